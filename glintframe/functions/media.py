"""Bytes of media as columns: container kinds by their first bytes, sound samples as numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values: (offset, hexadecimal bytes, kind) of containers, in the order they are tried.
MAGIC = [(4, "66747970", "mp4"), (0, "1A45DFA3", "mkv"), (0, "444B4946", "ivf"), (0, "464C56", "flv"), (0, "4F676753", "ogg"), (0, "3026B275", "wmv"), (0, "000001BA", "mpeg-ps"), (0, "52494646", "riff"), (0, "47", "ts")]


def container(head: Column) -> Column:
    """Kind of a container by its first bytes (a binary column); null if unknown."""
    text = F.hex(head)
    out = F.lit(None).cast("string")
    for offset, magic, kind in reversed(MAGIC):
        out = F.when(F.substring(text, 2 * offset + 1, len(magic)) == magic, kind).otherwise(out)
    return out


def pcm16(raw: Column) -> Column:
    """Array of floats from little-endian 16-bit samples."""
    text = F.hex(raw)
    one = lambda i: F.conv(F.concat(F.substr(text, i * 4 + 3, F.lit(2)), F.substr(text, i * 4 + 1, F.lit(2))), 16, 10).cast("int")
    whole = F.transform(F.sequence(F.lit(0), (F.length(raw) / 2).cast("int") - 1), one)
    return F.when(F.length(raw) >= 2, F.transform(whole, lambda v: F.when(v >= 32768, v - 65536).otherwise(v) / F.lit(32768.0))).otherwise(F.array().cast("array<double>"))


def pcm(codes: Column, bits: int) -> Column:
    """A sample of -1 to 1 from its little-endian code, an unsigned number of ``bits`` bits (8 bits: offset by half)."""
    half = 1 << (bits - 1)
    signed = codes - half if bits == 8 else F.when(codes >= half, codes - (1 << bits)).otherwise(codes)
    return signed / F.lit(float(half))


def a_law(code: Column) -> Column:
    """A sample of -1 to 1 from an A-law byte: every second bit is turned, then sign, exponent and mantissa."""
    c = code.bitwiseXOR(F.lit(0x55))
    exponent, mantissa = F.shiftright(c, 4).bitwiseAND(F.lit(7)), c.bitwiseAND(F.lit(15))
    size = F.when(exponent == 0, mantissa * 16 + 8).otherwise((mantissa * 16 + 264) * F.pow(F.lit(2.0), exponent - 1))
    return F.when(c.bitwiseAND(F.lit(128)) != 0, size).otherwise(-size) / F.lit(32768.0)


def mu_law(code: Column) -> Column:
    """A sample of -1 to 1 from a mu-law byte: all bits are turned, and a bias of 132 is taken off."""
    c = code.bitwiseXOR(F.lit(0xFF))
    size = (c.bitwiseAND(F.lit(15)) * 8 + 132) * F.pow(F.lit(2.0), F.shiftright(c, 4).bitwiseAND(F.lit(7))) - 132
    return F.when(c.bitwiseAND(F.lit(128)) != 0, -size).otherwise(size) / F.lit(32768.0)
