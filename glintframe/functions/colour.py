"""Colour quantities as column expressions and, for packed pictures, as numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB's luminance weights and XYZ rows, and the chromaticity of its red primary.
LUMA = (0.2126, 0.7152, 0.0722)
X_ROW = (0.4124, 0.3576, 0.1805)
Z_ROW = (0.0193, 0.1192, 0.9505)
RED_UV = (0.4507966, 0.5228869)
SATURATED = 1 << 31
LEAST_RED_SWING = 0.08

_codes = np.arange(256) / 255
LINEAR = np.where(_codes <= 0.04045, _codes / 12.92, ((_codes + 0.055) / 1.055) ** 2.4).astype(np.float32)


def linear(code: Column) -> Column:
    """Linear light of an sRGB code 0 to 255."""
    v = code / F.lit(255.0)
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4))).cast("float")


def _f(x: float) -> Column:
    return F.lit(x).cast("float")


def weighted(weights: tuple, r: Column, g: Column, b: Column) -> Column:
    return _f(weights[0]) * r + _f(weights[1]) * g + _f(weights[2]) * b


def luminance(r: Column, g: Column, b: Column) -> Column:
    """Relative luminance of linear channels, in 32-bit floats from left to right."""
    return weighted(LUMA, r, g, b)


def red_distance(r: Column, g: Column, b: Column, flare: float = 0.0035) -> Column:
    """How far a linear colour, with flare added, is from the red primary in the u'v' plane."""
    r, g, b = (c + _f(flare) for c in (r, g, b))
    x, y, z = weighted(X_ROW, r, g, b), luminance(r, g, b), weighted(Z_ROW, r, g, b)
    d = x + _f(15.0) * y + _f(3.0) * z
    du, dv = _f(4.0) * x / d - _f(RED_UV[0]), _f(9.0) * y / d - _f(RED_UV[1])
    return F.sqrt(du * du + dv * dv)


def saturated_red(r: Column, g: Column, b: Column, share: float = 0.8, flare: float = 0.0035) -> Column:
    r, g, b = (c + _f(flare) for c in (r, g, b))
    return r >= _f(share) * (r + g + b)


# 16.16 coefficients (Y scale, Y offset, R from V, G from U, G from V, B from U).
YUV = {"bt601-limited": (76309, 16, 104597, 25675, 53279, 132201), "bt709-limited": (76309, 16, 117489, 13975, 34925, 138438), "bt601-full": (65536, 0, 91881, 22554, 46802, 116130), "bt709-full": (65536, 0, 103206, 12276, 30679, 121609)}


def yuv_to_rgb(y: Column, u: Column, v: Column, matrix: str = "bt709-limited") -> list[Column]:
    """Red, green and blue codes of one sample, in integers."""
    scale, offset, rv, gu, gv, bu = YUV[matrix]
    base = (y - offset) * scale
    u, v = u - 128, v - 128
    return [F.greatest(F.lit(0), F.least(F.lit(255), F.shiftright((c + 32768).cast("int"), 16))) for c in (base + v * rv, base - u * gu - v * gv, base + u * bu)]


def planes(rgb: np.ndarray, saturation: float, flare: float, pack: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(luminance, distance from red, packed chromaticity) of sRGB codes (..., 3): float32, float32, int64; without ``pack`` no third."""
    f = np.float32
    r, g, b = (LINEAR[rgb[..., i]] for i in range(3))
    mix = lambda w, r, g, b: f(w[0]) * r + f(w[1]) * g + f(w[2]) * b
    light = mix(LUMA, r, g, b)
    r, g, b = r + f(flare), g + f(flare), b + f(flare)
    x, y, z = mix(X_ROW, r, g, b), mix(LUMA, r, g, b), mix(Z_ROW, r, g, b)
    d = x + f(15) * y + f(3) * z
    u, v = f(4) * x / d, f(9) * y / d
    du, dv = u - f(RED_UV[0]), v - f(RED_UV[1])
    if not pack:
        return light, np.sqrt(du * du + dv * dv), None
    packed = (np.minimum(np.floor(u * f(32768) + f(0.5)), 0x7FFF).astype(np.int64) << 16) | np.minimum(np.floor(v * f(65536) + f(0.5)), 0xFFFF).astype(np.int64)
    return light, np.sqrt(du * du + dv * dv), packed | np.where(r >= f(saturation) * (r + g + b), SATURATED, 0)


def red_transition(a: np.ndarray, b: np.ndarray, delta: float) -> np.ndarray:
    """Whether packed colours are far apart and one of them is a saturated red."""
    f = np.float32
    du = (((a >> 16) & 0x7FFF).astype(f) - ((b >> 16) & 0x7FFF).astype(f)) / f(32768)
    dv = ((a & 0xFFFF).astype(f) - (b & 0xFFFF).astype(f)) / f(65536)
    return (((a | b) & SATURATED) != 0) & (du * du + dv * dv > f(delta) * f(delta))


def default_matrix(height: Column) -> Column:
    """The matrix of a picture whose stream names none."""
    return F.when(height > 576, "bt709").otherwise("bt601")


def by_matrix(name: Column, y: Column, u: Column, v: Column) -> list[Column]:
    """Red, green and blue codes of one sample, by the matrix that a column names."""
    out = [F.lit(None).cast("long")] * 3
    for matrix in YUV:
        out = [F.when(name == matrix, made).otherwise(rest) for made, rest in zip(yuv_to_rgb(y, u, v, matrix), out, strict=True)]
    return out


def red_step(a: Column, b: Column, delta: float) -> Column:
    """``red_transition`` of packed colours in columns of long."""
    du = (F.shiftright(a, 16).bitwiseAND(F.lit(0x7FFF)) - F.shiftright(b, 16).bitwiseAND(F.lit(0x7FFF))) / F.lit(32768.0)
    dv = (a.bitwiseAND(F.lit(0xFFFF)) - b.bitwiseAND(F.lit(0xFFFF))) / F.lit(65536.0)
    red = a.bitwiseOR(b).bitwiseAND(F.lit(SATURATED)) != 0
    return red & (du * du + dv * dv > F.lit(delta * delta))
