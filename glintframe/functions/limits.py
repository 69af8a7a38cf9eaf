"""Rules that follow from the settings, for tables that hold settings as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fails_from(flash_limit: Column) -> Column:
    """Flashes within a second that fail."""
    return F.greatest(F.lit(1), F.floor(flash_limit) + 1).cast("long")


def extended_from(flash_limit: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(flash_limit)).cast("long")


def safe_rate(flash_limit: Column, extended: Column) -> Column:
    """Pictures a second that can't flash too often, to two decimals."""
    pairs = fails_from(flash_limit) - 1
    pairs = F.when(extended, F.least(pairs, extended_from(flash_limit) - 1)).otherwise(pairs)
    return F.floor(2 * pairs / F.lit(1.05) * 100) / 100


def context_seconds(extended: Column) -> Column:
    return F.when(extended, 6.5).otherwise(4.5)


def analysis_side(side: Column, fit: Column) -> Column:
    """A side of the analysed picture: scaled, even, at least 2."""
    return F.greatest(F.lit(2), F.bround(side * fit / 2) * 2).cast("long")


def analysis_size(width: Column, height: Column, screen_w: int, screen_h: int, scale: float) -> tuple[Column, Column]:
    fit = F.least(F.lit(float(screen_w)) / width, F.lit(float(screen_h)) / height) * scale
    return analysis_side(width, fit), analysis_side(height, fit)


def age(now_us: Column, then_us: Column) -> Column:
    """Microseconds since, at most 2**30."""
    return F.least(now_us - then_us, F.lit(1 << 30).cast("long"))
