"""Times as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_time(text: Column) -> Column:
    """Seconds of "s", "m:s" or "h:m:s" (decimals allowed); null if a part is no number or is negative."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: p.try_cast("double"))
    bad = F.exists(parts, lambda p: p.isNull() | F.isnan(p) | (p < 0)) | (F.size(parts) > 3)
    return F.when(~bad, F.aggregate(parts, F.lit(0.0), lambda a, p: a * 60 + p))


def format_time(seconds: Column) -> Column:
    """m:ss.mmm, or h:mm:ss.mmm from an hour on."""
    ms = F.round(seconds * 1000).cast("long")
    h, m, s, r = F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000
    long = F.format_string("%d:%02d:%02d.%03d", h, m, s, r)
    return F.when(h > 0, long).otherwise(F.format_string("%d:%02d.%03d", m, s, r))
