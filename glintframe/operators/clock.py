"""A monotonic clock for series whose source times stop, jump or run backwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOOK_BACK = 120


def monotonic_clock(df: DataFrame, keys: list[str], order: str = "n", time: str = "t", max_gap: float = 5.0) -> DataFrame:
    """Append ``tc`` (seconds from the first row) and ``anomaly``.

    A step that is not positive or longer than ``max_gap`` counts as the median of the last
    ``LOOK_BACK`` good steps before it (1/30 if there is none).
    """
    by = Window.partitionBy(*keys).orderBy(order)
    steps = df.withColumn("__dt", F.col(time) - F.lag(time).over(by)).withColumn("__good", (F.col("__dt") > 0) & (F.col("__dt") <= max_gap))
    # Good rows form a window of their own within the key: the same shuffle serves both windows.
    among_good = Window.partitionBy(*keys, "__good").orderBy(order).rowsBetween(-(LOOK_BACK - 1), 0)
    known = steps.withColumn("__median", F.when(F.col("__good"), F.expr("percentile(__dt, 0.5D)").over(among_good)))
    before = F.last("__median", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    step = F.when(F.col("__dt").isNull(), F.lit(0.0)).when(F.col("__good"), F.col("__dt")).otherwise(F.coalesce("__before", F.lit(1.0) / 30))
    known = known.withColumn("__before", before).withColumn("__step", step)
    return (
        known.withColumn("tc", F.sum("__step").over(by.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("anomaly", (F.col("__dt").isNotNull() & ~F.col("__good")).cast("int"))
        .drop("__dt", "__good", "__median", "__before", "__step")
    )


def to_native(points: DataFrame, frames: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Append ``native``: the source time at clock time ``at``, interpolated between frames and clamped.

    An as-of join: points and frames are sorted together and the frames on either side carried over.
    """
    both = points.select(*keys, F.col(at).alias("__x"), F.lit(None).cast("struct<tc:double,t:double>").alias("__f"), F.struct(*points.columns).alias("__p"))
    frame = frames.select(*keys, F.col("tc").alias("__x"), F.struct("tc", "t").alias("__f"), F.lit(None).cast(both.schema["__p"].dataType).alias("__p"))
    rows = both.unionByName(frame)
    up = Window.partitionBy(*keys).orderBy("__x", F.col("__p").isNotNull())
    # Frames at the very time of a point come before it either way.
    down = Window.partitionBy(*keys).orderBy(F.desc("__x"), F.col("__p").isNotNull())
    rows = rows.withColumn("__a", F.last("__f", ignorenulls=True).over(up)).withColumn("__b", F.last("__f", ignorenulls=True).over(down))
    a, b = F.col("__a"), F.col("__b")
    share = (F.col("__x") - a["tc"]) / (b["tc"] - a["tc"])
    native = F.when(a.isNull(), b["t"]).when(b.isNull() | (a["tc"] >= b["tc"]), a["t"]).otherwise(a["t"] + (b["t"] - a["t"]) * share)
    return rows.where("__p is not null").select("__p.*", native.alias("native"))


def fixed_clock(df: DataFrame, keys: list[str], order: str = "n", time: str = "t", max_gap: float = 5.0) -> DataFrame:
    """Append ``tc`` where every bad step counts as the median of all good ones (1/30 if there are none)."""
    by = Window.partitionBy(*keys).orderBy(order)
    steps = df.withColumn("__dt", F.col(time) - F.lag(time).over(by))
    good = (F.col("__dt") > 0) & (F.col("__dt") <= max_gap)
    usual = steps.where(good).groupBy(*keys).agg(F.expr("percentile(__dt, 0.5D)").alias("__m"))
    step = F.when(F.col("__dt").isNull(), F.lit(0.0)).when(good, F.col("__dt")).otherwise(F.coalesce("__m", F.lit(1.0) / 30))
    rows = steps.join(usual, keys, "left").withColumn("__step", step)
    return rows.withColumn("tc", F.sum("__step").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("__dt", "__m", "__step")


def merged_segments(rows: DataFrame, keys: list[str], segment: str, start: str, max_gap: float = 5.0) -> DataFrame:
    """One clock over segments scanned apart: each segment's run-up (rows before its start) is dropped, then all rows are timed anew."""
    kept = rows.where(F.col("t") >= F.col(start) - 1e-9)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(segment, "n")) - 1
    return monotonic_clock(kept.withColumn("place", place), keys, "place", "t", max_gap)
