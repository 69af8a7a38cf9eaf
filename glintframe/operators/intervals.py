"""Intervals from rows, and intervals against intervals: islands, merging, coverage, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.operators.flashes import spread


def hundredths(area: Column, threshold: int) -> Column:
    """area / threshold to two decimals, ties to even."""
    return F.rint(area.cast("double") / threshold * 100) / 100


def islands(df: DataFrame, keys: list[str], order: list, joins: Column, name: str = "island") -> DataFrame:
    """Append the number of the run that a row belongs to; ``joins``: it continues the row before it."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(joins, 0).otherwise(1)).over(by))


def strobe_violations(stats: DataFrame, keys: list[str], threshold: int, area: str = "area", gap: float = 1.0) -> DataFrame:
    """Spans of rows (n, t, tc, onset) whose area reaches the threshold and that follow within ``gap``.

    Columns: keys, start, end, severity, onset, peak.  The peak is the first row of the highest severity; the end and
    the onset are the latest and earliest of all rows.
    """
    by = Window.partitionBy(*keys).orderBy("n")
    rows = stats.where(F.col(area) >= threshold).withColumn("severity", hundredths(F.col(area), threshold))
    rows = islands(rows, keys, ["n"], F.col("tc") - F.lag("tc").over(by) <= gap)
    return rows.groupBy(*keys, "island").agg(
        F.min_by("t", "n").alias("start"),
        F.max("t").alias("end"),
        F.max("severity").alias("severity"),
        F.min(F.least("t", "onset")).alias("onset"),
        F.min_by("t", F.struct(-F.col("severity"), F.col("n"))).alias("peak"),
    )


def pattern_violations(stats: DataFrame, keys: list[str], threshold: int, hold: float = 0.5, least: float = 0.5) -> DataFrame:
    """Spans of rows with a striped area of at least ``threshold``, kept if they last ``least`` seconds with their last frame."""
    by = Window.partitionBy(*keys).orderBy("n")
    step = stats.withColumn("__d", F.col("tc") - F.lag("tc").over(by)).where("__d > 0").groupBy(*keys).agg(F.expr("percentile(__d, 0.5D)").alias("frame"))
    rows = stats.where(F.col("pattern") >= threshold).withColumn("severity", hundredths(F.col("pattern"), threshold))
    rows = islands(rows, keys, ["n"], F.col("tc") - F.lag("tc").over(by) <= hold)
    spans = rows.groupBy(*keys, "island").agg(
        F.min("t").alias("start"), F.max("t").alias("end"), (F.max("tc") - F.min("tc")).alias("lasts"), F.max("severity").alias("severity"), F.min_by("t", F.struct(-F.col("severity"), F.col("n"))).alias("peak")
    )
    return spans.join(step, keys, "left").where(F.col("lasts") + F.coalesce("frame", F.lit(1.0) / 30) >= least).drop("lasts", "frame", "island")


def warning_spans(stats: DataFrame, keys: list[str], threshold: int, general: str = "warn", red: str = "warn_red") -> DataFrame:
    """Spans where the louder of two areas reaches the threshold; red if it is louder at the worst row."""
    by = Window.partitionBy(*keys).orderBy("n")
    rows = stats.withColumn("__a", F.greatest(general, red)).where(F.col("__a") >= threshold)
    rows = rows.withColumn("severity", hundredths(F.col("__a"), threshold))
    rows = islands(rows, keys, ["n"], F.col("tc") - F.lag("tc").over(by) <= 1.0)
    worst = F.min_by(F.struct("t", F.when(F.col(red) > F.col(general), "red").otherwise("flash").alias("kind")), F.struct(-F.col("severity"), F.col("n")))
    spans = rows.groupBy(*keys, "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.max("severity").alias("severity"), worst.alias("w"))
    return spans.select(*keys, "start", "end", "severity", F.col("w.kind").alias("kind"), F.col("w.t").alias("peak"))


def asof(points: DataFrame, at: Column, others: DataFrame, time: str, value: Column, keys: list[str], name: str, after: bool = False, strict: bool = False) -> DataFrame:
    """Append to points ``name``: the value of the last of ``others`` whose time is at or before ``at``.

    ``after`` takes the first at or after it, ``strict`` leaves out those at ``at`` itself.  Null if there is none.
    Points and others are sorted together, so that no pairs of one key are made; keys that are null are one key.
    """
    value = F.struct(value.alias("v"))
    point = points.select(*keys, at.cast("double").alias("__x"), F.lit(None).cast(others.select(value.alias("__v")).schema["__v"].dataType).alias("__v"), F.struct(*points.columns).alias("__p"))
    other = others.select(*keys, F.col(time).cast("double").alias("__x"), value.alias("__v"), F.lit(None).cast(point.schema["__p"].dataType).alias("__p"))
    first = F.col("__p").isNull() if strict else F.col("__p").isNotNull()
    by = Window.partitionBy(*keys).orderBy(F.desc("__x") if after else F.asc("__x"), first)
    rows = spread(point.unionByName(other), *keys).withColumn("__v", F.last("__v", ignorenulls=True).over(by))
    return rows.where("__p is not null").select("__p.*", F.col("__v.v").alias(name))


def touching(rows: DataFrame, low: Column, high: Column, spans: DataFrame, start: Column, end: Column, keys: list[str], closed: bool = True) -> DataFrame:
    """Append ``touches``: whether [low, high] meets some span of its key, which is if the farthest end of those that start by ``high`` reaches ``low``.

    One running maximum over the sorted union; no pairs of one key are made.
    """
    point = rows.select(*keys, high.cast("double").alias("__x"), F.lit(None).cast("double").alias("__e"), low.cast("double").alias("__low"), F.struct(*rows.columns).alias("__p"))
    span = spans.select(*keys, start.cast("double").alias("__x"), end.cast("double").alias("__e"), F.lit(None).cast("double").alias("__low"), F.lit(None).cast(point.schema["__p"].dataType).alias("__p"))
    by = Window.partitionBy(*keys).orderBy("__x", F.col("__p").isNotNull() if closed else F.col("__p").isNull())
    reach = F.max("__e").over(by)
    met = spread(point.unionByName(span), *keys).withColumn("__m", F.coalesce(reach >= F.col("__low") if closed else reach > F.col("__low"), F.lit(False)))
    return met.where("__p is not null").select("__p.*", F.col("__m").alias("touches"))


def not_over(spans: DataFrame, louder: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that touch no span of ``louder`` (closed at both ends)."""
    return touching(spans, F.col("start"), F.col("end"), louder, F.col("start"), F.col("end"), keys).where("NOT touches").drop("touches")


def close_calls(limit: DataFrame, strict: DataFrame, violations: DataFrame, keys: list[str]) -> DataFrame:
    """Spans at the limit that no violation (from its onset) overlaps, and stricter ones that neither overlaps."""
    loud = violations.select(*keys, F.least("onset", "start").alias("start"), "end")
    kept = not_over(limit, loud, keys)
    return kept.withColumn("level", F.lit("limit")).unionByName(not_over(strict, loud.unionByName(kept.select(*keys, "start", "end")), keys).withColumn("level", F.lit("strict")))


def merge_spans(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end", gap: float = 0) -> DataFrame:
    """Disjoint spans: empty ones dropped, those that touch (or lie within ``gap``) merged."""
    rows = spans.where(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("start"), F.col(end).alias("end"))
    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    rows = islands(rows.withColumn("__reach", F.max("end").over(before)), keys, ["start", "end"], F.col("start") - F.col("__reach") <= gap)
    return rows.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("parts")).drop("island")


def coverage(positions: DataFrame, spans: DataFrame, keys: list[str], width: Column) -> DataFrame:
    """Append to positions (column x): seconds of [x, x + width] that disjoint spans cover, and where they open and end.

    The length covered up to a place is that of all spans before the last one to start, and what of this one
    lies before the place.  Positions of keys without spans are left out.
    """
    before = Window.partitionBy(*keys).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    sums = spans.select(*keys, "start", "end", F.coalesce(F.sum(F.col("end") - F.col("start")).over(before), F.lit(0)).alias("before"))
    span = F.struct("start", "end", "before")
    end = F.col("x") + width
    rows = asof(positions, F.col("x"), sums, "start", span, keys, "__at")
    rows = asof(rows, F.col("x"), sums, "start", F.col("start"), keys, "__next", after=True, strict=True)
    rows = asof(rows, end, sums, "start", span, keys, "__to", strict=True)
    up_to = lambda c, y: F.coalesce(F.col(f"{c}.before") + F.least(y, F.col(f"{c}.end")) - F.col(f"{c}.start"), F.lit(0.0))
    opens = F.when(F.col("__at.end") > F.col("x"), F.col("x")).otherwise(F.col("__next"))
    rows = rows.withColumn("covered", F.greatest(F.lit(0.0), up_to("__to", end) - up_to("__at", F.col("x"))))
    rows = rows.withColumn("start", opens).withColumn("end", F.when(F.col("__to").isNotNull(), F.least(F.col("__to.end"), end)))
    return rows.where("start is not null or end is not null").drop("__at", "__next", "__to")


def extended_flashes(stats: DataFrame, keys: list[str], threshold: int, hold: float = 1.0, window: float = 5.0, share: float = 0.8) -> DataFrame:
    """Spans in which flashing at the limit covers ``share`` of some window of ``window`` seconds.

    Coverage changes linearly between corners, so only windows that open or end with a lit span are tried.
    """
    hits = stats.where(F.greatest("ext", "ext_red") >= threshold).select(*keys, F.col("tc").alias("h"))
    bounds = stats.groupBy(*keys).agg(F.min("tc").alias("lo"), F.max("tc").alias("hi"))
    lit = merge_spans(hits.join(bounds, keys).select(*keys, F.col("h").alias("start"), F.least(F.col("h") + hold, "hi").alias("end")), keys).drop("parts")
    whole = F.col("hi") - F.col("lo") >= window
    room = bounds.where(F.col("hi") - F.col("lo") >= 0.9 * window).select(*keys, "lo", F.when(whole, F.lit(window)).otherwise(F.col("hi") - F.col("lo")).alias("wd"), F.when(whole, F.col("hi") - window).otherwise(F.col("lo")).alias("xh"))
    edges = lit.join(room, keys).select(*keys, "lo", "wd", "xh", F.explode(F.array(F.col("start"), F.col("end") - F.col("wd"))).alias("x"))
    ends = room.select(*keys, "lo", "wd", "xh", F.explode(F.array("lo", "xh")).alias("x"))
    tried = edges.unionByName(ends).where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("xh"))).select(*keys, "x", "wd").distinct()
    full = coverage(tried, lit, keys, F.col("wd")).where((F.col("covered") / F.col("wd") >= share) & (F.col("end") > F.col("start")))
    spans = merge_spans(full, keys).drop("parts")
    last = asof(spans, F.col("end"), hits, "h", F.col("h"), keys, "last").where("last is not null")
    return last.select(*keys, "start", F.col("last").alias("end"))


def sections(violations: DataFrame, keys: list[str], duration: str, pad: float = 1.5, gap: float = 3.0, least: float = 2.0, most: float = 45.0) -> DataFrame:
    """Work sections around violations (onset, start, end, kind): padded, clamped, widened to ``least``, merged over
    gaps up to ``gap``, and split into equal parts of at most ``most`` seconds."""
    rows = violations.select(*keys, duration, "kind", F.greatest(F.lit(0.0), F.least("onset", "start") - pad).alias("s"), F.least(F.col(duration), F.col("end") + pad).alias("e"))
    short = F.col("e") - F.col("s") < least
    centre = (F.col("s") + F.col("e")) / 2
    rows = rows.select(*keys, duration, "kind", F.when(short, F.greatest(F.lit(0.0), centre - least / 2)).otherwise(F.col("s")).alias("s"), F.when(short, F.least(F.col(duration), centre + least / 2)).otherwise(F.col("e")).alias("e"))
    before = Window.partitionBy(*keys).orderBy("s", "e", "kind").rowsBetween(Window.unboundedPreceding, -1)
    rows = islands(rows.withColumn("__reach", F.max("e").over(before)), keys, ["s", "e", "kind"], F.col("s") - F.col("__reach") <= gap)
    spans = rows.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.array_join(F.array_sort(F.collect_set("kind")), ",").alias("kinds"))
    parts = F.greatest(F.lit(1), F.ceil((F.col("e") - F.col("s")) / most)).cast("int")
    spans = spans.withColumn("parts", parts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    length = (F.col("e") - F.col("s")) / F.col("parts")
    return spans.select(*keys, F.round(F.col("s") + length * F.col("k"), 6).alias("start"), F.round(F.when(F.col("k") == F.col("parts") - 1, F.col("e")).otherwise(F.col("s") + length * (F.col("k") + 1)), 6).alias("end"), "kinds")


def snap_to_marks(spans: DataFrame, marks: DataFrame, keys: list[str], mark: str = "mark", slack: float = 1e-6) -> DataFrame:
    """Widen spans to the last mark at or before the start and the first at or after the end."""
    rows = asof(spans, F.col("start") + slack, marks, mark, F.col(mark), keys, "__b")
    rows = asof(rows, F.col("end") - slack, marks, mark, F.col(mark), keys, "__a", after=True)
    return rows.withColumn("snap_start", F.coalesce("__b", "start")).withColumn("snap_end", F.coalesce("__a", "end")).drop("__a", "__b")


def timeline(events: DataFrame, keys: list[str], time: str, width: float, kinds: list[str], kind: str = "kind") -> DataFrame:
    """Events of each kind per bin; every bin from the first to the last of a key is there."""
    binned = events.withColumn("bin", F.floor(F.col(time) / width))
    counts = binned.groupBy(*keys, "bin").pivot(kind, kinds).count()
    span = binned.groupBy(*keys).agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"))
    bins = span.select(*keys, F.explode(F.sequence("lo", "hi")).alias("bin"))
    return bins.join(counts, [*keys, "bin"], "left").fillna(0, kinds)


def envelope(series: DataFrame, keys: list[str], micros: str, value: str, reach: int = 250_000) -> DataFrame:
    """Append the largest value within ``reach`` microseconds on either side."""
    return series.withColumn("envelope", F.max(value).over(Window.partitionBy(*keys).orderBy(micros).rangeBetween(-reach, reach)))


def reached(spans: DataFrame, others: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """Spans that some other span lies within ``reach`` of."""
    return touching(spans, F.col("start"), F.col("end"), others, F.col("start") - reach, F.col("end") + reach, keys).where("touches").drop("touches")


def violation_spans(violations: DataFrame, keys: list[str], pad: float = 0.3) -> DataFrame:
    """Where edits may act: each violation from its onset, padded, merged."""
    return merge_spans(violations.select(*keys, (F.least("onset", "start") - pad).alias("start"), (F.col("end") + pad).alias("end")), keys)


def free_ranges(wanted: DataFrame, taken: DataFrame, keys: list[str], duration: str) -> DataFrame:
    """Ranges clamped to the duration and rounded to microseconds, without empty ones and those that overlap a taken one."""
    rows = wanted.select(*keys, F.round(F.greatest(F.lit(0.0), F.col("start")), 6).alias("start"), F.round(F.least(F.col("end"), F.col(duration)), 6).alias("end")).where("end > start")
    return touching(rows, F.col("start"), F.col("end"), taken, F.col("start") + 1e-6, F.col("end") - 1e-6, keys, closed=False).where("NOT touches").drop("touches")


def labelled(sections: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Append ``kinds``: the sorted kinds of all spans that overlap a section.  Each section is tried once for each kind of its key."""
    kinds = spans.where("kind is not null").select(*keys, F.col("kind").alias("__k")).distinct()
    tried = sections.join(kinds, keys, "left")
    met = touching(tried, F.col("start"), F.col("end"), spans.withColumnRenamed("kind", "__k"), F.col("start"), F.col("end"), [*keys, "__k"], closed=False)
    return met.groupBy(*sections.columns).agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("touches"), F.col("__k")))), ",").alias("kinds"))


def located(points: DataFrame, spans: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Append to points the span (start, end, id) that holds them, null if none; spans of one key don't overlap.

    An as-of join over the sorted union: the last span that starts at or before the point, if it ends after it.
    """
    point = points.select(*keys, F.col(at).alias("__x"), F.lit(None).cast(spans.select(F.struct("start", "end", "id")).schema[0].dataType).alias("__s"), F.struct(*points.columns).alias("__p"))
    span = spans.select(*keys, F.col("start").alias("__x"), F.struct("start", "end", "id").alias("__s"), F.lit(None).cast(point.schema["__p"].dataType).alias("__p"))
    up = Window.partitionBy(*keys).orderBy("__x", F.col("__p").isNotNull())
    rows = spread(point.unionByName(span), *keys).withColumn("__last", F.last("__s", ignorenulls=True).over(up)).where("__p is not null")
    return rows.select("__p.*", F.when(F.col("__x") < F.col("__last.end"), F.col("__last")).alias("__in")).select(*points.columns, "__in.start", "__in.end", "__in.id")


def pulses(marked: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Runs of consecutive ordinals: first, last and length."""
    run = F.col(ordinal) - F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal))
    runs = marked.withColumn("__run", run).groupBy(*keys, "__run")
    return runs.agg(F.min(ordinal).alias("first"), F.max(ordinal).alias("last"), F.count(F.lit(1)).alias("length")).drop("__run")
