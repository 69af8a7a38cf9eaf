"""Checking an edited section as an export will show it: with its run-up and run-out, which are the originals, replaced by the
edited edge of a neighbouring section where one lies there.

Tables: frames(video, n, t, x), sections(video, id, start, end; disjoint), edited(video, id, shown, x: every section's
sequence as it will be shown, from 0) and tails(video, id, held: seconds that the last picture is held; may be empty).  All sections are composed and checked at once;
windows meet sections and frames by cells of ``need`` seconds, so no pairs of one video are made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.config import Config
from glintframe.operators.flashes import series_flashes
from glintframe.operators.intervals import islands

SLACK = 1e-6
KEYS = ["video", "id"]


def _cells(low: Column, high: Column, need: float) -> Column:
    return F.explode(F.sequence(F.floor(low / need), F.floor(high / need)))


def windows(sections: DataFrame, bounds: DataFrame, need: float) -> DataFrame:
    """video, id, side (lead or tail), lo, hi: ``need`` seconds before and after each section, within the video (bounds: first, last)."""
    rows = sections.join(bounds, "video")
    sides = F.array(
        F.struct(F.lit("lead").alias("side"), F.greatest("first", F.col("start") - need).alias("lo"), F.col("start").alias("hi")),
        F.struct(F.lit("tail").alias("side"), F.col("end").alias("lo"), F.least("last", F.col("end") + need).alias("hi")),
    )
    return rows.select(*KEYS, F.explode(sides).alias("w")).select(*KEYS, "w.*")


def neighbours(wanted: DataFrame, sections: DataFrame, need: float) -> DataFrame:
    """Windows with every other section in them: other, o_start, o_end."""
    own = wanted.select("*", _cells(F.col("lo"), F.greatest("lo", "hi"), need).alias("cell"))
    other = sections.select("video", F.col("id").alias("other"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), _cells(F.col("start"), F.col("end"), need).alias("cell"))
    met = own.join(other, ["video", "cell"]).where((F.col("other") != F.col("id")) & (F.col("o_end") > F.col("lo") + SLACK) & (F.col("o_start") < F.col("hi") - SLACK))
    return met.drop("cell").distinct()


def context(frames: DataFrame, sections: DataFrame, edited: DataFrame, need: float) -> DataFrame:
    """video, id, side, part, t, x: what stands before and after each section, in parts of their own times.

    Part 2 k is the original up to neighbour k, part 2 k + 1 that neighbour's edited edge (its last ``need`` seconds before, its first
    after a section) or, where it has no sequence, its originals; the last part goes on to the window's end.
    """
    bounds = frames.groupBy("video").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    wanted = windows(sections, bounds, need)
    group = Window.partitionBy(*KEYS, "side")
    found = neighbours(wanted, sections, need)
    done = F.max("o_end").over(group.orderBy("o_start").rowsBetween(Window.unboundedPreceding, -1))
    found = found.withColumn("k", F.row_number().over(group.orderBy("o_start")) - 1).withColumn("cursor", F.greatest("lo", F.coalesce(done, "lo")))
    lasts = edited.groupBy("video", F.col("id").alias("other")).agg(F.min("shown").alias("opens"), F.max("shown").alias("closes"))
    found = found.join(lasts, ["video", "other"], "left")
    before = found.select(*KEYS, "side", (F.col("k") * 2).alias("part"), F.col("cursor").alias("a"), F.col("o_start").alias("b"))
    bare = found.where("closes is null").select(*KEYS, "side", (F.col("k") * 2 + 1).alias("part"), F.greatest("cursor", "o_start").alias("a"), F.least("hi", "o_end").alias("b"))
    rest = wanted.join(found.groupBy(*KEYS, "side").agg(F.max("o_end").alias("covered"), F.count(F.lit(1)).alias("n")), [*KEYS, "side"], "left")
    rest = rest.select(*KEYS, "side", (F.coalesce("n", F.lit(0)) * 2).alias("part"), F.greatest("lo", F.coalesce("covered", "lo")).alias("a"), F.col("hi").alias("b"))
    ranges = before.unionByName(bare).unionByName(rest).where("a < b").withColumn("cell", _cells(F.col("a") - SLACK, F.col("b"), need))
    cells = frames.select("video", "t", "x", F.floor(F.col("t") / need).alias("cell"))
    originals = ranges.join(cells, ["video", "cell"]).where((F.col("a") - SLACK <= F.col("t")) & (F.col("t") < F.col("b") - SLACK))
    edges = found.where("closes is not null").select(*KEYS, "side", (F.col("k") * 2 + 1).alias("part"), "other", "opens", "closes")
    edges = edges.join(edited.select("video", F.col("id").alias("other"), F.col("shown").alias("t"), "x"), ["video", "other"])
    edges = edges.where(F.when(F.col("side") == "lead", F.col("t") > F.col("closes") - need).otherwise(F.col("t") < F.col("opens") + need))
    columns = [*KEYS, "side", "part", "t", "x"]
    return originals.select(columns).unionByName(edges.select(columns))


def middle_steps(frames: DataFrame, sections: DataFrame, need: float) -> DataFrame:
    """video, id, dt: the median step between a section's own frames (1/30 without any)."""
    own = sections.select(*KEYS, "start", "end", _cells(F.col("start"), F.col("end"), need).alias("cell"))
    rows = own.join(frames.select("video", "n", "t", F.floor(F.col("t") / need).alias("cell")), ["video", "cell"]).where("t >= start - 1e-9 and t < end - 1e-9")
    step = F.col("t") - F.lag("t").over(Window.partitionBy(*KEYS).orderBy("n"))
    usual = rows.select(*KEYS, step.alias("d")).where("d > 0").groupBy(*KEYS).agg(F.percentile("d", 0.5).alias("dt"))
    return sections.select(*KEYS).join(usual, KEYS, "left").fillna(1 / 30, ["dt"])


def composed(frames: DataFrame, sections: DataFrame, edited: DataFrame, tails: DataFrame, need: float) -> DataFrame:
    """video, id, side (lead, own, tail), n, tc, x: one sequence a section on one clock, 0 at its first picture.

    Parts follow each other at a middle step; the run-up ends a step before 0, the run-out begins a step after the last
    picture and what is held after it.
    """
    rows = context(frames, sections, edited, need).join(middle_steps(frames, sections, need), KEYS)
    part = rows.groupBy(*KEYS, "side", "part").agg(F.min("t").alias("base"), (F.max("t") - F.min("t")).alias("length"), F.max("dt").alias("dt"))
    earlier = Window.partitionBy(*KEYS, "side").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*KEYS, "side")
    total = F.sum(F.col("length") + F.col("dt")).over(whole)
    part = part.withColumn("at", F.coalesce(F.sum(F.col("length") + F.col("dt")).over(earlier), F.lit(0.0))).withColumn("total", total)
    ends = edited.groupBy(*KEYS).agg(F.max("shown").alias("last"))
    ends = ends.join(tails, KEYS, "left").fillna(0.0, ["held"])
    sides = rows.drop("dt").join(part, [*KEYS, "side", "part"]).join(ends, KEYS)
    # added up from the left, so that moments are the same doubles wherever they are worked out
    lead = F.col("at") + F.col("t") - F.col("base") - F.col("total")
    tail = F.col("last") + F.col("held") + F.col("dt") + F.col("at") + F.col("t") - F.col("base")
    tc = F.when(F.col("side") == "lead", lead).otherwise(tail)
    every = sides.select(*KEYS, "side", tc.alias("tc"), "x").unionByName(edited.join(sections.select(*KEYS), KEYS, "left_semi").select(*KEYS, F.lit("own").alias("side"), F.col("shown").alias("tc"), "x"))
    return every.withColumn("n", F.row_number().over(Window.partitionBy(*KEYS).orderBy("tc")) - 1)


def flash_spans(series: DataFrame, cfg: Config, gap: float = 1.0) -> DataFrame:
    """video, id, start, end, onset of flashing in composed sequences; the onset is where the oldest of the flashes that fail opened."""
    fold = series_flashes(series, KEYS, noise=cfg.noise, swing=cfg.swing, dark=cfg.dark, k=cfg.k_fail)
    oldest = fold.where("flash").select(*KEYS, "n", F.lag("opened", cfg.k_fail - 1).over(Window.partitionBy(*KEYS).orderBy("n")).alias("began"))
    by = Window.partitionBy(*KEYS).orderBy("n")
    rows = fold.join(oldest, [*KEYS, "n"], "left").withColumn("began", F.last("began", ignorenulls=True).over(by)).where("strobing")
    rows = islands(rows, KEYS, ["n"], F.col("tc") - F.lag("tc").over(by) <= gap)
    return rows.groupBy(*KEYS, "island").agg(F.min("tc").alias("start"), F.max("tc").alias("end"), F.min(F.least("tc", "began")).alias("onset")).drop("island")


def bucketed(spans: DataFrame, boundary: Column) -> DataFrame:
    """Append ``bucket`` to spans (start, end; shown_to: the last own picture, next_at: where the next section begins after it, or null).

    Flashing that began before the section and ends within ``boundary`` (the pooling after its first picture) is the run-up's.
    """
    start, end = F.col("start"), F.col("end")
    before = (end < -SLACK) | ((start < -SLACK) & (end <= boundary + SLACK))
    later = start > F.col("shown_to") + SLACK
    elsewhere = F.coalesce(start >= F.col("shown_to") + F.col("next_at") - SLACK, F.lit(False))
    return spans.withColumn("bucket", F.when(before, "before").when(later & elsewhere, "elsewhere").when(later, "after").otherwise("inside"))


def check(frames: DataFrame, sections: DataFrame, edited: DataFrame, tails: DataFrame, cfg: Config) -> DataFrame:
    """video, id, safe, and how much flashing lies before, inside, after and elsewhere: one row for each section with a sequence.

    Safe: none inside or after.
    """
    need = cfg.context_seconds
    series = composed(frames, sections, edited, tails, need)
    shown = edited.groupBy(*KEYS).agg(F.max("shown").alias("shown_to"))
    following = F.lead("start").over(Window.partitionBy("video").orderBy("start"))
    nexts = sections.withColumn("__next", following - F.col("end")).select(*KEYS, F.when(F.col("__next") < need, F.col("__next")).alias("next_at"))
    about = sections.select(*KEYS).join(shown, KEYS).join(nexts, KEYS, "left").join(tails, KEYS, "left").withColumn("next_at", F.col("next_at") + F.coalesce("held", F.lit(0.0)))
    spans = bucketed(flash_spans(series, cfg).join(about, KEYS), F.lit(cfg.pool))
    counts = spans.groupBy(*KEYS).pivot("bucket", ["before", "inside", "after", "elsewhere"]).count()
    made = about.select(*KEYS).join(counts, KEYS, "left").fillna(0, ["before", "inside", "after", "elsewhere"])
    return made.withColumn("safe", (F.col("inside") == 0) & (F.col("after") == 0))
