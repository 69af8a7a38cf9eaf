"""Searches for an edit that passes: every candidate is a row's variant, all are simulated in one plan.

A series (keys, n, tc, x) stands for what a viewer sees; frames that an edit removes show the picture
before them, so they are left out of the fold.  Variants multiply the rows by a small constant.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.config import Config
from glintframe.operators import edits
from glintframe.operators import intervals as V
from glintframe.operators.flashes import greedy_gaps, series_flashes
from glintframe.tables import stored

LADDER = 10


def _passing(kept: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """keys, passes: whether no failing rate is reached in what is kept."""
    fold = series_flashes(kept, keys, noise=cfg.noise, swing=cfg.swing, dark=cfg.dark, k=cfg.k_fail)
    return fold.groupBy(*keys).agg((~F.bool_or("strobing")).alias("passes"))


def search_rate(series: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """keys, rate, kept, frames, passes: the highest picture rate of a ladder whose thinned series passes.

    The ladder falls by a tenth from 0.9 of the source's rate, twice the safe rate at most, to the safe
    rate; the safe rate is the last resort, whether it passes or not.
    """
    by = Window.partitionBy(*keys).orderBy("n")
    step = series.withColumn("__d", F.col("tc") - F.lag("tc").over(by)).where("__d > 0").groupBy(*keys).agg((1 / F.expr("percentile(__d, 0.5D)")).alias("source"))
    first = F.greatest(F.lit(cfg.safe_rate), F.least(F.lit(2 * cfg.safe_rate), 0.9 * F.col("source")))
    rates = F.transform(F.sequence(F.lit(0), F.lit(LADDER - 1)), lambda i: F.greatest(F.lit(cfg.safe_rate), first * F.pow(F.lit(0.9), i)))
    variants = step.select(*keys, F.explode(F.array_distinct(rates)).alias("rate"))
    rows = series.join(variants, keys).withColumn("gap", 1 / F.col("rate"))
    own = [*keys, "rate"]
    kept = greedy_gaps(rows, own, "n", "tc", "gap")
    counts = kept.groupBy(*own).agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("frames"))
    tried = counts.join(_passing(kept.where("kept").drop("kept"), own, cfg), own)
    best = tried.groupBy(*keys).agg(F.max_by(F.struct("rate", "kept", "frames", "passes"), F.struct("passes", F.when(F.col("passes"), F.col("rate")).otherwise(-F.col("rate")))).alias("b"))
    return best.select(*keys, "b.*")


WAYS = ["light", "light-tight", "dark", "dark-tight", "light-hold", "dark-hold"]


def in_spans(series: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, span, n, tc, x: frames with the start of the span that holds them (spans of a key are disjoint, ends belong to them)."""
    both = series.select(*keys, F.col("tc").alias("__at"), "n", "x", F.lit(None).cast("struct<start:double,end:double>").alias("__s"))
    marks = spans.select(*keys, F.col("start").alias("__at"), F.lit(None).cast(series.schema["n"].dataType).alias("n"), F.lit(None).cast("double").alias("x"), F.struct("start", "end").alias("__s"))
    up = Window.partitionBy(*keys).orderBy("__at", F.col("n").isNotNull(), "n").rowsBetween(Window.unboundedPreceding, 0)
    inside = both.unionByName(marks).withColumn("__s", F.last("__s", ignorenulls=True).over(up)).where("n is not null and __at <= __s.end")
    return inside.select(*keys, F.col("__s.start").alias("span"), "n", F.col("__at").alias("tc"), "x")


def removal_ways(series: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, variant, n: the frames that each of the WAYS removes within spans."""
    inside = stored(in_spans(series, spans, keys), "inside-spans")  # read by every way
    own = [*keys, "span"]
    ways = []
    for side in ("light", "dark"):
        for tight in (False, True):
            ways.append(edits.percentile_cut(inside, own, "x", side, tight).select(*keys, "n", F.lit(f"{side}{'-tight' * tight}").alias("variant")))
        stays = edits.hold_extreme(inside, own, keep="dark" if side == "light" else "light").select(*keys, "n")
        ways.append(inside.select(*keys, "n").join(stays, [*keys, "n"], "left_anti").withColumn("variant", F.lit(f"{side}-hold")))
    gone = ways[0]
    for w in ways[1:]:
        gone = gone.unionByName(w)
    return gone.where("n > 0").distinct()


def suggest_removals(series: DataFrame, spans: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """keys, variant, removed, passes: the way of removing frames within spans that passes with the fewest removed.

    Ways: cut at the middle between percentiles, or close to the side that stays, on either side; or keep
    only the extreme frame of each span.
    """
    return best_way(series, spans, stored(removal_ways(series, spans, keys), "removals"), keys, cfg)


def best_way(series: DataFrame, spans: DataFrame, gone: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """keys, variant, removed, passes: the best of the ways (keys, variant, n)."""
    rows = series.join(spans.select(*keys).distinct(), keys, "left_semi").withColumn("variant", F.explode(F.array(*map(F.lit, WAYS))))
    left = rows.join(gone, [*keys, "variant", "n"], "left_anti")
    counts = gone.groupBy(*keys, "variant").agg(F.count(F.lit(1)).alias("removed"))
    tried = _passing(left, [*keys, "variant"], cfg).join(counts, [*keys, "variant"], "left").fillna(0, ["removed"])
    best = tried.groupBy(*keys).agg(F.min_by(F.struct("variant", "removed", "passes"), F.struct(~F.col("passes"), "removed", "variant")).alias("b"))
    return best.select(*keys, "b.*")


def flashing_spans(series: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """Merged spans (keys, start, end) of the second before every moment at the failing rate."""
    fold = series_flashes(series, keys, noise=cfg.noise, swing=cfg.swing, dark=cfg.dark, k=cfg.k_fail)
    hot = fold.where("strobing").select(*keys, (F.col("tc") - 1.0).alias("start"), F.col("tc").alias("end"))
    return V.merge_spans(hot, keys).select(*keys, "start", "end")


def minority_frames(series: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: within each span, the frames beyond the middle of its percentiles, on the light side unless the dark one is clearly smaller.
    """
    inside = in_spans(series, spans, keys).drop("tc")
    own = [*keys, "span"]
    low, high = (F.percentile("x", p) for p in (0.15, 0.85))
    cuts = inside.groupBy(*own).agg(low.alias("lo"), high.alias("hi")).where(F.col("hi") - F.col("lo") >= 1e-4)
    rows = inside.join(cuts.select(*own, ((F.col("lo") + F.col("hi")) / 2).alias("cut")), own)
    sides = rows.groupBy(*own).agg(F.count_if(F.col("x") > F.col("cut")).alias("light"), F.count_if(F.col("x") <= F.col("cut")).alias("dark"))
    rows = rows.join(sides.select(*own, (F.col("dark") < 0.8 * F.col("light")).alias("darker")), own)
    return rows.where(F.when(F.col("darker"), F.col("x") <= F.col("cut")).otherwise(F.col("x") > F.col("cut"))).select(*keys, "n").distinct()


def blended(series: DataFrame, marks: DataFrame, keys: list[str]) -> DataFrame:
    """Append to every row ``mixed``: a marked one's value between its unmarked neighbours (null where it isn't marked)."""
    by = Window.partitionBy(*keys).orderBy("n")
    rows = series.join(marks.select(*keys, "n", F.lit(True).alias("__m")), [*keys, "n"], "left")
    free = F.when(F.col("__m").isNull(), F.struct("n", "x"))
    a = F.last(free, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    b = F.first(free, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("__a", a).withColumn("__b", b)
    share = (F.col("n") - F.col("__a.n")) / (F.col("__b.n") - F.col("__a.n"))
    between = F.coalesce(F.col("__a.x") * (1 - share) + F.col("__b.x") * share, F.col("__a.x"), F.col("__b.x"), F.col("x"))
    return rows.withColumn("mixed", F.when(F.col("__m"), between)).drop("__m", "__a", "__b")


def suggest_blend(series: DataFrame, keys: list[str], cfg: Config, rounds: int = 3, steps: int = 20, room: float = 0.8) -> DataFrame:
    """keys, frames, marked, least, strength, safe: how strongly flashing frames must be blended with their neighbours to pass.

    Frames to blend are gathered in up to ``rounds`` rounds at full strength, each from what still flashes.
    Then every strength is a variant of one plan, and the least that passes is found among them by halving;
    the strength chosen leaves at most ``room`` of the flash that just passes.  A series that passes as it
    is has no marks and strength 0; one that full strength doesn't settle has strength 1 and isn't safe.
    """
    marks = None
    shown = series
    for r in range(rounds):
        spans = stored(flashing_spans(shown, keys, cfg), f"blend-spans-{r}")
        if r == 0:
            hot = spans.select(*keys).distinct()
        new = minority_frames(shown, spans, keys)
        marks = stored(new if marks is None else marks.unionByName(new).distinct(), f"blend-marks-{r}")
        if r < rounds - 1:
            shown = stored(blended(series, marks, keys).select(*keys, "n", "tc", F.coalesce("mixed", "x").alias("x")), f"blend-shown-{r}")
    rows = blended(series, marks, keys)
    strengths = F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step")
    share = F.col("step") / steps
    tried = rows.join(hot, keys, "left_semi").select(*keys, "n", "tc", "x", "mixed", strengths)
    tried = tried.select(*keys, "step", "n", "tc", F.coalesce(F.col("x") * (1 - share) + F.col("mixed") * share, F.col("x")).alias("x"))
    passes = _passing(tried, [*keys, "step"], cfg).groupBy(*keys)
    passes = passes.agg(F.transform(F.sort_array(F.collect_list(F.struct("step", "passes"))), lambda s: s["passes"]).alias("__ok"))
    ok = F.col("__ok")
    ends = F.struct(F.lit(0).alias("lo"), F.lit(steps).alias("hi"))
    halve = lambda e, _: F.when(e["hi"] - e["lo"] <= 1, e).when(F.element_at(ok, F.greatest(F.lit(1), F.floor((e["lo"] + e["hi"]) / 2).cast("int"))), F.struct(e["lo"].alias("lo"), F.floor((e["lo"] + e["hi"]) / 2).cast("int").alias("hi"))).otherwise(F.struct(F.floor((e["lo"] + e["hi"]) / 2).cast("int").alias("lo"), e["hi"].alias("hi")))
    found = passes.withColumn("__hi", F.aggregate(F.sequence(F.lit(1), F.lit(steps.bit_length())), ends, halve)["hi"]).withColumn("safe", F.element_at(ok, steps))
    least = F.col("__hi") / steps
    chosen = F.least(F.lit(steps), F.ceil((1 - room * (1 - least)) * steps - 1e-9)).cast("int")
    found = found.withColumn("__chosen", chosen).select(
        *keys, "safe", F.when(F.col("safe"), least).otherwise(1.0).alias("least"),
        F.when(~F.col("safe"), 1.0).when(F.element_at(ok, F.col("__chosen")), F.col("__chosen") / steps).otherwise(least).alias("strength"),
    )
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames"), F.count("mixed").alias("marked"))
    made = counts.join(found, keys, "left").fillna(0.0, ["least", "strength"]).fillna(True, ["safe"])
    return made.select(*keys, "frames", "marked", "least", "strength", "safe")


def two_scenes(frames: DataFrame, keys: list[str], apart: float = 12.0, rounds: int = 20) -> DataFrame:
    """Append ``scene`` (0 or 1; null if there is one scene): means of two groups of signatures under the mean absolute distance.

    The groups start from the first frame and the one farthest from it.  A section's frames (at most
    some seconds of video) are grouped in one task.
    """
    import numpy as np

    def group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("i")
        x = np.stack(rows["signature"].to_numpy()).astype(float)
        distance = lambda c: np.abs(x - c).mean(axis=1)
        centres = [x[0], x[int(distance(x[0]).argmax())]]
        side = None
        if np.abs(centres[0] - centres[1]).mean() >= apart:
            for _ in range(rounds):
                new = (distance(centres[1]) < distance(centres[0])).astype(int)
                if side is not None and (new == side).all():
                    break
                side = new
                if side.min() == side.max():
                    break
                centres = [x[side == k].mean(axis=0) for k in (0, 1)]
            if side.min() == side.max() or np.abs(centres[0] - centres[1]).mean() < apart:
                side = None
        out = rows[[*keys, "i"]].copy()
        out["scene"] = pd.array([None] * len(rows) if side is None else side, dtype="Int32")
        return out

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frames.schema if f.name in (*keys, "i"))
    return frames.select(*keys, "i", "signature").groupBy(*keys).applyInPandas(group, f"{kinds}, scene int")
