"""From a removal that passes to the fewest removals: flashes put back, then frames let into long gaps.

All series are tried at once.  Between rounds a table keeps what each series that still fails tries next; series
that are done leave the plan, and the rounds end when none is left or the rates are used up.  A round costs one
simulation of what is still open, and a series takes no more than two rounds a rate and ``THIN_TRIES`` for its gaps.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.config import Config
from glintframe.operators.flashes import sorted_fold
from glintframe.operators.intervals import touching
from glintframe.operators.packets import discrete_quantile
from glintframe.plans.search import flashing_spans
from glintframe.tables import stored

# Flashes a second that may stay, tried in this order; rounds of thinning; seconds beside a failing window.
RATES = (3, 2, 1)
THIN_TRIES = 3
BESIDE = 0.1


def frame_gaps(series: DataFrame, keys: list[str]) -> DataFrame:
    """keys, gap: the middle step between frames (1/30 without any)."""
    step = series.withColumn("__d", F.col("tc") - F.lag("tc").over(Window.partitionBy(*keys).orderBy("n")))
    usual = discrete_quantile(step.where("__d is not null"), keys, "__d", 0.5)
    return series.select(*keys).distinct().join(usual, keys, "left").select(*keys, F.coalesce("quantile", F.lit(1.0) / 30).alias("gap"))


def pulses(series: DataFrame, removed: DataFrame, keys: list[str]) -> DataFrame:
    """Removed frames (keys, n) with their run of consecutive ones: first (its number), tc, a and b (its first and last time),
    before and after (times of the frames beside it, null at the ends)."""
    by = Window.partitionBy(*keys).orderBy("n")
    rows = series.select(*keys, "n", "tc", F.lag("tc").over(by).alias("before"), F.lead("tc").over(by).alias("after")).join(removed.select(*keys, "n").distinct(), [*keys, "n"])
    rows = rows.withColumn("__run", F.col("n") - F.row_number().over(by))
    run = Window.partitionBy(*keys, "__run")
    ends = {"first": F.min("n").over(run), "a": F.min("tc").over(run), "b": F.max("tc").over(run), "t0": F.min_by("before", "n").over(run), "t1": F.max_by("after", "n").over(run)}
    # min_by skips no nulls of its value, so a run at an end keeps its null
    return rows.withColumns(ends).select(*keys, "n", "tc", "first", "a", "b", F.col("t0").alias("before"), F.col("t1").alias("after"))


def choices(runs: DataFrame, gaps: DataFrame, keys: list[str]) -> DataFrame:
    """keys, per, first, a, b: the runs put back so that no more than ``per`` begin in a second and two frames."""
    heads = runs.select(*keys, "first", "a", "b").distinct().join(gaps, keys).withColumn("per", F.explode(F.array(*map(F.lit, RATES))))

    def begin():
        back: deque = deque()

        def step(row: dict):
            per = row["per"]
            keeps = len(back) < per or row["a"] - back[-per] > 1.0 + 2.0 * row["gap"]
            if keeps:
                back.append(row["a"])
                if len(back) > per:
                    back.popleft()
            return (keeps,)

        return step

    return sorted_fold(heads, [*keys, "per"], ["first"], [T.StructField("__back", T.BooleanType())], begin, [*keys, "per", "first", "a", "b"]).where("__back").drop("__back")


def unblamed(rows: DataFrame, failing: DataFrame, keys: list[str], low: Column, high: Column) -> DataFrame:
    """Rows whose stretch from ``low`` to ``high`` reaches no failing window."""
    return touching(rows, low, high, failing, F.col("start") - BESIDE, F.col("end") + BESIDE, keys).where("NOT touches").drop("touches")


def put_back(series: DataFrame, removed: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """keys, first, per: the runs of removed frames that may be shown again, with the rate at which they pass.

    Series start from RATES[0] flashes a second.  If that fails, the runs within failing windows go out again; if
    that fails too, or blames none, the next rate is tried.  A series without rows can have nothing back.
    """
    runs = stored(pulses(series, removed, keys), "restore-pulses")
    settled = runs.where("false").select(*keys, "first", F.lit(0).alias("per"))
    offered = stored(choices(runs, frame_gaps(series, keys), keys), "restore-choices")
    state = offered.select(*keys).distinct().select(*keys, F.lit(RATES[0]).alias("per"), F.lit(False).alias("fixed"))
    tried = offered.where(F.col("per") == RATES[0])
    for k in range(2 * len(RATES)):
        state, tried = stored(state, f"restore-state-{k}"), stored(tried, f"restore-tried-{k}")
        if state.isEmpty():
            break
        gone = runs.join(state.select(*keys), keys, "left_semi").join(tried.select(*keys, "first"), [*keys, "first"], "left_anti")
        shown = series.join(state.select(*keys), keys, "left_semi").join(gone.select(*keys, "n"), [*keys, "n"], "left_anti")
        failing = stored(flashing_spans(shown, keys, cfg), f"restore-failing-{k}")
        fails = failing.select(*keys).distinct()
        settled = settled.unionByName(tried.join(fails, keys, "left_anti").select(*keys, "first", "per"))
        open_state = state.join(fails, keys, "left_semi")
        # runs that no failing window reaches stay for a second round at the same rate, if some but not all are left
        left = unblamed(tried.join(open_state.where("NOT fixed").select(*keys), keys, "left_semi"), failing, keys, F.col("a"), F.col("b"))
        left = stored(left, f"restore-left-{k}")
        count = lambda rows, name: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
        counted = open_state.join(count(tried, "before"), keys, "left").join(count(left, "now"), keys, "left").fillna(0, ["before", "now"])
        again = (~F.col("fixed")) & (F.col("now") < F.col("before")) & (F.col("now") > 0)
        state = counted.select(*keys, F.when(again, F.col("per")).otherwise(F.col("per") - 1).alias("per"), again.alias("fixed")).where("per > 0")
        same = left.join(state.where("fixed").select(*keys, "per"), [*keys, "per"], "left_semi")
        tried = same.unionByName(offered.join(state.where("NOT fixed").select(*keys, "per"), [*keys, "per"], "left_semi").select(same.columns))
    return settled


def gap_frames(runs: DataFrame, gaps: DataFrame, keys: list[str], apart: float) -> DataFrame:
    """keys, n, first, t0, t1: removed frames that can be shown again ``apart`` seconds from each other and from the pictures on
    either side of their run (at an end of the series: a frame's step beyond it)."""
    rows = runs.join(gaps, keys).withColumn("t0", F.coalesce("before", F.col("a") - F.col("gap"))).withColumn("t1", F.coalesce("after", F.col("b") + F.col("gap")))

    def begin():
        last = [None]

        def step(row: dict):
            since = row["t0"] if last[0] is None else last[0]
            shows = row["tc"] - since >= apart - 1e-9 and row["t1"] - row["tc"] >= apart - 1e-9
            if shows:
                last[0] = row["tc"]
            return (shows,)

        return step

    made = sorted_fold(rows, [*keys, "first"], ["n"], [T.StructField("__shows", T.BooleanType())], begin, [*keys, "first", "n", "t0", "t1"])
    return made.where("__shows").drop("__shows")


def thin_gaps(series: DataFrame, removed: DataFrame, keys: list[str], cfg: Config, apart: float | None = None) -> DataFrame:
    """keys, n: frames of long runs of removed ones that are shown again, at a rate that can't flash by itself.

    Runs that failing windows reach are left as they were; so is the whole series after ``THIN_TRIES`` tries, or if no run is to blame.
    """
    runs = pulses(series, removed, keys)
    live = gap_frames(runs, frame_gaps(series, keys), keys, 1 / cfg.safe_rate if apart is None else apart)
    settled = removed.select(*keys, "n").where("false")
    for k in range(THIN_TRIES):
        live = stored(live, f"thin-live-{k}")
        if live.isEmpty():
            break
        mine = live.select(*keys).distinct()
        gone = removed.join(mine, keys, "left_semi").select(*keys, "n").join(live.select(*keys, "n"), [*keys, "n"], "left_anti")
        shown = series.join(mine, keys, "left_semi").join(gone, [*keys, "n"], "left_anti")
        failing = stored(flashing_spans(shown, keys, cfg), f"thin-failing-{k}")
        fails = failing.select(*keys).distinct()
        settled = settled.unionByName(live.join(fails, keys, "left_anti").select(*keys, "n"))
        blamed = live.join(fails, keys, "left_semi")
        left = unblamed(blamed, failing, keys, F.col("t0"), F.col("t1"))
        fewer = blamed.groupBy(*keys).agg(F.count_distinct("first").alias("before")).join(left.groupBy(*keys).agg(F.count_distinct("first").alias("now")), keys).where("now < before")
        live = left.join(fewer.select(*keys), keys, "left_semi")
    return settled


def fewest_removals(series: DataFrame, removed: DataFrame, keys: list[str], cfg: Config) -> DataFrame:
    """keys, n, back (``flash``, ``gap`` or null): every frame of a passing removal, and why it is shown again if it is."""
    frames = stored(removed.select(*keys, "n").distinct(), "removed-frames")
    runs = pulses(series, frames, keys).select(*keys, "n", "first")
    flashes = stored(runs.join(put_back(series, frames, keys, cfg).select(*keys, "first"), [*keys, "first"], "left_semi").select(*keys, "n"), "flashes-back")
    still = frames.join(flashes, [*keys, "n"], "left_anti")
    gaps = thin_gaps(series, still, keys, cfg)
    why = flashes.withColumn("back", F.lit("flash")).unionByName(gaps.withColumn("back", F.lit("gap")))
    return frames.join(why, [*keys, "n"], "left")
