"""Packet indexes: summaries, chunks, and which chunks to look at first."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.operators.flashes import NEVER, sorted_fold
from glintframe.operators.intervals import touching


def index_summary(packets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per index (t seconds, sync): bounds, median step, keyframes, holes, jumps and repeats."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy(*order))
    rows = packets.withColumn("__d", step)
    good = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("packets"),
        F.count_if("sync").alias("keyframes"),
        F.min("t").alias("first"),
        F.max("t").alias("last"),
        F.expr("percentile(CASE WHEN __d > 0 THEN __d END, 0.5D)").alias("median_step"),
        F.count_if(F.col("__d") > 0.25).alias("holes"),
        F.count_if(F.col("__d") > 5).alias("jumps"),
        F.count_if(F.col("__d") <= 1e-9).alias("repeats"),
    )
    return good.withColumn("ends", F.col("last") + F.coalesce("median_step", F.lit(1.0) / 30))


def chunk_starts(packets: DataFrame, keys: list[str], order: str, length: float = 10.0, tail: float = 5.0) -> DataFrame:
    """Sync rows at which a chunk starts: each at least ``length`` after the one before and ``tail`` before the end."""
    ends = packets.groupBy(*keys).agg(F.min("t").alias("__first"), F.max("t").alias("__last"))
    rows = packets.where("sync").join(ends, keys)

    def begin():
        at = [NEVER]

        def step(row: dict):
            if at[0] == NEVER:
                at[0] = row["__first"]
            starts = row["t"] - at[0] >= length and row["__last"] - row["t"] >= tail
            if starts:
                at[0] = row["t"]
            return (starts,)

        return step

    return sorted_fold(rows, keys, [order], [T.StructField("starts", T.BooleanType())], begin, [*keys, order, "t"]).where("starts").drop("starts")


# Shares of a span between its start and the one before, and before the end; packets that are worth cutting.
SPAN_SHARE, END_SHARE, SPAN_LEAST = 0.75, 0.5, 120


def decode_spans(packets: DataFrame, keys: list[str], order: str, k: int, least: int = SPAN_LEAST) -> DataFrame:
    """Each series as at most ``k`` spans of about equal packets that can be decoded at once: part, from_order, from, to.

    A span starts at a keyframe at least ``SPAN_SHARE`` shares after the one before and ``END_SHARE`` of a share before the end;
    a series of fewer than ``least`` packets stays whole.  ``order`` counts packets from 1.
    """
    ends = packets.groupBy(*keys).agg(F.min("t").alias("__first"), F.max("t").alias("__last"), F.count(F.lit(1)).alias("__total"))
    rows = packets.where("sync").join(ends.where(F.col("__total") >= least), keys)

    def begin():
        last, cuts = 0, 0

        def step(row: dict):
            nonlocal last, cuts
            i, share = row[order] - 1, row["__total"] / k
            cut = i > 0 and cuts < k - 1 and row["__first"] < row["t"] < row["__last"] and i - last >= share * SPAN_SHARE and row["__total"] - i >= share * END_SHARE
            if cut:
                last, cuts = i, cuts + 1
            return (cut,)

        return step

    cuts = sorted_fold(rows, keys, [order], [T.StructField("cut", T.BooleanType())], begin, [*keys, order, "t"]).where("cut")
    starts = cuts.select(*keys, F.col(order).alias("from_order"), F.col("t").alias("from"))
    whole = ends.select(*keys, F.lit(1).cast(packets.schema[order].dataType).alias("from_order"), F.col("__first").alias("from"))
    by = Window.partitionBy(*keys).orderBy("from_order")
    made = whole.unionByName(starts).withColumn("part", F.row_number().over(by).cast("long")).withColumn("__to", F.lead("from").over(by))
    return made.join(ends.select(*keys, "__last"), keys).withColumn("to", F.coalesce("__to", "__last")).drop("__to", "__last")


# What each rank adds to a chunk's score, how small a keyframe is flat, and when a packet is a spike.
TRIAGE_WEIGHTS = {"weight": 0.25, "keys_rate": 0.2, "spike_rate": 0.3, "flat_rate": 0.25}
FLAT_SHARE, FLAT_BYTES_PER_PIXEL, SPIKE, UPPER, LEAST_CHUNKS = 0.25, 0.002, 3, 0.75, 4


def triage(packets: DataFrame, keys: list[str], chunk: str, pixels: int, share: float = 0.25) -> DataFrame:
    """Score the chunks of each index by their packets (size, sync, t) and mark the hottest ``share``.

    Features: bytes a packet, keyframes a second, spikes a second (other packets of more than three times
    the upper quartile of the chunk's own) and flat keyframes a second (under a quarter of the index's median
    keyframe, or under 0.002 bytes a pixel); each is ranked with ties at their mean.  A chunk lasts until the next one
    starts, the last one until the last packet and a median step.
    """
    group = [*keys, chunk]
    upper = discrete_quantile(packets.where("NOT sync"), group, "size", UPPER).withColumnRenamed("quantile", "p75")
    flat = discrete_quantile(packets.where("sync"), keys, "size", 0.5).withColumnRenamed("quantile", "key_size")
    step = packets.withColumn("__d", F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("order"))).groupBy(*keys)
    ends = step.agg((F.max("t") + F.coalesce(F.percentile(F.when(F.col("__d") > 0, F.col("__d")), 0.5), F.lit(0.0))).alias("ends"))
    rows = packets.join(upper, group, "left").join(flat, keys, "left")
    under = F.greatest(F.coalesce("key_size", F.lit(0)) * FLAT_SHARE, F.lit(FLAT_BYTES_PER_PIXEL * max(1, pixels)))
    made = rows.groupBy(*group).agg(
        F.min("t").alias("__t"),
        (F.sum("size") / F.count(F.lit(1))).alias("weight"),
        F.count_if("sync").alias("keys_rate"),
        F.count_if(~F.col("sync") & (F.col("size") > SPIKE * F.col("p75"))).alias("spike_rate"),
        F.count_if(F.col("sync") & (F.col("size") < under)).alias("flat_rate"),
    )
    until = F.coalesce(F.lead("__t").over(Window.partitionBy(*keys).orderBy(chunk)), "ends")
    made = made.join(ends, keys).withColumn("__s", F.greatest(until - F.col("__t"), F.lit(1e-3)))
    made = made.withColumns({c: F.col(c) / F.col("__s") for c in ("keys_rate", "spike_rate", "flat_rate")}).drop("__t", "__s", "ends")
    whole = Window.partitionBy(*keys)
    n = F.count(F.lit(1)).over(whole)

    def rank(c: str):
        peers = F.count(F.lit(1)).over(Window.partitionBy(*keys, c))
        place = F.rank().over(whole.orderBy(c)) - 1 + (peers - 1) / 2
        return F.when(n > 1, place / (n - 1)).otherwise(0.5)

    made = made.withColumns({f"__{c}": rank(c) for c in TRIAGE_WEIGHTS})
    made = made.withColumn("score", sum((F.col(f"__{c}") * w for c, w in TRIAGE_WEIGHTS.items()), F.lit(0.0)))
    place = F.row_number().over(whole.orderBy(F.desc(F.round("score", 9)), chunk))
    return made.withColumn("hot", (n >= LEAST_CHUNKS) & (place <= F.greatest(F.lit(1), F.round(n * share)))).drop(*[f"__{c}" for c in TRIAGE_WEIGHTS])


def sync_before(wanted: DataFrame, syncs: DataFrame, keys: list[str]) -> DataFrame:
    """Append to wanted (t) the last sync time at or before it, or the first sync of all.

    An as-of join over the sorted union; no pairs of one key are made.
    """
    point = wanted.select(*keys, F.col("t").alias("__x"), F.lit(None).cast(syncs.schema["t"].dataType).alias("__s"), F.struct(*wanted.columns).alias("__p"))
    sync = syncs.select(*keys, F.col("t").alias("__x"), F.col("t").alias("__s"), F.lit(None).cast(point.schema["__p"].dataType).alias("__p"))
    up = Window.partitionBy(*keys).orderBy("__x", F.col("__p").isNotNull())
    rows = point.unionByName(sync).withColumn("__last", F.last("__s", ignorenulls=True).over(up)).withColumn("__first", F.min("__s").over(Window.partitionBy(*keys)))
    return rows.where("__p is not null").select("__p.*", F.coalesce("__last", "__first").alias("sync"))


def near_sync(wanted: DataFrame, syncs: DataFrame, keys: list[str], slack: float = 0.005) -> DataFrame:
    """Wanted rows with a sync within ``slack``."""
    t = F.col("t")
    return touching(wanted, t, t, syncs, t - slack, t + slack, keys).where("touches").drop("touches")


def run_up(starts: DataFrame, frames: DataFrame, keys: list[str], seconds: float) -> DataFrame:
    """For each start (tc): the first frame within ``seconds`` before it on the clock; starts without one are left out.

    A range window over the sorted union of both; no pairs of one key are made.
    """
    start = starts.select(*keys, F.col("tc").alias("__x"), F.lit(None).cast(frames.schema["n"].dataType).alias("__n"), F.struct(*starts.columns).alias("__p"))
    frame = frames.select(*keys, F.col("tc").alias("__x"), F.col("n").alias("__n"), F.lit(None).cast(start.schema["__p"].dataType).alias("__p"))
    span = f"min(__n) OVER (PARTITION BY {', '.join(keys)} ORDER BY __x RANGE BETWEEN {float(seconds)}D PRECEDING AND CURRENT ROW)"
    rows = start.unionByName(frame).withColumn("from_n", F.expr(span))
    return rows.where("__p is not null and from_n is not null").select("__p.*", "from_n")


def decode_times(packets: DataFrame, keys: list[str]) -> DataFrame:
    """Decode times for packets in decode order (order, pts): sorted presentation times, led by the largest delay."""
    by_time = Window.partitionBy(*keys).orderBy("pts", "order")
    by_order = Window.partitionBy(*keys).orderBy("order")
    ranked = packets.withColumn("__k", F.row_number().over(by_order))
    times = packets.select(*keys, F.col("pts").alias("__t"), F.row_number().over(by_time).alias("__k"))
    rows = ranked.join(times, [*keys, "__k"])
    lead = F.max(F.col("__t") - F.col("pts")).over(Window.partitionBy(*keys))
    return rows.withColumn("dts", F.col("__t") - F.greatest(F.lit(0), lead)).drop("__t", "__k")


def timing_sane(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Whether what was written lasts as expected: within a quarter second or 0.2 %, and with no new holes."""
    rows = expected.select(*keys, F.col("seconds").alias("want"), F.col("holes").alias("had")).join(found.select(*keys, "seconds", "holes"), keys)
    near = F.abs(F.col("seconds") - F.col("want")) <= F.greatest(F.lit(0.25), 0.002 * F.col("want"))
    return rows.select(*keys, (near & (F.col("holes") <= F.col("had"))).alias("sane"))


def discrete_quantile(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """The value at index min(n - 1, floor(q n)) of each key's sorted values."""
    by = Window.partitionBy(*keys)
    ranked = rows.withColumn("__k", F.row_number().over(by.orderBy(value)) - 1).withColumn("__n", F.count(F.lit(1)).over(by))
    return ranked.where(F.col("__k") == F.least(F.col("__n") - 1, F.floor(F.col("__n") * q))).select(*keys, F.col(value).alias("quantile"))
