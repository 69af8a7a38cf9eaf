"""Operator 3, sharding: longest-processing-time scheduling of groups that must stay together.

Rows with equal text are one group; its size is the sum of its rows' sizes.  Groups go, largest
first, to the least loaded shard, through a heap.  Groups of one size are alike to the schedule,
so the driver runs it over the histogram of group sizes (one entry for each distinct size, whose
number is bounded by the sizes that texts can have) and places all groups of a size at once: the
outcome is that of placing them one by one.  Groups find their shard by their rank among those
of their size.  Ranks and slots are counted in salted buckets, so no task holds a whole size
class or shard, and the hottest groups (at most ``HOT`` can hold a ``HOT``-th of the rows) are
joined by broadcast.

Defined results: a null text is its own empty group together with empty texts; repeated rows
are rows of their own in the same group; an empty table gives no rows; ids aren't read; columns named like the
operator's own are replaced.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common as C

HOT = 2_000


def schedule(classes: list[tuple[int, int]], shards: int) -> dict[int, list[tuple[int, int]]]:
    """From (size, groups) pairs: size -> [(shard, rank below which it gets groups)], ranks from 0.

    Largest size first, each group to the least loaded shard (the lowest number on ties).
    """
    loads = [0] * shards
    out: dict[int, list[tuple[int, int]]] = {}
    for size, count in sorted(classes, reverse=True):
        given = [0] * shards
        left = count
        if size > 0 and count > 2 * shards:
            # every place that starts under the level is taken before any that starts at it
            load = np.array(loads, dtype=object)
            low, high = min(loads), max(loads) + size * (count // shards + 2)
            taken = lambda level: [max(0, -((int(x) - level) // size)) for x in load]
            while low < high:
                mid = (low + high + 1) // 2
                if sum(taken(mid)) <= count:
                    low = mid
                else:
                    high = mid - 1
            given = taken(low)
            left -= sum(given)
        heap = [(loads[s] + given[s] * size, s) for s in range(shards)]
        heapq.heapify(heap)
        for _ in range(left):
            load_s, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (load_s + size, s))
        runs, upto = [], 0
        for s in range(shards):
            if given[s]:
                upto += given[s]
                runs.append((s, upto))
                loads[s] += given[s] * size
        out[size] = runs
    return out


def assign(docs: DataFrame, shards: int, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append size, text_crc32, shard and slot to ``keep``; equal texts share a shard."""
    keep = C.passing(docs, keep, ["size", "text_crc32", "shard", "slot"])
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(*keep, (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("__group"))
    rows = C.stored(rows.withColumn("__row", F.monotonically_increasing_id()), "shard-rows")
    groups = rows.groupBy("__group").agg(F.sum("size").alias("__size"), F.count(F.lit(1)).alias("__rows"))
    groups = C.stored(groups, "shard-groups")
    classes = [(r[0], r[1]) for r in groups.groupBy("__size").count().collect()]
    plan = spark.createDataFrame(
        [(size, runs) for size, runs in schedule(classes, shards).items()],
        T.StructType([T.StructField("__size", T.LongType()), T.StructField("__runs", T.ArrayType(T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("upto", T.LongType())])))]),
    )
    ranked = C.salted_rank(groups, ["__size"], "__group", "__nth").join(plan, "__size")
    shard = F.filter("__runs", lambda r: r["upto"] > F.col("__nth"))[0]["shard"]
    placed = C.stored(ranked.select("__group", "__rows", shard.alias("shard")), "shard-placed")
    n_rows = placed.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    is_hot = F.col("__rows") * HOT >= n_rows
    hot = F.broadcast(placed.where(is_hot).select("__group", F.col("shard").alias("__hot")))
    marked = rows.join(hot, "__group", "left")
    made = marked.where("__hot is not null").withColumn("shard", F.col("__hot"))
    made = made.unionByName(marked.where("__hot is null").join(placed.where(~is_hot).select("__group", "shard"), "__group"))
    made = C.salted_rank(made.drop("__hot"), ["shard"], "__row", "slot", salt="__row")
    return made.select(*keep, "size", "text_crc32", "shard", "slot")
