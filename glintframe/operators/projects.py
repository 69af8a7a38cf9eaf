"""Stored projects: what belongs to which video, which is the latest, what to evict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.tables import stored as kept


#: Pairs of one frame count that a task compares.
PAIRS = 20_000_000


def same_video(stored: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs with an equal frame count and durations within a frame: an equi-join with a tolerance.

    The rows of a frame count are dealt to as many parts as its pairs ask for, ``PAIRS`` to each: all pairs are made, but a
    task's work doesn't grow with the tables.
    """
    sizes = stored.groupBy("frames").agg(F.count(F.lit(1)).alias("a")).join(found.groupBy("frames").agg(F.count(F.lit(1)).alias("b")), "frames")
    parts = kept(sizes.select(F.col("frames").alias("__f"), F.ceil(F.col("a") * F.col("b") / PAIRS).cast("long").alias("__parts")), "pair-parts")
    spark = stored.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts.agg(F.sum("__parts")).first()[0] or 1)
    own = stored.join(parts, F.col("frames") == F.col("__f")).withColumn("__part", F.pmod(F.xxhash64("id"), F.col("__parts")))
    other = found.select(F.col("id").alias("video_id"), F.col("frames").alias("__n"), F.col("seconds").alias("__s"))
    other = other.join(parts, F.col("__n") == F.col("__f")).select("video_id", "__n", "__s", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias("__p"))
    own, other = own.repartition(tasks, "frames", "__part"), other.repartition(tasks, "__n", "__p")
    near = F.abs(F.col("seconds") - F.col("__s")) <= F.col("seconds") / F.greatest(F.lit(1), F.col("frames"))
    made = own.join(other, (F.col("frames") == F.col("__n")) & (F.col("__part") == F.col("__p")) & near)
    return made.select(*stored.columns, "video_id")


def latest(projects: DataFrame, prefix: Column) -> DataFrame:
    """The project saved last of each key prefix."""
    return projects.groupBy(prefix.alias("prefix")).agg(F.max_by("key", F.struct("saved", "key")).alias("key"), F.max("saved").alias("saved"))


def evicted(entries: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Entries that go, the least recently used first, until what stays fits the budget."""
    newer = Window.partitionBy(*keys).orderBy(F.desc("used"), F.desc("id")).rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("kept_bytes", F.sum("bytes").over(newer)).where(F.col("kept_bytes") > budget)


def edits_from_json(projects: DataFrame, column: str) -> DataFrame:
    """Rows (section, ord, removed, extended, fill) of JSON maps keyed by frame number; what is of a wrong kind is dropped.

    A frame that is both removed and extended is removed.
    """
    schema = "map<string, struct<removed: boolean, extended: boolean, fill: string>>"
    rows = projects.select("section", F.explode(F.from_json(column, schema)).alias("k", "e")).withColumn("ord", F.col("k").try_cast("long"))
    removed = F.coalesce("e.removed", F.lit(False))
    extended = F.coalesce("e.extended", F.lit(False)) & ~removed
    made = rows.where("ord >= 0").select("section", "ord", removed.alias("removed"), extended.alias("extended"), F.when(F.col("e.fill") == "next", "next").otherwise("prev").alias("fill"))
    return made.where("removed OR extended")


def result_json(every: DataFrame, violations: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, result: one JSON document for each of ``every``: its verdict, and its violations in the order of ``fields``."""
    rows = violations.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("violations"))
    met = every.select(key).distinct().join(rows, key, "left")
    none = F.array().cast(rows.schema["violations"].dataType)
    document = F.struct(F.col(key).alias("video"), F.col("violations").isNull().alias("passed"), F.coalesce("violations", none).alias("violations"))
    return met.select(key, F.to_json(document).alias("result"))
