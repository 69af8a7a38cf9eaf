"""Operator 13, mixing sources to target weights, in DataFrame functions only.

Each source's documents, in the order of a hash, are one stream of words, cut into blocks of ``BLOCK`` words (the last may be
shorter).  The mix is a sequence of slots, dealt to output shards of ``SHARD`` slots; every slot draws its source with the
target probabilities, so a shard's counts are multinomial.  A source has a quota, its target in
blocks; slots drawn beyond it are drawn anew, without replacement, among what other sources still lack, so the whole mix meets
the targets to a block and no block is taken more than ``epochs`` times.  The n-th slot of a source takes, in epoch
n div blocks, the block at place n mod blocks of a pseudorandom permutation of that epoch; slots and blocks
are joined by block index, a key that is taken ``epochs`` times at most.

The permutation is swap-or-not: ``ROUNDS`` times an index changes places with its mirror image about a
keyed point or not, by a hash of the larger of both.  It needs no table, no sort and no bound on the number of blocks.

Nothing is ordered in one task but tables of one row a source (a list of weights; their number is the only thing that
must stay small) and one row a shard of a source.  Offsets within a source are counted in ``2**BUCKET_BITS`` ranges of
the hash.  Tables of sources are joined without a hint: Spark broadcasts them if their stored size allows it.

Defined results: a null text has size 0; a null source is a source of its own, last in order; documents of size 0
take nothing; a null id is like any other id; rows alike in id and text are different documents; an
empty table gives no rows; columns named like the operator's own are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.llm import common as C

BLOCK = 64
SHARD = 16_384
TASK = 50_000  # slots a task works out
EPOCHS = 3
WEIGHTS = 3
BUCKET_BITS = 12
CELLS = 4_096
ROUNDS = 24
SEED = 13
SEPARATORS = r"[\x20\x09-\x0D]+"
MADE = ["size", "source_size", "target", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SEPARATORS), "")), F.lit(0)).cast("long")


def targets(totals: DataFrame, percent: int = 100, epochs: int = EPOCHS, block: int = BLOCK) -> DataFrame:
    """From (source, source_size), one row a source: sid, target, blocks and quota (in blocks) besides.

    Weights 1, 2, 3 repeat over sources in the order of code points.  A target that the cap lowers leaves its rest to the others by
    weight until none is above: targets are min(cap, weight * level), and the level is that of the first
    source, in order of cap / weight, which its share of what the earlier ones leave doesn't fill.
    """
    by_name = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    rows = totals.withColumn("sid", by_name).withColumn("weight", F.col("sid") % WEIGHTS + 1).withColumn("cap", F.col("source_size") * epochs)
    rows = rows.withColumn("filled_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("filled_at", "sid")
    earlier = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    wanted = F.sum("source_size").over(Window.partitionBy()) * F.lit(percent / 100)
    rows = rows.withColumn("level", (wanted - earlier) / left)
    first_open = F.min(F.when(F.col("filled_at") >= F.col("level"), F.struct("filled_at", "sid", "level"))).over(Window.partitionBy())
    open_level = first_open["level"]
    target = F.least(F.col("cap").cast("double"), F.coalesce(open_level * F.col("weight"), F.col("cap").cast("double")))
    rows = rows.withColumn("target", target).withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)))
    quota = F.least(F.col("blocks") * epochs, F.round(F.col("target") * F.col("blocks") / F.nullif(F.col("source_size"), F.lit(0))).cast("long"))
    return rows.select("sid", "source", "source_size", "target", "blocks", F.coalesce(quota, F.lit(0)).alias("quota"))


def offsets(rows: DataFrame, bits: int = BUCKET_BITS) -> DataFrame:
    """Append ``offset``, the words before a row in its source's stream (rows: sid, place, size; in order of place)."""
    rows = rows.withColumn("__bucket", F.shiftright("place", 64 - bits))
    sums = rows.groupBy("sid", "__bucket").agg(F.sum("size").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("sid").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("sid", "__bucket", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.sum("size").over(Window.partitionBy("sid", "__bucket").orderBy("place", "size").rowsBetween(Window.unboundedPreceding, -1))
    counted = rows.withColumn("__within", F.coalesce(within, F.lit(0))).join(sums, ["sid", "__bucket"])
    return counted.withColumn("offset", F.col("__before") + F.col("__within")).drop("__bucket", "__before", "__within")


def pieces(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """sid, block, offset (of the document), length: what each block holds of each document."""
    first, last = F.floor(F.col("offset") / block), F.floor((F.col("offset") + F.col("size") - 1) / block)
    cut = rows.where("size > 0").select("sid", "offset", "size", F.explode(F.sequence(first, last)).alias("block"))
    inside = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * block) - F.greatest("offset", F.col("block") * block)
    return cut.select("sid", "block", "offset", inside.alias("length"))


def permuted(index: Column, n: Column, keys: list[Column], rounds: int = ROUNDS) -> Column:
    """A pseudorandom permutation of 0 to n - 1, chosen by ``keys``: swap-or-not."""

    def swap(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(*keys, r), n) - x, n)
        return F.when(F.xxhash64(*keys, r, F.greatest(x, mirror)).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), swap)


def draws(sources: DataFrame, slots: int, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """shard, sid, drawn: multinomial counts of the sources in each output shard.

    A slot's number in [0, slots) falls into the range of one source; ranges are found by their cells, a
    table of at most CELLS rows and one a source.
    """
    width = slots // CELLS + 1
    upto = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranges = sources.withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("quota")).where("quota > 0")
    cells = ranges.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("cell"))
    number = F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), "id"), F.lit(slots))
    drawn = sources.sparkSession.range(slots).select(F.floor(F.col("id") / shard).alias("shard"), number.alias("u")).withColumn("cell", F.floor(F.col("u") / width))
    met = drawn.join(cells, "cell").where("lo <= u and u < hi")
    return met.groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("drawn"))


def mixed_slots(sources: DataFrame, slots: int, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix: shard, sid, nth (slot of the source), epoch and block, one row a slot."""
    counts = C.stored(draws(sources, slots, shard, seed), "mix-draws")
    before = F.sum("drawn").over(Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    nth = F.explode(F.sequence("from", F.col("from") + F.col("drawn") - 1)).alias("nth")
    # few small rows become many: as many tasks as the slots ask for, not as the rows do
    begun = counts.withColumn("from", F.coalesce(before, F.lit(0))).repartition(slots // TASK + 1, "shard", "sid")
    dealt = begun.select("shard", "sid", nth)
    # what sources have too much (over) and too little (under), each as ranges of one numbering
    over, under = F.greatest(F.col("drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("drawn"), F.lit(0))
    settled = sources.join(counts.groupBy("sid").agg(F.sum("drawn").alias("drawn")), "sid", "left").fillna(0, ["drawn"])
    settled = settled.withColumn("over", over).withColumn("under", under)
    prior = Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)
    settled = settled.withColumn("over_from", F.coalesce(F.sum("over").over(prior), F.lit(0))).withColumn("under_from", F.coalesce(F.sum("under").over(prior), F.lit(0)))
    settled = C.stored(settled.select("sid", "blocks", "quota", "drawn", "under", "over_from", "under_from"), "mix-settled")
    met = dealt.join(settled.select("sid", "blocks", "quota", "over_from"), "sid")
    kept = met.where("nth < quota").select("shard", "sid", "nth", "blocks")
    turned_back = met.where("nth >= quota").select("shard", (F.col("over_from") + F.col("nth") - F.col("quota")).alias("g"))
    lacking = settled.where("under > 0").select("sid", "blocks", "drawn", "under_from", F.explode(F.sequence("under_from", F.col("under_from") + F.col("under") - 1)).alias("g"))
    redrawn = lacking.select("sid", "blocks", (F.col("drawn") + F.col("g") - F.col("under_from")).alias("nth"), permuted(F.col("g"), F.sum(F.lit(1)).over(Window.partitionBy()), [F.lit(seed), F.lit("redraw")]).alias("g"))
    rows = kept.unionByName(turned_back.join(redrawn, "g").select("shard", "sid", "nth", "blocks"))
    epoch = F.floor(F.col("nth") / F.col("blocks"))
    place = permuted(F.pmod("nth", "blocks"), F.col("blocks"), [F.lit(seed), F.col("sid"), F.col("epoch")])
    return rows.withColumn("epoch", epoch).select("shard", "sid", "nth", "epoch", place.alias("block"))


def mix(docs: DataFrame, percent: int = 100, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Append size, source_size, target and taken (the words that the mix takes, repeats counted) to ``keep``."""
    keep = C.passing(docs, keep, MADE)
    names = [f"__keep{i}" for i in range(len(keep))]
    place = F.xxhash64(F.lit(SEED), F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names, strict=True)], F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), place.alias("place"))
    rows = C.stored(rows, "mix-rows")
    sources = C.stored(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), percent), "mix-sources")
    known = sources.select("sid", F.col("source").alias("__source"), "source_size", "target")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("source", "__source")
    rows = C.stored(offsets(rows), "mix-offsets")
    slots = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    times = mixed_slots(sources, slots).groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces(rows).join(times, ["sid", "block"]).groupBy("sid", "offset").agg(F.sum(F.col("length") * F.col("times")).alias("taken"))
    own = F.when(F.col("size") > 0, F.col("offset"))  # rows of size 0 share their offset with the next one
    made = rows.withColumn("__at", own).alias("r").join(taken.alias("t"), (F.col("r.sid") == F.col("t.sid")) & (F.col("__at") == F.col("t.offset")), "left")
    return made.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
