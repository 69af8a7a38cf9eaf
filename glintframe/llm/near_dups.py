"""Operator 4, near-duplicates: bottom-k sketches from one hash function.

1. Every text becomes its set of word shingles, hashed to 64 bits; the ``SKETCH`` smallest hashes
   are its sketch.  Texts with equal sets are one from here on.
2. The union's sketch bounds what two linked sets share: of the k smallest hashes of the union
   each lies in both sets with the probability of their similarity, so ``least_shared`` of them do but
   for a chance of about one in a million.  Hence two linked sets share one of the
   ``SKETCH - least_shared + 1`` rarest values of either sketch (rare: held by few sketches), and only
   these go into inverted lists.  Sets no larger than a sketch are held whole, where the exact
   prefix bound applies.  Values that many texts share are thus left out of most lists.
3. Lists with equal members are evaluated once.  A list is cut into blocks of bounded size.  In each
   pair of blocks the same estimate, of all pairs of sketches at once, keeps the sets that may be linked
   with some other; of these the intersections of full sets are counted as matrix products.  A
   spanning forest of the exact links is emitted: never all pairs, and no link between two parts is lost.
4. Connected components of the links by alternating large-star and small-star steps.

Defined results: null, empty or blank texts have an empty set and are linked with nothing; with
fewer words than a shingle the whole sequence is one shingle; rows with one id count as one
document: its texts are linked with each other, whatever they are (a text without words is not); a row with a null
id is linked with nothing and kept; ids are whole numbers; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common as C

WORDS = 5
SIMILAR = 85  # hundredths, where the caller names no other
SKETCH = 48
BLOCK_ROWS = 2_048
BLOCK_SHINGLES = 1_000_000
HOT = 2_000
FILTER_BITS = 26
CACHE = 150_000
COLUMNS = 2_048

_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(64)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of shingle hashes.  The hash of a word is looked up once."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def _learn(self, word: bytes) -> int:
        if len(self.known) > CACHE:
            self.known.clear()
        h = self.known[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return h

    def shingles(self, text: bytes) -> np.ndarray:
        """Sorted distinct hashes (int64)."""
        split = text.translate(C.ASCII_LOWER).split()
        if not split:
            return np.zeros(0, np.int64)
        get, learn = self.known.get, self._learn
        w = np.array([h if (h := get(x)) is not None else learn(x) for x in split], np.uint64)
        width = min(self.words, len(w))
        n = len(w) - width + 1
        h = np.full(n, width, np.uint64)
        for k in range(width):
            h += w[k : k + n] * _MULT[k]
        out = np.sort(mix(h).view(np.int64))
        return out[np.concatenate(([True], out[1:] != out[:-1]))]


def digest(values: np.ndarray) -> tuple[int, int]:
    """Two numbers that, with the size, stand for a whole set."""
    u = values.view(np.uint64)
    return int(u.sum(dtype=np.uint64).view(np.int64)) if len(u) else 0, int(np.bitwise_xor.reduce(mix(u ^ np.uint64(0x5BD1E995))).view(np.int64)) if len(u) else 0


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, d1, d2 (digest of the set) and sketch of every row."""

    def open_task():
        shingler = Shingler()

        def work(column: pa.Array) -> list:
            n, d1, d2, flat, sizes = [], [], [], [], [0]
            for t in C.as_bytes(column):
                s = shingler.shingles(t)
                a, b = digest(s)
                n.append(len(s))
                d1.append(a)
                d2.append(b)
                flat.append(s[:SKETCH])
                sizes.append(sizes[-1] + len(flat[-1]))
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int64)))
            return [n, d1, d2, lists]

        return work

    long = T.LongType()
    fields = [T.StructField("n_shingles", long), T.StructField("d1", long), T.StructField("d2", long), T.StructField("sketch", T.ArrayType(long))]
    return C.map_texts(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), open_task, fields, keep=["doc_id"])


def least_shared(similar: int) -> int:
    """Sketch values that two sets of that similarity share, but for a chance of about one in a million."""
    return int(SKETCH * similar / 100 - 5.5 * math.sqrt(SKETCH * similar * (100 - similar) / 10_000))


def inverted_lists(sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(v, key, n): the rarest sketch values of each set that any other sketch holds too, one list of each membership."""
    held = sets.select("key", "n_shingles", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    often = held.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = held.join(often, "v").groupBy("key", "n_shingles", "kept").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("values"))
    whole = F.col("n_shingles") * 100 <= F.lit(SKETCH * similar - 100)
    prefix = F.when(whole, F.floor(F.col("n_shingles") * (100 - similar) / 100) + 1).otherwise(F.lit(SKETCH - least_shared(similar) + 1))
    # Values that no other sketch holds are rarer than all in the list.
    room = F.greatest(F.lit(0), prefix - (F.col("kept") - F.size("values"))).cast("int")
    index = mine.select("key", F.col("n_shingles").alias("n"), F.explode(F.slice("values", F.lit(1), room)).alias("x")).select("x.v", "key", "n")
    index = C.stored(index, "near-index")
    code = F.xxhash64("key")
    lists = index.groupBy("v").agg(F.count(F.lit(1)).alias("g"), F.sum("n").alias("mass"), F.bit_xor(code).alias("x"), F.sum(F.shiftright(code, 24)).alias("s")).where("g > 1")
    once = lists.groupBy("g", "x", "s").agg(F.min(F.struct("v", "mass")).alias("l")).select("l.v", "l.mass", "g")
    blocks = F.greatest(F.ceil(F.col("mass") / BLOCK_SHINGLES), F.ceil(F.col("g") / BLOCK_ROWS)).cast("int")
    return index.join(once.select("v", blocks.alias("blocks")), "v")


def _candidate_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, rep, set) of the wanted (key, rep, d1, d2).  A filter of fixed size keeps other rows out of the shuffle."""
    at = F.shiftrightunsigned(F.xxhash64("rep"), 64 - FILTER_BITS)
    words = wanted.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("mask"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for word, mask in words.collect():
        bitmap[word] = mask
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    out = T.StructType([T.StructField("rep", T.LongType()), T.StructField("d1", T.LongType()), T.StructField("d2", T.LongType()), T.StructField("set", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        bits = sent.value.view(np.uint64)
        for batch in C.slices(batches):
            slot = batch.column("slot").to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1))
            if not len(hit):
                continue
            part = batch.take(pa.array(hit))
            sets = [shingler.shingles(t) for t in C.as_bytes(part.column("text"))]
            codes = [digest(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("rep"), pa.array([c[0] for c in codes], pa.int64()), pa.array([c[1] for c in codes], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                names=out.names,
            )

    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    made = rows.select("rep", "text", at.alias("slot")).mapInArrow(run, out)
    return made.join(wanted, ["rep", "d1", "d2"]).dropDuplicates(["key"]).select("key", "rep", "set")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share (a set with itself: how many it shares with any other)."""
    n = len(sets)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], code[shared]
    both = np.zeros((n, n), np.float32)
    if len(code):
        _, code = np.unique(code, return_inverse=True)
        order = np.argsort(code, kind="stable")
        owner, code = owner[order], code[order]
        for lo in range(0, int(code[-1]) + 1, COLUMNS):
            a, b = np.searchsorted(code, (lo, lo + COLUMNS))
            cells = np.zeros((n, COLUMNS), np.float32)
            cells[owner[a:b], code[a:b] - lo] = 1
            both += cells @ cells.T
    return both


def may_be_linked(sets: list[np.ndarray], sizes: np.ndarray, side: np.ndarray, same: bool, similar: int) -> np.ndarray:
    """Indices of sets that the union-sketch estimate leaves a partner.

    Two linked sets share ``least_shared`` of their union's sketch, hence of their own sketches, but for a
    chance of about one in a million; sets no larger than a sketch are compared exactly.
    """
    both = shared_counts([s[:SKETCH] for s in sets])
    exact = np.ceil(similar * (sizes[:, None] + sizes) / (100 + similar))
    ok = (both >= np.minimum(exact, least_shared(similar))) & (100 * np.minimum(sizes[:, None], sizes) >= similar * np.maximum(sizes[:, None], sizes))
    ok &= ~np.eye(len(sets), dtype=bool) if same else side[:, None] != side
    return np.flatnonzero(ok.any(axis=1))


def links_of(sets: list[np.ndarray], side: np.ndarray, same: bool, similar: int = SIMILAR) -> np.ndarray:
    """Pairs of indices that are linked and connect: a spanning forest.  Only pairs across sides unless ``same``."""
    sizes = np.array([len(s) for s in sets])
    likely = may_be_linked(sets, sizes, side, same, similar)
    if len(likely) < 2:
        return np.zeros((0, 2), np.int64)
    sizes, side = sizes[likely], side[likely]
    n = len(likely)
    both = shared_counts([sets[i] for i in likely])
    found = []
    left = np.ones(n, bool)

    def linked(i: int) -> np.ndarray:
        """Indices still left that i is linked with: 100 * both >= similar * (sizes - both)."""
        ok = left & ((100 + similar) * both[i].astype(np.int64) >= similar * (sizes[i] + sizes))
        return np.flatnonzero(ok if same else ok & (side != side[i]))

    for start in range(n):
        if not left[start]:
            continue
        left[start] = False
        todo = [start]
        while todo:
            new = linked(todo.pop())
            left[new] = False
            todo.extend(new.tolist())
            found.extend((start, x) for x in new.tolist())
    return likely[np.array(found, np.int64).reshape(-1, 2)]


def exact_links(lists: DataFrame, sets: DataFrame, similar: int = SIMILAR) -> DataFrame:
    """(a, b) links that connect what the lists hold, by the sets' smallest ids."""
    block = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    rows = lists.withColumn("block", block).join(sets, "key")
    # A block meets every block of its list, itself included: once for each pair.
    rows = rows.select("v", "key", "rep", "block", "set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("v", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "key", "rep", "set")
    rows = rows.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j", "key").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, sets_here, side = None, [], [], []

        def close() -> list[tuple[int, int]]:
            if len(reps) < 2:
                return []
            return [(reps[a], reps[b]) for a, b in links_of(sets_here, np.array(side), key[1] == key[2], similar).tolist()]

        def emit(pairs: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            made = []
            cols = [batch.column(c).to_pylist() for c in ("v", "i", "j", "block", "rep")]
            held = batch.column("set")
            flat = held.flatten().to_numpy(zero_copy_only=False)
            ends = held.offsets.to_numpy() - held.offsets[0].as_py()
            for r, (v, i, j, b, rep) in enumerate(zip(*cols, strict=True)):
                if (v, i, j) != key:
                    made += close()
                    key, reps, sets_here, side = (v, i, j), [], [], []
                reps.append(rep)
                side.append(b)
                sets_here.append(flat[ends[r] : ends[r + 1]])
            if made:
                yield emit(made)
        if made := close():
            yield emit(made)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable.  Alternates large-star and small-star until nothing changes."""
    edges = C.stored(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    code = F.xxhash64("u", "v")
    mark = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(code), F.sum(F.shiftright(code, 24))).first()
        if now == mark or not now[0]:
            break
        mark = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = C.stored(small.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct(), "star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def same_id_links(full: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) links between the sets of ids that have several, each to the one with the smallest id."""
    of_set = F.struct("n_shingles", "d1", "d2")
    several = full.groupBy("doc_id").agg(F.min(of_set).alias("lo"), F.max(of_set).alias("hi")).where("lo != hi").select("doc_id")
    mine = full.join(several, "doc_id").select("doc_id", "n_shingles", "d1", "d2").distinct().join(sets, ["n_shingles", "d1", "d2"]).select("doc_id", "rep")
    least = mine.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return mine.join(least, "doc_id").select(F.col("rep").alias("a"), "b")


def cluster(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similar: int = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    made = C.stored(sketches(docs, id_col, text_col), "near-sketches")
    rows = made.select(F.col("doc_id"), "n_shingles", "d1", "d2")
    full = made.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = full.groupBy("n_shingles", "d1", "d2").agg(F.min(F.col("doc_id").cast("long")).alias("rep"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("copies"))
    sets = C.stored(sets.withColumn("key", F.monotonically_increasing_id()), "near-sets")
    lists = C.stored(inverted_lists(sets, similar), "near-lists")
    wanted = sets.select("key", "rep", "d1", "d2").join(lists.select("key").distinct(), "key", "left_semi")
    links = exact_links(lists, _candidate_sets(docs, wanted, id_col, text_col), similar)
    found = components(links.unionByName(same_id_links(full, sets)))
    of_set = sets.join(found, sets.rep == found.node, "left").select("d1", "d2", "n_shingles", "copies", F.coalesce("component", "rep").alias("component_id"))
    of_set = C.stored(of_set, "near-components")
    n_rows = rows.count()
    is_hot = F.col("copies") * HOT >= n_rows  # no more than HOT sets can hold so many
    key = ["n_shingles", "d1", "d2"]
    hot = F.broadcast(of_set.where(is_hot).select(*key, F.col("component_id").alias("__hot")))
    marked = rows.join(hot, key, "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    is_marked = F.col("__hot").isNotNull() & ~alone
    done = marked.where(is_marked).withColumnRenamed("__hot", "component_id")
    single = marked.where(alone).select(*rows.columns, F.col("doc_id").cast("long").alias("component_id"))
    rest = marked.where(~is_marked & ~alone).drop("__hot").join(of_set.where(~is_hot).select(*key, "component_id"), key)
    names = ["doc_id", "n_shingles", "component_id"]
    out = done.select(*names).unionByName(single.select(*names)).unionByName(rest.select(*names))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
