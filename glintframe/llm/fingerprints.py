"""Operator 5, document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash; in every window of ``WINDOW`` consecutive hashes
the smallest is chosen, the rightmost on ties; chosen hashes are kept with their positions.  Two
texts that share ``WINDOW + GRAM - 1`` code points in a row share a chosen hash.

Defined results: a null or empty text has the empty fingerprint; a text shorter than ``GRAM`` has
one hash, of all of it at position 0; two empty fingerprints are alike (1.0); repeated rows are rows of
their own; null ids come after all others; columns named like the operator's own are replaced.
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

GRAM = 16
WINDOW = 16
RANGE_CHARS = 32_000_000  # code points in a range of ids, about
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
PLACE_BITS = 28  # of a position; a text has fewer code points than 2**28


class Winnower:
    def __init__(self, gram: int = GRAM, window: int = WINDOW):
        self.gram, self.window = gram, window
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            size = max(n, 2 * len(self.powers), 4096)
            for name, base in (("powers", BASE), ("inverses", INVERSE)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def hashes(self, text: str) -> np.ndarray:
        """A mixed rolling hash for every k-gram."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        n, k = len(points), min(self.gram, len(text))
        self._grow(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(points * self.powers[:n], out=sums[1:])
        h = (sums[k:] - sums[: n - k + 1]) * self.inverses[: n - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h

    def choose(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(32-bit hashes, positions) chosen, by position."""
        if not text:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        h = self.hashes(text)
        last = np.uint64((1 << PLACE_BITS) - 1)
        # The low bits grow smaller to the right, so the smallest value is the rightmost of equal hashes.
        value = (h & ~last) | (last - np.arange(len(h), dtype=np.uint64))
        w = self.window
        if len(value) <= w:
            least = value.min(keepdims=True)
        else:
            blocks = -(-len(value) // w)
            padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
            padded[: len(value)] = value
            rows = padded.reshape(blocks, w)
            ahead = np.minimum.accumulate(rows, axis=1).ravel()
            behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
            n = len(value) - w + 1
            least = np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])
            least = least[np.concatenate(([True], least[1:] != least[:-1]))]
        return (least >> np.uint64(32)).astype(np.uint32), (last - (least & last)).astype(np.int64)


def as_string(hashes: np.ndarray) -> str:
    """Eight hexadecimal digits for each hash, by position."""
    return hashes.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over all distinct hashes; a and b are sorted and distinct."""
    if not len(a) and not len(b):
        return 1.0
    both = np.concatenate((a, b))
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def fingerprint(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``hashes`` and ``positions`` (arrays of long) to ``keep``."""

    def open_task():
        winnower = Winnower()

        def work(column: pa.Array) -> list:
            rows = [winnower.choose(t) for t in C.as_texts(column)]
            return [[r[0].astype(np.int64) for r in rows], [r[1] for r in rows]]

        return work

    longs = T.ArrayType(T.LongType())
    return C.map_texts(docs, open_task, [T.StructField("hashes", longs), T.StructField("positions", longs)], text_col, keep)


FIELDS = [
    T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()),
    T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()),
    T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())),  # of the fingerprint's hashes
]


def beside_next(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Rows in ranges of the id, each range sorted downwards and followed by a copy of the next range's first row.

    Columns: range, copied, doc_id, text.  After the last row comes the first.  Equal ids are
    ordered by their text; null ids come last.  Ranges hold about equally much text and are a partition each.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), key.alias("key"))
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / RANGE_CHARS))
    fine = 4 * ranges
    steps = rows.stat.approxQuantile("key", [i / fine for i in range(1, fine)], 0.2 / fine) if ranges > 1 else []
    steps = np.unique(np.array([int(c) for c in steps], np.int64))

    def place_among(cuts: np.ndarray):
        @F.pandas_udf("long")
        def place(ids):
            import pandas as pd

            return pd.Series(np.searchsorted(cuts, ids.to_numpy(np.int64), side="right"))

        return place("key")

    # Neighbouring steps of the ids are joined until a range has its share of the text.
    held = np.zeros(len(steps) + 1, np.int64)
    for step, chars in rows.groupBy(place_among(steps).alias("step")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0)) + 64)).collect():
        held[step] = chars
    share = np.cumsum(held)[:-1] * ranges // max(1, int(held.sum()))
    cuts = steps[np.flatnonzero(np.diff(np.concatenate(([0], share))))] if len(steps) else steps

    tops = sorted(tuple(r) for r in rows.select("key", place_among(cuts).alias("range")).groupBy("range").agg(F.max("key")).collect())
    # The first row of each range also follows the range above; the very first follows the lowest.
    goes_to = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    heads = F.broadcast(spark.createDataFrame(goes_to, "key long, also long"))  # one row for each range
    placed = rows.withColumn("range", place_among(cuts)).join(heads, "key", "left")
    placed = placed.select("key", "doc_id", "text", F.posexplode(F.array_compact(F.array("range", "also"))).alias("copied", "range"))
    return placed.repartitionById(len(cuts) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "copied", F.desc("key"), "text").select("range", "copied", "doc_id", "text")


def compare_edited(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    sorted_rows = beside_next(docs, text_col, id_col)
    out = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        winnower = Winnower()
        before = None  # (range, id, text, hashes, positions, distinct hashes)

        for batch in C.slices(batches, 500):
            made: list[tuple] = []
            columns = [batch.column(i).to_pylist() for i in range(4)]
            for part, copied, doc_id, text in zip(*columns, strict=True):
                text = text or ""
                if copied and (before is None or before[0] != part):
                    continue  # a further copy of tied first rows
                chosen, places = winnower.choose(text)
                distinct = np.unique(chosen)
                if before is not None:
                    _, old_id, old, old_chosen, old_places, old_distinct = before
                    third = len(old) // 3
                    edited = old[: len(old) - third] + text[:third]
                    other = winnower.choose(edited)[0]
                    made.append(
                        (
                            old_id,
                            len(old),
                            hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            as_string(old_chosen),
                            as_string(other),
                            likeness(old_distinct, np.unique(other)),
                            likeness(old_distinct, distinct),
                            old_places,
                        )
                    )
                before = None if copied else (part, doc_id, text, chosen, places, distinct)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(v, C.arrow_type(f.dataType)) for v, f in zip(zip(*made, strict=True), out.fields, strict=True)], names=out.names)

    return sorted_rows.mapInArrow(run, out)
