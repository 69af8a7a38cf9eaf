"""Operator 12, target-distribution importance resampling over hashed n-grams.

Texts are taken in blocks of about ``BLOCK_BYTES``.  A block has a dictionary of its distinct words, as
integers; its n-grams are tuples of these ids, told apart by sorting integer codes.  The bytes of each distinct
tuple are put together and hashed once, and what the hash says (bucket, gain) is joined back to all
places of the tuple by its code.  A dictionary of a block instead of one of the corpus means that no token is ever
shuffled: what leaves a task is one count a bucket.  Blocks bound the memory of tasks, whatever the texts.

The two models (raw and target) are counts of ``buckets`` numbers each, so the log-ratio table that goes to the
tasks has a fixed size.  Drawing is by Gumbel scores made from the hash of the id, so that the draw is
without replacement and the same on every run.  Ranks come from counts of the whole-number scores: each
score's rows are ordered by id among themselves, behind the number of rows with higher ones.

Defined results: a null text has no words, weight 0, and can't be drawn; a null id hashes as empty text and stands behind
other ids of its score; rows with one id have equal scores, ordered by weight and text length; an empty target or
corpus counts 0 everywhere; columns named like the operator's own are replaced.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common as C

BLOCK_BYTES = 4 << 20
#: Bytes of words as they are, A-Z in lower case; all else is a blank.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Ratio:
    """Gain of every bucket: log of its share in the target over that in the raw corpus, as whole numbers."""

    gains: np.ndarray
    order: int


class Block:
    """The n-grams of some texts as integers.

    ``words`` counts the words of each text, ``first`` says where its words begin among all.
    """

    def __init__(self, texts: list[bytes]) -> None:
        data = np.frombuffer(b" ".join([b"", *texts, b""]).translate(WORD_BYTES), np.uint8)
        inside = data != 32
        edges = np.diff(inside.view(np.int8))
        starts, ends = np.flatnonzero(edges == 1) + 1, np.flatnonzero(edges == -1) + 1
        places = np.cumsum([1] + [len(t) + 1 for t in texts])
        self.first = np.searchsorted(starts, places)
        self.words = np.diff(self.first)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        spelled = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = spelled.dictionary_encode()
        self.ids = coded.indices.to_numpy().astype(np.int64)
        self.dictionary = coded.dictionary.to_pylist()
        self.left = np.repeat(self.first[1:], self.words) - np.arange(len(starts))  # words from a place to its text's end

    def tuples(self, order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes]]]:
        """For every length n up to ``order``: n, places where a tuple begins, the code of each, the bytes of each code."""
        code = self.ids
        for n in range(1, order + 1):
            at = np.flatnonzero(self.left >= n)
            if n == 1:
                firsts = np.empty(0, np.int64)
                spelled = self.dictionary
            else:
                wide = code[at] * len(self.dictionary) + self.ids[at + n - 1]
                _, firsts, short = np.unique(wide, return_index=True, return_inverse=True)
                code = np.zeros(len(self.ids), np.int64)
                code[at] = short
                spelled = [b" ".join([self.dictionary[self.ids[p + j]] for j in range(n)]) for p in at[firsts]]
            yield n, at, code[at], spelled


def blocks(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """Batches cut where their texts come to ``BLOCK_BYTES``, with what :class:`Block` makes of them."""
    for batch in batches:
        texts = C.as_bytes(batch.column(column))
        done = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BLOCK_BYTES or i == len(texts) - 1:
                yield batch.slice(done, i + 1 - done), Block(texts[done : i + 1])
                done, size = i + 1, 0
    pa.default_memory_pool().release_unused()


def hashed(spelled: list[bytes], buckets: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(x) % buckets for x in spelled), np.int64, len(spelled))


def bucket_counts(docs: DataFrame, order: int, buckets: int, text_col: str = "text") -> list[int]:
    """Features of all rows by bucket; tasks send one number a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, block in blocks(batches, text_col):
            for _, _, code, spelled in block.tuples(order):
                np.add.at(total, hashed(spelled, buckets), np.bincount(code, minlength=len(spelled)))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["bucket", "n"])

    found = docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * buckets
    for r in found.collect():  # at most ``buckets`` rows
        out[r.bucket] = r.n
    return out


def fit(docs: DataFrame, target: DataFrame, order: int = 1, buckets: int = 10_000, text_col: str = "text") -> Ratio:
    """Smoothed log-ratios of the target's bucket shares to those of all ``docs``, times 1000, floored."""
    raw, wanted = bucket_counts(docs, order, buckets, text_col), bucket_counts(target, order, buckets, text_col)
    s_all, t_all = float(sum(raw) + buckets), float(sum(wanted) + buckets)
    return Ratio(np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw, wanted, strict=True)], np.int64), order)


def weigh(docs: DataFrame, ratio: Ratio, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_words, n_features and weight, the floored mean gain of the text's features."""
    made = [T.StructField(name, T.LongType()) for name in ("n_words", "n_features", "weight")]
    keep = C.passing(docs, keep, [f.name for f in made])
    out = T.StructType([docs.schema[c] for c in keep] + made)
    gains, order = ratio.gains, ratio.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, block in blocks(batches, text_col):
            features, gained = np.zeros(len(block.words), np.int64), np.zeros(len(block.words), np.int64)
            for n, at, code, spelled in block.tuples(order):
                upto = np.concatenate([[0], np.cumsum(gains[hashed(spelled, len(gains))][code])])
                bounds = np.searchsorted(at, block.first)
                gained += np.diff(upto[bounds])
                features += np.maximum(block.words - n + 1, 0)
            weight = np.where(features > 0, gained // np.maximum(features, 1), 0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(x) for x in (block.words, features, weight)]], names=out.names)

    return docs.select(*keep, *([] if text_col in keep else [text_col])).mapInArrow(run, out)


def gumbel(id_col: str, seed: int) -> Column:
    """A Gumbel variate of the id, times 1000, floored: from the first 32 bits of a hash."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def draw(weighed: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id") -> DataFrame:
    """Append score and rank: the ``percent`` of the texts with enough words that score highest, from 1; others null.

    No task orders all rows: the scores are whole numbers, and Gumbel noise spreads them, so that one score
    holds less than a thousandth of ids.
    """
    rows, back = C.aside(weighed, ["score", "rank"])
    rows = C.stored(rows.withColumn("score", F.col("weight") + gumbel(id_col, seed)), "resample-scores")
    fit_in = F.col("n_words") >= least_words
    histogram = C.stored(rows.where(fit_in).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "resample-histogram")
    wanted = histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent // 100
    higher = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = histogram.select(F.col("score").alias("__score"), higher.alias("__higher")).where(F.col("__higher") < wanted)
    met = rows.join(offsets, fit_in & (F.col("score") == F.col("__score")), "left")
    among = Window.partitionBy("score").orderBy(F.asc_nulls_last(id_col), "weight", "n_words")
    place = F.col("__higher") + F.row_number().over(among)
    taken = met.where("__higher is not null").withColumn("rank", F.when(place <= wanted, place))
    rest = met.where("__higher is null").withColumn("rank", F.lit(None).cast("long"))
    # ``back`` names the columns that were passed in; the operator's own take the place of theirs
    kept = [c for c, name in zip(back, weighed.columns, strict=True) if name.lower() not in ("score", "rank")]
    return taken.unionByName(rest).select(*kept, "score", "rank")


ORACLE = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(lower_ascii, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii FROM documents)),
wanted AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
tokens AS (SELECT doc_id, unnest(words) AS word FROM docs),
seen AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (
  SELECT word, count(*) AS s, 0 AS t FROM tokens GROUP BY word
  UNION ALL SELECT word, 0, count(*) FROM (SELECT unnest(words) AS word FROM wanted) GROUP BY word) GROUP BY word),
entry(i, c, k) AS (
  SELECT i, i, 0 FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM entry WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS entries FROM entry WHERE k = 8),
spelled AS (SELECT word, s, t, hex(encode(word)) AS h FROM seen),
bucketed AS (
  SELECT word, s, t, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(h), 2),
           lambda p: CAST((instr('0123456789ABCDEF', substr(h, p, 1)) - 1) * 16 + instr('0123456789ABCDEF', substr(h, p + 1, 1)) - 1 AS BIGINT))),
           lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM spelled, crc),
totals AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM seen),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000)::DOUBLE / ((s + 1.0::DOUBLE) * (t_all + 10000)::DOUBLE))) AS gain
  FROM (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM bucketed GROUP BY bucket), totals),
weights AS (
  SELECT doc_id, sum(gain) AS gained FROM tokens JOIN bucketed USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT d.doc_id, len(words) AS n_features, CAST(floor(coalesce(gained, 0) / greatest(len(words), 1)) AS BIGINT) AS weight,
         CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) AS h
  FROM docs d LEFT JOIN weights USING (doc_id)),
final AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
                  count(*) OVER (PARTITION BY n_features >= 20) AS n FROM final)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score,
       CAST(CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS BIGINT) AS rank
FROM ranked
"""
