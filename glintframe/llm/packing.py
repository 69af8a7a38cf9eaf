"""Operator 7, best-fit packing: minimum bin slack.

Documents become token ids inside the tasks; longer ones are cut.  A full piece is a sequence of
its own.  The others are dealt by a hash into blocks of bounded size.  In a block, each sequence
is opened by the longest piece left; a bitset dynamic programme over the lengths still available
(bit k of an integer: some combination has length k) finds the fullest feasible combination for
the rest, which is taken out.  Sequences that a block leaves with slack are dissolved and packed
again together with those of the other blocks.

Defined results: a null or empty text is one piece with the end token only; repeated rows are
packed as often as they occur; an empty table gives no rows; null ids stay null; other columns aren't read.
"""

from __future__ import annotations

import functools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common as C

CAPACITY = 4096
BLOCK = 20_000  # pieces per block, about
TIGHT = 0.995  # a sequence filled less than this is packed again
ROUNDS = 2
CACHE = 250_000

#: Text in these characters is split into words here; any other text goes to the tokenizer whole.
CONTROL = re.compile("[\x00-\x08\x0e-\x1f\x7f]")
PLAIN = re.compile("[\t-\r -~\x85\xa0-\xffŒœ‐-‧‰-⁞€]*")


class Encoder:
    """Ids of texts under the word tokenizer, as packed 32-bit integers; what stands between blanks is looked up once."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # Fixed value: the vocabulary's own word pattern.
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        # What was looked up of late, and before: what isn't asked for again is forgotten.
        self.chunks: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _count(self, chunk: str) -> int:
        """Words of a chunk: letters only and letters with one sign behind them need no pattern."""
        if chunk.isalpha():
            return 1
        return 2 if chunk[:-1].isalpha() and not chunk[-1].isalnum() else len(self.words.findall(chunk))

    def _learn(self, chunks: list[str]) -> None:
        """Ids of new chunks: many go to the tokenizer as one text, and the tokens that end a word part the result."""
        rows = [" ".join(chunks[k : k + 1000]) for k in range(0, len(chunks), 1000)]
        ids = [i for e in self.tokenizer.encode_batch_fast(rows, add_special_tokens=False) for i in e.ids]
        packed = np.asarray(ids, "<u4")
        ends = np.concatenate(([0], 4 * (np.flatnonzero(self.ends_word[packed]) + 1)))
        words = np.fromiter(map(self._count, chunks), np.int64, len(chunks))
        assert words.sum() == len(ends) - 1
        raw = packed.tobytes()
        lo = 0
        for c, hi in zip(chunks, ends[np.cumsum(words)].tolist(), strict=True):
            self.chunks[c] = raw[lo:hi]
            lo = hi

    def encode(self, texts: list[str]) -> list[bytes]:
        chunks, old = self.chunks, self.old
        split = [t.lower().split() if t.isascii() and not CONTROL.search(t) or PLAIN.fullmatch(t) else None for t in texts]
        fresh = set().union(*(s for s in split if s)).difference(chunks)
        kept = fresh.intersection(old)
        chunks.update((c, old[c]) for c in kept)
        if new := list(fresh - kept):
            self._learn(new)
        known = chunks.__getitem__
        out = [self._whole(t) if s is None else b"".join(map(known, s)) for t, s in zip(texts, split, strict=True)]
        if len(chunks) > CACHE:
            self.chunks, self.old = {}, chunks
        return out


@functools.cache
def shared_encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, which keeps what it has looked up."""
    return Encoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, end_id: int = 1) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    end = np.asarray([end_id], "<u4").tobytes()
    out = T.StructType(
        [
            T.StructField("doc_id", docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in C.slices(batches, 500):
            encoder = encoder or shared_encoder(tokenizer_path)
            texts = C.as_texts(batch.column(1))
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(texts)):
                ids += end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo : lo + 4 * capacity]
                    row.append(i)
                    piece.append(k)
                    start.append(lo // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            arrays = [batch.column(0).take(pa.array(row, pa.int64()))]
            arrays += [pa.array(v, C.arrow_type(f.dataType)) for v, f in zip((piece, start, length, crc), out.fields[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def fullest(room: int, lengths: list[int], have: dict[int, int]) -> list[int]:
    """Lengths, with multiplicity, whose sum is the largest that fits: subset sums as a bitset.

    ``lengths`` are the distinct lengths available, longest first, and ``have`` how many there are.
    """
    within = (1 << (room + 1)) - 1
    goal = 1 << room
    reach = 1
    steps: list[tuple[int, int]] = []  # (length, what was reachable before it)
    for length in lengths:
        if length > room:
            continue
        for _ in range(min(have[length], room // length)):
            more = (reach | (reach << length)) & within
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
        if reach & goal:
            break
    left = reach.bit_length() - 1
    chosen = []
    for length, before in reversed(steps):
        if not (before >> left) & 1:
            chosen.append(length)
            left -= length
    return chosen


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, fill of the sequence) of each piece."""
    order = np.argsort(-lengths, kind="stable")
    stacks: dict[int, list[int]] = {}
    for i in order[::-1].tolist():
        stacks.setdefault(int(lengths[i]), []).append(i)
    have = {k: len(v) for k, v in stacks.items()}
    distinct = sorted(have, reverse=True)
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    fill = np.zeros(len(lengths), np.int64)
    n = 0
    while distinct:
        first = distinct[0]
        have[first] -= 1
        taken = [first, *fullest(capacity - first, distinct, have)]
        for length in taken[1:]:
            have[length] -= 1
        at, members = 0, []
        for length in taken:
            i = stacks[length].pop()
            sequence[i], offset[i] = n, at
            members.append(i)
            at += length
        fill[members] = at
        if any(not have[length] for length in taken):
            gone = {length for length in taken if not have[length]}
            distinct = [x for x in distinct if x not in gone]
        n += 1
    return sequence, offset, fill


def pack(rows: DataFrame, capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Append sequence_id and offset to rows with a ``length`` of 1 to ``capacity``."""
    columns = C.passing(rows, None, ["sequence_id", "offset"])
    rows = C.stored(rows.select(*columns, F.monotonically_increasing_id().alias("__row")), "pack-pieces")
    full = F.col("length") >= capacity
    placed = rows.where(full).select("__row", (F.col("__row") + F.lit(1 << 60)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = rows.where(~full).select("__row", "length")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "__row"], ascending=[False, True])
        sequence, offset, fill = pack_lengths(group["length"].to_numpy(), capacity)
        base = (int(group["__round"].iloc[0]) << 54) + (int(group["__block"].iloc[0]) << 24)
        return pd.DataFrame({"__row": group["__row"].to_numpy(), "length": group["length"].to_numpy(), "sequence_id": base + sequence, "offset": offset, "fill": fill})

    for k in range(ROUNDS):
        n = left.count()
        blocks = max(1, math.ceil(n / block))
        dealt = left.withColumn("__block", F.pmod(F.xxhash64("__row", F.lit(k)), F.lit(blocks))).withColumn("__round", F.lit(k))
        dealt = dealt.repartition(blocks, "__block")  # else small blocks are joined in few tasks
        made = C.stored(dealt.groupBy("__block").applyInPandas(run, "__row long, length long, sequence_id long, offset long, fill long"), f"pack-round{k}")
        last = k == ROUNDS - 1 or blocks == 1
        done = made if last else made.where(F.col("fill") >= TIGHT * capacity)
        placed = placed.unionByName(done.select("__row", "sequence_id", "offset"))
        if last:
            break
        left = made.where(F.col("fill") < TIGHT * capacity).select("__row", "length")
    return rows.join(placed, "__row").select(*columns, "sequence_id", "offset")
