"""Operator 6, quality: histogram gradient-boosted trees over document statistics.

Statistics are taken of every whole text inside the tasks.  Trees are grown on the driver from
the statistics of a bounded sample of labelled rows (``MAX_LABELLED``), on quantile bins, with
a logistic loss; they are complete binary trees laid out in flat arrays, which numpy walks level
by level for a whole batch at once.

Defined results: null text is an empty text and is scored by its (all zero) statistics; without
labelled rows, or with one class only, every score is the share of label 1 (0.5 if unknown);
repeated rows get equal scores; rows and labels with a null id aren't learned from; columns named like
the operator's own are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common as C

MAX_LABELLED = 20_000  # labelled rows that are learned from
BINS = 64
TREES = 60
DEPTH = 4
RATE = 0.15
LEAST_CHILD = 8.0  # documents in a leaf
RIDGE = 1.0

STATISTICS = [
    "chars", "words", "lines", "word_length", "upper", "digits", "blanks", "marks", "ascii_marks", "non_ascii",
    "distinct_words", "top_word", "top_pair", "repeated_lines", "capital_words", "all_capital_words",
    "marked_words", "lone_marks", "sentence_ends", "longest_word", "same_neighbour", "line_length",
]
SYMBOL_END = re.compile(r"[^\w\s.,;:'\"!?)\]-]$|!!$")


def statistics(text: str) -> tuple[float, ...]:
    """The numbers of ``STATISTICS`` for one text; all are finite, and 0 for an empty text."""
    n = len(text)
    words = text.split()
    k = len(words)
    if not k:
        return (float(n),) + (0.0,) * (len(STATISTICS) - 1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.bincount(raw, minlength=256)
    m = len(raw)
    upper = counts[65:91].sum()
    lower = counts[97:123].sum()
    digits = counts[48:58].sum()
    blanks = counts[32] + counts[9:14].sum()
    high = counts[128:].sum()
    marks = m - upper - lower - digits - blanks - high
    plain = counts[[33, 34, 39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    seen = Counter(words)
    pairs = Counter(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x.strip()]
    kinds = list(seen.items())
    return (
        float(n),
        float(k),
        float(len(lines)),
        (n - blanks) / k,
        upper / m,
        digits / m,
        blanks / m,
        marks / m,
        (marks - plain) / m,
        high / m,
        len(seen) / k,
        max(seen.values()) / k,
        max(pairs.values(), default=0) / k,
        1 - len(set(lines)) / len(lines),
        sum(c for w, c in kinds if w[:1].isupper()) / k,
        sum(c for w, c in kinds if len(w) > 1 and w.isupper()) / k,
        sum(c for w, c in kinds if len(w) > 1 and SYMBOL_END.search(w)) / k,
        sum(c for w, c in kinds if len(w) == 1 and not w.isalnum()) / k,
        (counts[46] + counts[33] + counts[63]) / k,
        float(max(map(len, seen))),
        sum(1 for a, b in zip(words, words[1:], strict=False) if a == b) / k,
        n / len(lines),
    )


@dataclass
class Forest:
    """Complete trees: node i has children 2i+1 and 2i+2; leaves carry values.

    features, cuts: (tree, inner node); values: (tree, leaf).
    """

    start: float
    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        for f, c, v in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += v[node - len(f)]
        return total

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    """Fit the forest.  Each split is the best over all statistics and bins by the second-order gain."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    empty = Forest(0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if not len(y):
        return empty
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    start = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        empty.start = start
        return empty
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    n_features = x.shape[1]
    wide = binned + np.arange(n_features) * BINS
    score = np.full(len(y), start)
    forest = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        feature, cut, bins = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS, np.int64)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            slot = ((node - first)[:, None] * (n_features * BINS) + wide).ravel()
            size = width * n_features * BINS
            shape = (width, n_features, BINS)
            sums = [np.bincount(slot, np.repeat(w, n_features), size).reshape(shape).cumsum(axis=2) for w in (g, h, np.ones(len(y)))]
            gl, hl, nl = sums
            gt, ht, nt = (s[:, :, -1:] for s in sums)
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain = np.where((nl >= LEAST_CHILD) & (nt - nl >= LEAST_CHILD), gain, -1.0)
            flat = gain.reshape(width, -1)
            best = flat.argmax(axis=1)
            for w in range(width):
                if flat[w, best[w]] > 1e-9:
                    f, b = divmod(int(best[w]), BINS)
                    feature[first + w], bins[first + w], cut[first + w] = f, b, edges[f][b] if b < len(edges[f]) else np.inf
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > bins[node])
        leaf = node - inner
        values = RATE * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        score += values[leaf]
        forest.append((feature, cut, values))
    return Forest(start, *(np.array(z) for z in zip(*forest, strict=True)))


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append the array column ``stats``."""

    def open_task():
        def work(column: pa.Array) -> list:
            return [[list(statistics(t)) for t in C.as_texts(column)]]

        return work

    return C.map_texts(docs, open_task, [T.StructField("stats", T.ArrayType(T.DoubleType()))], text_col, keep)


def fit(docs: DataFrame, labels: DataFrame) -> Forest:
    """Grow the forest from at most about MAX_LABELLED labelled rows."""
    chosen = C.labelled_rows(labels, "quality", MAX_LABELLED)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    rows = with_statistics(sample, keep=["label", "doc_id"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["stats"]))
    x = np.array([r["stats"] for r in rows], float).reshape(-1, len(STATISTICS))
    return grow(x, np.array([r["label"] for r in rows], float))


def score(docs: DataFrame, forest: Forest, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``quality`` (0 to 1: how likely label 1 is)."""
    model = docs.sparkSession.sparkContext.broadcast(forest)

    def open_task():
        def work(column: pa.Array) -> list:
            x = np.array([statistics(t) for t in C.as_texts(column)], float).reshape(-1, len(STATISTICS))
            return [model.value.predict(x)]

        return work

    return C.map_texts(docs, open_task, [T.StructField("quality", T.DoubleType())], text_col, keep)
