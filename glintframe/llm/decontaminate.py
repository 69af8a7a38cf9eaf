"""Operator 10, benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names and units turn into typed placeholders (a run of capitals within a
sentence is one name), other words into their lower-case form.  A word that opens a sentence with a capital is a name too:
protagonists stand there most of all.  Where it is a common word, its value stays what it was, which is consistent;
such values don't count among the item's.  Windows of ``WINDOW`` template tokens are hashed
and joined with those of the benchmark.  A Bloom filter of the benchmark's windows, of fixed size, is
sent to the tasks so that next to no other windows are shuffled; the join decides.  Windows of one
document and item at one alignment, or at alignments that differ by ``SLACK`` tokens step by step (words
put in or left out), form a chain.  A chain counts if it holds ``LEAST_SHARE`` of the item's windows or
covers ``LEAST_COVER`` of its tokens.

The values in a chain's placeholders must match consistently: one value of the item always stands for
the same value of the document, and two values that both changed don't become one; less than
``BROKEN`` of the item's values may break this.  So a question with other numbers and names is caught,
and a chance likeness of templates is not.  Windows with fewer than ``LEAST_WORDS`` words say little
alone: a chain of these needs two.  Windows of placeholders only say nothing and are left out.

Beside the template windows there are literal ones: lower-case tokens without placeholders, with no
minimum of words and no demand on values, so that copies are found whatever they consist of.

Defined results: null and empty texts and items match nothing; an item shorter than a window is
one window of its own length; equal items are reported each; repeated rows are reported each; null
ids are reported as such; extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from glintframe.llm import common as C

WINDOW = 5  # template tokens
LEAST_SHARE = 0.5  # of an item's template windows, in one chain
LEAST_COVER = 0.7  # or of its tokens
LITERAL_SHARE, LITERAL_COVER = 0.6, 0.8  # the same of literal windows, whose values needn't be consistent
LEAST_WORDS = 3  # words that aren't placeholders, in a window that counts alone
SLACK = 3  # tokens put in or left out at one place
BROKEN = 0.25  # of an item's values, from which a chain is inconsistent
FILTER_BITS = 26  # the filter has 2**26 bits (8 MB), whatever the benchmark's size
SALTS = 16
CACHE = 150_000
GROUP = 1_000_000  # characters worked on at once

NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:%|st|nd|rd|th)?", re.I)
# Numbers in words.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve hundred thousand million".split())
TRIM = re.compile(r"^[^\w$€£+-]+|[^\w%]+$")
SENTENCE_END = re.compile(r"[.!?:][\"'”’)\]]*$")
# Units that may follow a number.
UNITS = frozenset("mm cm m km in inch inches ft feet yd yards mile miles mi g kg mg lb lbs pound pounds oz ounce ounces l ml litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur hz khz mhz ghz w kw v a".split())

WORD, NUM, NAME, UNIT = range(4)
_MULT = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1 for k in range(WINDOW)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Templates(dict):
    """Template tokens of texts.  What a chunk of text between blanks says of itself is looked up once, by its number."""

    def __init__(self):
        super().__init__()
        self.values: list[str] = []
        self.hash = np.zeros(4096, np.uint64)
        self.flags = np.zeros(4096, np.uint8)  # 1 number, 2 unit word, 4 capital, 8 ends a sentence, 16 no token

    def __missing__(self, chunk: str) -> int:
        if chunk.isalpha():
            core, low, flags = chunk, chunk.lower(), 0
            number = low in NUMBER_WORDS
        else:
            core = TRIM.sub("", chunk)
            low = core.lower()
            flags = 8 * bool(SENTENCE_END.search(chunk)) + 16 * (not core)
            number = low in NUMBER_WORDS or NUMBER.fullmatch(core) is not None
        if number:
            flags |= 1
        else:
            flags |= 2 * (low in UNITS) + 4 * core[:1].isupper()
        i = self[chunk] = len(self.values)
        self.values.append(low)
        if i == len(self.hash):
            self.hash = np.concatenate([self.hash, np.zeros_like(self.hash)])
            self.flags = np.concatenate([self.flags, np.zeros_like(self.flags)])
        self.hash[i] = xxh3_64_intdigest(low.encode("utf-8", "surrogatepass"))
        self.flags[i] = flags
        return i

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text number, token hash, kind, chunk number, whether it opens a sentence) of each template token of the texts, one after another."""
        if len(self) > CACHE:
            self.clear()
            self.values.clear()
        chunks = [text.split() for text in texts]
        sizes = [len(c) for c in chunks]
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(chunks)), np.int64, sum(sizes))
        owner = np.repeat(np.arange(len(texts)), sizes)
        flags = self.flags[ids]
        if (flags >= 16).any():
            some = flags < 16
            ids, owner, flags = ids[some], owner[some], flags[some]
        kind = np.zeros(len(ids), np.uint8)
        starts = np.ones(len(ids), bool)
        if len(ids):
            same = owner[1:] == owner[:-1]
            number = (flags & 1) > 0
            starts[1:] = ~same | ((flags[:-1] & 8) > 0)
            kind[(flags & 4) > 0] = NAME
            kind[1:][((flags[1:] & 2) > 0) & same & number[:-1]] = UNIT
            kind[number] = NUM
        token = np.where(kind == WORD, self.hash[ids], kind.astype(np.uint64))
        return owner, token, kind, ids, starts


TEMPLATE, LITERAL = 1, 2
OPENS = "^"  # no value begins with it


def window_hashes(token: np.ndarray, width: int) -> np.ndarray:
    """A hash for every window of ``width`` tokens."""
    n = len(token) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.full(n, width, np.uint64)
    for k in range(width):
        h += token[k : k + n] * _MULT[k]
    return mix(h)


WINDOW_FIELDS = [
    T.StructField("n_windows", T.IntegerType()),  # of that mode and width in the text
    T.StructField("n_tokens", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("h", T.LongType()),
    T.StructField("pos", T.IntegerType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("strong", T.BooleanType()),  # holds enough words to count alone
    T.StructField("slots", T.ArrayType(T.StringType())),  # values of a template's placeholders, in order; OPENS before those that open a sentence
]


def text_windows(templates: Templates, texts: list[str], passes, widths) -> Iterator[tuple]:
    """(text number, n_windows, n_tokens, width, h, pos, mode, strong, slots) of each window that ``passes`` lets through.

    All texts are worked on at once, as one sequence of tokens; windows that reach from one into the next don't count.
    """
    owner, token, kind, ids, starts = templates.of(texts)
    marked = np.zeros(len(texts), bool)  # texts with placeholders: their literal windows are others
    marked[owner[kind != WORD]] = True
    # A run of names within a sentence is one name.
    first = np.flatnonzero(~((kind == NAME) & ~starts & np.concatenate(([False], kind[:-1] == NAME)))) if len(kind) else np.zeros(0, np.int64)
    literal = (LITERAL, owner, templates.hash[ids], None)
    for mode, of, tokens, kinds in ((TEMPLATE, owner[first], token[first], kind[first]), literal):
        lengths = np.bincount(of, minlength=len(texts))
        begins = np.cumsum(lengths) - lengths
        for width, has in widths(lengths):
            h = window_hashes(tokens, width)
            if not len(h):
                continue
            whole = (of[: len(h)] == of[width - 1 :]) & has[of[: len(h)]]
            if kinds is not None:
                counts = np.concatenate(([0], np.cumsum(kinds == WORD)))
                whole &= (counts[width:] > counts[: len(h)]) & marked[of[: len(h)]]  # the literal windows stand for texts without placeholders
            n = np.bincount(of[: len(h)][whole], minlength=len(texts))
            at = np.flatnonzero(whole)
            for p in at[passes(h[at])].tolist():
                text = int(of[p])
                slots = []
                if kinds is not None:
                    for q in range(p, p + width):
                        if kinds[q] != WORD:
                            lo, hi = int(first[q]), int(first[q + 1]) if q + 1 < len(first) else len(ids)
                            hi = min(hi, int(np.searchsorted(owner, text, "right")))
                            slots.append((OPENS if kinds[q] == NAME and starts[lo] else "") + " ".join(templates.values[c] for c in ids[lo:hi]))
                strong = kinds is None or counts[p + width] - counts[p] >= min(LEAST_WORDS, width)
                for m in (mode,) if marked[text] else (TEMPLATE, LITERAL):
                    yield text, int(n[text]), int(lengths[text]), width, int(h[p].view(np.int64)), p - int(begins[text]), m, bool(strong), slots


def groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(number of the first, texts) of about GROUP characters."""
    done = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP or i == len(texts) - 1:
            yield done, texts[done : i + 1]
            done, size = i + 1, 0


def _windows(df: DataFrame, id_col: str, text_col: str, open_task) -> DataFrame:
    """One row for each window that ``open_task()`` lets pass: id and WINDOW_FIELDS."""
    out = T.StructType([T.StructField("id", df.schema[id_col].dataType), *WINDOW_FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, passes, widths = None, None, None
        for batch in C.slices(batches):
            if templates is None:
                templates = Templates()
                passes, widths = open_task()
            for at, texts in groups(C.as_texts(batch.column(1))):
                made = list(text_windows(templates, texts, passes, widths))
                if made:
                    owner, *fields = zip(*made, strict=True)
                    ids = batch.column(0).take(pa.array([at + i for i in owner], pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids] + [pa.array(v, C.arrow_type(f.dataType)) for v, f in zip(fields, WINDOW_FIELDS, strict=True)], names=out.names)

    return df.select(id_col, text_col).mapInArrow(run, out)


def _filter_bits(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = np.uint64(FILTER_BITS)
    return (hashes >> (np.uint64(64) - size)).astype(np.int64), ((hashes << size) >> (np.uint64(64) - size)).astype(np.int64)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc row, item) pairs that match: id, item, windows matched, share of the item's windows, exact (all words, in one piece)."""
    spark = docs.sparkSession
    items = C.stored(_windows(benchmark, item_col, item_text, lambda: (lambda h: np.arange(len(h)), lambda n: [(w, np.minimum(n, WINDOW) == w) for w in range(1, WINDOW + 1)])), "benchmark-windows")
    in_use = [r[0] for r in items.select("width").distinct().collect()]  # WINDOW, and the lengths of shorter items
    # The two filter positions of each window, as set bits of 64-bit words: at most 2**20 words.
    top = F.shiftrightunsigned("h", 64 - FILTER_BITS)
    second = F.shiftrightunsigned(F.shiftleft("h", FILTER_BITS), 64 - FILTER_BITS)
    bits = items.select(F.explode(F.array(top, second)).alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask"))
    bitmap = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for word, mask in bits.collect():
        bitmap[word] = mask
    sent = spark.sparkContext.broadcast(bitmap)

    def open_task():
        words = sent.value.view(np.uint64)

        def passes(h: np.ndarray) -> np.ndarray:
            ok = np.arange(len(h))
            for k in range(2):  # few pass the first bit
                bit = _filter_bits(h[ok])[k]
                ok = ok[(words[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) > 0]
            return ok

        return passes, lambda n: [(w, n >= w) for w in in_use]

    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id")).alias("key"), F.col(text_col).alias("text"))
    found = _windows(rows, "key", "text", open_task)
    found = C.stored(found.select(F.col("id.row").alias("row"), F.col("id.id").alias("id"), "h", "mode", "pos", "slots"), "leaked-windows")
    salted = found.withColumn("salt", F.pmod(F.col("row"), F.lit(SALTS)).cast("int"))
    spread = items.select("id", "n_windows", "n_tokens", "width", "h", "mode", "pos", "strong", "slots").withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    spread = spread.select(F.col("id").alias("item"), "n_windows", "n_tokens", "width", "h", "mode", "salt", F.col("pos").alias("item_pos"), "strong", F.col("slots").alias("item_slots"))
    pairs = salted.join(spread, ["h", "mode", "salt"]).where(F.size("slots") == F.size("item_slots"))
    shift = (F.col("pos") - F.col("item_pos")).alias("shift")
    values = F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")).alias("values")
    lined = pairs.select("row", "id", "item", "n_windows", "n_tokens", "width", "mode", "item_pos", "strong", shift, values)
    # Bounded by the item's length: one alignment of one item.
    key = ["row", "id", "item", "mode", "n_windows", "n_tokens", "width"]
    aligned = lined.groupBy(*key, "shift").agg(F.collect_set("item_pos").alias("places"), F.max("strong").alias("strong"), F.array_distinct(F.flatten(F.collect_set("values"))).alias("values"))
    of_item = Window.partitionBy(*key).orderBy("shift")
    new = F.coalesce(F.col("shift") - F.lag("shift").over(of_item) > SLACK, F.lit(True)).cast("int")
    aligned = aligned.withColumn("new", new).withColumn("chain", F.sum("new").over(of_item))
    chains = aligned.groupBy(*key, "chain").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"), F.max("strong").alias("strong"), F.array_distinct(F.flatten(F.collect_list("values"))).alias("values"), F.count(F.lit(1)).alias("shifts")
    )
    matched = F.size("places")
    # Tokens of the item under some window: each place adds what the place before it leaves.
    covered = F.aggregate("places", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), lambda a, p: F.struct((p + F.col("width")).alias("end"), (a["n"] + p + F.col("width") - F.greatest(p, a["end"])).alias("n")))["n"]
    share = matched / F.col("n_windows")
    by_mode = lambda template, literal: F.when(F.col("mode") == TEMPLATE, template).otherwise(literal)
    enough = (share >= by_mode(LEAST_SHARE, LITERAL_SHARE)) | (covered >= by_mode(LEAST_COVER, LITERAL_COVER) * F.col("n_tokens"))
    bare = lambda v: F.struct(F.ltrim(v["item"], F.lit(OPENS)).alias("item"), F.ltrim(v["doc"], F.lit(OPENS)).alias("doc"))
    chains = chains.withColumn("marked", F.col("values")).withColumn("values", F.array_distinct(F.transform("values", bare)))
    changed = F.filter("values", lambda v: v["item"] != v["doc"])
    # Values that several others of the item became, unless one of them was kept.
    n_items = F.size(F.array_distinct(F.transform("values", lambda v: v["item"])))
    telling = F.filter("marked", lambda v: ~F.startswith(v["item"], F.lit(OPENS)) | (bare(v)["item"] != bare(v)["doc"]))
    n_telling = F.size(F.array_distinct(F.transform(telling, lambda v: bare(v)["item"])))
    merged = F.size(changed) - F.size(F.array_distinct(F.transform(changed, lambda v: v["doc"])))
    broken = F.size("values") - n_items + F.greatest(merged, F.lit(0))
    consistent = (F.col("mode") == LITERAL) | (broken == 0) | (broken < BROKEN * n_telling)
    sure = F.col("strong") | (matched > 1)
    exact = (F.col("mode") == LITERAL) & (matched == F.col("n_windows")) & (F.col("shifts") == 1)
    kept = chains.where(enough & consistent & sure).select("row", "id", "item", F.struct(exact.alias("exact"), matched.alias("matched"), share.alias("share")).alias("k"))
    best = kept.groupBy("row", "id", "item").agg(F.max("k").alias("b"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("b.matched").cast("long").alias("windows"), F.col("b.share").alias("share"), F.col("b.exact").alias("exact"))
