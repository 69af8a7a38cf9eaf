"""Operator 1, LM scoring: prediction by partial matching over bytes.

Training counts every window of ``ORDER + 1`` bytes of every training text inside the tasks and
sums the counts in one shuffle; shorter contexts are marginals of these.  Every window and context
is kept, in one distributed table an order, so the model grows with the input.  A context holds how
often each symbol followed (method D escapes: half a count for each distinct symbol).  Coding a
symbol starts at the longest context in the tables; where the symbol wasn't seen there, it escapes
to the next shorter context, in which the symbols of the longer one are excluded.  The windows seen
most often, at most ``HOT_WINDOWS`` of them, are broadcast with their scores and looked up by numpy; all
others are joined on the window.  Windows that training didn't see take their escape chain by joins,
each distinct one once; no key of these joins has more than 256 rows on a side.

The base score is the unigram word model with add-one smoothing.  Counts of the most frequent tokens,
at most ``HOT`` of them, are broadcast; all others are joined on the token.

Defined results: null text is an empty text, of which only the end is coded; with no training
rows every symbol costs log10(255) and N and V are 0; repeated rows get equal scores; ids aren't read;
columns named like the operator's own are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common as C

ORDER = 5  # longest context, in bytes
HOT_WINDOWS = 1 << 21  # windows broadcast at most: those seen most often
DISCOUNT = 0.5  # of every symbol's count, for the escape
HOT = 50_000  # tokens broadcast at most: those seen most often
PAD, END = 0xFE, 0xFF  # never in UTF-8: before a text, and its last symbol
SYMBOLS = 255  # all bytes but PAD
CHUNK = 1_000_000  # bytes worked on at once


def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, lower-cased, with pads before and an end after each; and where each text's symbols start."""
    pad = bytes([PAD]) * ORDER
    end = bytes([END])
    joined = b"".join(x for t in texts for x in (pad, t.translate(C.ASCII_LOWER), end))
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.cumsum(sizes + ORDER) - sizes
    return np.frombuffer(joined, np.uint8), starts


def windows(symbols: np.ndarray) -> np.ndarray:
    """For each coded symbol (no pads), in order: the window of ORDER + 1 bytes that it ends, newest byte lowest."""
    key = symbols[ORDER:].astype(np.int64)
    for back in range(1, ORDER + 1):
        key |= symbols[ORDER - back : len(symbols) - back].astype(np.int64) << (8 * back)
    return key[symbols[ORDER:] != PAD]


def mask(n: int) -> int:
    return (1 << (8 * n)) - 1


class Index:
    """A numpy hash table from int64 keys to their positions."""

    MULT = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys) + len(keys) // 2).bit_length())
        self.shift = np.uint64(64 - bits)
        self.size = 1 << bits
        self.slots = np.full(self.size, -1, np.int64)
        self.where = np.full(self.size, -1, np.int32)
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(left):
            free = self.slots[at] == -1
            slot, first = np.unique(at[free], return_index=True)
            who = left[free][first]
            self.slots[slot] = keys[who]
            self.where[slot] = who
            placed = self.slots[at] == keys[left]
            left, at = left[~placed], (at[~placed] + 1) & (self.size - 1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MULT) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        at = self._home(keys)
        got = self.slots[at]
        out = np.where(got == keys, self.where[at], -1)
        left = np.flatnonzero((got != keys) & (got != -1))
        while len(left):
            at_left = (at[left] + 1) & (self.size - 1)
            at[left] = at_left
            got = self.slots[at_left]
            hit = got == keys[left]
            out[left[hit]] = self.where[at_left[hit]]
            left = left[~hit & (got != -1)]
        return out


@dataclass
class Level:
    """One order of the trie.  contexts / grams are sorted keys; the rest are log10 weights by position."""

    contexts: np.ndarray
    top_total: np.ndarray  # of the context when coding starts there
    top_escape: np.ndarray
    shorter_total: np.ndarray  # of the next shorter context, without this one's symbols
    shorter_escape: np.ndarray
    grams: np.ndarray
    count: np.ndarray


@dataclass
class Model:
    levels: list[Level]
    floor: float  # log10 probability of a symbol seen in no context


def build(counts: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] | list) -> Model:
    """The trie in memory, from (context keys, totals, gram keys, gram counts) of each order."""
    levels: list[Level] = []
    distinct0 = 0
    for order, (ctx, total, gram, count) in enumerate(counts):
        by = np.argsort(ctx)
        ctx, total = ctx[by], total[by].astype(float)
        by = np.argsort(gram)
        gram, count = gram[by], count[by] - DISCOUNT
        owner = np.searchsorted(ctx, gram >> 8)
        kept = np.bincount(owner, count, len(ctx))
        kinds = np.bincount(owner, minlength=len(ctx)).astype(float)
        escape = total - kept
        if order:
            below = levels[-1]
            suffix = np.searchsorted(below.contexts, ctx & mask(order - 1))
            same = below.raw_count[np.searchsorted(below.grams, gram & mask(order))]
            rest = below.raw_kept[suffix] - np.bincount(owner, same, len(ctx))
            new = below.raw_escape[suffix] - DISCOUNT * kinds
            whole = rest + new
            none = whole <= 1e-9
            shorter_total = np.where(none, 0.0, np.log10(np.where(none, 1, whole)))
            shorter_escape = np.where(none | (new <= 1e-9), 0.0, np.log10(np.where(new <= 1e-9, 1, new))) - shorter_total
        else:
            distinct0 = len(gram)
            shorter_total = shorter_escape = np.zeros(len(ctx))
        level = Level(ctx, np.log10(total), np.log10(escape) - np.log10(total), shorter_total, shorter_escape, gram, np.log10(count))
        level.raw_count, level.raw_kept, level.raw_escape = count, kept, escape
        levels.append(level)
    for level in levels:
        del level.raw_count, level.raw_kept, level.raw_escape
    return Model(levels, -math.log10(max(1, SYMBOLS - distinct0)))


class Coder:
    """log10 probabilities of symbols, by the windows that they end."""

    def __init__(self, model: Model):
        self.model = model
        self.grams = [Index(x.grams) for x in model.levels]
        self.contexts = [Index(x.contexts) for x in model.levels]
        top = model.levels[-1] if model.levels else None
        if top is not None:  # of a symbol seen in its longest context
            self.seen = (top.count - top.top_total[np.searchsorted(top.contexts, top.grams >> 8)]).astype(np.float32)

    def code(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), self.model.floor)
        if not self.model.levels:
            return out
        at = self.grams[-1].find(keys)
        hit = at >= 0
        out[hit] = self.seen[at[hit]]
        rest = np.flatnonzero(~hit)
        if len(rest):
            # the same window again and again: each is worked out once
            again, back = np.unique(keys[rest], return_inverse=True)
            out[rest] = self._escaping(again)[back]
        return out

    def _escaping(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys))
        live = np.arange(len(keys))
        longer = np.full(len(keys), -1)  # the context one longer, from which coding came
        for order in range(len(self.model.levels) - 1, -1, -1):
            level = self.model.levels[order]
            key = keys[live]
            ctx = self.contexts[order].find((key >> 8) & mask(order))
            gram = self.grams[order].find(key & mask(order + 1))
            above = self.model.levels[order + 1] if order + 1 < len(self.model.levels) else level
            came = longer >= 0
            found = gram >= 0
            a = found & came
            out[live[a]] += level.count[gram[a]] - above.shorter_total[longer[a]]
            a = found & ~came
            out[live[a]] += level.count[gram[a]] - level.top_total[ctx[a]]
            a = ~found & came
            out[live[a]] += above.shorter_escape[longer[a]]
            a = ~found & ~came & (ctx >= 0)
            out[live[a]] += level.top_escape[ctx[a]]
            live, longer = live[~found], ctx[~found]
        out[live] += self.model.floor
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text with its end."""
        symbols, _ = stream(texts)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        return np.add.reduceat(self.code(windows(symbols)), np.cumsum(sizes) - sizes) if texts else np.zeros(0)


def chunks(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def corpus_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, gram, n): how often each word (the end: empty) and each window occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([g[0] for g in grams])
            n = np.concatenate([g[1] for g in grams])
            order = np.argsort(keys, kind="stable")
            keys, n = keys[order], n[order]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            return keys[first], np.add.reduceat(n, first)

        def rows(token: list, gram: np.ndarray | list, n: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(token, pa.binary()), pa.array(gram, pa.int64()), pa.array(n, pa.int64())], names=["token", "gram", "n"])

        for batch in batches:
            for part in chunks(C.as_bytes(batch.column(text_col))):
                for t in part:
                    tokens.update(t.translate(C.ASCII_LOWER).split())
                tokens[b""] += len(part)
                keys = np.sort(windows(stream(part)[0]))
                first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                grams.append((keys[first], np.diff(np.append(first, len(keys)))))
                held += len(first)
                if len(tokens) > 200_000:
                    yield rows(list(tokens), [None] * len(tokens), list(tokens.values()))
                    tokens.clear()
                if held > 1_500_000:
                    grams = [merged()]
                    held = len(grams[0][0])
                    if held > 750_000:
                        yield rows([None] * held, grams[0][0], grams[0][1])
                        grams, held = [], 0
        if tokens:
            yield rows(list(tokens), [None] * len(tokens), list(tokens.values()))
        if grams:
            keys, n = merged()
            yield rows([None] * len(keys), keys, n)

    made = docs.select(text_col).mapInArrow(run, "token binary, gram long, n long")
    return made.groupBy("token", "gram").agg(F.sum("n").alias("n"))


def levels(counts: DataFrame) -> list[DataFrame]:
    """Per order, all grams with their contexts: ctx, total and kinds (of the context), g, n."""
    of = counts.where("gram is not null").select(F.col("gram").alias("g"), "n")
    made: list[DataFrame] = []
    for order in range(ORDER, -1, -1):
        # A context has at most 255 symbols, so the list below is bounded.
        node = of.groupBy(F.shiftright("g", 8).alias("ctx")).agg(F.sum("n").alias("total"), F.collect_list(F.struct("g", "n")).alias("kept"))
        node = node.select("ctx", "total", F.size("kept").alias("kinds"), F.explode("kept").alias("x")).select("ctx", "total", "kinds", "x.g", "x.n")
        made.append(C.stored(node, "lm-level"))
        of = made[-1].groupBy(F.col("g").bitwiseAND(F.lit(mask(order))).alias("g")).agg(F.sum("n").alias("n"))
    return made[::-1]


def trie(of: list[DataFrame]) -> Model:
    """The whole model in memory, for small inputs; ``score`` doesn't gather it."""
    out = []
    for level in of:
        rows = level.toPandas()
        ctx = rows.drop_duplicates("ctx")
        out.append(tuple(x.to_numpy() for x in (ctx["ctx"], ctx["total"], rows["g"], rows["n"])))
    return build(out) if len(out[0][0]) else Model([], -math.log10(SYMBOLS))


def unseen(of: list[DataFrame], wanted: DataFrame) -> DataFrame:
    """(g, value): log10 probabilities of those windows ``wanted`` (distinct g) that training didn't see."""
    need = [wanted.join(of[ORDER].select("g"), "g", "left_anti")]
    need[0] = C.stored(need[0], "lm-need")
    for order in range(ORDER - 1, -1, -1):
        shorter = need[0].select(F.col("g").bitwiseAND(F.lit(mask(order + 1))).alias("g")).distinct()
        need.insert(0, C.stored(shorter.join(of[order].select("g"), "g", "left_anti"), "lm-need"))
    total, kinds = of[0].agg(F.max("total"), F.count(F.lit(1))).first()
    floor = -math.log10(max(1, SYMBOLS - kinds))
    start = floor + (math.log10(DISCOUNT * kinds) - math.log10(total) if total else 0.0)
    # came: after an escape from the context of g; begin: where coding begins at it, or at the longest that exists.
    value = need[0].select(F.col("g").alias("suffix"), F.lit(floor).alias("came"), F.lit(start).alias("begin"))
    for order in range(1, ORDER + 1):
        suffix = F.col("g").bitwiseAND(F.lit(mask(order))).alias("suffix")
        here = need[order].select("g", F.shiftright("g", 8).alias("ctx"), suffix)
        below = of[order - 1].select(F.col("g").alias("suffix"), F.col("n").alias("low_n"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds"))
        node = of[order].join(here.select("ctx").distinct(), "ctx", "left_semi").select("ctx", "total", "kinds", suffix).join(below, "suffix")
        node = node.groupBy("ctx", "total", "kinds", "low_total", "low_kinds").agg(F.sum(F.col("low_n") - DISCOUNT).alias("same"))
        new = (F.col("low_kinds") - F.col("kinds")) * DISCOUNT
        rest = F.col("low_total") - F.col("low_kinds") * DISCOUNT - F.col("same")
        # Without symbols that the longer context lacks, the shorter one is passed over.
        node = node.select("ctx", "total", "kinds", F.when(new > 0, F.log10(rest + new)).otherwise(0.0).alias("whole"), F.when(new > 0, F.log10(new) - F.log10(rest + new)).otherwise(0.0).alias("on"))
        rows = here.join(node, "ctx", "left").join(below.drop("low_kinds"), "suffix", "left").join(value, "suffix", "left")
        found = F.col("low_n").isNotNull()
        count = F.log10(F.col("low_n") - DISCOUNT)
        came = F.when(found, count - F.col("whole")).otherwise(F.col("on") + F.col("came"))
        escape = F.log10(F.col("kinds") * DISCOUNT) - F.log10("total")
        begin = F.when(F.col("total").isNotNull(), escape + came).when(found, count - F.log10("low_total")).otherwise(F.col("begin"))
        value = C.stored(rows.select(F.col("g").alias("suffix"), came.alias("came"), begin.alias("begin")), "lm-escapes")
    return value.select(F.col("suffix").alias("g"), F.col("begin").alias("value"))


@dataclass
class Trained:
    """What scoring needs: the tables of each order, and the token table with its sums."""

    levels: list[DataFrame]
    tokens: DataFrame
    n_tokens: int
    n_kinds: int

    @property
    def model(self) -> Model:
        return trie(self.levels)


def least_count(table: DataFrame, count: str, room: int) -> int:
    """The smallest count such that no more than ``room`` rows have it or more, up to steps of an eighth of a doubling.

    The histogram that the driver sees has at most 8 * 63 + 1 rows, however large the counts are.
    """
    step = F.floor(8 * F.log2(F.col(count).cast("double"))).cast("long")
    taken, least = 0, None
    for _, n, low in sorted(table.groupBy(step.alias("step")).agg(F.count(F.lit(1)), F.min(count)).collect(), reverse=True):
        taken += n
        if taken > room:
            break
        least = low
    return (1 << 62) if least is None else least


def fit(docs: DataFrame, training: Column, text_col: str = "text") -> Trained:
    counts = C.stored(corpus_counts(docs.where(training), text_col), "lm-counts")
    tokens = counts.where("token is not null").select("token", F.col("n").alias("c"))
    n, v = tokens.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    return Trained(levels(counts), tokens, n, v)


def score(docs: DataFrame, trained: Trained, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append n_tokens, n_known, base_score and score (log10) to ``keep``."""
    keep = C.passing(docs, keep, ["n_tokens", "n_known", "base_score", "score"])
    spark = docs.sparkSession
    is_hot = F.col("c") >= least_count(trained.tokens, "c", HOT)
    hot = {bytes(r[0]): r[1] for r in trained.tokens.where(is_hot).collect()}
    is_hot_window = F.col("n") >= least_count(trained.levels[ORDER], "n", HOT_WINDOWS)
    windows_seen = trained.levels[ORDER].select("g", "n", (F.log10(F.col("n") - DISCOUNT) - F.log10("total")).alias("value"))
    top = windows_seen.where(is_hot_window).select("g", "value").toArrow()
    top = tuple(top[c].to_numpy() for c in ("g", "value"))
    sent = spark.sparkContext.broadcast((top, {t: (c, math.log10(c + 1)) for t, c in hot.items()}))

    def open_task():
        (keys, values), hot_tokens = sent.value
        index = Index(keys)
        values = np.append(values, 0.0)  # of position -1

        def work(column: pa.Array) -> list:
            n_tokens, known, base, total = [], [], [], []
            sizes, cold, cold_n = [0], [], []
            grams, gram_n, gram_sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
            for part in chunks(C.as_bytes(column)):
                here = windows(stream(part)[0])
                lengths = np.fromiter((len(t) + 1 for t in part), np.int64, len(part))
                at = index.find(here)
                total.append(np.add.reduceat(values[at], np.cumsum(lengths) - lengths))
                owner = np.repeat(np.arange(len(part)), lengths)[at < 0]
                here = here[at < 0]
                order = np.lexsort((here, owner))
                owner, here = owner[order], here[order]
                first = np.flatnonzero(np.concatenate(([True], (here[1:] != here[:-1]) | (owner[1:] != owner[:-1]))) if len(here) else np.zeros(0, bool))
                grams.append(here[first])
                gram_n.append(np.diff(np.append(first, len(here))))
                gram_sizes.append(np.bincount(owner[first], minlength=len(part)))
                for t in part:
                    words = t.translate(C.ASCII_LOWER).split()
                    words.append(b"")
                    s, k = 0.0, 0
                    for w, n in Counter(words).items():
                        got = hot_tokens.get(w)
                        if got is None:
                            cold.append(w)
                            cold_n.append(n)
                        else:
                            k += n
                            s += n * got[1]
                    n_tokens.append(len(words))
                    known.append(k)
                    base.append(s)
                    sizes.append(len(cold))
            pairs = pa.StructArray.from_arrays([pa.array(cold, pa.binary()), pa.array(cold_n, pa.int64())], names=["token", "n"])
            lists = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pairs)
            pairs = pa.StructArray.from_arrays([pa.array(np.concatenate(grams)), pa.array(np.concatenate(gram_n))], names=["g", "n"])
            gram_lists = pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(gram_sizes)), pa.int32()), pairs)
            return [n_tokens, known, base, np.concatenate(total) if total else [], lists, gram_lists]

        return work

    pair = T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())])
    window = T.StructType([T.StructField("g", T.LongType()), T.StructField("n", T.LongType())])
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("__known", T.LongType()),
        T.StructField("__base", T.DoubleType()),
        T.StructField("__score", T.DoubleType()),
        T.StructField("__cold", T.ArrayType(pair)),
        T.StructField("__windows", T.ArrayType(window)),
    ]
    made = C.stored(C.map_texts(docs, open_task, fields, text_col, keep).withColumn("__row", F.monotonically_increasing_id()), "lm-scored")
    cold = made.select("__row", F.explode("__cold").alias("x")).select("__row", "x.token", "x.n")
    cold = cold.join(trained.tokens.where(~is_hot), "token").groupBy("__row")
    cold = cold.agg(F.sum("n").alias("__more"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("__more_base"))
    rare = made.select("__row", F.explode("__windows").alias("x")).select("__row", "x.g", F.col("x.n").alias("times"))
    values = windows_seen.where(~is_hot_window).select("g", "value").unionByName(unseen(trained.levels, rare.select("g").distinct()))
    rare = rare.join(values, "g").groupBy("__row").agg(F.sum(F.col("times") * F.col("value")).alias("__rest"))
    per_token = math.log10(trained.n_tokens + trained.n_kinds + 1)
    return made.drop("__cold", "__windows").join(cold, "__row", "left").join(rare, "__row", "left").select(
        *keep,
        "n_tokens",
        (F.col("__known") + F.coalesce("__more", F.lit(0))).alias("n_known"),
        (F.col("__base") + F.coalesce("__more_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(per_token)).alias("base_score"),
        (F.col("__score") + F.coalesce("__rest", F.lit(0.0))).alias("score"),
    )
