"""Operator 8, toxicity: Levenshtein automata over a lexicon trie, with context-window scores.

1. A lexicon is learned from a bounded sample of labelled rows (``MAX_LABELLED``): all words, and
   stems that open many words, which occur in toxic documents, in enough different contexts, far
   more often than in others.  How often is enough follows from the number of terms that were counted.
2. The lexicon is a trie.  A Levenshtein automaton of one edit is intersected with it; the
   product is a deterministic automaton whose states are made when first reached.  It accepts a
   term, a word that starts with a stem, and (for long terms) a word one edit away.
3. Each hit is weighed by the words around it: quotation marks or a reporting verb near the hit
   lower its weight.  A logistic curve, fitted on the same sample, turns the weighed hits of a
   document into a score.

Defined results: null or empty text, no letters, or no labelled row at all give a score of 0
up to the intercept of the curve; repeated rows get equal scores; ids may be null; columns named like
the operator's own are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common as C

MAX_LABELLED = 20_000  # labelled rows that are learned from
BY_CHANCE = 0.01  # terms of the lexicon that chance alone would put there
STEM_LENGTHS = range(3, 11)
FUZZY_LENGTH = 5  # shortest term for which one edit is forgiven
CONTEXT = 6  # words on either side
QUOTED_WEIGHT = 0.35
CLEAN_PER_NEIGHBOUR = 2_000  # clean documents per one that may hold a word an edit away from a term

WORD = re.compile(r"[^\W_]+(?:[@$!*]+[^\W_]+)*")  # signs between letters may stand for a letter
SIGN = re.compile(r"[@$!*]+")
# Words that report speech, in the four languages of the samples.
REPORTING = frozenset("said says say quote quoted quotes quoting called wrote reported term word slur sagte sagt zitat zitiert nannte wort dit disait cite citation mot dijo dice cita palabra".split())
QUOTES = frozenset("\"'“”„«»‘’`")


@dataclass
class Lexicon:
    """terms: term -> (is_stem, forgives_one_edit)."""

    terms: dict[str, tuple[bool, bool]] = field(default_factory=dict)
    weights: list[float] = field(default_factory=lambda: [0.0, 0.0, -6.0])


class Matcher:
    """Product of the trie and the one-edit automaton, determinised as it is walked.

    A state is a set of (trie node, edits so far); EXACT, NEAR and 0 are the answers for a word.
    """

    EXACT, NEAR = 2, 1

    def __init__(self, terms: dict[str, tuple[bool, bool]]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[bool, bool] | None] = [None]
        self.fuzzy_below: list[bool] = [False]
        for term, (stem, fuzzy) in terms.items():
            node = 0
            path = [0]
            for ch in term:
                nxt = self.children[node].get(ch)
                if nxt is None:
                    nxt = len(self.children)
                    self.children[node][ch] = nxt
                    self.children.append({})
                    self.ends.append(None)
                    self.fuzzy_below.append(False)
                node = nxt
                path.append(node)
            self.ends[node] = (stem, fuzzy)
            if fuzzy:
                for p in path:
                    self.fuzzy_below[p] = True
        self.states: dict[frozenset, int] = {}
        self.members: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.final: list[int] = []
        self.stop: list[int] = []
        self.start = self._state(self._closure({(0, 0)}))
        self.seen: dict[str, int] = {}

    def _closure(self, items: set) -> frozenset:
        """With deletions: a letter of the term that the word lacks."""
        out = set(items)
        for node, edits in items:
            if edits == 0:
                out.update((child, 1) for child in self.children[node].values() if self.fuzzy_below[child])
        return frozenset(out)

    def _state(self, items: frozenset) -> int:
        got = self.states.get(items)
        if got is None:
            got = self.states[items] = len(self.members)
            self.members.append(items)
            self.moves.append({})
            final = stop = 0
            for node, edits in items:
                end = self.ends[node]
                if end is None or (edits and not end[1]):
                    continue
                answer = self.NEAR if edits else self.EXACT
                final = max(final, answer)
                if end[0]:
                    stop = max(stop, answer)
            self.final.append(final)
            self.stop.append(stop)
        return got

    def _move(self, state: int, ch: str) -> int:
        """The next state, or -1 if nothing can match any more."""
        items = set()
        for node, edits in self.members[state]:
            child = self.children[node].get(ch)
            if child is not None and (edits == 0 or self.fuzzy_below[child]):
                items.add((child, edits))
            if edits == 0:
                if self.fuzzy_below[node]:
                    items.add((node, 1))  # an extra letter in the word
                items.update((c, 1) for c in self.children[node].values() if self.fuzzy_below[c])  # another letter
        nxt = self._state(self._closure(items)) if items else -1
        self.moves[state][ch] = nxt
        return nxt

    def match(self, word: str) -> int:
        got = self.seen.get(word)
        if got is None:
            got = self._walk(word)
            if got < self.EXACT and SIGN.search(word):  # or the signs part words
                got = max(got, *map(self._walk, SIGN.split(word)))
            if len(self.seen) > 150_000:
                self.seen.clear()
            self.seen[word] = got
        return got

    def _walk(self, word: str) -> int:
        state, best = self.start, 0
        for ch in word:
            nxt = self.moves[state].get(ch)
            state = self._move(state, ch) if nxt is None else nxt
            if state < 0:
                return best
            # a stem is complete: the rest of the word is free
            if self.stop[state] > best:
                best = self.stop[state]
                if best == self.EXACT:
                    return best
        return max(best, self.final[state])


def document_features(text: str, matcher: Matcher) -> tuple[float, float]:
    """(weighed hits, weighed hits per 100 words)."""
    low = text.lower()
    words = WORD.findall(low)
    match = matcher.match
    hits = {w: m for w in set(words) if (m := match(w))}
    if not hits:
        return 0.0, 0.0
    total = 0.0
    spans = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
    for i, (w, a, b) in enumerate(spans):
        kind = hits.get(w)
        if not kind:
            continue
        weight = 1.0 if kind == Matcher.EXACT else 0.7
        lo, hi = max(0, i - CONTEXT), min(len(spans) - 1, i + CONTEXT)
        before, after = low[spans[lo][1] : a], low[b : spans[hi][2]]
        quoted = any(q in before for q in QUOTES) and any(q in after for q in QUOTES)
        if quoted or any(x[0] in REPORTING for x in spans[lo : hi + 1]):
            weight *= QUOTED_WEIGHT
        total += weight
    return total, 100.0 * total / len(words)


def _feature_matrix(rows: list[tuple[float, float]]) -> np.ndarray:
    x = np.asarray(rows, dtype=float).reshape(-1, 2)
    return np.column_stack([np.minimum(np.log1p(3 * x[:, 0]), 3.0), np.minimum(x[:, 1], 5.0) / 5.0])


def _term_counts(sample: DataFrame) -> DataFrame:
    """Documents, and toxic documents, that hold each word and each stem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        toxic: Counter = Counter()

        def flush():
            keys = list(seen)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k[0] for k in keys], pa.string()),
                    pa.array([k[1] for k in keys], pa.bool_()),
                    pa.array([seen[k] for k in keys], pa.int64()),
                    pa.array([toxic[k] for k in keys], pa.int64()),
                ],
                names=["term", "stem", "docs", "toxic"],
            )

        for batch in C.slices(batches):
            for text, label in zip(C.as_texts(batch.column("text")), batch.column("label").to_pylist(), strict=True):
                words = set(WORD.findall(text.lower()))
                keys = {(w, False) for w in words}
                keys.update((w[:n], True) for w in words for n in STEM_LENGTHS if len(w) >= n)
                seen.update(keys)
                if label:
                    toxic.update(keys)
                if len(seen) > 300_000:
                    yield flush()
                    seen.clear()
                    toxic.clear()
        if seen:
            yield flush()

    made = sample.select("text", "label").mapInArrow(run, "term string, stem boolean, docs long, toxic long")
    return made.groupBy("term", "stem").agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))


def choose_terms(counts: list) -> list[tuple[str, bool]]:
    """(term, is_stem) from (term, stem, docs, toxic) rows: the shortest stems that say all a longer one says, and words."""
    words = {t: d for t, s, d, _ in counts if not s}
    stems = {t: d for t, s, d, _ in counts if s}
    longer: dict[str, int] = {}
    for s, d in stems.items():
        longer[s[:-1]] = max(longer.get(s[:-1], 0), d)
    chosen: dict[str, bool] = {}

    def covered(term: str) -> bool:
        return any(chosen.get(term[:n]) for n in range(1, len(term) + 1))

    for stem in sorted(stems, key=lambda t: (len(t), t)):
        docs = stems[stem]
        if len(stem) >= 4 and not covered(stem) and words.get(stem, 0) < 0.7 * docs and longer.get(stem, 0) < 0.9 * docs:
            chosen[stem] = True  # neither a whole word nor only the start of one longer stem
    for word in words:
        if len(word) >= 3 and not covered(word):
            chosen.setdefault(word, False)
    return sorted(chosen.items())


def _contexts(toxic: DataFrame, candidates: list[tuple[str, bool]]) -> dict[tuple[str, bool], int]:
    """In how many different contexts (the word before and the word after) each candidate stands in the toxic documents.

    Copies of one text are one context, so words that merely come along in copies don't count as often seen.
    """
    index = toxic.sparkSession.sparkContext.broadcast({c: i for i, c in enumerate(candidates)})

    def open_task():
        words = {t: i for (t, stem), i in index.value.items() if not stem}
        stems = {t: i for (t, stem), i in index.value.items() if stem}

        def work(column: pa.Array) -> list:
            out = []
            for text in C.as_texts(column):
                found = set()
                spans = ["", *WORD.findall(text.lower()), ""]
                for k, w in enumerate(spans[1:-1], 1):
                    here = [words[w]] if w in words else []
                    here += [stems[w[:n]] for n in STEM_LENGTHS if len(w) >= n and w[:n] in stems]
                    found.update((i, f"{spans[k - 1]} {spans[k + 1]}") for i in here)
                out.append([{"term": i, "context": c} for i, c in sorted(found)])
            return [out]

        return work

    pair = T.StructType([T.StructField("term", T.IntegerType()), T.StructField("context", T.StringType())])
    made = C.map_texts(toxic, open_task, [T.StructField("held", T.ArrayType(pair))], keep=[])
    rows = made.select(F.explode("held").alias("x")).select("x.term", "x.context").distinct().groupBy("term").count().collect()
    return {candidates[i]: n for i, n in rows}


def fit(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """Learn the lexicon and the curve from at most about MAX_LABELLED labelled rows."""
    chosen = C.labelled_rows(labels, "toxic", MAX_LABELLED)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null")
    sample = C.stored(sample.groupBy(F.md5(F.col("text")).alias("digest")).agg(F.min("text").alias("text"), F.max("label").alias("label")), "toxic-sample")
    n_docs, n_toxic = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n_toxic or n_docs == n_toxic:
        return Lexicon()
    # A term must be in so many toxic documents, in as many contexts, that chance alone would hardly put one of all
    # counted terms there; and, smoothed, nearly nowhere else.
    base = n_toxic / n_docs
    counts = C.stored(_term_counts(sample), "toxic-terms")
    least = max(3, math.ceil(math.log(BY_CHANCE / max(1, counts.count())) / math.log(base)))
    precise = (F.col("toxic") + base) / (F.col("docs") + 1) >= 0.6 + 0.4 * base
    found = [tuple(r) for r in counts.where((F.col("toxic") >= min(least, n_toxic)) & precise).collect()]
    toxic = sample.where("label = 1")
    often = _contexts(toxic, sorted({(t, s) for t, s, _, _ in found})) if found else {}
    terms = choose_terms([r for r in found if often.get(r[:2], 0) >= min(least, n_toxic)])
    lexicon = Lexicon({t: (stem, len(t) >= FUZZY_LENGTH + stem) for t, stem in terms})
    # An edit is forgiven only where the clean part of the sample holds (next to) no such neighbour.
    misled = _clean_neighbours(sample.where("label = 0"), lexicon)
    for t, n in misled.items():
        if n * CLEAN_PER_NEIGHBOUR > n_docs - n_toxic:
            lexicon.terms[t] = (lexicon.terms[t][0], False)
    rows = hits(sample, lexicon, keep=["label"]).select("hits", "rate", "label").collect()
    lexicon.weights = C.logistic(_feature_matrix([(r[0], r[1]) for r in rows]), np.asarray([r[2] for r in rows], float), ridge=0.1).tolist()
    return lexicon


def _clean_neighbours(clean: DataFrame, lexicon: Lexicon) -> dict[str, int]:
    """Documents that hold a word one edit away from a term, by term."""
    model = clean.sparkSession.sparkContext.broadcast(lexicon.terms)

    def open_task():
        matcher = Matcher(model.value)
        alone = {t: Matcher({t: v}) for t, v in model.value.items() if v[1]}

        def work(column: pa.Array) -> list:
            out = []
            for text in C.as_texts(column):
                near = [w for w in set(WORD.findall(text.lower())) if matcher.match(w) == Matcher.NEAR]
                out.append(sorted({t for w in near for t, m in alone.items() if m.match(w)}))
            return [out]

        return work

    made = C.map_texts(clean, open_task, [T.StructField("near", T.ArrayType(T.StringType()))], keep=[])
    return {r[0]: r[1] for r in made.select(F.explode("near").alias("t")).groupBy("t").count().collect()}


def hits(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``hits`` (weighed) and ``rate`` (per 100 words) to ``keep``."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon.terms)

    def open_task():
        matcher = Matcher(model.value)

        def work(column: pa.Array) -> list:
            rows = [document_features(t, matcher) for t in C.as_texts(column)]
            return [[r[0] for r in rows], [r[1] for r in rows]]

        return work

    return C.map_texts(docs, open_task, [T.StructField("hits", T.DoubleType()), T.StructField("rate", T.DoubleType())], text_col, keep)


def score(docs: DataFrame, lexicon: Lexicon, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``toxicity`` (0 to 1) to ``keep``."""
    model = docs.sparkSession.sparkContext.broadcast(lexicon)

    def open_task():
        matcher = Matcher(model.value.terms)
        w = np.asarray(model.value.weights)

        def work(column: pa.Array) -> list:
            x = _feature_matrix([document_features(t, matcher) for t in C.as_texts(column)])
            return [1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))]

        return work

    return C.map_texts(docs, open_task, [T.StructField("toxicity", T.DoubleType())], text_col, keep)
