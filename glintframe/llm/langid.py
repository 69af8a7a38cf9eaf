"""Operator 2, language ID by cross-parsing entropy.

A suffix automaton is built over labelled texts of each language: a sample of pieces of ``PIECE`` code points, which most
texts don't fill, so that long texts are neither left out nor cut off.  ``SYMBOLS`` bounds the letters of all automata.  A
document is parsed, once per language, into the longest phrases that the language's automaton
accepts.  Phrases, times the logarithm of the automaton's text, per letter are the cross-parsing
entropy; the language with the smallest wins, so unequal samples don't decide.

Numpy walks many lanes of ``LANE`` symbols at once.  A lane is first parsed on its own.  Then each lane
goes on into the next one until a phrase begins where the next lane's own parse begins one: from there
on both are the same.  So phrases cross lanes and the parse is that of the whole text.

Defined results: null, empty or letterless text gives ``und`` with score 0; with no labelled
row every document is ``und``; ties go to the language first in the alphabet; repeated rows
get equal results; ids may be null.  The score is the second-best entropy over the sum of the best two.
Columns of the operator's names (``lang_pred``, ``lang_score``, ``phrase_length``) are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.llm import common as C
from glintframe.llm.lm import Index

SAMPLE_PIECES = 24  # per language, about
PIECE = 20_000  # code points; shorter texts are whole
SYMBOLS = 1_000_000  # code points learned from in all, shared evenly by the languages; one piece of each is learned at least
LANE = 1024
DENSE = 1 << 23  # cells of an automaton up to which its moves are laid out as a plain table
MIXED = re.compile(r"(?<!\w)[^\W\d]*+\d\w*")
START = np.int32(1 << 30)  # flag: this step begins a phrase


@dataclass
class Automaton:
    """Transitions of all substrings of a text: from[i] goes with symbol[i] to target[i]; state 0 is the start."""

    states: int
    alphabet: int
    length: int
    origin: np.ndarray
    symbol: np.ndarray
    target: np.ndarray


@dataclass
class Model:
    """symbols: letter -> symbol (0: not a letter, 1: an unknown letter); automata: one per language."""

    languages: list[str]
    symbols: dict[str, int]
    automata: list[Automaton]


def suffix_automaton(text: np.ndarray, alphabet: int) -> Automaton:
    """The automaton of all substrings of ``text``, whose symbols are below ``alphabet``."""
    nxt: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text.tolist():
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    sizes = np.fromiter(map(len, nxt), np.int64, len(nxt))
    total = int(sizes.sum())
    return Automaton(
        len(nxt),
        alphabet,
        len(text),
        np.repeat(np.arange(len(nxt)), sizes),
        np.fromiter((c for moves in nxt for c in moves), np.int64, total),
        np.fromiter((t for moves in nxt for t in moves.values()), np.int32, total),
    )


class Dense:
    """Moves of an automaton as a table of states and its own symbols; ``lost``: from there every symbol begins a phrase.

    States are offsets of their rows.  Where no move exists, the cell holds the move from the start, flagged.
    """

    def __init__(self, automaton: Automaton, kinds: np.ndarray):
        width = len(kinds) + 1  # 0: a symbol that the automaton doesn't know
        self.code = np.zeros(automaton.alphabet, np.int32)
        self.code[kinds] = np.arange(1, width)
        self.lost = np.int32(automaton.states * width)
        cells = np.full((automaton.states + 1, width), -1, np.int64)
        cells[automaton.origin, self.code[automaton.symbol]] = automaton.target.astype(np.int64) * width
        root = np.where(cells[0] < 0, self.lost, cells[0]) | START
        self.cells = np.where(cells < 0, root, cells).astype(np.int32).ravel()

    def own(self, symbols: np.ndarray) -> np.ndarray:
        return self.code[symbols]

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with this symbol)."""
        move = self.cells[state + symbol]
        return move & (START - 1), move >= START


class Hashed:
    """The same by a hash of (state, symbol), for automata of many symbols."""

    def __init__(self, automaton: Automaton):
        self.alphabet = automaton.alphabet
        self.lost = automaton.states
        self.index = Index(automaton.origin * automaton.alphabet + automaton.symbol)
        self.target = np.append(automaton.target, np.int32(-1))
        self.root = np.full(automaton.alphabet, self.lost, np.int32)
        at_start = automaton.origin == 0
        self.root[automaton.symbol[at_start]] = automaton.target[at_start]

    def own(self, symbols: np.ndarray) -> np.ndarray:
        return symbols

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nxt = self.target[self.index.find(state.astype(np.int64) * self.alphabet + symbol)]
        begins = nxt < 0
        nxt[begins] = self.root[symbol[begins]]
        return nxt, begins


def parsing_table(automaton: Automaton) -> Dense | Hashed:
    kinds = np.unique(automaton.symbol)
    return Dense(automaton, kinds) if (automaton.states + 1) * (len(kinds) + 1) <= DENSE else Hashed(automaton)


class Lanes:
    """Texts cut into lanes, longest lane first: symbols is (step, lane)."""

    def __init__(self, codes: list[np.ndarray]):
        parts = [c[k : k + LANE] for c in codes for k in range(0, len(c), LANE)]
        owner = np.repeat(np.arange(len(codes)), [-(-len(c) // LANE) for c in codes])
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        order = np.argsort(-sizes, kind="stable")
        place = np.empty(len(parts), np.int64)
        place[order] = np.arange(len(parts))
        self.owner, self.sizes = owner[order], sizes[order]
        # The lane that goes before, -1 for the first of a text.
        before = np.where(np.concatenate(([True], owner[1:] != owner[:-1])), -1, np.concatenate(([0], place[:-1]))) if len(parts) else place
        self.before = before[order]
        steps = int(sizes.max(initial=0))
        cells = np.zeros((len(parts), steps), np.int32)
        if len(parts):
            cells[np.arange(steps)[None, :] < self.sizes[:, None]] = np.concatenate([parts[i] for i in order])
        self.symbols = np.ascontiguousarray(cells.T)
        self.live = np.searchsorted(-self.sizes, -np.arange(steps), side="left")  # lanes longer than each step


def lane_phrases(lanes: Lanes, table: Dense | Hashed) -> np.ndarray:
    """Phrases of the whole texts' parses that begin in each lane."""
    n = len(lanes.sizes)
    symbols = table.own(lanes.symbols)
    state = np.full(n, table.lost, np.int32)
    begins = np.zeros(symbols.shape, bool)
    for i, (row, live) in enumerate(zip(symbols, lanes.live.tolist(), strict=True)):
        state[:live], begins[i, :live] = table.step(state[:live], row[:live])
    own = np.cumsum(begins, axis=0, dtype=np.int32)
    count = own[-1].copy() if n else np.zeros(0, np.int32)
    own_end, end = state, state.copy()
    todo = np.flatnonzero(lanes.before >= 0)
    while len(todo):
        # Go on from the lane before until a phrase begins where one of this lane's own parse does.
        count[todo] = own[-1][todo]
        at, now = todo, end[lanes.before[todo]]
        late = np.zeros(n, np.int32)
        reached = own_end.copy()
        for i in range(len(symbols)):
            done = lanes.sizes[at] <= i
            if done.any():
                reached[at[done]] = now[done]
                count[at[done]] = late[at[done]]
                at, now = at[~done], now[~done]
            if not len(at):
                break
            now, fresh = table.step(now, symbols[i][at])
            same = fresh & begins[i, at]
            met = at[same]
            count[met] = late[met] + own[-1][met] - own[i][met] + 1
            late[at[fresh]] += 1
            at, now = at[~same], now[~same]
        if len(at):
            reached[at], count[at] = now, late[at]
        changed = np.zeros(n, bool)
        changed[todo] = reached[todo] != end[todo]
        end[todo] = reached[todo]
        todo = np.flatnonzero((lanes.before >= 0) & changed[lanes.before])
    return count


def encode(text: str, lookup: np.ndarray) -> np.ndarray:
    """Symbols of a text: letters in lower case, every run of other characters one blank (0).

    Words with digits (keys, numbers with units) are in no language; they count only where there are no other letters.
    """
    codes = _symbols(MIXED.sub(" ", text), lookup)
    return codes if codes.any() else _symbols(text, lookup)


def _symbols(text: str, lookup: np.ndarray) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = lookup[points]
    if len(codes):
        codes = codes[(codes > 0) | np.concatenate(([True], codes[:-1] > 0))]
    return codes


def symbol_lookup(symbols: dict[str, int]) -> np.ndarray:
    lookup = letter_lookup().copy()
    for ch, code in symbols.items():
        lookup[ord(ch)] = code
    return lookup


_letters: list[np.ndarray] = []


def letter_lookup() -> np.ndarray:
    """1 for every letter of Unicode (not for digits, fractions or numerals of any kind), 0 for the rest."""
    if not _letters:
        every = "".join(map(chr, range(0x110000)))
        table = np.zeros(0x110000, np.int32)
        table[np.fromiter(map(str.isalpha, every), bool, len(every))] = 1
        _letters.append(table)
    return _letters[0]


def _sample(docs: DataFrame, text_col: str, lang_col: str, id_col: str) -> list[tuple[str, str]]:
    """(language, piece) rows: about SAMPLE_PIECES a language, chosen by a hash of their id and place, within SYMBOLS in all."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null and id is not null and text is not null").where(C.id_bucket("id", 5) != 0)
    pieces = F.greatest(F.lit(1), F.ceil(F.length("text") / PIECE)).cast("int")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.sum(pieces)).collect()}
    if not sizes:
        return []
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, SAMPLE_PIECES / n))])
    cut = rows.select("id", "text", "lang", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("k"))
    chosen = F.pmod(F.xxhash64(F.col("id"), F.lit(977) + F.col("k")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    cut = cut.where(chosen).select("lang", F.substring("text", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("piece"), F.xxhash64("id", "k").alias("h"))
    most, taken, out = max(PIECE, SYMBOLS // len(sizes)), {}, []
    for r in sorted(cut.collect(), key=lambda r: (r[0], r[2], r[1])):
        taken[r[0]] = taken.get(r[0], 0) + len(r[1])
        if taken[r[0]] <= most:
            out.append((r[0], r[1]))
    return out


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> Model:
    """Learn one automaton per language from whole texts of documents whose id may be learned from."""
    sample = _sample(docs, text_col, lang_col, id_col)
    letters = sorted({ch for _, text in sample for ch in set(text.lower()) if ch.isalpha()})
    symbols = {ch: i + 2 for i, ch in enumerate(letters)}
    lookup = symbol_lookup(symbols)
    texts: dict[str, list[np.ndarray]] = {}
    for lang, text in sample:
        codes = encode(text, lookup)
        if (codes > 0).any():
            texts.setdefault(lang, []).append(np.append(codes, np.int32(0)))
    languages = sorted(texts)
    return Model(languages, symbols, [suffix_automaton(np.concatenate(texts[lang]), len(symbols) + 2) for lang in languages])


def parse(codes: list[np.ndarray], tables: list[Dense | Hashed]) -> np.ndarray:
    """Phrases of each document under each table: (document, table)."""
    lanes = Lanes(codes)
    out = np.zeros((len(codes), len(tables)), np.int64)
    if len(lanes.sizes):
        for k, table in enumerate(tables):
            np.add.at(out[:, k], lanes.owner, lane_phrases(lanes, table))
    return out


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Append ``lang_pred``, ``lang_score`` (0 to 1) and ``phrase_length`` (mean letters per phrase of the winner)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def open_task():
        m = sent.value
        lookup = symbol_lookup(m.symbols)
        tables = [parsing_table(a) for a in m.automata]
        weight = np.log2([max(2, a.length) for a in m.automata])

        def block(texts: list[str]) -> tuple[list, list, list]:
            codes = [encode(t, lookup) for t in texts]
            letters = np.array([np.count_nonzero(c) for c in codes])
            counts = parse(codes, tables) if tables else np.zeros((len(texts), 1), np.int64)
            bits = counts * weight if tables else counts.astype(float)
            best = bits.argmin(axis=1)
            phrases = counts[np.arange(len(texts)), best]
            first = bits[np.arange(len(texts)), best]
            two = np.partition(bits, 1, axis=1)[:, 1] if bits.shape[1] > 1 else np.maximum(first, 1)
            known = (letters > 0) & bool(tables)
            with np.errstate(divide="ignore", invalid="ignore"):
                score = np.where(known, two / (first + two), 0.0)
                length = np.where(known, letters / phrases, 0.0)
            return [m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], score.tolist(), length.tolist()

        def work(column: pa.Array) -> list:
            made: list[list] = [[], [], []]
            texts, size = [], 0
            for t in C.as_texts(column):
                texts.append(t)
                size += len(t)
                if size > 2_000_000:
                    for out, new in zip(made, block(texts), strict=True):
                        out.extend(new)
                    texts, size = [], 0
            if texts:
                for out, new in zip(made, block(texts), strict=True):
                    out.extend(new)
            return made

        return work

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("phrase_length", T.DoubleType())]
    return C.map_texts(docs, open_task, fields, text_col, keep)
