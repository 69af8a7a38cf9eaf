"""LM scoring, language ID, quality and toxicity: brute force, held-out accuracy, odd input."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from glintframe.llm import common as C
from glintframe.llm import langid, lm, quality, queries, toxicity

DATA = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def ppm_log10(train: list[bytes], text: bytes, order: int) -> float:
    """The model word for word: escapes with half a count a symbol, and exclusion."""
    counts: dict[bytes, Counter] = defaultdict(Counter)

    def symbols(t: bytes) -> bytes:
        return bytes([lm.PAD]) * order + t.translate(C.ASCII_LOWER) + bytes([lm.END])

    for t in train:
        s = symbols(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    total, s = 0.0, symbols(text)
    for i in range(order, len(s)):
        excluded: set[int] = set()
        for k in range(order, -1, -1):
            seen = counts.get(s[i - k : i])
            if not seen:
                continue
            left = {x: n for x, n in seen.items() if x not in excluded}
            mass = sum(left.values())
            if not mass:
                continue
            if s[i] in left:
                total += math.log10((left[s[i]] - 0.5) / mass)
                break
            total += math.log10(0.5 * len(left) / mass)
            excluded |= set(left)
        else:
            total -= math.log10(lm.SYMBOLS - len(counts[b""]))
    return total


def test_lm_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["the", "then", "Thing", "of", "offer", "an", "and", "ü"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["", "zebra quiz!", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    is_train = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    trained = lm.fit(docs, C.id_bucket("doc_id", 7) != 2)
    got = {r.doc_id: r for r in lm.score(docs, trained).collect()}
    raw = [(t or "").encode() for t in texts]
    train = [t for i, t in enumerate(raw) if is_train(i)]
    tokens = Counter(w for t in train for w in [*t.translate(C.ASCII_LOWER).split(), b""])
    n, v = sum(tokens.values()), len(tokens)
    assert trained.n_tokens == n
    for i, t in enumerate(raw):
        mine = [*t.translate(C.ASCII_LOWER).split(), b""]
        assert got[i].n_tokens == len(mine)
        assert got[i].n_known == sum(tokens[w] > 0 for w in mine)
        assert got[i].base_score == pytest.approx(sum(math.log10((tokens[w] + 1) / (n + v + 1)) for w in mine), rel=1e-9)
        assert got[i].score == pytest.approx(ppm_log10(train, t, lm.ORDER), rel=1e-4)


def test_lm_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "abcab cabcab bca"), (2, "aab")], "doc_id long, text string")
    model = lm.fit(docs, C.F.lit(True)).model
    coder = lm.Coder(model)
    for context in (b"\xfe\xfe\xfeab", b"zzzzz", b"abcab", b"aaaab"):
        base = sum(x << (8 * (len(context) - i)) for i, x in enumerate(context))
        keys = np.array([base + s for s in range(256) if s != lm.PAD], np.int64)
        assert (10 ** coder.code(keys)).sum() == pytest.approx(1.0, abs=1e-6)


def test_lm_keeps_rare_contexts(spark, monkeypatch):
    for bound in ("NODES", "HOT_WINDOWS"):
        monkeypatch.setattr(lm, bound, 100, raising=False)
    rng = random.Random(5)
    words = ["the", "then", "offer", "and", "quartz", "jumble"]
    texts = [" ".join(rng.choice(words) for _ in range(20)) for _ in range(70)] + ["seldom seen phrase", "seldom seen phrase?", "zzz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    trained = lm.fit(docs, C.F.col("doc_id") <= 70)
    model = trained.model
    raw = [t.encode() for t in texts]
    for r in lm.score(docs, trained).collect():
        if r.doc_id > 67:
            assert r.score == pytest.approx(ppm_log10(raw[:71], raw[r.doc_id], lm.ORDER), rel=1e-6)
            assert r.score == pytest.approx(lm.Coder(model).score([raw[r.doc_id]])[0], rel=1e-6)


def test_lm_odd_input(spark, odd_docs, no_docs):
    trained = lm.fit(odd_docs, C.id_bucket("doc_id", 7) != 2)
    rows = lm.score(odd_docs, trained, keep=["doc_id"]).collect()
    assert len(rows) == odd_docs.count() and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    same = [r for r in rows if r.doc_id == 7]
    assert len(same) == 2 and same[0] == same[1]
    assert lm.score(no_docs, trained, keep=["doc_id"]).count() == 0
    untrained = lm.fit(no_docs, C.F.lit(True))
    row = lm.score(odd_docs.where("doc_id = 3"), untrained, keep=["doc_id"]).first()
    assert row.score == pytest.approx(-2 * math.log10(255)) and row.n_known == 0


@tables
def test_language_held_out(spark):
    docs = C.table(spark, DATA, "documents")
    rows = queries.op2_language_id(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_phrases_equal_brute_force():
    rng = random.Random(5)
    text = "".join(rng.choice("abc") for _ in range(200))
    codes = lambda s: np.array([ord(c) - 96 for c in s], np.uint8)
    table = langid.parsing_table(langid.suffix_automaton(codes(text), 5))
    lines = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 700))) for _ in range(20)] + [""]
    got = langid.parse([codes(x) for x in lines], [table])[:, 0]
    for line, n in zip(lines, got, strict=True):
        want = 0
        for lo in range(0, len(line), langid.LANE):
            rest = line[lo : lo + langid.LANE]
            while rest:
                k = next((k for k in range(len(rest), 0, -1) if rest[:k] in text), 1)
                rest, want = rest[k:], want + 1
        assert n == want


def test_language_odd_input(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    rows = langid.identify(odd_docs, model, keep=["doc_id"]).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd_docs.count()
    assert [by[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and by[0].lang_score == 0
    assert langid.identify(no_docs, model, keep=["doc_id"]).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs, langid.fit(no_docs), keep=["doc_id"]).collect()} == {"und"}


@tables
def test_quality_and_toxicity_held_out(spark):
    labels = C.table(spark, DATA, "labels")
    rows = queries.op6_quality(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    rows = queries.op8_toxicity(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    clean = [r.predicted for r in rows if r.toxic == 0]
    assert np.mean(clean) < 0.03  # the table has 34 toxic documents to learn from
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9


def test_forest_on_odd_input(spark, odd_docs, no_docs, no_labels):
    assert len(quality.statistics("some words")) == len(quality.STATISTICS) == len(quality.statistics(""))
    forest = quality.fit(odd_docs, no_labels)
    assert {r.quality for r in quality.score(odd_docs, forest, keep=["doc_id"]).collect()} == {0.5}
    assert quality.score(no_docs, forest, keep=["doc_id"]).count() == 0
    x = np.random.default_rng(1).normal(size=(400, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.2) ^ (x[:, 5] > 0)).astype(float)
    assert np.mean((quality.grow(x, y).predict(x) > 0.5) == y) > 0.95


def edit_distance_at_most_one(a: str, b: str) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def test_automaton_equals_brute_force():
    rng = random.Random(7)
    make = lambda n: "".join(rng.choice("ab") for _ in range(n))
    terms = {make(rng.randrange(3, 7)): (False, True) for _ in range(6)}
    matcher = toxicity.Matcher(terms)
    for _ in range(3000):
        w = make(rng.randrange(1, 9))
        want = 2 if w in terms else 1 if any(edit_distance_at_most_one(w, t) for t in terms) else 0
        assert matcher.match(w) == want, (w, terms)
    stem = toxicity.Matcher({"lowei": (True, False), "scum": (False, False)})
    assert [stem.match(w) for w in ("lowei", "loweiung", "lowe", "scum", "scums", "scu")] == [2, 2, 0, 2, 0, 0]


def test_toxicity_context_and_odd_input(spark, odd_docs, no_docs, no_labels):
    matcher = toxicity.Matcher({"idiot": (False, True)})
    plain, _ = toxicity.document_features("you are an idiot and more words follow here", matcher)
    quoted, _ = toxicity.document_features('they said "an idiot" and more words follow here', matcher)
    typo, _ = toxicity.document_features("you are an idi0t and more words follow here", matcher)
    assert plain > typo > quoted > 0
    lexicon = toxicity.fit(odd_docs, no_labels)
    assert max(r.toxicity for r in toxicity.score(odd_docs, lexicon, keep=["doc_id"]).collect()) < 0.01
    assert toxicity.score(no_docs, lexicon, keep=["doc_id"]).count() == 0


@pytest.mark.parametrize("dense", [0, 1 << 23])
def test_phrases_cross_lanes(monkeypatch, dense):
    monkeypatch.setattr(langid, "LANE", 7)
    monkeypatch.setattr(langid, "DENSE", dense)
    rng = random.Random(8)
    text = "".join(rng.choice("abc") for _ in range(300)) + "ab" * 60
    codes = lambda s: np.array([ord(c) - 96 for c in s], np.int32)
    table = langid.parsing_table(langid.suffix_automaton(codes(text), 5))
    lines = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    lines += ["ab" * 50, "ba" * 77, "aab" * 30, "d" * 30, text[20:200], "", "b"]
    got = langid.parse([codes(x) for x in lines], [table])[:, 0]
    for line, n in zip(lines, got, strict=True):
        want, rest = 0, line
        while rest:
            k = next((k for k in range(len(rest), 0, -1) if rest[:k] in text), 1)
            rest, want = rest[k:], want + 1
        assert n == want, line


def test_language_learns_whole_texts(spark):
    """The language stands only at the end of long texts, and in letters of its own."""
    rng = random.Random(2)
    junk = lambda n: " ".join("".join(rng.choice("xyz") for _ in range(4)) for _ in range(n))
    tails = {"aa": [chr(0x4E00 + i) for i in range(300)], "bb": [chr(0x5E00 + i) for i in range(300)]}
    learn = [(i, junk(400) + " " + "".join(rng.choice(tails[lang]) for _ in range(600)), lang) for i, lang in enumerate(["aa", "bb"] * 20)]
    asked = [(1000 + i, "".join(rng.choice(tails[lang]) for _ in range(40)), lang) for i, lang in enumerate(["aa", "bb"] * 5)]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(learn, schema))
    rows = langid.identify(spark.createDataFrame(asked, schema), model).collect()
    assert all(r.lang_pred == r.lang for r in rows)


def test_unequal_samples_do_not_decide(spark):
    rng = random.Random(6)
    say = lambda ch, n: " ".join("".join(rng.choice(ch) for _ in range(5)) for _ in range(n))
    learn = [(i, say("abcde", 400), "big") for i in range(30)] + [(100 + i, say("abfgh", 40), "small") for i in range(30)]
    schema = "doc_id long, text string, lang string"
    model = langid.fit(spark.createDataFrame(learn, schema))
    rows = langid.identify(spark.createDataFrame([(i, say("abfgh", 30), "small") for i in range(9)], schema), model).collect()
    assert {r.lang_pred for r in rows} == {"small"}


def test_signs_within_words():
    matcher = toxicity.Matcher({"idiot": (False, True), "bastard": (False, True)})
    assert [matcher.match(w) for w in ("id!ot", "b@stard", "bast*rd", "id!o!t", "you!idiot", "a@b")] == [1, 1, 1, 0, 2, 0]
    assert toxicity.document_features("what a b@stard that is", matcher)[0] > 0.5


def test_toxicity_scores_equal_a_plain_version(spark):
    rng = random.Random(11)
    filler = [f"word{i}" for i in range(300)]
    terms = ["scumface", "vileling", "hatewort"]
    rows = []
    for i in range(240):
        words = [rng.choice(filler) for _ in range(rng.randrange(5, 60))]
        if i % 3 == 0:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(terms))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    copies = [(1000 + i, "zyx copied text with qqqq words that come along", 1) for i in range(9)]
    docs = spark.createDataFrame([r[:2] for r in rows + copies], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows + copies], "doc_id long, toxic int")
    lexicon = toxicity.fit(docs, labels)
    covered = lambda w: any(w == t or (stem and w.startswith(t)) for t, (stem, _) in lexicon.terms.items())
    assert all(covered(t) for t in terms) and not covered("qqqq") and not any(covered(w) for w in filler)

    def near(word, term, stem, fuzzy):
        if word == term or (stem and word.startswith(term)):
            return 2
        ends = [word[:k] for k in range(len(word) + 1)] if stem else [word]
        return int(fuzzy and any(edit_distance_at_most_one(w, term) for w in ends))

    asked = ["a scumface b", 'they said "scumface" once', "scumfac of you", "plain words", "vile1ing hatewort and so on", "x" * 50 + " hatewort"]
    got = toxicity.score(spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string"), lexicon).collect()
    for r in got:
        words = r.text.lower().split()
        total = 0.0
        for i, w in enumerate(words):
            bare = w.strip('"')
            kind = max((near(bare, t, *v) for t, v in lexicon.terms.items()), default=0)
            around = [x.strip('"') for x in words[max(0, i - 6) : i + 7]]
            quoted = w.startswith('"') and w.endswith('"')
            total += (0, 0.7, 1.0)[kind] * (toxicity.QUOTED_WEIGHT if quoted or "said" in around else 1)
        x = [min(math.log1p(3 * total), 3.0), min(100 * total / len(words), 5.0) / 5.0, 1.0]
        assert r.toxicity == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, lexicon.weights, strict=True)))), rel=1e-9), r.text


def test_trees_equal_brute_force(monkeypatch):
    """Splits and leaf values of two trees on few rows, by trying every cut of every statistic."""
    monkeypatch.setattr(quality, "TREES", 2)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, size=(90, len(quality.STATISTICS))).astype(float)
    y = ((x[:, 2] > 2) ^ (rng.random(90) < 0.1)).astype(float)
    got = quality.grow(x, y)
    share = y.mean()
    score = np.full(len(y), math.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])) for f in range(x.shape[1])]

    def tree(rows, g, h, depth):
        """{row: leaf value} of a depth-first tree."""
        best = None
        if depth:
            for f in range(x.shape[1]):
                for cut in edges[f]:
                    left = rows[x[rows, f] <= cut]
                    right = rows[x[rows, f] > cut]
                    if min(len(left), len(right)) < quality.LEAST_CHILD:
                        continue
                    part = lambda r: g[r].sum() ** 2 / (h[r].sum() + quality.RIDGE)
                    gain = part(left) + part(right) - part(rows)
                    if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                        best = (gain, left, right)
        if best is None:
            return dict.fromkeys(rows.tolist(), quality.RATE * g[rows].sum() / (h[rows].sum() + quality.RIDGE))
        return tree(best[1], g, h, depth - 1) | tree(best[2], g, h, depth - 1)

    for _ in range(2):
        p = 1 / (1 + np.exp(-score))
        leaves = tree(np.arange(len(y)), y - p, p * (1 - p), quality.DEPTH)
        score = score + np.array([leaves[i] for i in range(len(y))])
    assert got.raw(x) == pytest.approx(score, rel=1e-9)


def test_words_with_digits_are_in_no_language():
    lookup = langid.symbol_lookup({ch: i + 2 for i, ch in enumerate("abcdef")})
    plain = langid.encode("abc def", lookup).tolist()
    assert langid.encode("abc 12ff34ee def a1", lookup).tolist()[: len(plain)] == plain
    assert np.count_nonzero(langid.encode("a1b2 77", lookup)) == 2
    assert not langid.encode("12 34", lookup).any() and not len(langid.encode("", lookup))
    assert np.count_nonzero(langid.encode("a" * 200_000 + " b", lookup)) == 200_001


def test_numerals_are_no_letters_and_long_texts_are_learned(spark, monkeypatch):
    long = {"xx": "tara bolu miso ketan " * 4_000, "yy": "grün schlaf wurzel hand " * 3_000}
    rows = [(i, long["xx"] if i % 2 else long["yy"], "xx" if i % 2 else "yy") for i in range(40)]
    docs = spark.createDataFrame([*rows, (100, "½ ² ① Ⅷ", None), (101, "bolu miso", None), (102, "wurzel hand", None), (103, "x²", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["xx", "yy"] and all(a.length <= langid.SYMBOLS // 2 + 100 for a in model.automata)
    got = {r.doc_id: r.lang_pred for r in langid.identify(docs, model).where("doc_id >= 100").collect()}
    assert got[100] == "und" and got[101] == "xx" and got[102] == "yy" and got[103] != "und"
