"""Operators 11 to 13 against brute force and their SQL."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from glintframe.llm import audit, mixing, queries, resample

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size string, rank string, taken string, part string, digest string, Score string, weight string, place string, sid string, good string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(seed: int, n: int = 120) -> list[tuple]:
    rng = random.Random(seed)
    words = ["Alpha", "beta", "GAMMA", "d#lta", "naïve", "x", "日本", "a1b", "—", "ÉCOLE", "Don't"]
    out = []
    for i in range(n):
        text = rng.choice([None, "", " \t", "BIG LETTERS", "same text again " * 20]) if rng.random() < 0.3 else rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.choice([3, 19, 20, 60, 300])))
        out.append((None if i % 17 == 0 else i, text, rng.choice(["a", "a", "a", "b", None, "", "é"]), *"abcdefghij"))
    return [*out, out[5], out[5], (10_000, "long " * 40_000, "a", *"abcdefghij")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(1), SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 == 0 and 1 or 0) for i in range(0, 100, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_audit_by_simulation(spark, docs, labels):
    good, toxic = Counter(), Counter()
    for r in labels.collect():
        good[r.doc_id] |= r.quality == 1
        toxic[r.doc_id] |= r.toxic == 1
    data = [(r.doc_id, r.source or "", r.text or "") for r in docs.collect()]
    least = {}
    for i, _, text in data:
        if i is not None:
            least[text] = min(least.get(text, i), i)
    failing = []
    for i, part, text in data:
        words = WORD.findall(text)
        flags = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), i is not None and least[text] < i]
        failing.append((i, part, {"ABCDE"[k] for k in range(5) if flags[k]}))
    want, shapley = {}, Counter()
    for part in {p for _, p, _ in failing}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [(i, f) for i, p, f in failing if p == part]
            for step, x in enumerate(order, 1):
                gone = [i for i, f in left if x in f]
                fails = sum(x in f for _, p, f in failing if p == part)
                left = [(i, f) for i, f in left if x not in f]
                only = sum(f == {x} for _, p, f in failing if p == part)
                known = [i for i in gone if i is not None]
                want[part, order, step] = (len(left), len(gone), fails - len(gone), only, sum(good[i] for i in known), sum(toxic[i] for i in known))
                shapley[part, x] += len(gone)
    got = audit.audit_documents(docs, labels).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost) == want[r.part, r.filter_order, r.step]
        assert r.shapley == shapley[r.part, r.filter_order[r.step - 1]]
    assert audit.audit_documents(docs.where("doc_id < 0"), labels).count() == 0
    assert audit.audit_documents(docs, labels.where("doc_id < 0")).where("good_lost + toxic_lost <> 0").count() == 0


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), ("p", False, True), (None, None, None)], "part string, short boolean, old boolean")
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.audit(rows, ["short", "old"], "part").collect()}
    assert got["p", "shortold", 1] == (1, 2, 0, 1, 3) and got["p", "shortold", 2] == (0, 1, 1, 1, 3)
    assert got["p", "oldshort", 2] == (0, 1, 1, 1, 3) and got[None, "oldshort", 2] == (1, 0, 0, 0, 0) and len(got) == 8


def brute_resample(data, wanted, order, buckets):
    def features(text):
        lower = "".join(ch.lower() if "A" <= ch <= "Z" else ch for ch in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
        return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(words) - n + 1)]

    s, t = Counter(), Counter()
    for _, text in data:
        s.update(features(text)[1])
    for text in wanted:
        t.update(features(text)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for i, text in data:
        n, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    return out


@pytest.mark.parametrize(("order", "buckets", "size"), [(1, 10_000, 4 << 20), (2, 97, 300), (3, 1_000, 4 << 20)])
def test_resample_by_brute_force(spark, docs, monkeypatch, order, buckets, size):
    monkeypatch.setattr(resample, "BLOCK_BYTES", size)
    wanted = ["naïve alpha BETA x", None, "", "日本 a1b don't x x", "École—beta"]
    target = spark.createDataFrame([(t,) for t in wanted], "text string")
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], wanted, order, buckets)
    got = resample.draw(resample.weigh(docs, resample.fit(docs, target, order, buckets)), percent=10)
    assert sorted(c.lower() for c in got.columns) == sorted([*(c.lower() for c in docs.columns), "n_words", "n_features"])
    rows = got.collect()
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in rows) == Counter(want)
    able = sorted((-r[4], r[0] is None, r[0] or 0) for r in want if r[1] >= 20)
    drawn = sorted((r.rank, r.score, r.doc_id) for r in rows if r["rank"] is not None)
    assert [r[0] for r in drawn] == list(range(1, len(able) * 10 // 100 + 1))
    assert [(-s, i is None, i or 0) for _, s, i in drawn] == able[: len(drawn)]
    nothing = docs.where("doc_id < 0")
    assert resample.draw(resample.weigh(nothing, resample.fit(nothing, target, order, buckets))).count() == 0


def test_permutation(spark):
    n = spark.range(1, 60).select(F.col("id").alias("n"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("i"))
    rows = n.select("n", "i", mixing.permuted(F.col("i"), F.col("n"), [F.lit(7), F.col("n")]).alias("p")).collect()
    for k in range(1, 60):
        assert sorted(r.p for r in rows if r.n == k) == list(range(k))
    large = [r.p for r in spark.range(2000).select(mixing.permuted(F.col("id"), F.lit(2000).cast("long"), [F.lit(1)]).alias("p")).collect()]
    assert sorted(large) == list(range(2000)) and sum(a < b for a, b in itertools.pairwise(large)) in range(900, 1100)


def filled(sizes: list[int]) -> list[float]:
    """Targets by repeated resharing."""
    total, weights, out = sum(sizes), [i % 3 + 1 for i in range(len(sizes))], [0.0] * len(sizes)
    free, rest = set(range(len(sizes))), float(total)
    while free:
        share = {i: rest * weights[i] / sum(weights[j] for j in free) for i in free}
        above = {i for i in free if share[i] > 3 * sizes[i]}
        for i in above or free:
            out[i] = 3.0 * sizes[i] if above else share[i]
        if not above:
            break
        rest -= sum(3.0 * sizes[i] for i in above)
        free -= above
    return out


@pytest.mark.parametrize("sizes", [[100], [0, 50], [1000, 10, 10, 10, 500], [7, 7, 7], [5, 100_000, 3, 1, 900, 20_000, 0, 64], [0, 0]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = sorted(mixing.targets(rows).collect())
    assert [r.target for r in got] == pytest.approx(filled(sizes))
    for r in got:
        assert r.blocks == -(-r.source_size // mixing.BLOCK) and r.quota <= 3 * r.blocks
        assert abs(r.quota * r.source_size - r.target * r.blocks) <= 0.5 * r.source_size + 1e-6


def test_mix(spark, docs, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    got = mixing.mix(docs)
    assert sorted(c.lower() for c in got.columns) == sorted([*(c.lower() for c in docs.columns), "source_size", "target"])
    rows = got.collect()
    assert Counter((r.doc_id, r.text, r.source, r.size) for r in rows) == Counter((r.doc_id, r.text, r.source, len(WORD.findall(r.text or ""))) for r in docs.collect())
    names = sorted({r.source for r in rows}, key=lambda x: (x is None, (x or "").encode()))
    sizes = [sum(r.size for r in rows if r.source == s) for s in names]
    for name, size, target in zip(names, sizes, filled(sizes), strict=True):
        own = [r for r in rows if r.source == name]
        assert {r.source_size for r in own} == {size} and all(r.target == pytest.approx(target) for r in own)
        assert abs(sum(r.taken for r in own) - target) <= 4 * mixing.BLOCK
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    key = lambda frame: sorted(map(repr, frame.select("doc_id", "source", "size", "target", "taken").collect()))
    assert key(mixing.mix(docs.repartition(7))) == key(got)
    assert mixing.mix(docs.where("doc_id < 0")).count() == 0
    assert mixing.mix(docs.where("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_shards_of_the_mix(spark):
    totals = spark.createDataFrame([("a", 40_000), ("b", 900), ("c", 30_000), ("d", 64)], "source string, source_size long")
    sources = mixing.targets(totals).cache()
    quota = {r.sid: (r.quota, r.blocks) for r in sources.collect()}
    slots = sum(q for q, _ in quota.values())
    counts = mixing.draws(sources, slots, shard=200).collect()
    assert sum(r.drawn for r in counts) == slots
    chi = sum((r.drawn - 200 * quota[r.sid][0] / slots) ** 2 / (200 * quota[r.sid][0] / slots) for r in counts if r.shard < slots // 200)
    assert chi < 40  # about 10 shards of 4 sources
    rows = mixing.mixed_slots(sources, slots, shard=200).collect()
    assert Counter(r.shard for r in rows) == Counter(i // 200 for i in range(slots))
    assert Counter(r.sid for r in rows) == Counter({s: q for s, (q, _) in quota.items() if q})
    for s, (q, n) in quota.items():
        own = sorted((r.nth, r.epoch, r.block) for r in rows if r.sid == s)
        assert [x[0] for x in own] == list(range(q)) and all(e == i // n for i, e, _ in own)
        for e in {x[1] for x in own}:
            blocks = [b for _, at, b in own if at == e]
            assert len(set(blocks)) == len(blocks) and set(blocks) <= set(range(n))


def test_taken_is_what_the_blocks_hold(spark):
    docs = spark.createDataFrame([(i, "w " * (i * 7 % 300), "ab"[i % 2]) for i in range(80)], "doc_id long, text string, source string")
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.xxhash64(F.lit(mixing.SEED), F.col("doc_id").cast("string"), "text").alias("place"))
    sources = mixing.targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))).cache()
    sid = {r.source: r.sid for r in sources.collect()}
    times = Counter((r.sid, r.block) for r in mixing.mixed_slots(sources, sources.agg(F.sum("quota")).first()[0]).collect())
    want = {}
    for name, s in sid.items():
        at = 0
        for r in sorted((r for r in rows.collect() if r.source == name), key=lambda r: r.place):
            want[r.doc_id] = sum(times[s, word // mixing.BLOCK] for word in range(at, at + r.size))
            at += r.size
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect()} == want


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")
@pytest.mark.parametrize("name", ["op11_filter_audit", "op12_importance_resampling"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    made = queries.queries()[name](spark, DATA)
    columns = sorted(made.columns)
    want = con.sql(queries.oracle_sql()[name]).project(", ".join(columns)).fetchall()
    assert sorted(map(repr, map(tuple, made.select(*columns).collect()))) == sorted(map(repr, want))
