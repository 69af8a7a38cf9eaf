"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns: every operator and stage."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glintframe.llm import chat, decontaminate, fingerprints, langid, lm, near_dups, packing, quality, queries, sharding, toxicity

NAMES = "size SHARD slot text_crc32 score base_score n_tokens n_known lang_pred lang_score phrase_length toxicity hits rate quality stats hashes positions piece start length ids_crc32 sequence_id offset n_shingles component_id kept label id h pos mode windows share exact item item_id row value g n token gram pair_id place conv_id range copied key rep set block toxic".split()

ITEM = "a question about the river that runs through seven old towns before it meets the sea at last"


@pytest.fixture(scope="module")
def clashing(spark, odd_docs):
    extra = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", *[F.lit("x").alias(c) for c in NAMES])
    leak = spark.createDataFrame([(None, "it was said: " + ITEM, "en"), (50, "as before: " + ITEM, "en")], "doc_id long, text string, lang string")
    more = spark.createDataFrame([(51, "four words and no more", "en"), (51, "four words and no more", "en"), (None, "a null id and clean words", None)], leak.schema)
    rows = leak.unionByName(more).select("*", F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"), *[F.lit("x").alias(c) for c in NAMES])
    return extra.unionByName(rows)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM, "x", "y"), (2, None, "x", "y"), (3, "", "x", "y")], "item_id long, text string, h string, pos string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2, "x") for i in range(10)] + [(None, 1, 1, "x"), (3, None, None, "x"), (3, 1, 1, "x"), (99, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")


def applied(name, docs, bench, labels):
    """(result, columns it appends) of an operator with its default ``keep``."""
    if name == "lm":
        return lm.score(docs, lm.fit(docs, F.lit(True))), ["n_tokens", "n_known", "base_score", "score"]
    if name == "langid":
        return langid.identify(docs, langid.fit(docs)), ["lang_pred", "lang_score", "phrase_length"]
    if name == "sharding":
        return sharding.assign(docs, 3), ["size", "text_crc32", "shard", "slot"]
    if name == "fingerprints":
        return fingerprints.fingerprint(docs), ["hashes", "positions"]
    if name == "quality":
        return quality.score(docs, quality.fit(docs, labels)), ["quality"]
    if name == "toxicity":
        return toxicity.score(docs, toxicity.fit(docs, labels)), ["toxicity"]
    raise KeyError(name)


@pytest.mark.parametrize("name", ["lm", "langid", "sharding", "fingerprints", "quality", "toxicity"])
def test_appending_operators(clashing, bench, labels, name):
    made, appended = applied(name, clashing, bench, labels)
    lower = [c.lower() for c in made.columns]
    assert len(set(lower)) == len(lower) and {c.lower() for c in clashing.columns} | set(appended) == set(lower)
    rows = made.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in clashing.select("doc_id", "text").collect())
    assert all(r[c] is not None for r in rows for c in appended)
    by_text = {}
    for r in rows:
        if name != "sharding":  # equal texts, equal results
            assert by_text.setdefault(r.text or "", [r[c] for c in appended]) == [r[c] for c in appended]
    empty, _ = applied(name, clashing.where("doc_id < -5"), bench, labels)
    assert empty.count() == 0 and empty.columns == made.columns


def test_operators_with_rows_of_their_own(spark, clashing, bench):
    n = clashing.count()
    for made in (near_dups.cluster, fingerprints.compare_edited):
        assert made(clashing).count() == n and made(clashing.where("doc_id < -5")).count() == 0
    found = decontaminate.matches(clashing, bench)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(None, 1), (50, 1)}
    pieces = packing.pieces(clashing, queries.tokenizer_path())
    assert pieces.count() > n
    packed = packing.pack(pieces.select("*", F.lit("x").alias("Sequence_ID"), F.lit("y").alias("offset")))
    assert packed.columns == [*pieces.columns, "sequence_id", "offset"] and packed.count() == pieces.count()
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a " * 50_000), (1, 1, "assistant", "a " * 50_000), (1, 2, None, None), (2, 0, "user", "hi"), (None, 0, "user", "hi"), (3, None, "assistant", "")]
    talk = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    plain = sorted(map(tuple, chat.preference_pairs(talk).collect()))
    more = talk.select("*", *[F.lit("x").alias(c) for c in ("place", "side", "pair_id", "opening", "block", "prompt", "chosen", "rejected", "part")])
    assert plain and sorted(map(tuple, chat.preference_pairs(more).collect())) == plain
    assert chat.preference_pairs(more.where("conv_id > 5")).count() == 0


@pytest.fixture(scope="module")
def sf_dir(tmp_path_factory, bench, labels):
    path = tmp_path_factory.mktemp("tables")
    bench.write.parquet(f"{path}/benchmark.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return str(path)


WANT = {
    # rows of ``clashing`` that stay: by (id, start of the text)
    "toxicity": lambda rows: rows,
    "language": lambda rows: Counter({k: n for k, n in rows.items() if any(ch.isalpha() for ch in k[1] or "")}),
    "near-duplicates": lambda rows: Counter({k: 1 for k in rows if k[0] != 7}),
    "decontamination": lambda rows: Counter({k: n for k, n in rows.items() if ITEM not in (k[1] or "")}),
}


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages(spark, clashing, sf_dir, monkeypatch, stage):
    monkeypatch.setattr(corpus_pipeline, "LEAST_PHRASE", 0.0)  # the model of so few texts knows little
    monkeypatch.setattr(corpus_pipeline, "TOXIC_FROM", 1.1)
    run = dict(corpus_pipeline.STAGES)[stage]
    made = run(spark, clashing, sf_dir)
    empty = run(spark, clashing.where("doc_id < -5"), sf_dir)
    assert empty.columns == made.columns and empty.count() == 0
    rows = made.collect()
    if stage == "packing":
        ids = Counter(r.doc_id for r in clashing.select("doc_id").collect())
        assert Counter(r.doc_id for r in rows if r.piece == 0) == ids
        return
    assert made.columns == clashing.columns and made.dtypes == clashing.dtypes
    before = Counter((r.doc_id, r.text) for r in clashing.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r.text) for r in rows) == WANT[stage](before)
