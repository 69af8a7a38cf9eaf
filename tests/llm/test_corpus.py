"""Sharding, near-duplicates, fingerprints, packing, chat, decontamination and the pipeline."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from glintframe.llm import chat, common, decontaminate, fingerprints, near_dups, packing, queries, sharding

DATA = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables")


def test_schedule_is_longest_processing_time():
    rng = random.Random(1)
    for shards in (1, 3, 24):
        classes = {rng.randrange(1, 60): rng.randrange(1, 400) for _ in range(30)}
        loads, want = [(0, s) for s in range(shards)], defaultdict(Counter)
        for size in sorted(classes, reverse=True):
            for _ in range(classes[size]):
                load, s = loads[0]
                want[size][s] += 1
                heapq.heapreplace(loads, (load + size, s))
        got = sharding.schedule(list(classes.items()), shards)
        for size, runs in got.items():
            before = 0
            counts = {}
            for s, upto in runs:
                counts[s], before = upto - before, upto
            assert counts == dict(want[size])


def test_sharding_rows(spark, odd_docs, no_docs):
    rows = sharding.assign(odd_docs, 3, keep=["doc_id", "text"]).collect()
    assert len(rows) == odd_docs.count()
    groups = defaultdict(set)
    for r in rows:
        raw = (r.text or "").encode()
        assert r["size"] == len(raw) + 8 and r.text_crc32 == zlib.crc32(raw)
        groups[raw].add(r.shard)
    assert all(len(s) == 1 for s in groups.values())
    for s in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    assert sharding.assign(no_docs, 3, keep=["doc_id"]).count() == 0


def brute_components(texts: dict) -> dict:
    def shingles(t):
        w = (t or "").encode().translate(common.ASCII_LOWER).split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), min(j for j in ids if find(j) == find(i))) for i in ids}


def near_copies(seed: int) -> dict:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    texts = {}
    for group in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 40, 120, 400]))]
        for _ in range(rng.choice([1, 2, 6, 15])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 40)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts[len(texts) * 3] = " ".join(copy)
            base = copy if rng.random() < 0.5 else base
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(near_dups, "BLOCK_ROWS", 4)  # many blocks a list
    texts = near_copies(seed)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.cluster(docs).collect()}
    assert got == brute_components(texts)


def test_clusters_at_another_similarity(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles; a changed word in the middle takes 5
    near = [*words[:30], "x", *words[31:60], "y", *words[61:]]  # 90 of 110 shared: 0.818
    far = [*words[:20], "p", *words[21:50], "q", *words[51:80], "r", *words[81:]]  # 85 of 115: 0.739
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate((words, near, far))], "doc_id long, text string")
    assert {r.doc_id for r in near_dups.cluster(docs, similar=80).collect() if r.kept} == {0, 2}
    assert all(r.kept for r in near_dups.cluster(docs).collect())


def test_near_duplicates_odd_input(spark, odd_docs, no_docs):
    rows = near_dups.cluster(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r.doc_id: r for r in rows}
    assert by[7].component_id == 6 and not by[7].kept and by[6].kept
    assert [by[i].n_shingles for i in (0, 1, 2)] == [0, 0, 0] and by[1].component_id == 1
    assert by[None].kept and by[None].component_id is None
    assert near_dups.cluster(no_docs).count() == 0


def brute_winnow(text: str) -> list[tuple[int, int]]:
    w = fingerprints.Winnower()
    if not text:
        return []
    h = [int(x) >> fingerprints.PLACE_BITS for x in w.hashes(text)]
    out = []
    for i in range(max(1, len(h) - w.window + 1)):
        window = h[i : i + w.window]
        least = min(window)
        at = max(i + j for j, x in enumerate(window) if x == least)
        if not out or out[-1][1] != at:
            out.append((least >> (32 - fingerprints.PLACE_BITS), at))
    return out


def test_winnowing_equals_brute_force():
    rng = random.Random(4)
    for n in (0, 1, 15, 16, 17, 63, 64, 500, 1500):
        text = "".join(rng.choice("abé\U0001f600 ") for _ in range(n)) if n % 2 else "ab" * (n // 2)
        hashes, places = fingerprints.Winnower().choose(text)
        assert list(zip(hashes.tolist(), places.tolist(), strict=True)) == brute_winnow(text)


def test_shared_passage_is_found():
    rng = random.Random(9)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(fingerprints.GRAM + fingerprints.WINDOW - 1))
    noise = lambda: "".join(rng.choice("ijklmnop ") for _ in range(300))
    a, b = (set(fingerprints.Winnower().choose(noise() + shared + noise())[0].tolist()) for _ in range(2))
    assert a & b


def test_edited_texts(spark, odd_docs):
    docs = odd_docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in fingerprints.compare_edited(docs).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts, reverse=True)
    for k, i in enumerate(ids):
        text, after = texts[i], texts[ids[(k + 1) % len(ids)]]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        r = rows[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == fingerprints.as_string(fingerprints.Winnower().choose(text)[0])
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert rows[6].fingerprint == rows[7].fingerprint and rows[7].near_next == 1.0
    assert fingerprints.compare_edited(docs.where("doc_id = 5")).first().near_next == 1.0
    assert fingerprints.compare_edited(odd_docs).count() == odd_docs.count()
    assert fingerprints.compare_edited(docs.where("doc_id < 0")).count() == 0
    got = fingerprints.fingerprint(docs.where("doc_id = 4"), keep=["doc_id"]).first()
    assert len(got.hashes) == len(got.positions) > 0


def test_fullest_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        have = Counter(rng.randrange(1, 40) for _ in range(rng.randrange(0, 9)))
        room = rng.randrange(0, 90)
        chosen = packing.fullest(room, sorted(have, reverse=True), dict(have))
        assert not Counter(chosen) - have
        sums = {0}
        for x, n in have.items():
            sums = {s + x * k for s in sums for k in range(n + 1)}
        assert sum(chosen) == max(s for s in sums if s <= room)


def test_tokens_and_packing(spark, odd_docs, no_docs):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    rows = packing.pack(packing.pieces(odd_docs, path)).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = own.encode(r.text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = ids[k : k + 4096]
            want[r.doc_id, k // 4096, k, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(packing.pieces(no_docs, path)).count() == 0
    lengths = np.random.default_rng(3).integers(1, 4096, 3000)
    sequence, _, fill = packing.pack_lengths(lengths)
    assert fill.max() <= 4096 and sequence.max() + 1 <= 1.01 * -(-lengths.sum() // 4096) + 1


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    own = Tokenizer.from_file(path)
    own.encode_special_tokens = True
    encoder = packing.Encoder(path)
    rng = random.Random(6)
    letters = "ab'sTréÉß 1²½.,!?\n\t\xa0\x85\x1c\x00“”<|>éΣςİ日"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 60))) for _ in range(400)] + ["<|endoftext|> don't I'LL"]
    for t, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == own.encode(t, add_special_tokens=False).ids, repr(t)


@tables
def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{DATA}/conversations.parquet')")
    rows = chat.preference_pairs(common.table(spark, DATA, "conversations"))
    want = con.sql(chat.ORACLE)
    assert sorted(map(tuple, rows.select(*want.columns).collect())) == sorted(want.fetchall())


def test_chat_pairs(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "user", "more"), (1, 3, "assistant", "b"), (17, 0, "user", "hi"), (17, 1, "assistant", None), (None, 0, "user", "lost"), (5, 0, None, "x"), (5, 0, None, "x")]
    rows = {r.pair_id: r for r in chat.preference_pairs(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    swap, sibling = rows["swap-1"], rows["sibling-1-17"]
    assert swap.prompt_turns == 3 and swap.prompt.endswith("more<|end|>\n")
    assert swap.chosen == "<|assistant|>\nb<|end|>\n" and swap.rejected == "<|assistant|>\na<|end|>\n"
    a, b = map(int, swap.chosen_spans.split(":"))
    assert swap.chosen[a:b] == "b<|end|>"
    assert sibling.prompt_turns == 1 and sibling.rejected == "<|assistant|>\n<|end|>\n" and sibling.chosen.count("<|end|>") == 3
    assert chat.preference_pairs(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


@pytest.mark.parametrize("salts", [1, 4, 16])
def test_every_sibling_meets_the_next(spark, salts):
    rng = random.Random(salts)
    opens = {i: rng.choice(["hi", "hello", "good day"]) for i in rng.sample(range(-500, 5000), 90)} | {7001: "alone", 7002: "two", 9000: "two"}
    turns = chat.ordered_turns(spark.createDataFrame([(i, 0, "user", t) for i, t in opens.items()], "conv_id long, turn long, role string, text string"))
    want = set()
    for t in set(opens.values()):
        ids = sorted(i for i in opens if opens[i] == t)
        want |= {f"sibling-{a}-{b}" for a, b in zip(ids, ids[1:], strict=False)}
    assert {r.pair_id for r in chat.siblings(turns, salts).collect()} == want


def test_decontamination(spark, odd_docs, no_docs):
    item = "A farmer named Alice had 12 apples and gave 5 kg of them to her neighbour before the market opened on the hill"
    other = "Completely different question about rivers that flow through several towns before they reach the open sea at last"
    bench = spark.createDataFrame([(1, item), (2, other), (3, None), (4, "two words"), (5, "")], "item_id long, text string")
    filler = "nothing to see here in these plain words that fill the page with more and more of the same text"
    texts = {
        10: f"{filler} {item} {filler}",  # as it is
        11: f"{filler}. {item.replace('Alice', 'Bob').replace('12', '7').replace('5', '3')}. {filler}",  # other values
        12: f"{filler} {item.upper()} {filler}",
        13: filler,
        14: " ".join(item.split()[:6]) + " " + filler,  # a few words of it
        15: item.replace("12", "9").replace("5", "9"),  # one value for two of the item's
    }
    docs = spark.createDataFrame([*texts.items(), (None, item)], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert (10, 1) in found and found[10, 1].exact
    assert (11, 1) in found and not found[11, 1].exact
    assert (None, 1) in found
    assert not any(k[0] in (13, 14, 15) for k in found)
    assert decontaminate.matches(odd_docs, bench).count() == 0
    assert decontaminate.matches(no_docs, bench).count() == 0
    assert decontaminate.matches(docs, bench.where("item_id < 0")).count() == 0


def test_decontamination_of_literal_copies(spark):
    sums, capital = "Compute 345 * 23 + 12 - 7", "Paris lies on which river of the country"
    twice = "A box holds 12 red balls and 12 blue balls and a child takes some of them home before the rain begins to fall"
    bench = spark.createDataFrame([(1, sums), (2, capital), (3, twice)], "item_id long, text string")
    filler = "nothing to see here in these plain words"
    texts = {1: f"{filler} {sums} {filler}", 2: f"{filler} {capital} {filler}", 3: f"{filler} {twice.replace('12', '13', 1)} {filler}", 4: f"{filler} Compute 9 * 8 + 4 - 2 {filler}", 5: filler}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, bench).collect()}
    assert set(found) == {(1, 1), (2, 2), (3, 3)}
    assert found[1, 1].exact and found[1, 1].share == 1 and found[2, 2].exact and not found[3, 3].exact


@tables
def test_decontamination_finds_all_passages(spark):
    docs = common.table(spark, DATA, "documents").collect()
    items = common.table(spark, DATA, "benchmark").collect()
    want = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    got = {(r.doc_id, r.item_id) for r in queries.op10_decontamination(spark, DATA).collect()}
    assert want and want <= got and len(got - want) <= len(want) // 10


def test_pipeline_rejects_what_op8_marks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 0.29), (2, 0.3), (3, 0.45), (4, 0.9)], "doc_id long, given double")
    monkeypatch.setattr(corpus_pipeline.C, "table", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "fit", lambda *_: None)
    monkeypatch.setattr(corpus_pipeline.toxicity, "score", lambda d, _: d.withColumn("toxicity", d.given))
    assert [r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DATA).collect()] == [1]


@tables
def test_pipeline_drops_toxic_documents_and_keeps_clean_ones(spark):
    """The stage as it is, at its own threshold.  So few toxic texts (37 to learn from) don't hold all terms: of those it
    may not learn from most go; on 0.1 GB all did (README)."""
    docs, labels = common.table(spark, DATA, "documents"), common.table(spark, DATA, "labels")
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, DATA).select("doc_id").collect()}
    marks = {r.doc_id: (r.toxic, r.held) for r in labels.select("doc_id", "toxic", (common.id_bucket("doc_id", 4) == 2).alias("held")).collect()}
    clean, toxic = [i for i, (t, _) in marks.items() if t == 0], [i for i, (t, held) in marks.items() if t == 1 and held]
    assert toxic and sum(i in kept for i in clean) >= 0.99 * len(clean) and sum(i in kept for i in toxic) < 0.5 * len(toxic)


@tables
def test_pipeline_rejects_unlearned_languages(spark):
    docs = common.table(spark, DATA, "documents").select("doc_id", "text", "lang")
    clean = docs.join(common.table(spark, DATA, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi")
    finnish = ["Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", "Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.", "Jokaisella on oikeus elämään, vapauteen ja henkilökohtaiseen turvallisuuteen."]
    planted = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(finnish)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs.unionByName(planted), DATA).select("doc_id").collect()}
    assert min(kept) >= 0 and {r.doc_id for r in clean.select("doc_id").collect()} <= kept


@tables
def test_pipeline(spark):
    docs = common.table(spark, DATA, "documents")
    columns = docs.columns
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = common.stored(stage(spark, docs, DATA), "test-stage")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert made.columns == columns and made.join(docs, "doc_id", "left_anti").count() == 0
        if i == 2:
            texts = {r.doc_id: r.text for r in docs.collect()}
            components = {i: c for i, (_, c) in brute_small(texts).items()}
            assert {r.doc_id for r in made.collect()} == set(components.values())
        docs = made
    assert set(docs.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


def brute_small(texts: dict) -> dict:
    """brute_components, comparing only texts that share a shingle."""
    def shingles(t):
        w = (t or "").encode().translate(common.ASCII_LOWER).split()
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    shared = Counter((a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 85 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def parts(pairs) -> set[frozenset]:
    """Connected sets of the pairs."""
    made: list[set] = []
    for pair in pairs:
        met = [m for m in made if m & set(pair)]
        made = [m for m in made if not m & set(pair)] + [set(pair).union(*met)]
    return set(map(frozenset, made))


def test_sketch_filter_loses_no_link():
    rng = np.random.default_rng(5)
    for n_words in (6, 30, 47, 49, 60, 400):
        base = np.unique(rng.integers(-(1 << 60), 1 << 60, n_words))
        sets = []
        for _ in range(40):
            gone = rng.random(len(base)) < rng.choice([0.0, 0.03, 0.08, 0.3])
            sets.append(np.unique(np.concatenate([base[~gone], rng.integers(-(1 << 60), 1 << 60, int(gone.sum()))])))
        sets += [np.unique(rng.integers(-(1 << 60), 1 << 60, n_words)) for _ in range(10)]  # linked with nothing
        sizes = np.array([len(s) for s in sets])
        linked = {(i, j) for i in range(50) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (sizes[i] + sizes[j] - k)}
        likely = near_dups.may_be_linked(sets, sizes, np.zeros(50), True, 85)
        assert {i for pair in linked for i in pair} <= set(likely.tolist()) and not set(range(40, 50)) & set(likely.tolist())
        forest = near_dups.links_of(sets, np.zeros(50), True)
        assert parts(forest.tolist()) == parts(linked)


def rolled(gram: str) -> int:
    """The mixed hash of one gram, by its definition."""
    full = (1 << 64) - 1
    h = sum((ord(c) + 1) * pow(fingerprints.BASE, k, 1 << 64) for k, c in enumerate(gram)) & full
    h ^= h >> 31
    h = h * 0xBF58476D1CE4E5B9 & full
    return h ^ (h >> 29)


def test_gram_hashes_by_definition():
    rng = random.Random(12)
    for n in (1, 15, 16, 17, 90):
        text = "".join(rng.choice("abé\U0001f600 ") for _ in range(n))
        want = [rolled(text[i : i + fingerprints.GRAM]) for i in range(max(1, n - fingerprints.GRAM + 1))]
        assert [int(x) for x in fingerprints.Winnower().hashes(text)] == want


def test_ranges_are_partitions_of_about_equal_text(spark):
    from pyspark.sql import functions as F

    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), F.when(F.col("id") < 300, 400).otherwise(20).cast("int")).alias("text"))
    rows = fingerprints.beside_next(docs)
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.length("text")).alias("n"), F.count_distinct("range").alias("ranges")).collect()
    assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and all(r.ranges == 1 for r in sizes)
    assert max(r.n for r in sizes) < 1.6 * sum(r.n for r in sizes) / len(sizes)


def test_one_id_with_several_texts(spark):
    """8 is near one text of id 5, 9 near the other: one component, the same on every run."""
    rng = random.Random(4)
    a, b, other = ([f"{c}{rng.randrange(10**6)}" for _ in range(80)] for c in "abc")
    near = lambda words: " ".join([*words[:-1], "end"])
    rows = [(5, " ".join(a)), (5, " ".join(b)), (8, near(a)), (9, near(b)), (3, " ".join(other)), (5, ""), (4, " ".join(a)), (5, " ".join(a))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    runs = [sorted(map(tuple, near_dups.cluster(docs.repartition(1 + i)).collect())) for i in range(10)]
    assert all(r == runs[0] for r in runs)
    assert {(r[0], r[2]) for r in runs[0] if r[1]} == {(3, 3), (4, 4), (5, 4), (8, 4), (9, 4)}
    assert [r for r in runs[0] if not r[1]] == [(5, 0, 5, True)]
