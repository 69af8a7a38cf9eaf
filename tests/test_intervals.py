"""Joins on order against all pairs, ties and touching ends included."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from glintframe.operators import intervals as V


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    spans = [(v, i, a, a + rng.randrange(4)) for v in (1, 2) for i, a in enumerate(rng.randrange(60) for _ in range(12))]
    points = [(v, i, a, a + rng.randrange(3)) for v in (1, 2, 3) for i, a in enumerate(rng.randrange(64) for _ in range(40))]
    schema = "vid long, i long, start long, end long"
    return spans, points, spark.createDataFrame(spans, schema), spark.createDataFrame(points, schema)


@pytest.mark.parametrize("closed", [True, False])
def test_touching(tables, closed):
    spans, points, others, rows = tables
    start, end = F.col("start"), F.col("end")
    got = {(r.vid, r.i): r.touches for r in V.touching(rows, start, end, others, start, end, ["vid"], closed).collect()}
    meets = (lambda a, b, s, e: s <= b and e >= a) if closed else (lambda a, b, s, e: s < b and e > a)
    assert got == {(v, i): any(w == v and meets(a, b, s, e) for w, _, s, e in spans) for v, i, a, b in points}


@pytest.mark.parametrize("after", [True, False])
@pytest.mark.parametrize("strict", [True, False])
def test_asof(tables, after, strict):
    spans, points, others, rows = tables
    got = {(r.vid, r.i): r.found for r in V.asof(rows, F.col("start"), others, "start", F.col("start"), ["vid"], "found", after, strict).collect()}
    for v, i, a, _ in points:
        on = [s for w, _, s, _ in spans if w == v and ((s > a if strict else s >= a) if after else (s < a if strict else s <= a))]
        assert got[v, i] == ((min if after else max)(on) if on else None)


def test_coverage(spark, tables):
    _, points, others, _ = tables
    lit = V.merge_spans(others, ["vid"]).drop("parts")
    spans = [(r.vid, r.start, r.end) for r in lit.collect()]
    at = spark.createDataFrame([(v, i, a) for v, i, a, _ in points], "vid long, i long, x long")
    got = {(r.vid, r.i): (r.covered, r.start, r.end) for r in V.coverage(at, lit, ["vid"], F.lit(10)).collect()}
    want = {}
    for v, i, x, _ in points:
        own = [(a, b) for w, a, b in spans if w == v]
        if own:
            opens, closes = [max(a, x) for a, b in own if b > x], [min(b, x + 10) for a, b in own if a < x + 10]
            want[v, i] = (sum(max(0, min(b, x + 10) - max(a, x)) for a, b in own), min(opens) if opens else None, max(closes) if closes else None)
    assert got == want
