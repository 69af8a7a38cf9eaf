"""Folds of edits against loops written word for word."""

from __future__ import annotations

import random

import pytest

from glintframe.operators import edits, flashes, packets


@pytest.mark.parametrize(("rate", "grid"), [(25, 100), (30, 120), (60, 120), (50, 100), (120, 240)])
def test_slots_equal_a_loop(spark, rate, grid):
    rng = random.Random(rate)
    times = sorted(n / rate + (rng.uniform(0, 0.9 / rate) if n % 7 == 0 else 0) for n in range(80))
    times[40:44] = [times[40] + 1e-7 * i for i in range(4)]  # frames at almost one time
    ends = [*times[1:], times[-1] + 1 / rate]
    frames = spark.createDataFrame([(1, n, a, b) for n, (a, b) in enumerate(zip(times, ends, strict=True))], "vid long, n long, rel double, until double")
    got = edits.slots(frames, ["vid"]).orderBy("n").collect()
    slot = 0
    for row, end in zip(got, ends, strict=True):
        after = max(slot + 1, round(end * grid))
        assert (row.grid, row.first_slot, row.slots) == (grid, slot, after - slot)
        slot = after


def test_one_picture_has_a_slot(spark):
    frames = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 0.0, 0.5)], "vid long, n long, rel double, until double")
    assert {(r.vid, r.grid, r.slots) for r in edits.slots(frames, ["vid"]).collect()} == {(1, 120, 1), (2, 120, 60)}


def test_thinning_with_gone_and_scope(spark):
    rng = random.Random(3)
    rows = [(1, n, n / 30, rng.random() < 0.2, rng.random() < 0.8) for n in range(200)]
    frames = spark.createDataFrame(rows, "vid long, n long, t double, gone boolean, scope boolean")
    want, last = set(), None
    for _, n, t, gone, scope in rows:
        if gone:
            continue
        if last is not None and scope and t - last < 0.1 - 1e-9:
            want.add(n)
        else:
            last = t
    got = {r.n for r in flashes.thinned(frames, ["vid"], "n", "t", 0.1, "gone", "scope").where("thins").collect()}
    assert got == want and want


def test_decode_spans_are_balanced_and_whole_when_short(spark):
    rows = [(1, i + 1, i / 30, i % 25 == 0) for i in range(600)] + [(2, i + 1, i / 30, i % 25 == 0) for i in range(100)]
    frames = spark.createDataFrame(rows, "vid long, `order` long, t double, sync boolean")
    got = {(r.vid, r.part): r for r in packets.decode_spans(frames, ["vid"], "order", 4).collect()}
    assert set(got) == {(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)}
    assert [got[1, p].from_order for p in (1, 2, 3, 4)] == [1, 126, 251, 376]
    assert all(got[1, p].to == got[1, p + 1]["from"] for p in (1, 2, 3)) and got[2, 1].to == 99 / 30
