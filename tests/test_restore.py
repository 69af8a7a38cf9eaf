"""Fewest removals: all series at once give what a loop over each gives."""

from __future__ import annotations

import random

import pytest
from test_search import CONFIG, fails, flashing, rows_of

from glintframe.plans import restore, search


def made_series() -> dict[int, list[tuple[float, float]]]:
    rng = random.Random(3)
    out = {1: [(n / 30, 0.9 if n % 6 == 0 else 0.2) for n in range(120)], 2: [(n / 30, 0.9 if n % 4 < 2 else 0.2) for n in range(90)]}
    out[3] = [(n / 30, 0.9 if rng.random() < 0.2 else 0.2) for n in range(120)]
    out[4] = [(n / 30, rng.random()) for n in range(100)]
    out[5] = [(n / 30, 0.3 if 40 <= n < 80 and n % 3 else 0.75) for n in range(130)]
    out[6] = [(n / 30, 0.9 if n % 11 == 0 or 50 <= n < 70 else 0.2) for n in range(120)]
    return out


def reaches(failing, a, b):
    return any(b >= s - restore.BESIDE and a <= e + restore.BESIDE for s, e in failing)


def middle_gap(rows):
    gaps = sorted(b[0] - a[0] for a, b in zip(rows, rows[1:], strict=False))
    return gaps[len(gaps) // 2]


def runs_of(removed):
    runs: list[list[int]] = []
    for i in sorted(removed):
        if runs and runs[-1][-1] + 1 == i:
            runs[-1].append(i)
        else:
            runs.append([i])
    return runs


def chosen(rows, runs, per):
    out: list[int] = []
    for k, run in enumerate(runs):
        if len(out) < per or rows[run[0]][0] - rows[runs[out[-per]][0]][0] > 1 + 2 * middle_gap(rows):
            out.append(k)
    return set(out)


def restored_by_loop(rows, removed):
    """What comes back as flashes, by trying one proposal after the other."""
    runs = runs_of(removed)
    rate, fixed, back = 0, False, chosen(rows, runs, restore.RATES[0])
    while True:
        gone = removed - {i for k in back for i in runs[k]}
        shown = [r for i, r in enumerate(rows) if i not in gone]
        if not fails(shown):
            return {i for k in back for i in runs[k]}, rate
        failing = flashing(shown)
        kept = {k for k in back if not reaches(failing, rows[runs[k][0]][0], rows[runs[k][-1]][0])}
        if not fixed and len(kept) < len(back):
            fixed, back = True, kept
        else:
            rate, fixed, back = rate + 1, False, set()
            if rate < len(restore.RATES):
                back = chosen(rows, runs, restore.RATES[rate])
        while not back and rate + 1 < len(restore.RATES):
            rate, fixed = rate + 1, False
            back = chosen(rows, runs, restore.RATES[rate])
        if rate >= len(restore.RATES) or not back:
            return set(), rate


def thinned_by_loop(rows, removed, apart):
    gap, live = middle_gap(rows), []
    for run in runs_of(removed):
        a, b = run[0], run[-1]
        t0 = rows[a - 1][0] if a else rows[a][0] - gap
        t1 = rows[b + 1][0] if b + 1 < len(rows) else rows[b][0] + gap
        last, back = t0, []
        for i in run:
            if rows[i][0] - last >= apart - 1e-9 and t1 - rows[i][0] >= apart - 1e-9:
                back.append(i)
                last = rows[i][0]
        if back:
            live.append((t0, t1, back))
    for _ in range(restore.THIN_TRIES):
        gone = removed - {i for _, _, back in live for i in back}
        shown = [r for i, r in enumerate(rows) if i not in gone]
        if not fails(shown):
            return {i for _, _, back in live for i in back}
        failing = flashing(shown)
        left = [r for r in live if not reaches(failing, r[0], r[1])]
        if len(left) in (0, len(live)):
            break
        live = left
    return set()


@pytest.mark.parametrize("long", [False, True])
def test_fewest_removals_equal_a_loop(spark, long):
    made = made_series()
    if long:  # slow series with a stretch of flashing, removed in two long runs
        made = {v: [(n / 30, 0.3 + 0.001 * n + (0.5 * (n // v % 2) if 35 <= n < 70 else 0)) for n in range(130)] for v in (2, 3, 5, 8, 13)}
    series = rows_of(spark, made).cache()
    spans = search.flashing_spans(series, ["vid"], CONFIG).cache()
    ways = search.removal_ways(series, spans, ["vid"]).cache()
    best = search.best_way(series, spans, ways, ["vid"], CONFIG).where("passes").select("vid", "variant")
    removed = ways.join(best, ["vid", "variant"]).cache()
    if long:
        removed = series.where("n BETWEEN 30 AND 50 OR n BETWEEN 52 AND 75").select("vid", "n").cache()
    full = {v: {r.n for r in removed.collect() if r.vid == v} for v in made}
    got = restore.fewest_removals(series, removed, ["vid"], CONFIG).collect()
    assert {(r.vid, r.n) for r in got} == {(v, n) for v in full for n in full[v]}
    outcomes = set()
    for v, rows in made.items():
        if not full[v]:
            continue
        back, rate = restored_by_loop(rows, full[v])
        assert {r.n for r in got if r.vid == v and r.back == "flash"} == back, v
        gaps = thinned_by_loop(rows, full[v] - back, 1 / CONFIG.safe_rate)
        assert {r.n for r in got if r.vid == v and r.back == "gap"} == gaps, v
        assert not fails([r for i, r in enumerate(rows) if i not in full[v] - back - gaps])
        outcomes |= {("rate", rate), ("back", bool(back)), ("gaps", bool(gaps))}
    assert len([v for v in full if full[v]]) >= 4 and (("gaps", True) if long else ("back", True)) in outcomes, outcomes


def test_gaps_are_revoked_where_they_fail(spark):
    """Frames that come back flash by themselves at a narrow spacing: the runs in failing windows stay removed."""
    made = made_series()
    series = rows_of(spark, made).cache()
    rows = [(v, n) for v, xs in made.items() for n in range(len(xs)) if 30 <= n < 75 or n >= len(xs) - 9]
    removed = spark.createDataFrame(rows, "vid long, n long").cache()
    for apart in (0.06, 0.1, 0.25):
        got = restore.thin_gaps(series, removed, ["vid"], CONFIG, apart).collect()
        for v, xs in made.items():
            assert {r.n for r in got if r.vid == v} == thinned_by_loop(xs, {n for w, n in rows if w == v}, apart), (v, apart)


def test_nothing_removed(spark):
    series = rows_of(spark, made_series())
    none = spark.createDataFrame([], "vid long, n long")
    assert restore.fewest_removals(series, none, ["vid"], CONFIG).count() == 0


@pytest.mark.parametrize("per", restore.RATES)
def test_choices(spark, per):
    rows = made_series()[3]
    removed = {n for n, (_, x) in enumerate(rows) if x > 0.5}
    series = rows_of(spark, {3: rows})
    marked = spark.createDataFrame([(3, n) for n in removed], "vid long, n long")
    runs = restore.pulses(series, marked, ["vid"])
    got = restore.choices(runs, restore.frame_gaps(series, ["vid"]), ["vid"]).where(f"per = {per}").collect()
    starts = runs_of(removed)
    assert {r.first for r in got} == {starts[k][0] for k in chosen(rows, starts, per)}
