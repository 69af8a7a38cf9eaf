"""Searches: the plan over variants equals a loop over them."""

from __future__ import annotations

import math
import random

import numpy as np

from glintframe.config import PROFILES
from glintframe.operators.flashes import Pairs, Runs
from glintframe.plans import search

CONFIG = PROFILES["wcag"]


def fails(rows: list[tuple[float, float]]) -> bool:
    runs, pairs = Runs(1, CONFIG.noise), Pairs(1, CONFIG.k_fail)
    runs.start(np.array([rows[0][1]]), rows[0][0])
    for t, x in rows[1:]:
        peak, trough, base, far = runs.feed(np.array([x]), t)
        up, down = peak & (far - base >= CONFIG.swing) & (base < CONFIG.dark), trough & (base - far >= CONFIG.swing) & (far < CONFIG.dark)
        pairs.feed(up.astype(np.int8) - down.astype(np.int8), t)
        if pairs.strobing(t, CONFIG.k_fail)[0]:
            return True
    return False


def some_series() -> dict[int, list[tuple[float, float]]]:
    rng = random.Random(1)
    made = {v: [(n / 30, 0.5 + 0.4 * math.sin(2 * math.pi * hz * n / 30)) for n in range(150)] for v, hz in ((1, 1.0), (2, 5.0), (3, 7.3))}
    made[4] = [(n / 30, rng.random()) for n in range(150)]
    return made


def rows_of(spark, made):
    return spark.createDataFrame([(v, n, t, x) for v, rows in made.items() for n, (t, x) in enumerate(rows)], "vid long, n long, tc double, x double")


def test_rate_search_equals_loop(spark):
    made = some_series()
    got = {r.vid: r for r in search.search_rate(rows_of(spark, made), ["vid"], CONFIG).collect()}
    for v, rows in made.items():
        rate, want = min(2 * CONFIG.safe_rate, 0.9 * 30), None
        for k in range(search.LADDER):
            r = max(CONFIG.safe_rate, rate * 0.9**k)
            kept, last = [], -1e18
            for t, x in rows:
                if t - last >= 1 / r - 1e-9:
                    kept.append((t, x))
                    last = t
            if not fails(kept):
                want = (r, len(kept), True)
                break
            want = (r, len(kept), False)
        assert (round(got[v].rate, 9), got[v].kept, got[v].passes) == (round(want[0], 9), want[1], want[2])


def test_suggestion_passes(spark):
    made = some_series()
    spans = spark.createDataFrame([(2, 0.0, 5.0), (3, 0.0, 5.0)], "vid long, start double, end double")
    got = {r.vid: r for r in search.suggest_removals(rows_of(spark, made), spans, ["vid"], CONFIG).collect()}
    assert set(got) == {2, 3} and all(r.passes and 0 < r.removed < 150 for r in got.values())


def flashing(rows: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Merged spans of the second before each moment at the failing rate."""
    hot = [t for i, (t, _) in enumerate(rows) if i and now_fails(rows[: i + 1])]
    spans: list[list[float]] = []
    for t in hot:
        if spans and t - 1.0 <= spans[-1][1]:
            spans[-1][1] = t
        else:
            spans.append([t - 1.0, t])
    return [tuple(s) for s in spans]


def now_fails(rows: list[tuple[float, float]]) -> bool:
    runs, pairs = Runs(1, CONFIG.noise), Pairs(1, CONFIG.k_fail)
    runs.start(np.array([rows[0][1]]), rows[0][0])
    for t, x in rows[1:]:
        peak, trough, base, far = runs.feed(np.array([x]), t)
        up, down = peak & (far - base >= CONFIG.swing) & (base < CONFIG.dark), trough & (base - far >= CONFIG.swing) & (far < CONFIG.dark)
        pairs.feed(up.astype(np.int8) - down.astype(np.int8), t)
    return bool(pairs.strobing(t, CONFIG.k_fail)[0])


def mix(rows, marks: set[int], strength: float):
    made = []
    for n, (t, x) in enumerate(rows):
        if n in marks:
            a = next((i for i in range(n - 1, -1, -1) if i not in marks), None)
            b = next((i for i in range(n + 1, len(rows)) if i not in marks), None)
            if a is None or b is None:
                m = rows[a if b is None else b][1] if (a is not None or b is not None) else x
            else:
                m = rows[a][1] * (1 - (n - a) / (b - a)) + rows[b][1] * ((n - a) / (b - a))
            x = x * (1 - strength) + m * strength
        made.append((t, x))
    return made


def test_blend_search_equals_loop(spark):
    made = some_series()
    made[5] = [(n / 30, 0.9 if n % 5 == 0 else 0.2) for n in range(90)]
    got = {r.vid: r for r in search.suggest_blend(rows_of(spark, made), ["vid"], CONFIG).collect()}
    outcomes = set()
    for v, rows in made.items():
        marks: set[int] = set()
        for _ in range(3):
            shown = mix(rows, marks, 1.0)
            for a, b in flashing(shown):
                inside = [n for n, (t, _) in enumerate(shown) if a <= t <= b]
                xs = [shown[n][1] for n in inside]
                lo, hi = np.percentile(xs, 15), np.percentile(xs, 85)
                if hi - lo >= 1e-4:
                    light = {n for n in inside if shown[n][1] > (lo + hi) / 2}
                    dark = set(inside) - light
                    marks |= dark if len(dark) < 0.8 * len(light) else light
        want = (0, 0.0, 0.0, True) if not fails(rows) else (len(marks), 1.0, 1.0, False)
        if fails(rows) and not fails(mix(rows, marks, 1.0)):
            lo, hi = 0, 20
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if not fails(mix(rows, marks, mid / 20)) else (mid, hi)
            chosen = min(20, math.ceil((1 - 0.8 * (1 - hi / 20)) * 20 - 1e-9))
            want = (len(marks), hi / 20, (chosen if not fails(mix(rows, marks, chosen / 20)) else hi) / 20, True)
        assert (got[v].marked, got[v].least, got[v].strength, got[v].safe) == want, v
        outcomes.add((want[3], want[1] > 0))
    assert {(True, False), (True, True)} <= outcomes


def test_two_scenes(spark):
    rows = [(1, i, [10.0 if i % 4 < 2 else 90.0] * 12) for i in range(12)] + [(2, i, [10.0 + i / 10] * 12) for i in range(6)]
    frames = spark.createDataFrame(rows, "section int, i int, signature array<double>")
    got = {(r.section, r.i): r.scene for r in search.two_scenes(frames, ["section"]).collect()}
    assert [got[1, i] for i in range(12)] == [0, 0, 1, 1] * 3
    assert all(got[2, i] is None for i in range(6))
