"""Section checks: the composed sequence by hand, and verdicts and buckets against a loop."""

from __future__ import annotations

import numpy as np
import pytest
from test_search import CONFIG

from glintframe.operators.flashes import Pairs, Runs
from glintframe.plans import sections

FRAMES = "video long, n long, t double, x double"


def tables(spark):
    """Video 1: three sections close together; 2: a section in flashing that is cut out; 3: flashing before, after and far after."""
    flash = lambda t, a, b: 0.9 if a <= t < b and int(t * 12) % 2 else 0.2
    frames = [(1, n, n / 24, flash(n / 24, 1.0, 3.2)) for n in range(240)]
    frames += [(2, n, n / 24, flash(n / 24, 2.0, 6.0)) for n in range(240)]
    frames += [(3, n, n / 24, max(flash(n / 24, 0.0, 3.99), flash(n / 24, 5.5, 6.9), flash(n / 24, 8.0, 9.6))) for n in range(240)]
    marks = [(1, 1, 1.0, 2.0), (1, 2, 2.5, 4.0), (1, 3, 6.0, 7.0), (2, 1, 2.0, 6.0), (2, 2, 8.0, 8.5), (3, 1, 4.0, 5.0), (3, 2, 7.5, 8.0)]
    edited = []
    for v, i, a, b in marks:
        if (v, i) == (1, 2):
            continue  # no sequence: its originals stand
        for f in frames:
            if f[0] == v and a - 1e-9 <= f[2] < b - 1e-9:
                edited.append((v, i, f[2] - a, 0.2 if v == 2 else f[3]))
    tails = [(1, 1, 0.5), (3, 1, 1.0)]
    return (
        spark.createDataFrame(frames, FRAMES),
        spark.createDataFrame(marks, "video long, id long, start double, end double"),
        spark.createDataFrame(edited, "video long, id long, shown double, x double"),
        spark.createDataFrame(tails, "video long, id long, held double"),
    )


def test_composed_by_hand(spark):
    rows = sections.composed(*tables(spark), CONFIG.context_seconds).collect()
    of = lambda v, i, side: sorted((round(r.tc, 6), r.x) for r in rows if (r.video, r.id, r.side) == (v, i, side))
    lead = of(1, 3, "lead")
    # 1.5 to 2.5 of section 1's neighbours: its edited edge whole, originals between, the bare section 2's originals, then originals to 6.0
    assert len(lead) == 24 + 12 + 36 + 48 and lead[-1][0] == round(-1 / 24, 6) and lead[0][0] == round(-120 / 24, 6)
    assert len(of(1, 3, "own")) == 24 and of(1, 3, "tail")[0][0] == pytest.approx(23 / 24 + 1 / 24)
    assert of(1, 1, "tail")[0][0] == pytest.approx(23 / 24 + 0.5 + 1 / 24)
    assert all(x == 0.2 for _, x in of(2, 2, "lead"))  # all that is near is cut out
    assert {(r.video, r.id) for r in rows} == {(1, 1), (1, 3), (2, 1), (2, 2), (3, 1), (3, 2)}


def spans_by_loop(rows):
    """(start, end, onset) of flashing in rows of (tc, x)."""
    runs, pairs, out, last = Runs(1, CONFIG.noise), Pairs(1, CONFIG.k_fail), [], None
    runs.start(np.array([rows[0][1]]), rows[0][0])
    for t, x in rows[1:]:
        peak, trough, base, far = runs.feed(np.array([x]), t)
        up, down = peak & (far - base >= CONFIG.swing) & (base < CONFIG.dark), trough & (base - far >= CONFIG.swing) & (far < CONFIG.dark)
        pairs.feed(up.astype(np.int8) - down.astype(np.int8), t)
        if pairs.strobing(t, CONFIG.k_fail)[0]:
            began = min(t, float(pairs.opens[CONFIG.k_fail - 1, 0]))
            if last is not None and t - last <= 1.0:
                out[-1] = (out[-1][0], t, min(out[-1][2], began))
            else:
                out.append((t, t, began))
            last = t
    return out


def test_verdicts_equal_a_loop(spark):
    frames, marks, edited, tails = tables(spark)
    composed = sections.composed(frames, marks, edited, tails, CONFIG.context_seconds).cache()
    rows = composed.orderBy("video", "id", "n").collect()
    got = {(r.video, r.id): r for r in sections.check(frames, marks, edited, tails, CONFIG).collect()}
    starts = {(r.video, r.id): (r.start, r.end) for r in marks.collect()}
    held = {(r.video, r.id): r.held for r in tails.collect()}
    kinds = set()
    found = {(r.video, r.id, round(r.start, 6), round(r.end, 6), round(r.onset, 6)) for r in sections.flash_spans(composed, CONFIG).collect()}
    want_spans = set()
    for key, r in got.items():
        own = [(x.tc, x.x) for x in rows if (x.video, x.id) == key]
        shown_to = max(x.tc for x in rows if (x.video, x.id) == key and x.side == "own")
        nexts = [s - starts[key][1] for (v, i), (s, _) in starts.items() if v == key[0] and s > starts[key][1] - 1e-9 and s < starts[key][1] + CONFIG.context_seconds]
        want = {"before": 0, "inside": 0, "after": 0, "elsewhere": 0}
        for a, b, began in spans_by_loop(own):
            want_spans.add((*key, round(a, 6), round(b, 6), round(began, 6)))
            if b < -1e-6 or (a < -1e-6 and b <= CONFIG.pool + 1e-6):
                where = "before"
            elif a > shown_to + 1e-6:
                where = "elsewhere" if nexts and a >= shown_to + min(nexts) + held.get(key, 0.0) - 1e-6 else "after"
            else:
                where = "inside"
            want[where] += 1
            kinds.add(where)
        assert {k: r[k] for k in want} == want, key
        assert r.safe == (want["inside"] + want["after"] == 0)
    assert found == want_spans and kinds == {"before", "inside", "after", "elsewhere"}, kinds


def test_no_sections(spark):
    frames, marks, edited, tails = tables(spark)
    assert sections.check(frames, marks.where("id > 9"), edited, tails, CONFIG).count() == 0
    assert sections.check(frames.where("n < 0"), marks, edited.where("id > 9"), tails, CONFIG).count() == 0


def test_moments_are_added_up_from_the_left(spark):
    """The run-out's moments are ((((last + held) + step) + at) + t) - base to the last bit."""
    times = [10 * k / 97 for k in range(97)]
    frames = spark.createDataFrame([(1, n, t, 0.5) for n, t in enumerate(times)], FRAMES)
    marks = spark.createDataFrame([(1, 1, 1.7, 2.9)], "video long, id long, start double, end double")
    own = [t for t in times if 1.7 - 1e-9 <= t < 2.9 - 1e-9]
    edited = spark.createDataFrame([(1, 1, t - own[0], 0.5) for t in own], "video long, id long, shown double, x double")
    tails = spark.createDataFrame([(1, 1, 0.1)], "video long, id long, held double")
    made = sections.composed(frames, marks, edited, tails, 4.5)
    got = sorted(r.tc for r in made.where("side = 'tail'").collect())
    steps = sorted(b - a for a, b in zip(own, own[1:], strict=False))
    step = (steps[(len(steps) - 1) // 2] + steps[len(steps) // 2]) / 2
    after = [t for t in times if 2.9 - 1e-6 <= t < 2.9 + 4.5 - 1e-6]
    last = own[-1] - own[0]
    assert got == [last + 0.1 + step + 0.0 + t - after[0] for t in after]
    assert got != [(last + 0.1 + step) + (t - after[0]) for t in after]
