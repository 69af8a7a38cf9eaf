"""The detector as a plan over frames(video, n, t, w, h, rgb[, tc0]): from pictures to violations.

1. *Pictures*: a pass over each video's sorted frames keeps a clock and the last new picture, and
   tells new pictures from repeated ones.  It emits bands of rows, as the codes they came in.
2. *Pixels*: a pass over each (video, band) tracks every pixel's runs and flashes as numpy vectors
   and emits the band's share of all sliding windows as one array a picture.
3. *Frames*: a pass over each video adds the bands' arrays up, tracks every window's mean, which must
   flash too, and gives one row of statistics per frame; intervals follow in SQL.

Parts of a longer video say what its clock shows at their first frame (``tc0``), the good steps before that (``recent``, on
the first frame) and from which frame on there are to be statistics (``from_n``); ``segments`` makes such parts.
Each pass keeps the state of its current key only.  The work on pixels is keyed by (video, band), so one
video is spread over many tasks once its pictures are told apart; what meets again by video is small.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintframe.config import Config, Geometry
from glintframe.functions import colour
from glintframe.operators import flashes as R
from glintframe.operators import intervals as V

BAND = 32  # rows of a picture worked on together
FIRST = -(1 << 63)  # below all frame numbers
LOT, CHUNK = 8 << 20, 1 << 18  # bytes of rows, and of codes, worked on together
LANES = 1 << 14  # of series side by side: what a processor's cache holds
FACTORS = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(256)], np.uint64)
CODE = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(32)], np.uint64).view(np.int64)
COUNTS = ["fail", "ext", "warn", "fail_red", "ext_red", "warn_red"]


@functools.lru_cache
def _geometry(cfg: Config, width: int, height: int) -> Geometry:
    return cfg.geometry(width, height)


def median(values: list[float]) -> float:
    return float(np.median(values)) if values else 1 / 30


def _lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of batches, of about ``LOT`` bytes: what a task holds as Python objects doesn't grow with a batch."""
    for batch in batches:
        step = max(1, LOT * batch.num_rows // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _packed(codes: np.ndarray) -> np.ndarray:
    """One number for each pixel of (..., 3) codes."""
    return codes[..., 0] | codes[..., 1].astype(np.uint32) << 8 | codes[..., 2].astype(np.uint32) << 16


def _alike(codes: np.ndarray, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(one pixel of each class, each pixel's class) of (picture, pixel) numbers: pixels alike in all pictures, and in what is ``known``, are one class.

    Classes are found by a sum of multiples and then compared; pixels that the sum mixes up, or that are hardly ever alike, are classes of their own.
    """
    count, pixels = codes.shape
    factors = FACTORS[np.arange(count) % len(FACTORS)] * np.arange(1, 2 * count, 2, dtype=np.uint64)
    total = (codes * factors[:, None]).sum(axis=0)
    if known is not None:
        total += known.astype(np.uint64) * FACTORS[-1]
    _, pick, which = np.unique(total, return_index=True, return_inverse=True)
    same = 2 * len(pick) <= pixels and (codes == codes[:, pick[which]]).all() and (known is None or (known == known[pick[which]]).all())
    return (pick, which) if same else (np.arange(pixels), np.arange(pixels))


class _Series:
    """One key of a pass over sorted rows: its lanes' ``state`` and what is to come of this lot's rows.

    ``turns``: (a new picture, held ones before it), ``tail``: held ones after the last.  Pictures are whatever the pass makes of rows.
    """

    lanes = 0

    def __init__(self, key):
        self.key, self.size, self.state, self.turns, self.tail = key, None, None, [], []

    def add(self, picture, held: bool) -> None:
        if held:
            self.tail.append(picture)
        else:
            self.turns.append((picture, self.tail))
            self.tail = []


def side_by_side(series: list[_Series], lanes: Callable[[_Series], int]) -> Iterator[list[_Series]]:
    """Series in groups of about ``LANES`` lanes."""
    some: list[_Series] = []
    total = 0
    for x in series:
        if some and total + lanes(x) > LANES:
            yield some
            some, total = [], 0
        some.append(x)
        total += lanes(x)
    if some:
        yield some


def _in_step(series: list[_Series], lanes: int, blank) -> Iterator[tuple]:
    """(turns, series, their joint state, which are at their first picture, where in it each one is): all series' first new pictures of this lot, their second ones, and so on.

    Numpy's calls are dear and pictures small: one call serves all series of a lot.  The state of a series that is done goes
    back to it.
    """
    for some in side_by_side(series, lambda x: lanes):
        yield from _steps(some, lanes, blank)


def _steps(series: list[_Series], lanes: int | None, blank) -> Iterator[tuple]:
    """``_in_step`` for series that fit side by side; without ``lanes`` each series has a number of its own."""
    new = {id(x) for x in series if x.state is None}
    order = sorted((x for x in series if x.turns), key=lambda x: -len(x.turns))
    ends = list(itertools.accumulate(lanes or x.lanes for x in order))
    parts = [slice(a, b) for a, b in zip([0, *ends], ends, strict=False)]
    joint, at = None, 0
    while order:
        left = [x for x in order if len(x.turns) > at]
        if joint is None:
            states = [[blank(sum(lanes or x.lanes for x in some))] if fresh else [x.state for x in some] for fresh, some in ((k, list(g)) for k, g in itertools.groupby(order, lambda x: x.state is None))]
            joint = blank(0).joined(sum(states, []))
        for i in range(len(left), len(order)):
            order[i].state = joint.take(parts[i]).own()
        if len(left) < len(order):
            joint = joint.take(slice(0, ends[len(left) - 1] if left else 0))
        order = left
        if order:
            yield [x.turns[at] for x in order], order, joint, [at == 0 and id(x) in new for x in order], parts[: len(order)]
        at += 1
    for x in series:
        x.turns = []


def _pictures(frames: DataFrame, cfg: Config, alike: bool = True) -> DataFrame:
    """Bands of new pictures, as their codes; with ``alike`` codes of one pixel of each class, where many pixels are alike in a chunk of pictures.

    The chunk's first new picture says then in ``alike`` which class each of the band's pixels is in.
    """
    given = {"tc0": F.lit(0.0), "from_n": F.lit(FIRST), "recent": F.lit(None).cast("array<double>")}
    given = [c if c in frames.columns else default.alias(c) for c, default in given.items()]
    ready = frames.select("video", "n", "t", "w", "h", "rgb", *given)
    ready = R.spread(ready, "video").sortWithinPartitions("video", "n")

    def chunks(rows: list[tuple]) -> Iterator[list[tuple]]:
        """Rows of one video and size, of about ``CHUNK`` bytes."""
        for (_, h, w), same in itertools.groupby(rows, lambda row: (row[0], row[4], row[3])):
            same = list(same)
            step = max(1, CHUNK // (3 * w * h))
            yield from (same[at : at + step] for at in range(0, len(same), step))

    def lights(some: list[tuple], before: list[bytes]):
        """(bands as (classes, codes of each picture), mean luminances, how many pixels moved between two pictures); ``before`` is number -1.

        Pixels alike are worked out once.
        """
        h, w = some[0][4], some[0][3]
        rgb = np.frombuffer(b"".join([*before, *(row[5] for row in some)]), np.uint8).reshape(-1, h * w, 3)
        pick, which = _alike(_packed(rgb))
        share = np.bincount(which)
        light, red, _ = colour.planes(rgb[:, pick], cfg.red_saturation, cfg.red_flare, pack=False)
        off = len(before)

        def moved(i, k):
            far = (np.abs(light[i + off] - light[k + off]) > np.float32(0.5 * cfg.swing)) | (np.abs(red[i + off] - red[k + off]) > np.float32(0.5 * colour.LEAST_RED_SWING))
            return (far * share).sum(axis=-1)

        bands = []
        for y in range(0, h, BAND):
            part = slice(y * w, min(h, y + BAND) * w)
            own, local = np.unique(which[part], return_inverse=True)
            few = alike and 2 * len(own) <= len(local)
            bands.append((local.astype(np.int32).tobytes(), rgb[off:, pick[own]]) if few else (None, rgb[off:, part]))
        return bands, ((light[off:].astype(np.float64) * share).sum(axis=1) / (h * w)).tolist(), moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, state = None, None
        for batch in _lots(batches):
            made = []
            for rows in chunks(list(zip(*(R.plain(column) for column in batch.columns), strict=True))):
                w, h = rows[0][3:5]
                if rows[0][0] != video:
                    video, state = rows[0][0], {"tc": rows[0][6], "t": rows[0][2], "steps": rows[0][8] or [], "last": None}
                before = [state["last"]] if state["last"] is not None and len(state["last"]) == 3 * w * h else []
                bands, means, moved = lights(rows, before)
                each = np.arange(1, len(rows))
                near, new = [None, *moved(each, each - 1).tolist()], -1
                least = max(1.0, 0.1 * _geometry(cfg, w, h).area)
                for i, (_, n, t, _, _, codes, _, from_n, _) in enumerate(rows):
                    step = t - state["t"]
                    begun = state["last"] is not None
                    anomaly = begun and not 0 < step <= cfg.max_gap
                    if begun:
                        state["tc"] += median(state["steps"]) if anomaly else step
                        if not anomaly:
                            state["steps"] = [*state["steps"], step][-120:]
                    state["t"] = t
                    held = False
                    if new >= 0 or before:
                        held = (near[i] if new == i - 1 >= 0 else int(moved(i, new))) < least
                    first = new < 0
                    if not held:
                        state["last"], new = codes, i
                    for band, (classes, parts) in enumerate(bands):
                        part = (None, None) if held else (parts[i].tobytes(), classes if first else None)
                        made.append((video, band, n, t, state["tc"], held, anomaly, means[i], w, h, from_n, *part))
            columns = list(zip(*made, strict=True)) or [[]] * 13
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "video string, band int, n long, t double, tc double, held boolean, anomaly boolean, mean double, w int, h int, from_n long, codes binary, alike binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.bool_(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    return ready.mapInArrow(run, schema)


class _State:
    """Several ``Lanes`` of the same lanes."""

    def members(self) -> dict:
        return {name: value for name, value in vars(self).items() if isinstance(value, (R.Lanes, list))}

    def _with(self, change) -> _State:
        out = R.shallow(self)
        for name, value in self.members().items():
            setattr(out, name, [change(name, i) for i in range(len(value))] if isinstance(value, list) else change(name, None))
        return out

    def member(self, name: str, i: int | None) -> R.Lanes:
        value = getattr(self, name)
        return value if i is None else value[i]

    def take(self, part: slice) -> _State:
        return self._with(lambda name, i: self.member(name, i).take(part))

    def own(self) -> _State:
        return self._with(lambda name, i: self.member(name, i).own())

    def joined(self, states: list) -> _State:
        return self._with(lambda name, i: R.Lanes.joined([x.member(name, i) for x in states]))


class _Tile(_State):
    """Runs and flashes of a band's pixels; times in microseconds.

    From ``unsure`` on, each tracker's shadow takes all lanes to be within a flash; the two differ in what waits for its
    counterpart and in their latest flashes, until something makes them equal.
    """

    def __init__(self, n: int, cfg: Config, ways: bool = False, carry: bool = False):
        us = {"max_run": R.MAX_RUN * 1e6}
        self.light = R.Runs(n, cfg.noise, dtype=np.float32, **us)
        self.red = R.Runs(n, cfg.red_noise, dtype=np.float32, extra=True, **us)
        for runs in (self.light, self.red):
            runs.base, runs.far = np.zeros(n, np.float32), np.zeros(n, np.float32)
        self.red.base_aux, self.red.far_aux = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.cfg = cfg
        self.pairs, self.shadows = ([R.Pairs(n, cfg.k_fail, R.PAIR * 1e6) for _ in range(k)] for k in (3, 3 * carry))  # general, warning, red
        for pairs in self.pairs + self.shadows if ways else ():
            pairs.wild = np.zeros(n, bool)

    def settle(self, t: float, part: slice) -> None:
        self.light.settle(t, part)
        self.red.settle(t, part)

    def unsure(self, wild: np.ndarray | None) -> None:
        """Flashes begin anew, as the runs are known by now but not what waits for its counterpart; ``wild``: which lanes of each tracker are within a flash."""
        for pairs in self.pairs + self.shadows:
            pairs.pending[:], pairs.pending_t[:], pairs.times[:], pairs.opens[:] = 0, R.NEVER, R.NEVER, R.NEVER
        for i, pairs in enumerate(self.pairs):
            pairs.wild[:] = False if wild is None else wild[i]
        for shadow in self.shadows:
            shadow.wild[:] = True

    def still(self) -> np.ndarray:
        """Which lanes have had no run yet, in light and in red."""
        return np.stack([r.direction == 0 for r in (self.light, self.red)])

    def states(self, t: float | np.ndarray, seen: int | np.ndarray) -> np.ndarray:
        """(tracker, as it is or its shadow, lane): codes that are equal where the future is; a shadow that saw nothing is as the tracker.

        The last one is of the runs and of ``seen``, a code of the last new picture.  A lane without a run has no code of its own:
        its base may differ with where the scan began, but says nothing as long as no run begins.  Times are one number, or one for each lane.
        """
        fold = lambda x: (x ^ (x >> 32)).astype(np.int32)
        lanes = len(self.light.direction)
        trackers = self.pairs + self.shadows
        p = R.Pairs.joined(trackers)
        each = np.tile(t, len(trackers)) if np.ndim(t) else t
        out = np.where(each - p.pending_t <= p.pair, p.pending, 0).astype(np.int64) * CODE[0]
        both = p.times.astype(np.int64) * CODE[1 : 2 * len(p.times) : 2, None] + np.maximum(p.opens, 0).astype(np.int64) * CODE[2 : 2 * len(p.times) + 1 : 2, None]
        out += np.where(each - p.times < 1e6, both, 0).sum(axis=0)
        own = fold(out).reshape(-1, len(self.pairs), lanes)
        if self.shadows:
            own[1] = np.where(p.wild.reshape(own.shape)[1], own[0], own[1])

        def run(r: R.Runs, k: int) -> np.ndarray:
            values = [r.direction, r.base.view(np.int32), r.far.view(np.int32), r.since] + ([r.base_aux, r.far_aux] if r.extra else [])
            return np.where(r.direction == 0, 0, sum(v.astype(np.int64) * CODE[k + i] for i, v in enumerate(values)))

        runs = fold(run(self.light, 16) + run(self.red, 20) + seen * CODE[31:])
        return np.stack([*np.stack([own[0], own[-1]], axis=1), np.stack([runs, np.zeros_like(runs)])])

    def _pair(self, i: int, polarity: np.ndarray, t: float) -> None:
        self.pairs[i].feed(polarity, t)
        if self.shadows:
            self.shadows[i].feed(polarity, t)

    def feed(self, light: np.ndarray, red: np.ndarray, packed: np.ndarray, t: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray | None]]:
        """(masks as COUNTS, ages of the openings of failing flashes, if any: general, red)."""
        cfg = self.cfg
        peak, trough, base, far = self.light.feed(light, t)

        def polarity(swing: float) -> np.ndarray:
            up = peak & (far - base >= np.float32(swing)) & (base < np.float32(cfg.dark))
            down = trough & (base - far >= np.float32(swing)) & (far < np.float32(cfg.dark))
            return up.astype(np.int8) - down.astype(np.int8)

        general, warning, reds = self.pairs
        self._pair(0, polarity(cfg.swing), t)
        if cfg.warns:
            self._pair(1, polarity(cfg.warn_swing), t)
        peak, trough, _, _, base_c, far_c = self.red.feed(red, t, packed)
        if (peak | trough).any():
            moved = colour.red_transition(base_c, far_c, cfg.red_delta)
            self._pair(2, (peak & moved).astype(np.int8) - (trough & moved).astype(np.int8), t)
        test = lambda p, k: p.strobing(t, k, cfg.pool * 1e6, R.RATE * 1e6)
        none = np.zeros(len(light), bool)
        masks = [test(general, cfg.k_fail), test(general, cfg.k_extended), test(warning, cfg.k_warn) if cfg.warns else none]
        masks += [test(reds, cfg.k_fail), test(reds, cfg.k_extended), test(reds, cfg.k_warn) if cfg.warns else none]
        ages = [np.where(m, t - p.opens[cfg.k_fail - 1], 0.0) if m.any() else None for m, p in ((masks[0], general), (masks[3], reds))]
        return masks, ages


def _sums(planes: np.ndarray) -> np.ndarray:
    """(plane, picture, row, column) accumulated along rows and columns, from 0 on."""
    out = np.zeros((*planes.shape[:2], planes.shape[2] + 1, planes.shape[3] + 1))
    out[:, :, 1:, 1:] = planes.cumsum(axis=2, dtype=np.float64).cumsum(axis=3)
    return out


def _window_sums(sums: np.ndarray, geo: Geometry, y0: int) -> np.ndarray:
    """(plane, picture, cell) totals of every window's part in a band, from sums accumulated along both axes."""
    rows = sums.shape[2] - 1
    top = np.clip(np.asarray(geo.ys) - y0, 0, rows)
    bottom = np.clip(np.asarray(geo.ys) + geo.wh - y0, 0, rows)
    left = np.asarray(geo.xs)
    right = left + geo.ww
    upper, lower = sums[:, :, top], sums[:, :, bottom]
    return (lower[..., right] - upper[..., right] - lower[..., left] + upper[..., left]).reshape(*sums.shape[:2], -1)


def _oldest(ages: np.ndarray, geo: Geometry, y0: int) -> np.ndarray:
    """The largest age in every window's part in a band; 0 where there is none."""
    out = np.zeros((len(geo.ys), len(geo.xs)))
    for i, y in enumerate(geo.ys):
        a, b = max(0, y - y0), min(len(ages), y + geo.wh - y0)
        if a < b:
            column = ages[a:b].max(axis=0)
            out[i] = [column[x : x + geo.ww].max() for x in geo.xs]
    return out.ravel()


class _Band(_Series):
    """A series of one band's pictures, and what is known of a part of a video: see ``_window_parts``.

    Pixels that were alike in all pictures so far share a lane: ``pick`` is a pixel of each lane, ``which`` the lane of each pixel,
    ``share`` (window, lane) how many of a lane's pixels lie in a window, where that is less than to go through the pixels.
    """

    def __init__(self, key):
        super().__init__(key)
        self.wild = self.before = self.still = self.began = self.which = self.share = self.classes = self.seen = None
        self.last, self.settled = 0.0, math.inf

    def split(self, geo: Geometry, y0: int) -> None:
        """Lanes whose pixels are no longer alike in this lot's pictures become several, and pictures the codes of lanes."""
        if not self.turns:
            return
        known = self.which
        if self.wild is not None:
            known = (0 if known is None else known * 8) + self.wild.T @ np.array([1, 2, 4])
        runs = []
        for _, some in itertools.groupby((row for row, _ in self.turns), lambda row: id(row["alike"])):
            some = list(some)
            codes, classes = np.frombuffer(b"".join(row["codes"] for row in some), np.uint8).reshape(len(some), -1, 3), some[0]["alike"]
            if classes is None:
                pick, known = _alike(_packed(codes), known)
            else:
                both = classes if known is None else known.astype(np.int64) * codes.shape[1] + classes
                _, pick, known = np.unique(both, return_index=True, return_inverse=True)
            runs.append((codes, classes))
        which = known
        if self.state is not None:
            old = self.which[pick]
            self.state = self.state.take(old).own()
            if self.before is not None:
                self.before, self.still = self.before[..., old], self.still[..., old]
        self.share = None
        if 8 * len(pick) * len(geo.xs) * len(geo.ys) <= len(which):
            ones = (which == np.arange(len(pick))[:, None]).reshape(1, len(pick), -1, geo.width)
            self.share = _window_sums(_sums(ones), geo, y0)[0].T
        self.pick, self.which, self.lanes = pick, which, len(pick)
        own = itertools.chain.from_iterable(codes[:, pick if classes is None else classes[pick]] for codes, classes in runs)
        self.turns = [((row, own), before) for (row, before), own in zip(self.turns, own, strict=True)]


def _seen(row: dict) -> int:
    """A number for all of a picture's codes."""
    codes = row["codes"]
    return zlib.crc32(codes if row["alike"] is None else np.frombuffer(codes, np.uint8).reshape(-1, 3)[row["alike"]].tobytes())


def lanes_of(which: np.ndarray, codes: np.ndarray) -> bytes:
    """Codes of a band's lanes with the lane of each pixel, for ``pixels_of``."""
    return np.concatenate([[codes.shape[-1]], which, codes.ravel()]).astype(np.int32).tobytes()


def pixels_of(carry: bytes) -> np.ndarray:
    """(start or end, tracker or runs, one way or the other, pixel): what ``lanes_of`` packed."""
    packed = np.frombuffer(carry, np.int32)
    which, codes = np.split(packed[1:], [len(packed) - 1 - 16 * packed[0]])
    return codes.reshape(2, 4, 2, -1)[..., which]


def _window_parts(bands: DataFrame, cfg: Config, carry: bool = False) -> DataFrame:
    """One row for each new picture and band: totals of all windows over the band's rows; one without, for a held picture.

    Of a part that begins later than its video, runs settle for ``R.MAX_RUN`` seconds before flashes are followed: the first
    pictures may show transitions that are none in the video, or hide some.  A row numbered FIRST has in its codes which lanes are
    wild then.  With ``carry`` each band of a video gives one more row: the codes of its pixels' states (see ``_Tile.states``)
    before its ``from_n`` and after its last frame; the runs' second code tells where a lane had its first run in between, if the part began later.
    """
    ready = R.spread(bands, "video", "band").sortWithinPartitions("video", "band", "n")
    schema = "video string, n long, t double, tc double, held boolean, anomaly boolean, mean double, w int, h int, band int, parts binary, carry binary"

    def carried(done: list[_Band]) -> list[tuple]:
        made = []
        for some in side_by_side([s for s in done if carry and s.state is not None], lambda s: s.lanes):
            sizes = [s.lanes for s in some]
            joint = some[0].state.joined([s.state for s in some])
            now, still, ends = joint.states(np.repeat([s.last for s in some], sizes), np.repeat([_seen(s.seen) for s in some], sizes)), joint.still(), np.cumsum(sizes)[:-1]
            for s, now, still in zip(some, np.split(now, ends, axis=-1), np.split(still, ends, axis=-1), strict=True):
                codes = np.stack([now if s.before is None else s.before, now])
                if not s.began:  # without a run-up nothing is known
                    codes[0, 3, 1] = 1 if s.before is None else (s.still & ~still).any(axis=0)
                made.append((s.key[0], None, None, None, None, None, None, None, None, s.key[1], None, lanes_of(s.which, codes)))
        return made

    def counts(s: _Band, row: dict, state: _Tile | None, part: slice) -> bool:
        """Whether there are to be statistics of a row that comes next; what is to be done before it is done."""
        does = row["n"] >= row["from_n"]
        if s.began is None:
            s.began = row["tc"] == 0.0
            s.settled = math.inf if s.began or not (carry or s.wild is not None) else row["tc"] + R.MAX_RUN
        elif s.settled < math.inf and (does or row["tc"] >= s.settled):
            state.take(part).unsure(None if s.wild is None else s.wild[:, s.pick])
            s.settled = math.inf
        if carry and does and s.before is None and state is not None:
            now = state.take(part)
            s.before, s.still = now.states(s.last, _seen(s.seen)), now.still()
        s.last = float(round(row["tc"] * 1e6))
        return does

    tags = operator.itemgetter("video", "n", "t", "tc", "held", "anomaly", "mean", "w", "h")

    def held(s: _Band, rows: list[dict], state: _Tile | None, part: slice) -> list[tuple]:
        made = []
        for row in rows:
            does = counts(s, row, state, part)
            if state is not None:
                state.settle(s.last, part)
            if row["band"] == 0 and does:
                made.append((*tags(row), 0, None, None))
        return made

    def group(series: list[_Band], last: _Band, w: int, h: int, band: int) -> list[tuple]:
        """Rows of bands that lie alike in pictures of one size; all but the ``last`` one of the lot are done then and keep no state."""
        geo, y0 = _geometry(cfg, w, h), band * BAND
        rows, cells = min(BAND, h - y0), len(geo.xs) * len(geo.ys)
        ways = carry or any(s.wild is not None for s in series)
        made: list[tuple] = []
        for s in series:
            s.split(geo, y0)
        for near in side_by_side(series, lambda s: s.lanes):
            for turns, some, joint, begin, parts in _steps(near, None, lambda n: _Tile(n, cfg, ways, carry)):
                wanted = []
                for s, ((row, _), before), part, first in zip(some, turns, parts, begin, strict=True):
                    state = None if first else joint
                    made += held(s, before, state, part)
                    wanted.append(counts(s, row, state, part))
                    s.seen = row
                t = np.repeat([s.last for s in some], [s.lanes for s in some])
                light, red, packed = colour.planes(np.concatenate([codes for (_, codes), _ in turns]), cfg.red_saturation, cfg.red_flare)
                for part, first in zip(parts, begin, strict=True):
                    if first:
                        joint.light.begin(part, light, t)
                        joint.red.begin(part, red, t, packed)
                masks, ages = joint.feed(light, red, packed, t)
                some = [(s, part, row) for s, ((row, _), _), part, does in zip(some, turns, parts, wanted, strict=True) if does]
                if not some:
                    continue
                totals = np.zeros((len(some), 4 + len(COUNTS), cells))
                if all(s.share is not None for s, _, _ in some):
                    places = np.concatenate([np.arange(part.start, part.stop) for _, part, _ in some])
                    share = np.concatenate([s.share for s, _, _ in some], axis=1)
                    begins = [0, *itertools.accumulate(s.lanes for s, _, _ in some[:-1])]
                    values = np.stack([light, red, *masks], dtype=np.float64)[:, None, places]
                    totals[:, :-2] = np.add.reduceat(values * share, begins, axis=2).transpose(2, 0, 1)
                else:
                    pixels = np.concatenate([s.which + part.start for s, part, _ in some])
                    for i in (0, 1, *(i + 2 for i, m in enumerate(masks) if m.any())):
                        totals[:, i] = _window_sums(_sums((light, red, *masks)[i][pixels].reshape(1, -1, rows, w)), geo, y0)[0]
                for k, mask, age in ((-2, masks[0], ages[0]), (-1, masks[3], ages[1])):
                    if age is not None:
                        for i, (s, part, _) in enumerate(some):
                            if mask[part].any():
                                totals[i, k] = _oldest(age[part][s.which].reshape(rows, w), geo, y0)
                made += [(*tags(row), band, total.tobytes(), None) for (_, _, row), total in zip(some, totals, strict=True)]
            done = [s for s in near if s is not last]
            for s in near:
                made += held(s, s.tail, s.state, slice(None))
                s.tail = []
            made += carried(done)
            for s in done:
                s.state = None
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

        last: _Band | None = None
        for batch in _lots(batches):
            lot: list[_Band] = [last] if last else []
            for values in zip(*(R.plain(column) for column in batch.columns), strict=True):
                row = dict(zip(batch.schema.names, values, strict=True))
                if not lot or (row["video"], row["band"]) != lot[-1].key:
                    lot.append(_Band((row["video"], row["band"])))
                if row["n"] == FIRST:
                    lot[-1].wild = np.frombuffer(row["codes"], bool).reshape(3, -1)
                else:
                    w, h, band = lot[-1].size = (row["w"], row["h"], row["band"])
                    if row["alike"] is not None:
                        lot[-1].classes = np.frombuffer(row["alike"], np.int32)
                    whole = row["held"] or len(row["codes"]) == 3 * w * min(BAND, h - band * BAND)
                    row["alike"] = None if whole else lot[-1].classes
                    lot[-1].add(row, row["held"])
            made: list[tuple] = []
            sizes: dict[tuple, list[_Band]] = {}
            for s in lot:
                if s.size is not None:
                    sizes.setdefault((*s.size, s.wild is not None), []).append(s)
            for (*size, _), series in sizes.items():
                made += group(series, lot[-1], *size)
            last = lot[-1]
            if made:
                yield batch_of(made)
        if last and (made := carried([last])):
            yield batch_of(made)

    names = [x.split()[0] for x in schema.split(", ")]
    f64, i32 = pa.float64(), pa.int32()
    kinds = [pa.string(), pa.int64(), f64, f64, pa.bool_(), pa.bool_(), f64, i32, i32, i32, pa.binary(), pa.binary()]
    return ready.mapInArrow(run, schema)


class _Windows(_State):
    """Whether the windows' means flash too: every window of a picture is a lane."""

    def __init__(self, n: int, cfg: Config):
        self.cfg = cfg
        swing = np.float32(max(0.02, np.float32(cfg.swing) * np.float32(cfg.area_fraction)))
        warn_swing = np.float32(max(0.02, np.float32(cfg.warn_swing) * np.float32(cfg.warn_area_fraction)))
        red = np.float32(colour.LEAST_RED_SWING) * np.float32(cfg.area_fraction)
        warn_red = np.float32(colour.LEAST_RED_SWING) * np.float32(cfg.warn_area_fraction)
        self.swings = (swing, red, warn_swing, warn_red)
        self.runs = [R.Runs(n, s * np.float32(0.3), dtype=np.float32) for s in self.swings]
        for r in self.runs:
            r.base, r.far = np.zeros(n, np.float32), np.zeros(n, np.float32)
        self.pairs = [R.Pairs(n, cfg.k_fail) for _ in self.swings]

    def settle(self, t: float, part: slice) -> None:
        for r in self.runs:
            r.settle(t, part)

    def feed(self, means: list[np.ndarray], t: np.ndarray) -> list[np.ndarray]:
        """Which windows flash often enough, in the order of COUNTS."""
        for i, (r, p, s) in enumerate(zip(self.runs, self.pairs, self.swings, strict=True)):
            x = means[i % 2]
            peak, trough, base, far = r.feed(x, t)
            up, down = peak & (far - base >= s), trough & (base - far >= s)
            p.feed(up.astype(np.int8) - down.astype(np.int8), t)
        cfg, (g, rd, wg, wr) = self.cfg, self.pairs
        of = lambda p, k: p.strobing(t, k, max(cfg.pool, 0.2))
        none = np.zeros(len(means[0]), bool)
        return [of(g, cfg.k_fail), of(g, cfg.k_extended), of(wg, cfg.k_warn) if cfg.warns else none, of(rd, cfg.k_fail), of(rd, cfg.k_extended), of(wr, cfg.k_warn) if cfg.warns else none]


STATS = "video string, n long, t double, tc double, held boolean, anomaly boolean, lum double, hazard int, hazard_red int, cell int, onset_tc double, onset_red_tc double, ext int, ext_red int, warn int, warn_red int, w int, h int"


def frame_stats(frames: DataFrame, cfg: Config) -> DataFrame:
    """One row per frame: clock, held, areas of hazard, extended flashing and warnings of both kinds, onsets, cell."""
    return _frames_of_parts(_window_parts(_pictures(frames, cfg), cfg), cfg)


def _frames_of_parts(parts: DataFrame, cfg: Config) -> DataFrame:
    """The bands' totals of a picture, a few hundred numbers each, meet in a pass over each video's sorted frames."""
    parts = parts.select("video", "n", "t", "tc", "held", "anomaly", "mean", "w", "h", "band", "parts")
    parts = R.spread(parts, "video").sortWithinPartitions("video", "n", "band")
    names = [x.split()[0] for x in STATS.split(", ")]

    def held(rows: list[tuple], state: _Windows | None, part: slice) -> list[tuple]:
        made = []
        for (video, n, t, tc, held, anomaly, mean, w, h), _ in rows:
            if state is not None:
                state.settle(tc, part)
            made.append((video, n, t, tc, held, anomaly, mean, 0, 0, None, tc, tc, 0, 0, 0, 0, w, h))
        return made

    def group(series: list[_Series], w: int, h: int) -> list[tuple]:
        geo = _geometry(cfg, w, h)
        lanes = len(geo.xs) * len(geo.ys)
        made: list[tuple] = []
        for turns, some, joint, begin, parts in _in_step(series, lanes, lambda n: _Windows(n, cfg)):
            for (_, before), part, first in zip(turns, parts, begin, strict=True):
                made += held(before, None if first else joint, part)
            pictures = [picture for picture, _ in turns]
            total = np.stack([x for _, x in pictures], axis=1)  # (plane, picture, window)
            t = np.repeat([tags[3] for tags, _ in pictures], lanes)
            means = [(x.ravel().astype(np.float32).astype(np.float64) / (geo.ww * geo.wh)).astype(np.float32) for x in total[:2]]
            for part, first in zip(parts, begin, strict=True):
                if first:
                    for i, r in enumerate(joint.runs):
                        r.begin(part, means[i % 2], t)
            flashing = [x.reshape(-1, lanes) for x in joint.feed(means, t)]
            counts = dict(zip(COUNTS, zip(total[2:8], flashing, strict=True), strict=True))
            each = range(len(some))

            def best(name: str, ages: np.ndarray) -> list[tuple]:
                """(area, cell, onset) of the window with the largest area that fails, the first of equal ones."""
                area, ok = counts[name]  # noqa: B023
                area = np.where(ok & (area >= geo.area), area, -1)
                cells = area.argmax(axis=1)
                found = zip(area[each, cells].tolist(), cells.tolist(), ages[each, cells].tolist(), [tags[3] for tags, _ in pictures], strict=True)  # noqa: B023
                return [(0, None, tc) if a < 0 else (int(a), cell, tc - age * 1e-6 - cfg.pool if age > 0 else tc) for a, cell, age, tc in found]

            most = lambda name: np.where(counts[name][1], counts[name][0], 0).max(axis=1).astype(int).tolist()  # noqa: E731, B023
            rows = zip(pictures, best("fail", total[8]), best("fail_red", total[9]), *(most(x) for x in ("ext", "ext_red", "warn", "warn_red")), strict=True)
            made += [(*tags[:7], a, b, cell, onset, onset_red, *rest, w, h) for (tags, _), (a, cell, onset), (b, _, onset_red), *rest in rows]
        for s in series:
            made += held(s.tail, s.state, slice(None))
            s.tail = []
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tags, total, last = None, None, None

        def work(lot: list[_Series]) -> Iterator[pa.RecordBatch]:
            sizes: dict[tuple, list[_Series]] = {}
            for s in lot:
                sizes.setdefault(s.size, []).append(s)
            made = [row for size, series in sizes.items() for row in group(series, *size)]
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names)

        def close(lot: list[_Series]) -> None:
            if tags is not None:
                if not lot or lot[-1].key != tags[0]:
                    lot.append(_Series(tags[0]))
                    lot[-1].size = tags[-2:]
                lot[-1].add((tags, total), total is None)

        for batch in _lots(batches):
            lot = [last] if last else []
            for row in zip(*(R.plain(column) for column in batch.columns), strict=True):
                part = None if row[-1] is None else np.frombuffer(row[-1], np.float64).reshape(4 + len(COUNTS), -1)
                if tags is not None and row[:2] == tags[:2]:
                    total = np.vstack([total[:-2] + part[:-2], np.maximum(total[-2:], part[-2:])])
                else:
                    close(lot)
                    tags, total = row[:-2], part
            if lot:
                yield from work(lot)
                last = lot[-1]
        lot = [last] if last else []
        close(lot)
        if lot:
            yield from work(lot)

    f64, i32 = pa.float64(), pa.int32()
    kinds = [pa.string(), pa.int64(), f64, f64, pa.bool_(), pa.bool_(), f64, i32, i32, i32, f64, f64, i32, i32, i32, i32, i32, i32]
    return parts.mapInArrow(run, STATS)


def verdict(stats: DataFrame, cfg: Config, width: int, height: int, patterns: DataFrame | None = None) -> DataFrame:
    """Violations (kind flash, red, extended, pattern) and warnings of the videos whose pictures have this size.

    ``patterns`` has the striped area of each frame (``pattern_stats``); settings that look for patterns need it.

    Columns: video, what, kind, level, start, end, severity, onset, peak.
    """
    from glintframe.operators.clock import to_native

    if cfg.patterns and patterns is None:
        raise ValueError("these settings look for patterns: give pattern_stats of the frames")
    keys = ["video"]
    geo = cfg.geometry(width, height)
    frames = stats.select("video", "tc", "t")

    def strobes(area: str, onset: str, kind: str) -> DataFrame:
        rows = stats.where(F.col(area) >= geo.area).select("video", "n", "t", "tc", area, onset)
        rows = to_native(rows, frames, keys, onset).withColumnRenamed("native", "onset")
        return V.strobe_violations(rows, keys, geo.area, area).drop("island").withColumn("kind", F.lit(kind))

    found = strobes("hazard", "onset_tc", "flash").unionByName(strobes("hazard_red", "onset_red_tc", "red"))
    if cfg.extended:
        spans = V.extended_flashes(stats, keys, geo.area, cfg.extended_hold, cfg.extended_window, cfg.extended_coverage)
        spans = to_native(spans, frames, keys, "start").withColumnRenamed("native", "s")
        spans = to_native(spans, frames, keys, "end").withColumnRenamed("native", "e")
        spans = spans.select("video", F.col("s").alias("start"), F.col("e").alias("end"), F.lit(1.0).alias("severity"), F.col("s").alias("onset"), F.col("s").alias("peak"), F.lit("extended").alias("kind"))
        found = found.unionByName(spans)
    out = found
    if cfg.patterns:
        rows = stats.select("video", "n", "t", "tc").join(patterns.select("video", "n", "pattern"), ["video", "n"])
        spans = V.pattern_violations(rows, keys, max(1, math.floor(cfg.pattern_area * width * height + 0.5)), cfg.pattern_hold, cfg.pattern_seconds)
        out = out.unionByName(spans.withColumn("onset", F.col("start")).withColumn("kind", F.lit("pattern")))
    out = out.select("video", F.lit("violation").alias("what"), "kind", F.lit(None).cast("string").alias("level"), "start", "end", "severity", "onset", "peak")
    if cfg.warns:
        limit = V.warning_spans(stats, keys, geo.area, "ext", "ext_red")
        strict = V.warning_spans(stats, keys, geo.warn_area)
        calls = V.close_calls(limit, strict, found, keys)
        out = out.unionByName(calls.select("video", F.lit("warning").alias("what"), "kind", "level", "start", "end", "severity", F.col("start").alias("onset"), "peak"))
    return out
