"""Order-dependent folds over series: monotonic runs, qualifying transitions, opposing pairs.

A fold runs inside a sorted partition and keeps one small state per key, so memory doesn't grow
with a series.  The same kernel works on numpy vectors, for a tile of pixels at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UP, DOWN = 1, -1
MAX_RUN, PAIR, RATE, FRESH = 2.0, 1.0, 0.999, 0.125  # seconds
NEVER = -1e18


def shallow(x):
    """``copy.copy`` of a plain object, which takes longer to find out how to."""
    out = object.__new__(type(x))
    out.__dict__.update(x.__dict__)
    return out


class Lanes:
    """Arrays whose last axis is lanes, by name in ``lanes``; None where there is none yet."""

    lanes: tuple = ()

    def take(self, part: slice):
        """The same state of some lanes, in views."""
        out = shallow(self)
        for name in self.lanes:
            value = getattr(self, name)
            setattr(out, name, None if value is None else value[..., part])
        return out

    def own(self):
        """The same state in arrays of its own."""
        return self.joined([self])

    @classmethod
    def joined(cls, states: list):
        """Lanes of several states side by side."""
        out = shallow(states[0])
        for name in out.lanes:
            values = [getattr(x, name) for x in states]
            setattr(out, name, None if values[0] is None else np.concatenate(values, axis=-1))
        return out


class Runs(Lanes):
    """Monotonic runs of ``n`` values side by side.  ``feed`` returns the run that just ended, where one did.

    Times are one number, or one for each lane.
    """

    lanes = ("direction", "base", "far", "since", "base_aux", "far_aux")
    base_aux = far_aux = None

    def __init__(self, n: int, noise: float, max_run: float = MAX_RUN, dtype=np.float64, extra: bool = False):
        self.noise, self.max_run = dtype(noise), max_run
        self.direction = np.zeros(n, np.int8)
        self.base = self.far = None
        self.since = np.zeros(n)
        self.extra = extra

    def start(self, x: np.ndarray, t: float, aux: np.ndarray | None = None) -> None:
        self.base, self.far = x.copy(), x.copy()
        self.since[:] = t
        if self.extra:
            self.base_aux, self.far_aux = aux.copy(), aux.copy()

    def begin(self, part: slice, x: np.ndarray, t: np.ndarray, aux: np.ndarray | None = None) -> None:
        """``start`` for some lanes."""
        if self.base is None:
            self.base, self.far = np.zeros_like(x), np.zeros_like(x)
            if self.extra:
                self.base_aux, self.far_aux = np.zeros_like(aux), np.zeros_like(aux)
        self.base[part] = self.far[part] = x[part]
        self.since[part] = t[part]
        if self.extra:
            self.base_aux[part] = self.far_aux[part] = aux[part]

    def feed(self, x: np.ndarray, t: float, aux: np.ndarray | None = None):
        """(turned down, turned up, base, far[, base aux, far aux]) of the runs as they were."""
        up, down = self.direction == UP, self.direction == DOWN
        longer = (up & (x >= self.far)) | (down & (x <= self.far))
        self.far = np.where(longer, x, self.far)
        if self.extra:
            self.far_aux = np.where(longer, aux, self.far_aux)
        peak = up & ~longer & (x < self.far - self.noise)
        trough = down & ~longer & (x > self.far + self.noise)
        ended = (peak, trough, self.base, self.far) + ((self.base_aux, self.far_aux) if self.extra else ())
        turned = peak | trough
        still = self.direction == 0
        rises = still & (x > self.base + self.noise)
        falls = still & ~rises & (x < self.base - self.noise)
        begins = rises | falls
        self.base = np.where(turned, self.far, self.base)
        self.far = np.where(turned | begins, x, self.far)
        self.since = np.where(turned, t, self.since)
        if self.extra:
            self.base_aux = np.where(turned, self.far_aux, self.base_aux)
            self.far_aux = np.where(turned | begins, aux, self.far_aux)
        self.direction = np.where(peak | falls, DOWN, np.where(trough | rises, UP, self.direction)).astype(np.int8)
        stale = t - self.since > self.max_run
        flat = stale & (self.direction == 0)
        self.far = np.where(flat, x, self.far)
        if self.extra:
            self.far_aux = np.where(flat, aux, self.far_aux)
        self._age(stale, t)
        return ended

    def settle(self, t: float, part: slice = slice(None)) -> None:
        """Time passes without a new value, for some lanes or all."""
        stale = t - self.since[part] > self.max_run
        if stale.any():
            self.take(part)._age(stale, t)

    def _age(self, stale: np.ndarray, t: float) -> None:
        if not stale.any():
            return
        self.base[stale] = self.far[stale]
        self.since[stale] = _of(t, stale)
        if self.extra:
            self.base_aux[stale] = self.far_aux[stale]


def _of(t: float | np.ndarray, some: np.ndarray) -> float | np.ndarray:
    return t[some] if np.ndim(t) else t


class Pairs(Lanes):
    """Opposing transitions within ``PAIR`` seconds make a flash; the last ``k`` flashes are kept with their openings.

    The first transition of lanes that are ``wild`` completes a flash that began before there was anything to see.
    """

    lanes = ("pending", "pending_t", "times", "opens", "wild")

    def __init__(self, n: int, k: int, pair: float = PAIR):
        self.pair = pair
        self.pending = np.zeros(n, np.int8)
        self.pending_t = np.full(n, NEVER)
        self.times = np.full((k, n), NEVER)
        self.opens = np.full((k, n), NEVER)
        self.wild = None

    def feed(self, polarity: np.ndarray, t: float) -> np.ndarray:
        """polarity: 1, -1 or 0 for none.  Returns where a flash was completed."""
        some = polarity != 0
        if not some.any():
            return some
        flash = some & (self.pending == -polarity) & (t - self.pending_t <= self.pair)
        if self.wild is not None:
            flash |= some & self.wild
            self.wild = self.wild & ~some
        if flash.any():
            self.times[1:, flash] = self.times[:-1, flash]
            self.opens[1:, flash] = self.opens[:-1, flash]
            self.times[0, flash] = _of(t, flash)
            self.opens[0, flash] = self.pending_t[flash]
        waits = some & ~flash
        self.pending = np.where(flash, 0, np.where(waits, polarity, self.pending)).astype(np.int8)
        self.pending_t = np.where(flash, NEVER, np.where(waits, t, self.pending_t))
        return flash

    def strobing(self, t: float, k: int, fresh: float = FRESH, rate: float = RATE) -> np.ndarray:
        last = t - self.times[0] <= fresh
        return last & (t - self.times[k - 1] < rate) if last.any() else last


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session shuffles to.  A number that is asked for isn't lowered for small
    rows: what a fold costs is its work on rows, not their bytes, and sorted unions of wide rows take many times their shuffled bytes."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def plain(column: pa.Array) -> list:
    """The values of a column as Python objects; numbers without nulls by way of numpy, which is faster."""
    numbers = pa.types.is_integer(column.type) or pa.types.is_floating(column.type) or pa.types.is_boolean(column.type)
    return column.to_numpy(zero_copy_only=False).tolist() if numbers and not column.null_count else column.to_pylist()


def sorted_fold(df: DataFrame, keys: list[str], order: list[str], fields: list[T.StructField], begin, keep: list[str], takes: list[str] | None = None) -> DataFrame:
    """Feed rows to a fold, key by key in order; ``begin()`` makes a key's step function: row -> new values.

    One pass over sorted partitions: a key's rows are never gathered, only its state.  A step gets a row as a dict or, where
    ``takes`` names columns, their values alone; columns that are only kept never become Python objects then.
    """
    out = T.StructType([df.schema[c] for c in keep] + fields)
    ready = spread(df, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        key, step = None, None
        for batch in batches:
            names = batch.schema.names
            made = []
            known = {c: plain(batch.column(names.index(c))) for c in dict.fromkeys([*keys, *(names if takes is None else takes)])}
            rows = zip(*(known[c] for c in takes or names), strict=True)
            for now, row in zip(zip(*(known[k] for k in keys), strict=True), rows, strict=True):
                if now != key:
                    key, step = now, begin()
                made.append(step(dict(zip(names, row, strict=True))) if takes is None else step(*row))
            columns = [batch.column(names.index(c)) for c in keep]
            columns += [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip(list(zip(*made, strict=True)) or [[]] * len(fields), fields, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return ready.mapInArrow(run, out)


def series_flashes(df: DataFrame, keys: list[str], order: str = "n", time: str = "tc", value: str = "x", noise: float = 0.02, swing: float = 0.10, dark: float = 0.80, k: int = 4) -> DataFrame:
    """Append to a table of series: transition (1, -1 or 0), flash, opened (when it began) and strobing."""
    fields = [T.StructField("transition", T.IntegerType()), T.StructField("flash", T.BooleanType()), T.StructField("opened", T.DoubleType()), T.StructField("strobing", T.BooleanType())]

    def begin():
        # One series is one lane of Runs and Pairs: the same rules in plain floats.
        direction, base, far, since = 0, None, 0.0, 0.0
        pending, pending_t, times = 0, NEVER, [NEVER] * k

        def step(x: float, t: float):
            nonlocal direction, base, far, since, pending, pending_t, times
            if base is None:
                base, far, since = x, x, t
                return 0, False, None, False
            polarity = 0
            if direction:
                if x >= far if direction == UP else x <= far:
                    far = x
                elif x < far - noise if direction == UP else x > far + noise:
                    low, high = (base, far) if direction == UP else (far, base)
                    if high - low >= swing and low < dark:
                        polarity = direction
                    direction, base, far, since = -direction, far, x, t
            elif x > base + noise:
                direction, far = UP, x
            elif x < base - noise:
                direction, far = DOWN, x
            if t - since > MAX_RUN:
                if not direction:
                    far = x
                base, since = far, t
            flash, opened = False, None
            if polarity:
                if pending == -polarity and t - pending_t <= PAIR:
                    flash, opened = True, pending_t
                    times = [t, *times[:-1]]
                    pending, pending_t = 0, NEVER
                else:
                    pending, pending_t = polarity, t
            return polarity, flash, opened, t - times[0] <= FRESH and t - times[k - 1] < RATE

        return step

    return sorted_fold(df, keys, [order], fields, begin, df.columns, [value, time])


def greedy_gaps(df: DataFrame, keys: list[str], order: str, time: str, gap: float | str, name: str = "kept") -> DataFrame:
    """Append whether a row is kept when each kept row must lie ``gap`` (a number or a column) after the one kept before."""

    def begin():
        last = [NEVER]

        def step(t: float, least: float = gap):
            keeps = t - last[0] >= least - 1e-9
            if keeps:
                last[0] = t
            return (keeps,)

        return step

    return sorted_fold(df, keys, [order], [T.StructField(name, T.BooleanType())], begin, df.columns, [time, gap] if isinstance(gap, str) else [time])


def thinned(df: DataFrame, keys: list[str], order: str, time: str, gap: float | str, gone: str, scope: str, name: str = "thins") -> DataFrame:
    """Append whether a row is removed so that pictures lie ``gap`` apart.

    Rows that are ``gone`` neither pace nor go again; rows out of ``scope`` stay and pace the others.
    """

    def begin():
        last = [NEVER]

        def step(row: dict):
            if row[gone]:
                return (False,)
            if row[scope] and row[time] - last[0] < (row[gap] if isinstance(gap, str) else gap) - 1e-9:
                return (True,)
            last[0] = row[time]
            return (False,)

        return step

    return sorted_fold(df, keys, [order], [T.StructField(name, T.BooleanType())], begin, df.columns)


def debounced(df: DataFrame, keys: list[str], order: str, time: str, active: str, least: float = 0.25, name: str = "event") -> DataFrame:
    """Append whether a row starts an event: activity turns on, or lasts and ``least`` seconds have passed."""

    def begin():
        state = [False, NEVER]

        def step(row: dict):
            fires = bool(row[active]) and (not state[0] or row[time] - state[1] >= least)
            state[0] = bool(row[active])
            if fires:
                state[1] = row[time]
            return (fires,)

        return step

    return sorted_fold(df, keys, [order], [T.StructField(name, T.BooleanType())], begin, df.columns)


def nth_flash_age(flashes: DataFrame, keys: list[str], k: int, time: str = "tc") -> DataFrame:
    """Rows of flashes with the time since the k-th latest one: under a second, the rate is reached."""
    from pyspark.sql import Window

    return flashes.withColumn("age", F.col(time) - F.lag(time, k - 1).over(Window.partitionBy(*keys).orderBy("n")))


def pooled(transitions: DataFrame, keys: list[str], time: str = "tc", window: float = FRESH) -> DataFrame:
    """Append ``active``: the polarity of the last transition (columns n, transition) if it is at most ``window`` old, else 0."""
    from pyspark.sql import Window

    by = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("transition") != 0, F.struct(F.col(time).alias("t"), F.col("transition").alias("p"))), ignorenulls=True).over(by)
    return transitions.withColumn("__l", last).withColumn("active", F.when(F.col(time) - F.col("__l.t") <= window, F.col("__l.p")).otherwise(0)).drop("__l")
