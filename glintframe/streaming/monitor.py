"""Live series: the batch fold as a stateful stream.

Rows (key, n, tc, x) arrive in micro-batches; each key's runs and pairs are kept in the state store
between them, so the flashes found are those of one pass over the whole series.  Arrival order
within a key is by n; rows older than what a key has seen are ignored, as a live monitor skips them.
Source times that run backwards or jump are bridged by the median of the last good steps, never reordered.
"""

from __future__ import annotations

import pickle
from collections import deque
from collections.abc import Iterator
from statistics import median

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glintframe.operators.clock import LOOK_BACK
from glintframe.operators.flashes import Pairs, Runs

OUTPUT = "vid long, n long, tc double, opened double, strobing boolean"
STATE = "last_n long, fold binary"


class Clock:
    """The monotonic clock of one series, a step at a time."""

    def __init__(self, max_gap: float):
        self.max_gap, self.last, self.now, self.recent = max_gap, None, 0.0, deque(maxlen=LOOK_BACK)

    def advance(self, t: float) -> float:
        if self.last is not None:
            step = t - self.last
            if 0 < step <= self.max_gap:
                self.recent.append(step)
            else:
                step = median(self.recent) if self.recent else 1 / 30
            self.now += step
        self.last = t
        return self.now


def monitor(stream: DataFrame, noise: float = 0.02, swing: float = 0.10, dark: float = 0.80, k: int = 4, native: str | None = None, max_gap: float = 5.0, idle_ms: int | None = None) -> DataFrame:
    """One row per completed flash, with the time it opened and whether the failing rate is reached.

    ``native`` names a column of source times; the clock is then kept in the state, else ``tc`` is the time.
    A key without rows for ``idle_ms`` (processing time) leaves the state store; without it, keys stay.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, fold = state.get if state.exists else (-1, None)
        runs, pairs, clock = pickle.loads(fold) if fold else (Runs(1, noise), Pairs(1, k), Clock(max_gap))
        rows = pd.concat(list(batches)).sort_values("n")
        made = []
        for n, t, x in rows[["n", native or "tc", "x"]].itertuples(index=False):
            if n <= last:
                continue
            last = int(n)
            if native:
                t = clock.advance(t)
            value = np.array([x], float)
            if runs.base is None:
                runs.start(value, t)
                continue
            peak, trough, base, far = runs.feed(value, t)
            up = peak & (far - base >= swing) & (base < dark)
            down = trough & (base - far >= swing) & (far < dark)
            if pairs.feed(up.astype(np.int8) - down.astype(np.int8), t)[0]:
                made.append((key[0], last, float(t), float(pairs.opens[0, 0]), bool(pairs.strobing(t, k)[0])))
        state.update((last, pickle.dumps((runs, pairs, clock))))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(made, columns=["vid", "n", "tc", "opened", "strobing"])

    leaves = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return stream.groupBy("vid").applyInPandasWithState(update, OUTPUT, STATE, "append", leaves)
