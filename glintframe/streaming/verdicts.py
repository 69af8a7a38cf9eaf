"""Verdicts of a stream of frame statistics: violations so far, updated as rows arrive, and final ones by event-time sessions.

Rows (vid, n, t, tc, area, onset) are those of ``strobe_violations``; a key's rows come in order of n.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from glintframe.operators.intervals import asof, hundredths

ISLAND = "island long, start double, end double, severity double, onset double, peak double, last_tc double"
UPDATES = "vid long, frames long, last_n long, island long, start double, end double, severity double, onset double, peak double, open boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def timed(rows: DataFrame) -> DataFrame:
    """Append ``ts``, the clock time as a timestamp (whole microseconds)."""
    return rows.withColumn("ts", F.timestamp_micros(F.round(F.col("tc") * 1e6).cast("long")))


class OpenIslands(StatefulProcessor):
    """One key's state: rows seen, and the violation that may still grow.  Rows at or before the last one seen are ignored.

    A batch gives one row for each violation that it opened or changed.  The event-time timer of an open one fires
    when the watermark is past the time at which a row could still join it; then it is reported as closed.
    """

    def __init__(self, threshold: int, gap: float):
        self.threshold, self.gap = threshold, gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "frames long, last_n long, islands long")
        self.island = handle.getValueState("island", ISLAND)

    def _forget_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames, last_n, islands = self.seen.get() if self.seen.exists() else (0, -1, 0)
        now = list(self.island.get()) if self.island.exists() else None
        changed: dict[int, list] = {}
        for n, t, tc, area, onset in pd.concat(list(rows)).sort_values("n")[["n", "t", "tc", "area", "onset"]].itertuples(index=False):
            if n <= last_n:
                continue
            frames, last_n = frames + 1, int(n)
            if area < self.threshold:
                continue
            severity = round(area / self.threshold * 100) / 100
            if now is not None and tc - now[6] > self.gap:
                changed[now[0]] = [*now, False]
                now = None
            if now is None:
                now = [islands, t, t, severity, min(t, onset), t, tc]
                islands += 1
            else:
                if severity > now[3]:
                    now[3], now[5] = severity, t
                now[2], now[4], now[6] = max(now[2], t), min(now[4], t, onset), tc
            changed[now[0]] = [*now, True]
        self.seen.update((frames, last_n, islands))
        if now is not None:
            self.island.update(tuple(now))
            self._forget_timers()
            self.handle.registerTimer(int((now[6] + self.gap) * 1000) + 1)
        made = [(key[0], frames, last_n, *x[:6], x[7]) for x in changed.values()] or [(key[0], frames, last_n, *[None] * 6, None)]
        yield pd.DataFrame(made, columns=[c.split()[0] for c in UPDATES.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.island.exists():
            frames, last_n, _ = self.seen.get()
            now = self.island.get()
            self.island.clear()
            yield pd.DataFrame([(key[0], frames, last_n, *now[:6], False)], columns=[c.split()[0] for c in UPDATES.split(", ")])


def partial_verdicts(stream: DataFrame, threshold: int, gap: float = 1.0, delay: str = "0 seconds") -> DataFrame:
    """Changes of the verdict so far: rows of UPDATES, the latest of a (vid, island) counts; one without an island where none changed.

    ``delay``: how far the clocks of keys may lie apart.  The watermark is one for all keys, and rows behind it are dropped.
    Needs the RocksDB state store (``spark.sql.streaming.stateStore.providerClass`` = STORE).
    """
    rows = timed(stream).withWatermark("ts", delay).groupBy("vid")
    return rows.transformWithStateInPandas(OpenIslands(threshold, gap), UPDATES, "Update", "EventTime")


def upsert(path: str):
    """A sink for ``foreachBatch``: each batch's changes are a folder of its own, so a repeated batch replaces itself."""

    def write(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def current(spark: SparkSession, path: str) -> DataFrame:
    """The verdict so far: the latest state of every violation in the sink."""
    rows = spark.read.parquet(path).where("island is not null")
    latest = F.row_number().over(Window.partitionBy("vid", "island").orderBy(F.desc("batch"), F.asc("open")))
    return rows.withColumn("__k", latest).where("__k = 1").select("vid", "island", "start", "end", "severity", "onset", "peak", "open")


def sessions(rows: DataFrame, threshold: int, gap: str = "1 second", delay: str | None = None) -> DataFrame:
    """The violations as event-time sessions: rows of one key that follow within ``gap``, both ends included.

    Streams need ``delay``, the watermark: a session is emitted once, when no row can join it any more.  The
    same plan over a table gives all of them.  Timestamps are whole microseconds, so sessions are cut again wherever the
    clock itself says that the gap is longer; for that a session keeps its rows.
    """
    rows = timed(rows)
    if delay is not None:
        rows = rows.withWatermark("ts", delay)
    # the condition names ts, so it stays behind the watermark, which quiet rows then move too
    hot = rows.where(F.when(F.col("ts").isNotNull(), F.col("area")) >= threshold).withColumn("severity", hundredths(F.col("area"), threshold))
    # a microsecond more, as timestamps are rounded: no row that belongs to a session stays out
    row = F.struct("n", "tc", "t", "severity", "onset")
    found = hot.groupBy("vid", F.session_window("ts", f"{gap} 1 microsecond")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    seconds = F.expr(f"unix_micros(timestamp_micros(0) + INTERVAL {gap}) / 1e6D")
    at = lambda i: F.element_at("rows", i.cast("int"))["tc"]
    cuts = F.filter(F.sequence(F.lit(1), F.size("rows")), lambda i: (i == 1) | (at(i) - at(F.greatest(i - 1, F.lit(1))) > seconds))
    found = found.withColumn("cuts", F.concat(cuts, F.array(F.size("rows") + 1)))
    parts = F.transform(F.slice("cuts", F.lit(1), F.size("cuts") - 1), lambda a, k: F.slice("rows", a, F.element_at("cuts", k + 2) - a))
    found = found.select("vid", F.explode(parts).alias("part"))
    each = lambda f: F.transform("part", f)
    return found.select(
        "vid",
        F.col("part")[0]["t"].alias("start"),
        F.array_max(each(lambda r: r["t"])).alias("end"),
        F.array_max(each(lambda r: r["severity"])).alias("severity"),
        F.array_min(each(lambda r: F.least(r["t"], r["onset"]))).alias("onset"),
        F.array_min(each(lambda r: F.struct((-r["severity"]).alias("s"), r["n"].alias("n"), r["t"].alias("t"))))["t"].alias("peak"),
    )


def beside_trace(trace: DataFrame, keys: list[str], values: list[str], path: str):
    """A sink for ``foreachBatch``: live rows (keys, tc) with ``stored``, the trace's values at or before their time.

    The trace (keys, tc, values) is a table, so a batch needs no state: each is an as-of join over its rows and the trace of
    their keys, and the batches together are the join of the whole stream.
    """
    write = upsert(path)

    def join(live: DataFrame, batch: int) -> None:
        mine = trace.join(live.select(*keys).distinct(), keys, "left_semi")
        write(asof(live, F.col("tc"), mine, "tc", F.struct(*values), keys, "stored"), batch)

    return join
