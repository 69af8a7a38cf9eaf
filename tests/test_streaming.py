"""The stream finds the flashes of the batch fold, whatever the micro-batches."""

from __future__ import annotations

import math
import time

from glintframe.operators.clock import monotonic_clock
from glintframe.operators.flashes import series_flashes
from glintframe.streaming.monitor import monitor


def test_stream_equals_batch(spark, tmp_path):
    rows = [(v, n, n / 30, 0.5 + 0.4 * math.sin(2 * math.pi * (2 + v) * n / 30)) for v in (1, 2) for n in range(120)]
    whole = spark.createDataFrame(rows, "vid long, n long, tc double, x double")
    want = {(r.vid, r.n, round(r.opened, 9), r.strobing) for r in series_flashes(whole, ["vid"]).where("flash").collect()}
    source = str(tmp_path / "in")
    for k in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 40 == k], whole.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = monitor(stream).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r.vid, r.n, round(r.opened, 9), r.strobing) for r in spark.table("seen").collect()}
    assert got == want and want


def test_jumping_times_are_bridged(spark, tmp_path):
    times = [n / 30 + (100 if 40 <= n < 80 else -3 if n >= 80 else 0) for n in range(120)]
    rows = [(1, n, t, 0.5 + 0.4 * math.sin(2 * math.pi * 5 * n / 30)) for n, t in enumerate(times)]
    whole = spark.createDataFrame(rows, "vid long, n long, t double, x double")
    batch = series_flashes(monotonic_clock(whole, ["vid"]), ["vid"])
    want = {(r.n, round(r.tc, 9), round(r.opened, 9), r.strobing) for r in batch.where("flash").collect()}
    source = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], whole.schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = monitor(stream, native="t").writeStream.format("memory").queryName("bridged").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    assert {(r.n, round(r.tc, 9), round(r.opened, 9), r.strobing) for r in spark.table("bridged").collect()} == want and want


def test_idle_keys_leave_the_store(spark, tmp_path):
    rows = [(v, n, n / 30, 0.5 + 0.4 * math.sin(n)) for v in (1, 2) for n in range(30)]
    whole = spark.createDataFrame(rows, "vid long, n long, tc double, x double")
    source = str(tmp_path / "in")
    whole.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(whole.schema).parquet(source)
    query = monitor(stream, idle_ms=200).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    kept, until = [], time.time() + 60
    while time.time() < until and not (kept and max(kept) == 2 and kept[-1] == 0):
        time.sleep(0.2)
        kept = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    query.stop()
    assert max(kept) == 2 and kept[-1] == 0
