"""Verdicts of a stream: after every micro-batch those of the rows so far; sessions are the islands."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from glintframe.operators.intervals import asof, strobe_violations
from glintframe.streaming import verdicts

SCHEMA = "vid long, n long, t double, tc double, area int, onset double"
THRESHOLD = 100


def some_rows() -> list[tuple]:
    rng = random.Random(2)
    out = []
    for v in range(4):
        tc = 0.0
        for n in range(150):
            tc += rng.choice([1 / 32, 1 / 32, 0.25, 1.0, 1.0625])
            t = tc + (50 if n > 70 else 0) - (90 if n > 110 else 0)
            out.append((v, n, t, tc, rng.choice([0, 40, 100, 137, 250]) if v != 3 else 0, t - rng.random()))
    return out


def close(rows):
    return sorted((r.vid, *(round(x, 6) for x in (r.start, r.end, r.severity, r.onset, r.peak))) for r in rows)


@pytest.fixture(scope="module")
def stored_state(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", verdicts.STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_every_batch_gives_the_verdict_so_far(spark, tmp_path, stored_state):
    rows = some_rows()
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [0, 37, 38, 90, 150]
    empty = spark.createDataFrame([], SCHEMA)
    empty.write.parquet(source)
    stream = verdicts.partial_verdicts(spark.readStream.schema(empty.schema).parquet(source), THRESHOLD, delay="300 seconds")
    query = stream.writeStream.foreachBatch(verdicts.upsert(sink)).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).start()
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        again = [r for r in rows if a - 5 <= r[1] < b]  # some rows come twice
        spark.createDataFrame(again, empty.schema).coalesce(1).write.mode("append").parquet(source)
        query.processAllAvailable()
        so_far = spark.createDataFrame([r for r in rows if r[1] < b], empty.schema)
        want = strobe_violations(so_far, ["vid"], THRESHOLD).collect()
        got = verdicts.current(spark, sink).collect()
        assert close(got) == close(want) and want, k
    assert {r.vid for r in got} == {0, 1, 2}
    assert {(r.vid, r.island) for r in got if r.open} <= {(v, max(x.island for x in got if x.vid == v)) for v in range(3)}
    assert any(r.open for r in got)
    # a row far ahead moves the watermark: the timers close what can't grow any more
    spark.createDataFrame([(9, 0, 1e5, 1e5, 0, 1e5)], empty.schema).coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    final = verdicts.current(spark, sink).collect()
    assert not any(r.open for r in final) and close(final) == close(got)


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(1, 5, 4, 0, 1.0, 2.0, 1.5, 0.5, 1.0, True)], verdicts.UPDATES)
    later = spark.createDataFrame([(1, 9, 8, 0, 1.0, 3.0, 1.5, 0.5, 1.0, False), (2, 9, 8, None, None, None, None, None, None, None)], verdicts.UPDATES)
    for frame, batch in ((rows, 0), (later, 1), (later, 1)):
        verdicts.upsert(path)(frame, batch)
    assert [(r.vid, r.end, r.open) for r in verdicts.current(spark, path).collect()] == [(1, 3.0, False)]


def test_sessions_are_the_islands(spark, tmp_path):
    rows = spark.createDataFrame(some_rows(), SCHEMA)
    want = close(strobe_violations(rows, ["vid"], THRESHOLD).collect())
    assert close(verdicts.sessions(rows, THRESHOLD).collect()) == want
    # as a stream: a last row far ahead moves the watermark past all sessions
    source = str(tmp_path / "in")
    end = spark.createDataFrame([(9, 0, 1e5, 1e5, 0, 1e5)], SCHEMA)
    for k in range(3):
        rows.where(f"n div 50 = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = verdicts.sessions(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source), THRESHOLD, delay="100 seconds")
    query = stream.writeStream.format("memory").queryName("sessions").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    end.coalesce(1).write.mode("append").parquet(source)
    query.processAllAvailable()
    query.stop()
    got = close(spark.table("sessions").collect())
    assert got == want and not math.isnan(sum(x[1] for x in got))


def test_a_gap_longer_by_less_than_a_microsecond_ends_a_session(spark):
    """Timestamps are rounded, the clock decides: 0.2 s and a tenth of a microsecond is a gap, 0.2 s less that is none."""
    at = [0.0, 0.2000001, 0.4, 1.0, 1.2]
    rows = spark.createDataFrame([(1, n, t, t, 400 - n, t - 0.01) for n, t in enumerate(at)], SCHEMA)
    got = verdicts.sessions(rows, THRESHOLD, gap="200 milliseconds").collect()
    assert close(got) == close(strobe_violations(rows, ["vid"], THRESHOLD, gap=0.2).collect()) and len(got) == 3


def test_live_rows_beside_a_stored_trace(spark, tmp_path):
    live = spark.createDataFrame(some_rows(), SCHEMA)
    trace = live.where("n % 3 = 0 AND vid <> 2").select("vid", (F.col("tc") + 0.01).alias("tc"), F.col("area").alias("old_area"), F.col("onset").alias("old_onset")).cache()
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        live.where(f"n div 50 = {k}").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(live.schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.writeStream.foreachBatch(verdicts.beside_trace(trace, ["vid"], ["old_area", "old_onset"], sink)).option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = sorted(map(repr, spark.read.parquet(sink).select("vid", "n", "stored").collect()))
    want = asof(live, F.col("tc"), trace, "tc", F.struct("old_area", "old_onset"), ["vid"], "stored").select("vid", "n", "stored")
    assert got == sorted(map(repr, want.collect())) and len(got) == live.count()
