"""Pairs of one frame count, dealt to many tasks."""

from __future__ import annotations

from pyspark.sql import functions as F

from glintframe.operators import projects


def test_pairs_of_one_frame_count_meet_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(projects, "PAIRS", 500)
    a = [(i, 25 * (i % 40 == 0) or 50, 1.0 + i % 3 / 100) for i in range(300)] + [(900, 7, 1.0)]
    b = [(i, 50, 1.0 + i % 2 / 50) for i in range(60)] + [(70, 25, 1.0), (71, 8, 1.0)]
    schema = "id long, frames long, seconds double"
    made = projects.same_video(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    rows = made.withColumn("task", F.spark_partition_id()).collect()
    want = sorted((i, j) for i, n, s in a for j, m, t in b if n == m and abs(s - t) <= s / max(1, n))
    assert sorted((r.id, r.video_id) for r in rows) == want
    tasks = {}
    for r in rows:
        tasks[r.task] = tasks.get(r.task, 0) + 1
    assert len(tasks) > 10 and max(tasks.values()) < len(want) / 4
