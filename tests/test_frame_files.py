"""Pictures from files: rows, missing times, ranges and conditions."""

from __future__ import annotations

import math

import numpy as np
import pytest

from glintframe.sources.frames import FrameFiles, FrameReader, filled


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("frames")
    rng = np.random.default_rng(1)
    np.save(path / "a.npy", rng.integers(0, 256, (130, 6, 8, 3), dtype=np.uint8))
    np.save(path / "a.times.npy", np.array([n / 10 for n in range(100)]))
    np.save(path / "b.npy", rng.integers(0, 256, (5, 4, 4, 3), dtype=np.uint8))
    np.save(path / "none.npy", np.zeros((0, 4, 4, 3), np.uint8))
    return path


def test_missing_times():
    nan = math.nan
    assert filled(np.array([5.0, 5.5, nan, nan, 7.0, 6.0, nan]), 9) == pytest.approx([5.0, 5.5, 6.0, 6.5, 7.0, 6.0, 6.5, 7.0, 7.5])
    assert filled(np.empty(0), 3) == pytest.approx([0, 1 / 30, 2 / 30]) and len(filled(np.array([1.0]), 0)) == 0


def test_rows(spark, folder):
    spark.dataSource.register(FrameFiles)
    frames = spark.read.format("frame_files").option("frames", 50).load(str(folder))
    rows = sorted(frames.collect())
    assert [(r.video, r.n) for r in rows] == [("a", n) for n in range(130)] + [("b", n) for n in range(5)]
    a, b = np.load(folder / "a.npy"), np.load(folder / "b.npy")
    for r in rows:
        assert (r.w, r.h) == ((8, 6) if r.video == "a" else (4, 4)) and bytes(r.rgb) == (a if r.video == "a" else b)[r.n].tobytes()
    assert [r.t for r in rows if r.video == "a"] == pytest.approx([n / 10 for n in range(130)])
    assert frames.rdd.getNumPartitions() == 4


def test_conditions_choose_ranges(spark, folder):
    spark.dataSource.register(FrameFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frames = spark.read.format("frame_files").option("frames", 50).option("pushdown", "true").load(str(folder))
        some = frames.where("video = 'a' AND t >= 4.95 AND t < 5.25").select("n")
        assert sorted(r.n for r in some.collect()) == [50, 51, 52] and some.rdd.getNumPartitions() == 1
        assert frames.where("video IN ('b', 'z') AND n > 2").count() == 2
        assert frames.where("video = 'z'").count() == 0
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_range_reads_its_own_frames(folder):
    reader = FrameReader({"path": f"file://{folder}", "frames": "40"})
    parts = reader.partitions()
    assert [(p.video, p.first, len(p.times)) for p in parts] == [("a", 0, 40), ("a", 40, 40), ("a", 80, 40), ("a", 120, 10), ("b", 0, 5)]
    assert [b.num_rows for b in FrameReader({"path": str(folder)}).read(FrameReader({"path": str(folder)}).partitions()[0])] == [64, 64, 2]
