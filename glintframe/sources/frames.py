"""Pictures from files: a Spark data source over arrays of frames.

``spark.dataSource.register(FrameFiles)``, then ``spark.read.format("frame_files").load(folder)`` gives
frames(video, n, t, w, h, rgb).  A video is ``<video>.npy``, bytes of shape (frames, height, width, 3), and its times
``<video>.times.npy`` in seconds; a time that is missing (not a number, or past the file's end) is the one before and the last
positive step (1/30 before there is any).  The folder must be mounted alike on the driver and all executors.

A partition is a range of one video's frames (option ``frames``: how many), and is read as a memory map, so a
task touches the bytes of its own frames only.  With option ``pushdown`` conditions on video and time choose videos and ranges
before a task is made (Spark demands ``spark.sql.python.filterPushdown.enabled`` for it); Spark applies them again to the rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "video string, n long, t double, w int, h int, rgb binary"
STEP = 1 / 30
BATCH = 64
TIMES = ".times.npy"


def filled(times: np.ndarray, frames: int) -> np.ndarray:
    """``frames`` times, the missing ones extrapolated."""
    out, last, step = np.empty(frames), 0.0, STEP
    for i in range(frames):
        known = i < len(times) and not math.isnan(times[i])
        if known and i and times[i] > last:
            step = float(times[i]) - last
        last = float(times[i]) if known else last + step if i else 0.0
        out[i] = last
    return out


@dataclass
class FrameRange(InputPartition):
    path: str
    video: str
    first: int
    times: list[float]


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"].removeprefix("file://")
        self.frames = int(options.get("frames", 500))
        self.videos: set[str] | None = None
        self.low, self.high = -math.inf, math.inf

    def partitions(self) -> list[FrameRange]:
        out = []
        for file in sorted(Path(self.folder).glob("*.npy")):
            video = file.name.removesuffix(".npy")
            if file.name.endswith(TIMES) or (self.videos is not None and video not in self.videos):
                continue
            frames = np.load(file, mmap_mode="r").shape[0]
            stated = file.with_name(video + TIMES)
            times = filled(np.load(stated) if stated.exists() else np.empty(0), frames)
            wanted = np.flatnonzero((times >= self.low) & (times <= self.high))
            for first in range(0, frames, self.frames):
                inside = wanted[(wanted >= first) & (wanted < first + self.frames)]
                if len(inside):
                    a, b = int(inside[0]), int(inside[-1]) + 1
                    out.append(FrameRange(str(file), video, a, times[a:b].tolist()))
        return out or [FrameRange("", "", 0, [])]

    def read(self, partition: FrameRange) -> Iterator[pa.RecordBatch]:
        if not partition.times:
            return
        pictures = np.load(partition.path, mmap_mode="r")
        h, w = pictures.shape[1:3]
        for at in range(0, len(partition.times), BATCH):
            times = partition.times[at : at + BATCH]
            first, k = partition.first + at, len(times)
            rgb = [np.ascontiguousarray(pictures[i]).tobytes() for i in range(first, first + k)]
            columns = [pa.array([partition.video] * k), pa.array(range(first, first + k), pa.int64()), pa.array(times), pa.array([w] * k, pa.int32()), pa.array([h] * k, pa.int32()), pa.array(rgb, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["video", "n", "t", "w", "h", "rgb"])


class SelectiveReader(FrameReader):
    """Takes conditions on video and time into account."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = ".".join(f.attribute) if hasattr(f, "attribute") else ""
            if name == "video" and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.videos = wanted if self.videos is None else self.videos & wanted
            elif name == "t" and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                self.low = max(self.low, f.value)
            if name == "t" and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                self.high = min(self.high, f.value)
            yield f  # ranges are coarser than the condition


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return (SelectiveReader if self.options.get("pushdown") == "true" else FrameReader)(self.options)
