"""Synthetic pictures: deterministic scenes as frames(video, n, t, w, h, rgb), made inside the tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

W, H = 128, 96
RATE = 30000 / 1001

#: name -> (flashes a second, first and second colour, seconds, share of the picture or corner box, seconds of flashing)
SCENES = {
    "square3hz": (3, 20, 200, 10, 0.5, None),
    "square4hz": (4, 20, 200, 6, 0.5, None),
    "burst3hz": (3, 20, 200, 6, 0.5, 2),
    "soft3hz": (3, 149, 168, 6, 0.5, None),
    "partial15": (4, 20, 200, 6, (33, 25), None),
    "partial35": (4, 20, 200, 6, (50, 38), None),
    "red_grey": (4, (255, 0, 0), (144, 144, 144), 5, 1.0, None),
    "red_darkred": (4, (255, 0, 0), (110, 0, 0), 5, 1.0, None),
    "red_green": (4, (200, 0, 0), (0, 116, 0), 5, 1.0, None),
    "red_equilum": (5, (250, 0, 0), (122, 124, 122), 5, 1.0, None),
}
BACKGROUND = 20


def picture(name: str, t: float) -> np.ndarray:
    hz, low, high, _, share, lasts = SCENES[name]
    out = np.empty((H, W, 3), np.uint8)
    out[...] = BACKGROUND
    second = math.floor(t * hz * 2) % 2 == 1 and (lasts is None or t < lasts)
    if isinstance(share, tuple):
        box = (slice(0, share[1]), slice(0, share[0]))
    else:
        w, h = int(W * share**0.5), int(H * share**0.5)
        x, y = (W - w) // 2, (H - h) // 2
        box = (slice(y, y + h), slice(x, x + w))
    out[box] = high if second else low
    return out


def frames(spark: SparkSession, names: list[str]) -> DataFrame:
    """All frames of the named scenes."""
    counts = [(n, round(SCENES[n][3] * RATE)) for n in names]
    rows = spark.createDataFrame(counts, "video string, frames long").selectExpr("video", "explode(sequence(0L, frames - 1)) AS n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            videos, n = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            t = [i * 1001 / 30000 for i in n]
            rgb = [picture(v, x).tobytes() for v, x in zip(videos, t, strict=True)]
            k = len(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t, pa.float64()), pa.array([W] * k, pa.int32()), pa.array([H] * k, pa.int32()), pa.array(rgb, pa.binary())], names=["video", "n", "t", "w", "h", "rgb"])

    return rows.mapInArrow(run, "video string, n long, t double, w int, h int, rgb binary")
