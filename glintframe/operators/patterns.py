"""Striped patterns within a picture, and pixel-level filters of picture rows."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glintframe.config import Config
from glintframe.functions import colour

# Cosine and sine of eight directions, 22.5 degrees apart, in 16.16 fixed point.
DIRECTIONS = [(65536, 0), (60547, 25080), (46341, 46341), (25080, 60547), (0, 65536), (-25080, 60547), (-46341, 46341), (-60547, 25080)]
OUTSIDE = -1


@functools.cache
def line_pixels(width: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """Pixel index at (step, line) of the parallel lines of all directions, and of its neighbour across the line."""
    reach = math.ceil(math.hypot(width, height) / 2) + 1
    at = np.arange(-reach, reach + 1)
    own, beside = [], []
    for dx, dy in DIRECTIONS:
        for rows, offset in ((own, 0), (beside, 1)):
            x = (width * 32768 - (at + offset)[None, :] * dy + at[:, None] * dx + 32768) >> 16
            y = (height * 32768 + (at + offset)[None, :] * dx + at[:, None] * dy + 32768) >> 16
            inside = (x >= 0) & (x < width) & (y >= 0) & (y < height)
            rows.append(np.where(inside, y * width + x, OUTSIDE))
    return np.hstack(own), np.hstack(beside)


def stripes(light: np.ndarray, cfg: Config) -> tuple[int, int, int]:
    """(pixels crossed by a regular stretch of stripes, sum of spacings, their number) of a luminance plane.

    All lines of all directions are walked side by side, a step at a time; runs that end are noted.
    What makes a stretch is then worked out over the notes of all lines at once.
    """
    height, width = light.shape
    own, beside = line_pixels(width, height)
    flat = light.ravel().astype(np.float32)
    inside = own >= 0
    value = np.where(inside, flat[own], np.float32(0))
    alike = inside & (beside >= 0) & (np.abs(value - flat[beside]) <= np.float32(cfg.pattern_swing * 0.5))
    swing, dark, noise = np.float32(cfg.pattern_swing), np.float32(cfg.dark), np.float32(cfg.noise)
    lines = own.shape[1]
    index = np.arange(lines)
    direction = np.zeros(lines, np.int8)
    base, far = np.zeros(lines, np.float32), np.zeros(lines, np.float32)
    far_at = np.zeros(lines, np.int64)
    piece = np.zeros(lines, np.int64)  # a line enters the picture anew
    live = np.zeros(lines, bool)
    noted: list[tuple] = []  # (lines, piece, where the run ended, qualifies); 2: a piece begins
    for t in range(len(own)):
        x, here = value[t], inside[t]
        begins = here & ~live
        goes = here & live
        up, down = goes & (direction == 1), goes & (direction == -1)
        longer = (up & (x >= far)) | (down & (x <= far))
        ended = (up & ~longer & (x < far - noise)) | (down & ~longer & (x > far + noise))
        if ended.any():
            e = index[ended]
            low, high = np.minimum(base[e], far[e]), np.maximum(base[e], far[e])
            noted.append((e, piece[e], far_at[e], (high - low >= swing) & (low < dark) & alike[far_at[e], e]))
        still = goes & (direction == 0)
        rises, falls = still & (x > base + noise), still & (x < base - noise)
        if begins.any():
            b = index[begins]
            piece[b] += 1
            noted.append((b, piece[b], np.full(len(b), t), np.full(len(b), 2)))
        base = np.where(begins, x, np.where(ended, far, base))
        moved = begins | longer | ended | rises | falls
        far, far_at = np.where(moved, x, far), np.where(moved, t, far_at)
        direction = np.where(begins, 0, np.where((up & ended) | falls, -1, np.where((down & ended) | rises, 1, direction))).astype(np.int8)
        live = here
    if not noted:
        return 0, 0, 0
    line, part, where, kind = (np.concatenate([np.asarray(n[i], np.int64) for n in noted]) for i in range(4))
    order = np.lexsort((np.arange(len(line)), line))
    line, part, where, kind = line[order], part[order], where[order], kind[order]
    need = 2 * max(1, min(cfg.pattern_pairs, 7)) + 1
    # Consecutive qualifying runs up to each note: since the last note that isn't one.
    last_bad = np.maximum.accumulate(np.where(kind != 1, np.arange(len(kind)), -1))
    enough = (kind == 1) & (np.arange(len(kind)) - last_bad >= need)
    at = np.flatnonzero(enough)
    if not len(at):
        return 0, 0, 0
    gaps = np.stack([where[at - k] - where[at - k - 1] for k in range(need)])
    regular = gaps.max(axis=0) * 2 <= gaps.min(axis=0) * max(2, math.floor(cfg.pattern_regularity * 2 + 0.5))
    at = at[regular]
    ok = np.zeros(len(kind), bool)
    ok[at] = True
    follows = ok[at - 1]
    first = where[at - need]
    spacing = np.where(follows, where[at] - where[at - 1], where[at] - first).sum()
    number = np.where(follows, 1, need).sum()
    edges = np.zeros((len(own) + 1, lines), np.int32)
    np.add.at(edges, (first, line[at]), 1)
    np.add.at(edges, (where[at] + 1, line[at]), -1)
    crossed = (np.cumsum(edges[:-1], axis=0) > 0) & inside
    return len(np.unique(own[crossed])), int(spacing), int(number)


def pattern_stats(frames: DataFrame, cfg: Config) -> DataFrame:
    """video, n, pattern (pixels), period (mean half-period in pixels): each picture by itself, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                rgb = np.frombuffer(row["rgb"], np.uint8).reshape(row["h"], row["w"], 3)
                count, spacing, number = stripes(colour.planes(rgb, cfg.red_saturation, cfg.red_flare)[0], cfg)
                made.append((count, spacing / number if number else 0.0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.float64())], names=["video", "n", "pattern", "period"])

    return frames.select("video", "n", "w", "h", "rgb").mapInArrow(run, "video string, n long, pattern int, period double")


def blurred(picture: np.ndarray, radius: int, passes: int = 3) -> np.ndarray:
    """Codes (height, width, channels) blurred by boxes of 2 ``radius`` + 1, along the rows and down the columns, ``passes`` times.

    Edges repeat; every mean is rounded half up.
    """
    out = picture
    size = 2 * radius + 1
    for _ in range(passes if radius > 0 else 0):
        for axis in (1, 0):
            ends = [(0, 0)] * out.ndim
            ends[axis] = (radius + 1, radius)
            sums = np.pad(out.astype(np.int64), ends, mode="edge").cumsum(axis=axis)
            n = out.shape[axis]
            total = np.take(sums, np.arange(size, size + n), axis=axis) - np.take(sums, np.arange(n), axis=axis)
            out = ((total + size // 2) // size).astype(picture.dtype)
    return out


def softened(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """Frames (video, n, t, w, h, rgb) with those of the plan (video, n, radius) blurred: a table of pictures like any other."""
    rows = frames.select("video", "n", "t", "w", "h", "rgb").join(plan.select("video", "n", F.col("radius").cast("int").alias("radius")), ["video", "n"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h, rgb, radius = (batch.column(c).to_pylist() for c in ("w", "h", "rgb", "radius"))
            made = [p if not r else blurred(np.frombuffer(p, np.uint8).reshape(y, x, 3), r).tobytes() for x, y, p, r in zip(w, h, rgb, radius, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(made, pa.binary())], names=["video", "n", "t", "w", "h", "rgb"])

    return rows.mapInArrow(run, "video string, n long, t double, w int, h int, rgb binary")


def box_blur(rows: DataFrame, keys: list[str], at: str, value: str, reach: int) -> DataFrame:
    """One pass of a box blur along ``at`` (0, 1, ...): edges repeat, sums are rounded half up."""
    by = Window.partitionBy(*keys).orderBy(at)
    around = by.rowsBetween(-reach, reach)
    width = 2 * reach + 1
    first, last = (f(value).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for f in (F.first, F.last))
    n = F.count(F.lit(1)).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = F.greatest(F.lit(0), F.lit(reach) - F.col(at))
    right = F.greatest(F.lit(0), F.col(at) + reach - (n - 1))
    total = F.sum(value).over(around) + left * first + right * last
    return rows.withColumn("blurred", F.floor((total + width // 2) / width).cast("long"))


def mixed(frames: DataFrame, plan: DataFrame, keys: list[str], at: str, value: str, strength: float) -> DataFrame:
    """Pixels of marked frames mixed with those before and after (plan: ord, prev, next, u), rounded half up, at most 255."""
    from glintframe.operators.edits import blend_weights

    pixel = frames.select(*keys, F.col("ord").alias("__o"), at, F.col(value).alias("__v"))
    take = lambda o, name: pixel.select(*keys, F.col("__o").alias(o), at, F.col("__v").alias(name))
    rows = frames.join(plan, [*keys, "ord"]).join(take("prev", "__a"), [*keys, "prev", at], "left").join(take("next", "__b"), [*keys, "next", at], "left")
    own, before, after = blend_weights(F.col("u"), strength)
    total = own * F.col(value) + F.coalesce(before * F.col("__a"), F.lit(0.0)) + F.coalesce(after * F.col("__b"), F.lit(0.0))
    return rows.withColumn("mixed", F.least(F.lit(255), F.floor(total + 0.5)).cast("long")).select(*keys, "ord", at, "mixed")
