"""Stripes: what counts as a pattern, and what doesn't."""

from __future__ import annotations

import math

import numpy as np
import pytest

from glintframe.config import PROFILES
from glintframe.operators.patterns import blurred, pattern_stats, softened, stripes
from glintframe.plans import detector

CONFIG = PROFILES["wcag_ext"]
W, H = 256, 144


def picture(period: float, degrees: float = 0.0, share: float = 1.0, low: float = 0.05, high: float = 0.6) -> np.ndarray:
    y, x = np.mgrid[:H, :W]
    along = x * math.cos(math.radians(degrees)) + y * math.sin(math.radians(degrees))
    out = np.where((along / period) % 1.0 < 0.5, low, high)
    return np.where(x < W * share, out, 0.3).astype(np.float32)


def share(light: np.ndarray) -> float:
    return stripes(light, CONFIG)[0] / light.size


@pytest.mark.parametrize("degrees", [0, 15, 30, 45, 60, 90, 120, 160])
def test_fine_stripes_in_any_direction(degrees):
    assert share(picture(6, degrees)) > 0.9


def test_more_than_five_pairs():
    assert share(picture(W / 12)) > 0.9
    assert share(picture(W / 5)) == 0


def test_contrast_area_and_noise():
    assert share(picture(6, low=0.30, high=0.36)) == 0
    assert share(picture(6, low=0.85, high=1.0)) == 0
    assert 0.35 < share(picture(6, 90, 0.4)) < 0.45
    assert share(np.random.default_rng(7).random((H, W)).astype(np.float32) * 0.7) < 0.05
    _, spacing, number = stripes(picture(8), CONFIG)
    assert 3.8 < spacing / number < 6.0


def test_pattern_violation(spark):
    striped = np.repeat(np.where(picture(6)[..., None] > 0.3, 200, 60).astype(np.uint8), 3, axis=2)
    plain = np.full((H, W, 3), 90, np.uint8)
    rows = [("clip", n, n / 10, W, H, (striped if 5 <= n < 15 else plain).tobytes()) for n in range(20)]
    frames = spark.createDataFrame(rows, "video string, n long, t double, w int, h int, rgb binary")
    found = detector.verdict(detector.frame_stats(frames, CONFIG), CONFIG, W, H, pattern_stats(frames, CONFIG)).collect()
    assert [(r.kind, round(r.start, 3), round(r.end, 3)) for r in found] == [("pattern", 0.5, 1.4)]


@pytest.mark.parametrize("radius", [0, 1, 2, 5])
def test_blur_by_definition(radius):
    picture = np.random.default_rng(4).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    want = picture.astype(int)
    for _ in range(3 if radius else 0):
        for axis in (1, 0):
            n = want.shape[axis]
            around = [np.take(want, np.clip(np.arange(n) + k, 0, n - 1), axis=axis) for k in range(-radius, radius + 1)]
            want = np.floor(sum(around) / (2 * radius + 1) + 0.5).astype(int)
    assert (blurred(picture, radius) == want).all() and blurred(picture, radius).dtype == np.uint8
    assert (blurred(np.full((4, 9, 3), 77, np.uint8), radius) == 77).all()


def test_softened_stripes_pass(spark):
    striped = np.repeat(np.where(picture(6)[..., None] > 0.3, 200, 60).astype(np.uint8), 3, axis=2)
    rows = [("clip", n, n / 10, W, H, striped.tobytes()) for n in range(8)]
    frames = spark.createDataFrame(rows, "video string, n long, t double, w int, h int, rgb binary")
    plan = spark.createDataFrame([("clip", n, 4) for n in range(1, 8)] + [("clip", 0, 0), ("other", 3, 9)], "video string, n long, radius long")
    soft = softened(frames, plan).cache()
    assert soft.columns == frames.columns and {r.n: r.pattern > 0 for r in pattern_stats(soft, CONFIG).collect()} == {n: n == 0 for n in range(8)}
    found = [detector.verdict(detector.frame_stats(f, CONFIG), CONFIG, W, H, pattern_stats(f, CONFIG)).where("kind = 'pattern'").count() for f in (frames, soft)]
    assert found == [1, 0]
