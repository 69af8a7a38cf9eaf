"""Generated scenes give the published verdicts, however the pictures are cut into bands."""

from __future__ import annotations

import pytest

from glintframe.config import PROFILES, profile_name, with_settings
from glintframe.operators.patterns import pattern_stats
from glintframe.plans import detector
import scenes

# Fixed values: (profile, scene) -> held pictures, (what, kind, level, start, end, severity, onset, peak).
EXPECTED = {
    ("wcag", "square4hz"): (132, [("violation", "flash", None, 1.1345, 5.9059, 4.0, 0.1419, 1.1345)]),
    ("wcag", "square3hz"): (240, [("warning", "flash", "limit", 1.1678, 9.8432, 4.0, 1.1678, 1.1678)]),
    ("wcag", "red_grey"): (110, [("violation", "red", None, 1.1345, 4.9049, 4.0, 0.1419, 1.1345)]),
    ("wcag", "red_green"): (110, [("violation", "red", None, 1.1345, 4.9049, 4.0, 0.1419, 1.1345)]),
    ("wcag", "red_darkred"): (110, [("violation", "flash", None, 1.1345, 4.9049, 4.0, 0.1419, 1.1345)]),
    ("wcag", "red_equilum"): (100, [("violation", "red", None, 0.9009, 4.9049, 4.0, 0.0752, 0.9009)]),
    ("wcag", "partial15"): (132, []),
    ("wcag", "partial35"): (132, [("violation", "flash", None, 1.1345, 5.9059, 1.4, 0.1419, 1.1345)]),
    ("wcag", "burst3hz"): (167, [("warning", "flash", "limit", 1.1678, 1.8352, 4.0, 1.1678, 1.1678)]),
    ("wcag_ext", "square3hz"): (240, [("violation", "extended", None, 1.1678, 9.8432, 1.0, 1.1678, 1.1678)]),
    ("wcag_ext", "soft3hz"): (144, [("warning", "flash", "strict", 1.1678, 5.8392, 5.0, 1.1678, 1.1678)]),
    ("wcag_ext", "burst3hz"): (167, [("warning", "flash", "limit", 1.1678, 1.8352, 4.0, 1.1678, 1.1678)]),
    ("strict", "square3hz"): (240, [("violation", "flash", None, 1.1678, 9.8432, 5.0, 0.2087, 1.1678)]),
    ("strict", "soft3hz"): (144, [("violation", "flash", None, 1.1678, 5.8392, 5.0, 0.2087, 1.1678)]),
    ("strict", "burst3hz"): (167, [("violation", "flash", None, 1.1678, 1.8352, 5.0, 0.2087, 1.1678)]),
}


@pytest.mark.parametrize("profile", ["wcag", "wcag_ext", "strict"])
def test_verdicts(spark, profile):
    names = sorted(s for p, s in EXPECTED if p == profile)
    config = PROFILES[profile]
    stats = detector.frame_stats(scenes.frames(spark, names), config).cache()
    held = {r[0]: r[1] for r in stats.where("held").groupBy("video").count().collect()}
    patterns = pattern_stats(scenes.frames(spark, names), config) if config.patterns else None
    rows = detector.verdict(stats, config, scenes.W, scenes.H, patterns).orderBy("video", "start").collect()
    for name in names:
        n, want = EXPECTED[profile, name]
        assert held[name] == n
        got = [(r.what, r.kind, r.level, *(round(x, 4) for x in (r.start, r.end, r.severity, r.onset, r.peak))) for r in rows if r.video == name]
        assert [g[:3] for g in got] == [w[:3] for w in want]
        for g, w in zip(got, want, strict=True):
            assert g[3:] == pytest.approx(w[3:], abs=2e-4)
    stats.unpersist()


def test_bands_do_not_matter(spark, monkeypatch):
    config = PROFILES["wcag"]
    one = detector.frame_stats(scenes.frames(spark, ["partial35"]), config).orderBy("n").collect()
    monkeypatch.setattr(detector, "BAND", 17)
    two = detector.frame_stats(scenes.frames(spark, ["partial35"]), config).orderBy("n").collect()
    assert one == two


def test_settings():
    assert [PROFILES[p].safe_rate for p in ("wcag_ext", "wcag", "strict")] == [3.80, 5.71, 3.80]
    assert [PROFILES[p].context_seconds for p in ("wcag_ext", "wcag")] == [6.5, 4.5]
    assert PROFILES["wcag"].geometry(128, 96).area == 1360
    assert PROFILES["strict"].geometry(128, 96).area == 1088
    assert profile_name(PROFILES["strict"]) == "strict"
    assert profile_name(with_settings("strict", swing=0.2)) == "custom"
    assert PROFILES["wcag"].signature() != PROFILES["strict"].signature()
    assert with_settings("wcag", section_pad=9).signature() == PROFILES["wcag"].signature()
    assert PROFILES["wcag"].analysis_size(1920, 1080) == (256, 144)


def test_rows_are_worked_on_in_bounded_lots():
    """However large a batch is, a pass holds a part of it at a time, and lots give what one batch gives."""
    import pyarrow as pa

    from glintframe.plans import detector

    rows = 5000
    batch = pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array([bytes(2304)] * rows)], names=["n", "rgb"])
    lots = list(detector._lots(iter([batch])))
    assert len(lots) > 1 and max(x.nbytes for x in lots) <= detector.LOT * 1.1
    assert [n for x in lots for n in x.column(0).to_pylist()] == list(range(rows))


def test_series_are_worked_on_side_by_side():
    """One call of numpy serves many series."""
    from glintframe.plans import detector
    from glintframe.queries_detector import CONFIG

    series = [detector._Series(i) for i in range(5)]
    for s in series:
        for n in range(3):
            s.add(n, False)
    steps = list(detector._in_step(series, 8, lambda n: detector._Windows(n, CONFIG)))
    assert [len(turns) for turns, *_ in steps] == [5, 5, 5]


def test_pixels_alike_are_followed_once(monkeypatch):
    """Pixels that are alike in all pictures are one lane; those that part later are two from then on."""
    import numpy as np

    from glintframe.plans import detector

    rng = np.random.default_rng(5)
    kinds = rng.integers(0, 1 << 24, (9, 3), dtype=np.uint32)
    codes = kinds[:, rng.integers(0, 3, 96)]
    pick, which = detector._alike(codes)
    assert len(pick) == 3 and (codes[:, pick][:, which] == codes).all()
    later, again = detector._alike(codes[:, :1] + np.zeros((1, 96), np.uint32), which)
    assert len(later) == 3 and (which[later][again] == which).all()
    assert len(detector._alike(rng.integers(0, 1 << 24, (9, 96), dtype=np.uint32))[0]) == 96
    # a sum that mixes up pixels is found out
    monkeypatch.setattr(detector, "FACTORS", np.zeros(256, np.uint64))
    assert len(detector._alike(codes)[0]) == 96


def test_lanes_part_within_a_series():
    """A band whose pixels part after many lots gives what one lot gives, with as few lanes as there are kinds of pixels."""
    import numpy as np

    from glintframe.plans import detector
    from glintframe.queries_detector import CONFIG

    geo, rng = CONFIG.geometry(16, 16), np.random.default_rng(3)
    left = np.repeat(np.arange(16) < 8, 16).reshape(16, 16).T.ravel()
    grey = rng.integers(0, 256, 40)
    pictures = [np.repeat(np.where(left | (k < 20), g, 255 - g).astype(np.uint8)[:, None], 3, axis=1) for k, g in enumerate(grey)]
    rows = [{"codes": p.tobytes(), "alike": None} for p in pictures]

    def lanes(lots: list[list[dict]]) -> list[int]:
        band, found = detector._Band(("v", 0)), []
        for lot in lots:
            for row in lot:
                band.add(row, False)
            band.split(geo, 0)
            for (row, codes), _ in band.turns:
                assert codes[band.which].tobytes() == row["codes"]
            assert band.share.sum() == 256 and band.share.shape == (len(geo.xs) * len(geo.ys), band.lanes)
            band.state, band.turns = detector._Tile(band.lanes, CONFIG), []
            found.append(band.lanes)
        return found

    assert lanes([rows]) == [2]
    assert lanes([rows[:10], rows[10:20], rows[20:30], rows[30:]]) == [1, 1, 2, 2]
    assert lanes([rows[30:], rows[:10]]) == [2, 2]


def test_classes_of_pixels_are_handed_on(spark):
    """Bands handed on as a pixel of each class are small, and give what all codes give; a band without pixels alike is handed on whole."""
    import numpy as np
    from pyspark.sql import functions as F

    rng, rows = np.random.default_rng(11), []
    block = np.kron(np.arange(4).reshape(2, 2), np.ones((16, 8), np.int64))
    for n in range(150):
        top = rng.integers(0, 256, (4, 3))[block]
        low = np.repeat((np.arange(128).reshape(8, 16) + 97 * n)[..., None] % 256, 3, axis=2)
        rows.append(("v", n, n / 30, 16, 40, bytearray(np.concatenate([top, low]).astype(np.uint8).tobytes())))
    frames = spark.createDataFrame(rows, "video string, n long, t double, w int, h int, rgb binary")
    config = PROFILES["wcag"]
    bands = [detector._pictures(frames, config, alike).cache() for alike in (True, False)]
    sizes = [df.where("NOT held").groupBy("band").agg(F.max(F.length("codes")).alias("most")).orderBy("band").collect() for df in bands]
    assert [[r.most for r in x] for x in sizes] == [[12, 384], [1536, 384]]
    one, two = (detector._frames_of_parts(detector._window_parts(df, config), config).orderBy("n").collect() for df in bands)
    assert one == two and any(r.hazard for r in one)
