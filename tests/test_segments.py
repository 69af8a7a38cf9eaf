"""Segments scanned apart give what one scan gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from glintframe.config import PROFILES, with_settings
from glintframe.plans import detector, segments
import scenes

CONFIG = PROFILES["wcag_ext"]
SCENES = ["square3hz", "burst3hz", "partial35"]


@pytest.fixture(scope="module")
def frames(spark):
    """Scenes whose source times also jump ahead (4.1 s), stand still and run backwards."""
    rows = scenes.frames(spark, SCENES)
    jump = F.when((F.col("video") == "square3hz") & (F.col("n") >= 100), 40.0).when((F.col("video") == "burst3hz") & (F.col("n") >= 60), -1.5).otherwise(0.0)
    return rows.withColumn("t", F.when((F.col("video") == "partial35") & (F.col("n") == 50), F.lit(49 * 1001 / 30000)).otherwise(F.col("t") + jump)).cache()


@pytest.fixture(scope="module")
def whole(frames):
    return detector.frame_stats(frames, CONFIG).cache()


@pytest.fixture(scope="module")
def patterns(spark, frames):
    """None of the scenes is striped (``test_patterns``), so none is looked through again."""
    return frames.select("video", "n", F.lit(0).alias("pattern"), F.lit(0.0).alias("period"))


def close(a, b):
    return a == b or (isinstance(a, float) and a == pytest.approx(b, abs=1e-9))


@pytest.mark.parametrize("cut", ["n div 30", "floor(tc / 2.5)", "CASE WHEN n < 101 THEN 0 WHEN n < 102 THEN 1 ELSE 5 END"])
def test_any_cut_gives_the_whole_scan(frames, whole, patterns, cut):
    made = segments.scan(frames, CONFIG, F.expr(cut)).cache()
    a, b = (df.orderBy("video", "n").collect() for df in (made, whole))
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(close(p, q) for p, q in zip(x, y, strict=True)), (x, y)
    verdicts = [detector.verdict(df, CONFIG, scenes.W, scenes.H, patterns).orderBy("video", "what", "start", "level").collect() for df in (made, whole)]
    assert len(verdicts[0]) == len(verdicts[1]) > 2
    for x, y in zip(*verdicts, strict=True):
        assert all(close(p, q) for p, q in zip(x, y, strict=True)), (x, y)
    assert sorted(map(tuple, segments.counts(made).collect())) == sorted(map(tuple, segments.counts(whole).collect()))


def test_segments_that_state_their_start(spark, frames, whole):
    """Results of scans that began by themselves, with clocks and frame numbers of their own."""
    first = detector.frame_stats(frames.where("video = 'square3hz' AND n < 90"), CONFIG).withColumn("segment", F.lit(0)).withColumn("from_t", F.lit(0.0))
    later = detector.frame_stats(frames.where("video = 'square3hz' AND n >= 20").withColumn("n", F.col("n") - 20), CONFIG)
    later = later.withColumn("segment", F.lit(7)).withColumn("from_t", F.lit(90 * 1001 / 30000))
    never = later.withColumn("segment", F.lit(9)).withColumn("from_t", F.lit(1e9))
    made = segments.merge(segments.first_kept(first.unionByName(later).unionByName(never)).where("from_n is not null"), CONFIG)
    a, b = made.orderBy("n").collect(), whole.where("video = 'square3hz'").orderBy("n").collect()
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(close(p, q) for p, q in zip(x[:6], y[:6], strict=True)) and (x.n >= 90 or all(close(p, q) for p, q in zip(x, y, strict=True)))
        assert close(x.tc - x.onset_tc, y.tc - y.onset_tc)


def test_merging_is_associative(frames, whole):
    """Merged segments are a segment: (a, b), c gives what a, (b, c) gives."""
    rows = whole.withColumn("segment", (F.col("n") / 40).cast("long")).withColumn("from_n", F.lit(0))
    flat = segments.merge(rows, CONFIG)
    pair = segments.merge(rows.where("segment < 2"), CONFIG).withColumn("segment", F.lit(0)).withColumn("from_n", F.lit(0))
    nested = segments.merge(pair.unionByName(rows.where("segment >= 2")), CONFIG)
    a, b = (df.orderBy("video", "n").collect() for df in (flat, nested))
    assert all(close(p, q) for x, y in zip(a, b, strict=True) for p, q in zip(x, y, strict=True))


def test_patterns_are_not_skipped(whole):
    with pytest.raises(ValueError, match="patterns"):
        detector.verdict(whole, CONFIG, scenes.W, scenes.H)


def test_counts_need_no_work_on_pixels(frames, whole, monkeypatch):
    """Frames, held pictures and anomalies of the pictures alone are those of the whole scan."""
    monkeypatch.setattr(detector, "_window_parts", None)
    made = segments.pictures(frames, CONFIG, F.expr("n div 30"))
    assert sorted(map(tuple, segments.counts(made).collect())) == sorted(map(tuple, segments.counts(whole).collect()))
    columns = made.columns
    got, want = (df.select(columns).orderBy("video", "n").collect() for df in (made, whole))
    assert len(got) == len(want) and all(close(p, q) for x, y in zip(got, want, strict=True) for p, q in zip(x, y, strict=True))


#: Grey levels and times in microseconds of series that flash without a pause, and whose first pictures after 1.5 seconds,
#: taken for themselves, show other transitions than the series does.
RESTLESS = {
    "s0_2607": ("58732C0261DEFFEA0E1610AF3E39330111663A2A831ADE2A22FF4B2D561F8E22FFFF168E214C050B3D0D354C4778105D73050E5E24FF14FF9C3952FF297C53FFE941C9", [20539, 123957, 212398, 251892, 307301, 390160, 439260, 630115, 680648, 932125, 1013224, 1127096, 1317417, 1488848, 1496366, 1703682, 1729817, 1795271, 2023400, 2240221, 2247839, 2326814, 2414020, 2520878, 2534334, 2683464, 2877582, 2916911, 2937143, 3034139, 3170154, 3377545, 3643765, 3940157, 4060959, 4077187, 4286474, 4352493, 4457250, 4549768, 4615388, 4673904, 4777213, 4853921, 4878445, 5029683, 5039962, 5141565, 5163350, 5411163, 5471224, 5472416, 5903237, 5972432, 6099527, 6118902, 6244831, 6430532, 6473842, 6573632, 6671159, 6677058, 6845667, 7005326, 7013043, 7356265, 7479075]),
    "s12_10114": ("26090505FF205A054B0A803743075F43FF5A4F64FF5D318C4032FBFF2A87D60E8177845A4D3B220EFF6120FF289A1C1C06FFFB7ADB82929F5397328425370453A5B20F", [21203, 151715, 482668, 612775, 801385, 863095, 1007638, 1013159, 1276847, 1344686, 1409177, 1419903, 1510085, 1645425, 1666604, 1729059, 1881183, 1934662, 1940783, 2119803, 2183304, 2429213, 2624169, 3060739, 3126720, 3142553, 3274022, 3367225, 3402121, 3511099, 3569978, 3750929, 4020665, 4060996, 4186990, 4500827, 4502136, 4623576, 4869303, 4962259, 5028343, 5028829, 5150701, 5335904, 5466535, 5574375, 5727188, 5841301, 5852871, 5947276, 6005835, 6435979, 6536669, 6601875, 6722320, 6736179, 6795629, 6858934, 6921082, 6956375, 7025221, 7073375, 7092005, 7099640, 7100647, 7102262, 7119496]),
}


def test_a_run_up_settles_before_flashes_pair(spark):
    rows = [(v, n, t / 1e6, codes[2 * n : 2 * n + 2]) for v, (codes, times) in RESTLESS.items() for n, t in enumerate(times)]
    made = spark.createDataFrame(rows, "video string, n long, t double, grey string")
    made = made.select("video", "n", "t", F.lit(4).alias("w"), F.lit(4).alias("h"), F.unhex(F.repeat("grey", 48)).alias("rgb"))
    cfg = with_settings("wcag", max_gap=0.4)
    a, b = (df.orderBy("video", "n").collect() for df in (segments.scan(made, cfg, F.expr("floor(tc / 3)")), detector.frame_stats(made, cfg)))
    assert len(a) == len(b) == len(rows)
    for x, y in zip(a, b, strict=True):
        assert all(close(p, q) for p, q in zip(x, y, strict=True)), (x, y)


def test_a_run_up_that_settles_nothing_is_not_trusted(frames, whole):
    """With hardly any run-up no pixel's state is known: videos are taken as a whole."""
    for made, columns in ((segments.scan(frames, CONFIG, F.expr("n div 30"), run_up=0.1), whole.columns), (segments.pictures(frames, CONFIG, F.expr("n div 30"), run_up=0.0), ["video", "n", "tc", "held", "anomaly"])):
        a, b = (df.select(columns).orderBy("video", "n").collect() for df in (made, whole))
        assert len(a) == len(b) and all(close(p, q) for x, y in zip(a, b, strict=True) for p, q in zip(x, y, strict=True))
