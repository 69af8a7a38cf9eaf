"""Scanning one video in time segments, and one result from theirs.

A segment is scanned with a run-up: frames before its start, after which runs, ages and rings should be those of a
scan from the video's beginning.  One thing a run-up can't restore: in flashing without a pause, which transitions pair up hangs on
all that went before.  So each segment is followed both ways, as if it began between flashes or within one, as soon as its runs had
time to settle.  It hands on a code of each pixel's state at its start and its end either way, 64 bytes a pixel.  A pass over
these, segment by segment, tells which way each pixel went; only bands in which some pixel went the other way are scanned again.
Where a pixel went neither way (its run-up was too short to settle a run, or the last new picture is not the same one),
the whole video is scanned from its beginning.

Segments are scanned side by side, in as many tasks as there are.  Their windows' sums run through the last pass of
the detector as one video, by one clock.  ``merge`` joins results of segments that were scanned with clocks of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintframe.config import Config
from glintframe.operators.clock import LOOK_BACK, monotonic_clock
from glintframe.operators.flashes import spread
from glintframe.operators.intervals import asof
from glintframe.plans import detector
from glintframe.tables import stored

SECONDS = 10.0


def spans(times: DataFrame, cfg: Config, segment: Column | None = None, run_up: float | None = None) -> DataFrame:
    """video, segment, run_n, from_n, to_n from (video, n, t): frames from run_n on are read, those from from_n on count.

    tc0 and recent are the clock at run_n and the good steps that its median looks back on.

    ``segment``: a number that doesn't fall along a video, from n, t and the clock tc; by default every ``SECONDS`` a new one.
    The run-up is measured by the clock, so jumps of the source's time don't shorten it.
    """
    clock = monotonic_clock(spread(times.select("video", "n", "t"), "video"), ["video"], "n", "t", cfg.max_gap)
    number = F.floor(F.col("tc") / SECONDS) if segment is None else segment
    by = Window.partitionBy("video").orderBy("n")
    step = F.col("t") - F.lag("t").over(by)
    good = (step > 0) & (step <= cfg.max_gap)
    clock = clock.withColumn("step", F.when(good, step)).withColumn("good", F.count("step").over(by)).withColumn("segment", number.cast("long"))
    # the windows above are dear, and what follows reads them three times
    clock = stored(clock.select("video", "n", "tc", "step", "good", "segment"), "segment-clock")
    starts = clock.groupBy("video", "segment").agg(F.min("n").alias("from_n"), F.max("n").alias("to_n"), F.min("tc").alias("from_tc"))
    early = F.col("from_tc") - (cfg.context_seconds if run_up is None else run_up)
    rows = stored(asof(starts, early, clock, "tc", F.struct("n", "tc", "good"), ["video"], "run", after=True), "segment-starts")
    looked = rows.where("run.good > 0").select("video", "segment", F.explode(F.sequence(F.greatest(F.lit(1), F.col("run.good") - (LOOK_BACK - 1)), F.col("run.good"))).alias("good"))
    steps = looked.join(clock.where("step is not null").select("video", "good", "step"), ["video", "good"]).groupBy("video", "segment")
    recent = steps.agg(F.transform(F.sort_array(F.collect_list(F.struct("good", "step"))), lambda s: s["step"]).alias("recent"))
    rows = rows.join(recent, ["video", "segment"], "left")
    return rows.select("video", "segment", F.col("run.n").alias("run_n"), F.col("run.tc").alias("tc0"), "recent", "from_n", "to_n")


def first_kept(stats: DataFrame, start: str = "from_t") -> DataFrame:
    """Append ``from_n`` to rows (video, segment, n, t) of segments that say at which source time they begin.

    The first segment of a video counts whole; one that never reaches its start counts nothing.
    """
    own = Window.partitionBy("video", "segment")
    reached = F.min(F.when(F.col("t") >= F.col(start) - 1e-9, F.col("n"))).over(own)
    is_first = F.col("segment") == F.min("segment").over(Window.partitionBy("video"))
    return stats.withColumn("from_n", F.when(is_first, F.min("n").over(own)).otherwise(reached))


def merge(stats: DataFrame, cfg: Config) -> DataFrame:
    """One scan's rows of statistics from those of segments (columns of ``frame_stats``, segment, from_n).

    Run-ups go; frames are numbered anew; clocks and onsets move so that one clock runs on over the seams, by the
    source's step there or, where it jumps, by the median of the good steps before; anomalies are counted by that clock.
    """
    kept = stats.where("n >= from_n").withColumnsRenamed({"tc": "own"}).drop("anomaly", "from_n")
    kept = kept.withColumn("n", F.row_number().over(Window.partitionBy("video").orderBy("segment", "n")) - 1)
    timed = monotonic_clock(kept, ["video"], "n", "t", cfg.max_gap)
    timed = timed.withColumn("__step", F.col("tc") - F.lag("tc").over(Window.partitionBy("video").orderBy("n")))
    heads = timed.groupBy("video", "segment").agg(F.min_by("own", "n").alias("a"), F.max_by("own", "n").alias("b"), F.min_by(F.struct("__step"), "n")["__step"].alias("step"))
    along = Window.partitionBy("video").orderBy("segment")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ran = F.coalesce(F.sum(F.col("b") - F.col("a")).over(before), F.lit(0.0)) + F.coalesce(F.sum("step").over(along), F.lit(0.0))
    shifts = heads.select("video", "segment", (F.first("a").over(along) + ran - F.col("a")).alias("__shift"))
    moved = timed.drop("tc", "__step").join(shifts, ["video", "segment"])
    made = moved.select("*", *[(F.col(old) + F.col("__shift")).alias(f"__{old}") for old in ("own", "onset_tc", "onset_red_tc")])
    made = made.drop("own", "onset_tc", "onset_red_tc", "segment", "__shift").withColumnsRenamed({"__own": "tc", "__onset_tc": "onset_tc", "__onset_red_tc": "onset_red_tc"})
    names = [x.split()[0] for x in detector.STATS.split(", ")]
    return made.select([F.col("anomaly").cast("boolean").alias(c) if c == "anomaly" else c for c in names])


def ways(carries: DataFrame) -> DataFrame:
    """video, segment, band, codes: which lanes of each tracker began within a flash, where some did; no codes, where some went neither way.

    ``carries`` (video, segment, band, carry) has codes of the states at a segment's start and end, either way.  A pass
    over each band's segments in order: the state at the end of one is that at the start of the next.
    """
    ready = carries.repartition("video", "band").sortWithinPartitions("video", "band", "segment")
    schema = "video string, segment long, band int, codes binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ends = None, None
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                codes = detector.pixels_of(row["carry"])
                one, other = codes[0, :3, 0], codes[0, :3, 1]
                (runs, first_run), now = codes[0, 3], codes[1, 3, 0]
                if (row["video"], row["band"]) != key:
                    key, ends, last = (row["video"], row["band"]), one, runs
                neither = ((ends != one) & (ends != other)).any() or (last != runs).any() or first_run.any()
                within = (one != other) & (ends == other)
                ends, last = np.where(within, codes[1, :3, 1], codes[1, :3, 0]), now
                if neither or within.any():
                    made.append((*key[:1], row["segment"], key[1], None if neither else within.tobytes()))
            columns = list(zip(*made, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["video", "segment", "band", "codes"])

    return ready.select("video", "segment", "band", "carry").mapInArrow(run, schema)


def _whole(marks: DataFrame, videos: DataFrame) -> DataFrame:
    """One segment, numbered -1, of all of each of these videos."""
    rows = marks.join(videos, "video", "left_semi").groupBy("video")
    whole = rows.agg(F.min("run_n").alias("run_n"), F.min("from_n").alias("from_n"), F.max("to_n").alias("to_n"))
    return whole.select("video", F.lit(-1).cast("long").alias("segment"), "run_n", F.lit(0.0).alias("tc0"), F.lit(None).cast("array<double>").alias("recent"), "from_n", "to_n")


def _bands(frames: DataFrame, marks: DataFrame, cfg: Config, alike: bool = True) -> DataFrame:
    """The detector's first pass over segments, each a video of its own named segment:video."""
    mark = marks.withColumnRenamed("video", "__video")
    own = frames.join(mark, (F.col("video") == F.col("__video")) & F.col("n").between(F.col("run_n"), F.col("to_n")))
    own = own.withColumn("video", F.concat_ws(":", F.col("segment").cast("string"), "video")).withColumn("recent", F.when(F.col("n") == F.col("run_n"), F.col("recent")))
    return detector._pictures(own.select("video", "n", "t", "w", "h", "rgb", "tc0", "from_n", "recent"), cfg, alike)


def _named(rows: DataFrame) -> DataFrame:
    parts = F.split("video", ":", 2)
    return rows.withColumn("segment", parts[0].cast("long")).withColumn("video", parts[1])


def pictures(frames: DataFrame, cfg: Config, segment: Column | None = None, run_up: float | None = None) -> DataFrame:
    """The columns video to lum of ``scan`` alone: they are known as soon as repeated pictures are told apart, before any work on pixels.

    The last new picture before a segment must be the one that the segment before ends with; if not, the video is taken as a whole.
    """
    marks = stored(spans(frames, cfg, segment, run_up), "segments")
    rows = _named(_bands(frames, marks, cfg, alike=False)).withColumn("code", F.xxhash64("codes")).drop("codes", "alike")
    rows = stored(rows, "segment-pictures")
    new = rows.where("NOT held").groupBy("video", "band", "segment")
    ends = new.agg(F.max_by("code", F.when(F.col("n") < F.col("from_n"), F.col("n"))).alias("start"), F.max_by("code", "n").alias("end"))
    before = F.lag("end").over(Window.partitionBy("video", "band").orderBy("segment"))
    other = stored(ends.withColumn("before", before).where("before IS NOT NULL AND NOT before <=> start").select("video").distinct(), "segment-videos")
    again = _named(_bands(frames, _whole(marks, other), cfg, alike=False))
    first = rows.join(other, "video", "left_anti")
    rows = first.unionByName(again, allowMissingColumns=True).where("band = 0 AND n >= from_n")
    return rows.select("video", "n", "t", "tc", "held", "anomaly", F.col("mean").alias("lum"))


def scan(frames: DataFrame, cfg: Config, segment: Column | None = None, run_up: float | None = None) -> DataFrame:
    """``frame_stats`` of whole videos, every segment a key of its own: the same rows, in parallel along the time.

    Where the segments begin is worked out from the frames' times alone; pictures go to their own segment and those
    whose run-up they are in.
    """
    marks = stored(spans(frames, cfg, segment, run_up), "segments")
    bands = lambda marks: _bands(frames, marks, cfg)
    found = stored(_named(detector._window_parts(bands(marks), cfg, carry=True)), "segment-parts")
    turned = stored(ways(found.where("carry is not null")), "segment-ways")
    other = turned.where("codes is null").select("video").distinct()
    turned = turned.join(other, "video", "left_anti")
    key = ["video", "segment", "band"]
    again = bands(marks.join(turned.select("video", "segment").distinct(), ["video", "segment"], "left_semi").unionByName(_whole(marks, other)))
    known = turned.withColumn("video", F.concat_ws(":", F.col("segment").cast("string"), "video")).select("video", "band", "codes")
    whole = found.where("carry is not null").join(other, "video", "left_semi").select(F.concat(F.lit("-1:"), "video").alias("video"), "band").distinct()
    again = again.join(known.select("video", "band").unionByName(whole), ["video", "band"], "left_semi")
    again = again.unionByName(known.withColumn("n", F.lit(detector.FIRST)), allowMissingColumns=True)
    second = _named(detector._window_parts(again, cfg))
    first = found.where("carry is null").join(turned.select(*key), key, "left_anti").join(other, "video", "left_anti")
    # frames that show nothing new have a row in band 0 only, whichever scan it comes from
    return detector._frames_of_parts(first.unionByName(second).drop("segment"), cfg)


def counts(stats: DataFrame) -> DataFrame:
    """video, frames, held, anomalies."""
    return stats.groupBy("video").agg(F.count(F.lit(1)).alias("frames"), F.count_if("held").alias("held"), F.count_if("anomaly").alias("anomalies"))
