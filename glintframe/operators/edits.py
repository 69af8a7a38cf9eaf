"""Edits of a section's frames, as joins and windows over (section, ord, ...) rows."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.operators.flashes import sorted_fold
from glintframe.operators.intervals import asof, located, touching

LOCATE_SLACK = 1e-6  # seconds by which a moment may lie past the end
PICK_SLACK = 1e-9  # seconds by which a frame may seem early


def replacement(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Append ``source``: the frame shown at each place.  A removed frame shows the nearest survivor on its
    fill side (``fill``: prev or next), else on the other side, else frame 0.  Columns: ord, removed, fill."""
    by = Window.partitionBy(*keys).orderBy("ord")
    survivor = F.when(~F.col("removed"), F.col("ord"))
    before = F.last(survivor, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(survivor, ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return frames.withColumn("source", F.when(F.col("fill") == "next", F.coalesce(after, before, F.lit(0))).otherwise(F.coalesce(before, after, F.lit(0))))


def edited_sequence(frames: DataFrame, keys: list[str], hold: float = 1.0) -> DataFrame:
    """Append ``shown`` (seconds): the time at which a place is shown when every extended frame before it holds.

    A hold starts where the next frame would be, so it moves that frame and all after it.
    """
    by = Window.partitionBy(*keys).orderBy("ord")
    holds = F.sum(F.when(F.col("extended") & ~F.col("removed"), F.lit(hold)).otherwise(F.lit(0.0))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return frames.withColumn("shown", F.col("rel") + F.coalesce(holds, F.lit(0.0)))


def holds(frames: DataFrame, keys: list[str], end: str, hold: float = 1.0) -> DataFrame:
    """The holds of extended frames that stay: from where the next frame would be (for the last one: the section's end)."""
    by = Window.partitionBy(*keys).orderBy("ord")
    rows = frames.withColumn("at", F.coalesce(F.lead("rel").over(by), F.col(end)))
    return rows.where(F.col("extended") & ~F.col("removed")).select(*keys, "ord", "at", F.lit(hold).alias("seconds"))


# Rates (and how near to them) on the grid of 100 slots a second, and slots there must be for a picture.
GRID_100 = ((25, 0.5), (50, 1.0))
GRID_ROOM = 1.8


def slots(pictures: DataFrame, keys: list[str]) -> DataFrame:
    """Append ``grid`` (slots a second), ``first_slot`` and ``slots`` for an export at a constant rate.

    Pictures (n, rel, until: where each one ends) take whole slots, at least one each; one that finds its
    slot taken borrows from those after it.  The end of picture i is max(end before + 1, its own place),
    which is i and the running maximum of place - i.  Rates near those of ``GRID_100`` lie on a grid of 100, others
    on 120, doubled until it is ``GRID_ROOM`` times the rate.
    """
    by = Window.partitionBy(*keys).orderBy("n")
    step = F.col("until") - F.col("rel")
    usual = pictures.where(step > 1e-6).groupBy(*keys).agg((1 / F.percentile(step, 0.5)).alias("__rate"))
    rate = F.col("__rate")
    base = F.when(reduce(or_, (F.abs(rate - near) < slack for near, slack in GRID_100)), 100).otherwise(120)
    grids = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: base * F.pow(F.lit(2), i))
    grid = F.coalesce(F.element_at(F.filter(grids, lambda g: g >= rate * GRID_ROOM), 1), F.lit(120.0))
    rows = pictures.join(usual.select(*keys, grid.cast("long").alias("grid")), keys, "left").fillna(120, ["grid"])
    place = F.row_number().over(by)
    rows = rows.withColumn("__i", place).withColumn("__p", F.rint(F.col("until") * F.col("grid")).cast("long") - F.col("__i"))
    last = F.col("__i") + F.greatest(F.lit(0), F.max("__p").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("__end", last).withColumn("first_slot", F.coalesce(F.lag("__end").over(by), F.lit(0)))
    return rows.withColumn("slots", F.col("__end") - F.col("first_slot")).drop("__i", "__p", "__end")


def picture_times(sequence: DataFrame, keys: list[str]) -> DataFrame:
    """The first time each source is shown."""
    return sequence.groupBy(*keys, "source").agg(F.min("shown").alias("first_shown"), F.count(F.lit(1)).alias("places"))


def classified(violations: DataFrame, start: str, end: str, boundary: float = 0.125, slack: float = 1e-6) -> DataFrame:
    """Append ``bucket``: where a violation lies towards a section: before, inside, after or elsewhere."""
    inside = (F.col("v_end") >= F.col(start) - slack) & (F.col("v_start") < F.col(end) - slack)
    after = (F.col("v_start") >= F.col(end) - slack) & (F.col("v_start") <= F.col(end) + boundary)
    return violations.withColumn("bucket", F.when(inside, "inside").when(after, "after").when(F.col("v_end") < F.col(start), "before").otherwise("elsewhere"))


def flagged_frames(frames: DataFrame, spans: DataFrame, keys: list[str], slack: float = 0.05) -> DataFrame:
    """Frames that lie in some span, onset included."""
    t = F.col("t")
    return touching(frames, t, t, spans, F.least("onset", "start") - slack, F.col("end") + slack, keys).where("touches").drop("touches")


def percentile_cut(frames: DataFrame, keys: list[str], metric: str = "x", remove: str = "light", tight: bool = False) -> DataFrame:
    """Frames to remove in each span (keys): those on the wrong side of a cut between the 15th and 85th percentile."""
    low, high = (F.expr(f"percentile({metric}, {p}D)") for p in (0.15, 0.85))
    cuts = frames.groupBy(*keys).agg(low.alias("lo"), high.alias("hi")).where(F.col("hi") - F.col("lo") >= 1e-4)
    share = 0.5 if not tight else (0.15 if remove == "light" else 0.85)
    rows = frames.join(cuts.withColumn("cut", F.col("lo") + (F.col("hi") - F.col("lo")) * share), keys)
    return rows.where(F.col(metric) > F.col("cut") if remove == "light" else F.col(metric) < F.col("cut")).drop("lo", "hi")


def hold_extreme(frames: DataFrame, keys: list[str], metric: str = "x", order: str = "n", keep: str = "dark") -> DataFrame:
    """The one frame of each span that stays: the darkest (or lightest), the first on ties."""
    value = F.col(metric) if keep == "dark" else -F.col(metric)
    return frames.groupBy(*keys).agg(F.min_by(F.struct(order, metric), F.struct(value, F.col(order))).alias("b")).select(*keys, f"b.{order}", f"b.{metric}")


def blend_sources(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Append prev and next unmarked frames of each marked one, and how far along it lies (u)."""
    by = Window.partitionBy(*keys).orderBy("ord")
    free = F.when(~F.col("marked"), F.col("ord"))
    rows = frames.withColumn("prev", F.last(free, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))).withColumn("next", F.first(free, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing)))
    share = (F.col("ord") - F.col("prev")) / (F.col("next") - F.col("prev"))
    return rows.where("marked").withColumn("u", F.when(F.col("prev").isNull(), 1.0).when(F.col("next").isNull(), 0.0).otherwise(share))


def blend_weights(u: Column, strength: float) -> list[Column]:
    """Weights of the frame itself, the one before and the one after."""
    return [F.lit(1 - strength), F.lit(strength) * (1 - u), F.lit(strength) * u]


def first_come(segments: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (start, end) in order of their starts, each without what earlier ones cover; empty ones go."""
    earlier = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn("start", F.greatest("start", F.max("end").over(earlier))).where("start < end")


def sound_places(segments: DataFrame, holds: DataFrame, keys: list[str]) -> DataFrame:
    """Segments (start, end; disjoint, see :func:`first_come`) cut where a hold begins and moved by all holds at or before them.

    A cut belongs to the segment that holds it, and the shift is a running sum of the holds: both are as-of joins.
    """
    whole = segments.withColumn("__from", F.col("start"))
    spans = whole.select(*keys, "start", "end", F.col("__from").alias("id"))
    cuts = located(holds.select(*keys, "at").distinct(), spans, keys, "at").where("id is not null and at > id").select(*keys, F.col("id").alias("__from"), F.col("at").alias("start"))
    rest = [c for c in segments.columns if c not in (*keys, "start", "end")]
    inner = cuts.join(whole.select(*keys, "__from", "end", *rest), [*keys, "__from"])
    parts = whole.unionByName(inner.select(whole.columns))
    nearest = F.lead("start").over(Window.partitionBy(*keys, "__from").orderBy("start"))
    parts = parts.withColumn("end", F.coalesce(nearest, "end")).drop("__from")
    sums = holds.groupBy(*keys, "at").agg(F.sum("seconds").alias("seconds"))
    sums = sums.withColumn("held", F.sum("seconds").over(Window.partitionBy(*keys).orderBy("at")))
    moved = asof(parts, F.col("start"), sums, "at", F.col("held"), keys, "shift").fillna(0.0, ["shift"])
    return moved.withColumn("placed", F.col("start") + F.col("shift"))


def sound_source(points: DataFrame, places: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Append ``source``: which second of the source sounds at an output second; null in silence."""
    end = F.col("placed") + F.col("end") - F.col("start")
    spans = places.select(*keys, F.col("placed").alias("start"), end.alias("end"), F.col("shift").alias("id"))
    return located(points, spans, keys, at).withColumn("source", F.col(at) - F.col("id")).drop("start", "end", "id")


def export_layout(sections: DataFrame, keys: list[str], duration: str, least_gap: float = 0.02) -> DataFrame:
    """Pieces of an export in order: copied gaps and encoded sections, with where each starts in the result."""
    by = Window.partitionBy(*keys).orderBy("start")
    rows = sections.withColumn("gap_from", F.coalesce(F.lag("end").over(by), F.lit(0.0))).withColumn("is_last", F.lead("start").over(by).isNull())
    pieces = F.array(
        F.struct(F.lit("copy").alias("piece"), F.col("gap_from").alias("a"), F.col("start").alias("b"), F.lit(0.0).alias("extra")),
        F.struct(F.lit("encode").alias("piece"), F.col("start").alias("a"), F.col("end").alias("b"), F.col("extra").alias("extra")),
        F.struct(F.lit("copy").alias("piece"), F.when(F.col("is_last"), F.col("end")).otherwise(F.col(duration)).alias("a"), F.col(duration).alias("b"), F.lit(0.0).alias("extra")),
    )
    rows = rows.select(*keys, F.explode(pieces).alias("p")).select(*keys, "p.*").where((F.col("piece") == "encode") | (F.col("b") - F.col("a") > least_gap))
    length = F.col("b") - F.col("a") + F.col("extra")
    before = Window.partitionBy(*keys).orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("placed", F.coalesce(F.sum(length).over(before), F.lit(0.0)))


def locate(points: DataFrame, layout: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Where moments of an export come from: ``piece``, seconds ``into`` it, and the ``source`` time they stand for; null past the end.

    ``layout`` as made by :func:`export_layout`.  Within a section ``into`` is on its own timeline, holds included.  A
    moment where two pieces meet is the later one's, the end of all belongs to the last.
    """
    length = F.col("b") - F.col("a") + F.col("extra")
    last = F.lead("placed").over(Window.partitionBy(*keys).orderBy("placed", "a")).isNull()
    end = F.col("placed") + length + F.when(last, LOCATE_SLACK).otherwise(0.0)
    spans = layout.where(length > 0).select(*keys, F.col("placed").alias("start"), end.alias("end"), F.struct("piece", "a", "placed").alias("id"))
    found = located(points, spans, keys, at)
    into = F.col(at) - F.col("id.placed")
    return found.select(*points.columns, F.col("id.piece").alias("piece"), into.alias("into"), (F.col("id.a") + into).alias("source"))


def pick_pictures(wanted: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (i from 0 without gaps, at) with ``place`` and ``t`` of the frame (place from 0 without gaps, t) that shows each moment.

    The moment waits for the first frame at or after it that comes later than the one its predecessor waited for.  Of this
    frame and the one before it the nearer is taken, the later on ties, but none twice.  Moments that no frame is left for go.
    Frames waited for are i and the running maximum of place - i; only the choice between two frames is a fold.
    """
    first = asof(wanted, F.col("at") - PICK_SLACK, frames, "t", F.col("place"), keys, "__first", after=True).where("__first is not null")
    along = Window.partitionBy(*keys).orderBy("i")
    waits = F.col("i") + F.max(F.col("__first") - F.col("i")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = first.select(*wanted.columns, waits.alias("__k"))
    shown = frames.select(*keys, F.col("place").alias("__k"), F.col("t").alias("__t"), F.lag("t").over(Window.partitionBy(*keys).orderBy("place")).alias("__before"))
    rows = rows.join(shown, [*keys, "__k"])

    def begin():
        used = [-1]

        def step(row: dict):
            k, at = row["__k"], row["at"]
            earlier = row["__before"] is not None and used[0] != k - 1 and abs(row["__before"] - at) < abs(row["__t"] - at)
            used[0] = k - 1 if earlier else k
            return used[0], row["__before"] if earlier else row["__t"]

        return step

    fields = [T.StructField("place", T.LongType()), T.StructField("t", T.DoubleType())]
    return sorted_fold(rows, keys, ["i"], fields, begin, wanted.columns)


def pick_side(frames: DataFrame, keys: list[str], metric: str, cut: float) -> DataFrame:
    """Which side to remove: the light one unless the dark one is clearly smaller."""
    counts = frames.groupBy(*keys).agg(F.count_if(F.col(metric) > cut).alias("light"), F.count_if(F.col(metric) <= cut).alias("dark"))
    return counts.withColumn("side", F.when(F.col("dark") < 0.8 * F.col("light"), "dark").otherwise("light"))


def soften_plan(frames: DataFrame, keys: list[str], threshold: float, margin: float = 0.25) -> DataFrame:
    """Frames within ``margin`` of a clearly striped one, and the blur that its stripes ask for (sigma of at least 1, and the radius of its boxes)."""
    near = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY t RANGE BETWEEN {margin}D PRECEDING AND {margin}D FOLLOWING)"  # the API takes whole numbers only
    weight, spread = (F.expr(f"sum(CASE WHEN pattern >= {threshold / 2} THEN {v} END) {near}") for v in ("pattern", "period * pattern"))
    rows = frames.select(*keys, "n", weight.alias("__w"), spread.alias("__s")).where("__w is not null")
    return rows.select(*keys, "n", F.greatest(F.lit(1.0), F.col("__s") / F.col("__w")).alias("sigma")).withColumn("radius", blur_radius(F.col("sigma")))


def blur_radius(sigma: Column) -> Column:
    """Radius of three box passes whose variance, ((2 r + 1)**2 - 1) / 4, is nearest to sigma's; at least 1."""
    return F.greatest(F.lit(1), F.floor((F.sqrt(4 * sigma * sigma + 1) - 1) / 2 + 0.5)).cast("long")


def section_timeline(frames: DataFrame, keys: list[str], duration: str) -> DataFrame:
    """Frames shown, base time, and the length: to the first frame past the duration, or the last and a median step."""
    by = Window.partitionBy(*keys).orderBy("n")
    rows = frames.withColumn("__d", F.col("t") - F.lag("t").over(by)).withColumn("__rel", F.col("t") - F.first("t").over(by))
    shown = F.col("__rel") < F.col(duration) - 1e-9
    made = rows.groupBy(*keys).agg(
        F.count_if(shown).alias("shown"),
        F.count(F.lit(1)).alias("frames"),
        F.min(F.when(~shown, F.col("__rel"))).alias("cut"),
        F.max("__rel").alias("last"),
        F.coalesce(F.expr("percentile(CASE WHEN __d > 0 THEN __d END, 0.5D)"), F.lit(1.0) / 30).alias("step"),
    )
    return made.select(*keys, F.when(F.col("shown") > 0, F.col("shown")).otherwise(F.col("frames")).alias("shown"), F.coalesce("cut", F.col("last") + F.col("step")).alias("total"))


def valid_orders(orders: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose order (place, source) is a permutation of its places, and whether it moves anything."""
    made = orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("kinds"), F.min("source").alias("lo"), F.max("source").alias("hi"), F.count_if(F.col("source") != F.col("place")).alias("moved"))
    return made.select(*keys, ((F.col("kinds") == F.col("n")) & (F.col("lo") == 0) & (F.col("hi") == F.col("n") - 1)).alias("valid"), "moved")


def applied_marks(marks: DataFrame, suggested: DataFrame, keys: list[str], scope: DataFrame) -> DataFrame:
    """Marks outside the scope stay; inside it the suggestion replaces them."""
    inside = [*keys, "ord"]
    return marks.select(*inside).join(scope, inside, "left_anti").unionByName(suggested.select(*inside).join(scope, inside, "left_semi")).distinct()
