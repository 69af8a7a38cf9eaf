"""Queries of edits and their plans: holds, slots, thinning, spans to decode at once, blends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.config import PROFILES
from glintframe.operators import edits, flashes, packets
from glintframe.plans import restore, search
from glintframe.plans import sections as checks
from glintframe.queries import CLOCK, EDITS, ORACLES, ORDER_SPANS, PACKETS, US, clocked, edited, export_layout, order_spans, packet_rows, query, us
from glintframe.tables import stored


@query(
    f"""WITH {EDITS}, z AS (SELECT vid, ord, removed, extended, coalesce(lead(rel) OVER (PARTITION BY vid ORDER BY ord), rel + 0.5e0) AS hold_at FROM f)
SELECT vid, ord, {US.format('hold_at')} AS at_us, CAST(1000000 AS BIGINT) AS length_us FROM z WHERE extended AND NOT removed"""
)
def section_holds(spark: SparkSession, d: str) -> DataFrame:
    """Where the frames that are held longer begin to wait; the section ends half a second after its last frame."""
    rows = edited(spark, d).withColumn("end", F.col("rel") + 0.5)
    return edits.holds(rows, ["vid"], "end").select("vid", "ord", us("at").alias("at_us"), us("seconds").alias("length_us"))


@query(
    f"""WITH {CLOCK}, p AS (SELECT vid, n, tc, coalesce(lead(tc) OVER (PARTITION BY vid ORDER BY n), tc + 0.04e0) AS until FROM c),
r AS (SELECT vid, 1 / quantile_cont(until - tc, 0.5) AS rate FROM p WHERE until - tc > 1e-6 GROUP BY vid),
gb AS (SELECT vid, rate, CASE WHEN abs(rate - 25) < 0.5e0 OR abs(rate - 50) < 1e0 THEN 100 ELSE 120 END AS base FROM r),
gr AS (SELECT vid, CAST(min(base * power(2, i)) AS BIGINT) AS grid FROM gb, range(0, 21) z(i) WHERE base * power(2, i) >= rate * 1.8e0 GROUP BY vid),
w AS (SELECT p.vid, n, grid, until, row_number() OVER (PARTITION BY p.vid ORDER BY n) AS i FROM p JOIN gr ON gr.vid = p.vid),
z AS (SELECT vid, n, grid, i + greatest(0, max(CAST(round_even(until * grid, 0) AS BIGINT) - i) OVER (PARTITION BY vid ORDER BY n ROWS UNBOUNDED PRECEDING)) AS e FROM w)
SELECT vid, n, grid, coalesce(lag(e) OVER (PARTITION BY vid ORDER BY n), 0) AS first_slot, e - coalesce(lag(e) OVER (PARTITION BY vid ORDER BY n), 0) AS slots FROM z"""
)
def slot_layout(spark: SparkSession, d: str) -> DataFrame:
    """The slots of a constant-rate export that each picture takes."""
    after = F.lead("tc").over(Window.partitionBy("vid").orderBy("n"))
    rows = clocked(spark, d).select("vid", "n", F.col("tc").alias("rel"), F.coalesce(after, F.col("tc") + 0.04).alias("until"))
    return edits.slots(rows, ["vid"]).select("vid", "n", "grid", F.col("first_slot").cast("long"), F.col("slots").cast("long"))


_SAFE = PROFILES["wcag"].safe_rate


@query(
    f"""WITH RECURSIVE {EDITS}, h AS (SELECT vid, ord, removed AND ord % 3 = 0 AS gone, ord % 3 <> 0 AND NOT (x >= 0.5e0 AND x < 0.6e0) AS scope, x >= 0.5e0 AND x < 0.6e0 AS keep,
 rel + coalesce(sum(CASE WHEN extended AND NOT (removed AND ord % 3 = 0) THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY vid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS t FROM f),
r AS (SELECT vid, ord, gone, false AS thins, CASE WHEN gone THEN -1e18 ELSE t END AS last, keep FROM h WHERE ord = 0
UNION ALL SELECT h.vid, h.ord, h.gone, NOT h.gone AND h.scope AND h.t - r.last < 1 / {_SAFE}e0 - 1e-9, CASE WHEN h.gone OR (h.scope AND h.t - r.last < 1 / {_SAFE}e0 - 1e-9) THEN r.last ELSE h.t END, h.keep FROM r JOIN h ON h.vid = r.vid AND h.ord = r.ord + 1)
SELECT vid, count(*) AS frames, count(*) FILTER (WHERE gone) AS gone, count(*) FILTER (WHERE thins) AS removed, count(*) FILTER (WHERE keep) AS kept, CAST({round(_SAFE * 1e6)} AS BIGINT) AS rate_e6 FROM r GROUP BY vid"""
)
def rate_proposal(spark: SparkSession, d: str) -> DataFrame:
    """Thinning of each series to the safe rate: marks out of reach stay gone, frames marked keep pace the others."""
    keep = (F.col("x") >= 0.5) & (F.col("x") < 0.6)
    rows = edited(spark, d).withColumn("gone", F.col("removed") & (F.col("ord") % 3 == 0)).withColumn("keep", keep).withColumn("scope", (F.col("ord") % 3 != 0) & ~keep)
    rows = edits.edited_sequence(rows.withColumn("removed", F.col("gone")), ["vid"]).select("vid", "ord", "shown", "gone", "scope", "keep")
    made = flashes.thinned(rows, ["vid"], "ord", "shown", 1 / _SAFE, "gone", "scope").groupBy("vid")
    count = lambda c: F.count_if(c).alias("kept" if c == "keep" else "removed" if c == "thins" else c)
    return made.agg(F.count(F.lit(1)).alias("frames"), count("gone"), count("thins"), count("keep")).withColumn("rate_e6", us(F.lit(_SAFE)))


@query(
    f"""WITH RECURSIVE {PACKETS}, b AS (SELECT vid, min(t) AS f, max(t) AS l, count(*) AS total FROM p GROUP BY vid),
y AS (SELECT p.vid, p."order" - 1 AS i, p.t, total, p."order" > 1 AND p.t > b.f AND p.t < b.l AS may, row_number() OVER (PARTITION BY p.vid ORDER BY p."order") AS k FROM p JOIN b ON b.vid = p.vid WHERE sync AND total >= 120),
r AS (SELECT vid, CAST(0 AS BIGINT) AS i, CAST(0 AS DOUBLE) AS t, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS last, CAST(0 AS BIGINT) AS cuts, false AS cut FROM b
UNION ALL SELECT y.vid, y.i, y.t, y.k, CASE WHEN may AND cuts < 3 AND y.i - last >= total / 4 * 0.75 AND total - y.i >= total / 4 * 0.5 THEN y.i ELSE last END,
 cuts + CASE WHEN may AND cuts < 3 AND y.i - last >= total / 4 * 0.75 AND total - y.i >= total / 4 * 0.5 THEN 1 ELSE 0 END, may AND cuts < 3 AND y.i - last >= total / 4 * 0.75 AND total - y.i >= total / 4 * 0.5
 FROM r JOIN y ON y.vid = r.vid AND y.k = r.k + 1),
u AS (SELECT vid, CAST(1 AS BIGINT) AS from_order, f AS "from" FROM b UNION ALL SELECT vid, i + 1, t FROM r WHERE cut)
SELECT u.vid, row_number() OVER (PARTITION BY u.vid ORDER BY from_order) AS part, from_order, "from", coalesce(lead("from") OVER (PARTITION BY u.vid ORDER BY from_order), l) AS "to" FROM u JOIN b ON b.vid = u.vid"""
)
def decode_spans(spark: SparkSession, d: str) -> DataFrame:
    """Each packet series in up to four spans that can be decoded at the same time."""
    return packets.decode_spans(packet_rows(spark, d), ["vid"], "order", 4)


@query(None)
def suggested_blend(spark: SparkSession, d: str) -> DataFrame:
    """How strongly each series' flashing frames must be blended; held against a brute-force loop in the tests."""
    rows = stored(clocked(spark, d).select("vid", "n", "tc", "x"), "series")
    made = search.suggest_blend(rows, ["vid"], PROFILES["wcag"])
    return made.select("vid", "frames", "marked", us("least").alias("least_e6"), us("strength").alias("strength_e6"), "safe")


SOUND = f"""{ORDER_SPANS}, h AS (SELECT vid, CAST(s AS DOUBLE) + 3 AS mark, CAST(1 + id % 3 AS DOUBLE) AS seconds FROM o WHERE id % 4 = 0),
raw AS (SELECT vid, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e FROM o),
seg AS (SELECT vid, greatest(s, coalesce(max(e) OVER (PARTITION BY vid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS s, e FROM raw),
kept AS (SELECT vid, s, e FROM seg WHERE s < e),
cuts AS (SELECT vid, s, e, s AS a FROM kept UNION SELECT k.vid, s, e, mark FROM kept k JOIN h ON h.vid = k.vid WHERE mark > s AND mark < e),
parts AS (SELECT vid, a, coalesce(lead(a) OVER (PARTITION BY vid, s ORDER BY a), e) AS b FROM cuts),
placed AS (SELECT p.vid, p.a, p.b, coalesce(sum(CASE WHEN mark <= p.a THEN seconds END), 0e0) AS shift FROM parts p LEFT JOIN h ON h.vid = p.vid GROUP BY p.vid, p.a, p.b)"""


def sound(spark: SparkSession, d: str) -> DataFrame:
    spans = order_spans(spark, d)
    holds = spans.where("id % 4 = 0").select("vid", (F.col("start").cast("double") + 3).alias("at"), (1 + F.col("id") % 3).cast("double").alias("seconds"))
    segments = spans.select("vid", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return edits.sound_places(edits.first_come(segments, ["vid"]), holds, ["vid"])


@query(f'WITH {SOUND} SELECT vid, a AS start, b AS "end", shift, a + shift AS placed FROM placed')
def sound_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping pieces of sound, of which the first keeps its place, with holds."""
    return sound(spark, d)


@query(
    f"""WITH {SOUND}, pt AS (SELECT DISTINCT vid, CAST(s + id % 50 AS DOUBLE) AS u FROM o)
SELECT pt.vid, pt.u AS "at", coalesce(min(pt.u - shift), -1) AS source FROM pt LEFT JOIN placed p ON p.vid = pt.vid AND pt.u >= a + shift AND pt.u < b + shift GROUP BY pt.vid, pt.u"""
)
def sound_inverse(spark: SparkSession, d: str) -> DataFrame:
    """Which second of the source sounds at moments of the edited timeline; -1 in silence."""
    points = order_spans(spark, d).select("vid", (F.col("start") + F.col("id") % 50).cast("double").alias("at")).distinct()
    return edits.sound_source(points, sound(spark, d), ["vid"], "at").fillna(-1.0, ["source"])


@query(None)
def fewest_removals(spark: SparkSession, d: str) -> DataFrame:
    """Of every frame that the best passing removal takes out: what comes back as a flash that may stay, or into a long gap."""
    rows = stored(clocked(spark, d).select("vid", "n", "tc", "x"), "series")
    spans = stored(search.flashing_spans(rows, ["vid"], PROFILES["wcag"]), "flashing")
    ways = stored(search.removal_ways(rows, spans, ["vid"]), "removals")
    best = search.best_way(rows, spans, ways, ["vid"], PROFILES["wcag"]).where("passes").select("vid", "variant")
    made = restore.fewest_removals(rows, ways.join(best, ["vid", "variant"]), ["vid"], PROFILES["wcag"])
    return made.select("vid", "n", F.coalesce("back", F.lit("")).alias("back"))


@query(
    f"""WITH RECURSIVE {CLOCK}, w AS (SELECT vid, n, tc, lag(tc) OVER (PARTITION BY vid ORDER BY n) AS bf, lead(tc) OVER (PARTITION BY vid ORDER BY n) AS af FROM c),
sg AS (SELECT vid, tc - bf AS dd, row_number() OVER (PARTITION BY vid ORDER BY tc - bf) - 1 AS k, count(*) OVER (PARTITION BY vid) AS m FROM w WHERE bf IS NOT NULL),
gp AS (SELECT vid, dd AS gap FROM sg WHERE k = least(m - 1, floor(m * 0.5))),
rm AS (SELECT *, n - row_number() OVER (PARTITION BY vid ORDER BY n) AS run FROM w WHERE n % 23 BETWEEN 4 AND 15),
en AS (SELECT rm.vid, run, min(n) AS first, coalesce(min_by(struct_pack(v := bf), n).v, min(tc) - coalesce(max(gap), 1e0/30)) AS t0, coalesce(max_by(struct_pack(v := af), n).v, max(tc) + coalesce(max(gap), 1e0/30)) AS t1 FROM rm LEFT JOIN gp ON gp.vid = rm.vid GROUP BY rm.vid, run),
y AS (SELECT rm.vid, first, n, tc, t0, t1, row_number() OVER (PARTITION BY rm.vid, first ORDER BY n) AS k FROM rm JOIN en ON en.vid = rm.vid AND en.run = rm.run),
r AS (SELECT vid, first, n, k, CASE WHEN tc - t0 >= 0.175e0 - 1e-9 AND t1 - tc >= 0.175e0 - 1e-9 THEN tc ELSE t0 END AS last, tc - t0 >= 0.175e0 - 1e-9 AND t1 - tc >= 0.175e0 - 1e-9 AS shows FROM y WHERE k = 1
  UNION ALL SELECT y.vid, y.first, y.n, y.k, CASE WHEN y.tc - last >= 0.175e0 - 1e-9 AND t1 - y.tc >= 0.175e0 - 1e-9 THEN y.tc ELSE last END, y.tc - last >= 0.175e0 - 1e-9 AND t1 - y.tc >= 0.175e0 - 1e-9
  FROM r JOIN y ON y.vid = r.vid AND y.first = r.first AND y.k = r.k + 1)
SELECT vid, first, n FROM r WHERE shows"""
)
def gap_frames(spark: SparkSession, d: str) -> DataFrame:
    """Frames that long runs of removed ones have room for, 0.175 seconds apart."""
    rows = stored(clocked(spark, d).select("vid", "n", "tc", "x"), "series")
    runs = restore.pulses(rows, rows.where("n % 23 BETWEEN 4 AND 15"), ["vid"])
    return restore.gap_frames(runs, restore.frame_gaps(rows, ["vid"]), ["vid"], 0.175).select("vid", "first", "n")


#: Four sections of a second a video, edited by row numbers; one in three videos has an unedited one.
SECTIONS = f"""{CLOCK}, b AS (SELECT vid, min(t) AS first, max(t) AS last FROM c GROUP BY vid),
sec AS (SELECT vid, id, first + 0.5e0 + 1.5e0 * id AS s, first + 1.5e0 + 1.5e0 * id AS e FROM b, (SELECT unnest(range(0, 4)) AS id)),
own AS (SELECT sec.vid, id, n, t, x, t - lag(t) OVER w AS step, min(t) OVER (PARTITION BY sec.vid, id) AS base, n % 11 = 4 AS ext,
    CASE WHEN n % 5 <> 2 THEN x END AS stays FROM sec JOIN c ON c.vid = sec.vid AND t >= s - 1e-9 AND t < e - 1e-9 WINDOW w AS (PARTITION BY sec.vid, id ORDER BY n)),
ed AS (SELECT vid, id, n, ext, t - base + 0.5e0 * coalesce(sum(CAST(ext AS INT)) OVER (PARTITION BY vid, id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS shown,
    coalesce(last_value(stays IGNORE NULLS) OVER (PARTITION BY vid, id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), x) AS x FROM own WHERE NOT (vid % 3 = 0 AND id = 2)),
en AS (SELECT vid, id, min(shown) AS opens, max(shown) AS closes, max_by(CASE WHEN ext THEN 0.5e0 ELSE 0e0 END, n) AS held FROM ed GROUP BY vid, id),
md AS (SELECT sec.vid, sec.id, coalesce(median(CASE WHEN step > 0 THEN step END), 1e0/30) AS dt FROM sec LEFT JOIN own ON own.vid = sec.vid AND own.id = sec.id GROUP BY sec.vid, sec.id),
wi AS (SELECT sec.vid, id, 'lead' AS side, greatest(first, s - 4.5e0) AS lo, s AS hi FROM sec JOIN b ON b.vid = sec.vid
  UNION ALL SELECT sec.vid, id, 'tail', e, least(last, e + 4.5e0) FROM sec JOIN b ON b.vid = sec.vid),
nb AS (SELECT wi.*, o.id AS other, o.s AS os, o.e AS oe, row_number() OVER (PARTITION BY wi.vid, wi.id, side ORDER BY o.s) - 1 AS k,
    greatest(lo, coalesce(max(o.e) OVER (PARTITION BY wi.vid, wi.id, side ORDER BY o.s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS cur
  FROM wi JOIN sec o ON o.vid = wi.vid AND o.id <> wi.id AND o.e > lo + 1e-6 AND o.s < hi - 1e-6),
rg AS (SELECT vid, id, side, 2 * k AS part, cur AS lo, os AS hi FROM nb
  UNION ALL SELECT nb.vid, nb.id, side, 2 * k + 1, greatest(cur, os), least(hi, oe) FROM nb WHERE NOT EXISTS (SELECT 1 FROM en WHERE en.vid = nb.vid AND en.id = nb.other)
  UNION ALL SELECT wi.vid, wi.id, wi.side, 2 * count(nb.k), greatest(any_value(wi.lo), coalesce(max(oe), any_value(wi.lo))), any_value(wi.hi)
    FROM wi LEFT JOIN nb ON nb.vid = wi.vid AND nb.id = wi.id AND nb.side = wi.side GROUP BY wi.vid, wi.id, wi.side),
cx AS (SELECT rg.vid, id, side, part, c.t, c.x FROM rg JOIN c ON c.vid = rg.vid AND c.t >= lo - 1e-6 AND c.t < hi - 1e-6 WHERE lo < hi
  UNION ALL SELECT nb.vid, nb.id, side, 2 * k + 1, ed.shown, ed.x FROM nb JOIN en ON en.vid = nb.vid AND en.id = nb.other JOIN ed ON ed.vid = en.vid AND ed.id = en.id
    WHERE CASE WHEN side = 'lead' THEN ed.shown > closes - 4.5e0 ELSE ed.shown < opens + 4.5e0 END),
pt AS (SELECT cx.vid, cx.id, side, part, min(t) AS base, max(t) - min(t) + any_value(dt) AS len, any_value(dt) AS dt FROM cx JOIN md ON md.vid = cx.vid AND md.id = cx.id GROUP BY cx.vid, cx.id, side, part),
pa AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY vid, id, side ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS at0, sum(len) OVER (PARTITION BY vid, id, side) AS total FROM pt),
cm AS (SELECT cx.vid, cx.id, cx.side, CASE WHEN cx.side = 'lead' THEN at0 + t - base - total ELSE closes + held + dt + at0 + t - base END AS tc, cx.x
  FROM cx JOIN pa ON pa.vid = cx.vid AND pa.id = cx.id AND pa.side = cx.side AND pa.part = cx.part JOIN en ON en.vid = cx.vid AND en.id = cx.id
  UNION ALL SELECT vid, id, 'own', shown, x FROM ed)"""


def edited_sections(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(frames, sections, edited, tails) as in SECTIONS."""
    frames = stored(clocked(spark, d).select(F.col("vid").alias("video"), "n", "t", "x"), "series")
    first = frames.groupBy("video").agg(F.min("t").alias("first"))
    sections = first.select("video", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")).alias("id"), "first")
    sections = stored(sections.select("video", "id", (F.col("first") + 0.5 + 1.5 * F.col("id")).alias("start"), (F.col("first") + 1.5 + 1.5 * F.col("id")).alias("end")), "sections")
    by = Window.partitionBy("video", "id").orderBy("n")
    spans = sections.select("video", F.col("start").alias("s"), F.col("end").alias("e"), "id")
    own = frames.join(spans, "video").where("t >= s - 1e-9 AND t < e - 1e-9 AND NOT (video % 3 = 0 AND id = 2)")
    held = F.sum((F.col("n") % 11 == 4).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    stays = F.last(F.when(F.col("n") % 5 != 2, F.col("x")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    base = F.min("t").over(Window.partitionBy("video", "id"))
    edited = own.select("video", "id", "n", (F.col("t") - base + 0.5 * F.coalesce(held, F.lit(0))).alias("shown"), F.coalesce(stays, "x").alias("x"))
    edited = stored(edited, "edited-sections")
    tails = edited.groupBy("video", "id").agg(F.max_by(F.when(F.col("n") % 11 == 4, 0.5).otherwise(0.0), "n").alias("held"))
    return frames, sections, edited.drop("n"), tails


@query(f"WITH {SECTIONS} SELECT vid AS video, id, side, {US.format('tc')} AS tc_us, CAST(round(x*1e6) AS BIGINT) AS x_e6 FROM cm")
def composed_sections(spark: SparkSession, d: str) -> DataFrame:
    """Every edited section with its run-up and run-out, as an export will show them."""
    made = checks.composed(*edited_sections(spark, d), PROFILES["wcag"].context_seconds)
    return made.select("video", "id", "side", us("tc").alias("tc_us"), F.round(F.col("x") * 1e6).cast("long").alias("x_e6"))


@query(None)
def section_checks(spark: SparkSession, d: str) -> DataFrame:
    """Whether every edited section passes beside its neighbours' edits; held against a loop in the tests."""
    return checks.check(*edited_sections(spark, d), PROFILES["wcag"])


@query(
    f"""WITH RECURSIVE {CLOCK}, wt AS (SELECT vid, i, i * 0.15e0 AS at FROM (SELECT vid, unnest(range(0, CAST(floor(max(tc) / 0.15e0) AS BIGINT) + 2)) AS i FROM c GROUP BY vid)),
pk AS (SELECT vid, CAST(0 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS k, CAST(-1 AS BIGINT) AS used, CAST(NULL AS DOUBLE) AS t FROM c WHERE n = 0
  UNION ALL SELECT vid, i + 1, k2, CASE WHEN earlier THEN k2 - 1 ELSE k2 END, CASE WHEN earlier THEN bt ELSE kt END
  FROM (SELECT pk.vid, pk.i, a.n AS k2, a.tc AS kt, b.tc AS bt, coalesce(pk.used <> a.n - 1 AND abs(b.tc - w.at) < abs(a.tc - w.at), false) AS earlier
    FROM pk JOIN wt w ON w.vid = pk.vid AND w.i = pk.i
    JOIN LATERAL (SELECT n, tc FROM c WHERE c.vid = pk.vid AND c.n > pk.k AND c.tc + 1e-9 >= w.at ORDER BY n LIMIT 1) a ON true
    LEFT JOIN c b ON b.vid = pk.vid AND b.n = a.n - 1))
SELECT vid, i - 1 AS i, used AS place, {US.format('t')} AS t_us FROM pk WHERE i > 0"""
)
def picked_pictures(spark: SparkSession, d: str) -> DataFrame:
    """The frame that shows each moment of a grid of 0.15 seconds, none twice."""
    frames = stored(clocked(spark, d).select("vid", F.col("n").alias("place"), F.col("tc").alias("t")), "series")
    ends = frames.groupBy("vid").agg((F.floor(F.max("t") / 0.15) + 1).alias("last"))
    wanted = ends.select("vid", F.explode(F.sequence(F.lit(0), "last")).alias("i")).withColumn("at", F.col("i") * 0.15)
    return edits.pick_pictures(wanted, frames, ["vid"]).select("vid", "i", "place", us("t").alias("t_us"))


@query(
    f"""WITH lay AS ({ORACLES['export_layout']}), pt AS (SELECT DISTINCT o_custkey AS vid, CAST(o_orderkey % 3000 AS DOUBLE) AS "at" FROM orders),
en AS (SELECT vid, max(placed + b - a + extra) AS ends FROM lay GROUP BY vid)
SELECT pt.vid, pt."at", coalesce(piece, '') AS piece, coalesce(pt."at" - placed, -1) AS "into", coalesce(a + pt."at" - placed, -1) AS source
FROM pt LEFT JOIN (lay JOIN en USING (vid)) l ON l.vid = pt.vid AND pt."at" >= placed AND (pt."at" < placed + b - a + extra OR pt."at" = ends AND placed + b - a + extra = ends)"""
)
def export_located(spark: SparkSession, d: str) -> DataFrame:
    """Which piece of an export holds a moment, how far into it, and where in the source that is; none and -1 past the end."""
    points = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("vid"), (F.col("o_orderkey") % 3000).cast("double").alias("at"))
    points = flashes.spread(points, "vid").distinct()  # each task tells its own users' moments apart; small rows aren't gathered in few tasks
    return edits.locate(points, export_layout(spark, d), ["vid"], "at").fillna(-1.0, ["into", "source"]).fillna("", ["piece"])
