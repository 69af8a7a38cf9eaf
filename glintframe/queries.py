"""Queries over the star-schema and event tables, and the same rows in DuckDB SQL.

Every user's events are one series: x = value / 100 up to 1, and one second stands for four days.
Times are returned as whole microseconds, severities as hundredths, so both engines agree exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.config import PROFILES
from glintframe.functions import colour, times
from glintframe.operators import clock, edits, flashes, packets, signatures
from glintframe.operators import intervals as V
from glintframe.tables import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def us(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) * 1e6).cast("long")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def series(spark: SparkSession, d: str) -> DataFrame:
    # Renamed before the window, so that one shuffle by vid serves it and all that follow.
    rows = flashes.spread(table(spark, d, "events").withColumnRenamed("user_id", "vid"), "vid")
    n = F.row_number().over(Window.partitionBy("vid").orderBy("ts", "event_id")) - 1
    rows = rows.withColumn("n", n.cast("long"))
    t = (micros("ts") - 1577836800000000).cast("double") / 345600e6
    return rows.select("vid", "n", t.alias("t"), F.least(F.col("value") / 100, F.lit(1.0)).alias("x"), "event_type")


SERIES = """s AS (SELECT user_id AS vid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n,
  CAST(epoch_us(ts) - 1577836800000000 AS DOUBLE) / 345600e6 AS t, least(value / 100, 1e0) AS x, event_type FROM events)"""
#: Clock time tc and anomaly of every row.
CLOCK = (
    SERIES
    + """, d AS (SELECT *, t - lag(t) OVER (PARTITION BY vid ORDER BY n) AS dt FROM s),
g AS (SELECT *, dt > 0 AND dt <= 0.4e0 AS good FROM d),
m AS (SELECT vid, n, quantile_cont(dt, 0.5) OVER (PARTITION BY vid ORDER BY n ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS med FROM g WHERE good),
k AS (SELECT g.*, last_value(med IGNORE NULLS) OVER (PARTITION BY g.vid ORDER BY g.n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm
      FROM g LEFT JOIN m ON m.vid = g.vid AND m.n = g.n),
c AS (SELECT vid, n, t, x, event_type, sum(CASE WHEN dt IS NULL THEN 0e0 WHEN good THEN dt ELSE coalesce(pm, 1e0/30) END)
        OVER (PARTITION BY vid ORDER BY n ROWS UNBOUNDED PRECEDING) AS tc, CAST(dt IS NOT NULL AND NOT good AS INT) AS anomaly FROM k)"""
)
US = "CAST(round(({})*1e6) AS BIGINT)"


def clocked(spark: SparkSession, d: str) -> DataFrame:
    return clock.monotonic_clock(series(spark, d), ["vid"], max_gap=0.4)


@query(f"WITH {CLOCK} SELECT vid, n, {US.format('tc')} AS tc_us, anomaly FROM c")
def monotonic_clock(spark, d):
    return clocked(spark, d).select("vid", "n", us("tc").alias("tc_us"), "anomaly")


@query(
    f"""WITH {CLOCK}, p AS (SELECT vid, tc + 0.05e0 AS at FROM c)
SELECT p.vid, {US.format('p.at')} AS at_us, CAST(round((CASE WHEN b.tc IS NULL OR a.tc >= b.tc THEN a.t ELSE a.t + (b.t - a.t) * ((p.at - a.tc) / (b.tc - a.tc)) END)*1e4) AS BIGINT) AS native_e4
FROM p LEFT JOIN LATERAL (SELECT tc, t FROM c WHERE c.vid = p.vid AND c.tc <= p.at ORDER BY tc DESC, n DESC LIMIT 1) a ON true
LEFT JOIN LATERAL (SELECT tc, t FROM c WHERE c.vid = p.vid AND c.tc >= p.at ORDER BY tc, n LIMIT 1) b ON true"""
)
def to_native(spark, d):
    frames = clocked(spark, d)
    points = frames.select("vid", (F.col("tc") + 0.05).alias("at"))
    made = clock.to_native(points, frames, ["vid"], "at")
    return made.select("vid", us("at").alias("at_us"), F.round(F.col("native") * 1e4).cast("long").alias("native_e4"))


#: The fold over runs and opposing pairs, one row at a time.
FOLD = (
    CLOCK
    + """, r AS (
  SELECT vid, n, tc, x, 0 AS dir, x AS base, x AS far, tc AS since, 0 AS pend, -1e18 AS pend_t, 0 AS tr, false AS flash,
         [-1e18, -1e18, -1e18, -1e18] AS ring, CAST(NULL AS DOUBLE) AS opened FROM c WHERE n = 0
  UNION ALL SELECT vid, n, tc, x, dir2,
    CASE WHEN tc - since2 > 2 THEN CASE WHEN dir2 = 0 THEN x ELSE far2 END ELSE base2 END,
    CASE WHEN tc - since2 > 2 AND dir2 = 0 THEN x ELSE far2 END,
    CASE WHEN tc - since2 > 2 THEN tc ELSE since2 END,
    CASE WHEN fl THEN 0 WHEN q <> 0 THEN q ELSE pend END, CASE WHEN fl THEN -1e18 WHEN q <> 0 THEN tc ELSE pend_t END,
    q, fl, CASE WHEN fl THEN [tc, ring[1], ring[2], ring[3]] ELSE ring END, CASE WHEN fl THEN pend_t END
  FROM (SELECT *, q <> 0 AND pend = -q AND tc - pend_t <= 1 AS fl,
          CASE WHEN pk OR tg THEN ext ELSE base END AS base2, CASE WHEN pk OR tg OR rs OR fs THEN x ELSE ext END AS far2,
          CASE WHEN pk OR tg THEN tc ELSE since END AS since2, CASE WHEN pk OR fs THEN -1 WHEN tg OR rs THEN 1 ELSE dir END AS dir2
        FROM (SELECT *, CASE WHEN pk AND ext - base >= 0.1e0 AND base < 0.8e0 THEN 1 WHEN tg AND base - ext >= 0.1e0 AND ext < 0.8e0 THEN -1 ELSE 0 END AS q
              FROM (SELECT *, dir = 1 AND x < ext - 0.02e0 AS pk, dir = -1 AND x > ext + 0.02e0 AS tg,
                      dir = 0 AND x > base + 0.02e0 AS rs, dir = 0 AND x < base - 0.02e0 AS fs
                    FROM (SELECT c.vid, c.n, c.tc, c.x, r.dir, r.base, r.since, r.pend, r.pend_t, r.ring,
                            CASE WHEN r.dir = 1 THEN greatest(r.far, c.x) WHEN r.dir = -1 THEN least(r.far, c.x) ELSE r.far END AS ext
                          FROM r JOIN c ON c.vid = r.vid AND c.n = r.n + 1)))))"""
)


def folded(spark: SparkSession, d: str) -> DataFrame:
    return flashes.series_flashes(clocked(spark, d), ["vid"])


@query(f"WITH RECURSIVE {FOLD} SELECT vid, n, tr AS transition, flash, coalesce({US.format('opened')}, -1) AS opened_us, tc - ring[1] <= 0.125e0 AND tc - ring[4] < 0.999e0 AS strobing FROM r")
def run_tracker_and_pairs(spark, d):
    return folded(spark, d).select("vid", "n", "transition", "flash", F.coalesce(us("opened"), F.lit(-1)).alias("opened_us"), "strobing")


@query(
    f"""WITH RECURSIVE {FOLD}, f AS (SELECT vid, n, tc FROM r WHERE flash)
SELECT vid, n, coalesce({US.format('tc - lag(tc, 3) OVER (PARTITION BY vid ORDER BY n)')}, -1) AS age_us FROM f"""
)
def nth_flash_age(spark, d):
    return flashes.nth_flash_age(folded(spark, d).where("flash"), ["vid"], 4).select("vid", "n", F.coalesce(us("age"), F.lit(-1)).alias("age_us"))


#: Areas of each row, as a detector's frame statistics: all from the value, so that both engines agree.
STATS = (
    CLOCK
    + """, st AS (SELECT vid, n, t, tc, CAST(floor(x * 400) AS INT) AS area, CAST(floor(x * x * 500) AS INT) AS red, CAST(floor((1 - x) * 300) AS INT) AS pattern, t - 0.01e0 AS onset FROM c)"""
)


def stats(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    return clocked(spark, d).select("vid", "n", "t", "tc", F.floor(x * 400).cast("int").alias("area"), F.floor(x * x * 500).cast("int").alias("red"), F.floor((1 - x) * 300).cast("int").alias("pattern"), (F.col("t") - 0.01).alias("onset"))


def islands_sql(where: str, gap: str, order: str = "n", by: str = "vid") -> str:
    """Rows of ``st`` with an island number i."""
    return f"""(SELECT *, sum(CASE WHEN tc - p <= {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {by} ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS i
FROM (SELECT *, lag(tc) OVER (PARTITION BY {by} ORDER BY {order}) AS p FROM st WHERE {where}))"""


STROBES = f"""v AS (SELECT vid, i, min_by(t, n) AS s, max(t) AS e, max(sev) AS sev, min(least(t, onset)) AS onset, min_by(t, (-sev, n)) AS peak
FROM (SELECT *, round_even(CAST(area AS DOUBLE) / 200 * 100, 0) / 100 AS sev FROM {islands_sql('area >= 200', '0.2e0')}) GROUP BY vid, i)"""


def strobes(spark: SparkSession, d: str) -> DataFrame:
    return V.strobe_violations(stats(spark, d), ["vid"], 200, gap=0.2)


@query(f"WITH {STATS}, {STROBES} SELECT vid, {US.format('s')} AS start_us, {US.format('e')} AS end_us, CAST(round(sev*100) AS BIGINT) AS severity, {US.format('onset')} AS onset_us, {US.format('peak')} AS peak_us FROM v")
def strobe_violations(spark, d):
    return strobes(spark, d).select("vid", us("start").alias("start_us"), us("end").alias("end_us"), F.round(F.col("severity") * 100).cast("long").alias("severity"), us("onset").alias("onset_us"), us("peak").alias("peak_us"))


@query(
    f"""WITH {STATS}, fr AS (SELECT vid, quantile_cont(dd, 0.5) AS frame FROM (SELECT vid, tc - lag(tc) OVER (PARTITION BY vid ORDER BY n) AS dd FROM st) WHERE dd > 0 GROUP BY vid),
v AS (SELECT vid, i, min(t) AS s, max(t) AS e, max(tc) - min(tc) AS lasts, max(sev) AS sev, min_by(t, (-sev, n)) AS peak
FROM (SELECT *, round_even(CAST(pattern AS DOUBLE) / 120 * 100, 0) / 100 AS sev FROM {islands_sql('pattern >= 120', '0.3e0')}) GROUP BY vid, i)
SELECT vid, {US.format('s')} AS start_us, {US.format('e')} AS end_us, CAST(round(sev*100) AS BIGINT) AS severity, {US.format('peak')} AS peak_us
FROM v LEFT JOIN fr USING (vid) WHERE lasts + coalesce(frame, 1e0/30) >= 0.5e0"""
)
def pattern_violations(spark, d):
    made = V.pattern_violations(stats(spark, d), ["vid"], 120, hold=0.3)
    return made.select("vid", us("start").alias("start_us"), us("end").alias("end_us"), F.round(F.col("severity") * 100).cast("long").alias("severity"), us("peak").alias("peak_us"))


def warn_sql(name: str, th: int) -> str:
    return f"""{name} AS (SELECT vid, i, min(t) AS s, max(t) AS e, max(sev) AS sev, min_by(struct_pack(t := t, kind := CASE WHEN red > area THEN 'red' ELSE 'flash' END), (-sev, n)) AS w
FROM (SELECT *, round_even(CAST(greatest(area, red) AS DOUBLE) / {th} * 100, 0) / 100 AS sev FROM {islands_sql(f'greatest(area, red) >= {th}', '1e0')}) GROUP BY vid, i)"""


@query(
    f"""WITH {STATS}, {STROBES}, {warn_sql('lim', 380)}, {warn_sql('str', 300)},
loud AS (SELECT vid, least(onset, s) AS s, e FROM v WHERE sev >= 1.9),
kept AS (SELECT * FROM lim WHERE NOT EXISTS (SELECT 1 FROM loud l WHERE l.vid = lim.vid AND lim.s <= l.e AND lim.e >= l.s)),
more AS (SELECT * FROM str WHERE NOT EXISTS (SELECT 1 FROM (SELECT vid, s, e FROM loud UNION ALL SELECT vid, s, e FROM kept) l WHERE l.vid = str.vid AND str.s <= l.e AND str.e >= l.s))
SELECT vid, 'limit' AS level, w.kind AS kind, {US.format('s')} AS start_us, {US.format('e')} AS end_us, CAST(round(sev*100) AS BIGINT) AS severity, {US.format('w.t')} AS peak_us FROM kept
UNION ALL SELECT vid, 'strict', w.kind, {US.format('s')}, {US.format('e')}, CAST(round(sev*100) AS BIGINT), {US.format('w.t')} FROM more"""
)
def close_calls(spark, d):
    st = stored(stats(spark, d), "stats")  # read by every branch
    found = V.strobe_violations(st, ["vid"], 200, gap=0.2).where("severity >= 1.9")
    limit, strict = (V.warning_spans(st, ["vid"], th, "area", "red") for th in (380, 300))
    made = V.close_calls(limit, strict, found, ["vid"])
    return made.select("vid", "level", "kind", us("start").alias("start_us"), us("end").alias("end_us"), F.round(F.col("severity") * 100).cast("long").alias("severity"), us("peak").alias("peak_us"))


@query(
    f"""WITH {STATS}, hits AS (SELECT vid, tc AS h FROM st WHERE greatest(area, red) >= 330),
b AS (SELECT vid, min(tc) AS lo, max(tc) AS hi FROM st GROUP BY vid),
raw AS (SELECT vid, h AS s, least(h + 1e0, hi) AS e FROM hits JOIN b USING (vid) WHERE least(h + 1e0, hi) > h),
isl AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY vid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM raw),
g2 AS (SELECT *, sum(nw) OVER (PARTITION BY vid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM isl),
lit AS (SELECT vid, min(s) AS a, max(e) AS z FROM g2 GROUP BY vid, i),
w AS (SELECT vid, lo, CASE WHEN hi - lo >= 5e0 THEN 5e0 ELSE hi - lo END AS wd, CASE WHEN hi - lo >= 5e0 THEN hi - 5e0 ELSE lo END AS xh FROM b WHERE hi - lo >= 4.5e0),
xs AS (SELECT vid, lo AS x FROM w UNION SELECT vid, xh FROM w UNION SELECT vid, a FROM lit UNION SELECT lit.vid, z - wd FROM lit JOIN w ON w.vid = lit.vid),
cand AS (SELECT xs.vid, x, wd FROM xs JOIN w ON w.vid = xs.vid WHERE x >= lo AND x <= xh),
cov AS (SELECT c.vid, c.x, sum(greatest(0e0, least(z, x + wd) - greatest(a, x))) / max(wd) AS frac, min(CASE WHEN z > x THEN greatest(a, x) END) AS s, max(CASE WHEN a < x + wd THEN least(z, x + wd) END) AS e
  FROM cand c JOIN lit ON lit.vid = c.vid GROUP BY c.vid, c.x),
ok AS (SELECT * FROM cov WHERE frac >= 0.8e0 AND e > s),
i2 AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY vid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM ok),
g3 AS (SELECT *, sum(nw) OVER (PARTITION BY vid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM i2),
m2 AS (SELECT vid, min(s) AS s, max(e) AS e FROM g3 GROUP BY vid, i)
SELECT m2.vid, {US.format('s')} AS start_us, {US.format('max(h)')} AS end_us FROM m2 JOIN hits ON hits.vid = m2.vid AND h <= e GROUP BY m2.vid, s, e"""
)
def extended_flashes(spark, d):
    st = stored(stats(spark, d), "stats").withColumnsRenamed({"area": "ext", "red": "ext_red"})
    return V.extended_flashes(st, ["vid"], 330).select("vid", us("start").alias("start_us"), us("end").alias("end_us"))


@query(
    f"""WITH {STATS}, {STROBES}, b AS (SELECT vid, max(t) AS dur FROM st GROUP BY vid),
q AS (SELECT vid, dur, CASE WHEN sev >= 1.8 THEN 'red' ELSE 'flash' END AS kind, greatest(0e0, least(onset, s) - 0.3e0) AS s, least(dur, e + 0.3e0) AS e FROM v JOIN b USING (vid)),
q2 AS (SELECT vid, dur, kind, CASE WHEN e - s < 1e0 THEN greatest(0e0, (s + e) / 2 - 0.5e0) ELSE s END AS s, CASE WHEN e - s < 1e0 THEN least(dur, (s + e) / 2 + 0.5e0) ELSE e END AS e FROM q),
q3 AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY vid ORDER BY s, e, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0.2e0 THEN 0 ELSE 1 END AS nw FROM q2),
q4 AS (SELECT *, sum(nw) OVER (PARTITION BY vid ORDER BY s, e, kind ROWS UNBOUNDED PRECEDING) AS i FROM q3),
q5 AS (SELECT vid, min(s) AS s, max(e) AS e, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, CAST(greatest(1, ceil((max(e) - min(s)) / 4e0)) AS INT) AS parts FROM q4 GROUP BY vid, i)
SELECT vid, kinds, {US.format('s + (e - s) / parts * k')} AS start_us, {US.format('CASE WHEN k = parts - 1 THEN e ELSE s + (e - s) / parts * (k + 1) END')} AS end_us
FROM (SELECT *, unnest(range(0, parts)) AS k FROM q5)"""
)
def work_sections(spark, d):
    st = stored(stats(spark, d), "stats")
    lasts = st.groupBy("vid").agg(F.max("t").alias("dur"))
    found = V.strobe_violations(st, ["vid"], 200, gap=0.2).withColumn("kind", F.when(F.col("severity") >= 1.8, "red").otherwise("flash")).join(lasts, "vid")
    made = V.sections(found, ["vid"], "dur", pad=0.3, gap=0.2, least=1.0, most=4.0)
    return made.select("vid", "kinds", us("start").alias("start_us"), us("end").alias("end_us"))


ORDER_SPANS = """o AS (SELECT o_custkey AS vid, o_orderkey AS id, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) AS s, CAST(epoch_us(o_orderdate) // 86400000000 AS BIGINT) + 20 + o_orderkey % 90 AS e FROM orders)"""


def order_spans(spark: SparkSession, d: str) -> DataFrame:
    day = F.floor(micros("o_orderdate") / 86400000000).cast("long")
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("vid"), F.col("o_orderkey").alias("id"), day.alias("start"), (day + 20 + F.col("o_orderkey") % 90).alias("end"))
    return flashes.spread(rows, "vid")


MERGED = """mi AS (SELECT *, CASE WHEN s - max(e) OVER (PARTITION BY vid ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 0 THEN 0 ELSE 1 END AS nw FROM o WHERE e > s),
mj AS (SELECT *, sum(nw) OVER (PARTITION BY vid ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS i FROM mi),
merged AS (SELECT vid, min(s) AS s, max(e) AS e, count(*) AS parts FROM mj GROUP BY vid, i)"""


@query(f"WITH {ORDER_SPANS}, {MERGED} SELECT vid, s AS start, e AS \"end\", parts FROM merged")
def merge_spans(spark, d):
    return V.merge_spans(order_spans(spark, d), ["vid"])


@query(
    f"""WITH {ORDER_SPANS}, {MERGED}, x AS (SELECT vid, s AS x FROM o)
SELECT x.vid, x.x, CAST(sum(greatest(0, least(m.e, x + 365) - greatest(m.s, x))) AS BIGINT) AS covered, CAST(min(CASE WHEN m.e > x THEN greatest(m.s, x) END) AS BIGINT) AS opens, CAST(max(CASE WHEN m.s < x + 365 THEN least(m.e, x + 365) END) AS BIGINT) AS closes
FROM (SELECT DISTINCT * FROM x) x JOIN merged m ON m.vid = x.vid GROUP BY x.vid, x.x"""
)
def span_coverage(spark, d):
    spans = order_spans(spark, d)
    at = spans.select("vid", F.col("start").alias("x")).distinct()
    made = V.coverage(at, V.merge_spans(spans, ["vid"]), ["vid"], F.lit(365))
    return made.select("vid", "x", F.col("covered").cast("long").alias("covered"), F.col("start").alias("opens"), F.col("end").alias("closes"))


@query(
    f"""WITH {ORDER_SPANS}, {MERGED}, mk AS (SELECT DISTINCT vid, s AS mark FROM o WHERE id % 2 = 0)
SELECT m.vid, m.s AS start, m.e AS "end", coalesce(max(CASE WHEN mark <= m.s THEN mark END), m.s) AS snap_start, coalesce(min(CASE WHEN mark >= m.e THEN mark END), m.e) AS snap_end
FROM merged m LEFT JOIN mk ON mk.vid = m.vid GROUP BY m.vid, m.s, m.e"""
)
def snap_to_keyframes(spark, d):
    spans = order_spans(spark, d)
    marks = spans.where("id % 2 = 0").select("vid", F.col("start").alias("mark")).distinct()
    made = V.snap_to_marks(V.merge_spans(spans, ["vid"]).drop("parts"), marks, ["vid"])
    return made.select("vid", "start", "end", "snap_start", "snap_end")


@query(
    """WITH e AS (SELECT user_id AS vid, event_type AS kind, CAST(floor(CAST(epoch_us(ts) - 1577836800000000 AS DOUBLE) / 1e6 / 864000) AS BIGINT) AS bin FROM events),
b AS (SELECT vid, unnest(range(min(bin), max(bin) + 1)) AS bin FROM e GROUP BY vid)
SELECT b.vid, b.bin, count(*) FILTER (WHERE kind = 'click') AS click, count(*) FILTER (WHERE kind = 'view') AS view, count(*) FILTER (WHERE kind = 'purchase') AS purchase
FROM b LEFT JOIN e ON e.vid = b.vid AND e.bin = b.bin GROUP BY b.vid, b.bin"""
)
def timeline_bins(spark, d):
    rows = table(spark, d, "events").select(F.col("user_id").alias("vid"), F.col("event_type").alias("kind"), ((micros("ts") - 1577836800000000).cast("double") / 1e6).alias("t"))
    return V.timeline(rows, ["vid"], "t", 864000, ["click", "view", "purchase"])


@query(
    f"WITH {SERIES}, u AS (SELECT vid, n, {US.format('t')} AS t_us, x FROM s) SELECT vid, n, CAST(round(max(x) OVER (PARTITION BY vid ORDER BY t_us RANGE BETWEEN 250000 PRECEDING AND 250000 FOLLOWING)*1e6) AS BIGINT) AS envelope_e6 FROM u"
)
def limit_envelope(spark, d):
    rows = series(spark, d).select("vid", "n", us("t").alias("t_us"), "x")
    return V.envelope(rows, ["vid"], "t_us", "x").select("vid", "n", us("envelope").alias("envelope_e6"))


@query(f"WITH {ORDER_SPANS} SELECT vid, id, s AS start, e AS \"end\" FROM o WHERE id % 2 = 0 AND EXISTS (SELECT 1 FROM o b WHERE b.vid = o.vid AND b.id % 2 = 1 AND o.s <= b.e + 7 AND o.e >= b.s - 7)")
def stale_neighbours(spark, d):
    spans = order_spans(spark, d)
    return V.reached(spans.where("id % 2 = 0"), spans.where("id % 2 = 1"), ["vid"], 7)


@query(f"WITH {STATS}, {STROBES} SELECT vid, n FROM st WHERE EXISTS (SELECT 1 FROM v WHERE v.vid = st.vid AND st.t >= least(v.onset, v.s) - 0.05e0 AND st.t <= v.e + 0.05e0)")
def flagged_frames(spark, d):
    return edits.flagged_frames(stats(spark, d), strobes(spark, d), ["vid"]).select("vid", "n")


EDITS = f"""{SERIES}, f AS (SELECT vid, n AS ord, t - first_value(t) OVER (PARTITION BY vid ORDER BY n) AS rel, x < 0.1e0 OR (x > 0.3e0 AND x < 0.4e0) AS removed, x > 0.8e0 AS extended, CASE WHEN n % 2 = 0 THEN 'prev' ELSE 'next' END AS fill, x FROM s)"""


def edited(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("x")
    first = F.first("t").over(Window.partitionBy("vid").orderBy("n"))
    return series(spark, d).select("vid", F.col("n").alias("ord"), (F.col("t") - first).alias("rel"), ((x < 0.1) | ((x > 0.3) & (x < 0.4))).alias("removed"), (x > 0.8).alias("extended"), F.when(F.col("n") % 2 == 0, "prev").otherwise("next").alias("fill"), "x")


SHOWN = """q AS (SELECT *, CASE WHEN fill = 'next' THEN coalesce(nx, pv, 0) ELSE coalesce(pv, nx, 0) END AS source,
  rel + coalesce(sum(CASE WHEN extended AND NOT removed THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY vid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS shown
FROM (SELECT *, max(CASE WHEN NOT removed THEN ord END) OVER (PARTITION BY vid ORDER BY ord ROWS UNBOUNDED PRECEDING) AS pv,
  min(CASE WHEN NOT removed THEN ord END) OVER (PARTITION BY vid ORDER BY ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx FROM f))"""


@query(f"WITH {EDITS}, {SHOWN} SELECT vid, ord, source, {US.format('shown')} AS shown_us FROM q")
def edited_sequence(spark, d):
    return edits.edited_sequence(edits.replacement(edited(spark, d), ["vid"]), ["vid"]).select("vid", "ord", "source", us("shown").alias("shown_us"))


@query(f"WITH {EDITS}, {SHOWN} SELECT vid, source, {US.format('min(shown)')} AS first_us, count(*) AS places FROM q GROUP BY vid, source")
def picture_times(spark, d):
    shown = edits.edited_sequence(edits.replacement(edited(spark, d), ["vid"]), ["vid"])
    return edits.picture_times(shown, ["vid"]).select("vid", "source", us("first_shown").alias("first_us"), "places")


@query(
    f"""WITH {STATS}, {STROBES}, b AS (SELECT vid, max(t) / 3 AS a, max(t) * 2 / 3 AS z FROM st GROUP BY vid)
SELECT vid, {US.format('s')} AS start_us, CASE WHEN e >= a - 1e-6 AND s < z - 1e-6 THEN 'inside' WHEN s >= z - 1e-6 AND s <= z + 0.125e0 THEN 'after' WHEN e < a THEN 'before' ELSE 'elsewhere' END AS bucket FROM v JOIN b USING (vid)"""
)
def classified_violations(spark, d):
    st = stored(stats(spark, d), "stats")
    bounds = st.groupBy("vid").agg((F.max("t") / 3).alias("a"), (F.max("t") * 2 / 3).alias("z"))
    rows = V.strobe_violations(st, ["vid"], 200, gap=0.2).withColumnsRenamed({"start": "v_start", "end": "v_end"}).join(bounds, "vid")
    return edits.classified(rows, "a", "z").select("vid", us("v_start").alias("start_us"), "bucket")


@query(
    f"""WITH {SERIES}, g AS (SELECT vid, n // 10 AS span, n, x FROM s),
c AS (SELECT vid, span, quantile_cont(x, 0.15) AS lo, quantile_cont(x, 0.85) AS hi FROM g GROUP BY vid, span HAVING quantile_cont(x, 0.85) - quantile_cont(x, 0.15) >= 1e-4)
SELECT g.vid, g.n FROM g JOIN c ON c.vid = g.vid AND c.span = g.span WHERE x > lo + (hi - lo) * 0.5e0"""
)
def percentile_removals(spark, d):
    rows = series(spark, d).select("vid", F.floor(F.col("n") / 10).alias("span"), "n", "x")
    return edits.percentile_cut(rows, ["vid", "span"]).select("vid", "n")


@query(f"WITH {SERIES} SELECT vid, n // 10 AS span, min_by(n, (x, n)) AS n FROM s GROUP BY vid, n // 10")
def hold_extreme(spark, d):
    rows = series(spark, d).select("vid", F.floor(F.col("n") / 10).alias("span"), "n", "x")
    return edits.hold_extreme(rows, ["vid", "span"]).select("vid", "span", "n")


@query(
    f"""WITH {SERIES}, f AS (SELECT vid, n AS ord, x > 0.7e0 AS marked FROM s),
q AS (SELECT *, max(CASE WHEN NOT marked THEN ord END) OVER (PARTITION BY vid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
 min(CASE WHEN NOT marked THEN ord END) OVER (PARTITION BY vid ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM f),
w AS (SELECT *, CASE WHEN p IS NULL THEN 1e0 WHEN nx IS NULL THEN 0e0 ELSE CAST(ord - p AS DOUBLE) / (nx - p) END AS u FROM q WHERE marked)
SELECT vid, ord, coalesce(p, -1) AS prev, coalesce(nx, -1) AS next, {US.format('0.8e0 * (1 - u)')} AS before_e6, {US.format('0.8e0 * u')} AS after_e6 FROM w"""
)
def blend_plan(spark, d):
    rows = series(spark, d).select("vid", F.col("n").alias("ord"), (F.col("x") > 0.7).alias("marked"))
    _, before, after = edits.blend_weights(F.col("u"), 0.8)
    return edits.blend_sources(rows, ["vid"]).select("vid", "ord", F.coalesce("prev", F.lit(-1)).alias("prev"), F.coalesce("next", F.lit(-1)).alias("next"), us(before).alias("before_e6"), us(after).alias("after_e6"))


@query(
    f"""WITH RECURSIVE {SERIES}, r AS (SELECT vid, n, t, true AS kept, t AS last FROM s WHERE n = 0
UNION ALL SELECT s.vid, s.n, s.t, s.t - r.last >= 0.25e0 - 1e-9, CASE WHEN s.t - r.last >= 0.25e0 - 1e-9 THEN s.t ELSE r.last END FROM r JOIN s ON s.vid = r.vid AND s.n = r.n + 1)
SELECT vid, n, kept FROM r"""
)
def rate_limited(spark, d):
    return flashes.greedy_gaps(series(spark, d), ["vid"], "n", "t", 0.25).select("vid", "n", "kept")


@query(
    f"""WITH RECURSIVE {SERIES}, r AS (SELECT vid, n, x > 0.5e0 AS above, x > 0.5e0 AS event, CASE WHEN x > 0.5e0 THEN t ELSE -1e18 END AS last FROM s WHERE n = 0
UNION ALL SELECT s.vid, s.n, s.x > 0.5e0, s.x > 0.5e0 AND (NOT r.above OR s.t - r.last >= 0.25e0), CASE WHEN s.x > 0.5e0 AND (NOT r.above OR s.t - r.last >= 0.25e0) THEN s.t ELSE r.last END
 FROM r JOIN s ON s.vid = r.vid AND s.n = r.n + 1) SELECT vid, n, event FROM r"""
)
def debounced_events(spark, d):
    rows = series(spark, d).withColumn("active", F.col("x") > 0.5)
    return flashes.debounced(rows, ["vid"], "n", "t", "active").select("vid", "n", "event")


PACKETS = """p AS (SELECT l_suppkey AS vid, CAST(epoch_us(l_shipdate) // 86400000000 AS DOUBLE) AS t, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_linenumber = 1 AS sync,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus) AS "order" FROM lineitem)"""


def packet_rows(spark: SparkSession, d: str) -> DataFrame:
    full = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "vid")
    rows = rows.withColumn("order", F.row_number().over(Window.partitionBy("vid").orderBy(*full)).cast("long"))
    return rows.select("vid", F.floor(micros("l_shipdate") / 86400000000).cast("double").alias("t"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"), (F.col("l_linenumber") == 1).alias("sync"), "order")


@query(
    f"""WITH {PACKETS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY vid ORDER BY "order") AS dd FROM p)
SELECT vid, count(*) AS packets, count(*) FILTER (WHERE sync) AS keyframes, min(t) AS first, max(t) AS last, quantile_cont(CASE WHEN dd > 0 THEN dd END, 0.5) AS median_step,
 count(*) FILTER (WHERE dd > 0.25e0) AS holes, count(*) FILTER (WHERE dd > 5) AS jumps, count(*) FILTER (WHERE dd <= 1e-9) AS repeats, max(t) + coalesce(quantile_cont(CASE WHEN dd > 0 THEN dd END, 0.5), 1e0/30) AS ends FROM g GROUP BY vid"""
)
def packet_index(spark, d):
    return packets.index_summary(packet_rows(spark, d), ["vid"], ["order"])


@query(
    f"""WITH RECURSIVE {PACKETS}, b AS (SELECT vid, min(t) AS f, max(t) AS l FROM p GROUP BY vid),
y AS (SELECT p.vid, p."order", p.t, b.f, b.l, row_number() OVER (PARTITION BY p.vid ORDER BY p."order") AS k FROM p JOIN b ON b.vid = p.vid WHERE sync),
r AS (SELECT vid, "order", t, k, CASE WHEN t - f >= 100 AND l - t >= 50 THEN t ELSE f END AS a, t - f >= 100 AND l - t >= 50 AS starts FROM y WHERE k = 1
UNION ALL SELECT y.vid, y."order", y.t, y.k, CASE WHEN y.t - r.a >= 100 AND y.l - y.t >= 50 THEN y.t ELSE r.a END, y.t - r.a >= 100 AND y.l - y.t >= 50 FROM r JOIN y ON y.vid = r.vid AND y.k = r.k + 1)
SELECT vid, "order", t FROM r WHERE starts"""
)
def scan_chunks(spark, d):
    return packets.chunk_starts(packet_rows(spark, d), ["vid"], "order", 100.0, 50.0)


@query(
    f"""WITH {PACKETS}, c AS (SELECT *, CAST(floor(t / 200) AS BIGINT) AS chunk FROM p),
pl AS (SELECT vid, chunk, size, row_number() OVER (PARTITION BY vid, chunk ORDER BY size) - 1 AS k, count(*) OVER (PARTITION BY vid, chunk) AS m FROM c WHERE NOT sync),
up AS (SELECT vid, chunk, size AS p75 FROM pl WHERE k = least(m - 1, floor(m * 0.75))),
kl AS (SELECT vid, size, row_number() OVER (PARTITION BY vid ORDER BY size) - 1 AS k, count(*) OVER (PARTITION BY vid) AS m FROM p WHERE sync),
km AS (SELECT vid, size AS key_size FROM kl WHERE k = least(m - 1, floor(m * 0.5))),
en AS (SELECT vid, max(t) + coalesce(quantile_cont(CASE WHEN dd > 0 THEN dd END, 0.5), 0e0) AS ends FROM (SELECT *, t - lag(t) OVER (PARTITION BY vid ORDER BY "order") AS dd FROM p) GROUP BY vid),
f0 AS (SELECT c.vid, c.chunk, min(t) AS t0, sum(size) / count(*) AS weight, count(*) FILTER (WHERE sync) AS kr, count(*) FILTER (WHERE NOT sync AND size > 3 * p75) AS sr,
 count(*) FILTER (WHERE sync AND size < greatest(coalesce(key_size, 0) * 0.25e0, 0.002e0 * 1600000000)) AS fr FROM c LEFT JOIN up ON up.vid = c.vid AND up.chunk = c.chunk LEFT JOIN km ON km.vid = c.vid GROUP BY c.vid, c.chunk),
f1 AS (SELECT f0.*, greatest(coalesce(lead(t0) OVER (PARTITION BY f0.vid ORDER BY chunk), ends) - t0, 1e-3) AS secs FROM f0 JOIN en ON en.vid = f0.vid),
f AS (SELECT vid, chunk, weight, kr / secs AS kr, sr / secs AS sr, fr / secs AS fr FROM f1),
q AS (SELECT *, count(*) OVER (PARTITION BY vid) AS m,
 rank() OVER (PARTITION BY vid ORDER BY weight) - 1 + (count(*) OVER (PARTITION BY vid, weight) - 1) / 2 AS a, rank() OVER (PARTITION BY vid ORDER BY kr) - 1 + (count(*) OVER (PARTITION BY vid, kr) - 1) / 2 AS b,
 rank() OVER (PARTITION BY vid ORDER BY sr) - 1 + (count(*) OVER (PARTITION BY vid, sr) - 1) / 2 AS e, rank() OVER (PARTITION BY vid ORDER BY fr) - 1 + (count(*) OVER (PARTITION BY vid, fr) - 1) / 2 AS g FROM f),
z AS (SELECT *, CASE WHEN m > 1 THEN 0.25e0 * a / (m - 1) + 0.2e0 * b / (m - 1) + 0.3e0 * e / (m - 1) + 0.25e0 * g / (m - 1) ELSE 0.5e0 END AS score FROM q)
SELECT vid, chunk, {US.format('score')} AS score_e6, m >= 4 AND row_number() OVER (PARTITION BY vid ORDER BY round(score, 9) DESC, chunk) <= greatest(1, round(m * 0.25e0)) AS hot FROM z"""
)
def triage_chunks(spark, d):
    """Extended prices in cents are the sizes, so pictures are taken to have as many pixels as make some keyframes flat."""
    rows = packet_rows(spark, d).withColumn("chunk", F.floor(F.col("t") / 200).cast("long"))
    return packets.triage(rows, ["vid"], "chunk", 1_600_000_000).select("vid", "chunk", us("score").alias("score_e6"), "hot")


@query(
    f"""WITH {ORDER_SPANS}, g AS (SELECT vid, min(s) - 5 AS a0, CAST(max(e) + 10 AS DOUBLE) AS dur FROM o GROUP BY vid), {MERGED},
z AS (SELECT m.vid, CAST(s - a0 AS DOUBLE) AS s, CAST(e - a0 AS DOUBLE) AS e, dur - a0 AS dur, CAST(parts AS DOUBLE) AS extra FROM merged m JOIN g ON g.vid = m.vid),
w AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY vid ORDER BY s), 0e0) AS gf, lead(s) OVER (PARTITION BY vid ORDER BY s) IS NULL AS is_last FROM z),
u AS (SELECT vid, 'copy' AS piece, gf AS a, s AS b, 0e0 AS extra FROM w WHERE s - gf > 0.02 UNION ALL SELECT vid, 'encode', s, e, extra FROM w UNION ALL SELECT vid, 'copy', e, dur, 0e0 FROM w WHERE is_last AND dur - e > 0.02)
SELECT *, coalesce(sum(b - a + extra) OVER (PARTITION BY vid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0) AS placed FROM u"""
)
def export_layout(spark, d):
    spans = order_spans(spark, d)
    base = spans.groupBy("vid").agg((F.min("start") - 5).alias("a0"), (F.max("end") + 10).cast("double").alias("dur"))
    rows = V.merge_spans(spans, ["vid"]).join(base, "vid")
    rows = rows.select("vid", (F.col("start") - F.col("a0")).cast("double").alias("start"), (F.col("end") - F.col("a0")).cast("double").alias("end"), (F.col("dur") - F.col("a0")).alias("dur"), F.col("parts").cast("double").alias("extra"))
    return edits.export_layout(rows, ["vid"], "dur")


@query(
    f"""WITH {ORDER_SPANS}, {MERGED}, h AS (SELECT vid, CAST(s AS DOUBLE) + 3 AS cut, CAST(1 + id % 3 AS DOUBLE) AS seconds FROM o WHERE id % 4 = 0),
seg AS (SELECT vid, CAST(s AS DOUBLE) AS s, CAST(e AS DOUBLE) AS e FROM merged),
cuts AS (SELECT vid, s, e, s AS a FROM seg UNION SELECT seg.vid, s, e, cut FROM seg JOIN h ON h.vid = seg.vid WHERE cut > s AND cut < e),
parts AS (SELECT vid, a, coalesce(lead(a) OVER (PARTITION BY vid, s ORDER BY a), e) AS b FROM cuts)
SELECT p.vid, p.a AS start, p.b AS "end", coalesce(sum(CASE WHEN cut <= p.a THEN seconds END), 0e0) AS shift, p.a + coalesce(sum(CASE WHEN cut <= p.a THEN seconds END), 0e0) AS placed
FROM parts p LEFT JOIN h ON h.vid = p.vid GROUP BY p.vid, p.a, p.b"""
)
def sound_with_holds(spark, d):
    spans = order_spans(spark, d)
    holds = spans.where("id % 4 = 0").select("vid", (F.col("start").cast("double") + 3).alias("at"), (1 + F.col("id") % 3).cast("double").alias("seconds"))
    segments = V.merge_spans(spans, ["vid"]).select("vid", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return edits.sound_places(segments, holds, ["vid"])


LINEAR_SQL = "CAST(CASE WHEN {0}/255e0 <= 0.04045e0 THEN {0}/255e0/12.92e0 ELSE pow(({0}/255e0 + 0.055e0)/1.055e0, 2.4e0) END AS FLOAT)"
CODES = "k AS (SELECT p_partkey AS id, p_partkey * 7 % 256 AS r, p_partkey * 13 % 256 AS g, p_partkey * 29 % 256 AS b FROM part)"
_l = {c: LINEAR_SQL.format(c) for c in "rgb"}
_fl = {c: f"({_l[c]} + CAST(0.0035 AS FLOAT))" for c in "rgb"}


def codes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(key.alias("id"), *[(key * m % 256).alias(c) for c, m in zip("rgb", (7, 13, 29), strict=True)])


@query(f"""WITH {CODES} SELECT id, CAST(round(CAST(CAST(0.2126 AS FLOAT)*{_l['r']} + CAST(0.7152 AS FLOAT)*{_l['g']} + CAST(0.0722 AS FLOAT)*{_l['b']} AS DOUBLE)*1e5) AS BIGINT) AS luminance_e5,
 {_fl['r']} >= CAST(0.8 AS FLOAT) * ({_fl['r']} + {_fl['g']} + {_fl['b']}) AS saturated FROM k""")
def luminance_and_red(spark, d):
    r, g, b = (colour.linear(F.col(c)) for c in "rgb")
    light = F.round(colour.luminance(r, g, b).cast("double") * 1e5).cast("long")
    return codes(spark, d).select("id", light.alias("luminance_e5"), colour.saturated_red(r, g, b).alias("saturated"))


_m = colour.YUV["bt709-limited"]
_y = f"(r - {_m[1]}) * {_m[0]}"


def _rgb_sql(e: str) -> str:
    return f"greatest(0, least(255, ({e} + 32768) >> 16))"


@query(f"WITH {CODES} SELECT id, {_rgb_sql(f'{_y} + (b - 128) * {_m[2]}')} AS red, {_rgb_sql(f'{_y} - (g - 128) * {_m[3]} - (b - 128) * {_m[4]}')} AS green, {_rgb_sql(f'{_y} + (g - 128) * {_m[5]}')} AS blue FROM k")
def yuv_to_rgb(spark, d):
    made = colour.yuv_to_rgb(F.col("r"), F.col("g"), F.col("b"))
    return codes(spark, d).select("id", *[c.cast("long").alias(n) for c, n in zip(made, ("red", "green", "blue"), strict=True)])


PIXELS = "px AS (SELECT p_partkey // 40 AS pic, p_partkey % 40 % 8 AS x, p_partkey % 40 // 8 AS y, p_partkey * 37 % 256 AS v FROM part)"


def pixels(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.floor(k / 40).alias("pic"), (k % 40 % 8).alias("x"), F.floor(k % 40 / 8).alias("y"), (k * 37 % 256).alias("v"))



@query(f"WITH {PIXELS}, w(cell, x0, y0, x1, y1) AS (VALUES (0, 0, 0, 4, 3), (1, 2, 1, 6, 4), (2, 4, 2, 8, 5)) SELECT pic, CAST(cell AS BIGINT) AS cell, CAST(sum(v) AS BIGINT) AS total, max(v) AS largest, count(*) AS pixels FROM px JOIN w ON x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY pic, cell")
def window_sums(spark, d):
    cells = spark.createDataFrame([(0, 0, 0, 4, 3), (1, 2, 1, 6, 4), (2, 4, 2, 8, 5)], "cell long, x0 int, y0 int, x1 int, y1 int")
    return signatures.window_sums(pixels(spark, d), cells, ["pic"], "v")


@query(
    f"""WITH {PIXELS}, a AS (SELECT pic, y, ox, CAST(round_even(sum(v * (least((x+1)*3, (ox+1)*8) - greatest(x*3, ox*8)))/8e0, 0) AS BIGINT) AS v
 FROM px, (SELECT unnest(range(0, 3)) AS ox) WHERE least((x+1)*3, (ox+1)*8) > greatest(x*3, ox*8) GROUP BY pic, y, ox)
SELECT pic, ox, oy, CAST(round_even(sum(v * (least((y+1)*2, (oy+1)*5) - greatest(y*2, oy*5)))/5e0, 0) AS BIGINT) AS v FROM a, (SELECT unnest(range(0, 2)) AS oy)
WHERE least((y+1)*2, (oy+1)*5) > greatest(y*2, oy*5) GROUP BY pic, ox, oy"""
)
def area_resample(spark, d):
    return signatures.shrink(pixels(spark, d), ["pic"], 8, 5, 3, 2)


@query(
    """WITH e AS (SELECT label AS vid, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, embedding AS v FROM embeddings),
c AS (SELECT a.vid, sh AS shift, avg(list_sum(list_transform(range(1, len(a.v) + 1), lambda k: abs(CAST(a.v[k] AS DOUBLE) - CAST(b.v[k] AS DOUBLE)))) / len(a.v)) AS cost, count(*) AS frames
 FROM e a, (SELECT unnest(range(-3, 4)) AS sh), e b WHERE b.vid = (a.vid + 1) % 10 AND b.i = a.i + sh GROUP BY a.vid, sh HAVING count(*) >= 4)
SELECT vid, shift, CAST(round(cost*1e6) AS BIGINT) AS cost_e6, frames FROM c"""
)
def shift_alignment(spark, d):
    rows = table(spark, d, "embeddings")
    i = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    a = rows.select(F.col("label").alias("vid"), i.alias("i"), F.col("embedding").alias("signature"))
    b = a.withColumn("vid", F.pmod(F.col("vid") - 1, F.lit(10)))
    return signatures.shifts(a, b, ["vid"], reach=3).select("vid", F.col("shift").cast("long").alias("shift"), us("cost").alias("cost_e6"), "frames")


@query(
    """WITH z AS (SELECT o_orderkey AS id, (o_orderkey % 3) || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_custkey % 60 AS VARCHAR), 2, '0') || '.5' AS txt FROM orders),
v AS (SELECT id, txt, CAST(split_part(txt, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(txt, ':', 2) AS DOUBLE) * 60 + CAST(split_part(txt, ':', 3) AS DOUBLE) AS sec FROM z)
SELECT id, sec, CASE WHEN sec >= 3600 THEN printf('%d:%02d:%02d.%03d', CAST(floor(sec / 3600) AS INT), CAST(floor(sec / 60) AS INT) % 60, CAST(floor(sec) % 60 AS INT), 500) ELSE printf('%d:%02d.%03d', CAST(floor(sec / 60) AS INT), CAST(floor(sec) % 60 AS INT), 500) END AS shown FROM v"""
)
def time_text(spark, d):
    key, other = F.col("o_orderkey"), F.col("o_custkey")
    text = F.format_string("%d:%02d:%02d.5", key % 3, key % 60, other % 60)
    seconds = times.parse_time(text)
    return table(spark, d, "orders").select(key.alias("id"), seconds.alias("sec"), times.format_time(seconds).alias("shown"))
