"""More queries with their SQL: clocks of segments, pixel rows, edits, packets, projects and media bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintframe.config import PROFILES
from glintframe.functions import media
from glintframe.operators import clock, edits, flashes, packets, patterns, projects, signatures
from glintframe.operators import intervals as V
from glintframe.plans import search
from glintframe.streaming import verdicts
from glintframe.tables import stored
from glintframe.queries import CLOCK, FOLD, MERGED, ORDER_SPANS, PACKETS, PIXELS, SERIES, STATS, STROBES, US, clocked, folded, order_spans, packet_rows, pixels, query, series, stats, strobes, table, us

FIXED = (
    SERIES
    + """, d AS (SELECT *, t - lag(t) OVER (PARTITION BY vid ORDER BY n) AS dt FROM s),
m AS (SELECT vid, quantile_cont(dt, 0.5) AS med FROM d WHERE dt > 0 AND dt <= 0.4e0 GROUP BY vid)"""
)


@query(
    f"""WITH {FIXED} SELECT d.vid, n, {US.format('''sum(CASE WHEN dt IS NULL THEN 0e0 WHEN dt > 0 AND dt <= 0.4e0 THEN dt ELSE coalesce(med, 1e0/30) END)
 OVER (PARTITION BY d.vid ORDER BY n ROWS UNBOUNDED PRECEDING)''')} AS tc_us FROM d LEFT JOIN m ON m.vid = d.vid"""
)
def fixed_clock(spark: SparkSession, d: str) -> DataFrame:
    return clock.fixed_clock(series(spark, d), ["vid"], max_gap=0.4).select("vid", "n", us("tc").alias("tc_us"))


@query(
    CLOCK.replace("s AS (", "WITH s0 AS (", 1).replace(
        ", d AS (",
        """, b AS (SELECT vid, max(t) / 2 AS mid FROM s0 GROUP BY vid), u AS (SELECT vid, 0 AS seg, n, t, x, event_type, -1e18 AS f FROM s0 JOIN b USING (vid) WHERE t < mid
 UNION ALL SELECT vid, 1, n, t, x, event_type, mid FROM s0 JOIN b USING (vid) WHERE t >= mid - 1),
s AS (SELECT vid, row_number() OVER (PARTITION BY vid ORDER BY seg, n) - 1 AS n, t, x, event_type FROM u WHERE t >= f - 1e-9), d AS (""",
        1,
    )
    + f" SELECT vid, n AS place, {US.format('tc')} AS tc_us, anomaly FROM c"
)
def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    rows = series(spark, d)
    rows = rows.join(rows.groupBy("vid").agg((F.max("t") / 2).alias("mid")), "vid")
    parts = rows.where("t < mid").withColumn("seg", F.lit(0)).withColumn("from", F.lit(-1e18))
    parts = parts.unionByName(rows.where("t >= mid - 1").withColumn("seg", F.lit(1)).withColumn("from", F.col("mid")))
    made = clock.merged_segments(parts, ["vid"], "seg", "from", max_gap=0.4)
    return made.select("vid", F.col("place").cast("long").alias("place"), us("tc").alias("tc_us"), "anomaly")


@query(
    f"""WITH RECURSIVE {FOLD}, l AS (SELECT vid, n, tc, last_value(CASE WHEN tr <> 0 THEN tc END IGNORE NULLS) OVER w AS lt, last_value(CASE WHEN tr <> 0 THEN tr END IGNORE NULLS) OVER w AS lp
 FROM r WINDOW w AS (PARTITION BY vid ORDER BY n ROWS UNBOUNDED PRECEDING)) SELECT vid, n, CASE WHEN tc - lt <= 0.125e0 THEN lp ELSE 0 END AS active FROM l"""
)
def pooled_transitions(spark: SparkSession, d: str) -> DataFrame:
    return flashes.pooled(folded(spark, d), ["vid"]).select("vid", "n", "active")


@query(
    f"""WITH {STATS}, {STROBES}, o AS (SELECT vid, least(onset, s) - 0.3e0 AS s, e + 0.3e0 AS e FROM v), {MERGED}
SELECT vid, {US.format('s')} AS start_us, {US.format('e')} AS end_us, parts FROM merged"""
)
def violation_spans(spark: SparkSession, d: str) -> DataFrame:
    return V.violation_spans(strobes(spark, d), ["vid"]).select("vid", us("start").alias("start_us"), us("end").alias("end_us"), "parts")


@query(
    f"""WITH {ORDER_SPANS}, b AS (SELECT vid, CAST(max(s) AS DOUBLE) AS dur FROM o GROUP BY vid), w AS (SELECT o.vid, greatest(0e0, CAST(s AS DOUBLE)) AS s, least(CAST(e AS DOUBLE), dur) AS e FROM o JOIN b ON b.vid = o.vid WHERE id % 3 = 0)
SELECT vid, s AS start, e AS "end" FROM w WHERE e > s AND NOT EXISTS (SELECT 1 FROM o k WHERE k.vid = w.vid AND k.id % 3 = 1 AND w.s < k.e - 1e-6 AND w.e > k.s + 1e-6)"""
)
def free_ranges(spark: SparkSession, d: str) -> DataFrame:
    spans = order_spans(spark, d)
    wanted = spans.where("id % 3 = 0").join(spans.groupBy("vid").agg(F.max("start").cast("double").alias("dur")), "vid")
    wanted = wanted.select("vid", "dur", F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))
    return V.free_ranges(wanted, spans.where("id % 3 = 1"), ["vid"], "dur")


@query(
    f"""WITH {ORDER_SPANS} SELECT a.vid, a.id, a.s AS start, a.e AS "end", coalesce(array_to_string(list_sort(list_distinct(list(CASE WHEN a.s < b.e AND a.e > b.s THEN CASE WHEN b.id % 4 < 2 THEN 'flash' ELSE 'red' END END) )), ','), '') AS kinds
FROM o a LEFT JOIN o b ON b.vid = a.vid AND b.id % 2 = 1 WHERE a.id % 2 = 0 GROUP BY a.vid, a.id, a.s, a.e"""
)
def refreshed_labels(spark: SparkSession, d: str) -> DataFrame:
    spans = order_spans(spark, d)
    return V.labelled(spans.where("id % 2 = 0"), spans.where("id % 2 = 1").withColumn("kind", F.when(F.col("id") % 4 < 2, "flash").otherwise("red")), ["vid"])


@query(
    f"""WITH {PIXELS}, c AS (SELECT pic, y, x, unnest(range(x - 2, x + 3)) AS k FROM px), e AS (SELECT c.pic, c.y, c.x, p.v FROM c JOIN px p ON p.pic = c.pic AND p.y = c.y AND p.x = least(greatest(k, 0), (SELECT max(x) FROM px q WHERE q.pic = c.pic AND q.y = c.y)))
SELECT pic, y, x, CAST(floor((sum(v) + 2) / 5e0) AS BIGINT) AS blurred FROM e GROUP BY pic, y, x"""
)
def box_blur(spark: SparkSession, d: str) -> DataFrame:
    return patterns.box_blur(pixels(spark, d), ["pic", "y"], "x", "v", 2).select("pic", "y", "x", "blurred")


@query(
    f"""WITH {PIXELS}, f AS (SELECT pic // 10 AS vid, pic % 10 AS ord, y * 8 + x AS at, v FROM px), p AS (SELECT DISTINCT vid, ord, ord % 3 = 1 AS marked FROM f),
q AS (SELECT *, max(CASE WHEN NOT marked THEN ord END) OVER (PARTITION BY vid ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev, min(CASE WHEN NOT marked THEN ord END) OVER (PARTITION BY vid ORDER BY ord ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM p),
w AS (SELECT *, CASE WHEN prev IS NULL THEN 1e0 WHEN next IS NULL THEN 0e0 ELSE CAST(ord - prev AS DOUBLE) / (next - prev) END AS u FROM q WHERE marked)
SELECT f.vid, f.ord, f.at, CAST(least(255, floor((1 - 0.75e0) * f.v + coalesce(0.75e0 * (1 - u) * a.v, 0e0) + coalesce(0.75e0 * u * b.v, 0e0) + 0.5e0)) AS BIGINT) AS mixed
FROM f JOIN w ON w.vid = f.vid AND w.ord = f.ord LEFT JOIN f a ON a.vid = f.vid AND a.ord = prev AND a.at = f.at LEFT JOIN f b ON b.vid = f.vid AND b.ord = next AND b.at = f.at"""
)
def mixed_pixels(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d).select(F.floor(F.col("pic") / 10).alias("vid"), (F.col("pic") % 10).alias("ord"), (F.col("y") * 8 + F.col("x")).alias("at"), "v")
    plan = edits.blend_sources(rows.select("vid", "ord").distinct().withColumn("marked", F.col("ord") % 3 == 1), ["vid"])
    return patterns.mixed(rows, plan.select("vid", "ord", "prev", "next", "u"), ["vid"], "at", "v", 0.75)


@query(f"WITH {PIXELS} SELECT pic, CAST(y * 4 // 5 * 4 + x * 4 // 8 AS BIGINT) AS cell, {US.format('avg(v)')} AS mean_e6 FROM px GROUP BY pic, y * 4 // 5 * 4 + x * 4 // 8")
def grid_signature(spark: SparkSession, d: str) -> DataFrame:
    rows = pixels(spark, d).select("pic", "x", "y", F.col("v").alias("r"), F.col("v").alias("g"), F.col("v").alias("b"))
    return signatures.grid_means(rows, ["pic"], 8, 5, 4).select("pic", "cell", us("r").alias("mean_e6"))


@query(
    f"""WITH {SERIES} SELECT vid, n // 10 AS span, count(*) FILTER (WHERE x > 0.3e0) AS light, count(*) FILTER (WHERE x <= 0.3e0) AS dark,
 CASE WHEN count(*) FILTER (WHERE x <= 0.3e0) < 0.8e0 * count(*) FILTER (WHERE x > 0.3e0) THEN 'dark' ELSE 'light' END AS side FROM s GROUP BY vid, n // 10"""
)
def pick_side(spark: SparkSession, d: str) -> DataFrame:
    return edits.pick_side(series(spark, d).withColumn("span", F.floor(F.col("n") / 10)), ["vid", "span"], "x", 0.3)


@query(
    f"""WITH {STATS}, p AS (SELECT vid, t AS pt, pattern, 1 + pattern / 128e0 AS period FROM st WHERE pattern >= 90)
SELECT vid, n, {US.format('sigma')} AS sigma_e6, CAST(greatest(1, floor((sqrt(4e0 * sigma * sigma + 1e0) - 1e0) / 2e0 + 0.5e0)) AS BIGINT) AS radius
FROM (SELECT st.vid, st.n, greatest(1e0, sum(period * p.pattern) / sum(p.pattern)) AS sigma FROM st JOIN p ON p.vid = st.vid AND abs(st.t - pt) <= 0.25e0 GROUP BY st.vid, st.n)"""
)
def soften_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = stats(spark, d).withColumn("period", 1 + F.col("pattern") / 128)  # a binary fraction: sums are exact in any order
    return edits.soften_plan(rows, ["vid"], 180).select("vid", "n", us("sigma").alias("sigma_e6"), "radius")


@query(
    f"""WITH {SERIES}, z AS (SELECT vid, n, t - first_value(t) OVER (PARTITION BY vid ORDER BY n) AS rel, t - lag(t) OVER (PARTITION BY vid ORDER BY n) AS dd, 1e0 + vid % 7 AS dur FROM s),
g AS (SELECT vid, count(*) FILTER (WHERE rel < dur - 1e-9) AS shown, count(*) AS m, min(CASE WHEN rel >= dur - 1e-9 THEN rel END) AS cut, max(rel) AS last, coalesce(quantile_cont(CASE WHEN dd > 0 THEN dd END, 0.5), 1e0/30) AS step FROM z GROUP BY vid)
SELECT vid, CASE WHEN shown > 0 THEN shown ELSE m END AS shown, {US.format('coalesce(cut, last + step)')} AS total_us FROM g"""
)
def section_timeline(spark: SparkSession, d: str) -> DataFrame:
    rows = series(spark, d).withColumn("dur", F.lit(1.0) + F.col("vid") % 7)
    return edits.section_timeline(rows, ["vid"], "dur").select("vid", "shown", us("total").alias("total_us"))


@query(
    f"""WITH {SERIES}, o AS (SELECT vid, n AS place, CASE WHEN vid % 3 = 0 THEN n WHEN vid % 3 = 1 THEN count(*) OVER (PARTITION BY vid) - 1 - n ELSE n // 2 END AS source FROM s)
SELECT vid, count(DISTINCT source) = count(*) AND min(source) = 0 AND max(source) = count(*) - 1 AS valid, count(*) FILTER (WHERE source <> place) AS moved FROM o GROUP BY vid"""
)
def valid_orders(spark: SparkSession, d: str) -> DataFrame:
    rows = series(spark, d)
    turned = F.count(F.lit(1)).over(Window.partitionBy("vid")) - 1 - F.col("n")
    source = F.when(F.col("vid") % 3 == 0, F.col("n")).when(F.col("vid") % 3 == 1, turned).otherwise(F.floor(F.col("n") / 2))
    return edits.valid_orders(rows.select("vid", F.col("n").alias("place"), source.alias("source")), ["vid"])


@query(
    f"""WITH {SERIES} SELECT vid, n AS ord FROM s WHERE (x < 0.2e0 AND n % 10 >= 5) OR (x > 0.6e0 AND n % 10 < 5)"""
)
def applied_marks(spark: SparkSession, d: str) -> DataFrame:
    rows = series(spark, d).withColumnRenamed("n", "ord")
    return edits.applied_marks(rows.where("x < 0.2"), rows.where("x > 0.6"), ["vid"], rows.where("ord % 10 < 5").select("vid", "ord"))


@query(
    f"""WITH {PACKETS}, k AS (SELECT DISTINCT vid, t FROM p WHERE sync), w AS (SELECT DISTINCT vid, t + 3 AS t FROM p)
SELECT w.vid, w.t, coalesce(max(CASE WHEN k.t <= w.t THEN k.t END), min(k.t)) AS sync FROM w LEFT JOIN k ON k.vid = w.vid GROUP BY w.vid, w.t"""
)
def sync_before(spark: SparkSession, d: str) -> DataFrame:
    rows = packet_rows(spark, d)
    wanted = rows.select("vid", (F.col("t") + 3).alias("t")).distinct()
    return packets.sync_before(wanted, rows.where("sync").select("vid", "t").distinct(), ["vid"])


@query(f"""WITH {PACKETS} SELECT vid, "order", t FROM p WHERE NOT sync AND EXISTS (SELECT 1 FROM p k WHERE k.vid = p.vid AND k.sync AND abs(p.t - k.t) <= 0.005e0)""")
def near_keyframe(spark: SparkSession, d: str) -> DataFrame:
    rows = packet_rows(spark, d)
    return packets.near_sync(rows.where("NOT sync").select("vid", "order", "t"), rows.where("sync"), ["vid"])


@query(f"WITH {CLOCK} SELECT a.vid, a.n, min(b.n) AS from_n FROM c a JOIN c b ON b.vid = a.vid AND b.tc >= a.tc - 2e0 AND b.tc <= a.tc GROUP BY a.vid, a.n")
def run_up(spark: SparkSession, d: str) -> DataFrame:
    rows = clocked(spark, d)
    return packets.run_up(rows.select("vid", "n", "tc"), rows, ["vid"], 2.0).select("vid", "n", "from_n")


@query(
    f"""WITH {PACKETS}, q AS (SELECT vid, "order", size % 1000 AS pts FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY "order") AS k, row_number() OVER (PARTITION BY vid ORDER BY pts, "order") AS j FROM q)
SELECT a.vid, a."order", a.pts, b.pts - greatest(0, max(b.pts - a.pts) OVER (PARTITION BY a.vid)) AS dts FROM r a JOIN r b ON b.vid = a.vid AND b.j = a.k"""
)
def decode_times(spark: SparkSession, d: str) -> DataFrame:
    return packets.decode_times(packet_rows(spark, d).select("vid", "order", (F.col("size") % 1000).alias("pts")), ["vid"])


@query(f"WITH {PACKETS}, g AS (SELECT vid, size, row_number() OVER (PARTITION BY vid ORDER BY size) - 1 AS k, count(*) OVER (PARTITION BY vid) AS m FROM p) SELECT vid, size AS quantile FROM g WHERE k = least(m - 1, floor(m * 0.9e0))")
def discrete_quantile(spark: SparkSession, d: str) -> DataFrame:
    return packets.discrete_quantile(packet_rows(spark, d), ["vid"], "size", 0.9)


@query(
    """WITH a AS (SELECT c_custkey AS id, c_custkey % 97 AS frames, (c_custkey % 97) / 25e0 + c_nationkey / 1000e0 AS seconds FROM customer), b AS (SELECT s_suppkey AS id, s_suppkey % 97 AS frames, (s_suppkey % 97) / 25e0 AS seconds FROM supplier)
SELECT a.id, b.id AS video_id, a.frames FROM a JOIN b ON b.frames = a.frames AND abs(a.seconds - b.seconds) <= a.seconds / greatest(1, a.frames)"""
)
def fingerprint_match(spark: SparkSession, d: str) -> DataFrame:
    key, n = F.col("c_custkey"), F.col("c_custkey") % 97
    stored = table(spark, d, "customer").select(key.alias("id"), n.alias("frames"), (n / 25 + F.col("c_nationkey") / 1000).alias("seconds"))
    n = F.col("s_suppkey") % 97
    return projects.same_video(stored, table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), n.alias("frames"), (n / 25).alias("seconds"))).select("id", "video_id", "frames")


@query("""SELECT c_mktsegment || ':' || c_nationkey AS prefix, max_by(c_name, (c_acctbal, c_name)) AS key, max(c_acctbal) AS saved FROM customer GROUP BY c_mktsegment, c_nationkey""")
def latest_project(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").withColumnsRenamed({"c_name": "key", "c_acctbal": "saved"})
    return projects.latest(rows, F.concat_ws(":", "c_mktsegment", "c_nationkey"))


@query(
    """WITH e AS (SELECT p_size AS grp, p_partkey AS id, p_partkey * 31 % 1009 AS used, 100 + p_partkey * 7 % 900 AS bytes FROM part)
SELECT grp, id, kept_bytes FROM (SELECT *, CAST(sum(bytes) OVER (PARTITION BY grp ORDER BY used DESC, id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS kept_bytes FROM e) WHERE kept_bytes > 5000"""
)
def cache_eviction(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(F.col("p_size").alias("grp"), k.alias("id"), (k * 31 % 1009).alias("used"), (100 + k * 7 % 900).alias("bytes"))
    return projects.evicted(rows, ["grp"], 5000).select("grp", "id", "kept_bytes")


@query(
    """WITH z AS (SELECT event_id AS section, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
e AS (SELECT section, k AS ord, true AS removed, false AS extended, 'next' AS fill FROM z UNION ALL SELECT section, k + 1, false, k % 2 = 0, 'prev' FROM z)
SELECT * FROM e WHERE removed OR extended"""
)
def edits_from_json(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    even = (k % 2 == 0).cast("string")
    text = F.concat(F.lit('{"'), k.cast("string"), F.lit('": {"removed": true, "extended": true, "fill": "next"}, "'), (k + 1).cast("string"), F.lit('": {"extended": '), even, F.lit('}, "x": {"removed": true}}'))
    return projects.edits_from_json(table(spark, d, "events").select(F.col("event_id").alias("section"), text.alias("edits")), "edits")


@query(
    """WITH z AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '0000002066747970' WHEN 1 THEN '1A45DFA3' WHEN 2 THEN '444B4946' WHEN 3 THEN '47401110' ELSE 'FFEE' END AS head FROM part)
SELECT id, coalesce(CASE WHEN substr(head, 9, 8) = '66747970' THEN 'mp4' WHEN head LIKE '1A45DFA3%' THEN 'mkv' WHEN head LIKE '444B4946%' THEN 'ivf' WHEN head LIKE '47%' THEN 'ts' END, 'unknown') AS kind FROM z"""
)
def container_kinds(spark: SparkSession, d: str) -> DataFrame:
    heads = F.array(*[F.unhex(F.lit(h)) for h in ("0000002066747970", "1A45DFA3", "444B4946", "47401110", "FFEE")])
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.coalesce(media.container(heads[(F.col("p_partkey") % 5).cast("int")]), F.lit("unknown")).alias("kind"))


@query(
    """WITH z AS (SELECT p_partkey AS id, p_partkey * 7919 % 65536 AS a, p_partkey * 104729 % 65536 AS b FROM part)
SELECT id, CAST(CASE WHEN a >= 32768 THEN a - 65536 ELSE a END AS BIGINT) AS first, CAST(CASE WHEN b >= 32768 THEN b - 65536 ELSE b END AS BIGINT) AS second FROM z"""
)
def pcm_samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    le = lambda v: F.concat(F.lpad(F.hex(v % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    raw = F.unhex(F.concat(le(k * 7919 % 65536), le(k * 104729 % 65536)))
    rows = table(spark, d, "part").select(k.alias("id"), media.pcm16(raw).alias("s"))
    return rows.select("id", (F.col("s")[0] * 32768).cast("long").alias("first"), (F.col("s")[1] * 32768).cast("long").alias("second"))


@query(
    f"""WITH {PACKETS}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY vid ORDER BY "order") AS dd FROM p), e AS (SELECT vid, max(t) - min(t) AS sec, count(*) FILTER (WHERE dd > 20) AS h FROM g GROUP BY vid),
k AS (SELECT *, t - lag(t) OVER (PARTITION BY vid ORDER BY "order") AS d2 FROM p WHERE "order" % 9 <> 0), f AS (SELECT vid, max(t) - min(t) AS sec, count(*) FILTER (WHERE d2 > 20) AS h FROM k GROUP BY vid)
SELECT e.vid, abs(f.sec - e.sec) <= greatest(0.25e0, 0.002e0 * e.sec) AND f.h <= e.h AS sane FROM e JOIN f ON f.vid = e.vid"""
)
def timing_sanity(spark: SparkSession, d: str) -> DataFrame:
    rows = packet_rows(spark, d)

    def sums(df: DataFrame) -> DataFrame:
        step = F.col("t") - F.lag("t").over(Window.partitionBy("vid").orderBy("order"))
        return df.withColumn("dd", step).groupBy("vid").agg((F.max("t") - F.min("t")).alias("seconds"), F.count_if(F.col("dd") > 20).alias("holes"))

    return packets.timing_sane(sums(rows), sums(rows.where("order % 9 <> 0")), ["vid"])


@query(
    f"""WITH {ORDER_SPANS}, mk AS (SELECT DISTINCT vid, s AS mark FROM o WHERE id % 2 = 0), z AS (SELECT * FROM o WHERE id % 3 = 0),
sn AS (SELECT z.vid, z.id, coalesce(max(CASE WHEN mark <= z.s THEN mark END), z.s) AS s, coalesce(min(CASE WHEN mark >= z.e THEN mark END), z.e) AS e FROM z LEFT JOIN mk ON mk.vid = z.vid GROUP BY z.vid, z.id, z.s, z.e),
{MERGED.replace('FROM o WHERE', 'FROM sn WHERE')} SELECT vid, s AS start, e AS "end", parts AS sections FROM merged"""
)
def smart_cut(spark: SparkSession, d: str) -> DataFrame:
    """Ranges that an export encodes again: sections widened to keyframes, then merged; all else is copied."""
    spans = order_spans(spark, d)
    marks = spans.where("id % 2 = 0").select("vid", F.col("start").alias("mark")).distinct()
    wide = V.snap_to_marks(spans.where("id % 3 = 0"), marks, ["vid"]).select("vid", F.col("snap_start").alias("start"), F.col("snap_end").alias("end"))
    return V.merge_spans(wide, ["vid"]).withColumnRenamed("parts", "sections")


@query(f"WITH {STATS}, {STROBES} SELECT vid, {US.format('s')} AS start_us, {US.format('e')} AS end_us, CAST(round(sev*100) AS BIGINT) AS severity, {US.format('onset')} AS onset_us, {US.format('peak')} AS peak_us FROM v")
def session_violations(spark: SparkSession, d: str) -> DataFrame:
    """The violations again, as event-time sessions: the plan that a stream runs."""
    made = verdicts.sessions(stats(spark, d), 200, gap="200 milliseconds")
    return made.select("vid", us("start").alias("start_us"), us("end").alias("end_us"), F.round(F.col("severity") * 100).cast("long").alias("severity"), us("onset").alias("onset_us"), us("peak").alias("peak_us"))


@query(None)
def search_frame_rate(spark: SparkSession, d: str) -> DataFrame:
    """All rates of every series' ladder at once; held against a brute-force loop in the tests."""
    return search.search_rate(clocked(spark, d).select("vid", "n", "tc", "x"), ["vid"], PROFILES["wcag"]).select("vid", us("rate").alias("rate_e6"), "kept", "frames", "passes")


@query(None)
def suggested_removals(spark: SparkSession, d: str) -> DataFrame:
    """All ways of removing frames within flashing spans at once."""
    rows = stored(clocked(spark, d).select("vid", "n", "tc", "x"), "series")
    hot = flashes.series_flashes(rows, ["vid"]).where("strobing").select("vid", (F.col("tc") - 1.0).alias("start"), F.col("tc").alias("end"))
    spans = stored(V.merge_spans(hot, ["vid"]), "flashing")
    return search.suggest_removals(rows, spans, ["vid"], PROFILES["wcag"])


from glintframe import queries_edits, queries_extra  # noqa: E402, F401  (register their queries)
