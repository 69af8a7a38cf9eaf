"""Queries of single rules with their SQL: colours, sizes, limits, texts, samples, marks and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.functions import colour, display, limits, media
from glintframe.operators import intervals as V
from glintframe.operators import projects, signatures
from glintframe.queries import CODES, ORACLES, PIXELS, SERIES, _fl, codes, pixels, query, series, strobe_violations, table

_MATRICES = "m(matrix, ys, yo, rv, gu, gv, bu) AS (VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in colour.YUV.items()) + ")"


@query(
    f"""WITH {CODES}, {_MATRICES}, z AS (SELECT id, r, g, b, (CASE WHEN id * 31 % 1200 > 576 THEN 'bt709' ELSE 'bt601' END) || (CASE WHEN id % 2 = 0 THEN '-full' ELSE '-limited' END) AS matrix FROM k)
SELECT id, matrix, CAST(greatest(0, least(255, ((r - yo) * ys + (b - 128) * rv + 32768) >> 16)) AS BIGINT) AS red,
 CAST(greatest(0, least(255, ((r - yo) * ys - (g - 128) * gu - (b - 128) * gv + 32768) >> 16)) AS BIGINT) AS green,
 CAST(greatest(0, least(255, ((r - yo) * ys + (g - 128) * bu + 32768) >> 16)) AS BIGINT) AS blue FROM z JOIN m USING (matrix)"""
)
def default_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Every row as a luma and two chroma codes, by the matrix of its height and range."""
    matrix = F.concat(colour.default_matrix(F.col("id") * 31 % 1200), F.when(F.col("id") % 2 == 0, "-full").otherwise("-limited"))
    rows = codes(spark, d).withColumn("matrix", matrix)
    red, green, blue = colour.by_matrix(F.col("matrix"), F.col("r"), F.col("g"), F.col("b"))
    return rows.select("id", "matrix", red.cast("long").alias("red"), green.cast("long").alias("green"), blue.cast("long").alias("blue"))


_R, _G, _B = (f"({_fl[c]})" for c in "rgb")
_w = lambda w: f"(CAST({w[0]} AS FLOAT)*{_R} + CAST({w[1]} AS FLOAT)*{_G} + CAST({w[2]} AS FLOAT)*{_B})"


@query(
    f"""WITH {CODES}, x AS (SELECT id, {_w(colour.X_ROW)} AS x, {_w(colour.LUMA)} AS y, {_w(colour.Z_ROW)} AS z FROM k), c AS (SELECT id, x, y, x + CAST(15 AS FLOAT)*y + CAST(3 AS FLOAT)*z AS d FROM x)
SELECT id, CAST(round(sqrt(power(4*x/d - {colour.RED_UV[0]}, 2) + power(9*y/d - {colour.RED_UV[1]}, 2))*1e3) AS BIGINT) AS distance_e3 FROM c"""
)
def red_distance(spark: SparkSession, d: str) -> DataFrame:
    r, g, b = (colour.linear(F.col(c)) for c in "rgb")
    return codes(spark, d).select("id", F.round(colour.red_distance(r, g, b).cast("double") * 1e3).cast("long").alias("distance_e3"))


@query(
    """WITH z AS (SELECT o_orderkey AS id, o_orderkey * 48271 % 2147483648 + CASE WHEN o_orderkey % 3 = 0 THEN 2147483648 ELSE 0 END AS a, o_custkey * 69621 % 2147483648 AS b FROM orders)
SELECT id, (a | b) & 2147483648 <> 0 AND power((((a >> 16) & 32767) - ((b >> 16) & 32767)) / 32768e0, 2) + power(((a & 65535) - (b & 65535)) / 65536e0, 2) > 0.0625e0 AS steps FROM z"""
)
def red_transitions(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    a = key * 48271 % (1 << 31) + F.when(key % 3 == 0, F.lit(1 << 31)).otherwise(F.lit(0))
    b = F.col("o_custkey") * 69621 % (1 << 31)
    return table(spark, d, "orders").select(key.alias("id"), colour.red_step(a, b, 0.25).alias("steps"))


@query(
    """WITH z AS (SELECT p_partkey AS id, 16 + p_partkey * 37 % 4000 AS w, 16 + p_partkey * 53 % 2400 AS h FROM part), f AS (SELECT *, least(1024e0 / w, 768e0 / h) * 0.25e0 AS fit FROM z)
SELECT id, CAST(greatest(2, round_even(w * fit / 2, 0) * 2) AS BIGINT) AS width, CAST(greatest(2, round_even(h * fit / 2, 0) * 2) AS BIGINT) AS height FROM f"""
)
def analysis_sizes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    width, height = limits.analysis_size(16 + key * 37 % 4000, 16 + key * 53 % 2400, 1024, 768, 0.25)
    return table(spark, d, "part").select(key.alias("id"), width.alias("width"), height.alias("height"))


@query(
    """WITH z AS (SELECT c_custkey AS id, 1 + c_custkey % 17 / 4e0 AS flash, c_nationkey % 2 = 0 AS ext FROM customer),
k AS (SELECT *, CAST(greatest(1, floor(flash) + 1) AS BIGINT) AS fails, CAST(greatest(1, ceil(flash)) AS BIGINT) AS extends FROM z)
SELECT id, fails, extends, CAST(floor(2 * CASE WHEN ext THEN least(fails, extends) - 1 ELSE fails - 1 END / 1.05e0 * 100) AS BIGINT) AS safe_e2, CASE WHEN ext THEN 65 ELSE 45 END AS context_e1 FROM k"""
)
def limits_of_settings(spark: SparkSession, d: str) -> DataFrame:
    """What follows from the flash limits that customers' rows stand for."""
    flash, ext = 1 + F.col("c_custkey") % 17 / F.lit(4.0), F.col("c_nationkey") % 2 == 0
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), limits.fails_from(flash).alias("fails"), limits.extended_from(flash).alias("extends"),
        F.round(limits.safe_rate(flash, ext) * 100).cast("long").alias("safe_e2"), (limits.context_seconds(ext) * 10).cast("int").alias("context_e1"),
    )


@query("SELECT event_id, least(epoch_us(max(ts) OVER (PARTITION BY user_id)) - epoch_us(ts), 1073741824) AS age_us FROM events")
def flash_ages(spark: SparkSession, d: str) -> DataFrame:
    """How long before its series' end each event is, up to 2**30 microseconds."""
    rows = table(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    ends = rows.groupBy("user_id").agg(F.max("at").alias("last"))
    return rows.join(ends, "user_id").select("event_id", limits.age(F.col("last"), F.col("at")).alias("age_us"))


_STEPS = " ".join(f"WHEN s <= {float(s)}e0 THEN {float(s)}e0" for s in display.AXIS_STEPS)


@query(
    f"""WITH z AS (SELECT o_orderkey AS id, o_totalprice / 20e0 AS s, CAST(o_custkey - 700 AS BIGINT) * 9371 AS us FROM orders),
w AS (SELECT *, CAST(floor(s + 0.5) AS BIGINT) AS whole, floor(us / 1000e0 + 0.5) AS ms FROM z)
SELECT id, CAST(CASE {_STEPS} ELSE 3600 * power(2, ceil(log2(s / 3600))) END AS DOUBLE) AS step,
 CASE WHEN s < 90 THEN whole || ' s' WHEN whole < 3600 THEN whole // 60 || ' min ' || whole % 60 || ' s' ELSE whole // 3600 || ' h ' || whole // 60 % 60 || ' min' END AS wait,
 CASE WHEN ms = 0 THEN 'starts with the picture' ELSE 'starts ' || CASE WHEN abs(ms) < 10000 THEN CAST(abs(ms) AS BIGINT) || ' ms' ELSE printf('%.1f', abs(ms) / 1000e0) || ' s' END || CASE WHEN ms < 0 THEN ' before' ELSE ' after' END || ' the picture' END AS sound FROM w"""
)
def readouts(spark: SparkSession, d: str) -> DataFrame:
    """Axis steps, durations and sound starts in words."""
    s = F.col("o_totalprice").cast("double") / 20
    us = (F.col("o_custkey") - 700).cast("long") * 9371
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), display.axis_step(s).alias("step"), display.wait_text(s).alias("wait"), display.sound_start(F.lit(0), us).alias("sound"))


@query(
    r"""WITH z AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN '  ' WHEN 1 THEN '..a:b/' || p_name || '.mkv' WHEN 2 THEN p_name || '.MP4' WHEN 3 THEN p_name || '?*.mov ' ELSE p_name END AS raw FROM part),
n AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(raw, '[\x00-\x1f<>:"/\\|?*]+', ' ', 'g'), '\s+', ' ', 'g'), '^[.\s]+|[.\s]+$', '', 'g') AS name FROM z)
SELECT id, CASE WHEN length(name) = 0 THEN '(none)' WHEN regexp_matches(name, '(?i)\.mp4$') THEN name ELSE regexp_replace(name, '(?i)\.(mov|m4v|mkv|webm|avi|mp4v)$', '') || '.mp4' END AS file FROM n"""
)
def export_names(spark: SparkSession, d: str) -> DataFrame:
    key, name = F.col("p_partkey"), F.col("p_name")
    kind = key % 5
    raw = F.when(kind == 0, "  ").when(kind == 1, F.concat(F.lit("..a:b/"), name, F.lit(".mkv"))).when(kind == 2, F.concat(name, F.lit(".MP4"))).when(kind == 3, F.concat(name, F.lit("?*.mov "))).otherwise(name)
    return table(spark, d, "part").select(key.alias("id"), F.coalesce(display.export_name(raw), F.lit("(none)")).alias("file"))


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN CAST(s_suppkey // 4 AS VARCHAR) ELSE regexp_replace(printf('%.6f', s_suppkey / 4e0), '\\.?0+$', '') END AS text FROM supplier".replace("\\\\", "\\"))
def short_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), display.short_number(F.col("s_suppkey") / F.lit(4.0)).alias("text"))


@query(
    """WITH z AS (SELECT p_partkey AS id, CAST(p_partkey * 7919 AS BIGINT) AS v FROM part), c AS (SELECT id, v, CAST(xor(v % 256, 85) AS BIGINT) AS a, CAST(xor(v % 256, 255) AS BIGINT) AS m FROM z)
SELECT id, CAST(v % 256 - 128 AS BIGINT) AS u8, CAST((v * 4099 % 16777216) - CASE WHEN v * 4099 % 16777216 >= 8388608 THEN 16777216 ELSE 0 END AS BIGINT) AS s24,
 CAST((CASE WHEN a & 128 <> 0 THEN 1 ELSE -1 END) * CASE WHEN (a >> 4) & 7 = 0 THEN (a & 15) * 16 + 8 ELSE ((a & 15) * 16 + 264) * power(2, ((a >> 4) & 7) - 1) END AS BIGINT) AS a_law,
 CAST((CASE WHEN m & 128 <> 0 THEN -1 ELSE 1 END) * (((m & 15) * 8 + 132) * power(2, (m >> 4) & 7) - 132) AS BIGINT) AS mu_law FROM c"""
)
def sound_codes(spark: SparkSession, d: str) -> DataFrame:
    """Samples from 8- and 24-bit codes, A-law and mu-law bytes, as whole numbers of their own scale."""
    v = (F.col("p_partkey") * 7919).cast("long")
    byte = v % 256
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.round(media.pcm(byte, 8) * 128).cast("long").alias("u8"), F.round(media.pcm(v * 4099 % (1 << 24), 24) * (1 << 23)).cast("long").alias("s24"),
        F.round(media.a_law(byte) * 32768).cast("long").alias("a_law"), F.round(media.mu_law(byte) * 32768).cast("long").alias("mu_law"),
    )


@query(
    """WITH s AS (SELECT o_custkey AS vid, o_orderkey AS id, o_orderkey * 10e0 AS start, o_orderkey * 10e0 + 4 + o_orderkey % 5 AS "end" FROM orders),
p AS (SELECT l_orderkey, l_linenumber, o_custkey AS vid, l_orderkey * 10e0 + l_linenumber * 2 AS at FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT l_orderkey, l_linenumber, s.id AS span FROM p LEFT JOIN s ON s.vid = p.vid AND p.at >= s.start AND p.at < s."end" """
)
def located_points(spark: SparkSession, d: str) -> DataFrame:
    """The span of its series that holds each point."""
    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("vid"), F.col("o_orderkey").alias("id"))
    start = F.col("id") * F.lit(10.0)
    spans = orders.select("vid", "id", start.alias("start"), (start + 4 + F.col("id") % 5).alias("end"))
    points = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(orders, F.col("l_orderkey") == F.col("id"))
    points = points.select("vid", "l_orderkey", "l_linenumber", (F.col("l_orderkey") * F.lit(10.0) + F.col("l_linenumber") * 2).alias("at"))
    return V.located(points, spans, ["vid"], "at").select("l_orderkey", "l_linenumber", F.col("id").alias("span"))


@query(f"WITH {SERIES}, m AS (SELECT vid, n, n - row_number() OVER (PARTITION BY vid ORDER BY n) AS run FROM s WHERE x > 0.4e0) SELECT vid, min(n) AS first, max(n) AS last, count(*) AS length FROM m GROUP BY vid, run")
def pulses(spark: SparkSession, d: str) -> DataFrame:
    return V.pulses(series(spark, d).where("x > 0.4").select("vid", "n"), ["vid"], "n")


@query(
    f"""WITH {PIXELS} SELECT pic, bit_or(CAST(CASE WHEN v > 200 THEN 4 WHEN v > 100 THEN 2 ELSE 1 END AS BIGINT)) AS marks, CAST(min(x) FILTER (WHERE v > 200) AS BIGINT) AS x0, CAST(min(y) FILTER (WHERE v > 200) AS BIGINT) AS y0,
 CAST(max(x) FILTER (WHERE v > 200) + 1 AS BIGINT) AS x1, CAST(max(y) FILTER (WHERE v > 200) + 1 AS BIGINT) AS y1 FROM px GROUP BY pic"""
)
def marks_and_boxes(spark: SparkSession, d: str) -> DataFrame:
    """All marks of a picture as bits, and the box around its bright pixels."""
    bright = F.col("v") > 200
    inside = lambda c: F.when(bright, F.col(c).cast("long"))
    mark = F.when(bright, 4).when(F.col("v") > 100, 2).otherwise(1).cast("long")
    return pixels(spark, d).groupBy("pic").agg(
        F.bit_or(mark).alias("marks"), F.min(inside("x")).alias("x0"), F.min(inside("y")).alias("y0"), (F.max(inside("x")) + 1).alias("x1"), (F.max(inside("y")) + 1).alias("y1")
    )


@query(
    f"""WITH {PIXELS}, w AS (SELECT pic, ox, oy, sum(v) AS total FROM px, (SELECT unnest(range(0, 6)) AS ox), (SELECT unnest(range(0, 4)) AS oy) WHERE x >= ox AND x < ox + 3 AND y >= oy AND y < oy + 2 GROUP BY pic, ox, oy)
SELECT pic, CAST(total AS BIGINT) AS total, CAST(ox AS BIGINT) AS ox, CAST(oy AS BIGINT) AS oy FROM w QUALIFY row_number() OVER (PARTITION BY pic ORDER BY total DESC, oy, ox) = 1"""
)
def best_window(spark: SparkSession, d: str) -> DataFrame:
    """The 3 by 2 window of each picture with the largest sum, the first of equal ones, over every place."""
    return signatures.best_window(pixels(spark, d), ["pic"], 3, 2)


@query(f"WITH {PIXELS} SELECT pic, CAST(round(avg(v) * 1e4) AS BIGINT) AS mean_e4, count(*) AS pixels FROM px WHERE pic % 3 <> 1 AND x >= pic % 4 AND x < pic % 4 + 4 AND y >= 1 AND y < 4 GROUP BY pic")
def region_metric(spark: SparkSession, d: str) -> DataFrame:
    """The mean in a box of its own, for the pictures of a list."""
    left = F.col("pic") % 4
    boxes = pixels(spark, d).select("pic").distinct().where("pic % 3 <> 1").select("pic", left.alias("x0"), F.lit(1).alias("y0"), (left + 4).alias("x1"), F.lit(4).alias("y1"))
    made = signatures.region_mean(pixels(spark, d), boxes, ["pic"])
    return made.select("pic", F.round(F.col("mean") * 1e4).cast("long").alias("mean_e4"), "pixels")


@query(
    f"""WITH v AS ({ORACLES['strobe_violations']}), e AS (SELECT DISTINCT user_id AS vid FROM events)
SELECT e.vid, CAST(to_json(struct_pack(video := e.vid, passed := count(v.start_us) = 0, violations := coalesce(list(struct_pack(start_us := v.start_us, end_us := v.end_us, severity := v.severity) ORDER BY v.start_us, v.end_us) FILTER (WHERE v.start_us IS NOT NULL), []))) AS VARCHAR) AS result
FROM e LEFT JOIN v USING (vid) GROUP BY e.vid"""
)
def result_json(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document a series: its verdict and its violations in order."""
    every = table(spark, d, "events").select(F.col("user_id").alias("vid"))
    return projects.result_json(every, strobe_violations(spark, d), "vid", ["start_us", "end_us", "severity"])
