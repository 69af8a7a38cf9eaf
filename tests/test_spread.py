"""Series and spans are dealt to as many tasks as the session shuffles to, however few bytes they have."""

from __future__ import annotations

from glintframe import queries, queries_more  # noqa: F401  (registers its queries)

DATA = "/root/testdata/sf0.001"


def test_small_rows_are_not_gathered_in_few_tasks(spark):
    for name in ("to_native", "span_coverage"):
        made = queries.QUERIES[name](spark, DATA)
        rows = made.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
        assert len(rows) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(rows) < sum(rows), (name, rows)


def test_moments_are_told_apart_where_they_are_dealt(spark):
    """No shuffle of ``export_located`` may be gathered in few tasks."""
    plan = queries.QUERIES["export_located"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan
