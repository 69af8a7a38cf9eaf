"""A fold gets the columns it takes and no others; nulls stay nulls."""

from __future__ import annotations

from pyspark.sql import types as T

from glintframe.operators import flashes


def test_steps_get_only_what_they_take(spark):
    rows = spark.createDataFrame([(k, n, float(n) if n % 3 else None, f"{k}-{n}") for k in range(3) for n in range(10)], "k long, n long, x double, text string")

    def begin():
        total = [0.0]

        def step(*values):
            assert len(values) == 1
            total[0] += values[0] or 0.0
            return total[0], values[0] is None

        return step

    fields = [T.StructField("total", T.DoubleType()), T.StructField("gap", T.BooleanType())]
    got = flashes.sorted_fold(rows, ["k"], ["n"], fields, begin, rows.columns, ["x"]).collect()
    assert len(got) == 30
    for r in got:
        assert r.text == f"{r.k}-{r.n}" and r.gap == (r.n % 3 == 0) and r.total == sum(i for i in range(r.n + 1) if i % 3)
