"""Frame signatures: mean colours on a grid, distances, and the shift that aligns two runs of frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def grid_means(pixels: DataFrame, keys: list[str], width: int, height: int, cells: int = 8) -> DataFrame:
    """Mean of each channel (columns r, g, b at x, y) in a grid of cells."""
    cell = F.floor(F.col("y") * cells / height) * cells + F.floor(F.col("x") * cells / width)
    return pixels.groupBy(*keys, cell.alias("cell")).agg(*[F.avg(c).alias(c) for c in "rgb"])


def shifts(a: DataFrame, b: DataFrame, keys: list[str], reach: int = 8, least: int = 4) -> DataFrame:
    """Mean distance of a (i, signature) to b moved by each shift, where ``least`` frames overlap; best first on ``place``."""
    from pyspark.sql import Window

    moved = a.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn("j", F.col("i") + F.col("shift"))
    other = b.select(*keys, F.col("i").alias("j"), F.col("signature").alias("other"))
    costs = moved.join(other, [*keys, "j"]).groupBy(*keys, "shift").agg(F.avg(distance(F.col("signature"), F.col("other"))).alias("cost"), F.count(F.lit(1)).alias("frames")).where(F.col("frames") >= least)
    return costs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("cost", 9), "shift")))


def window_sums(pixels: DataFrame, cells: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Sum and largest value in each window (cell, x0, y0, x1, y1): a range join with the few windows of one picture size."""
    inside = (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1"))
    return pixels.join(F.broadcast(cells), inside).groupBy(*keys, "cell").agg(F.sum(value).alias("total"), F.max(value).alias("largest"), F.count(F.lit(1)).alias("pixels"))


def best_window(pixels: DataFrame, keys: list[str], width: int, height: int, value: str = "v") -> DataFrame:
    """keys, total, ox, oy: the ``width`` by ``height`` window with the largest sum over every place of it, the first of equal ones.

    Sums run along the rows and then down the columns, so a pixel is read twice whatever the window's size; pictures are whole.
    """
    from pyspark.sql import Window

    def along(rows: DataFrame, others: list[str], at: str, size: int) -> DataFrame:
        by = Window.partitionBy(*keys, *others).orderBy(at).rowsBetween(0, size - 1)
        return rows.withColumns({"__sum": F.sum("__sum").over(by), "__n": F.count(F.lit(1)).over(by)}).where(F.col("__n") == size)

    rows = pixels.select(*keys, "x", "y", F.col(value).cast("long").alias("__sum"))
    sums = along(along(rows, ["y"], "x", width), ["x"], "y", height)
    best = F.max(F.struct("__sum", (-F.col("y")).alias("y"), (-F.col("x")).alias("x")))
    return sums.groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.__sum").alias("total"), (-F.col("b.x")).cast("long").alias("ox"), (-F.col("b.y")).cast("long").alias("oy"))


def region_mean(pixels: DataFrame, boxes: DataFrame, keys: list[str], value: str = "v") -> DataFrame:
    """keys, mean, pixels: the mean in each listed picture's own box (keys, x0, y0, x1, y1)."""
    inside = pixels.join(boxes, keys).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    return inside.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("pixels"))


def shrink(pixels: DataFrame, keys: list[str], width: int, height: int, to_width: int, to_height: int, value: str = "v") -> DataFrame:
    """Area-average resample of integer codes: each output pixel weighs inputs by how far they overlap it.

    Overlaps are exact integers in units of 1 / (input x output) of an axis; rows are averaged after
    columns, each rounded half to even.
    """

    def axis(df: DataFrame, at: str, n: int, m: int, out: str) -> DataFrame:
        # input pixel i covers [i*m, (i+1)*m), output pixel o covers [o*n, (o+1)*n)
        first, last = F.floor(F.col(at) * m / n), F.floor(((F.col(at) + 1) * m - 1) / n)
        df = df.withColumn(out, F.explode(F.sequence(first, last)))
        return df.withColumn("__w", F.least((F.col(at) + 1) * m, (F.col(out) + 1) * n) - F.greatest(F.col(at) * m, F.col(out) * n))

    across = axis(pixels, "x", width, to_width, "ox").groupBy(*keys, "ox", "y").agg((F.bround(F.sum(F.col(value) * F.col("__w")) / width)).cast("long").alias(value))
    down = axis(across, "y", height, to_height, "oy").groupBy(*keys, "ox", "oy").agg((F.bround(F.sum(F.col(value) * F.col("__w")) / height)).cast("long").alias(value))
    return down
