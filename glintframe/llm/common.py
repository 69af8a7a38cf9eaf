"""Pieces that several corpus operators share.

Rules all operators keep:

* a null text is an empty text; a null id is kept as a null id;
* operators read only the columns they name; columns that pass through (``keep``, all by default) make way for
  those of the operator where the names are equal, in any case of letters;
* what goes to the driver or is broadcast is a model whose size has a documented bound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glintframe.tables import stored  # noqa: F401  (for the operators)

ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_bucket(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id falls into bucket 0)."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus)), F.lit(0))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def passing(docs: DataFrame, keep: list[str] | None, made: list[str]) -> list[str]:
    """The columns of ``keep`` (default: all of ``docs``) that no column of ``made`` replaces."""
    taken = {name.lower() for name in made}
    return [c for c in (docs.columns if keep is None else keep) if c.lower() not in taken]


def aside(docs: DataFrame, made: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of the names ``made`` renamed, and what selects all columns under their own names again."""
    taken = {name.lower() for name in made}
    names = [f"__kept{i}" if c.lower() in taken else c for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [F.col(f"`{new}`").alias(old) for new, old in zip(names, docs.columns, strict=True)]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of every text; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time, so that what Python makes of them stays small; none are empty.

    At the end freed memory goes back to the system: workers live on between stages.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def map_texts(
    df: DataFrame,
    open_task: Callable[[], Callable[[pa.Array], list]],
    fields: list[T.StructField],
    text_col: str = "text",
    keep: list[str] | None = None,
) -> DataFrame:
    """Append ``fields``, computed from the text column batch by batch inside the tasks.

    ``open_task`` runs once per task and returns a function from the Arrow text column to one
    list or array per field.  Every column in ``keep`` passes through untouched, but for those that a field replaces.
    """
    keep = passing(df, keep, [f.name for f in fields])
    out = T.StructType([df.schema[c] for c in keep] + fields)
    extra = [] if text_col in keep else [text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in slices(batches):
            work = work or open_task()
            made = work(batch.column(text_col))
            columns = [batch.column(c) for c in keep]
            for field, values in zip(fields, made, strict=True):
                columns.append(values if isinstance(values, pa.Array) else pa.array(values, type=arrow_type(field.dataType)))
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return df.select(*keep, *extra).mapInArrow(run, out)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def hash_fraction(column: Column, fraction: float) -> Column:
    """A fixed pseudo-random share of rows, the same on every run."""
    return F.pmod(F.xxhash64(column, F.lit(20_011)), F.lit(1_000_000)) < F.lit(int(min(1.0, fraction) * 1_000_000))


def labelled_rows(labels: DataFrame, label: str, max_rows: int, id_col: str = "doc_id", modulus: int = 4, held: int = 2) -> DataFrame:
    """(id, label) of the rows that may be learned from, about ``max_rows`` at most, chosen by a hash of the id.

    Conflicting labels of one id: the larger counts.  The bound makes the result safe to broadcast.
    """
    rows = (
        labels.select(id_col, F.col(label).cast("int").alias("label"))
        .where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & (id_bucket(id_col, modulus) != held))
        .groupBy(id_col)
        .agg(F.max("label").alias("label"))
    )
    n = rows.count()
    return rows if n <= max_rows else rows.where(hash_fraction(F.col(id_col), max_rows / n))


def salted_rank(df: DataFrame, keys: list[str], order: str, name: str, buckets: int = 256, salt: str | None = None) -> DataFrame:
    """A gapless rank from 0 within ``keys``: ranks within hash buckets plus the sizes of earlier buckets.

    ``salt`` (the order column by default) is hashed into buckets.

    No task holds a whole key; at most ``buckets`` counts per key meet in the running sum.
    """
    from pyspark.sql import Window

    df = df.withColumn("__bucket", F.pmod(F.xxhash64(salt or order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    within = Window.partitionBy(*keys, "__bucket").orderBy(order)
    ranked = df.withColumn("__rank", F.row_number().over(within) - 1)
    return ranked.join(counts, [*keys, "__bucket"]).withColumn(name, F.col("__rank") + F.col("__before")).drop("__bucket", "__rank", "__before")


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = ridge / 10
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
