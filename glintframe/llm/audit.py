"""Operator 11, filter interaction audit: what each filter removes in every order of application.

Joint failures are counted once for all 2**k intersections of k filters, as sums of products of the
filters' flags (one aggregation, combined before the shuffle).  Everything else follows from these
few numbers a part: inclusion-exclusion gives the survivors of any set of filters, Mobius inversion the documents
that fail one filter only, and since the dividend of an intersection is its signed joint count, the
Shapley value of a filter is the sum of its intersections' dividends, each shared equally.

Copies are found by the digest of the text: the smallest id of each digest comes from an aggregation, and
rows meet it by (digest, id), a key that no group of copies makes hot.

Defined results: a null text is empty; a null part is the empty string; a null flag passes; a null id is never a copy and
has no labels; rows with one id and text are none of them copies of each other; of several labels of one
id the larger counts; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import itertools
import json
import math
from collections.abc import Iterable
from functools import reduce
from operator import add, mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintframe.llm import common as C

SEPARATORS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = r"[#$%&*|]"


def text_flags(text: Column, least_words: int = 50, least_distinct: int = 65, most_capitals: int = 5) -> dict[str, Column]:
    """Failure conditions of one text: few words, repeated words, many capitals, signs (shares in per cent)."""
    words = F.array_remove(F.split(text, SEPARATORS), "")
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < least_words,
        "B": 100 * F.size(F.array_distinct(words)) < least_distinct * F.size(words),
        "C": 100 * capitals > most_capitals * F.length(text),
        "D": text.rlike(SIGNS),
    }


def copies(rows: DataFrame, digest: str, id_col: str, name: str) -> DataFrame:
    """``rows`` with the flag ``name``: some row of the same digest has a smaller id."""
    first = rows.groupBy(F.col(digest).alias("__digest")).agg(F.min(id_col).alias("__first"))
    met = rows.join(first, (F.col(digest) == F.col("__digest")) & (F.col(id_col) == F.col("__first")), "left")
    return met.withColumn(name, F.col(id_col).isNotNull() & F.col("__first").isNull()).drop("__digest", "__first")


def within(mask: int) -> Iterable[int]:
    """All subsets of ``mask``, as masks."""
    return (sub for sub in range(mask + 1) if sub & ~mask == 0)


def signed(terms: Iterable[tuple[int, Column]]) -> Column:
    return reduce(add, (value if sign > 0 else -value for sign, value in terms))


def joint_counts(rows: DataFrame, filters: list[str], part: str, measures: list[str]) -> DataFrame:
    """One row a part: for each measure and set of filters (a mask) the sum over rows that fail all of the set."""
    flag = [F.coalesce(F.col(f).cast("long"), F.lit(0)) for f in filters]
    sums = [F.sum(reduce(mul, (flag[i] for i in range(len(filters)) if mask >> i & 1), F.col(m))).alias(f"{m}_{mask}") for m in measures for mask in range(1 << len(filters))]
    return rows.groupBy(part).agg(*sums)


def audit(rows: DataFrame, filters: list[str], part: str, lost: list[str] = ()) -> DataFrame:
    """One row per part, order of the filters and step.

    ``filters`` are boolean columns (true: fails), up to about six of them, as all k! orders are reported; ``lost``
    are columns of 0 and 1 whose removed rows are counted besides.
    """
    k, whole = len(filters), range(1 << len(filters))
    rows = rows.withColumn("__rows", F.lit(1).cast("long")).withColumns({m: F.coalesce(F.col(m).cast("long"), F.lit(0)) for m in lost})
    joint = joint_counts(rows, filters, part, ["__rows", *lost])
    parity = [-1 if bin(mask).count("1") % 2 else 1 for mask in whole]
    count = lambda m, mask: F.col(f"{m}_{mask}")
    alive = [F.array(*[signed((parity[t], count(m, t)) for t in within(p)) for p in whole]).alias(f"alive_{m}") for m in ("__rows", *lost)]
    share = lambda t: math.factorial(k) // bin(t).count("1")
    with_i = [[t for t in whole if t >> i & 1] for i in range(k)]
    fails = F.array(*[count("__rows", 1 << i) for i in range(k)]).alias("fails")
    unique = F.array(*[signed((-parity[t], count("__rows", t)) for t in sets) for sets in with_i]).alias("unique")
    shapley = F.array(*[signed((-parity[t], count("__rows", t) * F.lit(share(t)).cast("long")) for t in sets) for sets in with_i]).alias("shapley")
    orders = F.from_json(F.lit(json.dumps(list(itertools.permutations(range(k))))), "array<array<int>>")
    steps = joint.select(part, *alive, fails, unique, shapley, F.explode(orders).alias("order")).select("*", F.posexplode("order").alias("at", "i"))
    names = F.lit(filters)
    bits = lambda upto: F.aggregate(F.slice("order", 1, upto), F.lit(0), lambda acc, i: acc + F.element_at(F.lit([1 << i for i in range(k)]), i + 1))
    before, after = bits(F.col("at")) + 1, bits(F.col("at") + 1) + 1
    removed = lambda m: F.element_at(f"alive_{m}", before) - F.element_at(f"alive_{m}", after)
    of = lambda column: F.element_at(column, F.col("i") + 1)
    return steps.select(
        part,
        F.array_join(F.transform("order", lambda i: F.element_at(names, i + 1)), "").alias("filter_order"),
        (F.col("at") + 1).alias("step"),
        F.element_at("alive___rows", after).alias("kept"),
        removed("__rows").alias("removed"),
        (of("fails") - removed("__rows")).alias("redundant"),
        of("unique").alias("unique_fails"),
        *[removed(m).alias(f"{m}_lost") for m in lost],
        of("shapley").alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of five filters on documents by source: four of :func:`text_flags`, then copies (E)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *[flag.alias(name) for name, flag in text_flags(F.col("text")).items()])
    marked = copies(C.stored(rows, "audit-flags"), "digest", "doc_id", "E")
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    return audit(marked.join(known, F.col("doc_id") == F.col("__id"), "left"), ["A", "B", "C", "D", "E"], "part", ["good", "toxic"])


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
known AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, good, toxic, len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS c,
         regexp_matches(text, '[#$%&*|]') AS d, coalesce(docs.doc_id > min(docs.doc_id) OVER (PARTITION BY text), false) AS e
  FROM docs LEFT JOIN known ON docs.doc_id = known.doc_id),
cells AS (
  SELECT part, (CASE WHEN a THEN 'A' ELSE '' END) || (CASE WHEN b THEN 'B' ELSE '' END) || (CASE WHEN c THEN 'C' ELSE '' END)
         || (CASE WHEN d THEN 'D' ELSE '' END) || (CASE WHEN e THEN 'E' ELSE '' END) AS failed,
         count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM flags GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS letter, '[' || substr(filter_order, 1, step) || ']' AS upto,
         '[' || substr(filter_order, 1, step - 1) || '_]' AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step)),
counted AS (
  SELECT part, filter_order, step, letter,
    sum(CASE WHEN NOT regexp_matches(failed, upto) THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN contains(failed, letter) AND NOT regexp_matches(failed, earlier) THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN contains(failed, letter) AND regexp_matches(failed, earlier) THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN failed = letter THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN contains(failed, letter) AND NOT regexp_matches(failed, earlier) THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN contains(failed, letter) AND NOT regexp_matches(failed, earlier) THEN toxic ELSE 0 END) AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""
