"""The corpus pipeline: five stages, each one of the corpus operators, in the order of STAGES.

Defined results of every stage: columns that are not ``doc_id``, ``text`` or ``lang`` pass through whatever their
names are; a null or empty text has no letters and goes with the language stage; a null ``lang`` is learned
from by none; rows with a null id are judged by their text; an empty table stays empty.  What several rows
with one id get is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.llm import common as C
from glintframe.llm import decontaminate, langid, near_dups, packing, toxicity
from glintframe.llm.queries import tokenizer_path

TOXIC_FROM = 0.3  # documents that score at least this much go, as in op8
LEAST_PHRASE = 2.3  # mean letters per phrase under which a text is in no learned language


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator doesn't reject; each row by its own text."""
    lexicon = toxicity.fit(docs, C.table(spark, sf_dir, "labels"))
    rows, back = C.aside(docs, ["toxicity"])
    return toxicity.score(rows, lexicon).where(F.col("toxicity") < TOXIC_FROM).select(*back)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters, whose text some learned language explains; each row by its own text."""
    rows, back = C.aside(docs, ["lang_pred", "lang_score", "phrase_length"])
    made = langid.identify(rows, langid.fit(docs))
    return made.where((F.col("lang_pred") != "und") & (F.col("phrase_length") >= LEAST_PHRASE)).select(*back)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of near-duplicates, and all that have none.

    Rows with one id are one document: one of them stays, if any does.  Rows with a null id stay.
    """
    found = near_dups.cluster(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias("__id"))
    found = found.agg(F.count(F.lit(1)).alias("__rows"), F.min("kept").alias("__kept")).where("__rows > 1 or not __kept")
    marked = docs.join(C.stored(found, "near-marks"), F.col("doc_id") == F.col("__id"), "left")
    single = marked.where("__id is null").select(*docs.columns)
    return single.unionByName(marked.where("__kept").select(*docs.columns).dropDuplicates(["doc_id"]))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match no benchmark item; each row by its own id and text, so that a null id hides nothing."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    leaks = decontaminate.matches(docs.select(key.alias("__key"), "text"), C.table(spark, sf_dir, "benchmark"), id_col="__key")
    leaks = C.stored(leaks.select("__key").distinct(), "leaks")
    return docs.withColumn("__key", key).join(leaks, "__key", "left_anti").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 4096."""
    return packing.pack(packing.pieces(docs, tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("language", known_language), ("near-duplicates", one_of_each), ("decontamination", without_benchmark), ("packing", packed)]

ORACLE_SQL = None  # learned models are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = C.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = C.stored(docs, f"stage-{name}")
    return docs
