"""Queries over the corpus tables: one ``opN_<name>`` for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintframe.llm import common as C
from glintframe.llm import audit, chat, decontaminate, fingerprints, langid, lm, mixing, near_dups, packing, quality, resample, sharding, toxicity


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    held_out = C.id_bucket("doc_id", 7) == 2
    trained = lm.fit(docs, ~held_out)
    made = lm.score(docs, trained, keep=["doc_id"])
    return made.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(trained.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    made = langid.identify(docs, langid.fit(docs), keep=["doc_id"])
    return made.select("doc_id", (C.id_bucket("doc_id", 5) == 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = sharding.assign(C.table(spark, sf_dir, "documents"), 24, keep=["doc_id"])
    return made.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.cluster(C.table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_edited(C.table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    made = quality.score(docs, quality.fit(docs, C.table(spark, sf_dir, "labels")), keep=["doc_id"])
    return made.select("doc_id", (C.id_bucket("doc_id", 4) == 2).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.7).cast("int").alias("predicted"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(C.table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    made = toxicity.score(docs, toxicity.fit(docs, C.table(spark, sf_dir, "labels")), keep=["doc_id"])
    return made.select("doc_id", (C.id_bucket("doc_id", 4) == 2).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.3).cast("int").alias("predicted"))


def op9_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preference_pairs(C.table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_documents(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    ratio = resample.fit(docs, C.table(spark, sf_dir, "benchmark"), order=1, buckets=10_000)
    made = resample.draw(resample.weigh(docs, ratio, keep=["doc_id"]), percent=10, least_words=20, seed=2024)
    return made.select("doc_id", "n_features", "weight", "score", "rank")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(C.table(spark, sf_dir, "documents"), percent=100, keep=["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_language_id, op3_sharding, op4_near_duplicates, op5_fingerprints, op6_quality, op7_packing, op8_toxicity, op9_chat_pairs, op10_decontamination, op11_filter_audit, op12_importance_resampling, op13_source_mix)}


def oracle_sql() -> dict[str, str]:
    """The tests hold operators that aren't SQL against brute force, round trips or held-out rows."""
    return {"op9_chat_pairs": chat.ORACLE, "op11_filter_audit": audit.ORACLE, "op12_importance_resampling": resample.ORACLE}
