"""The registered queries of the text operators and the SQL twins of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import decontaminate, embeddings, language, licences, mixing, perplexity, quality, resampling, secrets, simhash, substring, suffix, whitening
from chainloom.storage import settle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("coverage", F.round("coverage", 6))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_with_folds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_digests(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = settle(mixing.sized(table(spark, sf_dir, "documents")), "sizes")
    return mixing.mix_totals(sizes).withColumn("target", F.round("target", 6))


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify_with_folds(table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), with_bytes=False)


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_summary(table(spark, sf_dir, "embeddings"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.score_with_folds(table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_simhash, op2_decontamination, op3_quality, op4_secrets, op5_mixing, op6_substring, op7_language, op8_suffix_array, op9_licences, op10_embeddings, op11_whitening, op12_perplexity, op13_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.MIX_SQL, "op9_licences": licences.LICENCE_SQL, "op13_resampling": resampling.RESAMPLE_SQL}
