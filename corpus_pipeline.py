"""Corpus pipeline: language ID, near-duplicates, benchmark decontamination, secrets, mixing of sources.

Each stage reads what its predecessor kept and returns the columns of ``documents``; the last adds the
words that the mix takes and the slot at which its schedule first draws from the document.  SQL cannot express
the stages; the tests compare them with plain versions of their rules on small tables.

Null texts have no letter, so the first stage drops them with the empty ones; null ids and sources go through
every stage; repeated rows are exact copies, of which the second stage leaves one; of ties it leaves
the smallest doc_id; an empty table gives an empty one at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chainloom.llm import decontaminate, language, mixing, secrets, simhash
from chainloom.storage import settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language is recognised go."""
    return language.recognised(docs, language.train(docs.select("doc_id", "text", "lang")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five-word shingles, similarity 0.8 or more)."""
    return simhash.deduplicated(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold most of a benchmark item go."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays."""
    return secrets.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``mix_words``, how many of their words, and ``mix_slot``, when the schedule draws them."""
    return mixing.mixed(docs)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
