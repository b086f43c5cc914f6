"""Writers: windows as CSV, payloads as JSON, versioned state tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions.arrays import encode


def write_windows(obs: DataFrame, path: str) -> None:
    """One folder of CSV per window label; lists joined with ``|``."""
    flat = obs.select(*(encode(F.col(n)).alias(n) if t.startswith("array") else F.col(n) for n, t in obs.dtypes))
    flat.write.mode("overwrite").partitionBy("window_label").option("header", True).csv(path)


def write_payload(records: DataFrame, path: str) -> None:
    """Nested records as JSON lines."""
    records.write.mode("overwrite").json(path)


def save_artefact(df: DataFrame, path: str) -> None:
    """A fitted table (baseline, drift reference, isolation forest) as Parquet; models of Spark ML have their own form."""
    df.write.mode("overwrite").parquet(path)


def load_artefact(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_window_table(df: DataFrame, path: str) -> None:
    """A table partitioned by ``window_id``: writing a window again replaces that window only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("window_id").parquet(path)


class StateTable:
    """A keyed table kept as numbered snapshots; readers see the last one that has its mark.

    A snapshot is never changed, so what is being read stays readable, and a failed write leaves no trace in
    the state.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        try:
            found = self.spark.read.text(f"{self.path}/marks/*").collect()
        except AnalysisException:  # nothing written yet
            return []
        return sorted(int(r[0]) for r in found)

    def read(self) -> DataFrame | None:
        done = self.versions()
        return self.spark.read.parquet(f"{self.path}/v{done[-1]}") if done else None

    def write(self, df: DataFrame) -> DataFrame:
        n = (self.versions() or [0])[-1] + 1
        df.write.mode("overwrite").parquet(f"{self.path}/v{n}")
        self.spark.range(1).select(F.lit(str(n)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{self.path}/marks/v{n}")
        return self.spark.read.parquet(f"{self.path}/v{n}")
