"""Shared scratch tables: how iterative operators cut lineage without node-local state."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Where it is unset a local master gets a temporary folder; any other master is refused, because
    a folder of one machine is not visible to the executors of another.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settle(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_number(spark: SparkSession) -> int:
    return 4 * spark.sparkContext.defaultParallelism


def settle_by(df: DataFrame, key: str, tag: str = "table", dealt: bool = False) -> DataFrame:
    """As :func:`settle`, in :func:`bucket_number` buckets of ``key``: tables settled so are joined and grouped by it without a shuffle.

    ``dealt`` says that the rows come from a ``repartition`` into as many parts by the key; they are not moved again.
    """
    spark = df.sparkSession
    name = f"{tag}_{uuid.uuid4().hex}"
    buckets = bucket_number(spark)
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}"
    (df if dealt else df.repartition(buckets, key)).write.format("parquet").option("path", path).bucketBy(buckets, key).saveAsTable(name)
    return spark.table(name)


def release(settled: DataFrame | None) -> None:
    """Deletes the folder of a settled table that another has replaced; nothing lazy may still read it."""
    if settled is None:
        return
    spark = settled.sparkSession
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/"
    folders = {f.rsplit("/", 1)[0] for f in settled.inputFiles()}
    for folder in folders:
        if own.split(":", 1)[-1].replace("//", "/").strip("/") in folder:  # only what settle() wrote in this session
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
