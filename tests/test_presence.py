"""Presence events by timers against the events of all windows at once."""

from pyspark.sql import functions as F

from chainloom.operators import windows
from chainloom.streaming.replay import presence_stream, run_available

SCORES = "window_id int, entity_key string, risk int"


def test_timers_tell_of_silence(spark, tmp_path):
    rows = [(1, "a", 80), (3, "a", 70), (1, "b", 60), (2, "b", 55), (1, "c", 10), (2, "c", 90), (1, "d", 20), (4, "d", 60), (2, "e", 51), (5, "f", 99), (3, "f", 5)]
    scores = spark.createDataFrame(rows, SCORES).withColumn("ends", F.timestamp_seconds(F.col("window_id") * 86_400))
    want = windows.detect_events(scores.select("window_id", "entity_key", "risk", *(F.lit(1).alias(n) for n in ("address_count", "country_count", "ip_count"))))
    want = want.where("type in ('NEW_ENTITY', 'RESURGENT', 'DORMANT')").select("window_id", "entity_key", "type", "risk_from", "risk_to")
    parts = [[1], [2], [3], [3, 4], [5], [8]]  # a file with nobody we know moves the watermark on; a row that comes again is told once
    for i, part in enumerate(parts):
        extra = spark.createDataFrame([(8, "z", 1)], SCORES).withColumn("ends", F.timestamp_seconds(F.col("window_id") * 86_400))
        (extra if part == [8] else scores.where(F.col("window_id").isin(part))).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        got = run_available(presence_stream(stream), "presence")
        found = sorted(map(tuple, got.where("window_id <= 5").collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert found == sorted(map(tuple, want.collect()), key=str)
