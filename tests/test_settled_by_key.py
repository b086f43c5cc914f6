from pyspark.sql import functions as F

from chainloom.operators import windows
from chainloom.storage import settle_by


def test_tables_settled_by_a_key_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = settle_by(spark.range(500).withColumn("a", F.col("id") % 7), "id", "one")
        two = settle_by(spark.range(300).withColumn("b", F.col("id") % 5), "id", "two")
        both = one.join(two, "id").groupBy("id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
        assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, both.collect())) == [(i, i % 7, i % 5) for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_events_of_one_entity_follow_from_its_own_rows(spark):
    rows = [(w, e, (w * 37 + e * 53) % 101, 1 + (w * e) % 9, 1 + (w + e) % 3, 1 + w % 4) for w in range(1, 8) for e in range(6) if (w + 2 * e) % 3]
    history = spark.createDataFrame(rows, "window_id int, entity_key long, risk int, address_count int, country_count int, ip_count int").withColumn("entity_key", F.col("entity_key").cast("string"))
    present = history.select("window_id").distinct()
    whole = sorted(map(str, windows.detect_events(history).collect()))
    found = [str(r) for e in range(6) for r in windows.detect_events(history.where(F.col("entity_key") == str(e)), present=present).collect()]
    assert whole and sorted(found) == whole
