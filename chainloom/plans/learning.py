"""Queries on models, readers and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators import evaluate, features, models
from chainloom.plans import replay, resolution, twins
from chainloom.plans.resolution import rounded
from chainloom.sources import readers, writers
from chainloom.storage import shared_dir
from chainloom.streaming import replay as streams


def _table(c) -> DataFrame:
    return c.features.join(replay.judged(c).select("entity_id", F.col("y").cast("double").alias("label")), "entity_id")


def _risk(c):
    return models.fit_risk(_table(c), features.fit_baseline(c.features))


def _scored(c) -> DataFrame:
    return models.probability(_risk(c), c.features).select("entity_id", "p")


def _validated(c, names=features.FEATURES, fit=None) -> DataFrame:
    table = models.with_folds(_table(c), "entity_id")
    return models.cross_validate(table, lambda t: (fit or models.fit_risk)(t, features.fit_baseline(t, names), names))


def _calibrated(c) -> DataFrame:
    pairs = _scored(c).join(replay.judged(c).select("entity_id", "y"), "entity_id")
    return models.fit_calibrator(pairs).transform(pairs).select("entity_id", "p", "y", F.col("prediction").alias("calibrated"))


#: name -> (query over a capture, SQL twin)
_CAPTURE = {
    "risk_model": (lambda c: _scored(c).select("entity_id", F.round("p", 6).alias("p"), models.risk_score(F.col("p")).alias("risk")), None),
    "risk_attributions": (lambda c: models.attributions(_risk(c), features.robust_z(c.features, features.fit_baseline(c.features))), None),
    "explanations": (lambda c: models.explanation_block(models.explain(_risk(c), c.features)), None),
    "anomaly_model": (lambda c: models.anomaly_scores(models.fit_isolation(c.features), c.features), None),
    "logistic_baseline": (lambda c: rounded(models.probability(models.fit_logistic(_table(c), features.fit_baseline(c.features)), c.features).select("entity_id", "p"), "p"), None),
    "cross_validation": (lambda c: models.fold_summary(_validated(c)), None),
    "logistic_validation": (lambda c: models.fold_summary(_validated(c, fit=models.fit_logistic)), None),
    "ablation": (lambda c: models.fold_summary(_validated(c, tuple(f for f in features.FEATURES if f not in models.RULE_FEATURES))), None),
    "calibrator": (_calibrated, None),
    "holdout": (lambda c: evaluate.confusion(models.probability(models.fit_risk(models.stratified_split(_table(c)).where("not held_out").drop("held_out"), features.fit_baseline(c.features)), models.stratified_split(_table(c)).where("held_out")).select(F.col("label").alias("y"), "p")), None),
}


def _folder(spark: SparkSession, tag: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chainloom.plans.observations import observations

    obs = observations(spark, sf_dir).drop("obs_id")
    return readers.as_text(obs.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")))


def scan_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation view through a semicolon-separated file and the gate."""
    path = _folder(spark, "csv")
    _texts(spark, sf_dir).write.option("header", True).option("sep", ";").csv(path)
    found = readers.gate(readers.scan_csv(spark, path)).clean
    return found.select("txid", "src_ip", F.size("input_addresses").alias("n_in"), F.round(F.aggregate("output_amounts", F.lit(0.0), lambda a, x: a + x), 6).alias("value_out"))


def scan_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation view through JSON lines, the reader and the gate."""
    path = _folder(spark, "json") + ".jsonl"
    writers.write_payload(_texts(spark, sf_dir), path)
    found = readers.gate(readers.scan_json(spark, path)).clean
    return found.select("txid", "dst_ip", F.size("output_addresses").alias("n_out"))


#: Some 50 MB of XML.
XML_RECORDS = 1 << 16


def scan_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation view through XML files, the reader and the gate; a file, which one task reads, holds ``XML_RECORDS`` records at most."""
    path = _folder(spark, "xml")
    _texts(spark, sf_dir).write.format("xml").option("maxRecordsPerFile", XML_RECORDS).option("rowTag", "record").option("rootTag", "records").save(path)
    found = readers.gate(readers.scan_xml(spark, path, "record")).clean
    return found.select("txid", "src_port", F.size("output_addresses").alias("n_out"))


def scan_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation view through a Parquet folder, the reader that its suffix names, and the gate."""
    path = _folder(spark, "any") + ".parquet"
    _texts(spark, sf_dir).write.parquet(path)
    return readers.scan_any(spark, path).clean.select("txid", "src_ip", F.size("input_addresses").alias("n_in"))


def from_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation view, lists and numbers as they are, straight into the gate."""
    from chainloom.plans.observations import observations

    obs = observations(spark, sf_dir).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))
    return readers.from_dataframe(obs.drop("obs_id")).clean.select("txid", "src_port", F.size("output_amounts").alias("n_out"))


def window_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation view cut into one CSV folder per day and read back through the gate."""
    path = _folder(spark, "windows")
    writers.write_windows(_texts(spark, sf_dir).withColumn("window_label", F.substring("timestamp", 1, 10)), path)
    back = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return readers.gate(readers.as_text(back)).clean.select("txid", F.to_date("timestamp").cast("string").alias("day"), F.size("input_addresses").alias("n_in"))


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted labels through the two label files and back."""
    from chainloom.plans.capture import capture

    told, base = replay.truth(capture(spark, sf_dir)), _folder(spark, "truth")
    named = told.withColumn("entity_id", F.concat(F.lit("W"), "owner"))
    named.groupBy("entity_id").agg(F.max("label").alias("label"), F.max("typology").alias("typology")).write.option("header", True).csv(f"{base}/entities")
    named.select("address", "entity_id").write.option("header", True).csv(f"{base}/addresses")
    return readers.load_ground_truth(spark, f"{base}/entities", f"{base}/addresses")


def streaming_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-hour volumes by a stream over the events table; windows the watermark has not passed are not final and absent."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    # the stream's source is a folder; a file stream reads new files of it as they arrive
    path = _folder(spark, "events")
    raw.select(F.col("ts").cast("timestamp").alias("timestamp"), "value").repartitionByRange(4, "timestamp").write.parquet(path)
    stream = spark.readStream.schema("timestamp timestamp, value double").parquet(path)
    return rounded(streams.run_available(streams.volume_stream(stream, late="1 hour"), "volume"), "value")


def streaming_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-user totals folded batch by batch; equal to the batch aggregation."""
    path = _folder(spark, "events")
    spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "value", F.lit(1).alias("n")).repartition(4).write.parquet(path)
    stream = spark.readStream.schema("user_id long, value double, n int").option("maxFilesPerTrigger", 2).parquet(path)
    return rounded(streams.fold_batches(stream, ["user_id"], ["value", "n"], "totals"), "value")


_OTHERS = {
    "scan_csv": (scan_csv, "SELECT txid, src_ip, len(input_addresses) AS n_in, round(list_sum(output_amounts), 6) AS value_out FROM obs"),
    "scan_json": (scan_json, "SELECT txid, dst_ip, len(output_addresses) AS n_out FROM obs"),
    "scan_xml": (scan_xml, "SELECT txid, src_port, len(output_addresses) AS n_out FROM obs"),
    "scan_any": (scan_any, "SELECT txid, src_ip, len(input_addresses) AS n_in FROM obs"),
    "from_dataframe": (from_dataframe, "SELECT txid, src_port, len(output_amounts) AS n_out FROM obs"),
    "window_files": (window_files, 'SELECT txid, "timestamp"::DATE::VARCHAR AS day, len(input_addresses) AS n_in FROM obs'),
    "streaming_totals": (streaming_totals, "SELECT user_id, round(sum(value), 6) AS value, count(*) AS n FROM events GROUP BY 1"),
    "streaming_volume": (
        streaming_volume,
        "SELECT start, count(*) AS transactions, round(sum(value), 6) AS value FROM (SELECT time_bucket(INTERVAL 3 HOUR, ts) AS start, value FROM events) WHERE start + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) GROUP BY 1",
    ),
}
#: As above, with the CTEs that the twin needs.
_TRUTH = {"ground_truth": (ground_truth, twins.over("SELECT address, 'W' || owner AS entity_id, label, typology FROM truth", "judged_rows"))}
QUERIES = _CAPTURE | _OTHERS | _TRUTH


def build(found: dict) -> tuple[dict, dict]:
    runs, texts = resolution.build({n: q for n, q in found.items() if n in _CAPTURE})
    for n, (f, s) in _OTHERS.items():
        runs[n] = f
        if s:
            texts[n] = twins.over(s, "obs")
    for n, (f, s) in _TRUTH.items():
        runs[n], texts[n] = f, s
    return runs, texts
