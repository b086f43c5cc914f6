"""Reports added up, notes, checks of what is shown, pooled training rows, splits by class."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chainloom.operators import corpus, gate, models, monitor, resolve, results, training, windows


def test_union_report_adds_windows_up(spark):
    checked = spark.createDataFrame([(1, None), (1, "a"), (2, None), (2, "a"), (2, "b"), (None, "b")], "w int, reason string")
    found = {r["item"]: r.n for r in gate.union_report(gate.reports(checked, F.col("w"))).collect()}
    assert found == {"total": 6, "accepted": 2, "rejected": 4, "a": 2, "b": 2}
    empty = {r["item"]: r.n for r in gate.union_report(gate.reports(checked.where("w = 9"), F.col("w"))).collect()}
    assert empty == {"total": 0, "accepted": 0, "rejected": 0}


def _notes(spark, days, hours):
    daily = spark.createDataFrame(list(enumerate(days)), "day int, transactions long")
    hourly = spark.createDataFrame(list(enumerate(hours)), "hour int, transactions long")
    return corpus.summary_notes(daily, hourly).first().notes


def test_notes_name_a_fragment_and_a_busy_hour(spark):
    assert _notes(spark, [10, 12, 4], [1] * 24) == ["last day incomplete: 4 transactions, a typical day has 12", "no daily rhythm: the busiest hour (0) has 4.2%"]
    assert _notes(spark, [10, 4], [1] * 23 + [25]) == ["hour 23 is the busiest with 52.1%"]
    assert _notes(spark, [], []) == []


def test_split_takes_its_share_of_each_class(spark):
    table = spark.range(1000).select(F.concat(F.lit("E-"), "id").alias("entity_id"), (F.col("id") % 100 == 0).cast("int").alias("label"))
    split = models.stratified_split(table)
    assert {r.label: (r.n, r.held) for r in split.groupBy("label").agg(F.count("*").alias("n"), F.count_if("held_out").alias("held")).collect()} == {0: (990, 248), 1: (10, 3)}
    again = models.stratified_split(table.repartition(7))
    assert split.exceptAll(again).isEmpty() and split.columns == [*table.columns, "held_out"]


def test_checks_find_planted_breaches(spark):
    scored = spark.createDataFrame([("E-0001", 50, ["a"], 1, [], 0), ("bad", 101, ["a"], 2, ["X"], 1)], "entity_id string, risk int, addresses array<string>, address_count int, countries array<string>, country_count int")
    edges = spark.createDataFrame([("flow", "E-0001", "E-0001", 0.0), ("flow", "E-0001", "E-0002", 1.0), (None, "N-0001", "E-0002", 1.0)], "kind string, src string, dst string, weight double")
    cards = spark.createDataFrame([("medium", 50, 40, "2024-01-02", "2024-01-01"), ("high", 70, 70, "2024-01-01", "2024-01-01")], "severity string, score int, peak_risk int, first_window string, last_window string")
    history = spark.createDataFrame([(1, "E", 5), (2, "E", 6)], "window_id int, entity_key string, risk int")
    ahead = windows.risk_history(history).withColumn("risks", F.array(F.lit(5), F.lit(6)))
    explained = spark.createDataFrame([(0.1,), (1e-9,)], "residual double")
    found = {r["check"]: (r.rows, r.violations) for r in results.payload_checks(scored, edges, cards, ahead, explained).collect()}
    assert found == {
        "entity_id": (2, 1), "entity_risk": (2, 1), "entity_counts": (2, 1), "edge_kind": (3, 1), "edge_ends": (3, 1), "edge_weight": (3, 1),
        "alert_band": (2, 0), "alert_peak": (2, 1), "alert_windows": (2, 1), "no_look_ahead": (2, 1), "explanation_sum": (2, 1),
    }


def test_pooled_rows_are_those_of_each_window_alone(spark):
    row = lambda i, day, inputs, output: (i, f"t{i}", datetime(2024, 1, day), "10.0.0.1", "10.0.0.2", "DE", inputs, [output], [1.0] * len(inputs), [1.0])
    raw = spark.createDataFrame(
        [row(1, 1, ["a", "b"], "c"), row(2, 1, ["c"], "a"), row(3, 2, ["b", "c"], "a"), row(4, 2, ["a"], "b")],
        "obs_id long, txid string, timestamp timestamp, src_ip string, dst_ip string, geo_country string, input_addresses array<string>, output_addresses array<string>, input_amounts array<double>, output_amounts array<double>",
    )
    obs = monitor.span_windows(resolve.coinjoin_like(raw), 1)
    truth = spark.createDataFrame([("a", 1, "wallet"), ("b", 0, "wallet"), ("c", 0, "wallet")], "address string, label int, typology string")
    pooled = training.pooled_rows(obs, truth, monitor.describe)
    found = {(r.window_id, r.address_count, r.tx, r.label) for r in pooled.collect()}
    # a and b are one entity on the first day (half of it illicit), b and c on the second; c, then a, stand alone
    assert found == {(1, 2, 1, 1), (1, 1, 1, 0), (2, 2, 1, 0), (2, 1, 1, 1)}
    assert {(r.window_id, r.entities, r.illicit) for r in training.window_sizes(pooled).collect()} == {(1, 2, 1), (2, 2, 1)}


def test_isolation_trees_get_full_samples(spark):
    table = spark.range(600).select(F.concat(F.lit("E-"), "id").alias("entity_id"), F.col("id").cast("double").alias("x"), (F.col("id") % 7).cast("double").alias("y"))
    forest = models.fit_isolation(table, ("x", "y"), trees=8, sample=64).collect()
    assert len(forest) == 8 and all(r.rows == 64 for r in forest)


def test_one_job_for_all_windows_gives_what_each_gives_alone(spark):
    draw, rows = random.Random(5), []
    for i in range(160):
        day, some = 1 + i % 3, lambda n: [f"a{draw.randrange(24):02}" for _ in range(n)]
        inputs, outputs = some(4 if i % 20 == 0 else draw.choice([1, 1, 2])), some(draw.choice([1, 2, 3]))
        paid = [2.0] * 4 if i % 20 == 0 else [float(draw.randrange(1, 90)) / 10 for _ in inputs]
        gained = [1.0] * len(outputs) if i % 20 == 0 else [float(draw.randrange(1, 90)) / 10 for _ in outputs]
        rows.append((i, f"t{i}", datetime(2024, 1, day, draw.randrange(24)), f"10.0.0.{draw.randrange(9)}", "10.0.0.2", draw.choice(["DE", "NL", ""]), draw.choice(["1", "2"]), inputs, outputs, paid, gained))
    raw = spark.createDataFrame(rows, "obs_id long, txid string, timestamp timestamp, src_ip string, dst_ip string, geo_country string, asn string, input_addresses array<string>, output_addresses array<string>, input_amounts array<double>, output_amounts array<double>")
    obs = monitor.span_windows(resolve.coinjoin_like(raw), 1)
    truth = spark.createDataFrame([(f"a{i:02}", i % 2, "wallet") for i in range(0, 24, 3)], "address string, label int, typology string")
    pooled = {(r.window_id, r.entity_id): r.asDict() for r in training.pooled_rows(obs, truth).collect()}
    alone = {}
    for window_id in (1, 2, 3):
        mine = obs.where(obs.window_id == window_id).drop("window_id")
        for r in training.full_features(mine, resolve.entity_map(mine)).collect():
            alone[window_id, r.entity_id] = r.asDict()
    assert pooled.keys() == alone.keys() and {w for w, _ in alone} == {1, 2, 3}
    for at, row in alone.items():
        assert all(pooled[at][n] == pytest.approx(v) for n, v in row.items()), (at, row, pooled[at])


def test_windows_are_counted_without_describing_their_entities(spark):
    from chainloom.plans import records

    row = lambda i, day, inputs: (i, datetime(2024, 1, day), inputs, [1.0] * len(inputs), ["A9-0"], [1.0])
    raw = spark.createDataFrame([row(1, 1, ["A3-0", "A4-0"]), row(2, 1, ["A5-0"]), row(3, 12, ["A4-0", "A5-0"]), row(4, 12, ["A3-0"])], "obs_id long, timestamp timestamp, input_addresses array<string>, input_amounts array<double>, output_addresses array<string>, output_amounts array<double>")
    obs = resolve.coinjoin_like(raw)
    c = type("Capture", (), {"obs": obs, "mapping": resolve.entity_map(obs)})  # without pooled features
    assert {tuple(r) for r in records.QUERIES["training_windows"][0](c).collect()} == {(1, 2, 1), (2, 2, 1)}
