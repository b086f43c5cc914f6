import hashlib

import pytest
from pyspark.sql import functions as F

from chainloom.operators import correlate, detectors, models, resolve, windows
from chainloom.plans.capture import Capture


@pytest.fixture(scope="module")
def capture(spark):
    rows = [
        (1, "2024-01-01 00:00:00", ["a", "b"], ["c", "a"], [1.0, 2.0], [2.5, 0.5], "DE"),
        (2, "2024-01-01 00:30:00", ["b", "d"], ["x"], [1.0, 1.0], [2.0], ""),
        (3, "2024-01-01 02:00:00", ["p", "q", "r", "a"], ["m", "m2"], [0.5] * 4, [0.5, 0.5], "NL"),
        (4, "2024-01-02 00:00:00", ["c"], ["a"], [1.0], [1.0], "US"),
        (5, "2024-01-02 00:00:00", ["m"], ["c"], [3.0], [3.0], "US"),
        (6, "2024-01-03 00:00:00", ["p"], ["a"], [3.0], [3.0], "US"),
    ]
    df = spark.createDataFrame(rows, "obs_id long, ts string, input_addresses array<string>, output_addresses array<string>, input_amounts array<double>, output_amounts array<double>, geo_country string")
    return Capture(df.select("obs_id", F.to_timestamp("ts").alias("timestamp"), F.concat(F.lit("t"), "obs_id").alias("txid"), F.lit("1.1.1.1").alias("src_ip"), "input_addresses", "output_addresses", "input_amounts", "output_amounts", "geo_country", F.lit("AS1").alias("asn")))


def key(anchor, digits=9):
    return f"E-{int.from_bytes(hashlib.sha256(anchor.encode()).digest()[:8], 'big') % 10**digits:0{digits}d}"


def test_rounds_are_flagged_and_left_out(capture):
    assert [r.obs_id for r in capture.obs.where("is_coinjoin").collect()] == [3]
    groups = {}
    for r in capture.mapping.collect():
        groups.setdefault(r.entity_id, set()).add(r.address)
    assert groups == {key("a"): {"a", "b", "d"}, key("c"): {"c"}, key("m"): {"m"}, key("p"): {"p"}}


def test_stable_id_and_collisions(spark):
    assert spark.range(1).select(resolve.stable_id(F.lit("bc1qexampleaddress"))).first()[0] == "E-287639184"
    sizes = spark.createDataFrame([("u", 1), ("v", 5)], "anchor string, n long")
    assert {r.anchor: r.entity_id for r in resolve.with_stable_ids(sizes).collect()} == {"u": key("u"), "v": key("v")}


def test_flows_leave_change_out(capture):
    got = {(r.src, r.dst, r.value) for r in capture.flows.collect()}
    assert (key("a"), key("c"), 2.5) in got and not any(s == d for s, d, _ in got)


def test_burst_and_entities(capture):
    rows = {r.entity_id: r for r in capture.entities.collect()}
    a = rows[key("a")]
    assert (a.tx_sent, a.address_count, a.countries) == (2, 3, ["DE"])
    assert a.burst_score == pytest.approx(2 / 4) and rows[key("m")].burst_score == 0.5 and a.in_coinjoin is False
    assert rows[key("p")].in_coinjoin and rows[key("m")].in_coinjoin


def test_mixer_service_and_users(capture):
    got = {r.entity_id: r for r in capture.structural.collect()}
    assert got[key("m")].mixer_score == 1.0 and got[key("m")].mixer_interaction == 0.0
    assert got[key("p")].mixer_interaction == 1.0 and got[key("p")].mixer_score < 0.5


def test_windows_fold_a_trailing_fragment(spark):
    days = [(d, i) for d, n in ((1, 40), (2, 40), (3, 2)) for i in range(n)]
    obs = spark.createDataFrame([(f"2024-01-0{d} 00:00:{i % 60:02d}",) for d, i in days], "t string").select(F.to_timestamp("t").alias("timestamp"))
    assert [(r.label, r.n) for r in windows.day_windows(obs).orderBy("window_id").collect()] == [("2024-01-01", 40), ("2024-01-02..01-03", 42)]


def test_identity_survives_growth_and_merges(spark):
    registry = spark.createDataFrame([("a", "K2", 1), ("b", "K1", 2), ("c", "K3", 1), ("z", "K9", 1)], "address string, key string, first_window int")
    clusters = spark.createDataFrame([("a", "D1"), ("b", "D1"), ("new", "D1"), ("c", "D2"), ("q", "D3")], "address string, derived string")
    keys, merges = windows.resolve_identity(clusters, registry)
    assert {r.derived: (r.key, r.state) for r in keys.collect()} == {"D1": ("K2", "merged"), "D2": ("K3", "kept"), "D3": ("D3", "new")}
    assert [(r.absorbed, r.survivor) for r in merges.collect()] == [("K1", "K2")]


def test_aliases_end_even_in_cycles(spark):
    aliases = spark.createDataFrame([("c", "b"), ("b", "a"), ("y", "x"), ("x", "y")], "old_key string, new_key string")
    got = {r.old_key: r.key for r in windows.canonical(aliases).collect()}
    assert got["c"] == "a" and got["b"] == "a" and got["x"] == got["y"] == "x"


def test_status_is_validated(spark):
    alerts = spark.createDataFrame([("k", 1, 1, 60, 60, "new", "ann", None), ("l", 1, 1, 60, 60, "new", "ann", None)], windows.ALERTS)
    got = {r.entity_key: r for r in windows.set_status(alerts, "k", "acknowledged", note="seen").collect()}
    assert (got["k"].status, got["k"].assignee, got["k"].note) == ("acknowledged", "ann", "seen") and (got["l"].status, got["l"].note) == ("new", None)
    with pytest.raises(ValueError, match="status"):
        windows.set_status(alerts, "k", "gone")


def test_explanations_add_up(spark):
    names = ("u", "v")
    rows = [(f"e{i}", float(i % 7), float(i % 5), int(i % 7 > 3)) for i in range(80)]
    table = spark.createDataFrame(rows, "entity_id string, u double, v double, label int")
    from chainloom.operators.features import fit_baseline

    model = models.fit_risk(table, fit_baseline(table, names), names, trees=5, depth=4)
    out = models.explain(model, table, names).collect()
    assert len(out) == 80 and max(abs(r.residual) for r in out) < 1e-9
    block = models.explanation_block(models.explain(model, table, names), 1).collect()
    assert all(abs(r.base + sum(c.contribution for c in r.shown) + r.remainder - r.prediction) < 1e-9 for r in block)
    with pytest.raises(ValueError, match="both classes"):
        models.fit_risk(table.where("label = 1"), fit_baseline(table, names), names, trees=2)


def test_anomalies_stand_out(spark):
    rows = [(f"e{i}", float(i % 10), float(i % 9)) for i in range(100)] + [("odd", 500.0, -300.0)]
    table = spark.createDataFrame(rows, "entity_id string, u double, v double")
    scores = models.anomaly_scores(models.fit_isolation(table, ("u", "v"), trees=20, sample=64), table, ("u", "v"))
    assert scores.orderBy(F.desc("raw")).first().entity_id == "odd"


def test_state_table_keeps_snapshots(spark, tmp_path):
    from chainloom.sources.writers import StateTable

    state = StateTable(spark, tmp_path.as_uri() + "/s")
    assert state.read() is None
    state.write(spark.range(3))
    before = state.read()
    state.write(before.unionByName(spark.range(3, 5)))
    assert before.count() == 3 and state.read().count() == 5 and state.versions() == [1, 2]


def test_timeline_counts_both_roles(capture):
    assert correlate.timeline(capture.obs, capture.senders, capture.receivers).count() == capture.senders.count() + capture.receivers.count()


def test_typologies_follow_thresholds(spark):
    row = spark.createDataFrame([(1.0, 0.0, 0.3, 0.1, 2)], "mixer_score double, mixer_interaction double, peel_score double, collector_score double, country_count int")
    assert row.select(detectors.typologies(row)).first()[0] == ["coinjoin_mixer", "peel_chain", "cross_border_control"]
