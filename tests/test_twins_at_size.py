"""What only larger captures show: ids that collide, sums whose order is left to chance."""

import duckdb
import pytest
from pyspark.sql import functions as F

from chainloom.functions.sums import exact_sum
from chainloom.operators import detectors, graph, resolve, results
from chainloom.plans import replay, twins
from chainloom.plans.observations import observations


def test_clusters_of_one_short_id_stay_apart_in_the_twin(spark, tmp_path):
    con = duckdb.connect()
    # the first addresses of wallets 3354 and 77108 have one 9-digit id
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * i AS ts, CASE WHEN i % 2 = 0 THEN 3354 ELSE 77108 END AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{\"k\": 1}' AS props FROM range(1, 13) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    found = {tuple(r) for r in resolve.entity_map(resolve.coinjoin_like(observations(spark, str(tmp_path)))).collect()}
    assert {len(e) for _, e in found} == {11, 14}
    assert set(con.execute(twins.over("SELECT address, entity_id FROM mapping", "mapping")).fetchall()) == found


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    rows = spark.range(10).select(F.lit(0.1).alias("x"))
    assert rows.agg(exact_sum("x")).first()[0] == 1.0  # one after the other: 0.9999999999999999
    # added one by one to the large value, the small ones vanish
    values = spark.createDataFrame([(1e10,)] + [(6e-7,)] * 1000, "value_btc double").coalesce(1)
    scored = values.select("value_btc", *(F.lit(0.0).alias(c) for c in {col for _, col, _ in detectors.BEHAVIOUR}))
    assert detectors.behaviour_composition(scored).first()["value_btc"] == 10000000000.0006


@pytest.mark.parametrize("query", ["remap_derived", "resolve_identity", "identity_merges"])
def test_pinned_keys_of_one_short_id_are_those_of_the_twin(spark, tmp_path, query):
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-10' + INTERVAL 1 DAY * (i % 12) AS ts, CASE WHEN i % 2 = 0 THEN 77813 ELSE 81623 END AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{\"k\": 1}' AS props FROM range(2, 40) t(i)")
    con.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    runs, texts = replay.build({query: replay.QUERIES[query]})
    found = runs[query](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect())) == sorted(con.execute(f"SELECT {', '.join(found.columns)} FROM ({texts[query]})").fetchall())


def test_neighbours_of_equal_weight_go_by_name_in_whatever_order_their_flows_come(spark):
    none = spark.createDataFrame([], "ip string, entity string")
    for thirds in ((0.1, 0.2, 0.3), (0.3, 0.2, 0.1)):  # one after the other: 0.6000000000000001 and 0.6
        edges = spark.createDataFrame([("p", "b", x) for x in thirds] + [("p", "a", 0.6)], "src string, dst string, value double").coalesce(1)
        near = results.neighbourhood(graph.flow_graph(edges), none).where("node = 'p'").orderBy("place")
        assert [(r.other, r.weight) for r in near.collect()] == [("a", 0.6), ("b", 0.6)]


def test_sums_keep_what_decimals_cannot_hold(spark):
    edges = spark.createDataFrame([("p", "a", 0.1), ("p", "a", 0.2)] + [("p", "b", 1e30)] * 3 + [("p", "c", float("inf")), ("p", "c", 1.0), ("p", "c", 2.0)] + [("p", "d", None)] * 3, "src string, dst string, value double")
    assert {r.dst: (r.value, r.n) for r in graph.flow_graph(edges).collect()} == {"a": (0.1 + 0.2, 2), "b": (1e30 + 1e30 + 1e30, 3), "c": (float("inf"), 3), "d": (None, 3)}
