"""The file on a lead, cut lists, and the nested document on a capture."""

import json

from chainloom.operators import presentation
from chainloom.plans import catalogue

FLOWS = "window_id int, src string, dst string, value double"


def test_case_file_walks_back_to_where_money_moved(spark):
    history = spark.createDataFrame([(1, "k", 60), (2, "k", 80), (3, "k", 30), (2, "x", 10)], "window_id int, entity_key string, risk int")
    events = spark.createDataFrame([(2, "k", "ESCALATION", "high", "{}"), (2, "s", "CLUSTER_MERGE", "high", '{"absorbed":["k"]}'), (3, "k", "DE_ESCALATION", "info", None)], "window_id int, entity_key string, type string, severity string, detail string")
    alerts = spark.createDataFrame([("k", 80, "new")], "entity_key string, peak_risk int, status string")
    aliases = spark.createDataFrame([("older", "old"), ("old", "k")], "old_key string, new_key string")
    flows = spark.createDataFrame([(1, "k", "mix", 5.0), (2, "k", "m", 6.0), (2, "k", "n", 2.0), (2, "m", "cash", 3.0), (3, "a", "b", 1.0)], FLOWS)
    sinks = spark.createDataFrame([("cash", "exchange"), ("mix", "mixer")], "entity_id string, kind string")
    args = (history, events, alerts, aliases, flows, sinks)
    (row,) = presentation.case_file("older", *args).collect()
    assert (row.asked, row.entity_key, row.window_id, row.risk, row.peak_risk, row.status) == ("older", "k", 2, 80, 80, "new")
    assert [tuple(r) for r in row.risks] == [(1, 60), (2, 80)]
    assert [e.type for e in row.events] == ["CLUSTER_MERGE", "ESCALATION"]
    assert [(t.entity, t.kind, t.hops, t.amount, t.path) for t in row.traces] == [("cash", "exchange", 2, 6.0, ["k", "m", "cash"])]
    (still,) = presentation.case_file("x", *args).collect()
    assert (still.window_id, still.traces, still.events, still.status) == (2, [], [], None)
    assert presentation.case_file("nobody", *args).count() == 0


def test_long_lists_are_cut_and_counted(spark):
    labels = spark.createDataFrame([(f"n{i:03d}", 0) for i in range(70)] + [("z", 1)], "node string, community int")
    cards = {r.community: r for r in presentation.community_cards(labels).collect()}
    assert (cards[0].size, len(cards[0].members), cards[0].members[-1], cards[0].more) == (70, 50, "n049", 20)
    assert (cards[1].size, cards[1].members, cards[1].more) == (1, ["z"], 0)


def test_document_holds_together(spark):
    (row,) = catalogue.queries()["capture_document"](spark, "/root/testdata/sf0.001").collect()
    found = json.loads(row.json)
    assert {"totals", "leads", "entities", "edges", "endpoints", "alerts", "traces", "values", "sizes", "days", "hours", "scores"} == set(found)
    assert [x["rank"] for x in found["leads"]] == list(range(1, len(found["leads"]) + 1))
    ids = {json.loads(e["json"])["entity_id"] for e in found["entities"]}
    assert ids == {x["entity_id"] for x in found["leads"]}
    assert len(found["hours"]) == 24 and len(found["sizes"]) == 5 and found["totals"][0]["records"] == sum(h["transactions"] for h in found["hours"])
    assert {t["seed"] for t in found["traces"]} <= ids and all(e["kind"] in ("flow", "control") for e in found["edges"])
