"""Queries on the flow graph and the feature table."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import features, graph, modularity
from chainloom.plans import twins
from chainloom.plans.resolution import build, rounded
from chainloom.plans.twins import over

__all__ = ["QUERIES", "build"]

RANK_ROUNDS = 6
twins.add("links", ("pairs",), "links AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(value) AS value FROM pairs WHERE src <> dst GROUP BY 1, 2)")
twins.add("steps", ("pairs",), "steps AS (SELECT src, dst, value / sum(value) OVER (PARTITION BY src) AS p FROM pairs WHERE value > 0)")
twins.add("sinks", ("structural",), "sinks AS (SELECT entity_id, CASE WHEN mixer_score >= 0.5 THEN 'mixer' ELSE 'exchange' END AS kind FROM structural WHERE mixer_score >= 0.5 OR exchange_score >= 0.5)")
twins.add("seeds", ("scored",), "seeds AS (SELECT entity_id FROM scored WHERE entity_id <> '' AND address_count >= 1 ORDER BY value_sent DESC, entity_id LIMIT 10)")
_rounds = ["rank0 AS (SELECT node, 1.0 / count(*) OVER () AS rank FROM (SELECT src AS node FROM pairs UNION SELECT dst FROM pairs))"]
for _i in range(RANK_ROUNDS):
    _rounds.append(
        f"""rank{_i + 1} AS (SELECT r.node, 0.15 / count(*) OVER () + 0.85 * (coalesce(g.got, 0) +
    (SELECT coalesce(sum(rank), 0) FROM rank{_i} WHERE node NOT IN (SELECT src FROM steps)) / count(*) OVER ()) AS rank
    FROM rank{_i} r LEFT JOIN (SELECT dst AS node, sum(rank * p) AS got FROM steps JOIN rank{_i} q ON q.node = steps.src GROUP BY 1) g USING (node))"""
    )
twins.add("ranks", ("steps",), ",\n".join(_rounds))
_hops = ["f0 AS (SELECT entity_id AS seed, entity_id AS node, t.total AS amount FROM seeds JOIN (SELECT src, sum(value) AS total FROM pairs GROUP BY 1) t ON t.src = entity_id WHERE total > 0)"]
for _i in range(1, 5):
    _seen = " UNION ALL ".join(f"SELECT seed, node FROM f{j}" for j in range(_i))
    _hops.append(f"n{_i} AS (SELECT seed, dst AS node, sum(amount * p) AS amount FROM f{_i - 1} JOIN steps ON src = node GROUP BY 1, 2)")
    _hops.append(f"f{_i} AS (SELECT * FROM n{_i} WHERE (seed, node) NOT IN ({_seen}))")
twins.add("trace", ("steps", "sinks", "seeds"), ",\n".join(_hops) + ",\ntrace AS (SELECT seed, entity, kind, arg_min(amount, hops) AS amount, min(hops) AS hops FROM (" + " UNION ALL ".join(f"SELECT seed, node AS entity, kind, amount, {i} AS hops FROM n{i} JOIN sinks ON entity_id = node WHERE node <> seed" for i in range(1, 5)) + ") GROUP BY 1, 2, 3)")
_PLAIN = [f for f in features.FEATURES if f not in ("pagerank", "betweenness", "community_size", "net_flow_ratio")]
_made = {"log_value_btc": "ln(1 + greatest(value_btc, 0))", "value_per_tx": "CASE WHEN tx_count <> 0 THEN value_btc / tx_count ELSE 0 END", "in_out_ratio": "fan_in / (fan_out + 1)"}
twins.add("plain", ("structural",), "plain AS (SELECT entity_id, " + ", ".join(f"({_made.get(f, f)})::DOUBLE AS {f}" for f in _PLAIN) + " FROM entities JOIN structural USING (entity_id))")
twins.add("cells", ("plain",), "cells AS (UNPIVOT plain ON COLUMNS (* EXCLUDE entity_id) INTO NAME feature VALUE x)")
twins.add(
    "baseline",
    ("cells",),
    """middle AS (SELECT feature, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.01) AS lower, quantile_cont(x, 0.99) AS upper FROM cells GROUP BY 1),
baseline AS (SELECT feature, median, CASE WHEN mad < 1e-12 THEN 1.0 ELSE mad END AS mad, lower, upper FROM middle JOIN (SELECT feature, quantile_cont(abs(x - median), 0.5) AS mad FROM cells JOIN middle USING (feature) GROUP BY 1) USING (feature))""",
)

_plain = lambda c: c.features.select("entity_id", *_PLAIN)
_base = lambda c: features.fit_baseline(_plain(c), tuple(_PLAIN))


def _seeds(c):
    return c.scored.orderBy(F.desc("value_sent"), "entity_id").limit(10)


#: name -> (query over a capture, SQL twin)
QUERIES = {
    "flow_graph": (lambda c: rounded(c.pairs, "value"), over("SELECT src, dst, round(value, 6) AS value, n FROM pairs", "pairs")),
    "undirected_view": (lambda c: rounded(graph.undirected(c.pairs), "value"), over("SELECT a, b, round(value, 6) AS value FROM links", "links")),
    "backbone": (
        lambda c: rounded(graph.backbone(c.pairs), "value", "cutoff"),
        over("SELECT src, dst, round(value, 6) AS value, n, round(cutoff, 6) AS cutoff FROM pairs, (SELECT quantile_cont(value, 0.9) AS cutoff FROM pairs) WHERE value >= cutoff", "pairs"),
    ),
    "modularity": (
        lambda c: rounded(graph.modularity(graph.undirected(c.pairs), c.entities.select(F.col("entity_id").alias("node"), F.substring("entity_id", -1, 1).alias("community"))), "modularity"),
        over("SELECT round(sum(2 * inside / twice - (degree / twice) * (degree / twice)), 6) AS modularity FROM (SELECT *, sum(degree) OVER () AS twice FROM (SELECT c, sum(i) AS inside, sum(value) AS degree FROM (SELECT right(a, 1) AS c, CASE WHEN right(a, 1) = right(b, 1) THEN value ELSE 0 END AS i, value FROM links UNION ALL SELECT right(b, 1), 0, value FROM links) GROUP BY 1))", "links"),
    ),
    "net_flow_ratio": (
        lambda c: rounded(graph.net_flow(c.pairs), "net_flow_ratio"),
        over("SELECT node, round(CASE WHEN sum(value) > 0 THEN sum(net) / sum(value) ELSE 0 END, 6) AS net_flow_ratio FROM (SELECT src AS node, -value AS net, value FROM pairs UNION ALL SELECT dst, value, value FROM pairs) GROUP BY 1", "pairs"),
    ),
    "sinks": (lambda c: graph.sink_entities(c.structural), over("SELECT entity_id, kind FROM sinks", "sinks")),
    "pagerank": (lambda c: rounded(graph.pagerank(c.pairs, rounds=RANK_ROUNDS, tolerance=0.0), "pagerank"), over(f"SELECT node, round(rank, 6) AS pagerank FROM rank{RANK_ROUNDS}", "ranks")),
    "roles": (
        lambda c: graph.assign_roles(c.entities.select("entity_id", (F.col("fan_in") * F.col("fan_out")).cast("double").alias("betweenness")), c.entities, graph.sink_entities(c.structural)),
        over(
            """SELECT entity_id, CASE WHEN kind = 'exchange' THEN 'cash-out/exchange' WHEN kind IS NOT NULL THEN 'mixing service'
  WHEN fan_in >= 3 * greatest(fan_out, 1) AND value_received >= value_sent THEN 'collector' WHEN fan_out >= 3 * greatest(fan_in, 1) AND value_sent > value_received THEN 'distributor'
  WHEN fan_in * fan_out >= cut AND cut > 0 THEN 'relay' ELSE 'wallet' END AS role,
  CASE WHEN kind = 'exchange' THEN 'pays out like an exchange' WHEN kind IS NOT NULL THEN 'its rounds mix funds'
  WHEN fan_in >= 3 * greatest(fan_out, 1) AND value_received >= value_sent THEN 'takes from ' || fan_in || ' and pays ' || fan_out || ', keeps more than it passes on' WHEN fan_out >= 3 * greatest(fan_in, 1) AND value_sent > value_received THEN 'pays ' || fan_out || ' and takes from ' || fan_in || ', gives more than it gets'
  WHEN fan_in * fan_out >= cut AND cut > 0 THEN 'lies on many of the shortest ways between others' ELSE 'nothing about its payments stands out' END AS role_reason
  FROM entities LEFT JOIN sinks USING (entity_id), (SELECT quantile_cont((fan_in * fan_out)::DOUBLE, 0.8) AS cut FROM entities)""",
            "entities",
            "sinks",
        ),
    ),
    # the whole jobs, which the twins of the three forms above cannot follow
    "pagerank_full": (lambda c: rounded(graph.pagerank(c.pairs), "pagerank"), None),
    "roles_full": (lambda c: graph.assign_roles(c.metrics, c.entities, graph.sink_entities(c.structural)), None),
    "modularity_full": (lambda c: rounded(graph.modularity(graph.undirected(graph.backbone(c.pairs)), c.metrics.where("community >= 0").select(F.col("entity_id").alias("node"), "community")), "modularity"), None),
    "communities_by_modularity": (lambda c: modularity.modularity_communities(graph.undirected(graph.backbone(c.pairs))), None),
    "trace_funds": (
        lambda c: rounded(graph.trace_funds(c.flows, _seeds(c), graph.sink_entities(c.structural)).drop("path"), "amount"),
        over("SELECT seed, entity, kind, round(amount, 6) AS amount, hops FROM trace", "trace"),
    ),
    "communities": (lambda c: graph.community_table(c.metrics.where("community >= 0").select(F.col("entity_id").alias("node"), "community")), None),
    "betweenness": (lambda c: rounded(c.metrics.select("entity_id", "betweenness"), "betweenness"), None),
    "graph_metrics": (lambda c: rounded(c.metrics, "pagerank", "betweenness", "net_flow_ratio"), None),
    "graph_summary": (lambda c: graph.graph_summary(c.flows, c.metrics, graph.assign_roles(c.metrics, c.entities, graph.sink_entities(c.structural))).withColumn("roles", F.to_json("roles")), None),
    "feature_table": (lambda c: rounded(_plain(c), *_PLAIN), over("SELECT entity_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in _PLAIN) + " FROM plain", "plain")),
    "feature_table_full": (lambda c: rounded(c.features, *features.FEATURES), None),
    "feature_baseline": (lambda c: rounded(_base(c), "median", "mad", "lower", "upper"), over("SELECT feature, round(median, 6) AS median, round(mad, 6) AS mad, round(lower, 6) AS lower, round(upper, 6) AS upper FROM baseline", "baseline")),
    "robust_z": (
        lambda c: rounded(features.robust_z(_plain(c), _base(c), tuple(_PLAIN)), "x", "z"),
        over("SELECT entity_id, feature, round(x, 6) AS x, round(0.6745 * (greatest(lower, least(upper, x)) - median) / mad, 6) AS z FROM cells JOIN baseline USING (feature)", "baseline"),
    ),
    "clamped_features": (
        lambda c: rounded(features.clamp(_plain(c), _base(c), tuple(_PLAIN)), *_PLAIN),
        over("PIVOT (SELECT entity_id, feature, round(greatest(lower, least(upper, x)), 6) AS x FROM cells JOIN baseline USING (feature)) ON feature IN (" + ", ".join(f"'{f}'" for f in _PLAIN) + ") USING first(x) GROUP BY entity_id", "baseline"),
    ),
}
