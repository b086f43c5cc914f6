"""Queries on resolution, correlation and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.operators import correlate, detectors, resolve
from chainloom.plans.capture import Capture
from chainloom.plans.twins import NUDGE, over

SIX = 6


def rounded(df, *columns: str):
    """Doubles at six places, nudged as in the twins so that exact halves and signed zeros come out alike."""
    return df.withColumns({c: F.round(F.col(c) + NUDGE, SIX) for c in columns})


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


_ENTITY = "entity_id, address_count, addresses, tx_count, tx_sent, tx_received, round(value_sent, 6) AS value_sent, round(value_received, 6) AS value_received, round(value_btc, 6) AS value_btc, fan_in, fan_out, distinct_counterparties, ip_count, ips, countries, country_count, asns, asn_count, active_days, first_seen, last_seen, round(burst_score, 6) AS burst_score, in_coinjoin"
STRUCTURAL = ("change_ratio", "peel_score", "output_uniformity", "mixer_score", "mixer_interaction", "collector_score", "exchange_score", "round_amount_ratio", "mean_payment_btc")

_SPEAKS = (("against", "collector_score", 0.3), ("against", "peel_score", 0.25), ("against", "mixer_score", 0.5), ("against", "mixer_interaction", 0.5), ("against", "country_count", 2), ("against", "burst_score", 0.5), ("for", "exchange_score", 0.5), ("for", "round_amount_ratio", 0.5))
_REASONS = f"SELECT entity_id, len(kinds)::INT AS n, kinds FROM (SELECT entity_id, list_filter([{', '.join(f"CASE WHEN {c} >= {t} THEN '{k}' END" for k, c, t in _SPEAKS)}], lambda x: x IS NOT NULL) AS kinds FROM scored)"

#: name -> (query over a capture, SQL twin)
QUERIES = {
    "obs_view": (lambda c: c.raw, over("SELECT * FROM obs", "obs")),
    "coinjoin_like": (lambda c: c.obs.where("is_coinjoin").select("obs_id", "txid"), over("SELECT obs_id, txid FROM cj WHERE is_coinjoin", "cj")),
    "co_spend_edges": (lambda c: resolve.co_spend_edges(c.obs), over("SELECT anchor, other FROM edges", "edges")),
    "entity_map": (lambda c: c.mapping, over("SELECT address, entity_id FROM mapping", "mapping")),
    "entity_members": (lambda c: resolve.entity_members(c.mapping), over("SELECT entity_id, list_sort(list(address)) AS members FROM mapping GROUP BY 1", "mapping")),
    "cluster_stats": (
        lambda c: rounded(resolve.cluster_stats(c.mapping), "mean_size"),
        over("SELECT count(*) AS clusters, count(*) FILTER (n > 1) AS multi_address, max(n) AS largest, round(avg(n), 6) AS mean_size FROM (SELECT entity_id, count(*) AS n FROM mapping GROUP BY 1)", "mapping"),
    ),
    "dominant_owner": (lambda c: c.senders, over("SELECT obs_id, entity_id FROM senders", "senders")),
    "dominant_receiver": (lambda c: c.receivers, over("SELECT obs_id, entity_id FROM receivers", "receivers")),
    "first_owner": (lambda c: c.first, over("SELECT obs_id, entity_id FROM firsts", "firsts")),
    "flows": (lambda c: rounded(c.flows, "value"), over('SELECT src, dst, obs_id, txid, "timestamp", round(value, 6) AS value FROM flows', "flows")),
    "controls": (lambda c: c.controls, over("SELECT * FROM controls", "controls")),
    "burst_score": (
        lambda c: rounded(correlate.burst_score(correlate.timeline(c.obs, c.senders, c.receivers)), "burst_score"),
        over("SELECT entity_id, round(burst_score, 6) AS burst_score FROM burst", "burst"),
    ),
    "entities": (lambda c: rounded(c.entities, "value_sent", "value_received", "value_btc", "burst_score"), over(f"SELECT {_ENTITY} FROM entities", "entities")),
    "correlation_stats": (
        lambda c: correlate.correlation_stats(c.obs, c.mapping, c.flows, c.controls),
        over("SELECT (SELECT count(*) FROM cj) AS transactions, (SELECT count(*) FROM cj WHERE is_coinjoin) AS coinjoin_like, (SELECT count(*) FROM mapping) AS addresses, (SELECT count(DISTINCT entity_id) FROM mapping) AS entities, (SELECT count(*) FROM flows) AS flow_edges, (SELECT count(*) FROM controls) AS control_edges, (SELECT count(DISTINCT ip) FROM controls) AS ips", "flows", "controls"),
    ),
    "top_entities": (
        lambda c: rounded(c.entities.orderBy(F.desc("value_btc"), "entity_id").limit(20).select("entity_id", "address_count", "tx_count", "value_btc", "countries", "ip_count"), "value_btc"),
        over("SELECT entity_id, address_count, tx_count, round(value_btc, 6) AS value_btc, countries, ip_count FROM (SELECT * FROM entities ORDER BY value_btc DESC, entity_id LIMIT 20)", "entities"),
    ),
    "peel_scores": (lambda c: rounded(detectors.peel_scores(c.entities, c.flows), "change_ratio", "peel_score"), over(f"SELECT entity_id, {_r('change_ratio', 'peel_score')} FROM peel", "peel")),
    "mixer_scores": (
        lambda c: rounded(detectors.mixer_scores(c.entities, c.obs, c.mapping, c.flows, c.first), "mixer_score"),
        over("SELECT entity_id, output_uniformity, round(mixer_score, 6) AS mixer_score, mixer_interaction FROM mixer", "mixer"),
    ),
    "flow_shape": (lambda c: rounded(detectors.flow_shape(c.entities), "collector_score", "exchange_score"), over(f"SELECT entity_id, {_r('collector_score', 'exchange_score')} FROM shape", "shape")),
    "value_shape": (lambda c: rounded(detectors.value_shape(c.entities, c.obs, c.first), "round_amount_ratio", "mean_payment_btc"), over(f"SELECT entity_id, {_r('round_amount_ratio', 'mean_payment_btc')} FROM amounts", "amounts")),
    "structural_features": (lambda c: rounded(c.structural, *STRUCTURAL), over(f"SELECT entity_id, {_r(*STRUCTURAL)} FROM structural", "structural")),
    "typologies": (
        lambda c: c.scored.select("entity_id", detectors.typologies(c.scored).alias("typologies")),
        over("SELECT entity_id, list_filter([" + ", ".join(f"CASE WHEN {col} >= {t} THEN '{n}' END" for n, col, t in detectors.TYPOLOGIES) + "], lambda x: x IS NOT NULL) AS typologies FROM scored", "scored"),
    ),
    "behaviour_composition": (
        lambda c: detectors.behaviour_composition(c.scored),
        over(
            "SELECT behaviour, count(*) AS entities, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(value_btc::DECIMAL(28,8))::DOUBLE, 6) AS value_btc FROM (SELECT value_btc, CASE "
            + " ".join(f"WHEN {col} >= {t} THEN '{n}'" for n, col, t in detectors.BEHAVIOUR)
            + " ELSE 'ordinary' END AS behaviour FROM scored) GROUP BY behaviour",
            "scored",
        ),
    ),
    "rules_baseline": (
        lambda c: detectors.rules_baseline(c.scored),
        over("SELECT entity_id, " + " OR ".join(f"{k} >= {v}" for k, v in detectors.RULES.items()) + " AS flagged FROM scored", "scored"),
    ),
    "reasons": (lambda c: detectors.reasons(c.scored).select("entity_id", F.size("reasons").alias("n"), F.transform("reasons", lambda r: r["kind"]).alias("kinds")), over(_REASONS, "scored")),
}


def build(found: dict) -> tuple[dict, dict]:
    """Spark callables and SQL texts of a table of queries."""
    from chainloom.plans.capture import capture

    run = lambda f: lambda spark, sf_dir: f(capture(spark, sf_dir))
    return {n: run(f) for n, (f, _) in found.items()}, {n: s for n, (_, s) in found.items() if s}


__all__ = ["QUERIES", "Capture", "build"]
