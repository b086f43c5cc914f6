"""Queries on reports, checks of what is shown, pooled training rows and saved artefacts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.operators import corpus, detectors, evaluate, features, gate, graph, models, monitor, presentation, results, training, windows
from chainloom.plans import replay, twins
from chainloom.plans.resolution import build, rounded
from chainloom.plans.statistics import raw_text
from chainloom.plans.twins import over
from chainloom.sources import writers
from chainloom.storage import settle, shared_dir

__all__ = ["QUERIES", "build"]

#: Days per window of the pooled training rows.
SPAN = 10


def _saved(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as an artefact and loaded again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    writers.save_artefact(df, path)
    return writers.load_artefact(spark, path)


def _spans(c) -> DataFrame:
    return windows.day_windows(c.obs)


def _keys(c) -> DataFrame:
    """The entities are those of the mapping, so nothing else has to be derived for them."""
    return c.mapping.select(F.col("entity_id").alias("derived")).distinct().select("derived", F.concat(F.lit("K"), F.substring("derived", -1, 1)).alias("key"))


def _histories(c) -> DataFrame:
    return windows.risk_history(c.history)


def _cards(c) -> DataFrame:
    return windows.alert_cards(windows.raise_alerts(c.history), results.node_kind(c.scored).withColumnRenamed("entity_id", "entity_key"), _spans(c))


def _checks(c) -> DataFrame:
    return results.payload_checks(c.scored, results.graph_edges(c.pairs, c.controls, c.scored), _cards(c), _histories(c))


def _grouped(c, fit=models.fit_logistic) -> DataFrame:
    table = models.with_folds(c.pooled.withColumn("label", F.col("label").cast("double")), "window_id")
    return models.fold_summary(models.cross_validate(table, lambda t: fit(t, features.fit_baseline(t))))


def _windowed_flows(c) -> DataFrame:
    days = windows.day_windows(c.obs)
    return windows.assign_windows(c.flows, days).select("window_id", "src", "dst", "value")


def _case_file(c) -> DataFrame:
    """On the lead with the highest risk; its events are derived from its own rows, between all windows and by the baseline of all entities."""
    key = c.scored.orderBy(F.desc("risk"), "entity_id").first()["entity_id"]
    present = settle(c.history.select("window_id").distinct(), "present")
    own = settle(c.history.where(F.col("entity_key") == key), "own")
    z = monitor.z_scores(own, replay._baseline(c.history))
    changes = settle(windows.delta_attribution(z, windows.with_previous(c.history, present)), "changes")
    events = windows.with_detail(windows.detect_events(own, changes, present=present), changes, own, present)
    none = c.history.sparkSession.createDataFrame([], "old_key string, new_key string")
    return presentation.case_file(key, c.history, events, windows.raise_alerts(c.history), none, _windowed_flows(c), graph.sink_entities(c.structural))


def _document(c) -> DataFrame:
    top = results.leads(c.scored, 25)
    first = top.select(F.col("entity_id")).limit(5)
    some = F.broadcast(top.select("entity_id"))  # 25 rows
    ends = lambda at, n: some.select(F.col("entity_id").alias(at), F.lit(True).alias(n))
    about = lambda a, b: c.pairs.join(ends(a, "__a"), a, "left").join(ends(b, "__b"), b, "left").where("__a or __b").select(*c.pairs.columns)
    return presentation.document(
        totals=corpus.totals(c.obs, c.entities, c.mapping, c.controls),
        leads=top.select("rank", "entity_id", "risk", "band", "value_btc"),
        entities=results.payload(c.scored.join(some, "entity_id", "left_semi"), about("src", "dst"), c.controls.join(some.withColumnRenamed("entity_id", "entity"), "entity", "left_semi")),
        edges=results.graph_edges(c.pairs, c.controls, c.scored),
        endpoints=results.endpoint_nodes(c.controls, c.scored),
        alerts=_cards(c).where("score >= 85").orderBy(F.desc("score"), "entity_key").limit(100),
        traces=graph.trace_funds(c.flows, first, graph.sink_entities(c.structural)),
        values=corpus.value_percentiles(c.obs),
        sizes=corpus.size_classes(c.obs),
        days=corpus.daily_volume(c.obs),
        hours=corpus.hourly_profile(c.obs),
        scores=results.score_distribution(c.scored),
    )


def _split(c) -> DataFrame:
    table = replay.judged(c).select("entity_id", F.col("y").alias("label"))
    return models.stratified_split(table).groupBy("label").agg(F.count("*").alias("n"), F.count_if("held_out").alias("held_out"))


twins.add("scoped", ("cj",), f"""scoped AS (SELECT DISTINCT w || '|' || input_addresses[1] AS anchor, w || '|' || unnest(input_addresses) AS other
  FROM (SELECT *, ("timestamp"::DATE - (SELECT min("timestamp"::DATE) FROM cj)) // {SPAN} + 1 AS w FROM cj) WHERE NOT is_coinjoin AND len(input_addresses) > 0)""")
twins.add(
    "pooled",
    ("scoped",),
    """psym AS (SELECT anchor AS a, other AS b FROM scoped UNION SELECT other, anchor FROM scoped),
pwalk(node, root) AS (SELECT a, a FROM psym UNION SELECT s.b, w.root FROM pwalk w JOIN psym s ON s.a = w.node),
pooled AS (SELECT root, (avg((regexp_extract(node, '\\|A(\\d+)-', 1)::INT % 11 = 3)::INT) >= 0.5)::INT AS label FROM (SELECT node, min(root) AS root FROM pwalk GROUP BY 1) GROUP BY 1)""",
)
_LEVEL = replay._LEVEL
_BANDS = "CASE " + " ".join(f"WHEN risk >= {low} THEN '{n}'" for n, low in results.BANDS) + " ELSE 'low' END"
_NODE = "'N-' || lpad(((('0x' || substr(sha256(ip), 1, 16))::UBIGINT) % 1000000000)::VARCHAR, 9, '0')"
twins.add("shown", ("pairs", "control_pairs"), f"""shown AS (SELECT 'flow' AS kind, src, dst, value AS weight FROM (SELECT * FROM pairs ORDER BY value DESC, src, dst LIMIT 130)
  UNION ALL SELECT 'control', {_NODE}, entity, n::DOUBLE FROM (SELECT * FROM control_pairs ORDER BY n DESC, ip, entity LIMIT 60))""")
twins.add(
    "cards",
    ("alerts", "scored"),
    f"""cards AS (SELECT current_risk AS score, peak_risk, CASE {_LEVEL.format("current_risk")} WHEN 3 THEN 'critical' WHEN 2 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS severity, f.d::VARCHAR AS first_window, l.d::VARCHAR AS last_window
  FROM alerts JOIN scored ON entity_id = entity_key LEFT JOIN win f ON f.window_id = opened LEFT JOIN win l ON l.window_id = last_window)""",
)
twins.add("past", ("history",), "past AS (SELECT len(list(risk) OVER w) AS told, row_number() OVER w AS n FROM history WINDOW w AS (PARTITION BY entity_key ORDER BY window_id))")
#: Name of a check, the table it looks at, what must hold there.
_CHECKS = (
    ("entity_id", "scored", "regexp_full_match(entity_id, 'E-[0-9]{4,}')"),
    ("entity_risk", "scored", "risk BETWEEN 0 AND 100"),
    ("entity_counts", "scored", "len(addresses) = address_count AND len(countries) = country_count"),
    ("edge_kind", "shown", "kind IN ('flow', 'control')"),
    ("edge_ends", "shown", "regexp_full_match(src, '[EN]-[0-9]{4,}') AND regexp_full_match(dst, 'E-[0-9]{4,}') AND src <> dst"),
    ("edge_weight", "shown", "weight > 0"),
    ("alert_band", "cards", "severity = CASE WHEN score >= 85 THEN 'critical' WHEN score >= 70 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END"),
    ("alert_peak", "cards", "peak_risk >= score"),
    ("alert_windows", "cards", "first_window <= last_window"),
    ("no_look_ahead", "past", "told = n"),
)

#: name -> (query over a capture, SQL twin)
QUERIES = {
    "union_report": (
        lambda c: gate.union_report(gate.reports(gate.check(raw_text(c.raw)), F.to_date("at"))),
        over("SELECT 'total' AS item, count(*) AS n FROM judged UNION ALL SELECT 'accepted', count(*) FROM judged WHERE reason IS NULL UNION ALL SELECT 'rejected', count(*) FROM judged WHERE reason IS NOT NULL UNION ALL SELECT reason, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY 1", "judged"),
    ),
    "summary_notes": (
        lambda c: corpus.summary_notes(corpus.daily_volume(c.obs), corpus.hourly_profile(c.obs)),
        over(
            """SELECT list_filter([CASE WHEN len(rest) >= 2 AND tail < 0.5 * rest[len(rest) // 2 + 1] THEN format('last day incomplete: {} transactions, a typical day has {}', tail, rest[len(rest) // 2 + 1]) END,
  CASE WHEN share <= 0.042 * 1.2 THEN format('no daily rhythm: the busiest hour ({}) has {:.1f}%', hour, share * 100) ELSE format('hour {} is the busiest with {:.1f}%', hour, share * 100) END], lambda x: x IS NOT NULL) AS notes
  FROM (SELECT list(n ORDER BY label)[-1] AS tail, list_sort(list(n ORDER BY label)[:-2]) AS rest FROM (SELECT label, sum(n)::BIGINT AS n FROM folded GROUP BY 1)),
  (SELECT arg_min(hour, (-n, hour)) AS hour, max(n) / sum(n) AS share FROM (SELECT hour("timestamp")::INT AS hour, count(*) AS n FROM valued GROUP BY 1))""",
            "folded",
        ),
    ),
    "data_profile": (
        lambda c: corpus.profile(c.raw),
        over(
            """SELECT count(*) AS rows, count(DISTINCT txid) AS distinct_tx, sum(len(input_addresses))::BIGINT AS input_places, sum(len(output_addresses))::BIGINT AS output_places,
  (SELECT count(DISTINCT a) FROM (SELECT unnest(input_addresses) AS a FROM obs UNION ALL SELECT unnest(output_addresses) FROM obs)) AS addresses, (SELECT count(DISTINCT ip) FROM (SELECT src_ip AS ip FROM obs UNION ALL SELECT dst_ip FROM obs)) AS ips FROM obs""",
            "obs",
        ),
    ),
    "score_distribution": (
        lambda c: rounded(results.score_distribution(c.scored), "share"),
        over(f"SELECT band, count(entity_id) AS entities, round(count(entity_id) / sum(count(entity_id)) OVER (), 6) AS share FROM (VALUES ('critical'), ('high'), ('medium'), ('low')) b(band) LEFT JOIN (SELECT entity_id, {_BANDS} AS band FROM scored) USING (band) GROUP BY 1", "scored"),
    ),
    "rules_metrics": (
        lambda c: rounded(detectors.rules_metrics(c.scored, evaluate.project_labels(c.mapping, replay.truth(c).drop("owner"))), "precision", "recall", "f1"),
        over(
            "SELECT flags, round(coalesce(tp / nullif(flags, 0), 0), 6) AS precision, round(coalesce(tp / nullif(pos, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(flags + pos, 0), 0), 6) AS f1 FROM (SELECT count(*) FILTER (hit) AS flags, count(*) FILTER (hit AND label = 1) AS tp, count(*) FILTER (label = 1) AS pos FROM (SELECT label, "
            + " OR ".join(f"{k} >= {v}" for k, v in detectors.RULES.items())
            + " AS hit FROM scored LEFT JOIN labelled USING (entity_id)))",
            "judged_rows",
        ),
    ),
    "payload_checks": (
        _checks,
        over(" UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) AS rows, count(*) FILTER (NOT coalesce({holds}, false)) AS violations FROM {t}" for n, t, holds in _CHECKS), "shown", "cards", "past"),
    ),
    "explanation_checks": (lambda c: results.payload_checks(c.scored, results.graph_edges(c.pairs, c.controls, c.scored), _cards(c), _histories(c), models.explain(models.fit_risk(c.features.join(replay.judged(c).select("entity_id", F.col("y").cast("double").alias("label")), "entity_id"), features.fit_baseline(c.features)), c.features)), None),
    "labelled_scores": (
        lambda c: windows.with_window_labels(c.history, _spans(c)).select("label", "entity_key", "risk"),
        over("SELECT d::VARCHAR AS label, entity_key, risk FROM history JOIN win USING (window_id)", "history"),
    ),
    "status_counts": (
        lambda c: windows.value_counts(replay._judged_alerts(c), "status"),
        over("SELECT 'status' AS \"column\", status AS value, count(*) AS n FROM judged_alerts GROUP BY 2", "judged_alerts"),
    ),
    "event_totals": (
        lambda c: windows.value_counts(replay._events(c), "type", "severity"),
        over("SELECT 'type' AS \"column\", type AS value, count(*) AS n FROM evts GROUP BY 2 UNION ALL SELECT 'severity', severity, count(*) FROM evts GROUP BY 2", "events"),
    ),
    "role_counts": (lambda c: windows.value_counts(graph.assign_roles(c.metrics, c.entities, graph.sink_entities(c.structural)), "role"), None),
    "served_alerts": (
        lambda c: windows.served(windows.raise_alerts(c.history), windows.canonical(replay._aliases(c))).groupBy("entity_key").agg(F.max("peak_risk").alias("peak_risk")),
        over("SELECT coalesce(key, entity_key) AS entity_key, max(peak_risk) AS peak_risk FROM alerts LEFT JOIN (SELECT entity_key AS k, min(entity_key) OVER () AS key FROM (SELECT DISTINCT entity_key FROM history WHERE entity_key LIKE '%7' UNION ALL SELECT 'E-merged')) ON k = entity_key GROUP BY 1", "alerts"),
    ),
    "rekeyed_controls": (
        lambda c: windows.rekey_controls(c.controls, _keys(c)).groupBy("ip", "entity").agg(F.count("*").alias("n")),
        over("SELECT ip, 'K' || right(entity, 1) AS entity, count(*) AS n FROM controls GROUP BY 1, 2", "controls"),
    ),
    "rekeyed_mapping": (lambda c: windows.rekey_mapping(c.mapping, _keys(c)), over("SELECT address, 'K' || right(entity_id, 1) AS entity_id FROM mapping", "mapping")),
    "stratified_split": (_split, over("SELECT y AS label, count(*) AS n, floor(count(*) * 0.25 + 0.5)::BIGINT AS held_out FROM judged_rows GROUP BY 1", "judged_rows")),
    "training_windows": (
        lambda c: training.window_sizes(training.pooled_entities(monitor.span_windows(c.obs, SPAN), replay.truth(c).drop("owner"))),
        over("SELECT split_part(root, '|', 1)::INT AS window_id, count(*) AS entities, sum(label)::BIGINT AS illicit FROM pooled GROUP BY 1", "pooled"),
    ),
    "training_rows": (lambda c: c.pooled, None),
    "grouped_validation": (_grouped, None),
    "grouped_validation_forest": (lambda c: _grouped(c, models.fit_risk), None),
    "case_file": (_case_file, None),
    "capture_document": (_document, None),
    "community_cards": (lambda c: presentation.community_cards(c.metrics.where("community >= 0").select(F.col("entity_id").alias("node"), "community")), None),
    "saved_baseline": (
        lambda c: rounded(_saved(replay._baseline(c.history), "baseline"), "median", "mad", "lower", "upper"),
        over("SELECT feature, round(median, 6) AS median, round(mad, 6) AS mad, round(lower, 6) AS lower, round(upper, 6) AS upper FROM hbase", "moves"),
    ),
    "saved_reference": (
        lambda c: _saved(evaluate.fit_reference(replay._halves(c)[0]), "reference").select("feature", F.size("edges").alias("edges"), F.round(F.aggregate("edges", F.lit(0.0), lambda a, x: a + x), 6).alias("sum")),
        over("SELECT feature, len(edges)::INT AS edges, round(list_sum(edges), 6) AS sum FROM cuts", "drifted"),
    ),
    "saved_forest": (lambda c: models.anomaly_scores(_saved(models.fit_isolation(c.features), "isolation"), c.features), None),
}
