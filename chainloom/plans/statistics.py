"""Queries on the gate, capture statistics and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from chainloom.functions.arrays import encode
from chainloom.operators import corpus, gate, results
from chainloom.plans import twins
from chainloom.plans.resolution import build, rounded
from chainloom.plans.twins import over

__all__ = ["QUERIES", "build"]


def raw_text(obs):
    """The observation view as text records with planted errors: first reason in gate order wins."""
    hit = lambda m: F.col("obs_id") % m == 7
    text = obs.select(
        "obs_id",
        F.when(hit(101), F.lit(None)).otherwise(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss")).alias("timestamp"),
        "txid",
        F.when(hit(109), "40.52.114").otherwise(F.col("src_ip")).alias("src_ip"),
        "dst_ip",
        F.when(hit(103), "-1").otherwise(F.col("src_port").cast("string")).alias("src_port"),
        F.when(hit(107), "999999").otherwise(F.col("dst_port").cast("string")).alias("dst_port"),
        encode(F.col("input_addresses")).alias("input_addresses"),
        encode(F.col("output_addresses")).alias("output_addresses"),
        F.when(hit(113), "1.0|inf").when(hit(131), "-1").when(hit(137), F.element_at(F.col("input_amounts"), 1).cast("string")).otherwise(encode(F.col("input_amounts"))).alias("input_amounts"),
        encode(F.col("output_amounts")).alias("output_amounts"),
        F.when(hit(127), "-").otherwise(F.col("geo_country")).alias("geo_country"),
        "asn",
    )
    return text


_gate = lambda c: gate.gate(raw_text(c.raw))
twins.add(
    "judged",
    ("obs",),
    """judged AS (SELECT *, CASE WHEN obs_id % 101 = 7 THEN 'missing field ''timestamp''' WHEN obs_id % 109 = 7 THEN 'invalid src_ip' WHEN obs_id % 103 = 7 THEN 'src_port out of range'
    WHEN obs_id % 107 = 7 THEN 'dst_port out of range' WHEN obs_id % 113 = 7 THEN 'non-finite amount ''inf''' WHEN obs_id % 131 = 7 THEN 'negative amount'
    WHEN obs_id % 137 = 7 AND len(input_addresses) <> 1 THEN 'input addresses/amounts length mismatch' END AS reason FROM obs)""",
)
twins.add("valued", ("cj",), 'valued AS (SELECT "timestamp", txid, list_sum(output_amounts) AS value FROM cj)')
twins.add("control_pairs", ("controls",), "control_pairs AS (SELECT ip, entity, count(*) AS n FROM controls GROUP BY 1, 2)")
twins.add("ranked", ("scored",), f"""ranked AS (SELECT entity_id, risk, CASE {" ".join(f"WHEN risk >= {low} THEN '{n}'" for n, low in results.BANDS)} ELSE 'low' END AS band, value_btc, round(risk / 100, 6) AS confidence, row_number() OVER (ORDER BY risk DESC, entity_id) AS rank FROM scored)""")
twins.add(
    "near",
    ("pairs", "control_pairs"),
    """near AS (SELECT *, row_number() OVER (PARTITION BY node, relation ORDER BY weight DESC, other) AS place, sum(weight) OVER (PARTITION BY node, relation) AS total, count(*) OVER (PARTITION BY node, relation) AS every_ FROM
    (SELECT src AS node, 'pays' AS relation, dst AS other, value AS weight FROM pairs UNION ALL SELECT dst, 'paid_by', src, value FROM pairs
     UNION ALL SELECT entity, 'controlled_from', ip, n::DOUBLE FROM control_pairs UNION ALL SELECT ip, 'controls', entity, n::DOUBLE FROM control_pairs))""",
)
_ID = "'N-' || lpad(((('0x' || substr(sha256(ip), 1, 16))::UBIGINT) % 1000000000)::VARCHAR, 9, '0')"
FLOOR = 20
_days = """days AS (SELECT "timestamp"::DATE AS d, count(*) AS n, sum(value) AS v FROM valued GROUP BY 1),
folded AS (SELECT d.*, CASE WHEN fold AND d = last_ THEN prev_ || '..' || substr(d::VARCHAR, 6, 5) WHEN fold AND next_ = last_ THEN d::VARCHAR || '..' || substr(next_::VARCHAR, 6, 5) ELSE d::VARCHAR END AS label
  FROM (SELECT *, max(d) OVER () AS last_, lag(d) OVER (ORDER BY d)::VARCHAR AS prev_, lead(d) OVER (ORDER BY d) AS next_ FROM days) d,
       (SELECT count(*) >= 3 AND max(n) FILTER (d = m) < 0.1 * quantile_cont(n, 0.5) FILTER (d <> m) AS fold FROM days, (SELECT max(d) AS m FROM days)))"""
twins.add("folded", ("valued",), _days)

def _union_estimates(c):
    """``(item, exact, within)``: counts over all windows, and whether those from merged sketches of the windows lie within four standard errors."""
    from chainloom.operators import monitor

    found = corpus.merged_counts(corpus.window_sketches(monitor.span_windows(c.obs, 5)))
    exact = corpus.profile(c.obs).select(F.explode(F.array(*(F.struct(F.lit(n).alias("item"), F.col(k).cast("long").alias("exact")) for n, k in (("rows", "rows"), ("transactions", "distinct_tx"), ("addresses", "addresses"))))).alias("i")).select("i.item", "i.exact")
    exact = exact.unionByName(c.obs.agg(F.count_distinct("src_ip").alias("exact")).select(F.lit("ips").alias("item"), "exact"))
    return found.join(exact, "item").select("item", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.033 * F.col("exact")).alias("within"))


#: name -> (query over a capture, SQL twin)
QUERIES = {
    "gate_clean": (
        lambda c: _gate(c).clean.select("obs_id", "txid", "src_ip", "src_port", "dst_port", "geo_country", F.size("input_amounts").alias("n_in"), F.round(F.aggregate("output_amounts", F.lit(0.0), lambda a, x: a + x), 6).alias("value_out")),
        over("SELECT obs_id, txid, src_ip, src_port, dst_port, CASE WHEN obs_id % 127 = 7 THEN '' ELSE geo_country END AS geo_country, CASE WHEN obs_id % 137 = 7 THEN 1 ELSE len(input_amounts) END AS n_in, round(list_sum(output_amounts), 6) AS value_out FROM judged WHERE reason IS NULL", "judged"),
    ),
    "gate_rejections": (lambda c: _gate(c).rejections(), over("SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1", "judged")),
    "gate_report": (lambda c: _gate(c).totals(), over("SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS accepted, count(reason) AS rejected FROM judged", "judged")),
    "gate_quarantine": (lambda c: _gate(c).quarantine.select("obs_id", "txid", "reason"), over("SELECT obs_id, txid, reason FROM judged WHERE reason IS NOT NULL", "judged")),
    "gate_notes": (
        lambda c: gate.gate(raw_text(c.raw).unionByName(raw_text(c.raw).where("obs_id % 50 = 0"))).notes(),
        over("SELECT unnest(['duplicate txid observations', 'exact duplicate rows']) AS note, count(*) FILTER (obs_id % 50 = 0) AS n FROM judged WHERE reason IS NULL", "judged"),
    ),
    "corpus_totals": (
        lambda c: rounded(corpus.totals(c.obs, c.entities, c.mapping, c.controls), "value_btc", "mean_value", "median_value", "span_hours"),
        over(
            """SELECT (SELECT count(*) FROM valued) AS records, (SELECT count(DISTINCT txid) FROM valued) AS distinct_tx, (SELECT round(sum(value::DECIMAL(28,8))::DOUBLE, 6) FROM valued) AS value_btc, (SELECT round(sum(value::DECIMAL(28,8))::DOUBLE / count(value), 6) FROM valued) AS mean_value,
  (SELECT round(quantile_cont(value, 0.5), 6) FROM valued) AS median_value, (SELECT round((epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 3.6e9, 6) FROM valued) AS span_hours,
  (SELECT count(*) FROM entities) AS entities, (SELECT sum(ip_count)::BIGINT FROM entities) AS entity_ip_pairs, (SELECT count(*) FROM mapping) AS addresses,
  (SELECT count(DISTINCT ip) FROM controls) AS distinct_ips, (SELECT count(DISTINCT country) FROM controls WHERE country <> '') AS countries, (SELECT count(DISTINCT asn) FROM controls WHERE asn <> '') AS asns""",
            "valued",
            "entities",
        ),
    ),
    "value_percentiles": (
        lambda c: rounded(corpus.value_percentiles(c.obs), "value"),
        over("SELECT unnest([0.5, 0.9, 0.95, 0.99, 0.999, 1.0]::DOUBLE[]) AS p, unnest(list_transform(quantile_cont(value, [0.5, 0.9, 0.95, 0.99, 0.999, 1.0]), lambda x: round(x, 6))) AS value FROM valued", "valued"),
    ),
    "union_estimates": (
        _union_estimates,
        over(
            """SELECT item, exact, true AS within FROM (SELECT 'rows' AS item, count(*) AS exact FROM obs UNION ALL SELECT 'transactions', count(DISTINCT txid) FROM obs UNION ALL SELECT 'ips', count(DISTINCT src_ip) FROM obs
  UNION ALL SELECT 'addresses', count(DISTINCT a) FROM (SELECT unnest(input_addresses) AS a FROM obs UNION ALL SELECT unnest(output_addresses) FROM obs))""",
            "obs",
        ),
    ),
    "size_classes": (
        lambda c: rounded(corpus.size_classes(c.obs), "tx_share", "value_btc", "value_share"),
        over(
            "SELECT size_class, count(value) AS transactions, round(count(value) / sum(count(value)) OVER (), 6) AS tx_share, round(coalesce(sum(value), 0), 6) AS value_btc, round(coalesce(sum(value), 0) / sum(sum(value)) OVER (), 6) AS value_share FROM (VALUES "
            + ", ".join(f"('{n}', {lo}, {hi if hi < 1e9 else '1e308'})" for n, lo, hi in corpus.SIZE_CLASSES)
            + ") k(size_class, lo, hi) LEFT JOIN valued ON value >= lo AND value < hi GROUP BY 1",
            "valued",
        ),
    ),
    "daily_volume": (lambda c: rounded(corpus.daily_volume(c.obs), "value_btc"), over("SELECT label AS day, sum(n)::BIGINT AS transactions, round(sum(v), 6) AS value_btc FROM folded GROUP BY 1", "folded")),
    "daily_volume_folded": (
        lambda c: rounded(corpus.daily_volume(c.obs, 1e9), "value_btc"),  # a share that no last day reaches: it always joins the day before
        over("""SELECT CASE WHEN d >= p THEN p::VARCHAR || '..' || substr(m::VARCHAR, 6, 5) ELSE d::VARCHAR END AS day, sum(n)::BIGINT AS transactions, round(sum(v), 6) AS value_btc
  FROM (SELECT *, max(d) OVER () AS m, (SELECT max(d) FROM days WHERE d < (SELECT max(d) FROM days)) AS p FROM (SELECT "timestamp"::DATE AS d, count(*) AS n, sum(value) AS v FROM valued GROUP BY 1)) GROUP BY 1""".replace("FROM days", "FROM (SELECT DISTINCT \"timestamp\"::DATE AS d FROM valued)"), "valued"),
    ),
    "hourly_profile": (lambda c: rounded(corpus.hourly_profile(c.obs), "value_btc"), over('SELECT h::INT AS hour, count(value) AS transactions, round(coalesce(sum(value), 0), 6) AS value_btc FROM range(24) r(h) LEFT JOIN valued ON hour("timestamp") = h GROUP BY 1', "valued")),
    "volume_3h": (lambda c: rounded(corpus.volume_series(c.obs), "value_btc"), over("SELECT time_bucket(INTERVAL 3 HOUR, \"timestamp\") AS start, count(*) AS transactions, round(sum(value), 6) AS value_btc FROM valued GROUP BY 1", "valued")),
    "top_actors": (lambda c: rounded(corpus.top_actors(c.entities), "value_btc", "share"), over("SELECT entity_id, round(value_btc, 6) AS value_btc, round(value_btc / total, 6) AS share FROM (SELECT *, sum(value_btc) OVER () AS total FROM entities) ORDER BY entities.value_btc DESC, entity_id LIMIT 8".replace("entities.value_btc DESC", "value_btc DESC"), "entities")),
    "country_topk": (lambda c: corpus.countries(c.scored, FLOOR), over(f"SELECT country, count(*) AS entities, count(*) FILTER (risk >= {FLOOR}) AS flagged FROM (SELECT risk, unnest(countries) AS country FROM scored) GROUP BY 1 ORDER BY entities DESC, country LIMIT 10", "scored")),
    "geo_breakdown": (lambda c: rounded(corpus.geo_breakdown(c.scored, FLOOR), "share"), over(f"SELECT country, count(*) AS entities, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT unnest(countries) AS country FROM scored WHERE risk >= {FLOOR}) GROUP BY 1 ORDER BY entities DESC, country LIMIT 6", "scored")),
    "coverage": (
        lambda c: rounded(corpus.coverage(c.scored, FLOOR), "flagged_share", "flagged_value_share"),
        over(f"SELECT count(*) AS scored, count(*) FILTER (risk >= {FLOOR}) AS flagged, round(count(*) FILTER (risk >= {FLOOR}) / count(*), 6) AS flagged_share, round(coalesce(sum(value_btc) FILTER (risk >= {FLOOR}), 0) / sum(value_btc), 6) AS flagged_value_share FROM scored", "scored"),
    ),
    "capture_peaks": (
        lambda c: corpus.peaks(c.obs),
        over(
            'SELECT arg_min(hour, (-n, hour)) AS peak_hour, max(n) AS peak_hour_transactions, (SELECT arg_min(label, (-n, label)) FROM (SELECT label, sum(n) AS n FROM folded GROUP BY 1)) AS peak_day FROM (SELECT hour("timestamp")::INT AS hour, count(*) AS n FROM valued GROUP BY 1)',
            "folded",
        ),
    ),
    "summary_sentence": (lambda c: corpus.summary_sentence(corpus.totals(c.obs, c.entities, c.mapping, c.controls), corpus.coverage(c.scored, FLOOR)), over(
        f"""SELECT format('{{}} records over {{:.1f}} hours: {{}} addresses in {{}} entities, controlled from {{}} IPs in {{}} countries; {{}} flagged.', (SELECT count(*) FROM valued),
  (SELECT (epoch_us(max("timestamp")) - epoch_us(min("timestamp"))) / 3.6e9 FROM valued), (SELECT count(*) FROM mapping), (SELECT count(*) FROM entities), (SELECT count(DISTINCT ip) FROM controls),
  (SELECT count(DISTINCT country) FROM controls WHERE country <> ''), (SELECT count(*) FROM scored WHERE risk >= {FLOOR})) AS sentence""",
        "valued",
        "scored",
    )),
    "leads": (lambda c: rounded(results.leads(c.scored), "value_btc"), over("SELECT entity_id, risk, band, round(value_btc, 6) AS value_btc, confidence, rank::INT AS rank FROM ranked", "ranked")),
    "alert_ids": (lambda c: results.alert_ids(results.leads(c.scored, 25)), over("SELECT 'A-' || lpad(rank::VARCHAR, 4, '0') AS alert_id, entity_id, risk, band FROM ranked WHERE rank <= 25", "ranked")),
    "flow_edges_topk": (lambda c: rounded(results.top_flow_edges(c.pairs), "value"), over("SELECT src, dst, round(value, 6) AS value, n FROM (SELECT * FROM pairs ORDER BY value DESC, src, dst LIMIT 130)", "pairs")),
    "control_edges_topk": (lambda c: results.top_control_edges(c.controls), over("SELECT ip, entity, n FROM control_pairs ORDER BY n DESC, ip, entity LIMIT 60", "control_pairs")),
    "endpoint_nodes": (
        lambda c: results.endpoint_nodes(c.controls, c.scored),
        over(f"SELECT {_ID} AS endpoint_id, ip, count(*) AS observations, count(DISTINCT entity) AS entities, max(risk) AS peak_risk, coalesce(list_sort(list(DISTINCT country) FILTER (country <> '')), []) AS countries FROM controls LEFT JOIN scored ON entity_id = entity GROUP BY ip ORDER BY observations DESC, ip LIMIT 60", "scored", "controls"),
    ),
    "graph_edges": (
        lambda c: rounded(results.graph_edges(c.pairs, c.controls, c.scored), "weight"),
        over(f"SELECT 'flow' AS kind, src, dst, round(value, 6) AS weight FROM (SELECT * FROM pairs ORDER BY value DESC, src, dst LIMIT 130) UNION ALL SELECT 'control', {_ID}, entity, n::DOUBLE FROM (SELECT * FROM control_pairs ORDER BY n DESC, ip, entity LIMIT 60)", "pairs", "control_pairs"),
    ),
    "neighbourhood": (
        lambda c: rounded(results.neighbourhood(c.pairs, c.controls), "weight", "total"),
        over("SELECT node, relation, other, round(weight, 6) AS weight, place::INT AS place, round(total, 6) AS total, greatest(every_ - 5, 0) AS more FROM near WHERE place <= 5", "near"),
    ),
    "node_kind": (
        lambda c: results.node_kind(c.scored),
        over("SELECT entity_id, CASE WHEN mixer_score >= 0.5 THEN 'mixer' WHEN exchange_score >= 0.5 THEN 'exchange' WHEN collector_score >= 0.3 THEN 'collector' ELSE 'wallet' END AS kind, substr(addresses[1], 1, 10) || CASE WHEN address_count > 1 THEN ' (+' || (address_count - 1) || ')' ELSE '' END AS label FROM scored", "scored"),
    ),
    "integrity_checks": (
        lambda c: results.integrity(c.flows, c.scored, results.leads(c.scored)),
        over("SELECT unnest(['dangling_edges', 'self_flows', 'unknown_leads', 'rank_disorder', 'risk_out_of_range', 'bad_ids']) AS \"check\", unnest([(SELECT count(*) FROM flows WHERE src NOT IN (SELECT entity_id FROM scored) OR dst NOT IN (SELECT entity_id FROM scored)), (SELECT count(*) FROM flows WHERE src = dst), 0, 0, (SELECT count(*) FROM scored WHERE risk < 0 OR risk > 100), 0]) AS violations", "scored"),
    ),
    "payload": (lambda c: results.payload(c.scored, c.pairs, c.controls), None),
}
