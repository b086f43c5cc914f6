"""DuckDB SQL of the derived tables, as chained CTEs."""

from __future__ import annotations

from chainloom.plans.observations import OBS_SQL

#: Added before rounding to six places: sums of doubles that should be an exact half differ in their last bits.
NUDGE = 3e-9
#: name -> (names it needs, CTE text)
_CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": ((), OBS_SQL.strip()),
    "cj": (
        ("obs",),
        """cj AS (SELECT *, coalesce(len(input_amounts) >= 4 AND list_min(input_amounts) > 0
    AND CASE WHEN list_max(input_amounts) > 0 THEN (list_max(input_amounts) - list_min(input_amounts)) / list_max(input_amounts) ELSE 1e308 END <= 0.02
    AND (NOT (len(output_amounts) >= 2 AND list_min(output_amounts) > 0)
         OR CASE WHEN list_max(output_amounts) > 0 THEN (list_max(output_amounts) - list_min(output_amounts)) / list_max(output_amounts) ELSE 1e308 END <= 0.02), false) AS is_coinjoin FROM obs)""",
    ),
    "edges": (("cj",), "edges AS (SELECT DISTINCT input_addresses[1] AS anchor, unnest(input_addresses) AS other FROM cj WHERE NOT is_coinjoin AND len(input_addresses) > 0)"),
    "mapping": (
        ("edges",),
        """sym AS (SELECT anchor AS a, other AS b FROM edges UNION SELECT other, anchor FROM edges),
walk(node, root) AS (SELECT a, a FROM sym UNION SELECT s.b, w.root FROM walk w JOIN sym s ON s.a = w.node),
comp AS (SELECT node AS address, min(root) AS anchor FROM walk GROUP BY node),
digests AS (SELECT anchor, count(*) AS n, ('0x' || substr(sha256(anchor), 1, 16))::UBIGINT AS h FROM comp GROUP BY 1),
nine AS (SELECT *, row_number() OVER (PARTITION BY h % 1000000000 ORDER BY n DESC, anchor) AS r FROM digests),
twelve AS (SELECT anchor, h, row_number() OVER (PARTITION BY h % 1000000000000 ORDER BY n DESC, anchor) AS r FROM nine WHERE r > 1),
names AS (SELECT anchor, 'E-' || lpad((h % 1000000000)::VARCHAR, 9, '0') AS entity_id FROM nine WHERE r = 1
    UNION ALL SELECT anchor, 'E-' || CASE WHEN r = 1 THEN lpad((h % 1000000000000)::VARCHAR, 12, '0') ELSE lpad((h % 1000000000000000)::VARCHAR, 15, '0') END FROM twelve),
mapping AS (SELECT address, entity_id FROM comp JOIN names USING (anchor))""",
    ),
    "flat_in": (("cj", "mapping"), "flat_in AS (SELECT obs_id, pos, x.address, m.entity_id FROM (SELECT obs_id, unnest(input_addresses) AS address, generate_subscripts(input_addresses, 1) - 1 AS pos FROM cj) x JOIN mapping m USING (address))"),
    "flat_out": (("cj", "mapping"), "flat_out AS (SELECT obs_id, pos, x.address, m.entity_id FROM (SELECT obs_id, unnest(output_addresses) AS address, generate_subscripts(output_addresses, 1) - 1 AS pos FROM cj) x JOIN mapping m USING (address))"),
    "senders": (("flat_in",), "senders AS (SELECT obs_id, entity_id FROM (SELECT obs_id, entity_id, row_number() OVER (PARTITION BY obs_id ORDER BY count(*) DESC, min(pos)) AS r FROM flat_in GROUP BY 1, 2) WHERE r = 1)"),
    "receivers": (("flat_out",), "receivers AS (SELECT obs_id, entity_id FROM (SELECT obs_id, entity_id, row_number() OVER (PARTITION BY obs_id ORDER BY count(*) DESC, min(pos)) AS r FROM flat_out GROUP BY 1, 2) WHERE r = 1)"),
    "firsts": (("flat_in",), "firsts AS (SELECT obs_id, arg_min(entity_id, pos) AS entity_id FROM flat_in GROUP BY 1)"),
    "flows": (
        ("senders",),
        """flows AS (SELECT s.entity_id AS src, m.entity_id AS dst, o.obs_id, o.txid, o."timestamp", round(sum(o.amount), 8) AS value
    FROM (SELECT obs_id, txid, "timestamp", unnest(output_addresses) AS address, unnest(output_amounts) AS amount FROM cj) o
    JOIN mapping m USING (address) JOIN senders s USING (obs_id) WHERE s.entity_id <> m.entity_id GROUP BY 1, 2, 3, 4, 5)""",
    ),
    "controls": (("senders",), 'controls AS (SELECT src_ip AS ip, s.entity_id AS entity, geo_country AS country, asn, "timestamp", txid FROM cj JOIN senders s USING (obs_id))'),
    "roles": (
        ("senders", "receivers"),
        """roles AS (SELECT s.entity_id, "timestamp", is_coinjoin, 1 AS sent, 0 AS received, list_sum(output_amounts) AS value_out, 0.0::DOUBLE AS value_in FROM cj JOIN senders s USING (obs_id)
    UNION ALL SELECT r.entity_id, "timestamp", is_coinjoin, 0, 1, 0.0::DOUBLE, list_sum(input_amounts) FROM cj JOIN receivers r USING (obs_id))""",
    ),
    "burst": (
        ("roles",),
        """burst AS (SELECT entity_id, max(n) / count(*) AS burst_score FROM
    (SELECT entity_id, count(*) OVER (PARTITION BY entity_id ORDER BY "timestamp" RANGE BETWEEN CURRENT ROW AND INTERVAL 1 HOUR FOLLOWING) AS n FROM roles) GROUP BY 1)""",
    ),
    "entities": (
        ("roles", "burst", "flows", "controls"),
        """moved AS (SELECT entity_id, sum(sent)::BIGINT AS tx_sent, sum(received)::BIGINT AS tx_received, sum(value_out) AS value_sent, sum(value_in) AS value_received,
    min("timestamp") AS first_seen, max("timestamp") AS last_seen, bool_or(is_coinjoin) AS in_coinjoin FROM roles GROUP BY 1),
network AS (SELECT entity AS entity_id, list_sort(list(DISTINCT ip)) AS ips, coalesce(list_sort(list(DISTINCT country) FILTER (trim(country) <> '')), []) AS countries,
    coalesce(list_sort(list(DISTINCT asn) FILTER (trim(asn) <> '')), []) AS asns, count(DISTINCT "timestamp"::DATE) AS active_days FROM controls GROUP BY 1),
fans AS (SELECT entity_id, count(DISTINCT other) FILTER (NOT out_) AS fan_in, count(DISTINCT other) FILTER (out_) AS fan_out, count(DISTINCT other) AS distinct_counterparties
    FROM (SELECT src AS entity_id, dst AS other, true AS out_ FROM flows UNION ALL SELECT dst, src, false FROM flows) GROUP BY 1),
entities AS (SELECT g.entity_id, len(g.addresses)::BIGINT AS address_count, g.addresses,
    coalesce(tx_sent, 0) + coalesce(tx_received, 0) AS tx_count, coalesce(tx_sent, 0) AS tx_sent, coalesce(tx_received, 0) AS tx_received,
    round(coalesce(value_sent, 0), 8) AS value_sent, round(coalesce(value_received, 0), 8) AS value_received, round(coalesce(value_sent, 0) + coalesce(value_received, 0), 8) AS value_btc,
    coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(distinct_counterparties, 0) AS distinct_counterparties,
    coalesce(len(ips), 0)::BIGINT AS ip_count, coalesce(ips, []) AS ips, coalesce(countries, []) AS countries, coalesce(len(countries), 0)::BIGINT AS country_count,
    coalesce(asns, []) AS asns, coalesce(len(asns), 0)::BIGINT AS asn_count, coalesce(active_days, 0) AS active_days, first_seen, last_seen,
    coalesce(burst_score, 0.0) AS burst_score, coalesce(in_coinjoin, false) AS in_coinjoin
    FROM (SELECT entity_id, list_sort(list(address)) AS addresses FROM mapping GROUP BY 1) g
    LEFT JOIN moved USING (entity_id) LEFT JOIN network USING (entity_id) LEFT JOIN fans USING (entity_id) LEFT JOIN burst USING (entity_id))""",
    ),
    "peel": (
        ("entities",),
        """peel AS (SELECT entity_id, change_ratio, greatest(0.0, least(1.0, change_ratio * greatest(0.0, least(1.0, 1.0 / greatest(degree, 1) * 1.6)))) AS peel_score FROM
    (SELECT e.entity_id, coalesce(degree, 0) AS degree, greatest(0.0, least(1.0, CASE WHEN value_sent > 0 THEN (value_sent - coalesce(external, 0)) / value_sent ELSE 0.0 END)) AS change_ratio
     FROM entities e LEFT JOIN (SELECT src AS entity_id, sum(value) AS external, count(DISTINCT dst) AS degree FROM flows GROUP BY 1) USING (entity_id)))""",
    ),
    "mixer": (
        ("entities", "firsts", "flat_out"),
        """participants AS (SELECT DISTINCT entity_id FROM flat_in JOIN cj USING (obs_id) WHERE is_coinjoin),
services AS (SELECT DISTINCT entity_id FROM flat_out JOIN cj USING (obs_id) WHERE is_coinjoin AND entity_id NOT IN (SELECT entity_id FROM participants)),
touched AS (SELECT dst AS entity_id FROM flows WHERE src IN (SELECT entity_id FROM services) UNION SELECT src FROM flows WHERE dst IN (SELECT entity_id FROM services) UNION SELECT entity_id FROM participants),
even AS (SELECT f.entity_id, avg(1 - (list_max(output_amounts) - list_min(output_amounts)) / greatest(list_max(output_amounts), 1e-12)) AS uniformity
    FROM cj JOIN firsts f USING (obs_id) WHERE len(output_amounts) >= 2 AND list_sum(output_amounts) > 0 GROUP BY 1),
mixer AS (SELECT e.entity_id, round(coalesce(uniformity, 0), 4) AS output_uniformity,
    CASE WHEN e.entity_id IN (SELECT entity_id FROM services) THEN 1.0 ELSE greatest(0.0, least(1.0, coalesce(uniformity, 0) * 0.35)) END AS mixer_score,
    CASE WHEN e.entity_id NOT IN (SELECT entity_id FROM services) AND e.entity_id IN (SELECT entity_id FROM touched) THEN 1.0 ELSE 0.0 END AS mixer_interaction
    FROM entities e LEFT JOIN even USING (entity_id))""",
    ),
    "shape": (
        ("entities",),
        """shape AS (SELECT entity_id, greatest(0.0, least(1.0, fi / ti * greatest(0.0, least(1.0, (fi - fo) / greatest(fi, 1.0))) * 1.5)) AS collector_score,
    greatest(0.0, least(1.0, least(fi / ti, fo / tu) * (1.0 - abs(fi - fo) / greatest(fi + fo, 1.0)) * 1.4)) AS exchange_score
    FROM (SELECT entity_id, fan_in::DOUBLE AS fi, fan_out::DOUBLE AS fo, greatest(max(fan_in) OVER (), 1) AS ti, greatest(max(fan_out) OVER (), 1) AS tu FROM entities))""",
    ),
    "amounts": (
        ("entities", "firsts"),
        """amounts AS (SELECT e.entity_id, coalesce(r, 0.0) AS round_amount_ratio, coalesce(m, 0.0) AS mean_payment_btc FROM entities e LEFT JOIN
    (SELECT f.entity_id, avg(CASE WHEN v > 0 AND abs(v / 0.1 - round_even(v / 0.1, 0)) < 0.01 THEN 1.0 ELSE 0.0 END) AS r, avg(v) AS m
     FROM (SELECT obs_id, unnest(output_amounts) AS v FROM cj) JOIN firsts f USING (obs_id) GROUP BY 1) USING (entity_id))""",
    ),
    "structural": (("peel", "mixer", "shape", "amounts"), "structural AS (SELECT * FROM peel JOIN mixer USING (entity_id) JOIN shape USING (entity_id) JOIN amounts USING (entity_id))"),
    "scored": (
        ("structural",),
        """scored AS (SELECT *, round_even(100 * least(1.0, 0.5 * collector_score + 0.4 * peel_score + 0.3 * mixer_interaction + 0.2 * burst_score + 0.15 * country_count), 0)::INT AS risk
    FROM entities JOIN structural USING (entity_id))""",
    ),
    "pairs": (("flows",), "pairs AS (SELECT src, dst, sum(value) AS value, count(*) AS n FROM flows GROUP BY 1, 2)"),
}


def add(name: str, needs: tuple[str, ...], text: str) -> None:
    _CTES[name] = (needs, text)


def over(select: str, *needs: str) -> str:
    """``WITH RECURSIVE`` the named tables and all they need, then ``select``."""
    order: list[str] = []

    def visit(name: str) -> None:
        for n in _CTES[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    text = "WITH RECURSIVE " + ",\n".join(_CTES[n][1] for n in order) + "\n" + select
    return text.replace(", 6)", f" + {NUDGE}, 6)")  # every such call is a rounding
