"""The observation view over ``events`` that the registered queries run on, in Spark SQL and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OBS_SPARK = """
WITH e AS (SELECT event_id, ts, user_id AS u, CAST(get_json_object(props,'$.k') AS BIGINT) AS k,
                  value AS v, (SELECT max(user_id)+1 FROM {events}) AS n FROM {events}),
     p AS (SELECT *, (u+k+1) % n AS r, event_id % 499 = 0 AS cj FROM e)
SELECT event_id AS obs_id, CAST(ts AS TIMESTAMP) AS timestamp, 'tx'||event_id AS txid,
  '10.0.'||(u%256)||'.'||(1+event_id%3) AS src_ip, '10.1.'||(r%256)||'.1' AS dst_ip,
  8333 AS src_port, 443 AS dst_port,
  CASE WHEN cj THEN array('A'||(1+(u+0)%(n-1))||'-0','A'||(1+(u+3)%(n-1))||'-0','A'||(1+(u+6)%(n-1))||'-0','A'||(1+(u+9)%(n-1))||'-0')
       WHEN event_id%3=0 THEN array('A'||u||'-0')
       ELSE array('A'||u||'-0','A'||u||'-'||(1+event_id%2)) END AS input_addresses,
  CASE WHEN cj THEN array('A0-0','A0-0','A0-0','A0-0')
       WHEN event_id%2=0 THEN array('A'||r||'-'||(k%3),'A'||u||'-0')
       ELSE array('A'||r||'-'||(k%3)) END AS output_addresses,
  CASE WHEN cj THEN array(0.5D,0.5D,0.5D,0.5D) WHEN event_id%3=0 THEN array(v) ELSE array(0.25D*v,0.75D*v) END AS input_amounts,
  CASE WHEN cj THEN array(0.5D,0.5D,0.5D,0.5D) WHEN event_id%2=0 THEN array(0.75D*v,0.25D*v) ELSE array(v) END AS output_amounts,
  CASE (u + CASE WHEN event_id%17=0 THEN 1 ELSE 0 END)%5 WHEN 0 THEN 'RU' WHEN 1 THEN 'NL' WHEN 2 THEN 'DE' WHEN 3 THEN 'US' ELSE '' END AS geo_country,
  'AS'||(u%7) AS asn
FROM p
"""

#: CTEs ``e``, ``p`` and ``obs``; the other SQL twins build on them.
OBS_SQL = """
e AS (SELECT event_id, ts, user_id AS u, CAST(json_extract_string(props,'$.k') AS BIGINT) AS k,
             value AS v, (SELECT max(user_id)+1 FROM events) AS n FROM events),
p AS (SELECT *, (u+k+1) % n AS r, event_id % 499 = 0 AS cj FROM e),
obs AS (SELECT event_id AS obs_id, ts AS "timestamp", 'tx'||event_id AS txid,
  '10.0.'||(u%256)||'.'||(1+event_id%3) AS src_ip, '10.1.'||(r%256)||'.1' AS dst_ip,
  8333 AS src_port, 443 AS dst_port,
  CASE WHEN cj THEN ['A'||(1+(u+0)%(n-1))||'-0','A'||(1+(u+3)%(n-1))||'-0','A'||(1+(u+6)%(n-1))||'-0','A'||(1+(u+9)%(n-1))||'-0']
       WHEN event_id%3=0 THEN ['A'||u||'-0']
       ELSE ['A'||u||'-0','A'||u||'-'||(1+event_id%2)] END AS input_addresses,
  CASE WHEN cj THEN ['A0-0','A0-0','A0-0','A0-0']
       WHEN event_id%2=0 THEN ['A'||r||'-'||(k%3),'A'||u||'-0']
       ELSE ['A'||r||'-'||(k%3)] END AS output_addresses,
  CASE WHEN cj THEN [0.5::DOUBLE,0.5,0.5,0.5] WHEN event_id%3=0 THEN [v] ELSE [0.25*v,0.75*v] END AS input_amounts,
  CASE WHEN cj THEN [0.5::DOUBLE,0.5,0.5,0.5] WHEN event_id%2=0 THEN [0.75*v,0.25*v] ELSE [v] END AS output_amounts,
  CASE (u + CASE WHEN event_id%17=0 THEN 1 ELSE 0 END)%5 WHEN 0 THEN 'RU' WHEN 1 THEN 'NL' WHEN 2 THEN 'DE' WHEN 3 THEN 'US' ELSE '' END AS geo_country,
  'AS'||(u%7) AS asn
FROM p)
"""


def observations(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """The view; a capture in fewer splits than there are cores (one row group, say) is dealt out once, before any work on its rows.

    With ``parts`` its events, which are narrower than the view's rows, are dealt into as many parts by their id in any case.
    """
    events, cores = spark.read.parquet(f"{sf_dir}/events.parquet"), spark.sparkContext.defaultParallelism
    if parts:
        events = events.repartition(parts, "event_id")
    elif events.rdd.getNumPartitions() < cores:
        events = events.repartition(cores, "event_id")
    return spark.sql(OBS_SPARK, events=events)
