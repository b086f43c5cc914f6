"""What is handed to a reader whole: the file on one lead, and one nested document on a capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.operators import graph, windows

#: Members of a community that are listed; the rest is a number.
MEMBERS = 50


def community_cards(labels: DataFrame, most: int = MEMBERS) -> DataFrame:
    """``(community, size, members, more)`` from (node, community): the ``most`` smallest members, and how many are not listed.

    A task keeps ``most`` members of a community, so the largest costs no more than others.
    """
    sizes = labels.groupBy("community").agg(F.count("*").alias("size"))
    first = labels.withColumn("r", F.row_number().over(W.partitionBy("community").orderBy("node"))).where(F.col("r") <= most)  # limited before the shuffle
    listed = first.groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return sizes.join(listed, "community").select("community", "size", "members", (F.col("size") - F.size("members")).alias("more"))


def case_file(entity_key: str, history: DataFrame, events: DataFrame, alerts: DataFrame, aliases: DataFrame, flows: DataFrame, sinks: DataFrame, max_hops: int = 4) -> DataFrame:
    """One row on one lead: ``(asked, entity_key, window_id, risk, risks, events, peak_risk, status, traces)``.

    A key that was absorbed leads to the one that serves it now (``aliases``: old_key, new_key).  The file is that of the last window in which
    the entity was scored and money moved (``flows`` with ``window_id``); was it never both, that of the last in which it was
    scored.  Risks reach up to that window; events are its own, those that absorbed others included; traces start at the
    entity and follow that window's flows to sinks (``sinks``: entity_id, kind).  An unknown key gives no row.
    """
    spark = history.sparkSession
    asked = spark.createDataFrame([(entity_key,)], "entity_key string")
    key = windows.served(asked, windows.canonical(aliases)).first()[0]
    scored = history.where(F.col("entity_key") == key).select("window_id", "entity_key", "risk")
    moved = flows.where((F.col("src") == key) | (F.col("dst") == key)).select("window_id").distinct().withColumn("moved", F.lit(True))
    (best,) = scored.join(moved, "window_id", "left").agg(F.max(F.struct(F.coalesce("moved", F.lit(False)).alias("moved"), "window_id", "risk")).alias("b")).first()
    if best is None:
        return spark.createDataFrame([], "asked string, entity_key string, window_id int, risk int, risks array<struct<window_id:int,risk:int>>, events array<struct<type:string,severity:string,detail:string>>, peak_risk int, status string, traces array<struct<entity:string,kind:string,amount:double,hops:int,path:array<string>>>")
    traces = graph.trace_funds(flows.where(F.col("window_id") == best.window_id).drop("window_id"), asked.select(F.lit(key).alias("entity_id")), sinks, max_hops)
    past = scored.where(F.col("window_id") <= best.window_id).agg(F.array_sort(F.collect_list(F.struct("window_id", "risk"))).alias("risks"))
    absorbed = F.coalesce(F.array_contains(F.from_json("detail", "absorbed array<string>")["absorbed"], key), F.lit(False))
    told = events.where((F.col("window_id") == best.window_id) & ((F.col("entity_key") == key) | absorbed)).agg(F.array_sort(F.collect_list(F.struct("type", "severity", "detail"))).alias("events"))
    flag = alerts.where(F.col("entity_key") == key).agg(F.max("peak_risk").alias("peak_risk"), F.max("status").alias("status"))
    ways = traces.agg(F.sort_array(F.collect_list(F.struct("entity", "kind", "amount", "hops", "path"))).alias("traces"))
    one = past.crossJoin(told).crossJoin(flag).crossJoin(ways)  # one row each
    found = one.withColumns({"asked": F.lit(entity_key), "entity_key": F.lit(key), "window_id": F.lit(best.window_id), "risk": F.lit(best.risk)})
    return found.select("asked", "entity_key", "window_id", "risk", "risks", "events", "peak_risk", "status", "traces")


def document(**sections: DataFrame) -> DataFrame:
    """One row ``json``: an object with an array of rows per section, in the order of their columns.

    Sections are tables of a bounded size: totals, rankings, the edges that are shown.  An empty section is an empty array.
    """
    whole = None
    for name, rows in sections.items():
        part = rows.agg(F.sort_array(F.collect_list(F.struct(*rows.columns))).alias(name))
        whole = part if whole is None else whole.crossJoin(part)  # one row each
    return whole.select(F.to_json(F.struct(*sections)).alias("json"))
