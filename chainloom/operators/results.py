"""What a reader of a capture sees: rankings, edges, endpoints, neighbourhoods, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.operators.resolve import stable_id
from chainloom.storage import settle

#: Risk bands by lower bound.
BANDS = (("critical", 85), ("high", 70), ("medium", 50))


def band(risk: Column) -> Column:
    return F.coalesce(*(F.when(risk >= low, F.lit(name)) for name, low in BANDS), F.lit("low"))


#: Rows of one part of a ranking: a task numbers one part at a time.
PART_ROWS = 1 << 16


def ranked(rows: DataFrame, order: list[Column], name: str = "rank", kind: str = "int") -> DataFrame:
    """``rows`` numbered from 1 in the order, which must be total.

    Two-level: the rows are dealt out by ranges of the order, numbered within their partition, and each partition
    starts behind the rows of those before it; no window spans the table.
    """
    parts = max(1, -(-rows.count() // PART_ROWS))
    part, inside = "__part", "__inside"
    dealt = settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(part, F.spark_partition_id()).withColumn(inside, F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranked")
    sizes = dealt.groupBy(part).agg(F.count("*").alias("n"))
    starts = sizes.select(part, F.coalesce(F.sum("n").over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # a row per part
    return dealt.join(starts, part).withColumn(name, (F.col("start") + F.col(inside) + 1).cast(kind)).drop(part, inside, "start")


def leads(scored: DataFrame, n: int | None = None, probability: str | None = None) -> DataFrame:
    """Entities by risk, then the model's probability (six places; without a model the risk), then id, numbered from 1."""
    p = F.round(F.col(probability), 6) if probability else F.round(F.col("risk") / 100, 6)
    order = [F.desc("risk"), F.desc("confidence"), F.asc("entity_id")]
    whole = scored.select("entity_id", "risk", band(F.col("risk")).alias("band"), "value_btc", p.alias("confidence"))
    return ranked(whole.orderBy(*order).limit(n) if n else whole, order)


def alert_ids(ranked: DataFrame) -> DataFrame:
    """``(alert_id, entity_id, risk, band)``, ids numbered by rank."""
    return ranked.select(F.format_string("A-%04d", "rank").alias("alert_id"), "entity_id", "risk", "band")


def top_flow_edges(pairs: DataFrame, n: int = 130) -> DataFrame:
    return pairs.orderBy(F.desc("value"), "src", "dst").limit(n)


def control_pairs(seen: DataFrame) -> DataFrame:
    """``(ip, entity, n)``."""
    return seen.groupBy("ip", "entity").agg(F.count("*").alias("n"))


def top_control_edges(seen: DataFrame, n: int = 60) -> DataFrame:
    return control_pairs(seen).orderBy(F.desc("n"), "ip", "entity").limit(n)


def endpoint_nodes(seen: DataFrame, scored: DataFrame, n: int = 60) -> DataFrame:
    """``(endpoint_id, ip, observations, entities, peak_risk, countries)`` of the busiest IPs."""
    whole = seen.join(scored.select(F.col("entity_id").alias("entity"), "risk"), "entity", "left")
    by_ip = whole.groupBy("ip").agg(F.count("*").alias("observations"), F.count_distinct("entity").alias("entities"), F.max("risk").alias("peak_risk"), F.array_sort(F.collect_set(F.when(F.col("country") != "", F.col("country")))).alias("countries"))
    return by_ip.orderBy(F.desc("observations"), "ip").limit(n).select(stable_id(F.col("ip"), "N-").alias("endpoint_id"), "ip", "observations", "entities", "peak_risk", "countries")


def graph_edges(pairs: DataFrame, seen: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(kind, src, dst, weight)``: capped flow and control edges whose entities are among ``nodes`` (entity_id)."""
    known = nodes.select("entity_id")
    flow = top_flow_edges(pairs).join(known.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(known.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select(F.lit("flow").alias("kind"), "src", "dst", F.col("value").alias("weight"))
    control = top_control_edges(seen).join(known.withColumnRenamed("entity_id", "entity"), "entity", "left_semi").select(F.lit("control").alias("kind"), stable_id(F.col("ip"), "N-").alias("src"), F.col("entity").alias("dst"), F.col("n").cast("double").alias("weight"))
    return flow.unionByName(control)


def neighbourhood(pairs: DataFrame, seen: DataFrame, n: int = 5) -> DataFrame:
    """``(node, relation, other, weight, place, total, more)``: the heaviest neighbours per node and relation."""
    control = control_pairs(seen).withColumn("w", F.col("n").cast("double"))
    rows = pairs.select(F.col("src").alias("node"), F.lit("pays").alias("relation"), F.col("dst").alias("other"), F.col("value").alias("weight"))
    rows = rows.unionByName(pairs.select(F.col("dst").alias("node"), F.lit("paid_by").alias("relation"), F.col("src").alias("other"), F.col("value").alias("weight")))
    rows = rows.unionByName(control.select(F.col("entity").alias("node"), F.lit("controlled_from").alias("relation"), F.col("ip").alias("other"), F.col("w").alias("weight")))
    rows = rows.unionByName(control.select(F.col("ip").alias("node"), F.lit("controls").alias("relation"), F.col("entity").alias("other"), F.col("w").alias("weight")))
    group = W.partitionBy("node", "relation")
    ranked = rows.withColumns({"place": F.row_number().over(group.orderBy(F.desc("weight"), "other")), "total": F.sum("weight").over(group), "all": F.count("*").over(group)})
    return ranked.where(F.col("place") <= n).select("node", "relation", "other", "weight", "place", "total", F.greatest(F.col("all") - n, F.lit(0)).alias("more"))


def node_kind(scored: DataFrame) -> DataFrame:
    """``(entity_id, kind, label)``."""
    kind = F.when(F.col("mixer_score") >= 0.5, "mixer").when(F.col("exchange_score") >= 0.5, "exchange").when(F.col("collector_score") >= 0.3, "collector").otherwise("wallet")
    return scored.select("entity_id", kind.alias("kind"), F.concat(F.substring(F.col("addresses")[0], 1, 10), F.when(F.col("address_count") > 1, F.format_string(" (+%d)", F.col("address_count") - 1)).otherwise("")).alias("label"))


def integrity(edges: DataFrame, scored: DataFrame, lined: DataFrame) -> DataFrame:
    """``(check, violations)``: references that lead nowhere, self-payments, order and ranges."""
    ids = scored.select("entity_id")
    dangling = edges.select(F.explode(F.array("src", "dst")).alias("entity_id")).join(ids, "entity_id", "left_anti")
    ahead = lined.select((F.col("rank") + 1).alias("rank"), F.col("risk").alias("before"))
    ordered = lined.join(ahead, "rank")
    checks = {
        "dangling_edges": dangling,
        "self_flows": edges.where("src = dst"),
        "unknown_leads": lined.join(ids, "entity_id", "left_anti"),
        "rank_disorder": ordered.where("before < risk"),
        "risk_out_of_range": scored.where("risk < 0 or risk > 100"),
        "bad_ids": scored.where(~F.col("entity_id").rlike("^[EN]-[0-9]{4,}$")),
    }
    out = None
    for name, rows in checks.items():
        part = rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = part if out is None else out.unionByName(part)
    return out


def score_distribution(scored: DataFrame) -> DataFrame:
    """``(band, entities, share)`` of all scored entities; bands without any have a row too."""
    names = scored.sparkSession.createDataFrame([(n,) for n, _ in BANDS] + [("low",)], "band string")
    whole = names.join(scored.groupBy(band(F.col("risk")).alias("band")).agg(F.count("*").alias("n")), "band", "left").select("band", F.coalesce("n", F.lit(0)).alias("entities"))
    total = F.sum("entities").over(W.partitionBy())  # four rows
    return whole.select("band", "entities", F.coalesce(F.try_divide("entities", total), F.lit(0.0)).alias("share"))


def payload_checks(scored: DataFrame, edges: DataFrame, cards: DataFrame, histories: DataFrame, explained: DataFrame | None = None) -> DataFrame:
    """``(check, rows, violations)``: whether what is shown keeps to its contract of types, vocabularies and ranges.

    ``scored`` are entities, ``edges`` (kind, src, dst, weight), ``cards`` alerts (``windows.alert_cards``), ``histories``
    (``windows.risk_history``: never a risk beyond the window), ``explained`` (``models.explain``: contributions that add up).
    """
    bands, past = [n for n, _ in BANDS] + ["low"], W.partitionBy("entity_key").orderBy("window_id")
    kept = {
        "entity_id": (scored, F.col("entity_id").rlike("^E-[0-9]{4,}$")),
        "entity_risk": (scored, F.col("risk").between(0, 100)),
        "entity_counts": (scored, (F.size("addresses") == F.col("address_count")) & (F.size("countries") == F.col("country_count"))),
        "edge_kind": (edges, F.col("kind").isin("flow", "control")),
        "edge_ends": (edges, F.col("src").rlike("^[EN]-[0-9]{4,}$") & F.col("dst").rlike("^E-[0-9]{4,}$") & (F.col("src") != F.col("dst"))),
        "edge_weight": (edges, F.col("weight") > 0),
        "alert_band": (cards, F.col("severity").isin(*bands) & (F.col("severity") == band(F.col("score")))),
        "alert_peak": (cards, F.col("peak_risk") >= F.col("score")),
        "alert_windows": (cards, F.col("first_window") <= F.col("last_window")),
        "no_look_ahead": (histories.withColumn("__n", F.row_number().over(past)), F.size("risks") == F.col("__n")),
    }
    if explained is not None:
        kept["explanation_sum"] = (explained, F.abs("residual") < 1e-6)
    out = None
    for name, (rows, holds) in kept.items():
        part = rows.agg(F.count("*").alias("rows"), F.count_if(~F.coalesce(holds, F.lit(False))).alias("violations")).select(F.lit(name).alias("check"), "rows", "violations")
        out = part if out is None else out.unionByName(part)
    return out


def payload(scored: DataFrame, pairs: DataFrame, seen: DataFrame) -> DataFrame:
    """One JSON text per entity, with its band, kind and heaviest neighbours: the nested presentation record."""
    near = neighbourhood(pairs, seen).groupBy(F.col("node").alias("entity_id")).agg(F.sort_array(F.collect_list(F.struct("relation", "place", "other", F.round("weight", 8).alias("weight")))).alias("neighbours"))
    whole = scored.join(near, "entity_id", "left").withColumn("band", band(F.col("risk")))
    return whole.select("entity_id", F.to_json(F.struct("entity_id", "risk", "band", F.slice("addresses", 1, 40).alias("addresses"), "value_btc", "countries", "neighbours")).alias("json"))
