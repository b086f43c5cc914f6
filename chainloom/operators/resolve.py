"""Addresses to entities: coordinated rounds, co-spending, components, stable ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.functions.keys import graph_of, keyed, name_of
from chainloom.operators.components import connected_components


def relative_range(amounts: str) -> Column:
    """(max - min) / max, infinite where the maximum is not positive."""
    top, low = F.array_max(amounts), F.array_min(amounts)
    return F.when(top > 0, (top - low) / top).otherwise(F.lit(float("inf")))


def coinjoin_like(obs: DataFrame, min_inputs: int = 4, tolerance: float = 0.02) -> DataFrame:
    """``obs`` with ``is_coinjoin``: several positive inputs of equal value; two or more positive outputs must be equal too.

    Array expressions on the row alone: no shuffle.
    """
    inputs = (F.size("input_amounts") >= min_inputs) & (F.array_min("input_amounts") > 0) & (relative_range("input_amounts") <= tolerance)
    judged = (F.size("output_amounts") >= 2) & (F.array_min("output_amounts") > 0)
    return obs.withColumn("is_coinjoin", F.coalesce(inputs & (~judged | (relative_range("output_amounts") <= tolerance)), F.lit(False)))


def co_spend_edges(obs: DataFrame) -> DataFrame:
    """``(anchor, other)``: the first input address with each of the inputs, itself included; rounds are left out.

    A star of k edges per transaction, not a clique.
    """
    single = obs.where("not is_coinjoin and size(input_addresses) > 0")
    return single.select(F.col("input_addresses")[0].alias("anchor"), F.explode("input_addresses").alias("other")).distinct()


def stable_id(anchor: Column, prefix: str = "E-", digits: int = 9) -> Column:
    """Prefix and decimal digits of the first 8 bytes of SHA-256, big-endian, modulo 10**digits."""
    head = F.conv(F.substring(F.sha2(anchor, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.concat(F.lit(prefix), F.lpad((head % F.lit(10**digits).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"), digits, "0"))


def with_stable_ids(sizes: DataFrame, prefix: str = "E-", many: bool = False) -> DataFrame:
    """``(anchor, n)`` to ``(anchor, entity_id)``: among clusters of one 9-digit id the largest keeps it, then by
    anchor; the others take 12 digits, and 15 where that collides too.  Anchors of many graphs get keys of theirs."""
    order = lambda c: W.partitionBy(c).orderBy(F.desc("n"), "anchor")
    ids = sizes.select("anchor", "n", *((keyed(graph_of("anchor"), stable_id(name_of("anchor"), prefix, d)) if many else stable_id(F.col("anchor"), prefix, d)).alias(f"d{d}") for d in (9, 12, 15)))
    ids = ids.withColumn("r9", F.row_number().over(order("d9")))
    first = ids.where("r9 = 1").select("anchor", F.col("d9").alias("entity_id"))
    rest = ids.where("r9 > 1").withColumn("r12", F.row_number().over(order("d12")))
    return first.unionByName(rest.select("anchor", F.when(F.col("r12") == 1, F.col("d12")).otherwise(F.col("d15")).alias("entity_id")))


def entity_map(obs: DataFrame, many: bool = False) -> DataFrame:
    """``(address, entity_id)`` of every input address outside coordinated rounds (common-input ownership)."""
    members = connected_components(co_spend_edges(obs), "anchor", "other").select(F.col("node").alias("address"), F.col("component").alias("anchor"))
    return members.join(with_stable_ids(members.groupBy("anchor").agg(F.count("*").alias("n")), many=many), "anchor").select("address", "entity_id")


def entity_members(mapping: DataFrame) -> DataFrame:
    """``(entity_id, members)``, members sorted."""
    return mapping.groupBy("entity_id").agg(F.array_sort(F.collect_set("address")).alias("members"))


def cluster_stats(mapping: DataFrame) -> DataFrame:
    """One row: clusters, those of several addresses, largest, mean size."""
    sizes = mapping.groupBy("entity_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("n") > 1).alias("multi_address"), F.max("n").alias("largest"), F.avg("n").alias("mean_size"))


def exploded(obs: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``(obs_id, pos, address, entity_id)`` of a list column's addresses that belong to an entity."""
    flat = obs.select("obs_id", F.posexplode(column).alias("pos", "address"))
    return flat.join(mapping, "address").select("obs_id", "pos", "address", "entity_id")


def owners(obs: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``(obs_id, entity_id, first)``: the owner of most addresses of the list (ties go to the earliest position), and that of the first address that has one."""
    votes = exploded(obs, column, mapping).repartition("obs_id").groupBy("obs_id", "entity_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos"))
    return votes.groupBy("obs_id").agg(F.min_by("entity_id", F.struct(-F.col("n"), F.col("pos"))).alias("entity_id"), F.min_by("entity_id", "pos").alias("first"))


def dominant_owner(obs: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``(obs_id, entity_id)``: the owner of most addresses of the list; ties go to the earliest position."""
    return owners(obs, column, mapping).select("obs_id", "entity_id")


def first_owner(obs: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``(obs_id, entity_id)``: the owner of the first address of the list that has one."""
    return exploded(obs, column, mapping).groupBy("obs_id").agg(F.min_by("entity_id", "pos").alias("entity_id"))
