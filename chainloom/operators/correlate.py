"""Both layers joined: value flows, control observations, one row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.operators.resolve import entity_members


def list_sum(column: str) -> Column:
    """The sum of an amount list, within the row."""
    return F.aggregate(column, F.lit(0.0), lambda acc, x: acc + x)


def flows(obs: DataFrame, owners: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(src, dst, value, txid, timestamp, obs_id)``: one edge per transaction and receiver; change is no payment.

    ``owners`` is ``(obs_id, entity_id)`` of the senders.
    """
    paid = obs.select("obs_id", "txid", "timestamp", F.explode(F.arrays_zip(F.col("output_addresses").alias("address"), F.col("output_amounts").alias("amount"))).alias("o"))
    paid = paid.select("obs_id", "txid", "timestamp", F.col("o.address").alias("address"), F.coalesce("o.amount", F.lit(0.0)).alias("amount"))
    both = paid.join(mapping.select("address", F.col("entity_id").alias("dst")), "address").join(owners.withColumnRenamed("entity_id", "src"), "obs_id").where("src <> dst")
    return both.groupBy("src", "dst", "obs_id", "txid", "timestamp").agg(F.round(F.sum("amount"), 8).alias("value"))


def controls(obs: DataFrame, owners: DataFrame) -> DataFrame:
    """``(ip, entity, country, asn, timestamp, txid)``: who broadcast a wallet's transactions, and from where."""
    seen = obs.join(owners.withColumnRenamed("entity_id", "entity"), "obs_id")
    return seen.select(F.col("src_ip").alias("ip"), "entity", F.coalesce("geo_country", F.lit("")).alias("country"), F.coalesce("asn", F.lit("")).alias("asn"), "timestamp", "txid")


def timeline(obs: DataFrame, senders: DataFrame, receivers: DataFrame) -> DataFrame:
    """``(entity_id, timestamp)``: one row per role an entity plays in an observation."""
    at = obs.select("obs_id", "timestamp")
    return at.join(senders, "obs_id").unionByName(at.join(receivers, "obs_id")).select("entity_id", "timestamp")


def burst_score(times: DataFrame, minutes: int = 60) -> DataFrame:
    """``(entity_id, burst_score)``: the largest share of an entity's events in any closed window of that length.

    Time is cut into buckets of eight lengths: a window that begins in one ends in it or in the first eighth of the next, so a bucket is
    looked at together with that, and however many events an entity has, a task sees those of nine lengths.  Events of one
    instant are summed first, after the one shuffle.
    """
    span = minutes * 60_000_000
    own, before = F.floor(F.col("at") / (8 * span)), F.floor((F.col("at") - span) / (8 * span))
    moments = times.where("timestamp is not null").select("entity_id", F.unix_micros("timestamp").alias("at"))
    placed = moments.select("entity_id", "at", F.explode(F.array_distinct(F.array(own, before))).alias("bucket")).repartition("entity_id", "bucket")
    placed = placed.groupBy("entity_id", "bucket", "at").agg(F.count("*").alias("n"))
    window = W.partitionBy("entity_id", "bucket").orderBy("at").rangeBetween(0, span)
    begun = placed.withColumn("within", F.sum("n").over(window)).where(own == F.col("bucket"))
    return begun.groupBy("entity_id").agg((F.max("within") / F.sum("n")).alias("burst_score"))


def _named(column: str) -> Column:
    return F.array_sort(F.collect_set(F.when(F.trim(column) != "", F.col(column))))


def entities(obs: DataFrame, mapping: DataFrame, senders: DataFrame, receivers: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """The 23-column entity table.

    Value sent is all output value of the transactions an entity sends, value received all input value of
    those it receives.  Each side is aggregated to one row per entity before it is joined.
    """
    sums = obs.select("obs_id", "timestamp", "is_coinjoin", list_sum("input_amounts").alias("value_in"), list_sum("output_amounts").alias("value_out"))
    roles = sums.join(senders, "obs_id").select("entity_id", "timestamp", "is_coinjoin", F.lit(1).alias("sent"), F.lit(0).alias("received"), "value_out", F.lit(0.0).alias("value_in"))
    roles = roles.unionByName(sums.join(receivers, "obs_id").select("entity_id", "timestamp", "is_coinjoin", F.lit(0).alias("sent"), F.lit(1).alias("received"), F.lit(0.0).alias("value_out"), "value_in"))
    moved = roles.groupBy("entity_id").agg(
        F.sum("sent").alias("tx_sent"),
        F.sum("received").alias("tx_received"),
        F.sum("value_out").alias("value_sent"),
        F.sum("value_in").alias("value_received"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.bool_or("is_coinjoin").alias("in_coinjoin"),
    )
    network = seen.groupBy(F.col("entity").alias("entity_id")).agg(
        F.array_sort(F.collect_set("ip")).alias("ips"),
        _named("country").alias("countries"),
        _named("asn").alias("asns"),
        F.count_distinct(F.to_date("timestamp")).alias("active_days"),
    )
    pairs = edges.select("src", "dst").distinct()
    fans = pairs.select(F.col("src").alias("entity_id"), F.col("dst").alias("other"), F.lit(1).alias("out"))
    fans = fans.unionByName(pairs.select(F.col("dst").alias("entity_id"), F.col("src").alias("other"), F.lit(0).alias("out")))
    fans = fans.groupBy("entity_id").agg(F.sum(1 - F.col("out")).alias("fan_in"), F.sum("out").alias("fan_out"), F.count_distinct("other").alias("distinct_counterparties"))
    burst = burst_score(roles.select("entity_id", "timestamp"))
    whole = entity_members(mapping)
    for part in (moved, network, fans, burst):
        whole = whole.join(part, "entity_id", "left")
    none, zero, nil = F.array().cast("array<string>"), F.lit(0).cast("long"), F.lit(0.0)
    count = lambda c: F.coalesce(c, zero).alias(c)
    held = lambda c: F.coalesce(c, none)
    sent, received = F.coalesce("value_sent", nil), F.coalesce("value_received", nil)
    return whole.select(
        "entity_id",
        F.size("members").cast("long").alias("address_count"),
        F.col("members").alias("addresses"),
        (F.coalesce("tx_sent", zero) + F.coalesce("tx_received", zero)).alias("tx_count"),
        count("tx_sent"),
        count("tx_received"),
        F.round(sent, 8).alias("value_sent"),
        F.round(received, 8).alias("value_received"),
        F.round(sent + received, 8).alias("value_btc"),
        count("fan_in"),
        count("fan_out"),
        count("distinct_counterparties"),
        F.size(held("ips")).cast("long").alias("ip_count"),
        held("ips").alias("ips"),
        held("countries").alias("countries"),
        F.size(held("countries")).cast("long").alias("country_count"),
        held("asns").alias("asns"),
        F.size(held("asns")).cast("long").alias("asn_count"),
        count("active_days"),
        "first_seen",
        "last_seen",
        F.coalesce("burst_score", nil).alias("burst_score"),
        F.coalesce("in_coinjoin", F.lit(False)).alias("in_coinjoin"),
    )


def correlation_stats(obs: DataFrame, mapping: DataFrame, edges: DataFrame, seen: DataFrame) -> DataFrame:
    """One row of counters over the capture."""
    parts = [
        obs.agg(F.count("*").alias("transactions"), F.count_if("is_coinjoin").alias("coinjoin_like")),
        mapping.agg(F.count("*").alias("addresses"), F.count_distinct("entity_id").alias("entities")),
        edges.agg(F.count("*").alias("flow_edges")),
        seen.agg(F.count("*").alias("control_edges"), F.count_distinct("ip").alias("ips")),
    ]
    whole = parts[0]
    for part in parts[1:]:  # one row each
        whole = whole.crossJoin(part)
    return whole
