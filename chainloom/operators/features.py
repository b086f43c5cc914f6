"""The 28-column feature table and its robust baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators.quantiles import exact_quantiles
from chainloom.storage import settle

#: Fixed order of the model's inputs.
FEATURES = (
    "address_count", "tx_count", "tx_sent", "tx_received", "log_value_btc", "value_per_tx", "fan_in", "fan_out",
    "in_out_ratio", "distinct_counterparties", "ip_count", "country_count", "asn_count", "active_days", "burst_score",
    "change_ratio", "peel_score", "output_uniformity", "mixer_score", "mixer_interaction", "collector_score", "exchange_score",
    "round_amount_ratio", "mean_payment_btc", "pagerank", "betweenness", "community_size", "net_flow_ratio",
)
ROBUST_Z = 0.6745


def feature_table(entities: DataFrame, structural: DataFrame, metrics: DataFrame) -> DataFrame:
    """``entity_id`` and the features as doubles; missing, null and non-finite values are 0."""
    whole = entities.join(structural, "entity_id", "left").join(metrics, "entity_id", "left")
    made = {
        "log_value_btc": F.log1p(F.greatest("value_btc", F.lit(0.0))),
        "value_per_tx": F.when(F.col("tx_count") != 0, F.col("value_btc") / F.col("tx_count")),
        "in_out_ratio": F.col("fan_in") / (F.col("fan_out") + 1),
    }

    def clean(name: str) -> Column:
        c = made.get(name, F.col(name)).cast("double")
        return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c).alias(name)

    return whole.select("entity_id", *map(clean, FEATURES))


def long_form(table: DataFrame, key: str = "entity_id", names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``(key, feature, x)``: one row per cell, so that statistics of all features are one aggregation."""
    return table.unpivot([key], list(names), "feature", "x")


def fit_baseline(table: DataFrame, names: tuple[str, ...] = FEATURES, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``(feature, median, mad, lower, upper)``: exact percentiles; a spread of 0, but for float noise, counts as 1."""
    cells = long_form(settle(table.select(*names), "cells").withColumn("entity_id", F.lit(0)), names=names)
    middle = exact_quantiles(cells, [0.5, low, high]).toDF("feature", "median", "lower", "upper")
    spread = exact_quantiles(cells.join(F.broadcast(middle), "feature").select("feature", F.abs(F.col("x") - F.col("median")).alias("x")), [0.5]).toDF("feature", "mad")
    return middle.join(spread, "feature").select("feature", "median", F.when(F.col("mad") < 1e-12, 1.0).otherwise(F.col("mad")).alias("mad"), "lower", "upper")


def robust_z(table: DataFrame, baseline: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``(entity_id, feature, x, z)``: clamped to the baseline's bounds, scaled by its spread (a row per feature: broadcast)."""
    cells = long_form(table, names=names).join(F.broadcast(baseline), "feature")
    clamped = F.greatest("lower", F.least("upper", "x"))
    return cells.select("entity_id", "feature", "x", (ROBUST_Z * (clamped - F.col("median")) / F.col("mad")).alias("z"))


def clamp(table: DataFrame, baseline: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``table`` with every feature held within the baseline's bounds."""
    bounds = F.broadcast(baseline.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("lower", "upper")))).alias("__b")))
    at = lambda n: F.element_at("__b", F.lit(n))
    return table.crossJoin(bounds).select("entity_id", *(F.greatest(at(n)["lower"], F.least(at(n)["upper"], F.col(n))).alias(n) for n in names))
