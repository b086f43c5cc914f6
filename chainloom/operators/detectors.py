"""Structural detectors over the entity table and the two edge kinds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions.keys import graph_of
from chainloom.functions.sums import exact_sum
from chainloom.operators.resolve import exploded


def clip(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def peel_scores(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """``(entity_id, change_ratio, peel_score)``: most value comes back as change, and few are paid."""
    paid = edges.groupBy(F.col("src").alias("entity_id")).agg(F.sum("value").alias("external"), F.count_distinct("dst").alias("degree"))
    both = entities.select("entity_id", "value_sent").join(paid, "entity_id", "left")
    change = clip(F.when(F.col("value_sent") > 0, (F.col("value_sent") - F.coalesce("external", F.lit(0.0))) / F.col("value_sent")).otherwise(0.0))
    focus = clip(F.lit(1.0) / F.greatest(F.coalesce("degree", F.lit(0)), F.lit(1)) * 1.6)
    return both.select("entity_id", change.alias("change_ratio"), clip(change * focus).alias("peel_score"))


def round_sides(obs: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Participants of coordinated rounds, and the services that take the pooled outputs; ``(entity_id)`` each."""
    rounds = obs.where("is_coinjoin")
    inside = exploded(rounds, "input_addresses", mapping).select("entity_id").distinct()
    pooled = exploded(rounds, "output_addresses", mapping).select("entity_id").distinct()
    return inside, pooled.join(inside, "entity_id", "left_anti")


def output_uniformity(obs: DataFrame, first: DataFrame) -> DataFrame:
    """``(entity_id, uniformity)``: mean of 1 - spread over transactions of two or more outputs."""
    top, low = F.array_max("output_amounts"), F.array_min("output_amounts")
    mean = F.aggregate("output_amounts", F.lit(0.0), lambda a, x: a + x)
    usable = obs.where((F.size("output_amounts") >= 2) & (mean > 0)).select("obs_id", (1 - (top - low) / F.greatest(top, F.lit(1e-12))).alias("even"))
    return usable.join(first, "obs_id").groupBy("entity_id").agg(F.avg("even").alias("uniformity"))


def mixer_scores(entities: DataFrame, obs: DataFrame, mapping: DataFrame, edges: DataFrame, first: DataFrame) -> DataFrame:
    """``(entity_id, output_uniformity, mixer_score, mixer_interaction)``: is it the service, or does it use one?"""
    inside, services = round_sides(obs, mapping)
    near = edges.join(services.withColumnRenamed("entity_id", "src"), "src", "left_semi").select(F.col("dst").alias("entity_id"))
    near = near.unionByName(edges.join(services.withColumnRenamed("entity_id", "dst"), "dst", "left_semi").select(F.col("src").alias("entity_id")))
    touched = near.unionByName(inside).distinct().withColumn("touched", F.lit(True))
    whole = entities.select("entity_id").join(output_uniformity(obs, first), "entity_id", "left")
    whole = whole.join(services.withColumn("service", F.lit(True)), "entity_id", "left").join(touched, "entity_id", "left")
    even, service = F.coalesce("uniformity", F.lit(0.0)), F.coalesce("service", F.lit(False))
    return whole.select(
        "entity_id",
        F.round(even, 4).alias("output_uniformity"),
        F.when(service, 1.0).otherwise(clip(even * 0.35)).alias("mixer_score"),
        F.when(~service & F.coalesce("touched", F.lit(False)), 1.0).otherwise(0.0).alias("mixer_interaction"),
    )


def flow_shape(entities: DataFrame, many: bool = False) -> DataFrame:
    """``(entity_id, collector_score, exchange_score)``, fans scaled by the largest of the capture (a row for each, joined)."""
    entities = entities.select("*", graph_of("entity_id", many).alias("graph"))
    tops = entities.groupBy("graph").agg(F.greatest(F.max("fan_in"), F.lit(1)).alias("top_in"), F.greatest(F.max("fan_out"), F.lit(1)).alias("top_out"))
    fi, fo = F.col("fan_in").cast("double"), F.col("fan_out").cast("double")
    lean = clip((fi - fo) / F.greatest(fi, F.lit(1.0)))
    even = 1.0 - F.abs(fi - fo) / F.greatest(fi + fo, F.lit(1.0))
    return entities.join(F.broadcast(tops), "graph").select(
        "entity_id",
        clip(fi / F.col("top_in") * lean * 1.5).alias("collector_score"),
        clip(F.least(fi / F.col("top_in"), fo / F.col("top_out")) * even * 1.4).alias("exchange_score"),
    )


def value_shape(entities: DataFrame, obs: DataFrame, first: DataFrame) -> DataFrame:
    """``(entity_id, round_amount_ratio, mean_payment_btc)``: payments within 1 % of a multiple of 0.1."""
    paid = obs.join(first, "obs_id").select("entity_id", F.explode("output_amounts").alias("v"))
    ratio = F.col("v") / 0.1
    near = ((F.col("v") > 0) & (F.abs(ratio - F.rint(ratio)) < 0.01)).cast("double")
    shape = paid.groupBy("entity_id").agg(F.avg(near).alias("r"), F.avg("v").alias("m"))
    return entities.select("entity_id").join(shape, "entity_id", "left").select("entity_id", F.coalesce("r", F.lit(0.0)).alias("round_amount_ratio"), F.coalesce("m", F.lit(0.0)).alias("mean_payment_btc"))


def structural_features(entities: DataFrame, obs: DataFrame, mapping: DataFrame, edges: DataFrame, first: DataFrame, many: bool = False) -> DataFrame:
    """All detector columns, one row per entity."""
    parts = [peel_scores(entities, edges), mixer_scores(entities, obs, mapping, edges, first), flow_shape(entities, many), value_shape(entities, obs, first)]
    return reduce(lambda a, b: a.join(b, "entity_id", "full"), parts).fillna(0.0)


#: Tag, score column and threshold, in the order in which tags are listed.
#: Thresholds of the typologies, of shown behaviour and of the plain rules.
TYPOLOGIES = (
    ("coinjoin_mixer", "mixer_score", 0.5),
    ("mixer_interaction", "mixer_interaction", 0.5),
    ("peel_chain", "peel_score", 0.25),
    ("ransomware_fanin", "collector_score", 0.3),
    ("cross_border_control", "country_count", 2),
)


def typologies(scored: DataFrame) -> Column:
    """The tags an entity earns; ``scored`` holds detector columns and country_count."""
    return F.filter(F.array(*(F.when(F.col(c) >= t, F.lit(n)) for n, c, t in TYPOLOGIES)), lambda t: t.isNotNull())


BEHAVIOUR = (("mixing_service", "mixer_score", 0.5), ("exchange_like", "exchange_score", 0.5), ("fan_in_collector", "collector_score", 0.3), ("peel_chain", "peel_score", 0.25), ("multi_country", "country_count", 2))


def behaviour_class() -> Column:
    """The first class whose test an entity meets."""
    return F.coalesce(*(F.when(F.col(c) >= t, F.lit(n)) for n, c, t in BEHAVIOUR), F.lit("ordinary"))


def behaviour_composition(scored: DataFrame) -> DataFrame:
    """``(behaviour, entities, share, value_btc)``; shares sum to one."""
    groups = scored.select(behaviour_class().alias("behaviour"), "value_btc").groupBy("behaviour").agg(F.count("*").alias("entities"), F.round(exact_sum("value_btc"), 6).alias("value_btc"))
    total = groups.agg(F.sum("entities").alias("total"))
    return groups.crossJoin(F.broadcast(total)).select("behaviour", "entities", F.round(F.col("entities") / F.col("total"), 6).alias("share"), "value_btc")


def reasons(scored: DataFrame) -> DataFrame:
    """``(entity_id, reasons array<struct<kind, text>>)``: what speaks for and against an entity, in words."""
    why = lambda test, kind, text: F.when(test, F.struct(F.lit(kind).alias("kind"), text.alias("text")))
    percent = lambda c: F.format_string("%.0f%%", F.col(c) * 100)
    found = F.array(
        why(F.col("collector_score") >= 0.3, "against", F.format_string("%d senders against %d recipients", "fan_in", "fan_out")),
        why(F.col("peel_score") >= 0.25, "against", F.concat(percent("change_ratio"), F.lit(" of the value sent comes back as change"))),
        why(F.col("mixer_score") >= 0.5, "against", F.lit("takes the pooled outputs of coordinated rounds")),
        why(F.col("mixer_interaction") >= 0.5, "against", F.lit("one step from a mixing service")),
        why(F.col("country_count") >= 2, "against", F.format_string("controlled from %d countries", "country_count")),
        why(F.col("burst_score") >= 0.5, "against", F.concat(percent("burst_score"), F.lit(" of its activity falls within one hour"))),
        why(F.col("exchange_score") >= 0.5, "for", F.lit("balanced traffic with many counterparties, as a service has")),
        why(F.col("round_amount_ratio") >= 0.5, "for", F.lit("mostly round amounts, as people pay")),
    )
    return scored.select("entity_id", F.filter(found, lambda r: r.isNotNull()).alias("reasons"))


#: Fixed thresholds of the rules-only baseline.
RULES = {"peel_score": 0.25, "mixer_score": 0.5, "collector_score": 0.3, "mixer_interaction": 0.5}


def rules_baseline(scored: DataFrame) -> DataFrame:
    """``(entity_id, flagged)`` by thresholds alone."""
    return scored.select("entity_id", reduce(lambda a, b: a | b, (F.col(c) >= t for c, t in RULES.items())).alias("flagged"))


def rules_metrics(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: how many the rules alone flag, with precision, recall and F1 against ``(entity_id, label)``; without a label 0."""
    both = rules_baseline(scored).join(labels.select("entity_id", "label"), "entity_id", "left")
    y, hit = F.coalesce("label", F.lit(0)) == 1, F.col("flagged")
    sums = both.agg(F.count_if(hit).alias("flags"), F.count_if(hit & y).alias("tp"), F.count_if(y).alias("positives"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, flags, known = F.col("tp"), F.col("flags"), F.col("positives")
    return sums.select("flags", share(tp, flags).alias("precision"), share(tp, known).alias("recall"), share(2 * tp, flags + known).alias("f1"))
