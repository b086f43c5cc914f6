"""Training rows at the scale that a model is served at: the features of each window, pooled."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions.keys import graph_of, keyed, name_of
from chainloom.operators import correlate, detectors, evaluate, features, graph, resolve
from chainloom.storage import settle


def full_features(obs: DataFrame, mapping: DataFrame, many: bool = False) -> DataFrame:
    """``entity_id`` and the 28 features of ``obs`` (``resolve.coinjoin_like`` columns): correlate, detectors, graph, table."""
    senders = settle(resolve.dominant_owner(obs, "input_addresses", mapping), "senders")
    receivers = settle(resolve.dominant_owner(obs, "output_addresses", mapping), "receivers")
    flows = settle(correlate.flows(obs, senders, mapping), "flows")
    entities = settle(correlate.entities(obs, mapping, senders, receivers, flows, correlate.controls(obs, senders)), "entities")
    structural = detectors.structural_features(entities, obs, mapping, flows, resolve.first_owner(obs, "input_addresses", mapping), many)
    return features.feature_table(entities, settle(structural, "structural"), graph.graph_metrics(flows, many=many))


def keyed_by_window(obs: DataFrame) -> DataFrame:
    """``obs`` without ``window_id``, its observation ids and addresses keyed by it, so that windows share nothing.

    A null address stays null; rows without a window are left out.
    """
    window = F.col("window_id")
    inside = lambda c: F.transform(c, lambda a: keyed(window, a))
    return obs.where("window_id is not null").withColumns({"obs_id": keyed(window, F.col("obs_id")), "input_addresses": inside("input_addresses"), "output_addresses": inside("output_addresses")}).drop("window_id")


def pooled_rows(obs: DataFrame, truth: DataFrame, describe: Callable[[DataFrame, DataFrame], DataFrame] = partial(full_features, many=True)) -> DataFrame:
    """``(window_id, entity_id, label, features...)``: each window resolved and described by itself, then pooled.

    ``obs`` has ``window_id``, ``truth`` is ``(address, label, typology)``; an entity without known addresses has label 0.
    All windows go through one job, however many: addresses, observations and entities are keyed by window
    (:mod:`chainloom.functions.keys`), so components, edges and graphs of different windows do not touch.  ``describe`` gets such keys and must
    not compare entities of different windows, as :func:`full_features` does not with ``many``.
    Folds by ``window_id`` (:func:`chainloom.operators.models.with_folds`) keep one wallet's rows of one window together.
    """
    whole, mapping = _resolved(obs)
    labels = _labels(mapping, truth)
    rows = describe(whole, mapping).join(labels, "entity_id", "left")
    names = [c for c in rows.columns if c not in ("entity_id", "label")]
    return settle(_pooled(rows, obs, names), "rows")


def pooled_entities(obs: DataFrame, truth: DataFrame) -> DataFrame:
    """``(window_id, entity_id, label)`` of the rows of :func:`pooled_rows`, which none of the features decides."""
    mapping = _resolved(obs)[1]
    return _pooled(mapping.select("entity_id").distinct().join(_labels(mapping, truth), "entity_id", "left"), obs)


def _resolved(obs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The observations keyed by window and the entities of each window."""
    whole = settle(keyed_by_window(obs), "windows")
    if whole.isEmpty():
        raise ValueError("no window has observations")
    return whole, settle(resolve.entity_map(whole, many=True), "mapping")


def _labels(mapping: DataFrame, truth: DataFrame) -> DataFrame:
    return evaluate.project_labels(mapping.select(name_of("address").alias("address"), "entity_id"), truth).select("entity_id", "label")


def _pooled(rows: DataFrame, obs: DataFrame, names: list[str] | tuple[str, ...] = ()) -> DataFrame:
    kind = obs.schema["window_id"].dataType
    return rows.select(graph_of("entity_id").cast(kind).alias("window_id"), name_of("entity_id").alias("entity_id"), F.coalesce("label", F.lit(0)).alias("label"), *names)


def window_sizes(pooled: DataFrame) -> DataFrame:
    """``(window_id, entities, illicit)``."""
    return pooled.groupBy("window_id").agg(F.count("*").alias("entities"), F.sum("label").alias("illicit"))
