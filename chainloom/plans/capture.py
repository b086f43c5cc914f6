"""The tables that most queries derive from a capture, each settled once per session and input."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators import correlate, detectors, features, graph, resolve
from chainloom.plans.observations import observations
from chainloom.storage import bucket_number, settle, settle_by


class Capture:
    """Observations and what is resolved from them; every attribute is a DataFrame over a settled table."""

    def __init__(self, obs: DataFrame, dealt: DataFrame | None = None) -> None:
        """``dealt``: the same rows, dealt for :func:`chainloom.storage.settle_by` by ``obs_id``."""
        self.raw, self._dealt = obs, dealt

    @cached_property
    def obs(self) -> DataFrame:
        return settle_by(resolve.coinjoin_like(self.raw if self._dealt is None else self._dealt), "obs_id", "obs", self._dealt is not None)

    @cached_property
    def mapping(self) -> DataFrame:
        return settle(resolve.entity_map(self.obs), "mapping")

    @cached_property
    def owners(self) -> DataFrame:
        return settle_by(resolve.owners(self.obs, "input_addresses", self.mapping), "obs_id", "owners")

    @cached_property
    def senders(self) -> DataFrame:
        return self.owners.select("obs_id", "entity_id")

    @cached_property
    def receivers(self) -> DataFrame:
        return settle_by(resolve.dominant_owner(self.obs, "output_addresses", self.mapping), "obs_id", "receivers")

    @cached_property
    def first(self) -> DataFrame:
        return self.owners.select("obs_id", F.col("first").alias("entity_id"))

    @cached_property
    def flows(self) -> DataFrame:
        return settle(correlate.flows(self.obs, self.senders, self.mapping), "flows")

    @cached_property
    def controls(self) -> DataFrame:
        return settle(correlate.controls(self.obs, self.senders), "controls")

    @cached_property
    def entities(self) -> DataFrame:
        return settle(correlate.entities(self.obs, self.mapping, self.senders, self.receivers, self.flows, self.controls), "entities")

    @cached_property
    def structural(self) -> DataFrame:
        return settle(detectors.structural_features(self.entities, self.obs, self.mapping, self.flows, self.first), "structural")

    @cached_property
    def scored(self) -> DataFrame:
        """Entities with their detector columns and a risk by formula, 0..100, where no model is fitted."""
        whole = self.entities.join(self.structural, "entity_id")
        risk = F.rint(100 * F.least(F.lit(1.0), F.lit(0.5) * F.col("collector_score") + 0.4 * F.col("peel_score") + 0.3 * F.col("mixer_interaction") + 0.2 * F.col("burst_score") + 0.15 * F.col("country_count")))
        return settle(whole.withColumn("risk", risk.cast("int")), "scored")

    @cached_property
    def pairs(self) -> DataFrame:
        return settle(graph.flow_graph(self.flows), "pairs")

    @cached_property
    def metrics(self) -> DataFrame:
        return settle(graph.graph_metrics(self.flows), "metrics")

    @cached_property
    def features(self) -> DataFrame:
        return settle(features.feature_table(self.entities, self.structural, self.metrics), "features")

    @cached_property
    def replayed(self):
        """The state after every window in turn (:class:`chainloom.operators.monitor.Monitor`)."""
        from chainloom.plans.replay import replayed

        return replayed(self)

    @cached_property
    def pooled(self) -> DataFrame:
        """The features of every span of days by itself (:func:`chainloom.operators.training.pooled_rows`)."""
        from chainloom.operators import monitor, training
        from chainloom.plans import records, replay

        return settle(training.pooled_rows(monitor.span_windows(self.obs, records.SPAN), replay.truth(self).drop("owner")), "pooled")

    @cached_property
    def history(self) -> DataFrame:
        from chainloom.plans.replay import history

        return settle(history(self), "history")


_open: dict[tuple[str, str], Capture] = {}


def capture(spark: SparkSession, sf_dir: str) -> Capture:
    """The capture of one folder; its settled tables serve all queries of the session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _open:
        _open[key] = Capture(observations(spark, sf_dir), observations(spark, sf_dir, bucket_number(spark)))
    return _open[key]
