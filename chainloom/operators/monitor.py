"""Batch after batch: each window is resolved against pinned keys, scored, compared with the one before, and kept.

The state is a folder of commits (:mod:`chainloom.sources.commits`), one for each window: scores and events are added to,
the registry of addresses, the keys, entities, alerts and windows are keyed tables.  A window starts from the commit of the
window before it and takes effect with its own commit, whole or not at all.  So a window that is delivered twice, or that
died between any two writes, gives the state of one clean run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators import resolve, windows
from chainloom.operators.features import ROBUST_Z
from chainloom.sources.commits import Commit, CommitLog
from chainloom.storage import settle

COUNTS = ("tx", "address_count", "country_count", "ip_count")
REGISTRY = "address string, key string, first_window int"
KEYS = "key string, first_window int, parent string"
ENTITIES = "entity_key string, first_window int, last_window int, address_count long"
WINDOWS = "window_id int, label string, start_ts timestamp, end_ts timestamp, transactions long, entities long, new_entities long, merged_entities long, events long, alerts long"
EVENTS = "window_id int, entity_key string, type string, severity string, risk_from int, risk_to int, detail string"


def span_windows(obs: DataFrame, days: int) -> DataFrame:
    """``obs`` with ``window_id``: spans of so many calendar days, counted from the first day, from 1 on."""
    first = obs.agg(F.min(F.to_date("timestamp")).alias("first_day"))
    return obs.crossJoin(F.broadcast(first)).withColumn("window_id", (F.floor(F.datediff(F.to_date("timestamp"), "first_day") / days) + 1).cast("int")).drop("first_day")  # one row


def describe(obs: DataFrame, mapping: DataFrame) -> DataFrame:
    """``(entity_id, tx, address_count, country_count, ip_count)`` of the senders in ``obs``."""
    owned = resolve.dominant_owner(obs, "input_addresses", mapping)
    sent = obs.select("obs_id", "src_ip", "geo_country").join(owned, "obs_id")
    base = sent.groupBy("entity_id").agg(F.count("*").alias("tx"), F.count_distinct(F.when(F.col("geo_country") != "", F.col("geo_country"))).alias("country_count"), F.count_distinct("src_ip").alias("ip_count"))
    used = resolve.exploded(obs, "input_addresses", mapping).select("obs_id", "address").join(owned, "obs_id").groupBy("entity_id").agg(F.count_distinct("address").alias("address_count"))
    return base.join(used, "entity_id").select("entity_id", *COUNTS)


def score(table: DataFrame) -> DataFrame:
    """``table`` with a risk by formula, 0..100, where no model is given."""
    return table.withColumn("risk", F.least(F.lit(100), 9 * F.col("ip_count") + 11 * F.col("country_count") + 4 * F.col("tx") + 6 * F.col("address_count")).cast("int"))


def z_scores(table: DataFrame, baseline: DataFrame, names: tuple[str, ...] = COUNTS) -> DataFrame:
    """``(window_id, entity_key, feature, x, z)`` against a baseline of a row per feature."""
    cells = table.select("window_id", "entity_key", *(F.col(n).cast("double").alias(n) for n in names)).unpivot(["window_id", "entity_key"], list(names), "feature", "x").join(F.broadcast(baseline), "feature")
    return cells.select("window_id", "entity_key", "feature", "x", (ROBUST_Z * (F.greatest("lower", F.least("upper", "x")) - F.col("median")) / F.col("mad")).alias("z"))


def relative_moves(table: DataFrame, names: tuple[str, ...] = COUNTS) -> DataFrame:
    """What stands for :func:`z_scores` without a baseline: the change relative to the value before, 0 in the first window given."""
    cells = table.select("window_id", "entity_key", *(F.col(n).cast("double").alias(n) for n in names)).unpivot(["window_id", "entity_key"], list(names), "feature", "x")
    steps = windows.with_previous(table, table.select("window_id").distinct())
    before = cells.select(F.col("window_id").alias("prev"), "entity_key", "feature", F.col("x").alias("x0"))
    both = cells.join(F.broadcast(steps), "window_id").join(before, ["prev", "entity_key", "feature"], "left")
    return both.select("window_id", "entity_key", "feature", "x", F.coalesce((F.col("x") - F.col("x0")) / F.when(F.abs("x0") > 1e-9, F.abs("x0")).otherwise(1.0), F.lit(0.0)).alias("z"))


class View:
    """One table of the state, as it is now or as of a window."""

    def __init__(self, read: Callable[[Commit | None], DataFrame], monitor: Monitor) -> None:
        self._read, self._monitor = read, monitor

    def read(self, window_id: int | None = None) -> DataFrame:
        return self._read(self._monitor._at(window_id))


class Monitor:
    """The state of one capture that arrives in windows."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 4, fan_in: int = 4) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        keyed = {"registry": ("address", REGISTRY), "keys": ("key", KEYS), "entities": ("entity_key", ENTITIES), "alerts": ("entity_key", windows.ALERTS), "windows": ("window_id", WINDOWS)}
        self.log = CommitLog(spark, f"{self.path}/state", keyed, {"scores": "", "events": EVENTS}, buckets, fan_in)
        self.entities, self.alerts, self.windows, self.keys = (View(lambda at, n=n: self.log.read(n, at), self) for n in ("entities", "alerts", "windows", "keys"))
        self.aliases, self.registry = View(self._aliases, self), View(self._registry, self)

    def _at(self, window_id: int | None = None) -> Commit | None:
        found = [c for c in self.log.commits() if window_id is None or c.window <= window_id]
        return found[-1] if found else None

    def _aliases(self, at: Commit | None) -> DataFrame:
        """``(old_key, new_key)``: absorbed keys and what absorbed them."""
        return self.log.read("keys", at).where("key <> parent").select(F.col("key").alias("old_key"), F.col("parent").alias("new_key"))

    def _registry(self, at: Commit | None) -> DataFrame:
        """``(address, key, first_window)`` with the key that serves the address at that point."""
        return windows.served(self.log.read("registry", at).withColumnRenamed("key", "entity_key"), windows.canonical(self._aliases(at))).withColumnRenamed("entity_key", "key")

    def scores(self) -> DataFrame:
        """``(window_id, entity_key, features..., risk)`` of every window: the feature vectors as they were scored."""
        return self._grown("scores", self.log.commits())

    def _grown(self, name: str, commits: list[Commit]) -> DataFrame:
        if name == "scores":  # its columns are those of the features, which a caller may choose
            folders = [f"{self.log.path}/{c.added[name]}" for c in commits if name in c.added]
            return self.spark.read.parquet(*folders)
        return self.log.grown(name, commits)

    def events(self) -> DataFrame:
        return self._grown("events", self.log.commits())

    def features_at_peak(self) -> DataFrame:
        """Per entity the row of the earliest window of its highest risk: what explains the risk that is shown."""
        best = self.scores().groupBy("entity_key").agg(F.max_by("window_id", F.struct("risk", -F.col("window_id"))).alias("window_id"))
        return self.scores().join(best, ["entity_key", "window_id"])

    def summary(self) -> DataFrame:
        """One row: windows, entities, events, open alerts by canonical key."""
        return windows.store_summary(self.scores(), self.events(), self.alerts.read(), windows.canonical(self.aliases.read()))

    def judge(self, entity_key: str, status: str, assignee: str | None = None, note: str | None = None) -> DataFrame:
        """An analyst's word on an alert, a step of its own after the last window; returns the alert."""
        last = self._at()
        if last is None:
            raise ValueError("no window has been processed")
        step = self.log.begin(last.window, last.step + 1)
        word = {"entity_key": entity_key, "status": status, "assignee": assignee, "note": note}
        mine = self.log.read("alerts", step.base).where(F.col("entity_key") == entity_key)
        step.mine.judged = [word]
        found = step.put("alerts", windows.set_status(mine, **word))
        step.commit()
        return found

    def _window_id(self, window_id: int | None, label: str | None, commits: list[Commit]) -> int:
        """The number under which the label is registered, else the given one, else the next."""
        known = {c.label: c.window for c in commits if c.label is not None and c.step == 0}
        if label in known:
            if window_id not in (None, known[label]):
                raise ValueError(f"{label} is window {known[label]}")
            return known[label]
        return window_id if window_id is not None else (commits[-1].window + 1 if commits else 1)

    def process_window(
        self,
        obs: DataFrame,
        window_id: int | None = None,
        label: str | None = None,
        members: DataFrame | None = None,
        describe: Callable[[DataFrame, DataFrame], DataFrame] = describe,
        score: Callable[[DataFrame], DataFrame] = score,
        baseline: DataFrame | None = None,
        names: tuple[str, ...] = COUNTS,
        floor: int = windows.FLOOR,
        again: bool = False,
        drop_later: bool = False,
    ) -> DataFrame:
        """Takes the observations of one window (``resolve.coinjoin_like`` columns) into the state; returns its row of ``windows``.

        ``members`` is ``(address, derived)``, by default the clusters of the window itself.  Keys are pinned before anything
        is computed, so features, flows and scores are those of the lasting identities.  Without a ``baseline``
        moves count relative to the value before.

        A window is known by its label, where it has one, else by its number.  Rows that were taken already change nothing
        (``again`` works them out once more, to the same end).  Other rows for the last window replace it, with what analysts
        said since then said again; for an earlier one, or a window from before the last, they are refused unless
        ``drop_later`` gives up the windows after it, which then must be processed again.
        """
        obs, commits = settle(obs, "window"), self.log.commits()
        window_id = self._window_id(window_id, label, commits)
        digest = str(obs.agg(F.sum(F.xxhash64(*sorted(obs.columns)).cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first())
        here_now = {c.window: c for c in commits if c.step == 0}
        same = window_id in here_now and here_now[window_id].digest == digest
        if same and not again:
            return self.windows.read().where(F.col("window_id") == window_id)
        if not same and commits and commits[-1].window > window_id and not drop_later:
            raise ValueError(f"window {window_id} comes after window {commits[-1].window} has been processed")
        step = self.log.begin(window_id, 0)
        step.mine.label, step.mine.digest = label, digest
        if not same:
            step.mine.cut = bool(commits and commits[-1].window >= window_id)
            step.mine.judged = [w for c in commits if c.window == window_id for w in c.judged]
        elif here_now[window_id].judged:
            step.mine.judged = here_now[window_id].judged
        before = [c for c in commits if c.window < window_id]

        if members is None:
            members = resolve.entity_map(obs).select("address", F.col("entity_id").alias("derived"))
        members = settle(members, "members")
        held = settle(self.log.lookup("registry", step.base, members.select("address")).select("address", "key"), "held")
        met = held.select("key").unionByName(members.select(F.col("derived").alias("key"))).distinct()
        roots = self._roots(met, step.base)
        keys, merges, moved = (settle(t, "identity") for t in windows.resolve_incremental(members, held, roots, window_id))
        mapping = settle(members.join(keys, "derived").select("address", F.col("key").alias("entity_id")), "mapping")
        step.put("registry", mapping.join(held, "address", "left_anti").select("address", F.col("entity_id").alias("key"), F.lit(window_id).alias("first_window")))
        step.put("keys", moved)

        fresh = score(describe(obs, mapping)).withColumnRenamed("entity_id", "entity_key").withColumn("window_id", F.lit(window_id))
        here = step.add("scores", fresh)
        last = [c for c in before if c.step == 0][-1:]
        history = self._grown("scores", last).unionByName(here) if last else here
        mine = here.select("entity_key", F.lit(window_id).alias("first_window"), F.lit(window_id).alias("last_window"), "address_count")
        seen = self.log.lookup("entities", step.base, history.select("entity_key"))
        state = settle(windows.upsert_entities(seen, mine), "entities")
        step.put("entities", state.join(here.select("entity_key"), "entity_key", "left_semi"))

        z = z_scores(history, baseline, names) if baseline is not None else relative_moves(history, names)
        changes = settle(windows.delta_attribution(z, windows.with_previous(history, history.select("window_id").distinct())), "changes")
        found = windows.detect_events(history, changes, floor, state.select("entity_key", "first_window")).where(F.col("window_id") == window_id)
        told = step.add("events", windows.with_detail(found, changes, history).unionByName(windows.merge_events(merges, window_id)))

        loud = here.where(F.col("risk") >= floor).select("entity_key", "window_id", "risk")
        alerts = self.log.lookup("alerts", step.base, loud.select("entity_key").unionByName(merges.select(F.col("absorbed").alias("entity_key"))))
        raised = windows.upsert_alerts(windows.close_merged(alerts, merges, window_id), loud)
        for word in step.mine.judged:
            raised = windows.set_status(raised, **word)
        step.put("alerts", raised)

        span = obs.agg(F.min("timestamp").alias("start_ts"), F.max("timestamp").alias("end_ts"), F.count("*").alias("transactions"))
        counts = keys.agg(F.count_if(F.col("state") == "new").alias("new_entities")).crossJoin(merges.agg(F.count_distinct("survivor").alias("merged_entities")))
        counts = counts.crossJoin(here.agg(F.count("*").alias("entities"), F.count_if(F.col("risk") >= floor).alias("alerts")))
        counts = counts.crossJoin(told.agg(F.count("*").alias("events")))  # one row each
        row = span.crossJoin(counts).select(F.lit(window_id).alias("window_id"), F.coalesce(F.lit(label), F.to_date("start_ts").cast("string")).alias("label"), "start_ts", "end_ts", "transactions", "entities", "new_entities", "merged_entities", "events", "alerts")
        shown = step.put("windows", row)
        step.commit()
        return shown

    def _roots(self, met: DataFrame, at: Commit | None) -> DataFrame:
        """``(key, first_window, root, root_first)`` of the registered keys among ``met``: pointers are followed for these alone."""
        now = settle(self.log.lookup("keys", at, met).select("key", "first_window", F.col("parent").alias("root"), F.col("first_window").alias("root_first")), "roots")
        while True:
            far = now.where("key <> root").select(F.col("root").alias("key")).distinct()
            if far.isEmpty():
                return now
            step = self.log.lookup("keys", at, far).select(F.col("key").alias("root"), F.col("parent").alias("__to"), F.col("first_window").alias("__first"))
            after = settle(now.join(step, "root", "left").select("key", "first_window", F.coalesce("__to", "root").alias("root"), F.coalesce("__first", "root_first").alias("root_first"), (F.col("__to") != F.col("root")).alias("__moved")), "roots")
            now = after.drop("__moved")
            if after.where("__moved").isEmpty():
                return now


def replay(monitor: Monitor, obs: DataFrame, **how) -> DataFrame:
    """Every window of ``obs`` (with ``window_id``) in order, into an empty state; returns the rows of ``windows``.

    The windows are a handful of numbers; their observations stay distributed.  ``members`` among the options is
    a table over all addresses, of which each window takes those it uses.
    """
    members = how.pop("members", None)
    for (window_id,) in sorted(obs.select("window_id").distinct().collect()):
        mine = obs.where(F.col("window_id") == window_id).drop("window_id")
        used = None
        if members is not None:
            seen = mine.select(F.explode(F.concat("input_addresses", "output_addresses")).alias("address")).distinct()
            used = members.join(seen, "address", "left_semi")
        monitor.process_window(mine, window_id, members=used, **how)
    return monitor.windows.read()
