"""Windows, identity across them, change events, alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.operators.components import connected_components
from chainloom.operators.corpus import fold_last_day
from chainloom.operators.results import band
from chainloom.storage import settle

FLOOR = 50
SHIFT_Z = 2.0
#: What an alert's status may be; the last is no analyst's judgement.
STATUSES = ("new", "acknowledged", "investigating", "closed_false_positive", "closed_escalated", "closed_merged")
#: Statuses from which a new detection reopens an alert.
REOPENED = ("closed_false_positive", "closed_escalated")
ALERTS = "entity_key string, opened int, last_window int, peak_risk int, current_risk int, status string, assignee string, note string"


def day_windows(obs: DataFrame, least_share: float = 0.1) -> DataFrame:
    """``(window_id, label, start_ts, end_ts, n)``: calendar days, numbered from 1; a trailing fragment joins the day before."""
    days = obs.groupBy(F.to_date("timestamp").alias("d")).agg(F.count("*").alias("n"), F.min("timestamp").alias("s"), F.max("timestamp").alias("e"))
    folded = fold_last_day(days, least_share).groupBy("label").agg(F.min("d").alias("d"), F.sum("n").alias("n"), F.min("s").alias("start_ts"), F.max("e").alias("end_ts"))
    return folded.select(F.row_number().over(W.orderBy("d")).alias("window_id"), "label", "start_ts", "end_ts", "n")  # a row per day


def assign_windows(obs: DataFrame, windows: DataFrame) -> DataFrame:
    """``obs`` with ``window_id``: by day, so an equi-join on a small table."""
    days = windows.select("window_id", F.explode(F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))).alias("d"))
    return obs.withColumn("d", F.to_date("timestamp")).join(days, "d").drop("d")


def trailing(obs: DataFrame, window_id: int, n: int = 1) -> DataFrame:
    """The rows of the ``n`` windows before ``window_id``: context for it."""
    return obs.where((F.col("window_id") < window_id) & (F.col("window_id") >= window_id - n))


def canonical(aliases: DataFrame, rounds: int = 30) -> DataFrame:
    """``(old_key, key)``: aliases followed to their end; each round doubles the step, a cycle ends at its smallest key."""
    now = aliases.select(F.col("old_key"), F.col("new_key").alias("key")).where("old_key <> new_key")
    return connected_components(now, "old_key", "key", rounds).select(F.col("node").alias("old_key"), F.col("component").alias("key"))


def resolve_identity(clusters: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pinned keys for the clusters of a window.

    ``clusters`` is ``(address, derived)``, ``registry`` ``(address, key, first_window)`` with canonical keys.
    Returns ``(derived, key, state)`` with state new, kept, or merged, and merges ``(absorbed, survivor)``.
    Clusters that share a key, directly or through other clusters, and keys that share a cluster are one
    identity: components over (cluster, key) pairs, so the result does not depend on any order.  The earliest, then smallest key survives.
    """
    held = clusters.join(registry, "address", "left")
    pairs = held.where("key is not null").select(F.concat(F.lit("c:"), "derived").alias("a"), F.concat(F.lit("k:"), "key").alias("b")).distinct()
    group = settle(connected_components(settle(pairs, "pairs"), "a", "b"), "groups")
    keys = registry.groupBy("key").agg(F.min("first_window").alias("first_window"))
    named = group.where(F.col("node").startswith("k:")).select(F.substring("node", 3, 1000).alias("key"), "component").join(keys, "key")
    best = named.groupBy("component").agg(F.min_by("key", F.struct("first_window", "key")).alias("survivor"), F.count("*").alias("n"))
    mine = group.where(F.col("node").startswith("c:")).select(F.substring("node", 3, 1000).alias("derived"), "component").join(best, "component")
    whole = clusters.select("derived").distinct().join(mine, "derived", "left")
    state = F.when(F.col("survivor").isNull(), "new").when(F.col("n") > 1, "merged").otherwise("kept")
    merges = named.join(best, "component").where("key <> survivor").select(F.col("key").alias("absorbed"), "survivor")
    return whole.select("derived", F.coalesce("survivor", "derived").alias("key"), state.alias("state")), merges


def resolve_incremental(clusters: DataFrame, held: DataFrame, roots: DataFrame, window_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`resolve_identity` from what a window meets of the registry alone.

    ``held`` is ``(address, key)`` of the window's addresses as they were pinned, ``roots`` ``(key, first_window, root,
    root_first)`` of those keys and of the derived ids that are keys.  Returns keys and merges, between
    roots, and the rows ``(key, first_window, parent)`` that change: new keys, absorbed roots, and pointers that now can skip a step.
    """
    known = held.unionByName(clusters.select("address", F.col("derived").alias("key")))
    rooted = known.join(roots.select("key", F.col("root"), "root_first"), "key").select("address", F.col("root").alias("key"), F.col("root_first").alias("first_window")).distinct()
    keys, merges = resolve_identity(clusters, rooted)
    new = keys.where("state = 'new'").select("key", F.lit(window_id).alias("first_window"), F.col("key").alias("parent")).distinct()
    now = roots.join(merges.select(F.col("absorbed").alias("root"), "survivor"), "root", "left").withColumn("to", F.coalesce("survivor", "root"))
    inner = roots.where("key = root").select("key")
    far = now.where("key <> root").select("key", "first_window", F.col("to").alias("parent"))
    gone = merges.join(rooted.select(F.col("key").alias("absorbed"), "first_window").distinct(), "absorbed").select(F.col("absorbed").alias("key"), "first_window", F.col("survivor").alias("parent"))
    return keys, merges, new.unionByName(far.join(inner, "key", "left_anti")).unionByName(gone)


def remap_derived(clusters: DataFrame, registry: DataFrame) -> DataFrame:
    """``(derived, key)`` for reading back: the earliest, then smallest registered key of a cluster's addresses, else its own id."""
    order = F.when(F.col("key").isNotNull(), F.struct("first_window", "key"))  # addresses that are not registered have no say
    held = clusters.join(registry, "address", "left").groupBy("derived").agg(F.min_by("key", order).alias("key"))
    return held.select("derived", F.coalesce("key", "derived").alias("key"))


def rekey_entities(entities: DataFrame, keys: DataFrame) -> DataFrame:
    """Entities under their pinned keys; those that now share one are merged: sums, unions, extremes, any."""
    named = entities.join(keys.select(F.col("derived").alias("entity_id"), "key"), "entity_id", "left").withColumn("entity_key", F.coalesce("key", "entity_id"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    sums = ("tx_count", "tx_sent", "tx_received", "value_sent", "value_received", "value_btc")
    merged = named.groupBy("entity_key").agg(*(F.sum(c).alias(c) for c in sums), *map(union, ("addresses", "ips", "countries", "asns")), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"), F.max("burst_score").alias("burst_score"), F.bool_or("in_coinjoin").alias("in_coinjoin"))
    return merged.withColumns({"address_count": F.size("addresses"), "ip_count": F.size("ips"), "country_count": F.size("countries"), "asn_count": F.size("asns")})


def rekey_flows(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """Flows between pinned keys; what now stays within one key is no payment."""
    side = lambda c: keys.select(F.col("derived").alias(c), F.col("key").alias(f"{c}_key"))
    named = edges.join(side("src"), "src", "left").join(side("dst"), "dst", "left")
    named = named.withColumns({"src": F.coalesce("src_key", "src"), "dst": F.coalesce("dst_key", "dst")}).drop("src_key", "dst_key")
    return named.where("src <> dst")


def rekey_controls(controls: DataFrame, keys: DataFrame) -> DataFrame:
    """Controls (``entity``) under the pinned keys; every observation stays."""
    named = controls.join(keys.select(F.col("derived").alias("entity"), "key"), "entity", "left")
    return named.withColumn("entity", F.coalesce("key", "entity")).select(*controls.columns)


def rekey_mapping(mapping: DataFrame, keys: DataFrame) -> DataFrame:
    """``(address, entity_id)`` with pinned keys."""
    named = mapping.join(keys.select(F.col("derived").alias("entity_id"), "key"), "entity_id", "left")
    return named.select("address", F.coalesce("key", "entity_id").alias("entity_id"))


def with_window_labels(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows`` (scores, events) with the ``label`` of their window (``spans``: window_id, label); rows of unknown windows go."""
    return rows.join(spans.select("window_id", "label"), "window_id")


def value_counts(rows: DataFrame, *names: str) -> DataFrame:
    """``(column, value, n)`` of each named column: roles, types, states or severities."""
    cells = rows.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(n).cast("string").alias("value")) for n in names))).alias("c"))
    return cells.groupBy("c.column", "c.value").agg(F.count("*").alias("n"))


def served(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` with ``entity_key`` replaced by the key that serves it now (``aliases``: old_key, key)."""
    named = rows.join(aliases.select(F.col("old_key").alias("entity_key"), "key"), "entity_key", "left")
    return named.withColumn("entity_key", F.coalesce("key", "entity_key")).select(*rows.columns)


def with_previous(history: DataFrame, windows: DataFrame) -> DataFrame:
    """``windows`` (window_id) with ``prev``: the window before it in order, whatever its number."""
    return windows.select("window_id", F.lag("window_id").over(W.orderBy("window_id")).alias("prev"))


def severity(risk_band: Column) -> Column:
    return F.when(risk_band == "low", "info").otherwise(risk_band)


def delta_attribution(z: DataFrame, steps: DataFrame, top: int = 3) -> DataFrame:
    """``(window_id, entity_key, changes array<struct<feature, before, after, delta_z>>, biggest)``.

    ``z`` is ``(window_id, entity_key, feature, x, z)``; changes are the ``top`` features by move in robust z.
    """
    before = z.select(F.col("window_id").alias("prev"), "entity_key", "feature", F.col("x").alias("before"), F.col("z").alias("z0"))
    both = z.join(F.broadcast(steps), "window_id").join(before, ["prev", "entity_key", "feature"])
    moved = both.select("window_id", "entity_key", F.struct((-F.abs(F.col("z") - F.col("z0"))).alias("order"), "feature", "before", F.col("x").alias("after"), (F.col("z") - F.col("z0")).alias("delta_z")).alias("c")).where("abs(c.delta_z) > 1e-9")
    best = moved.groupBy("window_id", "entity_key").agg(F.slice(F.array_sort(F.collect_list("c")), 1, top).alias("c"))
    return best.select("window_id", "entity_key", F.transform("c", lambda c: F.struct(c["feature"].alias("feature"), F.round(c["before"], 6).alias("before"), F.round(c["after"], 6).alias("after"), F.round(c["delta_z"], 4).alias("delta_z"))).alias("changes"), (-F.col("c")[0]["order"]).alias("biggest"))


def growth(now: DataFrame) -> Column:
    """Whether a footprint grew: a new country, or two and a quarter more addresses or IPs; columns ``x`` and ``x0``."""
    more = lambda c: (F.col(c) - F.col(f"{c}0") >= 2) & (F.col(c) >= F.col(f"{c}0") * 1.25)
    return F.coalesce((F.col("country_count") > F.col("country_count0")) | more("address_count") | more("ip_count"), F.lit(False))


def detect_events(history: DataFrame, changes: DataFrame | None = None, floor: int = FLOOR, seen: DataFrame | None = None, present: DataFrame | None = None) -> DataFrame:
    """``(window_id, entity_key, type, severity, risk_from, risk_to)``: what changed from each window to the next.

    ``history`` is ``(window_id, entity_key, risk, address_count, country_count, ip_count)``, ``changes`` the
    output of :func:`delta_attribution`.  All windows at once: a full join of every window with its predecessor.
    ``seen`` gives ``(entity_key, first_window)`` where ``history`` does not reach back to the first, ``present`` the windows
    (window_id) where it holds some entities only.
    """
    steps = with_previous(history, history.select("window_id").distinct() if present is None else present)
    counts = ("risk", "address_count", "country_count", "ip_count")
    ahead = F.broadcast(steps.select(F.col("window_id").alias("to_window"), F.col("prev").alias("window_id")).where("window_id is not null"))
    before = history.join(ahead, "window_id").select(F.col("to_window").alias("window_id"), "entity_key", *(F.col(c).alias(f"{c}0") for c in counts))
    first = history.groupBy("entity_key").agg(F.min("window_id").alias("first_window")) if seen is None else seen
    both = history.select("window_id", "entity_key", *counts).join(before, ["window_id", "entity_key"], "full").join(first, "entity_key")
    if changes is not None:
        both = both.join(changes.select("window_id", "entity_key", "biggest"), ["window_id", "entity_key"], "left")
    else:
        both = both.withColumn("biggest", F.lit(None).cast("double"))
    order = lambda c: F.coalesce(F.when(c >= 85, 3).when(c >= 70, 2).when(c >= 50, 1), F.lit(0))
    here, prior, loud = F.col("risk").isNotNull(), F.col("risk0").isNotNull(), F.col("risk") >= floor
    way = order(F.col("risk")) - order(F.col("risk0"))
    tests = {
        "NEW_ENTITY": here & ~prior & (F.col("first_window") == F.col("window_id")) & loud,
        "RESURGENT": here & ~prior & (F.col("first_window") < F.col("window_id")) & loud,
        "ESCALATION": here & prior & (way > 0) & loud,
        "DE_ESCALATION": here & prior & (way < 0),
        "CLUSTER_GROWTH": here & prior & growth(both) & loud,
        "BEHAVIOUR_SHIFT": here & prior & (way == 0) & (F.col("biggest") >= SHIFT_Z) & loud,
        "DORMANT": ~here & (F.col("risk0") >= floor),
    }
    kinds = F.filter(F.array(*(F.when(t, F.lit(n)) for n, t in tests.items())), lambda x: x.isNotNull())
    level = severity(band(F.coalesce("risk", "risk0")))
    return both.select("window_id", "entity_key", F.explode(kinds).alias("type"), level.alias("severity"), F.col("risk0").alias("risk_from"), F.col("risk").alias("risk_to"))


def with_detail(events: DataFrame, changes: DataFrame, history: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """``events`` with ``detail``, a JSON text: bands, the features that moved, what grew, and the reason in words (``present`` as in :func:`detect_events`)."""
    steps = with_previous(history, history.select("window_id").distinct() if present is None else present)
    counts = ("address_count", "country_count", "ip_count")
    now = history.select("window_id", "entity_key", *counts)
    before = history.select(F.col("window_id").alias("prev"), "entity_key", *(F.col(c).alias(f"{c}0") for c in counts))
    grown = now.join(F.broadcast(steps), "window_id").join(before, ["prev", "entity_key"]).drop("prev")
    whole = events.join(changes.select("window_id", "entity_key", "changes"), ["window_id", "entity_key"], "left").join(grown, ["window_id", "entity_key"], "left")
    kind = F.col("type")
    moved = kind.isin("ESCALATION", "BEHAVIOUR_SHIFT", "RESURGENT")
    text = lambda c: F.concat(F.replace(c["feature"], F.lit("_"), F.lit(" ")), F.lit(" "), c["before"].cast("string"), F.lit(" -> "), c["after"].cast("string"))
    told = F.array_join(F.transform("changes", text), " and ")
    step = lambda c: F.when((F.col(c) - F.col(f"{c}0") >= 2) & (F.col(c) >= F.col(f"{c}0") * 1.25), F.struct(F.col(f"{c}0").alias("from"), F.col(c).alias("to")))
    reasons = F.when(kind == "NEW_ENTITY", "not seen in any previous window").when(kind == "RESURGENT", "absent last window, active again").when(kind == "CLUSTER_GROWTH", "footprint expanded").when(kind == "DORMANT", "was above the risk floor, silent this window")
    bands = kind.isin("ESCALATION", "DE_ESCALATION")
    grew = kind == "CLUSTER_GROWTH"
    detail = F.to_json(
        F.struct(
            F.when(kind.isin("NEW_ENTITY", "RESURGENT", "BEHAVIOUR_SHIFT"), F.col("risk_to")).alias("risk"),
            F.when(bands, band(F.col("risk_from"))).alias("band_from"),
            F.when(bands, band(F.col("risk_to"))).alias("band_to"),
            F.when(kind == "DORMANT", F.col("risk_from")).alias("last_risk"),
            F.when(kind == "BEHAVIOUR_SHIFT", F.lit(SHIFT_Z)).alias("threshold_z"),
            F.when(moved, F.col("changes")).alias("changes"),
            F.when(grew & (F.col("country_count") > F.col("country_count0")), F.col("country_count") - F.col("country_count0")).alias("new_countries"),
            F.when(grew, step("address_count")).alias("addresses"),
            F.when(grew, step("ip_count")).alias("IPs"),
            reasons.alias("reason"),
            F.when(moved, F.when(F.size("changes") > 0, told).otherwise("no single dominant feature")).alias("reason_text"),
        )
    )
    return whole.select(*events.columns, detail.alias("detail"))


def merge_events(merges: DataFrame, window_id: int) -> DataFrame:
    """CLUSTER_MERGE events of a window, for the surviving keys, in the columns of :func:`with_detail`."""
    folded = merges.groupBy("survivor").agg(F.array_sort(F.collect_list("absorbed")).alias("absorbed"))
    detail = F.to_json(F.struct("absorbed", F.lit("a transaction co-spent addresses from both clusters").alias("reason")))
    none = F.lit(None).cast("int")
    return folded.select(F.lit(window_id).alias("window_id"), F.col("survivor").alias("entity_key"), F.lit("CLUSTER_MERGE").alias("type"), F.lit("high").alias("severity"), none.alias("risk_from"), none.alias("risk_to"), detail.alias("detail"))


def raise_alerts(history: DataFrame, floor: int = FLOOR) -> DataFrame:
    """Alerts (``ALERTS``) of everything that reached the floor: first and last such window, highest and latest such risk."""
    loud = history.where(F.col("risk") >= floor)
    none = F.lit(None).cast("string")
    return loud.groupBy("entity_key").agg(F.min("window_id").alias("opened"), F.max("window_id").alias("last_window"), F.max("risk").alias("peak_risk"), F.max_by("risk", "window_id").alias("current_risk")).withColumns({"status": F.lit("new"), "assignee": none, "note": none})


def upsert_alerts(alerts: DataFrame, fresh: DataFrame) -> DataFrame:
    """Alerts after a window's ``(entity_key, window_id, risk)``: one row per entity, whose peak grows and whose risk is that of the latest window.

    An alert that was closed as false or as escalated opens again with any new detection; other statuses stay.
    """
    both = alerts.join(fresh.select("entity_key", F.col("window_id").alias("w"), F.col("risk").alias("r")), "entity_key", "full")
    later = F.coalesce(F.col("w") >= F.col("last_window"), F.col("w").isNotNull())
    again = later & F.col("r").isNotNull() & F.col("status").isin(*REOPENED)
    return both.select(
        "entity_key",
        F.least("opened", "w").alias("opened"),
        F.greatest("last_window", "w").alias("last_window"),
        F.greatest("peak_risk", "r").alias("peak_risk"),
        F.when(later, F.col("r")).otherwise(F.col("current_risk")).alias("current_risk"),
        F.when(F.col("status").isNull() | again, "new").otherwise(F.col("status")).alias("status"),
        "assignee",
        "note",
    )


def close_merged(alerts: DataFrame, merges: DataFrame, window_id: int) -> DataFrame:
    """Open alerts of absorbed keys are closed with a note; their peaks stay with them, and closed ones are left alone."""
    into = merges.groupBy(F.col("absorbed").alias("entity_key")).agg(F.min("survivor").alias("survivor"))
    ended = F.col("survivor").isNotNull() & ~F.col("status").startswith("closed")
    both = alerts.join(into, "entity_key", "left")
    note = F.concat_ws(" | ", "note", F.concat(F.lit("merged into "), "survivor"))
    return both.withColumns({"note": F.when(ended, note).otherwise(F.col("note")), "last_window": F.when(ended, F.lit(window_id)).otherwise(F.col("last_window")), "status": F.when(ended, "closed_merged").otherwise(F.col("status"))}).select(*alerts.columns)


def set_status(alerts: DataFrame, entity_key: str, status: str, assignee: str | None = None, note: str | None = None) -> DataFrame:
    """Alerts with one status changed; assignee and note stay unless given."""
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    mine = F.col("entity_key") == entity_key
    given = {n: F.when(mine, F.coalesce(F.lit(v).cast("string"), F.col(n))).otherwise(F.col(n)) for n, v in (("assignee", assignee), ("note", note)) if n in alerts.columns}
    return alerts.withColumns({"status": F.when(mine, status).otherwise(F.col("status"))} | given)


def alert_queue(alerts: DataFrame, status: str | None = None) -> DataFrame:
    """Alerts, of one status if given, by current risk, then key."""
    return (alerts if status is None else alerts.where(F.col("status") == status)).orderBy(F.desc("current_risk"), "entity_key")


def alert_cards(alerts: DataFrame, entities: DataFrame, spans: DataFrame) -> DataFrame:
    """Alerts whose entity is known, with its label (``entities``: entity_key, label) and the labels of their windows (``spans``: window_id, label)."""
    at = lambda c: spans.select(F.col("window_id").alias(c), F.col("label").alias(f"{c}_label"))
    both = alerts.join(entities.select("entity_key", "label"), "entity_key").join(at("opened"), "opened", "left").join(at("last_window"), "last_window", "left")
    return both.select("entity_key", "label", band(F.col("current_risk")).alias("severity"), F.col("current_risk").alias("score"), "peak_risk", "status", F.col("opened_label").alias("first_window"), F.col("last_window_label").alias("last_window"))


def upsert_entities(state: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(entity_key, first_window, last_window, address_count)``: first windows stay, the rest follows the newest row."""
    new = fresh.select("entity_key", *(F.col(c).alias(f"n_{c}") for c in ("first_window", "last_window", "address_count")))
    both = state.join(new, "entity_key", "full")
    return both.select("entity_key", F.least("first_window", "n_first_window").alias("first_window"), F.greatest("last_window", "n_last_window").alias("last_window"), F.coalesce("n_address_count", "address_count").alias("address_count"))


def peak_scores(history: DataFrame) -> DataFrame:
    """``(entity_key, peak_risk, peak_window, band)``: the earliest window of the highest risk; bands follow the peak."""
    best = history.groupBy("entity_key").agg(F.max_by(F.struct("risk", "window_id"), F.struct("risk", -F.col("window_id"))).alias("b"))
    return best.select("entity_key", F.col("b.risk").alias("peak_risk"), F.col("b.window_id").alias("peak_window"), band(F.col("b.risk")).alias("band"))


def risk_history(history: DataFrame) -> DataFrame:
    """``(window_id, entity_key, risks)``: the risks of an entity up to each window, never beyond it."""
    past = W.partitionBy("entity_key").orderBy("window_id").rowsBetween(W.unboundedPreceding, 0)
    return history.select("window_id", "entity_key", F.collect_list("risk").over(past).alias("risks"))


def store_summary(history: DataFrame, events: DataFrame, alerts: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row: windows, entities, events, open alerts counted by canonical key."""
    open_ = alerts.where(~F.col("status").startswith("closed"))
    if aliases is not None:
        open_ = open_.join(aliases.withColumnRenamed("old_key", "entity_key"), "entity_key", "left").withColumn("entity_key", F.coalesce("key", "entity_key"))
    parts = [history.agg(F.count_distinct("window_id").alias("windows"), F.count_distinct("entity_key").alias("entities")), events.agg(F.count("*").alias("events")), open_.agg(F.count_distinct("entity_key").alias("open_alerts"))]
    return parts[0].crossJoin(parts[1]).crossJoin(parts[2])  # one row each


def event_counts(events: DataFrame, windows: DataFrame) -> DataFrame:
    """``(window_id, type, n)``; windows without events have one row of type null and n 0."""
    n = events.groupBy("window_id", "type").agg(F.count("*").alias("n"))
    return windows.select("window_id").join(n, "window_id", "left").select("window_id", "type", F.coalesce("n", F.lit(0)).alias("n"))


def lead_dossier(entity_key: str, history: DataFrame, events: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row on one entity: its latest window, its risks, its events, its alert."""
    mine = lambda df: df.where(F.col("entity_key") == entity_key)
    past = mine(history).agg(F.max("window_id").alias("latest_window"), F.array_sort(F.collect_list(F.struct("window_id", "risk"))).alias("risks"))
    told = mine(events).agg(F.array_sort(F.collect_list(F.struct("window_id", "type"))).alias("events"))
    flag = mine(alerts).agg(F.max("peak_risk").alias("peak_risk"), F.max("status").alias("status"))
    return past.crossJoin(told).crossJoin(flag).withColumn("entity_key", F.lit(entity_key))  # one row each
