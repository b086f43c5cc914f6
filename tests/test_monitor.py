"""Windows one after the other, as a batch and as a stream, against all of them at once."""

import json
import random
from functools import partialmethod

import pytest
from pyspark.sql import functions as F

from chainloom.operators import monitor, resolve, windows
from chainloom.sources.commits import Attempt, Commit, CommitLog
from chainloom.streaming.replay import late_rows, monitor_stream

SCHEMA = "obs_id long, ts string, src_ip string, input_addresses array<string>, output_addresses array<string>, input_amounts array<double>, output_amounts array<double>, geo_country string"


def rows():
    """``a`` is loud, silent on day 2 and back; ``b`` and ``c`` grow; on day 3 a transaction joins the two."""
    out = []

    def add(day, inputs, ip, country, n):
        for i in range(n):
            out.append((len(out), f"2024-01-0{day} 00:{i:02d}:00", ip, inputs, ["z"], [1.0] * len(inputs), [1.0], country))

    add(1, ["a"], "1.1.1.1", "DE", 9)
    add(3, ["a"], "1.1.1.1", "DE", 9)
    add(1, ["b"], "2.1.1.1", "NL", 2)
    add(2, ["b"], "2.1.1.1", "NL", 10)
    add(2, ["b"], "2.1.1.2", "US", 3)
    add(1, ["c"], "3.1.1.1", "FR", 8)
    add(2, ["c"], "3.1.1.1", "FR", 8)
    add(3, ["b", "c"], "3.1.1.1", "FR", 9)
    add(4, ["c"], "3.1.1.1", "FR", 9)
    return out


@pytest.fixture(scope="module")
def obs(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("timestamp", F.to_timestamp("ts")).drop("ts").withColumn("txid", F.concat(F.lit("t"), "obs_id")).withColumn("asn", F.lit("AS1"))
    return monitor.span_windows(resolve.coinjoin_like(df), 1)


def plain(df):
    return sorted(map(str, df.collect()))


def test_replay_equals_all_windows_at_once(spark, obs, tmp_path):
    members = resolve.entity_map(obs).select("address", F.col("entity_id").alias("derived"))
    state = monitor.Monitor(spark, str(tmp_path / "m"))
    table = monitor.replay(state, obs, members=members)
    mapping = members.withColumnRenamed("derived", "entity_id")
    parts = [monitor.score(monitor.describe(obs.where(F.col("window_id") == w), mapping)).withColumnRenamed("entity_id", "entity_key").withColumn("window_id", F.lit(w)) for w in (1, 2, 3, 4)]
    history = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    changes = windows.delta_attribution(monitor.relative_moves(history), windows.with_previous(history, history.select("window_id").distinct()))
    want = windows.detect_events(history, changes)
    assert plain(state.events().select(*want.columns)) == plain(want)
    kinds = {r.type for r in want.collect()}
    assert {"NEW_ENTITY", "DORMANT", "RESURGENT"} <= kinds
    peaks = windows.raise_alerts(history)
    assert plain(state.alerts.read().select("entity_key", "opened", "last_window", "peak_risk", "current_risk")) == plain(peaks.select("entity_key", "opened", "last_window", "peak_risk", "current_risk"))
    assert plain(state.features_at_peak().select("entity_key", "window_id", "risk")) == plain(windows.peak_scores(history).select("entity_key", F.col("peak_window").alias("window_id"), F.col("peak_risk").alias("risk")))
    assert table.count() == 4 and table.agg(F.sum("transactions")).first()[0] == obs.count()
    for r in state.events().collect():
        detail = json.loads(r.detail)
        assert "reason" in detail or "reason_text" in detail or "band_from" in detail


@pytest.fixture(scope="module")
def clean(spark, obs, tmp_path_factory):
    """The state after one run over all windows."""
    state = monitor.Monitor(spark, str(tmp_path_factory.mktemp("clean")))
    monitor.replay(state, obs)
    return state


def whole(state):
    return [plain(t) for t in (state.scores(), state.events(), state.alerts.read(), state.registry.read(), state.entities.read(), state.aliases.read(), state.windows.read())]


def test_pinned_keys_merge_and_their_alerts_close(clean):
    registry = {r.address: r.key for r in clean.registry.read().collect()}
    assert registry["b"] == registry["c"] != registry["a"]
    (merge,) = clean.events().where("type = 'CLUSTER_MERGE'").collect()
    assert (merge.window_id, merge.entity_key, merge.severity) == (3, registry["b"], "high")
    (gone,) = json.loads(merge.detail)["absorbed"]
    closed = {r.entity_key: r for r in clean.alerts.read().collect()}[gone]
    assert closed.status == "closed_merged" and closed.note == f"merged into {registry['b']}" and closed.last_window == 3
    assert clean.summary().first().open_alerts == len({registry["a"], registry["b"]})


def test_no_window_that_comes_again_changes_anything(clean, obs):
    before = whole(clean)
    for w in (1, 3, 4):
        mine = obs.where(F.col("window_id") == w).drop("window_id")
        row = plain(clean.process_window(mine, w))
        assert plain(clean.process_window(mine, w, again=True)) == row  # worked out once more
    assert whole(clean) == before
    with pytest.raises(ValueError, match="comes after"):
        clean.process_window(obs.where("window_id = 2").drop("window_id").limit(3), 2)
    with pytest.raises(ValueError, match="is window"):
        clean._window_id(1, "x", [Commit(1, 4, 0, label="x")])
    assert clean._window_id(None, "x", [Commit(1, 4, 0, label="x")]) == 4 and clean._window_id(None, "y", clean.log.commits()) == 5
    assert whole(clean) == before


WRITES = ("registry", "keys", "scores", "entities", "events", "alerts", "windows", "commit")


def test_a_window_that_dies_at_any_write_leaves_no_trace(spark, obs, clean, tmp_path, monkeypatch):
    state = monitor.Monitor(spark, str(tmp_path / "m"))
    take = lambda w: state.process_window(obs.where(F.col("window_id") == w).drop("window_id"), w)
    take(1)
    take(2)
    held = state.log.commits()
    for point in WRITES:
        with monkeypatch.context() as patch:

            def die(self, name="commit", rows=None, real=None, point=point):
                if name == point:
                    raise OSError("lost")
                return real(self, name, rows) if rows is not None else real(self)

            for method in ("put", "add", "commit"):
                patch.setattr(Attempt, method, partialmethod(die, real=getattr(Attempt, method)))
            with pytest.raises(OSError, match="lost"):
                take(3)
        assert state.log.commits() == held
    take(3)
    take(4)
    assert whole(state) == whole(clean)


def test_other_rows_for_the_last_window_replace_it(spark, obs, tmp_path):
    one, two = (monitor.Monitor(spark, str(tmp_path / n)) for n in ("one", "two"))
    first, second = (obs.where(F.col("window_id") == w).drop("window_id") for w in (1, 3))
    for state in (one, two):
        state.process_window(first, label="day one")
    key = two.registry.read().where("address = 'a'").first().key
    two.process_window(second.where("input_addresses[0] <> 'a'"), label="day three")
    two.judge(key, "investigating", "kim")
    for state in (one, two):
        state.process_window(second, label="day three")
    assert [(c.window, c.step) for c in two.log.commits()] == [(1, 0), (2, 0)]  # what was said went into the second
    one.judge(key, "investigating", "kim")
    assert whole(one) == whole(two)
    assert two.alerts.read().where("assignee = 'kim'").count() == 1 and two.alerts.read(1).where("assignee = 'kim'").count() == 0
    two.process_window(first.limit(4), label="day one", drop_later=True)
    assert [c.window for c in two.log.commits()] == [1] and two.windows.read().count() == 1


def test_deltas_follow_the_window(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path), {"t": ("k", "k long, x int")}, {}, buckets=2, fan_in=3)
    want, written = {}, []
    real = CommitLog._write

    def counted(self, rows, folder, key):
        written.append(rows.count())
        real(self, rows, folder, key)

    CommitLog._write = counted
    try:
        for w in range(1, 15):
            rows = [(k, w) for k in range(w * 3, w * 3 + 9)]
            want.update(dict(rows))
            step = log.begin(w, 0)
            step.put("t", spark.createDataFrame(rows, "k long, x int"))
            last = step.commit()
    finally:
        CommitLog._write = real
    assert {r.k: r.x for r in log.read("t", last).collect()} == want
    assert {r.k: r.x for r in log.lookup("t", last, spark.createDataFrame([(5,), (30,), (99,)], "k long")).collect()} == {k: want[k] for k in (5, 30)}
    assert len(last.tables["t"]) <= 2 * 3 and sum(written) < 14 * 9 * 3  # not 14 * 15 / 2 * 9
    early = log.commits()[4]
    assert {r.x for r in log.read("t", early).collect()} == {1, 2, 3, 4, 5}


def test_identity_from_the_keys_that_a_window_meets(spark, tmp_path):
    """Random histories against a registry that is kept whole."""
    rng = random.Random(6)
    state, registry, roots = monitor.Monitor(spark, str(tmp_path)), {}, {}
    for w in range(1, 6):
        parts = [[f"a{x}" for x in rng.sample(range(14), rng.choice([1, 2, 3]))] for _ in range(4)]
        clusters = []
        for p in parts:
            p = set(p)
            for c in [c for c in clusters if c & p]:
                clusters.remove(c)
                p |= c
            clusters.append(p)
        members = spark.createDataFrame([(a, f"w{w}{min(c)}") for c in clusters for a in sorted(c)], "address string, derived string")
        step = state.log.begin(w, 0)
        held = state.log.lookup("registry", step.base, members.select("address")).select("address", "key")
        met = held.select("key").unionByName(members.select(F.col("derived").alias("key"))).distinct()
        keys, merges, moved = windows.resolve_incremental(members, held, state._roots(met, step.base), w)
        mapping = members.join(keys, "derived").select("address", F.col("key"), F.lit(w).alias("first_window"))
        step.put("registry", mapping.join(held, "address", "left_anti"))
        step.put("keys", moved)
        step.commit()

        groups = [({registry[a] for a in c if a in registry}, c) for c in clusters]  # clusters that share a key are one
        while True:
            joined = next(((g, h) for i, g in enumerate(groups) for h in groups[:i] if g[0] & h[0]), None)
            if not joined:
                break
            groups = [g for g in groups if g not in joined] + [(joined[0][0] | joined[1][0], joined[0][1] | joined[1][1])]
        for olds, c in groups:
            best = min(olds, key=lambda k: (roots[k], k)) if olds else None
            for a, k in list(registry.items()):
                if k in olds:
                    registry[a] = best
            for a in c:
                registry[a] = best or f"w{w}{min(c)}"
            if not olds:
                roots[f"w{w}{min(c)}"] = w
        assert {r.address: r.key for r in state.registry.read().collect()} == registry


def test_stream_equals_batch(spark, obs, clean, tmp_path):
    """Files that split and mix windows; a window is taken once the watermark has passed it, and what comes later is kept apart."""
    two = monitor.Monitor(spark, str(tmp_path / "stream"))
    raw = obs.drop("is_coinjoin")
    late = raw.where("window_id = 1").limit(1).withColumn("obs_id", F.lit(999).cast("long"))
    for i, part in enumerate([raw.where("window_id = 1 and obs_id % 2 = 0"), raw.where("window_id = 2 or (window_id = 1 and obs_id % 2 = 1)"), raw.where("window_id = 3 and obs_id % 3 = 0"), late.unionByName(raw.where("(window_id = 3 and obs_id % 3 > 0) or window_id = 4"))]):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    monitor_stream(stream, two)
    assert whole(two) == whole(clean)
    assert [r.obs_id for r in late_rows(two).collect()] == [999]


def test_reopening_follows_the_status(spark):
    alerts = spark.createDataFrame([(s, 1, 2, 90, 80, s, None, None) for s in windows.STATUSES], windows.ALERTS)
    fresh = spark.createDataFrame([(s, 3, 55) for s in windows.STATUSES] + [("unseen", 3, 60)], "entity_key string, window_id int, risk int")
    got = {r.entity_key: (r.opened, r.last_window, r.peak_risk, r.current_risk, r.status) for r in windows.upsert_alerts(alerts, fresh).collect()}
    assert got["closed_false_positive"] == (1, 3, 90, 55, "new") and got["closed_escalated"][4] == "new"
    assert got["closed_merged"][4] == "closed_merged" and got["investigating"] == (1, 3, 90, 55, "investigating") and got["unseen"] == (3, 3, 60, 60, "new")
