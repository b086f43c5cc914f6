"""Sliding counts over buckets, and counts from merged sketches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import corpus, correlate


def test_bursts_equal_sliding_over_everything(spark):
    rng = random.Random(7)
    start = datetime.datetime(1969, 12, 31, 20)
    seconds = {"hot": [rng.randrange(40_000) for _ in range(3000)] + [3600 * 5 + i for i in range(200)], "edge": [0, 3600, 3600, 7200, 7201], "one": [5], "same": [9] * 4}
    rows = [(e, start + datetime.timedelta(seconds=s, microseconds=s % 3)) for e, v in seconds.items() for s in v] + [("none", None)]
    got = {r.entity_id: r.burst_score for r in correlate.burst_score(spark.createDataFrame(rows, "entity_id string, timestamp timestamp")).collect()}
    assert set(got) == set(seconds)
    for e, v in seconds.items():
        at = sorted(s * 1_000_000 + s % 3 for s in v)
        assert got[e] == pytest.approx(max(sum(t <= x <= t + 3_600_000_000 for x in at) for t in set(at)) / len(at))


def test_merged_sketches_count_the_union(spark):
    rows = [(w, f"t{(w * 400 + i) % 1500}", f"ip{i % 90}", [f"a{i}", f"a{i + w}"], [f"b{i % 7}"]) for w in range(1, 6) for i in range(700)]
    obs = spark.createDataFrame(rows, "window_id int, txid string, src_ip string, input_addresses array<string>, output_addresses array<string>")
    sketches = corpus.window_sketches(obs)
    found = {r.item: r.estimate for r in corpus.merged_counts(sketches).collect()}
    want = {"rows": len(rows), "transactions": len({r[1] for r in rows}), "addresses": len({a for r in rows for a in r[3] + r[4]}), "ips": 90}
    assert found["rows"] == want["rows"] and all(abs(found[k] - v) <= 0.033 * v for k, v in want.items())
    some = {r.item: r.estimate for r in corpus.merged_counts(sketches.where(F.col("window_id").isin(1, 3))).collect()}
    assert some["rows"] == 1400 and abs(some["transactions"] - len({r[1] for r in rows if r[0] in (1, 3)})) <= 0.033 * 1400
    assert {r.estimate for r in corpus.merged_counts(sketches.limit(0)).collect()} == {0}
