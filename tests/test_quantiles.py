"""Quantiles and running sums against plain sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from chainloom.operators import evaluate, quantiles

POINTS = [0.0, 0.01, 0.5, 0.9, 0.99, 1.0]


def plain(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    low, high = math.floor(at), math.ceil(at)
    return v[low] if low == high else (high - at) * v[low] + (at - low) * v[high]


@pytest.fixture(scope="module")
def features():
    rng = random.Random(8)
    return {
        "even": [rng.random() for _ in range(3000)],
        "sizes": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(3000)],
        "ties": [float(rng.choice([0, 0, 0, 1, 5])) for _ in range(3000)],
        "close": [1.0 + i * 2.0**-52 for i in range(3000)],
        "tiny": [rng.random() * 1e-200 for _ in range(500)] + [1e9],
        "one": [7.0],
        "two": [1.0, 4.0],
    }


def test_quantiles_equal_sorting(spark, features):
    rows = [(n, x) for n, v in features.items() for x in v] + [("even", None), ("even", float("nan")), ("even", float("inf")), ("none", None)]
    cells = spark.createDataFrame(rows, "feature string, x double").repartition(5)
    got = {r[0]: r[1:] for r in quantiles.exact_quantiles(cells, POINTS, few=40, bins=32).collect()}
    assert set(got) == set(features)
    for n, v in features.items():
        assert list(got[n]) == [plain(v, p) for p in POINTS], n
    assert quantiles.exact_quantiles(cells.limit(0), POINTS).count() == 0
    assert tuple(quantiles.column_quantiles(cells.where("feature = 'none'"), "x", [0.5]).first()) == (None,)


def test_quantiles_equal_the_engine(spark, features):
    cells = spark.createDataFrame([(n, x) for n, v in features.items() for x in v], "feature string, x double")
    want = {r[0]: r[1] for r in cells.groupBy("feature").agg(F.percentile("x", F.array(*map(F.lit, POINTS)))).collect()}
    assert {r[0]: list(r[1:]) for r in quantiles.exact_quantiles(cells, POINTS).collect()} == want


def test_running_sums_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "PART_ROWS", 50)
    rng = random.Random(2)
    rows = [(k, i, rng.randrange(9)) for k, n in (("hot", 600), ("b", 3), ("c", 90)) for i in rng.sample(range(5000), n)]
    got = {(r.k, r.i): r.upto_v for r in quantiles.running_sums(spark.createDataFrame(rows, "k string, i int, v int"), "k", "i", ["v"]).collect()}
    for key in ("hot", "b", "c"):
        total = 0
        for _, i, v in sorted(r for r in rows if r[0] == key):
            total += v
            assert got[key, i] == total


def test_largest_gap(spark):
    rng = random.Random(3)
    a = {"x": [rng.gauss(0, 1) for _ in range(400)], "y": [float(rng.randrange(4)) for _ in range(300)]}
    b = {"x": [rng.gauss(0.5, 1) for _ in range(250)], "y": [float(rng.randrange(4)) for _ in range(100)], "z": [1.0]}
    table = lambda d: spark.createDataFrame([(f"k{i}", n, x) for n, v in d.items() for i, x in enumerate(v)], "key string, feature string, x double")
    got = {r.feature: r for r in evaluate.ks_statistic(table(a), table(b)).collect()}
    for n in ("x", "y"):
        share = lambda v, x: sum(y <= x for y in v) / len(v)
        assert got[n].ks == pytest.approx(max(abs(share(a[n], x) - share(b[n], x)) for x in a[n] + b[n]), abs=1e-12)
        assert (got[n].n, got[n].m) == (len(a[n]), len(b[n]))
    assert got["z"].ks is None and got["z"].n == 0
