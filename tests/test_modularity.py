"""Communities by modularity against greedy merging of all pairs."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from chainloom.operators import graph, modularity

SCHEMA = "a string, b string, value double"


def quality(links, label):
    twice = 2 * sum(v for _, _, v in links)
    inside, degree = {}, {}
    for a, b, v in links:
        for x in (a, b):
            degree[label[x]] = degree.get(label[x], 0) + v
        if label[a] == label[b]:
            inside[label[a]] = inside.get(label[a], 0) + 2 * v
    return sum(inside.get(c, 0) / twice - (d / twice) ** 2 for c, d in degree.items())


def greedy(links):
    """Joins the best pair of all until none gains."""
    label = {x: x for a, b, _ in links for x in (a, b)}
    while True:
        now = quality(links, label)
        groups = sorted({(min(label[a], label[b]), max(label[a], label[b])) for a, b, _ in links if label[a] != label[b]})
        best = max(((quality(links, {n: (g if c == h else c) for n, c in label.items()}), g, h) for g, h in groups), default=None)
        if not best or best[0] <= now + 1e-12:
            return now
        label = {n: (best[1] if c == best[2] else c) for n, c in label.items()}


def weighted(rng, names, p, low=1, high=5):
    return [(a, b, float(rng.randint(low, high))) for a, b in combinations(names, 2) if rng.random() < p]


def graphs():
    rng = random.Random(12)
    names = [f"n{i:02d}" for i in range(24)]
    blocks = [n for i in range(3) for n in weighted(rng, names[8 * i : 8 * i + 8], 0.8, 4, 9)] + weighted(rng, names, 0.06)
    merged = {}
    for a, b, v in blocks:
        merged[a, b] = merged.get((a, b), 0) + v
    chain = [(names[i], names[i + 1], 1.0) for i in range(23)]
    return {"blocks": [(*k, v) for k, v in merged.items()], "random": weighted(rng, names, 0.15), "chain": chain, "star": [("hub", n, 1.0) for n in names], "equal": weighted(rng, names[:12], 0.4, 2, 2)}


@pytest.mark.parametrize("name", list(graphs()))
def test_beside_greedy_merging(spark, name):
    links = graphs()[name]
    frame = spark.createDataFrame(links, SCHEMA)
    found = modularity.modularity_communities(frame.repartition(3))
    label = {r.node: r.community for r in found.collect()}
    assert set(label) == {x for a, b, _ in links for x in (a, b)}
    got = quality(links, label)
    assert got >= greedy(links) - (1e-9 if name in ("blocks", "star") else 0.02)  # without structure either may be ahead
    assert graph.modularity(frame, found).first()[0] == pytest.approx(got, abs=1e-9)
    if name == "blocks":
        assert all(len({label[f"n{i:02d}"] for i in range(8 * b, 8 * b + 8)}) == 1 for b in range(3))
    if name == "star":
        assert len(set(label.values())) == 1
    sizes = [sum(c == k for c in label.values()) for k in range(len(set(label.values())))]
    assert sizes == sorted(sizes, reverse=True)


def test_rounds_merge_by_exact_gains(spark):
    """Each round raises the modularity by what it says."""
    links = graphs()["random"]
    frame = spark.createDataFrame(links, SCHEMA)
    twice = 2 * sum(v for _, _, v in links)
    degrees = frame.select(F.explode(F.array("a", "b")).alias("node"), "value").groupBy("node").agg(F.sum("value").alias("degree"))
    joins = {r.node: r.into for r in modularity._merge_round(frame, degrees, twice).collect()}
    assert joins and not set(joins) & set(joins.values())
    alone = {x: x for a, b, _ in links for x in (a, b)}
    assert quality(links, {n: joins.get(n, n) for n in alone}) > quality(links, alone)


def test_no_links(spark):
    assert modularity.modularity_communities(spark.createDataFrame([("a", "a", 2.0), ("b", "c", 0.0)], SCHEMA)).count() == 0
