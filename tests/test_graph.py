import random
from itertools import combinations

import pytest

from chainloom.operators import graph
from chainloom.operators.components import connected_components


def frame(spark, rows):
    return spark.createDataFrame([(a, b, float(v)) for a, b, v in rows], "src string, dst string, value double")


def test_components_match_union_find(spark):
    random.seed(4)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(900, 900)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}


def test_long_shuffled_path_is_one_component(spark):
    nodes = list(range(2000))
    random.Random(1).shuffle(nodes)
    found = connected_components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long"), "a", "b")
    assert found.count() == 2000 and found.select("component").distinct().collect()[0][0] == 0


@pytest.fixture(scope="module")
def cliques():
    left, right = ["a0", "a1", "a2", "a3"], ["b0", "b1", "b2", "b3"]
    return [(x, y, 5) for side in (left, right) for x, y in combinations(side, 2)] + [("a0", "b0", 1)]


def test_communities_of_two_cliques(spark, cliques):
    links = graph.undirected(frame(spark, cliques))
    labels = graph.communities(links)
    groups = {}
    for r in labels.collect():
        groups.setdefault(r.community, set()).add(r.node[0])
    assert sorted(map(sorted, groups.values())) == [["a"], ["b"]]
    assert graph.modularity(links, labels).first()[0] > 0.4


def test_betweenness_matches_brute_force(spark, cliques):
    near = {}
    for a, b, _ in cliques:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    nodes = sorted(near)

    def paths(s):
        dist, count, order = {s: 0}, {s: 1}, [s]
        for u in order:
            for v in sorted(near[u]):
                if v not in dist:
                    dist[v], count[v] = dist[u] + 1, 0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    count[v] += count[u]
        return dist, count

    info = {s: paths(s) for s in nodes}
    n = len(nodes)
    expect = {}
    for v in nodes:
        total = 0.0
        for s in nodes:
            for t in nodes:
                if len({s, t, v}) == 3 and info[s][0][v] + info[v][0][t] == info[s][0][t]:
                    total += info[s][1][v] * info[v][1][t] / info[s][1][t]
        expect[v] = total / ((n - 1) * (n - 2))
    got = {r.node: r.betweenness for r in graph.betweenness(graph.undirected(frame(spark, cliques))).collect()}
    assert got == pytest.approx(expect)


def test_pagerank_matches_power_iteration(spark):
    rows = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "d", 1)]
    nodes, rank = "abcd", dict.fromkeys("abcd", 0.25)
    out = {s: sum(v for x, _, v in rows if x == s) for s in nodes}
    for _ in range(60):
        lost = sum(rank[x] for x in nodes if not out[x])
        rank = {x: 0.15 / 4 + 0.85 * (sum(rank[s] * v / out[s] for s, t, v in rows if t == x) + lost / 4) for x in nodes}
    got = {r.node: r.pagerank for r in graph.pagerank(frame(spark, rows), rounds=60, tolerance=1e-9).collect()}
    assert got == pytest.approx(rank, abs=1e-6)


def test_trace_stops_or_passes_at_sinks(spark):
    edges = spark.createDataFrame([("s", "x", 6.0), ("s", "y", 4.0), ("x", "m", 1.0), ("y", "m", 1.0), ("m", "e", 1.0), ("x", "s", 1.0)], "src string, dst string, value double")
    seeds = spark.createDataFrame([("s",), ("none",)], "entity_id string")
    sinks = spark.createDataFrame([("m", "mixer"), ("e", "exchange"), ("s", "exchange")], "entity_id string, kind string")
    got = {r.entity: (r.kind, r.amount, r.hops, r.path) for r in graph.trace_funds(edges, seeds, sinks).collect()}
    assert got == {"m": ("mixer", 7.0, 2, ["s", "y", "m"]), "e": ("exchange", 7.0, 3, ["s", "y", "m", "e"])}
    stopped = graph.trace_funds(edges, seeds, sinks, expand_sinks=False)
    assert {r.entity for r in stopped.collect()} == {"m"}


def test_whole_jobs_are_registered(spark, cliques):
    from types import SimpleNamespace

    from chainloom.plans import graphs

    rows = [("a", "b", 2), ("b", "c", 1), ("c", "a", 1), ("a", "d", 1)]
    rank, out = dict.fromkeys("abcd", 0.25), {"a": 3, "b": 1, "c": 1}
    for _ in range(200):
        rank = {x: 0.15 / 4 + 0.85 * (sum(rank[s] * v / out[s] for s, t, v in rows if t == x) + rank["d"] / 4) for x in "abcd"}
    got = {r.node: r.pagerank for r in graphs.QUERIES["pagerank_full"][0](SimpleNamespace(pairs=frame(spark, rows))).collect()}
    assert got == pytest.approx(rank, abs=1e-5)

    metrics = spark.createDataFrame([(f"e{i}", float(i == 3), i // 2) for i in range(4)], "entity_id string, betweenness double, community int")
    entities = spark.createDataFrame([(f"e{i}", 2, 2, 1.0, 1.0) for i in range(4)], "entity_id string, fan_in long, fan_out long, value_sent double, value_received double")
    structural = spark.createDataFrame([("none", 0.0, 0.0)], "entity_id string, mixer_score double, exchange_score double")
    pairs = frame(spark, [("e0", "e1", 5), ("e2", "e3", 5)])
    c = SimpleNamespace(metrics=metrics, entities=entities, structural=structural, pairs=pairs)
    assert {r.entity_id: r.role for r in graphs.QUERIES["roles_full"][0](c).collect()} == {"e0": "wallet", "e1": "wallet", "e2": "wallet", "e3": "relay"}
    assert graphs.QUERIES["modularity_full"][0](c).first()[0] == pytest.approx(0.5)


def test_neighbours_do_not_swap_labels_for_ever(spark):
    links = frame(spark, [(f"p{i}", f"q{i}", 1) for i in range(8)])
    groups = {}
    for r in graph.communities(graph.undirected(links)).collect():
        groups.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, groups.values())) == [[f"p{i}", f"q{i}"] for i in range(8)]


def test_betweenness_of_a_long_path(spark):
    n = 70
    got = {r.node: r.betweenness for r in graph.betweenness(graph.undirected(frame(spark, [(f"{i:03}", f"{i + 1:03}", 1) for i in range(n - 1)]))).collect()}
    assert got == pytest.approx({f"{i:03}": 2 * i * (n - 1 - i) / ((n - 1) * (n - 2)) for i in range(n)})


def test_a_block_of_betweenness_leads_to_few_nodes(spark):
    n, blocks = 1200, 8
    links = [(f"{i * 7919 % n:04}", f"{(i + d) % n * 7919 % n:04}") for i in range(n) for d in range(1, 7)] + [("0000", f"{i:04}") for i in range(1, n, 9)]
    named = spark.createDataFrame([p for a, b in set(links) if a != b for p in ((a, b), (b, a))], "node string, other string").distinct()
    places = {r.node: r.number for r in graph._numbered(named.select("node").distinct(), graph._cells(named, 4 * blocks), blocks).collect()}
    assert len(places) == len(set(places.values())) == n
    met = {(places[a] >> graph._BLOCK_BITS, b) for x, y in links if x != y for a, b in ((x, y), (y, x))}
    assert len(met) < 3 * n  # blocks by a hash of the node lead to nearly all nodes each: some 6.5 n by calculation
