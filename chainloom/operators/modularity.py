"""Communities by modularity: merging and contraction, then moves of single nodes, all with exact gains.

Joining two communities changes only their own terms of the modularity, so joins (and moves) that touch different communities add
up.  In a round of merging every community names the neighbour it gains most with.  One whose choice is
smaller than itself is a root; roots take those smaller communities that chose them, in the order of gain, each
with its gain beside what the root has taken before it, as long as that gain is positive.  The best pair of
all always joins, a hub takes all its leaves in one round, and the contracted graph is the next round's input.  A move takes place
if both communities that it touches have no better one.  So modularity rises with every round and nothing
has to be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators.graph import number_communities
from chainloom.operators.quantiles import running_sums
from chainloom.storage import release, settle

#: Gains below this share of the whole count as none.
LEAST = 1e-12


def _bigger(a: str, b: str) -> Column:
    """Whether community ``a`` is larger than ``b``, by degree, then by its later place in a shuffled order."""
    order = lambda c: F.struct(F.col(f"degree_{c}"), F.xxhash64(c), F.col(c))
    return order(a) > order(b)


def _merge_round(edges: DataFrame, degrees: DataFrame, twice: float) -> DataFrame:
    """``(node, into)``: which communities join which; ``edges`` is (a, b, value) between different ones, a < b."""
    side = lambda c: degrees.select(F.col("node").alias(c), F.col("degree").alias(f"degree_{c}"))
    gain = 2 * F.col("value") / twice - 2 * F.col("degree_a") * F.col("degree_b") / twice**2
    useful = edges.join(side("a"), "a").join(side("b"), "b").withColumn("gain", gain).where(F.col("gain") > LEAST)
    there = useful.select("a", "b", "degree_a", "degree_b", "gain", "value")
    both = there.unionByName(there.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("degree_b").alias("degree_a"), F.col("degree_a").alias("degree_b"), "gain", "value"))
    choice = F.max_by(F.struct("b", "degree_a", "degree_b", "gain", "value"), F.struct(F.col("gain"), F.col("degree_b"), F.xxhash64("b"), F.col("b")))
    chosen = settle(both.groupBy("a").agg(choice.alias("c")).select("a", "c.*"), "chosen")
    roots = chosen.where(_bigger("a", "b")).select(F.col("a").alias("b"))
    offers = chosen.where(_bigger("b", "a")).join(roots, "b").select(F.col("b").alias("into"), F.col("a").alias("node"), "degree_a", "degree_b", "value", F.struct(-F.col("gain"), F.xxhash64("a"), F.col("a")).alias("turn"))
    placed = running_sums(offers, "into", "turn", ["degree_a"])
    beside = F.col("degree_b") + F.col("upto_degree_a") - F.col("degree_a")
    return placed.where(2 * F.col("value") / twice - 2 * F.col("degree_a") * beside / twice**2 > LEAST).select("node", "into")


def _contracted(links: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of communities: ``(a, b, value)`` between different ones, and ``(node, degree)`` of all."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}"))
    named = links.join(at("a"), "a").join(at("b"), "b").groupBy("label_a", "label_b").agg(F.sum("value").alias("value"))
    named = settle(named, "named")
    degrees = named.select(F.explode(F.array("label_a", "label_b")).alias("node"), "value").groupBy("node").agg(F.sum("value").alias("degree"))
    edges = named.where("label_a <> label_b").groupBy(F.least("label_a", "label_b").alias("a"), F.greatest("label_a", "label_b").alias("b")).agg(F.sum("value").alias("value"))
    return edges, degrees


def _moved(both: DataFrame, degrees: DataFrame, labels: DataFrame, twice: float, rounds: int) -> tuple[DataFrame, bool]:
    """``labels`` after moves of single nodes to neighbouring communities, and whether any took place."""
    any_ = False
    for _ in range(rounds):
        now = degrees.join(labels, "node")
        sums = now.groupBy("label").agg(F.sum("degree").alias("total"))
        votes = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node", "label").agg(F.sum("value").alias("w"))
        mine = now.join(sums, "label").select("node", "degree", F.col("label").alias("home"), F.col("total").alias("home_total"))
        away = votes.join(sums, "label").join(mine, "node")
        stay = F.coalesce(F.max(F.when(F.col("label") == F.col("home"), F.col("w"))), F.lit(0.0)) - F.first("degree") * (F.first("home_total") - F.first("degree")) / twice
        pull = F.when(F.col("label") != F.col("home"), F.col("w") - F.col("degree") * F.col("total") / twice)
        best = away.groupBy("node", "home").agg(stay.alias("stay"), F.max_by("label", F.struct(pull, F.xxhash64("label"), F.col("label"))).alias("to"), F.max(pull).alias("pull"))
        wants = settle(best.where((F.col("pull") - F.col("stay")) * 2 / twice > LEAST).select("node", "home", "to", (F.col("pull") - F.col("stay")).alias("gain")), "wants")
        rank = F.max(F.struct("gain", F.xxhash64("node").alias("h"), "node")).alias("top")
        tops = wants.select("gain", "node", F.explode(F.array("home", "to")).alias("label")).groupBy("label").agg(rank).select("label", F.col("top.node").alias("node"))
        free = wants.join(tops.withColumnRenamed("label", "home"), ["home", "node"], "left_semi").join(tops.withColumnRenamed("label", "to"), ["to", "node"], "left_semi")
        if wants.isEmpty():
            break
        any_ = True
        before = labels
        labels = settle(labels.join(free.select("node", "to"), "node", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        release(before)
        release(wants)
    return labels, any_


def modularity_communities(links: DataFrame, rounds: int = 20, passes: int = 3, polish: int = 3) -> DataFrame:
    """``(node, community)`` by modularity; ``links`` is (a, b, value), a pair once, values above zero.

    Communities are numbered by size, then by smallest member.  ``polish`` rounds of single moves follow every round of merging,
    up to ``rounds`` the last of a pass; ``passes`` bounds how often merging begins anew.  With more of any of them modularity
    can only rise.  Self-links are left out.
    """
    links = settle(links.where("a <> b and value > 0").select("a", "b", F.col("value").cast("double").alias("value")), "links")
    both = settle(links.select(F.col("a").alias("node"), F.col("b").alias("other"), "value").unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"), "value")), "both")
    degrees = settle(both.groupBy("node").agg(F.sum("value").alias("degree")), "degrees")
    twice = degrees.agg(F.sum("degree")).first()[0]
    labels = settle(degrees.select("node", F.col("node").alias("label")), "labels")
    if twice:
        for _ in range(passes):
            while not (joins := settle(_merge_round(*_contracted(links, labels), twice), "joins")).isEmpty():
                into, before = joins.select(F.col("node").alias("label"), "into"), labels
                labels = settle(labels.join(into, "label", "left").select("node", F.coalesce("into", "label").alias("label")), "labels")
                release(before)
                release(joins)
                labels, _ = _moved(both, degrees, labels, twice, polish)
            labels, moved = _moved(both, degrees, labels, twice, rounds)
            if not moved:
                break
    return number_communities(labels)
