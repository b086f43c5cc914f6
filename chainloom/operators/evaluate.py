"""Labels, scores and how good they are; drift between two feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.operators.quantiles import column_quantiles, exact_quantiles, running_sums
from chainloom.storage import settle


def project_labels(mapping: DataFrame, truth: DataFrame) -> DataFrame:
    """``(entity_id, label, typology)`` of entities through their addresses only.

    ``truth`` is ``(address, label, typology)``.  A label needs half of the labelled addresses; the typology is the most frequent, the
    smaller name on ties.
    """
    held = mapping.join(truth, "address")
    label = held.groupBy("entity_id").agg((F.avg(F.col("label").cast("double")) >= 0.5).cast("int").alias("label"))
    kinds = held.where("typology is not null").groupBy("entity_id", "typology").agg(F.count("*").alias("n"))
    kind = kinds.groupBy("entity_id").agg(F.min_by("typology", F.struct(-F.col("n"), F.col("typology"))).alias("typology"))
    return label.join(kind, "entity_id", "left")


def adjusted_rand(pairs: DataFrame) -> DataFrame:
    """One row ``ari`` from ``(predicted, actual)``: pair counts of the contingency table, never all pairs."""
    two = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    cells = pairs.groupBy("predicted", "actual").agg(F.count("*").cast("double").alias("n"))
    rows, columns = cells.groupBy("predicted").agg(F.sum("n").alias("n")), cells.groupBy("actual").agg(F.sum("n").alias("n"))
    one = cells.agg(two("n").alias("cell"), F.sum("n").alias("total")).crossJoin(rows.agg(two("n").alias("a"))).crossJoin(columns.agg(two("n").alias("b")))  # one row each
    expected = F.col("a") * F.col("b") / (F.col("total") * (F.col("total") - 1) / 2)
    top = (F.col("a") + F.col("b")) / 2
    return one.select(F.when(top == expected, 1.0).otherwise((F.col("cell") - expected) / (top - expected)).alias("ari"))


def confusion(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row of counts and ratios from ``(y, p)``."""
    hit, real = F.col("p") >= threshold, F.col("y") == 1
    n = scored.agg(F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"), F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return n.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def auc(scored: DataFrame) -> DataFrame:
    """One row ``auc`` from ``(y, p)``: rank sums over the distinct scores, ties at their mean rank.

    Scores are first summed per value; running counts go over ranges of values, then within them, so no
    window spans the table.
    """
    bins = scored.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") != 1).alias("neg")).withColumn("part", F.floor(F.col("p") * 1024))
    parts = bins.groupBy("part").agg(F.sum("neg").alias("n"))
    starts = parts.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"))  # 1,025 rows for scores in 0..1
    below = F.coalesce(F.sum("neg").over(W.partitionBy("part").orderBy("p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    wins = bins.withColumn("inside", below).join(F.broadcast(starts), "part")
    return wins.agg((F.sum(F.col("pos") * (F.col("inside") + F.col("start") + F.col("neg") / 2)) / F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), (F.sum("pos") * F.sum("neg")).cast("double")))).alias("auc"))


def precision_at_k(scored: DataFrame, k: int, key: str) -> DataFrame:
    """One row: share of positives among the ``k`` highest scores, and the base rate; ties by key."""
    top = scored.orderBy(F.desc("p"), key).limit(k).agg(F.avg(F.col("y").cast("double")).alias("precision_at_k"))
    return top.crossJoin(scored.agg(F.avg(F.col("y").cast("double")).alias("base_rate")))


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    """``(bin, n, mean_p, rate)`` of the filled bins."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg(F.col("y").cast("double")).alias("rate"))


def calibration_error(scored: DataFrame, bins: int = 10) -> DataFrame:
    """One row: Brier score and expected calibration error."""
    brier = scored.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return brier.crossJoin(calibration(scored, bins).agg((F.sum(F.abs(F.col("mean_p") - F.col("rate")) * F.col("n")) / F.sum("n")).alias("ece")))


def decoys(scored: DataFrame, key: str, k: int = 25, kind: str = "legitimate_service") -> DataFrame:
    """One row: how many of the ``k`` highest scores are legitimate services, and how many there are."""
    top = scored.orderBy(F.desc("p"), key).limit(k).agg(F.count_if(F.col("typology") == kind).alias("decoys_in_top"), F.count("*").alias("looked_at"))
    return top.crossJoin(scored.agg(F.count_if(F.col("typology") == kind).alias("decoys")))


def time_to_detection(history: DataFrame, labels: DataFrame, floor: int = 50) -> DataFrame:
    """One row from ``(entity_id, window_id, risk)`` and ``(entity_id, label)``: entities caught, windows until then."""
    bad = labels.where("label = 1").select("entity_id")
    seen = history.join(bad, "entity_id").groupBy("entity_id").agg(F.min("window_id").alias("first"), F.min(F.when(F.col("risk") >= floor, F.col("window_id"))).alias("caught"))
    gap = F.col("caught") - F.col("first")
    seen = settle(seen.withColumn("gap", gap), "seen")
    middle = F.broadcast(column_quantiles(seen, "gap", [0.5]).toDF("median_windows"))  # one row
    return seen.agg(F.count("*").alias("illicit"), F.count("caught").alias("detected"), F.avg("gap").alias("mean_windows")).crossJoin(middle)


def fit_reference(cells: DataFrame, bins: int = 10, most: int = 500) -> DataFrame:
    """``(feature, edges, shares, median, sample)`` from ``(key, feature, x)``: decile edges, bin shares, a hash-ordered sample."""
    cuts = exact_quantiles(cells, [*(i / bins for i in range(1, bins)), 0.5])
    edges = cuts.select("feature", F.array_sort(F.array_distinct(F.array(*cuts.columns[1:bins]))).alias("edges"), F.col(cuts.columns[-1]).alias("median"))
    counts = binned(cells, edges).groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("shares"))
    order = W.partitionBy("feature").orderBy(F.xxhash64(F.col(cells.columns[0])), cells.columns[0])
    sample = cells.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).groupBy("feature").agg(F.array_sort(F.collect_list("x")).alias("sample"))
    return edges.join(counts, "feature").join(sample, "feature")


def binned(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """``(feature, bin, n, share)``: bin i holds x with i edges at or below it; a row per feature in ``edges``."""
    at = F.size(F.filter("edges", lambda e: e <= F.col("x")))
    n = cells.join(F.broadcast(edges.select("feature", "edges")), "feature").groupBy("feature", at.alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("feature")))


def psi(cells: DataFrame, now: DataFrame, edges: DataFrame, floor: float = 1e-6) -> DataFrame:
    """``(feature, psi)``: population stability between two sets of cells over the same edges."""
    a, b = binned(cells, edges).select("feature", "bin", F.col("share").alias("a")), binned(now, edges).select("feature", "bin", F.col("share").alias("b"))
    both = a.join(b, ["feature", "bin"], "full").select("feature", F.greatest(F.coalesce("a", F.lit(0.0)), F.lit(floor)).alias("a"), F.greatest(F.coalesce("b", F.lit(0.0)), F.lit(floor)).alias("b"))
    return both.groupBy("feature").agg(F.sum((F.col("b") - F.col("a")) * F.log(F.col("b") / F.col("a"))).alias("psi"))


def ks_statistic(cells: DataFrame, now: DataFrame) -> DataFrame:
    """``(feature, ks, n, m, p_value)``: largest gap of the two distribution functions, asymptotic p-value.

    A feature that only one side has gives null.  Equal values are summed first, running sums are two-level.
    """
    both = cells.select("feature", "x", F.lit(1).alias("i"), F.lit(0).alias("j")).unionByName(now.select("feature", "x", F.lit(0).alias("i"), F.lit(1).alias("j")))
    steps = running_sums(settle(both.groupBy("feature", "x").agg(F.sum("i").alias("i"), F.sum("j").alias("j")), "steps"), "feature", "x", ["i", "j"])
    sizes = steps.groupBy("feature").agg(F.sum("i").alias("n"), F.sum("j").alias("m"))
    gap = F.abs(F.try_divide("upto_i", "n") - F.try_divide("upto_j", "m"))
    found = steps.join(F.broadcast(sizes), "feature").groupBy("feature", "n", "m").agg(F.max(gap).alias("ks")).select("feature", "ks", "n", "m")  # a row per feature
    return found.withColumn("p_value", kolmogorov(F.col("ks"), F.col("n"), F.col("m")))


def kolmogorov(gap: Column, n: Column, m: Column) -> Column:
    """The limiting tail probability 2 * sum (-1)^(k-1) exp(-2 k^2 z^2)."""
    z2 = gap * gap * n * m / (n + m)
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * z2))
    return F.when(z2 < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def drift(cells: DataFrame, now: DataFrame) -> DataFrame:
    """``(feature, psi, ks, p_value, drifted)``: both the size and the significance of a shift count."""
    edges = fit_reference(cells)
    both = psi(cells, now, edges).join(ks_statistic(cells, now), "feature")
    return both.select("feature", "psi", "ks", "p_value", ((F.col("psi") > 0.1) & (F.col("p_value") < 0.01)).alias("drifted"))


def verdict(report: DataFrame) -> DataFrame:
    """One row: features, drifted ones, and what that means."""
    n = report.agg(F.count("*").alias("features"), F.count_if("drifted").alias("drifted"))
    share = F.col("drifted") / F.col("features")
    return n.select("features", "drifted", F.when(F.col("drifted") == 0, "stable").when(share < 0.25, "some drift").otherwise("drifted").alias("verdict"))
