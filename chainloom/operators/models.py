"""Risk model, explanations, anomaly model, baselines, cross-validation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chainloom.operators import evaluate, forest
from chainloom.operators.features import FEATURES
from chainloom.operators.forest import Forest
from chainloom.storage import settle, shared_dir

#: The features that hand-written detectors make; the ablation leaves them out.
RULE_FEATURES = ("change_ratio", "peel_score", "output_uniformity", "mixer_score", "mixer_interaction", "collector_score", "exchange_score", "round_amount_ratio", "mean_payment_btc")


def dealt(table: DataFrame) -> DataFrame:
    """``table`` over all cores, by the values of its rows: a short table with much work a row would else stay in the few tasks that its bytes fill.

    Rows are ordered within a partition, because a forest draws its bags by position.
    """
    return table.repartition(table.sparkSession.sparkContext.defaultParallelism, *table.columns).sortWithinPartitions(*table.columns)


def balanced(table: DataFrame) -> DataFrame:
    """``table``, settled and dealt to all cores, with ``weight``: n / (2 * rows of its class); one class alone is refused."""
    table = settle(table, "training")
    sizes = table.groupBy("label").agg(F.count("*").alias("c"))
    if sizes.count() < 2:
        raise ValueError("a risk model needs rows of both classes")
    total = sizes.agg(F.sum("c").alias("t"))
    return dealt(table.join(F.broadcast(sizes.crossJoin(total).select("label", (F.col("t") / (2 * F.col("c"))).alias("weight"))), "label"))  # two rows


def clamp_stage(baseline: DataFrame, names: tuple[str, ...]) -> SQLTransformer:
    """A pipeline stage that holds every feature within the bounds of the training data (a row per feature)."""
    bounds = {r.feature: (r.lower, r.upper) for r in baseline.select("feature", "lower", "upper").collect()}
    terms = ", ".join(f"greatest({bounds[n][0]!r}D, least({bounds[n][1]!r}D, {n})) AS c_{n}" for n in names)
    return SQLTransformer(statement=f"SELECT *, {terms} FROM __THIS__")


def fit_risk(table: DataFrame, baseline: DataFrame, names: tuple[str, ...] = FEATURES, trees: int = 300, depth: int = 12, least: int = 2, seed: int = 42) -> Forest | PipelineModel:
    """Random forest on clamped features with balanced weights; ``table`` is features and ``label``.

    A tree is grown in one task (:mod:`chainloom.operators.forest`); Spark's own forest, which sends the counts of every node of every tree from
    every partition, takes over only where the binned table would be too large for a task.
    """
    table = settle(table.select("label", *names), "training")
    sizes = {r["label"]: r["count"] for r in table.groupBy("label").count().collect()}  # two rows
    if len(sizes) < 2:
        raise ValueError("a risk model needs rows of both classes")
    if sum(sizes.values()) * (len(names) + 1) <= forest.MOST_BYTES:
        bounds = {r.feature: (r.lower, r.upper) for r in baseline.select("feature", "lower", "upper").collect()}  # a row per feature
        return forest.fit(table, bounds, names, trees, depth, least, seed)
    stages = [clamp_stage(baseline, names), VectorAssembler(inputCols=[f"c_{n}" for n in names], outputCol="vector")]
    stages.append(RandomForestClassifier(featuresCol="vector", labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, seed=seed))
    return Pipeline(stages=stages).fit(balanced(table))


def fit_logistic(table: DataFrame, baseline: DataFrame, names: tuple[str, ...] = FEATURES) -> PipelineModel:
    """The balanced logistic baseline on scaled, clamped features."""
    stages = [clamp_stage(baseline, names), VectorAssembler(inputCols=[f"c_{n}" for n in names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="vector", withMean=True)]
    stages.append(LogisticRegression(featuresCol="vector", labelCol="label", weightCol="weight", maxIter=100, regParam=0.01))
    return Pipeline(stages=stages).fit(balanced(table))


def probability(model: Forest | PipelineModel, table: DataFrame) -> DataFrame:
    """``table`` with ``p``, the probability of class 1."""
    if isinstance(model, Forest):
        return model.probability(table)
    return model.transform(table).withColumn("p", vector_to_array("probability")[1]).select(*table.columns, "p")


def risk_score(p: Column) -> Column:
    return F.rint(100 * p).cast("int")


def importances(model: Forest | PipelineModel, names: tuple[str, ...] = FEATURES) -> list[tuple[str, float]]:
    """Features by importance."""
    found = model.importances if isinstance(model, Forest) else model.stages[-1].featureImportances.toArray()
    return sorted(zip(names, found.tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def attributions(model: Forest | PipelineModel, z: DataFrame, names: tuple[str, ...] = FEATURES, top: int = 6) -> DataFrame:
    """``(entity_id, attributions)``: importance times robust z, the largest first; ``z`` is (entity_id, feature, x, z)."""
    weights = F.broadcast(z.sparkSession.createDataFrame(importances(model, names), "feature string, importance double"))
    parts = z.join(weights, "feature").select("entity_id", F.struct((-F.abs(F.col("importance") * F.col("z"))).alias("o"), "feature", (F.col("importance") * F.col("z")).alias("contribution")).alias("a"))
    return parts.groupBy("entity_id").agg(F.transform(F.slice(F.array_sort(F.collect_list("a")), 1, top), lambda a: F.struct(a["feature"].alias("feature"), a["contribution"].alias("contribution"))).alias("attributions"))


def save(model: Forest | PipelineModel, path: str) -> None:
    if isinstance(model, Forest):
        model.save(SparkSession.active(), path)
    else:
        model.write().overwrite().save(path)


def load(path: str) -> Forest | PipelineModel:
    spark = SparkSession.active()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/trees")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return Forest.load(spark, path)
    return PipelineModel.load(path)


def forest_nodes(spark: SparkSession, model: PipelineModel) -> pd.DataFrame:
    """The forest's node table (bounded by trees and depth), from its saved form in the shared folder."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/forest-{model.uid}"
    model.stages[-1].write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    return nodes.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.impurityStats").alias("stats"), F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"), F.col("nodeData.split.featureIndex").alias("feature"), F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("cut")).toPandas()


def explain(model: Forest | PipelineModel, table: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``(entity_id, base, prediction, residual, contributions)``: each step of a decision path credits its feature.

    Base plus contributions is the forest's probability on the clamped features; the residual says how exactly.
    """
    rows, trees = dealt(table.select("entity_id", *names)), []
    if isinstance(model, Forest):
        clamped = rows.select("entity_id", F.array(*model.clamped()).alias("x"))
        trees = [(left, left + 1, feature, cut, p) for left, feature, cut, p in model.trees]
    else:
        clamped = model.stages[0].transform(rows).select("entity_id", F.array(*(F.col(f"c_{n}") for n in names)).alias("x"))
        for _, t in forest_nodes(table.sparkSession, model).groupby("treeID"):
            t = t.sort_values("id")
            stats = np.vstack(t["stats"].to_numpy())
            trees.append((t["left"].to_numpy(), t["right"].to_numpy(), t["feature"].to_numpy(), t["cut"].fillna(0).to_numpy(float), stats[:, 1] / stats.sum(axis=1)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.vstack(batch["x"].to_numpy())
            base, given, rows = 0.0, np.zeros(x.shape), np.arange(len(x))
            for left, right, feature, cut, p in trees:
                at, base = np.zeros(len(x), np.int64), base + p[0]
                while (going := left[at] >= 0).any():
                    now, r = at[going], rows[going]
                    f = feature[now]
                    at[going] = np.where(x[r, f] <= cut[now], left[now], right[now])
                    given[r, f] += p[at[going]] - p[now]  # a row is at one node of a tree
            base, given = base / len(trees), given / len(trees)
            yield pd.DataFrame({"entity_id": batch["entity_id"].to_numpy(), "base": base, "total": base + given.sum(axis=1), "parts": list(given)})

    found = clamped.mapInPandas(walk, "entity_id string, base double, total double, parts array<double>")
    scored = probability(model, table).select("entity_id", "p")
    named = F.transform(F.arrays_zip(F.array(*map(F.lit, names)).alias("n"), F.col("parts").alias("c")), lambda z: F.struct((-F.abs(z["c"])).alias("o"), z["n"].alias("feature"), z["c"].alias("contribution")))
    return found.join(scored, "entity_id").select("entity_id", "base", F.col("p").alias("prediction"), (F.col("p") - F.col("total")).alias("residual"), F.transform(F.array_sort(named), lambda c: F.struct(c["feature"].alias("feature"), c["contribution"].alias("contribution"))).alias("contributions"))


def explanation_block(explained: DataFrame, listed: int = 8) -> DataFrame:
    """``(entity_id, base, shown, remainder, prediction)``: the largest contributions and one term for the rest, which add up."""
    rest = F.aggregate(F.slice("contributions", listed + 1, 10_000), F.lit(0.0), lambda a, c: a + c["contribution"])
    return explained.select("entity_id", "base", F.slice("contributions", 1, listed).alias("shown"), (rest + F.col("residual")).alias("remainder"), "prediction")


def fit_isolation(table: DataFrame, names: tuple[str, ...] = FEATURES, trees: int = 200, sample: int = 256, seed: int = 42) -> DataFrame:
    """``(tree, nodes)``: isolation trees, each grown in a task of its own on its own ``sample`` rows by hash."""
    rows = settle(table.select("entity_id", F.array(*(F.col(n) for n in names)).alias("x")), "rows")
    # each row offers itself to few trees: as many as make twice the sample expected; the others are struck out before rows repeat
    share = min(1.0, 2.0 * sample / max(1, rows.count()))
    draw = lambda t: F.pmod(F.xxhash64(F.lit(seed), t, "entity_id"), F.lit(1 << 30))
    drawn = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < share * (1 << 30))
    offers = rows.withColumn("tree", F.explode(drawn)).withColumn("h", draw(F.col("tree")))
    chosen = offers.withColumn("r", F.row_number().over(W.partitionBy("tree").orderBy("h", "entity_id"))).where(F.col("r") <= sample)

    def grow(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        rng, x, nodes = np.random.default_rng([seed, int(key[0])]), np.vstack(part.sort_values("entity_id")["x"].to_numpy()), []
        limit = int(np.ceil(np.log2(max(2, len(x)))))

        def split(rows: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, -1, -1, len(rows), depth])
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_ = np.flatnonzero(high > low)
            if depth < limit and len(rows) > 1 and len(open_):
                f = int(rng.choice(open_))
                cut = float(rng.uniform(low[f], high[f]))
                side = x[rows, f] <= cut
                if side.all():  # the cut was rounded up to the largest value
                    return me
                nodes[me][:2] = [f, cut]
                nodes[me][2] = split(rows[side], depth + 1)
                nodes[me][3] = split(rows[~side], depth + 1)
            return me

        split(np.arange(len(x)), 0)
        return pd.DataFrame({"tree": [int(key[0])], "rows": [len(x)], "nodes": [[[float(v) for v in n] for n in nodes]]})

    return chosen.groupBy("tree").applyInPandas(grow, "tree int, rows int, nodes array<array<double>>")


def anomaly_scores(forest: DataFrame, table: DataFrame, names: tuple[str, ...] = FEATURES, contamination: float = 0.06) -> DataFrame:
    """``(entity_id, raw, score, anomalous)``: raw grows as rows are isolated sooner; score is its percentile rank.

    The forest (trees times sample rows at most) travels with the task.
    """
    grown = [(np.array(r.nodes), r.rows) for r in forest.orderBy("tree").collect()]

    def path(n: np.ndarray) -> np.ndarray:
        return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x, depth, scale = np.vstack(batch["x"].to_numpy()), np.zeros(len(batch)), 0.0
            for nodes, n in grown:
                at = np.zeros(len(x), np.int64)
                while (going := nodes[at, 0] >= 0).any():
                    now = at[going]
                    at[going] = np.where(x[going, nodes[now, 0].astype(int)] <= nodes[now, 1], nodes[now, 2], nodes[now, 3]).astype(np.int64)
                depth += nodes[at, 5] + path(nodes[at, 4])
                scale += float(path(np.array([n]))[0])
            yield pd.DataFrame({"entity_id": batch["entity_id"].to_numpy(), "raw": 2.0 ** (-depth / max(scale, 1e-9))})

    raw = settle(table.select("entity_id", F.array(*(F.col(n) for n in names)).alias("x")).mapInPandas(score, "entity_id string, raw double"), "raw")
    part = F.floor(F.col("raw") * 4096)
    sizes = raw.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    starts = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("n").over(W.partitionBy()).alias("total"))  # 4,097 rows at most
    place = F.row_number().over(W.partitionBy("part").orderBy("raw", "entity_id")) - 1
    ranked = raw.withColumn("part", part).withColumn("inside", place).join(F.broadcast(starts), "part")
    rank = F.when(F.col("total") > 1, (F.col("start") + F.col("inside")) / (F.col("total") - 1)).otherwise(0.0)
    return ranked.select("entity_id", "raw", rank.alias("score"), (rank > 1 - contamination).alias("anomalous"))


def stratified_split(table: DataFrame, test: float = 0.25, key: str = "entity_id", seed: int = 42) -> DataFrame:
    """``table`` (with ``label``) and ``held_out``: the given share of each class to a row, in the order of a hash of ``key``.

    Ranks are two-level: sums of hash ranges, then rows within a range, so no class is numbered in one task.
    """
    h = F.xxhash64(F.lit(seed), key)
    placed = table.withColumns({"__h": h, "__part": F.pmod(F.shiftright(h, 40), F.lit(1 << 12))})
    sizes = placed.groupBy("label", "__part").agg(F.count("*").alias("__n"))
    before, every = W.partitionBy("label").orderBy("__part").rowsBetween(W.unboundedPreceding, -1), W.partitionBy("label")
    starts = sizes.select("label", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(every).alias("__all"))  # 4,096 rows a class
    place = F.row_number().over(W.partitionBy("label", "__part").orderBy("__h", key))
    ranked = placed.withColumn("__place", place).join(starts, ["label", "__part"])
    return ranked.select(*table.columns, (F.col("__start") + F.col("__place") <= F.floor(F.col("__all") * test + 0.5)).alias("held_out"))


def with_folds(table: DataFrame, group: str, folds: int = 4) -> DataFrame:
    """``table`` with ``fold``: whole groups, by the hash of the group."""
    return table.withColumn("fold", F.pmod(F.xxhash64(group), F.lit(folds)).cast("int"))


def cross_validate(table: DataFrame, fit, folds: int = 4, threshold: float = 0.5) -> DataFrame:
    """``(fold, auc, precision, recall, f1)`` of each fold that holds both classes, trained on the others.

    ``table`` has features, ``label``, ``fold``; ``fit`` turns a training table into a model.  A loop over
    folds on the driver; every fit and score is a Spark job.
    """
    out, table = None, settle(table, "folds")
    for k in range(folds):
        train, test = table.where(F.col("fold") != k), table.where(F.col("fold") == k)
        if train.select("label").distinct().count() < 2 or test.isEmpty():
            continue
        scored = settle(probability(fit(train), test).select(F.col("label").alias("y"), "p"), "fold")
        row = evaluate.auc(scored).crossJoin(evaluate.confusion(scored, threshold)).select(F.lit(k).alias("fold"), "auc", "precision", "recall", "f1")
        out = row if out is None else out.unionByName(row)
    if out is None:
        raise ValueError("no fold leaves both classes for training")
    return out


def fold_summary(report: DataFrame) -> DataFrame:
    """One row of means and population deviations over the folds."""
    return report.agg(*(f(c).alias(f"{c}_{n}") for c in ("auc", "precision", "recall", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def fit_calibrator(scored: DataFrame):
    """Isotonic regression of ``y`` on ``p``."""
    return IsotonicRegression(featuresCol="p", labelCol="y").fit(scored.select(F.col("y").cast("double").alias("y"), "p"))
