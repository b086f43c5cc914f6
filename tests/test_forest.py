import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.operators import evaluate, forest, models
from chainloom.operators.features import fit_baseline

NAMES = ("u", "v", "w")


@pytest.fixture(scope="module")
def table(spark):
    part = lambda k: F.pmod(F.xxhash64(F.lit(k), "id"), F.lit(1009)) / 1009.0
    rows = spark.range(3000).select(F.concat(F.lit("E-"), "id").alias("entity_id"), *(part(k).alias(n) for k, n in enumerate(NAMES)))
    return rows.withColumn("label", ((F.col("u") + F.col("v") > 1.3) != (F.pmod(F.xxhash64("entity_id"), F.lit(10)) == 0)).cast("double")).localCheckpoint()


def test_a_fit_takes_no_pass_over_the_rows_for_each_level_of_its_trees(spark, table):
    def jobs(depth):
        spark.sparkContext.setJobGroup(f"fit-{depth}", "")
        models.fit_risk(table, base, NAMES, trees=4, depth=depth)
        found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"fit-{depth}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found

    base = fit_baseline(table, NAMES)
    assert jobs(9) == jobs(2)


def test_the_forest_is_as_good_as_sparks_own(spark, table, monkeypatch):
    base, train, test = fit_baseline(table, NAMES), table.where("pmod(xxhash64(entity_id, 7), 4) <> 0"), table.where("pmod(xxhash64(entity_id, 7), 4) = 0")
    quality = lambda m: evaluate.auc(models.probability(m, test).select(F.col("label").alias("y"), "p")).first()[0]
    mine = models.fit_risk(train, base, NAMES, trees=40, depth=5)
    monkeypatch.setattr(forest, "MOST_BYTES", 0)  # as for a table that no task can hold
    theirs = models.fit_risk(train, base, NAMES, trees=40, depth=5)
    assert not isinstance(theirs, forest.Forest) and abs(quality(mine) - quality(theirs)) < 0.02 and quality(mine) > 0.8
    assert all(abs(dict(models.importances(mine, NAMES))[n] - x) < 0.05 for n, x in models.importances(theirs, NAMES))


def test_trees_do_not_depend_on_how_the_rows_lie_and_survive_saving(table, tmp_path):
    base = fit_baseline(table, NAMES)
    one, two = (models.fit_risk(t, base, NAMES, trees=3, depth=4) for t in (table.coalesce(1), table.repartition(7)))
    models.save(two, str(tmp_path / "m"))
    for other in (two, models.load(str(tmp_path / "m"))):
        assert all(np.array_equal(a, b) for x, y in zip(one.trees, other.trees, strict=True) for a, b in zip(x, y, strict=True))
    p = [models.probability(m, table).orderBy("entity_id").collect() for m in (one, models.load(str(tmp_path / "m")))]
    assert p[0] == p[1] and len({r.p for r in p[0]}) > 5


def test_a_tree_parts_two_classes_and_keeps_to_the_least_rows():
    x = np.repeat(np.arange(4, dtype=np.uint8), 50)[:, None]
    y = (x[:, 0] >= 2).astype(np.uint8)
    left, feature, at, p, gains = forest._grow(x, y, np.random.default_rng(1), 12, 2)
    assert left == [1, -1, -1] and at[0] == 1 and p[1:] == [0.0, 1.0] and gains.tolist() == [1.0]
    assert forest._grow(x, y, np.random.default_rng(1), 12, 300)[0] == [-1]
