from chainloom.operators import features, models
from chainloom.plans import learning


def test_registered_forests_have_the_operators_sizes(monkeypatch):
    asked = []
    for place, name in ((features, "fit_baseline"), (models, "with_folds"), (models, "fold_summary"), (models, "anomaly_scores"), (learning, "_table")):
        monkeypatch.setattr(place, name, lambda *_: None)
    monkeypatch.setattr(models, "cross_validate", lambda table, fit: fit(table))
    for name in ("fit_risk", "fit_isolation"):
        monkeypatch.setattr(models, name, lambda *_, **how: asked.append(how))
    c = type("Capture", (), {"features": None})
    learning._risk(c)
    for name in ("anomaly_model", "cross_validation", "ablation"):
        learning.QUERIES[name][0](c)
    assert asked == [{}] * 4


def test_short_training_tables_are_dealt_to_all_cores(spark):
    from chainloom.operators import models

    table = spark.range(200).coalesce(1).selectExpr("concat('E-', id) AS entity_id", "CAST(id AS double) AS x", "CAST(id % 2 AS double) AS label")
    rows = models.balanced(table)
    assert rows.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r.entity_id for r in rows.collect()) == sorted(f"E-{i}" for i in range(200)) and {r.weight for r in rows.collect()} == {1.0}
