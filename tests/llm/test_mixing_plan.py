from chainloom.llm import mixing


def test_targets_are_planned_once(spark):
    sizes = spark.createDataFrame([(i, f"s{i % 3}", 30 + i) for i in range(60)], "doc_id long, source string, size long")
    taken, _ = mixing.mix(sizes)
    plan = taken._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at(" not in plan  # the weights by rank are in the settled targets
    assert sum(r.words for r in taken.collect()) == round(1.5 * sum(r["size"] for r in sizes.collect()))
