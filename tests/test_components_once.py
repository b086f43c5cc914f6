from pyspark.sql import functions as F

from chainloom.operators.components import connected_components


def test_the_edges_are_made_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = [(1, 2), (2, 3), (7, 7), (9, 8), (8, 9), (None, 4), (5, None)]
    edges = spark.createDataFrame(rows, "a long, b long").repartition(2).mapInArrow(count, "a long, b long")
    found = connected_components(edges, "a", "b").orderBy("node").select("node", F.col("component"))
    assert [tuple(r) for r in found.collect()] == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 8), (9, 8)]
    assert seen.value == len(rows)
