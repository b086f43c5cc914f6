"""Settled tables that were replaced leave the shared folder."""

from pathlib import Path

from chainloom.operators import graph, modularity
from chainloom.storage import release, settle, shared_dir


def test_released_tables_are_gone_and_others_stay(spark, tmp_path):
    one, two = settle(spark.range(5), "one"), settle(spark.range(7), "two")
    at = [Path(f.removeprefix("file:")).parent for f in (one.inputFiles()[0].replace("///", "/"), two.inputFiles()[0].replace("///", "/"))]
    release(one)
    release(None)
    assert not at[0].exists() and at[1].exists() and two.count() == 7
    spark.range(3).write.parquet(str(tmp_path / "input"))
    release(spark.read.parquet(str(tmp_path / "input")))  # nothing that settle() wrote
    assert (tmp_path / "input").exists()


def test_rounds_leave_a_bounded_number_of_tables(spark):
    links = spark.createDataFrame([(f"n{i:02d}", f"n{j:02d}", 1.0 + (i // 6 == j // 6) * 8) for i in range(18) for j in range(i + 1, 18) if (i + j) % 3 or i // 6 == j // 6], "a string, b string, value double")
    own = Path(shared_dir(spark).removeprefix("file:").replace("///", "/")) / spark.sparkContext.applicationId
    for find in (graph.communities, modularity.modularity_communities):
        before = len([p for p in own.iterdir() if p.name.startswith("labels-")])
        labels = {r.node: r.community for r in find(links).collect()}
        assert all(len({labels[f"n{i:02d}"] for i in range(6 * b, 6 * b + 6)}) == 1 for b in range(3))
        assert len([p for p in own.iterdir() if p.name.startswith("labels-")]) <= before + 1
