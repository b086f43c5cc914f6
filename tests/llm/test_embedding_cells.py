import numpy as np
import pytest
from pyspark.sql import functions as F

from chainloom.llm import embeddings


def packed(spark, vectors, kind="float"):
    points = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(vectors)], f"point long, weight long, embedding array<{kind}>")
    return embeddings.settle(embeddings._pack_blocks(points, embeddings._centres(points, embeddings.CENTRES)), "blocks")


@pytest.mark.parametrize("divisions", [16, 0])  # the second deals every large cell by hash
def test_large_cells_are_divided_until_they_fit(spark, monkeypatch, divisions):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    monkeypatch.setattr(embeddings, "CENTRES", 3)
    monkeypatch.setattr(embeddings, "PICKED", 6)
    monkeypatch.setattr(embeddings, "DEALT", 16)
    monkeypatch.setattr(embeddings, "DIVISIONS", divisions)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 6))
    vectors = np.repeat(base, 12, axis=0) + 0.02 * rng.normal(size=(144, 6))
    vectors = np.concatenate([vectors, np.outer(np.arange(1, 81), base[0])])  # one direction, which nothing parts
    blocks = packed(spark, vectors, "double")
    tile = {}
    for r in blocks.select("tile", "ids", "n").collect():
        ids = np.frombuffer(r.ids, np.int64).tolist()
        assert len(ids) == r.n <= 8 and not set(ids) & set(tile)
        tile |= dict.fromkeys(ids, r.tile)
    assert sorted(tile) == list(range(len(vectors)))
    met = {(r.low, r.high) for r in embeddings._tile_pairs(blocks.select("tile", "dim", "centre", "radius"), 0.9).collect()}
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for i, j in zip(*np.nonzero(unit @ unit.T >= 0.9), strict=True):
        assert (min(tile[i], tile[j]), max(tile[i], tile[j])) in met


def test_tile_pairs_grow_with_the_vectors_where_these_form_clusters(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)
    monkeypatch.setattr(embeddings, "CENTRES", 16)
    visits = []
    for clusters in (64, 256):  # several to a cell of the first level in both
        rng = np.random.default_rng(2)
        vectors = np.repeat(rng.normal(size=(clusters, 32)), 40, axis=0) + 0.05 * rng.normal(size=(clusters * 40, 32))
        blocks = packed(spark, vectors)
        pairs = embeddings._tile_pairs(blocks.select("tile", "dim", "centre", "radius"), 0.9)
        sides = pairs.select("low", "high", F.explode(F.array_distinct(F.array("low", "high"))).alias("tile"))
        visits.append(blocks.join(sides, "tile").count())
    assert visits[1] <= 8 * visits[0]  # four times the vectors; every tile with every tile would be sixteen times


def test_far_clumps_of_a_cell_are_blocks_of_their_own():
    rng = np.random.default_rng(6)
    unit = embeddings._unit(np.repeat(np.eye(5), 7, axis=0) + 0.01 * rng.normal(size=(35, 5)))
    assert embeddings._clumps(unit).reshape(5, 7).std(axis=1).max() == 0 and len(set(embeddings._clumps(unit))) == 5
    assert set(embeddings._clumps(embeddings._unit(rng.normal(size=(300, 40))))) == {0}
