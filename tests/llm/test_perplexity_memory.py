import tracemalloc

import numpy as np
import pyarrow as pa

from chainloom.llm import perplexity


def test_a_batch_is_scored_in_bounded_memory(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.zipf(1.2, 20_000) % 100_000)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts[:10])], "doc_id long, text string")
    reader = perplexity.fit(docs).opened()
    column = pa.array(texts)
    tracemalloc.start()
    n = perplexity.text_sums(reader, column)[0]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n.tolist() == [20_001] * 40
    assert peak < 90e6


def test_logs_in_parts_are_those_of_all_at_once(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b {i % 3} c a") for i in range(9)], "doc_id long, text string")
    reader = perplexity.fit(docs).opened()
    column = pa.array(["a b 1 c", None, "x a a b 2"])
    whole = perplexity.text_sums(reader, column)
    monkeypatch.setattr(perplexity, "LOGS", 2)
    for one, two in zip(whole, perplexity.text_sums(reader, column), strict=True):
        assert np.array_equal(one, two)
