import corpus_pipeline


def test_every_stage_takes_an_empty_table(spark, make, tmp_path):
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    empty = spark.createDataFrame([], make([(1, "x")]).schema)
    for name, stage in corpus_pipeline.STAGES:
        got = corpus_pipeline.settle(stage(spark, empty, str(tmp_path)), name)
        assert got.count() == 0 and set(empty.columns) <= set(got.columns), name


def test_empty_benchmark_drops_nothing(spark, make, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make([(1, "some words that stay"), (2, None), (None, "")])
    assert corpus_pipeline.decontaminate_benchmark(spark, docs, str(tmp_path)).count() == 3
