import corpus_pipeline


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, d), f"test-{name}")
        assert docs.columns == columns
        if name != "source_mixing":
            assert 0 < docs.count() <= kept
            kept = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert out.count() == docs.count() and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
