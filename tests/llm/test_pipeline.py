import corpus_pipeline

from sparkloom.llm import decontam, packing


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
            kept = {r.doc_id for r in out.select("doc_id").collect()}
            assert kept <= ids and len(kept) > 0.7 * len(ids), name
            ids = kept
            docs = spark.createDataFrame(out.collect(), docs.schema)
    assert decontam.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
    whole = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()), key=repr)
    assert whole == sorted(map(tuple, packing.pack(docs).collect()), key=repr)


def test_empty(spark, sf, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
