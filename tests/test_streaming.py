from pyspark.sql import functions as F

from sparkloom.operators.extract import definitions
from sparkloom.streaming import incremental as s


def test_index_follows_files(spark, tmp_path):
    src, out, check = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "check")
    src.mkdir()
    (src / "a.rs").write_text("fn one() {}\nfn two() {}\n")
    for more in (None, ("b.rs", "struct S;\n")):
        if more:
            (src / more[0]).write_text(more[1])
        s.index_stream(s.source_stream(spark, str(src)), out, check).awaitTermination()
    got = {(r.path.rsplit("/", 1)[1], r.line, r.kind, r.name) for r in s.read_index(spark, out).collect()}
    batch = spark.createDataFrame([(p.name, p.read_text()) for p in src.iterdir()], "path string, content string")
    assert got == {(r.path, r.line, r.kind, r.name) for r in definitions(batch).collect()} and len(got) == 3


def test_change_rate_batch_equals_stream(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    cast = lambda d: d.withColumn("ts", F.col("ts").cast("timestamp"))
    for i, (mode, build) in enumerate((("complete", lambda d: s.change_rate(d, "1 day")), ("complete", lambda d: s.change_rate(d, "2 days", "1 day")), ("append", lambda d: s.sessions(d, "6 hours")))):
        build(cast(stream)).writeStream.outputMode(mode).format("memory").queryName(f"rate{i}").trigger(availableNow=True).start().awaitTermination()
        want, got = {tuple(r) for r in build(cast(batch)).collect()}, {tuple(r) for r in spark.table(f"rate{i}").collect()}
        # only sessions that the watermark has closed are appended
        assert got and (got == want if mode == "complete" else got <= want)


def test_evidence_feedback(spark, tmp_path):
    folder = str(tmp_path / "scans")
    for i, rows in enumerate(([("a", 0.5), ("b", 0.9)], [("a", 0.7)], [("a", 0.6), ("c", 0.1)])):
        spark.createDataFrame(rows, "id string, confidence double").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema("id string, confidence double").parquet(folder)
    q = s.evidence_feedback(stream).writeStream.outputMode("update").format("memory").queryName("feedback").trigger(availableNow=True).start()
    q.awaitTermination()
    last = {r.id: r for r in spark.table("feedback").orderBy("times").collect()}
    assert {k: (r.confidence, r.times) for k, r in last.items()} == {"a": (0.7, 3), "b": (0.9, 1), "c": (0.1, 1)}
