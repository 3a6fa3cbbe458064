"""Streams against the same computation in one batch."""

from pyspark.sql import functions as F

from tesserae.operators import chunking, store
from tesserae.streaming import ingest

SF = "/root/testdata/sf0.001"


def run(df, name, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return df.sparkSession.table(name)


def test_index_stream(spark, tmp_path):
    rows = [(d, 1, k, "text", f"document {d} element {k} with text enough to be a chunk", [0.0, 20.0 * k, 100.0, 20.0 * k + 20], 0.9, "") for d in range(4) for k in range(2)]
    schema = "doc_id int, page_number int, elem_no int, type string, text string, bbox array<double>, confidence double, image_path string"
    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame(rows, schema).write.parquet(source)
    ingest.index_stream(ingest.read(spark, source, schema), table, str(tmp_path / "check"), 4).awaitTermination(120)
    again = [(0, 1, 0, "text", "document 0 anew with quite another text that is long enough", [0.0, 0.0, 100.0, 20.0], 0.9, "")]
    spark.createDataFrame(again, schema).write.mode("append").parquet(source)
    ingest.index_stream(ingest.read(spark, source, schema), table, str(tmp_path / "check"), 4).awaitTermination(120)
    got = {(r.doc_id, r.chunk_id, r.text) for r in store.load(spark, table).collect()}
    want = chunking.chunk(spark.createDataFrame([r for r in rows if r[0]] + again, schema))
    assert got == {(r.doc_id, r.chunk_id, r.text) for r in want.collect()}


def test_windows_and_repeats(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    source = str(tmp_path / "events")
    events.union(events.limit(50)).write.parquet(source)
    stream = ingest.read(spark, source, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema.fields))
    got = run(ingest.windowed(stream, "10 minutes", "1 hour"), "windows", "complete").agg(F.sum("n").alias("n")).first().n
    assert got == events.count() + 50
    assert run(ingest.distinct_events(stream, "365 days"), "distinct_rows", "append").count() == events.count()


def test_threads(spark, tmp_path):
    messages = spark.read.parquet(f"{SF}/conversations.parquet")
    source = str(tmp_path / "messages")
    messages.write.parquet(source)
    stream = ingest.read(spark, source, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.turns, r.last_question) for r in run(ingest.threads(stream), "threads", "update").collect()}
    last = messages.filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("q"))
    want = messages.groupBy("conv_id").count().join(last, "conv_id", "left")
    assert got == {r.conv_id: (r["count"], r.q or "") for r in want.collect()}
