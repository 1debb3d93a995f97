import json

from pyspark.sql import functions as F

from docengine.sources import documents
from docengine.streaming import ingest


def test_chunk_payloads(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"chunks": [{"chunk_id": "1", "text": "x"}, {"chunk_id": "2"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"chunk_id": "3", "content": "y"}]))
    (tmp_path / "c.json").write_text("{broken")
    chunks, bad = documents.read_chunks(spark, str(tmp_path))
    assert sorted(r.chunk_id for r in chunks.collect()) == ["1", "3"]
    assert [r.path.endswith("c.json") for r in bad.collect()] == [True]


def test_files_and_sinks(spark, tmp_path):
    deep = tmp_path / "in" / "Acme" / "CIS"
    deep.mkdir(parents=True)
    (deep / "f.PDF").write_bytes(b"abc")
    (deep / "g.txt").write_bytes(b"abc")
    found = documents.path_columns(documents.discover(spark, str(tmp_path / "in")), str(tmp_path / "in")).collect()
    assert [(r.insurer, r.document_type, r.file_size) for r in found] == [("Acme", "cis", 3)]
    rows = spark.createDataFrame([("1", "Acme", "cis"), ("2", "Best", "cis")], "chunk_id string, insurer string, document_type string")
    out = str(tmp_path / "out")
    documents.write_chunks(rows, out)
    documents.write_chunks(rows.filter("insurer = 'Best'").withColumn("chunk_id", F.lit("9")), out)
    assert sorted(r.chunk_id for r in spark.read.parquet(out).collect()) == ["1", "9"]
    events = spark.createDataFrame([(1.0, "r", "a/b", "n")], "ts double, run_id string, session_id string, node string")
    documents.append_traces(events, str(tmp_path / "t"))
    documents.append_traces(events, str(tmp_path / "t"))
    assert documents.read_traces(spark, str(tmp_path / "t")).count() == 2
    assert "| Acme |" in documents.markdown_report(rows.groupBy("insurer").count(), "R")


def test_stream_upsert_is_idempotent(spark, tmp_path):
    src, target = str(tmp_path / "src"), str(tmp_path / "target")
    rows = spark.createDataFrame([("1", "a"), ("1", "a"), ("2", "b")], "chunk_id string, embedding_text string")
    rows.write.parquet(src)
    read = spark.readStream.schema(rows.schema).parquet(src)
    for n in range(2):  # a second run with a new checkpoint sees the same rows again
        ingest.stream_upsert(read, target, str(tmp_path / f"cp{n}")).awaitTermination(120)
    assert sorted(r.chunk_id for r in spark.read.parquet(target).collect()) == ["1", "2"]
    assert ingest.distinct_arrivals(spark.readStream.schema("chunk_id string, indexed_at timestamp").parquet(src)).isStreaming
    assert ingest.session_counts(spark.readStream.schema("user_id int, ts timestamp").parquet(src)).isStreaming
