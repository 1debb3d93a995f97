"""Reading files, chunk payloads and traces, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx

CHUNK_SCHEMA = "chunk_id string, document_id string, insurer string, document_type string, chunk_type string, section string, page_number int, table_id string, row_number int, text string, embedding_text string, content string"
TRACE_SCHEMA = "ts double, run_id string, session_id string, node string, latency_ms double, state_bytes int, error string"


def discover(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """document_id, file_path, file_size, last_modified of all files below path with the suffix in any case."""
    glob = "*.{" + f"{suffix.lower()},{suffix.upper()},{suffix.title()}" + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.sha2("content", 256).alias("document_id"), F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.unix_micros("modificationTime").alias("last_modified_us"))


def path_columns(files: DataFrame, root: str) -> DataFrame:
    """insurer and document_type from the path below root."""
    below = F.split(F.regexp_replace("file_path", "^.*?" + root.rstrip("/") + "/", ""), "/")
    kinds = F.create_map(*[F.lit(x) for pair in lx.DOC_TYPES.items() for x in pair])
    deep = F.size(below) >= 3
    return files.withColumn("insurer", F.when(deep, F.get(below, F.lit(0))).otherwise("Unknown")).withColumn("document_type", F.when(deep, F.coalesce(F.try_element_at(kinds, F.get(below, F.lit(1))), F.lit("other"))).otherwise("Unknown"))


def read_chunks(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chunks of all payload files ({chunks: [...]} or a bare list), and the files that cannot be read.

    Records without any text are left out. A file that is no JSON goes to the second result with its path.
    """
    whole = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path).withColumn("path", F.col("_metadata.file_path"))
    return parse_chunks(whole)


def parse_chunks(whole: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The chunks of payload texts (value, path), and path and reason of those that are no JSON."""
    held = whole.withColumn("as_payload", F.from_json("value", f"struct<chunks: array<struct<{_fields()}>>>")).withColumn("as_list", F.from_json("value", f"array<struct<{_fields()}>>"))
    parsed = held.withColumn("ok", F.try_parse_json("value").isNotNull()).withColumn("chunks", F.when(F.ltrim("value").startswith("["), F.col("as_list")).otherwise(F.col("as_payload.chunks")))
    chunks = parsed.filter("ok").select(F.explode("chunks").alias("c")).select("c.*").filter("coalesce(text, '') <> '' or coalesce(embedding_text, '') <> '' or coalesce(content, '') <> ''")
    return chunks, parsed.filter("not ok").select("path", F.lit("not JSON").alias("reason"))


def _fields() -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.rsplit(" ", 1) for f in CHUNK_SCHEMA.split(", ")))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk records by insurer and document type; a later run replaces only the partitions it has rows for."""
    chunks.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("insurer", "document_type").parquet(path)


def append_traces(events: DataFrame, path: str, files: int | None = None) -> None:
    """Events as JSON lines by sanitised session id (S12, L14): a folder per session, or with files so many files that share the sessions."""
    clean = F.regexp_replace(F.coalesce("session_id", F.lit("anonymous")), r"[^A-Za-z0-9_.-]", "_")
    named = events.withColumn("session", clean)
    if files:
        named.repartition(files, "session").write.mode("append").json(path)
    else:
        named.write.mode("append").partitionBy("session").json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """All events; blank and unreadable lines are skipped."""
    return spark.read.schema(TRACE_SCHEMA).option("mode", "DROPMALFORMED").json(path).filter("ts is not null")


def markdown_report(rows: DataFrame, title: str) -> str:
    """A small aggregate as a Markdown table (S16); rows must be a report, not data."""
    head = "| " + " | ".join(rows.columns) + " |\n|" + "---|" * len(rows.columns)
    body = "\n".join("| " + " | ".join(str(v) for v in r) + " |" for r in rows.orderBy(*rows.columns[:1]).toLocalIterator())
    return f"# {title}\n\n{head}\n{body}\n"
