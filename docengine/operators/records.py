"""Records that come more than once, and the joins between the document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(table: DataFrame, key: str, by: str) -> DataFrame:
    """One row per key: the one with the greatest value of by; rows with a null key are left out."""
    rest = [c for c in table.columns if c != key]
    picked = table.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(by, F.xxhash64(*rest))).alias("r"))
    return picked.select(key, "r.*")


def pages_of(pages: DataFrame) -> DataFrame:
    return latest(pages, "page_id", "extracted_at")


def chunks_of(chunks: DataFrame) -> DataFrame:
    return latest(chunks, "chunk_id", "indexed_at")


def files_of(files: DataFrame) -> DataFrame:
    return latest(files, "document_id", "ingested_at")


def requests_of(requests: DataFrame) -> DataFrame:
    return latest(requests, "request_id", "logged_at")


def responses_of(responses: DataFrame) -> DataFrame:
    return latest(responses, "request_id", "responded_at")
