"""From pages to chunks: table rows, line windows, types, sections, record checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx


def table_rows(pages: DataFrame) -> DataFrame:
    """page_id, document_id, page_number, row_no, cells: non-empty rows of table_text with trimmed cells."""
    got = pages.filter("table_text is not null").select("page_id", "document_id", "page_number", F.posexplode(F.split("table_text", "\n")).alias("i", "line"))
    cells = F.transform(F.split("line", r"\|"), tx.strip)
    return got.select("page_id", "document_id", "page_number", (F.col("i") + 1).cast("int").alias("row_no"), cells.alias("cells")).filter(F.exists("cells", lambda c: c != ""))


def is_parent(cells: Column) -> Column:
    """Heading rows: short left and long right cell, or capitals, or a heading word in few words."""
    count = lambda t: F.size(F.filter(F.split(t, r"\s+"), lambda x: x != ""))
    text = F.trim(F.array_join(cells, " "))
    first, second = F.coalesce(F.get(cells, F.lit(0)), F.lit("")), F.coalesce(F.get(cells, F.lit(1)), F.lit(""))
    return (
        ((F.size(cells) >= 2) & (count(first) <= 4) & (count(second) >= 6))
        | ((text == F.upper(text)) & (text != F.lower(text)) & (count(text) <= 8))
        | (F.lower(text).rlike("|".join(lx.PARENT_KEYWORDS)) & (count(text) <= 12))
    )


def with_parent_rows(rows: DataFrame) -> DataFrame:
    """Each row with the text of the last heading row at or above it in its table."""
    above = W.partitionBy("page_id").orderBy("row_no").rowsBetween(W.unboundedPreceding, 0)
    got = rows.withColumn("text", F.array_join("cells", " | ")).withColumn("is_parent", is_parent(F.col("cells")))
    return got.withColumn("parent_row", F.last(F.when(F.col("is_parent"), F.col("text")), ignorenulls=True).over(above))


def line_windows(pages: DataFrame, window: int = 4, overlap: int = 2) -> DataFrame:
    """page_id, start, text: windows of lines of two or more characters, each `overlap` lines into the one before."""
    if not 0 <= overlap < window:
        raise ValueError("overlap must be less than the window")
    lines = F.filter(F.transform(F.split("cleaned_text", "\n"), tx.strip), lambda x: F.length(x) >= 2)
    keep = [c for c in ("page_id", "document_id", "page_number") if c in pages.columns]
    got = pages.filter("cleaned_text is not null").select(*keep, lines.alias("ls")).filter("size(ls) > 0")
    got = got.select(*keep, "ls", F.explode(F.sequence(F.lit(0), F.size("ls") - 1, F.lit(window - overlap))).alias("start"))
    return got.select("page_id", F.col("start").cast("int").alias("start"), F.array_join(F.slice("ls", F.col("start") + 1, F.lit(window)), " ").alias("text"))


def section(text: Column) -> Column:
    low, out = F.lower(text), None
    for s in lx.SECTION_HEADERS:
        hit = F.contains(low, F.lit(s))
        out = F.when(hit, s.title()) if out is None else out.when(hit, s.title())
    return out.otherwise("General")


def chunk_type(text: Column) -> Column:
    """exclusion before claim_rule before policy_clause before general_info."""
    low = F.lower(text)
    return (
        F.when(tx.contains_any(low, lx.EXCLUSION_PHRASES), "exclusion").when(tx.contains_any(low, lx.CLAIM_PHRASES), "claim_rule")
        .when(low.rlike(lx.CLAUSE_PATTERN), "policy_clause").otherwise("general_info")
    )


def typed(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("chunk_type", chunk_type(F.col("text"))).withColumn("section", section(F.col("text")))


def build_chunks(pages: DataFrame) -> DataFrame:
    """Chunk records of all documents: table rows, then line windows, with ids derived from the content's place."""
    page = pages.filter("document_id is not null")
    rows = with_parent_rows(table_rows(page))
    table_id = F.concat(F.lit("T_"), F.substring(F.sha2(F.concat_ws(":", "document_id", "page_id", F.lit("1")), 256), 1, 12))
    rows = rows.withColumn("table_id", table_id).select("document_id", "page_number", "table_id", F.concat("table_id", F.lit("_R"), "row_no").alias("piece"), "text")
    windows = line_windows(page).join(page.select("page_id", "document_id", "page_number"), "page_id")
    windows = windows.select("document_id", "page_number", F.lit(None).cast("string").alias("table_id"), F.concat(F.lit("W_"), "page_id", F.lit("_"), "start").alias("piece"), "text")
    both = typed(rows.unionByName(windows))
    return both.select(
        F.concat(F.lit("C_"), F.substring(F.sha2(F.concat_ws(":", "document_id", "piece"), 256), 1, 12)).alias("chunk_id"), "document_id", F.col("page_number").cast("int").alias("page_number"), "table_id",
        F.when(F.col("table_id").isNull(), F.col("chunk_type")).otherwise("table_row").alias("chunk_type"), "section", "text")


def violations(chunks: DataFrame) -> DataFrame:
    """chunk_id, missing: required fields that a record lacks; table records need a table_id."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    lacks = [F.when(empty(c), F.lit(c)) for c in ("text", "embedding_text", "chunk_type")] + [F.when(F.col(c).isNull(), F.lit(c)) for c in ("page_start", "page_end")]
    lacks.append(F.when(F.col("chunk_type").isin("table_row", "table_row_part", "table_meta") & empty("table_id"), F.lit("table_id")))
    return chunks.select("chunk_id", F.array_compact(F.array(*lacks)).alias("missing")).filter("size(missing) > 0")


def normalized(chunks: DataFrame) -> DataFrame:
    """The records with their text filled from the other text field and their type inferred."""
    low = F.lower(F.coalesce("text", F.lit("")))
    kind = (
        F.when((F.coalesce("table_id", F.lit("")) != "") | F.col("row_number").isNotNull(), "table_row")
        .when(tx.contains_any(low, lx.EXCLUSION_PHRASES), "exclusion").when(tx.contains_any(low, lx.INDEX_CLAUSE_WORDS), "clause").otherwise("general_info")
    )
    return chunks.withColumn("filled", F.coalesce(F.nullif("embedding_text", F.lit("")), F.nullif("text", F.lit("")))).withColumn("inferred_type", kind)


def changed_files(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """document_id, signature of files that have no chunks yet: the change signature is the id and the time of change."""
    left = files.filter("last_modified is not null").join(chunks.select("document_id"), "document_id", "left_anti")
    return left.select("document_id", F.concat_ws("_", "document_id", F.floor("last_modified").cast("bigint").cast("string")).alias("signature"))
