"""Page-level operators: repeated lines, paragraphs, captions, layout, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx
from docengine.plans.staging import small_side


def _lines(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    got = pages.filter(F.col(text).isNotNull() & F.col("document_id").isNotNull())
    return got.select("document_id", "page_id", F.posexplode(F.split(text, "\n")).alias("i", "raw")).withColumn("line", tx.strip(F.col("raw")))


def repeated_page_lines(pages: DataFrame, share: float = 0.6, min_length: int = 3) -> DataFrame:
    """document_id, line, n_pages of trimmed lines on at least max(2, share of the document's pages) pages."""
    total = pages.filter("raw_text is not null").groupBy("document_id").agg(F.count("*").alias("pages"))
    seen = _lines(pages).filter(F.length("line") >= min_length).select("document_id", "page_id", "line").distinct()
    often = seen.groupBy("document_id", "line").agg(F.count("*").alias("n_pages")).join(total, "document_id")
    return often.filter(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(share * F.col("pages")))).select("document_id", "line", "n_pages")


def strip_page_lines(pages: DataFrame, **limits) -> DataFrame:
    """page_id, text without the document's repeated lines (T11); '' where nothing is left."""
    gone = small_side(repeated_page_lines(pages, **limits).select("document_id", "line", F.lit(True).alias("gone")))
    kept = _lines(pages).join(gone, ["document_id", "line"], "left")
    rest = F.sort_array(F.collect_list(F.when(F.col("gone").isNull(), F.struct("i", "raw"))))
    return kept.groupBy("page_id").agg(F.array_join(F.transform(rest, lambda x: x["raw"]), "\n").alias("text"))


def concat_pages(pages: DataFrame) -> DataFrame:
    """document_id, pages, text: a document's pages in order, each after a banner line."""
    banner = F.concat(F.lit("===== PAGE "), F.col("page_number"), F.lit(" =====\n"), F.coalesce("cleaned_text", F.lit("")))
    got = pages.filter("document_id is not null").groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "page_id", banner.alias("t")))).alias("p"))
    return got.select("document_id", F.size("p").cast("bigint").alias("pages"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def distinct_paragraphs(pages: DataFrame) -> DataFrame:
    """page_id, paragraphs, text: each paragraph once, compared without case and blanks; the first stays."""
    got = pages.filter("cleaned_text is not null").select("page_id", F.posexplode(F.split("cleaned_text", "\n\n")).alias("i", "p")).withColumn("p", tx.strip(F.col("p"))).filter("p <> ''")
    first = got.groupBy("page_id", F.md5(F.regexp_replace(F.lower("p"), r"\s+", " ")).alias("k")).agg(F.min(F.struct("i", "p")).alias("x"))
    whole = first.groupBy("page_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return whole.select("page_id", F.size("x").cast("bigint").alias("paragraphs"), F.array_join(F.transform("x", lambda y: y["p"]), "\n\n").alias("text"))


def caption_lines(pages: DataFrame) -> DataFrame:
    """page_id, line_no, line of figure and table captions."""
    got = pages.filter("raw_text is not null").select("page_id", F.posexplode(F.split("raw_text", "\n")).alias("i", "line"))
    return got.filter(F.col("line").rlike("(?i)" + lx.CAPTION_PATTERN)).select("page_id", (F.col("i") + 1).cast("int").alias("line_no"), "line")


def ocr_stats(pages: DataFrame) -> DataFrame:
    n, ocr = F.count("*"), F.count_if("used_ocr")
    return pages.groupBy("document_id").agg(n.alias("pages"), ocr.alias("ocr_pages"), F.round(100.0 * ocr / n, 2).alias("ocr_percentage"))


def dataset_summary(files: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents, pages, pages with tables and characters per insurer."""
    page = pages.select("document_id", "page_id", F.length("raw_text").alias("raw"), F.length("cleaned_text").alias("clean"), (F.col("table_text") != "").alias("tab"))
    per = page.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if("tab").alias("tabs"), F.sum("raw").alias("raw"), F.sum("clean").alias("clean"))
    return files.join(per, "document_id", "left").groupBy("insurer").agg(
        F.count("*").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("pages"), F.coalesce(F.sum("tabs"), F.lit(0)).alias("table_pages"), F.sum("raw").alias("raw_chars"), F.sum("clean").alias("clean_chars"))


#: Frequent words by which a language is told.
LANGUAGE_WORDS = {
    "en": ("the", "of", "and", "to", "is", "for", "that", "with"), "de": ("der", "die", "das", "und", "den", "nicht", "ist", "mit"),
    "fr": ("le", "les", "des", "et", "du", "une", "pour", "pas"), "es": ("el", "los", "las", "y", "del", "una", "por", "para"),
}


def language(pages: DataFrame) -> DataFrame:
    """page_id, language by the most frequent words, 'unknown' without any."""
    words = tx.blank_tokens(F.coalesce("cleaned_text", "raw_text", F.lit("")))
    hits = lambda known: F.size(F.filter(words, lambda w: w.isin(list(known))))
    scored = pages.select("page_id", F.explode(F.array(*[F.struct(hits(v).alias("n"), F.lit(k).alias("l")) for k, v in LANGUAGE_WORDS.items()])).alias("s"))
    best = scored.groupBy("page_id").agg(F.max("s").alias("s"))
    return best.select("page_id", F.when(F.col("s.n") > 0, F.col("s.l")).otherwise("unknown").alias("language"))


def path_metadata(files: DataFrame) -> DataFrame:
    """Insurer, document type and form mode from the path."""
    parts = F.split("file_path", "/")
    known = F.create_map(*[F.lit(x) for pair in lx.DOC_TYPES.items() for x in pair])
    deep = F.size(parts) >= 3
    return files.select(
        "document_id", F.when(deep, F.get(parts, F.lit(1))).otherwise("Unknown").alias("path_insurer"),
        F.when(deep, F.coalesce(F.try_element_at(known, F.get(parts, F.lit(2))), F.lit("other"))).otherwise("Unknown").alias("path_type"),
        F.lower("file_path").rlike("claim|preauth").alias("form_mode"))


def pdf_date(text: Column) -> Column:
    """D:yyyyMMddHHmmss as a time, anything else as it is."""
    stamp = F.try_to_timestamp(F.substring(F.replace(text, F.lit("D:"), F.lit("")), 1, 14), F.lit("yyyyMMddHHmmss"))
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), text)


def two_columns(words: DataFrame, page: list[str], width: str = "page_width", min_words: int = 50, gap: float = 0.18, share: float = 0.05) -> DataFrame:
    """Per page whether words leave the centre band free: at least min_words words, under share of them in it."""
    centre = (F.col("x0") - F.col(width) / 2).between(-gap * F.col(width), gap * F.col(width))
    return words.groupBy(*page).agg(((F.count("*") >= min_words) & (F.count_if(centre) / F.count("*") < share)).alias("two_columns"))


def reading_order(words: DataFrame, page: list[str], key: str, page_width: float) -> DataFrame:
    """Words numbered by line band and left edge, with the side of the page's middle."""
    order = W.partitionBy(*page).orderBy(F.bround(F.col("y0") / 6), "x0", key)
    return words.withColumn("reading_order", F.row_number().over(order)).withColumn("side", F.when(F.col("x0") < page_width / 2, "L").otherwise("R"))


def word_lines(words: DataFrame, page: list[str], threshold: float = 6.0) -> DataFrame:
    """Words grouped into lines: a new one where y0 is more than threshold from the line's first word.

    The anchor moves only at a break, so a page's words are folded in order; a page is one row.
    """
    ordered = words.groupBy(*page).agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "word"))).alias("w"))
    start = F.struct(F.lit(-1e300).alias("anchor"), F.array().cast("array<string>").alias("lines"))
    fresh = lambda acc, x: F.struct(x["y0"].cast("double").alias("anchor"), F.concat(acc["lines"], F.array(x["word"])).alias("lines"))
    same = lambda acc, x: F.struct(acc["anchor"].alias("anchor"), F.concat(F.slice(acc["lines"], F.lit(1), F.size(acc["lines"]) - 1), F.array(F.concat(F.element_at(acc["lines"], -1), F.lit(" "), x["word"]))).alias("lines"))
    folded = F.aggregate("w", start, lambda acc, x: F.when(F.abs(x["y0"] - acc["anchor"]) > threshold, fresh(acc, x)).otherwise(same(acc, x)), lambda acc: acc["lines"])
    return ordered.select(*page, folded.alias("lines"))
