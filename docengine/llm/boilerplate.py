"""Lines repeated across the documents of one source (problem 5).

Lines are masked (digits, dates, names) and clustered inside their source by locality-sensitive hashing of their word shingles; a
cluster whose documents are many is removed. What makes two lines of a bucket members of one cluster is a parameter: equality of
the form, or likeness of the masked forms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.llm.near_duplicates import components
from docengine.plans.staging import ship_with_tasks, small_side, stage

ship_with_tasks(__name__)

SHINGLE = 5  # words of a shingle; shorter lines are one shingle
#: Bands of ROWS minimum hashes: forms that share a band share a bucket. A pair at likeness 0.8 is met with probability 0.995.
BANDS, ROWS = 10, 4
#: Masked forms of one bucket that are paired in one task; more are dealt to slots of this size.
BUCKET = 512


def line_form(line: Column) -> Column:
    """Lower case, each digit run one 0, each run of white space one blank, trimmed."""
    low = F.regexp_replace(F.lower(line), r"(?U)\d+", "0")
    return F.regexp_replace(F.regexp_replace(low, r"(?U)\s+", " "), r"^ | $", "")


def masked_form(line: Column) -> Column:
    """The line with dates and numbers as 0 and with capitalised names after the first word as one N."""
    named = F.regexp_replace(line, r"(?U)(?<=\S )(?:\p{Lu}\.? )*\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)*", "N")
    dated = F.regexp_replace(named, r"(?U)\d+(?:[./:,-]\d+)*", "0")
    return line_form(dated)


def document_pages(pages: DataFrame, files: DataFrame) -> DataFrame:
    """source, document_id, page_id, cleaned_text: each page_id once (its latest extraction) with the one source of its document.

    Pages without a non-empty cleaned_text and documents without a row in files are left out; a null insurer is the source ''.
    """
    own = F.xxhash64("document_id", "cleaned_text")
    text = pages.filter("cleaned_text <> '' and page_id is not null").select("page_id", "document_id", "cleaned_text", "extracted_at", own.alias("text_id"))
    last = text.groupBy("page_id").agg(F.max(F.struct("extracted_at", "text_id")).alias("n"))
    page = text.join(last, "page_id").filter("text_id = n.text_id").groupBy("page_id").agg(F.first(F.struct("document_id", "cleaned_text")).alias("p"))
    src = files.groupBy("document_id").agg(F.coalesce(F.max_by("insurer", F.struct("ingested_at", "insurer")), F.lit("")).alias("source"))
    return page.select("page_id", "p.*").join(src, "document_id").select("source", "document_id", "page_id", "cleaned_text")


def _buckets(forms: DataFrame) -> DataFrame:
    """The columns source, form_id and masked of forms with buckets: the hashes of the bands of the masked form's shingles."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(20240701)
        factor, shift = rng.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)
        for whole in batches:
            for a in range(0, len(whole), 1024):
                batch, flat, sizes = whole.iloc[a : a + 1024], [], []
                for masked in batch["masked"]:
                    words = masked.split()
                    shingles = {" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))}
                    sizes.append(len(shingles))
                    flat += [xxhash.xxh32_intdigest(s) for s in shingles]
                base, starts = np.array(flat, np.uint32), np.cumsum(sizes) - np.array(sizes)
                band = np.empty((len(batch), BANDS), np.uint64)
                for b in range(BANDS):
                    key = np.full(len(batch), b + 1, np.uint64)
                    for k in range(b * ROWS, (b + 1) * ROWS):
                        key = (key ^ np.minimum.reduceat(base * factor[k] ^ shift[k], starts)) * np.uint64(0x9E3779B97F4A7C15)
                    band[:, b] = key ^ (key >> np.uint64(32))
                yield batch.assign(buckets=list(band.view(np.int64)))

    return forms.select("source", "form_id", "masked").mapInPandas(hashed, "source string, form_id bigint, masked string, buckets array<bigint>")


def _shingles(masked: Column) -> Column:
    words = F.split(masked, " ")
    last = F.greatest(F.size(words) - SHINGLE, F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(F.slice(words, k + 1, SHINGLE), " ")))


def alike_clusters(forms: DataFrame, likeness: float = 0.8) -> DataFrame:
    """source, form_id, cluster: forms of a source are one cluster if a chain of masked forms, each like the next, leads from one to the other.

    Equal masked forms are one member, so that a bucket holds different ones only; the members of a bucket are paired, those of a large
    one slot by slot, and pairs whose shingles have a Jaccard similarity of likeness or more are linked.
    """
    ids = F.xxhash64("source", "masked").alias("member")
    known = stage(_buckets(forms).withColumn("member", ids))
    members = stage(known.groupBy("member").agg(F.first("source").alias("source"), F.first("masked").alias("masked"), F.first("buckets").alias("buckets")))
    rows = members.select("member", "source", F.explode("buckets").alias("bucket"))
    size = rows.groupBy("source", "bucket").agg(F.count("*").alias("held")).filter("held > 1")
    rows = stage(rows.join(size, ["source", "bucket"]).withColumn("slots", F.ceil(F.col("held") / BUCKET).cast("int")).drop("held"))
    left = rows.withColumn("slot", F.pmod(F.xxhash64("member"), "slots").cast("int")).select("source", "bucket", "slot", F.col("member").alias("a"))
    right = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).select("source", "bucket", "slot", F.col("member").alias("b"))
    met = left.join(right, ["source", "bucket", "slot"]).filter("a < b").select("a", "b").distinct()
    words = members.select("member", _shingles(F.col("masked")).alias("s"))
    both = met.join(words.withColumnsRenamed({"member": "a", "s": "sa"}), "a").join(words.withColumnsRenamed({"member": "b", "s": "sb"}), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    links = both.filter(shared >= likeness * (F.size("sa") + F.size("sb") - shared)).select("a", "b")
    roots = components(links, "a", "b").withColumnsRenamed({"node": "member", "root": "cluster"})
    return known.join(roots, "member", "left").select("source", "form_id", F.coalesce("cluster", "member").alias("cluster"))


def equal_clusters(forms: DataFrame, enough) -> DataFrame:
    """source, form_id, cluster: each form a cluster of its own, if a bucket that it lies in is dense enough.

    The documents of a bucket's forms add up to a bound from above, so no form that reaches the frequency itself is lost.
    """
    rows = _buckets(forms).select("source", "form_id", F.explode("buckets").alias("bucket")).join(forms.select("source", "form_id", "n_docs", "source_docs"), ["source", "form_id"])
    dense = rows.groupBy("source", "bucket").agg(F.sum("n_docs").alias("bound"), F.first("source_docs").alias("source_docs")).filter(enough("bound")).select("source", "bucket")
    return rows.join(dense, ["source", "bucket"]).select("source", "form_id", F.col("form_id").alias("cluster")).distinct()


def repeated_lines(pages: DataFrame, files: DataFrame, min_docs: int = 3, min_share: float = 0.1, near: bool = False) -> DataFrame:
    """Lines to remove: source, document_id, page_id, line_no, form_id, n_docs (the documents of the line's cluster).

    The lines of a cluster go if it occurs in at least min_docs and min_share of its source's documents that have text. With near=False
    the members of a cluster are equal by line_form, with near=True alike by their masked forms (alike_clusters). Null, empty and
    blank lines never go, repeated rows count once, and empty tables give an empty result.
    """
    return _gone(stage(document_pages(pages, files)), min_docs, min_share, near)


def _gone(page: DataFrame, min_docs: int, min_share: float, near: bool) -> DataFrame:
    docs = small_side(page.groupBy("source").agg(F.count_distinct("document_id").alias("source_docs")))
    line = F.posexplode(F.split("cleaned_text", "\n")).alias("pos", "line")
    lines = page.select("source", "document_id", "page_id", line).select("source", F.xxhash64("document_id").alias("doc"), "document_id", "page_id", (F.col("pos") + 1).cast("int").alias("line_no"), "line", line_form(F.col("line")).alias("form"))
    lines = lines.filter("form <> ''").withColumn("form_id", F.xxhash64("form")).drop("form")
    enough = lambda n: (F.col(n) >= min_docs) & (F.col(n) >= F.lit(min_share) * F.col("source_docs"))
    forms = lines.groupBy("source", "form_id", "doc").agg(F.min("line").alias("line")).groupBy("source", "form_id").agg(F.count("*").alias("n_docs"), F.min("line").alias("line"))
    forms = stage(forms.join(docs, "source").select("source", "form_id", "n_docs", "source_docs", masked_form(F.col("line")).alias("masked")))
    if near:
        clusters = stage(alike_clusters(forms))
        sizes = clusters.groupBy("source", "cluster").agg(F.count("*").alias("held"))
        spread = lines.select("source", "form_id", "doc").join(clusters.join(sizes.filter("held > 1"), ["source", "cluster"]), ["source", "form_id"]).groupBy("source", "cluster").agg(F.count_distinct("doc").alias("n_docs"))
        single = clusters.join(sizes.filter("held = 1"), ["source", "cluster"]).join(forms.select("source", "form_id", "n_docs"), ["source", "form_id"])
        counted = spread.select("source", "cluster", "n_docs").unionByName(single.select("source", "cluster", "n_docs"))
    else:
        clusters = stage(equal_clusters(forms, enough))
        counted = clusters.join(forms, ["source", "form_id"]).select("source", "cluster", "n_docs")
    kept = clusters.join(counted.join(docs, "source").filter(enough("n_docs")), ["source", "cluster"]).select("source", "form_id", "n_docs")
    # A source keeps at most (lines per document) / min_share clusters; the table's size is measured before it is broadcast.
    return lines.join(small_side(kept), ["source", "form_id"]).select("source", "document_id", "page_id", "line_no", "form_id", "n_docs")


def strip_repeated(pages: DataFrame, files: DataFrame, min_docs: int = 3, min_share: float = 0.1, near: bool = False) -> DataFrame:
    """document_id, page_id, cleaned_text without the repeated lines; pages left without lines have ''."""
    page = stage(document_pages(pages, files))
    gone = _gone(page, min_docs, min_share, near).groupBy("page_id").agg(F.collect_set("line_no").alias("gone"))  # lines of one page
    lines = F.transform(F.split("cleaned_text", "\n"), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    kept = F.filter(lines, lambda x: ~F.array_contains("gone", x["n"]))
    out = F.when(F.col("gone").isNull(), F.col("cleaned_text")).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    return page.join(gone, "page_id", "left").select("document_id", "page_id", out.alias("cleaned_text"))
