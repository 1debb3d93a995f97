"""Queries of the training-data problems over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm import answer_pairs, boilerplate, leakage, mixture, near_duplicates, ocr_repair, splitting, template_residue, vector_neighbours
from docengine.plans.staging import read_table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_repair.line_defects(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "source_files"))


def p1_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr_repair.repaired_pages(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "source_files"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = vector_neighbours.neighbour_pairs(read_table(spark, sf_dir, "chunk_vectors"))
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_neighbours.nearest(read_table(spark, sf_dir, "chunk_vectors"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = splitting.split_oversized(read_table(spark, sf_dir, "pages"))
    return pieces.filter("piece_no = 1").select("page_id", "boundary")


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_oversized(read_table(spark, sf_dir, "pages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answer_pairs.defects(read_table(spark, sf_dir, "query_requests"), read_table(spark, sf_dir, "query_responses"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = boilerplate.repeated_lines(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "source_files"))
    return lines.select("page_id", "line_no")


def p5_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages without the lines of clusters of alike lines."""
    return boilerplate.strip_repeated(read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "source_files"), near=True)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_duplicates.near_duplicate_pairs(read_table(spark, sf_dir, "chunks"), latest_by="indexed_at")
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


def p6_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(read_table(spark, sf_dir, "chunks"), latest_by="indexed_at")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of twelve words with up to two edited characters."""
    return leakage.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), edits=2)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixture.source_plan(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "source_targets"))
    return plan.select("source", "copies", "status")


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "source_targets"))


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mixture_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "source_targets"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.residue(read_table(spark, sf_dir, "documents"))


def p9_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.without_residue(read_table(spark, sf_dir, "documents")).select("doc_id", "source", "lang")


def queries() -> dict[str, Query]:
    named = (p1_found, p1_repaired, p2_found, p2_neighbours, p3_found, p3_pieces, p4_found, p5_found, p5_stripped, p6_found, p6_groups, p7_found, p7_near, p8_found, p8_mixture, p8_report, p9_found, p9_kept)
    return {f.__name__: f for f in named}


_P3 = r"""
WITH page AS (SELECT page_id, arg_max(cleaned_text, extracted_at) AS t FROM pages GROUP BY page_id),
long AS (SELECT page_id, regexp_split_to_array(t, '\n\s*\n') AS pars, t FROM page WHERE length(t) > 2000),
units AS (SELECT page_id, pars, string_split(array_to_string(list_transform(pars, lambda p: regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g')), chr(1)), chr(1)) AS sens,
                 regexp_split_to_array(t, '\s+') AS words FROM long),
size AS (SELECT page_id, list_max(list_transform(pars, lambda u: length(regexp_replace(u, '^\s+|\s+$', '', 'g')))) AS p,
                list_max(list_transform(sens, lambda u: length(regexp_replace(u, '^\s+|\s+$', '', 'g')))) AS s,
                list_max(list_transform(words, lambda u: length(u))) AS w FROM units)
SELECT page_id, CASE WHEN p <= 2000 THEN 'paragraph' WHEN s <= 2000 THEN 'sentence' WHEN w <= 2000 THEN 'word' ELSE 'none' END AS boundary FROM size
"""

_P5 = r"""
WITH page AS (SELECT page_id, arg_max(document_id, extracted_at) AS document_id, arg_max(cleaned_text, extracted_at) AS t FROM pages WHERE cleaned_text <> '' GROUP BY page_id),
src AS (SELECT document_id, coalesce(arg_max(insurer, ingested_at), '') AS source FROM source_files GROUP BY document_id),
line AS (SELECT source, document_id, page_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS line_no FROM page JOIN src USING (document_id)),
form AS (SELECT source, document_id, page_id, CAST(line_no AS INT) AS line_no, trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '\s+', ' ', 'g')) AS form FROM line),
docs AS (SELECT source, count(DISTINCT document_id) AS n FROM form GROUP BY source),
freq AS (SELECT source, form, count(DISTINCT document_id) AS d FROM form WHERE form <> '' GROUP BY source, form),
gone AS (SELECT source, form FROM freq JOIN docs USING (source) WHERE d >= 3 AND d >= 0.1 * n)
SELECT page_id, line_no FROM form JOIN gone USING (source, form)
"""

_P7 = r"""
WITH item AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
doc AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
gram AS (SELECT DISTINCT item_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM item WHERE len(w) >= 12)),
seen AS (SELECT doc_id, array_to_string(w[k:k+11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM doc WHERE len(w) >= 12))
SELECT DISTINCT doc_id, item_id FROM seen JOIN gram USING (g)
"""

_P8 = r"""
WITH tok AS (SELECT source, sum(coalesce(len(regexp_extract_all(text, '[\p{L}\p{Nd}]+|[^\s\p{L}\p{Nd}]')), 0)) AS n FROM documents GROUP BY source),
plan AS (SELECT t.source, t.target_share AS a, t.max_repeats AS m, CAST(coalesce(n, 0) AS BIGINT) AS n FROM source_targets t LEFT JOIN tok USING (source)),
need AS (SELECT source, m, n, a * (SELECT sum(n) FROM plan) AS need FROM plan),
pick AS (SELECT source, m, n, need, coalesce(list_min(list_filter(range(0, m + 1), lambda c: c * n >= need)), m) AS c FROM need)
SELECT source, CAST(CASE WHEN n = 0 THEN 0 ELSE c END AS INT) AS copies, CASE WHEN n > 0 AND c * n >= need THEN 'met' ELSE 'short' END AS status FROM pick
"""


_P2 = """
WITH vec AS (SELECT chunk_id, max(embedding) AS e FROM chunk_vectors WHERE chunk_id IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY chunk_id),
d AS (SELECT chunk_id, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS e FROM vec),
s AS (SELECT a.chunk_id AS x, b.chunk_id AS y, row_number() OVER (PARTITION BY a.chunk_id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.chunk_id) AS n FROM d a JOIN d b ON a.chunk_id <> b.chunk_id)
SELECT DISTINCT least(x, y) AS chunk_id_a, greatest(x, y) AS chunk_id_b FROM s WHERE n <= 5
"""

_P6 = """
WITH c AS (SELECT chunk_id, arg_max(text, indexed_at) AS t FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id),
w AS (SELECT chunk_id, list_distinct(regexp_extract_all(lower(t), '[a-z0-9]+')) AS ws FROM c WHERE t IS NOT NULL),
u AS (SELECT chunk_id, len(ws) AS n, unnest(ws) AS w FROM w WHERE len(ws) >= 20),
p AS (SELECT a.chunk_id AS x, b.chunk_id AS y, any_value(a.n) + any_value(b.n) AS n, count(*) AS s FROM u a JOIN u b ON a.w = b.w AND a.chunk_id < b.chunk_id AND 10 * b.n >= 7 * a.n AND 10 * a.n >= 7 * b.n GROUP BY a.chunk_id, b.chunk_id)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM p WHERE 10 * s >= 7 * (n - s)
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": _P2, "p6_found": _P6, "p3_found": _P3, "p5_found": _P5, "p7_found": _P7, "p8_found": _P8}
