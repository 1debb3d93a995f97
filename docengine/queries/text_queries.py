"""Cleaning, page and chunking queries (T*, C*, S02, S03)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx
from docengine.operators import chunking, cleaning
from docengine.operators.records import chunks_of, files_of, pages_of
from docengine.queries.registry import Registry, Tables

query = Registry()


def once(table: str, key: str, by: str, name: str) -> str:
    return f"{name} AS (SELECT * FROM {table} WHERE {key} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {by} DESC NULLS LAST) = 1)"


PAGE = once("pages", "page_id", "extracted_at", "page")
CHUNK = once("chunks", "chunk_id", "indexed_at", "chunk")
FILE = once("source_files", "document_id", "ingested_at", "file")
_CLEAN = r"""
s1 AS (SELECT *, translate(raw_text, chr(160) || '“”‘’–—−•▪■●◦·' || chr(8203) || chr(8204) || chr(8205) || chr(65279), ' ""''''---------') AS t FROM page WHERE raw_text IS NOT NULL),
s2 AS (SELECT *, translate(regexp_replace(translate(t, chr(10) || chr(9), '⏎⇥'), '\p{C}', '', 'g'), '⏎⇥', chr(10) || chr(9)) AS u FROM s1),
s3 AS (SELECT *, regexp_replace(u, '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g') AS v FROM s2),
s4 AS (SELECT *, list_transform(string_split(v, chr(10)), lambda x: regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS ls FROM s3),
s5 AS (SELECT *, list_filter(ls, lambda x, i: i = 1 OR x <> ls[i - 1]) AS ld FROM s4),
s6 AS (SELECT *, array_to_string(list_filter(ld, lambda x: NOT regexp_full_match(x, '\s*[0-9]+\s*')), chr(10)) AS w FROM s5),
clean AS (SELECT *, regexp_replace(regexp_replace(w, '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned FROM s6)"""


@query(f"WITH {PAGE},{_CLEAN} SELECT page_id, cleaned FROM clean")
def t09_clean_text(t: Tables) -> DataFrame:
    return pages_of(t.pages).filter("raw_text is not null").select("page_id", tx.clean_text(F.col("raw_text")).alias("cleaned"))


@query()
def t01_nfkc_clean(t: Tables) -> DataFrame:
    normal = pages_of(t.pages).filter("raw_text is not null").select("page_id", tx.nfkc("raw_text").alias("normal"))
    return normal.select("page_id", tx.clean_text(F.col("normal")).alias("cleaned"))


@query(rf"""WITH {PAGE}, line AS (SELECT page_id, document_id, unnest(string_split(raw_text, chr(10))) AS raw FROM page WHERE raw_text IS NOT NULL AND document_id IS NOT NULL),
seen AS (SELECT DISTINCT document_id, page_id, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM line),
n AS (SELECT document_id, count(*) AS pages FROM page WHERE raw_text IS NOT NULL GROUP BY document_id)
SELECT document_id, line, count(*) AS n_pages FROM seen JOIN n USING (document_id) WHERE length(line) >= 3
GROUP BY document_id, line, pages HAVING count(*) >= greatest(2, CAST(floor(0.6 * pages) AS BIGINT))""")
def t10_repeated_lines(t: Tables) -> DataFrame:
    return cleaning.repeated_page_lines(pages_of(t.pages))


_STRIP = rf"""WITH {PAGE}, line AS (SELECT page_id, document_id, unnest(string_split(raw_text, chr(10))) AS raw, generate_subscripts(string_split(raw_text, chr(10)), 1) AS i FROM page WHERE raw_text IS NOT NULL AND document_id IS NOT NULL),
trimmed AS (SELECT document_id, page_id, i, raw, regexp_replace(raw, '^\s+|\s+$', '', 'g') AS line FROM line),
n AS (SELECT document_id, count(*) AS pages FROM page WHERE raw_text IS NOT NULL GROUP BY document_id),
rep AS (SELECT document_id, line FROM (SELECT DISTINCT document_id, page_id, line FROM trimmed) JOIN n USING (document_id) WHERE length(line) >= 3
        GROUP BY document_id, line, pages HAVING count(*) >= greatest(2, CAST(floor(0.6 * pages) AS BIGINT)))
SELECT page_id, coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (WHERE rep.line IS NULL), '') AS text FROM trimmed LEFT JOIN rep ON trimmed.document_id = rep.document_id AND trimmed.line = rep.line GROUP BY page_id"""


@query(_STRIP)
def t11_strip_repeated(t: Tables) -> DataFrame:
    return cleaning.strip_page_lines(pages_of(t.pages))


_STRIPPED = _CLEAN.replace("FROM page WHERE raw_text IS NOT NULL", f"FROM (SELECT page_id, text AS raw_text FROM ({_STRIP}))")


@query(f"WITH {_STRIPPED} SELECT page_id, cleaned FROM clean")
def t12_clean_pages(t: Tables) -> DataFrame:
    return cleaning.strip_page_lines(pages_of(t.pages)).select("page_id", tx.clean_text(F.col("text")).alias("cleaned"))


@query(f"""WITH {PAGE} SELECT document_id, count(*) AS pages, string_agg('===== PAGE ' || page_number || ' =====' || chr(10) || coalesce(cleaned_text, ''), chr(10) || chr(10) ORDER BY page_number, page_id) AS text
FROM page WHERE document_id IS NOT NULL GROUP BY document_id""")
def t13_concat_pages(t: Tables) -> DataFrame:
    return cleaning.concat_pages(pages_of(t.pages))


@query(rf"""WITH {PAGE}, par AS (SELECT page_id, unnest(string_split(cleaned_text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(cleaned_text, chr(10) || chr(10)), 1) AS i FROM page WHERE cleaned_text IS NOT NULL),
trimmed AS (SELECT page_id, i, regexp_replace(p, '^\s+|\s+$', '', 'g') AS p FROM par),
firsts AS (SELECT page_id, i, p FROM trimmed WHERE p <> '' QUALIFY row_number() OVER (PARTITION BY page_id, md5(regexp_replace(lower(p), '\s+', ' ', 'g')) ORDER BY i) = 1)
SELECT page_id, count(*) AS paragraphs, string_agg(p, chr(10) || chr(10) ORDER BY i) AS text FROM firsts GROUP BY page_id""")
def t14_paragraph_dedupe(t: Tables) -> DataFrame:
    return cleaning.distinct_paragraphs(pages_of(t.pages))


_ALNUM = r"[\p{L}\p{N}\s]"


@query(rf"""WITH {PAGE}, s AS (SELECT page_id, raw_text IS NULL AS missing, regexp_replace(coalesce(raw_text, ''), '^\s+|\s+$', '', 'g') AS t FROM page)
SELECT page_id, round(CASE WHEN length(t) = 0 THEN 1.0 ELSE length(regexp_replace(t, '{_ALNUM}', '', 'g')) / length(t) END, 6) AS symbol_ratio,
missing OR length(t) < 40 OR (CASE WHEN length(t) = 0 THEN 1.0 ELSE length(regexp_replace(t, '{_ALNUM}', '', 'g')) / length(t) END) > 0.2 AS needs_ocr FROM s""")
def t20_ocr_need(t: Tables) -> DataFrame:
    text = tx.strip(F.coalesce("raw_text", F.lit("")))
    return pages_of(t.pages).select("page_id", F.round(tx.symbol_ratio(text), 6).alias("symbol_ratio"), tx.needs_ocr(F.col("raw_text")).alias("needs_ocr"))


@query(rf"""WITH {PAGE}, line AS (SELECT page_id, unnest(string_split(raw_text, chr(10))) AS line, generate_subscripts(string_split(raw_text, chr(10)), 1) AS line_no FROM page WHERE raw_text IS NOT NULL)
SELECT page_id, CAST(line_no AS INT) AS line_no, line FROM line WHERE regexp_matches(line, '(?i){lx.CAPTION_PATTERN}')""")
def t28_caption_lines(t: Tables) -> DataFrame:
    return cleaning.caption_lines(pages_of(t.pages))


@query(f"""WITH {PAGE} SELECT document_id, count(*) AS pages, CAST(coalesce(count_if(used_ocr), 0) AS BIGINT) AS ocr_pages, round(100.0 * coalesce(count_if(used_ocr), 0) / count(*), 2) AS ocr_percentage FROM page GROUP BY document_id""")
def t29_ocr_stats(t: Tables) -> DataFrame:
    return cleaning.ocr_stats(pages_of(t.pages))


@query(f"""WITH {PAGE}, {FILE} SELECT insurer, count(DISTINCT document_id) AS documents, count(page_id) AS pages, CAST(coalesce(count_if(table_text <> ''), 0) AS BIGINT) AS table_pages,
CAST(sum(length(raw_text)) AS BIGINT) AS raw_chars, CAST(sum(length(cleaned_text)) AS BIGINT) AS clean_chars FROM file LEFT JOIN page USING (document_id) GROUP BY insurer""")
def t32_dataset_summary(t: Tables) -> DataFrame:
    return cleaning.dataset_summary(files_of(t.source_files), pages_of(t.pages))


@query()
def t30_language(t: Tables) -> DataFrame:
    return cleaning.language(pages_of(t.pages))


@query(rf"""WITH {PAGE}, r AS (SELECT page_id, unnest(string_split(table_text, chr(10))) AS line, generate_subscripts(string_split(table_text, chr(10)), 1) AS i FROM page WHERE table_text IS NOT NULL),
c AS (SELECT page_id, i, list_transform(string_split(line, '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS cells FROM r)
SELECT page_id, CAST(i AS INT) AS row_no, array_to_string(cells, ' | ') AS row_text, len(cells) AS n_cells FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0""")
def t24_table_rows(t: Tables) -> DataFrame:
    return chunking.table_rows(pages_of(t.pages)).select("page_id", "row_no", F.array_join("cells", " | ").alias("row_text"), F.size("cells").cast("bigint").alias("n_cells"))


@query(rf"""WITH {PAGE}, r AS (SELECT page_id, unnest(string_split(table_text, chr(10))) AS line, generate_subscripts(string_split(table_text, chr(10)), 1) AS i FROM page WHERE table_text IS NOT NULL),
c AS (SELECT page_id, i, list_transform(string_split(line, '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS cells FROM r),
k AS (SELECT page_id, i, array_to_string(cells, ' | ') AS t FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0)
SELECT page_id, string_agg(t, chr(10) ORDER BY i) AS table_text FROM k GROUP BY page_id""")
def t25_table_text(t: Tables) -> DataFrame:
    rows = chunking.table_rows(pages_of(t.pages)).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("row_no", F.array_join("cells", " | ").alias("x")))).alias("r"))
    return rows.select("page_id", F.array_join(F.transform("r", lambda x: x["x"]), "\n").alias("table_text"))


_PARENT = """(len(cells) >= 2 AND len(list_filter(regexp_split_to_array(cells[1], '\\s+'), lambda x: x <> '')) <= 4 AND len(list_filter(regexp_split_to_array(cells[2], '\\s+'), lambda x: x <> '')) >= 6)
OR (row_text = upper(row_text) AND row_text <> lower(row_text) AND n_words <= 8) OR (regexp_matches(lower(row_text), 'coverage|benefit|plan|eligibility|policy|details|sum insured') AND n_words <= 12)"""
_ROWS = rf"""{PAGE}, r AS (SELECT page_id, unnest(string_split(table_text, chr(10))) AS line, generate_subscripts(string_split(table_text, chr(10)), 1) AS i FROM page WHERE table_text IS NOT NULL),
c AS (SELECT page_id, CAST(i AS INT) AS row_no, list_transform(string_split(line, '|'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS cells FROM r),
k AS (SELECT page_id, row_no, cells, trim(array_to_string(cells, ' ')) AS row_text, len(list_filter(regexp_split_to_array(array_to_string(cells, ' '), '\s+'), lambda x: x <> '')) AS n_words FROM c WHERE len(list_filter(cells, lambda x: x <> '')) > 0),
p AS (SELECT page_id, row_no, array_to_string(cells, ' | ') AS text, {_PARENT} AS is_parent FROM k)"""


@query(f"""WITH {_ROWS} SELECT page_id, row_no, is_parent, last_value(CASE WHEN is_parent THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS parent_row FROM p""")
def c08_parent_rows(t: Tables) -> DataFrame:
    return chunking.with_parent_rows(chunking.table_rows(pages_of(t.pages))).select("page_id", "row_no", "is_parent", "parent_row")


_LINES = r"list_filter(list_transform(string_split(cleaned_text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) >= 2)"


@query(f"""WITH {PAGE}, l AS (SELECT page_id, {_LINES} AS ls FROM page WHERE cleaned_text IS NOT NULL),
w AS (SELECT page_id, ls, unnest(range(0, len(ls), 2)) AS start FROM l WHERE len(ls) > 0)
SELECT page_id, CAST(start AS INT) AS start, array_to_string(ls[start + 1:start + 4], ' ') AS text FROM w""")
def c02_line_windows(t: Tables) -> DataFrame:
    return chunking.line_windows(pages_of(t.pages))


def _any(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


_TYPE = f"CASE WHEN {_any('low', lx.EXCLUSION_PHRASES)} THEN 'exclusion' WHEN {_any('low', lx.CLAIM_PHRASES)} THEN 'claim_rule' WHEN regexp_matches(low, '{lx.CLAUSE_PATTERN}') THEN 'policy_clause' ELSE 'general_info' END"
_SECTION = "CASE " + " ".join(f"WHEN contains(low, '{s}') THEN '{s.title()}'" for s in lx.SECTION_HEADERS) + " ELSE 'General' END"


@query(f"WITH {CHUNK}, c AS (SELECT chunk_id, lower(text) AS low FROM chunk WHERE text IS NOT NULL) SELECT chunk_id, {_TYPE} AS chunk_type, {_SECTION} AS section FROM c")
def c04_chunk_types(t: Tables) -> DataFrame:
    return chunking.typed(chunks_of(t.chunks).filter("text is not null").select("chunk_id", "text")).select("chunk_id", "chunk_type", "section")


@query(f"""WITH {_ROWS}, f AS (SELECT page_id, row_no, text, last_value(CASE WHEN is_parent THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS parent_row FROM p),
tab AS (SELECT document_id, page_number, page_id, 'T_' || substr(sha256(document_id || ':' || page_id || ':1'), 1, 12) AS table_id FROM page WHERE document_id IS NOT NULL),
rowchunk AS (SELECT document_id, page_number, table_id, table_id || '_R' || row_no AS piece, row_no AS ord, text FROM f JOIN tab USING (page_id)),
l AS (SELECT document_id, page_number, page_id, {_LINES} AS ls FROM page WHERE cleaned_text IS NOT NULL AND document_id IS NOT NULL),
w AS (SELECT document_id, page_number, page_id, ls, unnest(range(0, len(ls), 2)) AS start FROM l WHERE len(ls) > 0),
winchunk AS (SELECT document_id, page_number, CAST(NULL AS VARCHAR) AS table_id, 'W_' || page_id || '_' || start AS piece, 100000 + start AS ord, array_to_string(ls[start + 1:start + 4], ' ') AS text FROM w),
u AS (SELECT *, lower(text) AS low FROM (SELECT * FROM rowchunk UNION ALL SELECT * FROM winchunk))
SELECT 'C_' || substr(sha256(document_id || ':' || piece), 1, 12) AS chunk_id, document_id, CAST(page_number AS INT) AS page_number, table_id, CASE WHEN table_id IS NULL THEN {_TYPE} ELSE 'table_row' END AS chunk_type, {_SECTION} AS section, text FROM u""")
def c10_build_chunks(t: Tables) -> DataFrame:
    return chunking.build_chunks(pages_of(t.pages))


@query(f"WITH {CHUNK} SELECT document_id, chunk_type, count(*) AS n FROM chunk GROUP BY document_id, chunk_type")
def c14_chunk_type_counts(t: Tables) -> DataFrame:
    return chunks_of(t.chunks).groupBy("document_id", "chunk_type").agg(F.count("*").alias("n"))


@query(f"""WITH {CHUNK} SELECT chunk_id, list_filter([CASE WHEN coalesce(text, '') = '' THEN 'text' END, CASE WHEN coalesce(embedding_text, '') = '' THEN 'embedding_text' END, CASE WHEN coalesce(chunk_type, '') = '' THEN 'chunk_type' END,
CASE WHEN page_start IS NULL THEN 'page_start' END, CASE WHEN page_end IS NULL THEN 'page_end' END, CASE WHEN chunk_type IN ('table_row', 'table_row_part', 'table_meta') AND coalesce(table_id, '') = '' THEN 'table_id' END], lambda x: x IS NOT NULL) AS missing
FROM chunk WHERE coalesce(text, '') = '' OR coalesce(embedding_text, '') = '' OR coalesce(chunk_type, '') = '' OR page_start IS NULL OR page_end IS NULL OR (chunk_type IN ('table_row', 'table_row_part', 'table_meta') AND coalesce(table_id, '') = '')""")
def c13_chunk_violations(t: Tables) -> DataFrame:
    return chunking.violations(chunks_of(t.chunks))


_NORMAL = f"""coalesce(nullif(embedding_text, ''), nullif(text, '')) AS filled, CASE WHEN coalesce(table_id, '') <> '' OR row_number IS NOT NULL THEN 'table_row' WHEN {_any("lower(coalesce(text, ''))", lx.EXCLUSION_PHRASES)} THEN 'exclusion'
WHEN {_any("lower(coalesce(text, ''))", lx.INDEX_CLAUSE_WORDS)} THEN 'clause' ELSE 'general_info' END AS inferred_type"""


@query(f"WITH {CHUNK} SELECT chunk_id, {_NORMAL} FROM chunk")
def c15_normalize_chunks(t: Tables) -> DataFrame:
    return chunking.normalized(chunks_of(t.chunks)).select("chunk_id", "filled", "inferred_type")


@query(f"""WITH {FILE}, {CHUNK} SELECT document_id, document_id || '_' || CAST(CAST(floor(last_modified) AS BIGINT) AS VARCHAR) AS signature FROM file WHERE last_modified IS NOT NULL AND document_id NOT IN (SELECT document_id FROM chunk WHERE document_id IS NOT NULL)""")
def c12_unchanged_skip(t: Tables) -> DataFrame:
    return chunking.changed_files(files_of(t.source_files), chunks_of(t.chunks))


@query(f"WITH {FILE}, {CHUNK} SELECT document_id, file_name FROM file WHERE document_id IN (SELECT document_id FROM chunk WHERE document_id IS NOT NULL)")
def c16_already_indexed(t: Tables) -> DataFrame:
    return files_of(t.source_files).join(chunks_of(t.chunks).select("document_id"), "document_id", "left_semi").select("document_id", "file_name")


_MAP = "CASE part3 " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lx.DOC_TYPES.items()) + " ELSE 'other' END"


@query(f"""WITH {FILE}, p AS (SELECT document_id, file_path, string_split(file_path, '/') AS parts FROM file WHERE file_path IS NOT NULL), q AS (SELECT *, CASE WHEN len(parts) >= 3 THEN parts[2] ELSE 'Unknown' END AS path_insurer, parts[3] AS part3 FROM p)
SELECT document_id, path_insurer, CASE WHEN len(parts) >= 3 THEN {_MAP} ELSE 'Unknown' END AS path_type, regexp_matches(lower(file_path), 'claim|preauth') AS form_mode FROM q""")
def s02_path_metadata(t: Tables) -> DataFrame:
    return cleaning.path_metadata(files_of(t.source_files).filter("file_path is not null"))


@query(f"WITH {FILE} SELECT document_id, regexp_full_match(document_id, '[0-9a-f]{{64}}') AS well_formed, sha256(document_id) AS rehash, strftime(make_timestamp(CAST(floor(last_modified) AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S') AS modified FROM file")
def s03_content_id(t: Tables) -> DataFrame:
    return files_of(t.source_files).select(
        "document_id", F.col("document_id").rlike("^[0-9a-f]{64}$").alias("well_formed"), F.sha2("document_id", 256).alias("rehash"),
        F.date_format(F.timestamp_seconds(F.floor("last_modified")), "yyyy-MM-dd HH:mm:ss").alias("modified"))


@query(f"""WITH {FILE}, d AS (SELECT document_id, CASE WHEN page_count % 7 = 3 THEN 'D:bad' ELSE 'D:' || strftime(ingested_at, '%Y%m%d%H%M%S') || 'Z' END AS pdf_date FROM file)
SELECT document_id, coalesce(strftime(try_strptime(substr(replace(pdf_date, 'D:', ''), 1, 14), '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S'), pdf_date) AS created FROM d""")
def t27_pdf_dates(t: Tables) -> DataFrame:
    made = F.when(F.col("page_count") % 7 == 3, "D:bad").otherwise(F.concat(F.lit("D:"), F.date_format("ingested_at", "yyyyMMddHHmmss"), F.lit("Z")))
    return files_of(t.source_files).select("document_id", cleaning.pdf_date(made).alias("created"))


@query(f"""WITH {CHUNK}, w AS (SELECT document_id, page_number, chunk_id, page_start * 6.5 + coalesce(row_number, 0) AS y0, length(coalesce(text, '')) % 600 AS x0 FROM chunk WHERE document_id IS NOT NULL AND page_number IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY round_even(y0 / 6, 0), x0, chunk_id) AS n FROM w)
SELECT chunk_id, CAST(n AS INT) AS reading_order, CASE WHEN x0 < 300 THEN 'L' ELSE 'R' END AS side FROM o""")
def t17_reading_order(t: Tables) -> DataFrame:
    words = chunks_of(t.chunks).filter("document_id is not null and page_number is not null").select(
        "document_id", "page_number", "chunk_id", (F.col("page_start") * 6.5 + F.coalesce("row_number", F.lit(0))).alias("y0"), (F.length(F.coalesce("text", F.lit(""))) % 600).alias("x0"))
    return cleaning.reading_order(words, ["document_id", "page_number"], "chunk_id", page_width=600.0).select("chunk_id", "reading_order", "side")


@query(f"""WITH {CHUNK}, w AS (SELECT document_id, length(coalesce(text, '')) % 600 AS x0 FROM chunk WHERE document_id IS NOT NULL)
SELECT document_id, count(*) >= 5 AND count_if(x0 - 300 BETWEEN -108 AND 108) / count(*) < 0.2 AS two_columns FROM w GROUP BY document_id""")
def t15_two_columns(t: Tables) -> DataFrame:
    words = chunks_of(t.chunks).filter("document_id is not null").select("document_id", (F.length(F.coalesce("text", F.lit(""))) % 600).alias("x0"), F.lit(600.0).alias("page_width"))
    return cleaning.two_columns(words, ["document_id"], min_words=5, share=0.2)
