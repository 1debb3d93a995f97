"""Whole passes and their records: context blocks, confidence, verdicts, normalised queries, round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx
from docengine.operators import context, evaluation, lexical, retrieval, understanding, vectors
from docengine.operators.records import chunks_of, pages_of, requests_of, responses_of
from docengine.plans.staging import shared_dir
from docengine.queries.evaluation_queries import _FACT, _HITS, _JAC, _POOL, _SENT, _TAGS, RESP, _hits
from docengine.queries.registry import Registry, Tables
from docengine.queries.retrieval_queries import _KEYWORD, _PRE, _UNIT, _VEC, _WTOK, BASE, BM25, COS, REQ, _case, asked, best, docs_of, expand_sql, hybrid_sql
from docengine.queries.text_queries import CHUNK, PAGE
from docengine.sources import documents

query = Registry()

_BUDGET = f"""{_POOL}, c AS (SELECT *, coalesce(sum(CASE WHEN nc <= 4 THEN tokens ELSE 0 END) OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pool),
e AS (SELECT qid, min(pos) AS stop FROM c WHERE before + tokens > 200 AND before > 0 GROUP BY qid),
used AS (SELECT c.qid, chunk_id, string_agg(sentence, ' ' ORDER BY pos) AS text, CAST(sum(tokens) AS BIGINT) AS tokens, min(pos) AS first_pos, 'C_' || substr(md5(chunk_id), 1, 8) AS tag FROM c LEFT JOIN e USING (qid) WHERE nc <= 4 AND (stop IS NULL OR pos < stop) GROUP BY c.qid, chunk_id)"""


def _used(t: Tables) -> DataFrame:
    return t.staged("_used", lambda: context.compress(_staged_hits(t), budget=200))


def _staged_hits(t: Tables) -> DataFrame:
    return t.staged("_found", lambda: _hits(t))


@query(f"""WITH {_BUDGET}, r AS (SELECT qid, chunk_id, {_JAC.format(a='qs', b='ts')} >= 0.3 AS rel FROM (SELECT qid, chunk_id, list_distinct({_WTOK.format('qtext')}) AS qs, list_distinct({_WTOK.format('text')}) AS ts FROM hit))
SELECT r.qid, count(*) AS candidates, CAST(count_if(rel) AS BIGINT) AS relevant, round(CASE WHEN count_if(rel) = 0 THEN 1e0 ELSE count_if(rel AND used.chunk_id IS NOT NULL) / count_if(rel) END, 3) AS context_recall
FROM r LEFT JOIN used ON used.qid = r.qid AND used.chunk_id = r.chunk_id GROUP BY r.qid""")
def e04_context_recall(t: Tables) -> DataFrame:
    return evaluation.context_recall(_staged_hits(t), _used(t))


@query(f"""WITH {_BUDGET}, x AS (SELECT used.*, chunk_type, page_start FROM used JOIN doc USING (chunk_id)), n AS (SELECT qid, count(*) AS candidates FROM hit GROUP BY qid)
SELECT qid, string_agg('[' || tag || '] (' || coalesce(chunk_type, 'unknown') || ', page ' || coalesce(CAST(page_start AS VARCHAR), '?') || '): ' || text, chr(10) ORDER BY first_pos) AS block, CAST(sum(tokens) AS BIGINT) AS tokens_used,
any_value(candidates) - count(*) AS dropped, round(count(*) / greatest(1, any_value(candidates)), 2) AS compression_ratio FROM x JOIN n USING (qid) GROUP BY qid""")
def g06_context_block(t: Tables) -> DataFrame:
    return context.context_block(_used(t).join(docs_of(t).select("chunk_id", "chunk_type", "page_start"), "chunk_id"), _staged_hits(t))


@query(f"""WITH {_BUDGET}, n AS (SELECT qid, any_value(qtext) AS qtext, count(*) AS candidates, max(score) AS top FROM hit GROUP BY qid),
a AS (SELECT qid, string_agg(text, ' ' ORDER BY first_pos) FILTER (WHERE k <= 4) AS answer, string_agg(text, ' ' ORDER BY first_pos) AS whole, count(*) AS used FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_pos) AS k FROM used) GROUP BY qid),
w AS (SELECT *, list_distinct({_WTOK.format('answer')}) AS aw, list_distinct({_WTOK.format('whole')}) AS ww, list_distinct({_WTOK.format('qtext')}) AS qw FROM a JOIN n USING (qid)),
s AS (SELECT qid, used, candidates, top, round(CASE WHEN len(aw) = 0 THEN 0e0 ELSE len(list_intersect(aw, ww)) / len(aw) END, 3) AS faithfulness, round(CASE WHEN len(qw) = 0 THEN 0e0 ELSE len(list_intersect(qw, aw)) / len(qw) END, 3) AS relevance FROM w)
SELECT qid, faithfulness, relevance, round(0.4e0 * faithfulness + 0.3e0 * relevance + 0.3e0 * least(1e0, top), 3) AS confidence, round(used / greatest(1, candidates), 2) AS compression_ratio FROM s""")
def g22_single_pass(t: Tables) -> DataFrame:
    """Retrieve, compress, answer from the best used chunks, judge the answer by tokens."""
    return context.single_pass(_used(t), _staged_hits(t))


_JUDGED = f"""{REQ}, {RESP}, x AS (SELECT request_id, coalesce(intent, 'none') AS intent, list_distinct({_WTOK.format("coalesce(query, '')")}) AS qs, list_distinct({_WTOK.format("coalesce(synthesized_answer, '')")}) AS ts,
  coalesce(synthesized_answer, '') AS a, coalesce(sources, []) AS ctx, coalesce(confidence, 0e0) AS top FROM req JOIN resp USING (request_id)),
y AS (SELECT *, {_TAGS.format(t='a')} AS cited, {_FACT.format(s=_SENT.format(t='a'))} AS facts FROM x),
z AS (SELECT *, len(list_filter(cited, lambda c: NOT list_contains(ctx, c))) AS invalid, round(CASE WHEN len(facts) = 0 THEN 1e0 ELSE len(list_filter(facts, lambda f: len(list_intersect({_TAGS.format(t='f')}, ctx)) > 0)) / len(facts) END, 3) AS cc,
  CASE WHEN len(qs) = 0 THEN 0e0 ELSE len(list_intersect(qs, ts)) / len(qs) END AS rel, {_JAC.format(a='qs', b='ts')} AS sim FROM y),
v AS (SELECT *, round(cc * CASE WHEN invalid > 0 THEN 0.3e0 ELSE 1e0 END, 3) AS faith, least(1e0, 0.7e0 * rel + 0.3e0 * sim) AS full_score FROM z),
verdict AS (SELECT request_id, intent, top, faith AS faithfulness, round(rel, 3) AS relevance, NOT (faith < 0.2 OR rel < 0.15 OR full_score < 0.001 OR rel < 0.1) AS passed, (rel < 0.15 OR faith < 0.2 OR invalid > 0 OR rel < 0.1) AS crag_required,
  CASE WHEN rel < 0.15 THEN 'low_relevance' WHEN faith < 0.2 OR invalid > 0 THEN 'low_faithfulness' END AS crag_priority, (rel < 0.05 AND faith < 0.05 AND rel < 0.1 AND len(ctx) = 0) AS drop_immediately FROM v)"""


def _verdicts(t: Tables) -> DataFrame:
    got = requests_of(t.query_requests).select("request_id", "query").join(responses_of(t.query_responses).select("request_id", "synthesized_answer", "sources", "confidence", "intent"), "request_id")
    q, a = tx.word_set(F.col("query")), tx.word_set(F.col("synthesized_answer"))
    rel = F.when(F.size(q) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(q, a)) / F.size(q))
    known = F.coalesce("sources", F.array().cast("array<string>"))
    cite = context.citation_report(F.coalesce("synthesized_answer", F.lit("")), known)
    faith = F.round(cite["citation_coverage"] * F.when(cite["invalid"] > 0, lx.INVALID_TAG_PENALTY).otherwise(1.0), 3)
    full = F.least(F.lit(1.0), 0.7 * rel + 0.3 * tx.jaccard(q, a))
    judged = context.verdict(faith, rel, full, rel, F.coalesce("confidence", F.lit(0.0))) | context.correction(faith, rel, rel, cite["invalid"] > 0, F.size(known) == 0)
    return got.select("request_id", F.coalesce("intent", F.lit("none")).alias("intent"), faith.alias("faithfulness"), F.round(rel, 3).alias("relevance"), F.round(full, 3).alias("completeness"), *[c.alias(k) for k, c in judged.items()])


_REASONS = "list_filter([CASE WHEN faith < 0.2 THEN 'low_faithfulness' END, CASE WHEN rel < 0.15 THEN 'low_relevance' END, CASE WHEN full_score < 0.001 THEN 'low_completeness' END, CASE WHEN rel < 0.1 THEN 'low_coverage' END, CASE WHEN top < 0.45 THEN 'low_retrieval' END], lambda r: r IS NOT NULL)"


@query(f"WITH {_JUDGED} SELECT request_id, faith AS faithfulness, round(rel, 3) AS relevance, round(full_score, 3) AS completeness, NOT (faith < 0.2 OR rel < 0.15 OR full_score < 0.001 OR rel < 0.1) AS passed, {_REASONS} AS reasons FROM v")
def g17_verdict(t: Tables) -> DataFrame:
    """Each request's latest answer judged by token similarity to question and context."""
    return _verdicts(t).select("request_id", "faithfulness", "relevance", "completeness", "passed", "reasons")


@query(f"WITH {_JUDGED} SELECT request_id, faithfulness, relevance, passed, crag_required, crag_priority, drop_immediately FROM verdict")
def g17_correction_flags(t: Tables) -> DataFrame:
    return _verdicts(t).select("request_id", "faithfulness", "relevance", "passed", "crag_required", "crag_priority", "drop_immediately")


@query(f"WITH {_JUDGED} SELECT intent, count(*) AS answers, round(avg(CAST(passed AS INT)), 3) AS pass_rate, round(avg(CAST(crag_required AS INT)), 3) AS trigger_rate, round(avg(faithfulness), 3) AS faithfulness, round(avg(relevance), 3) AS relevance FROM verdict GROUP BY intent")
def e15_pass_rates(t: Tables) -> DataFrame:
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")), 3).alias({"passed": "pass_rate", "crag_required": "trigger_rate"}[c])
    return _verdicts(t).groupBy("intent").agg(F.count("*").alias("answers"), rate("passed"), rate("crag_required"), F.round(F.avg("faithfulness"), 3).alias("faithfulness"), F.round(F.avg("relevance"), 3).alias("relevance"))


_VALID = "(" + ", ".join(f"'{i}'" for i in (*lx.FIRST_INTENTS, *lx.OTHER_INTENTS)) + ")"


@query(f"""WITH {_PRE}, {RESP}, x AS (SELECT request_id, query, {_case(lx.FIRST_INTENTS, 'lower(query)')} AS found, regexp_matches(lower(query), '{lx.COMPARISON_PATTERN}') AS cmp, intent, confidence FROM pre LEFT JOIN resp USING (request_id)),
y AS (SELECT *, CASE WHEN lower(intent) IN {_VALID} THEN lower(intent) ELSE 'general' END AS named, least(1e0, greatest(0e0, coalesce(CASE WHEN isnan(confidence) THEN NULL ELSE confidence END, 0.5e0))) AS conf FROM x)
SELECT request_id, upper(substr(regexp_replace(query, '[.!?\\s]+$', ''), 1, 1)) || substr(regexp_replace(query, '[.!?\\s]+$', ''), 2) || '?' AS normalized, CASE WHEN cmp THEN 'comparison' WHEN conf < 0.75 AND found <> 'general' THEN found ELSE named END AS intent, conf AS intent_confidence FROM y""")
def q09_validated_intent(t: Tables) -> DataFrame:
    """Q08 and Q09: an intent that came with the answer is checked against the known ones, defaults fill gaps, patterns overrule doubt."""
    told = responses_of(t.query_responses).select("request_id", F.col("intent").alias("told"), "confidence")
    q = requests_of(t.query_requests).filter("query is not null").select("request_id", understanding.preprocess(F.col("query")).alias("query")).join(told, "request_id", "left")
    sure = understanding.valid_confidence(F.col("confidence"))
    return q.select("request_id", understanding.normalized(F.col("query")).alias("normalized"), understanding.final_intent(F.col("query"), F.col("told"), sure).alias("intent"), sure.alias("intent_confidence"))


@query(f"""WITH {BASE}, {BM25}, {COS}, {hybrid_sql(15)}, {expand_sql(30, 15)}, kw AS (SELECT wide.*, {_KEYWORD} AS keyword FROM wide JOIN q USING (qid))
SELECT qid, chunk_id, keyword, CAST(row_number() OVER (PARTITION BY qid ORDER BY keyword DESC, chunk_id) AS INT) AS rank FROM kw {best('keyword', 5)}""")
def r17_routed_retrieval(t: Tables) -> DataFrame:
    return retrieval.retrieve(asked(t), docs_of(t), 5, blended=False).select("qid", "chunk_id", "keyword", "rank")


@query(f"""WITH {_VEC}, {_UNIT}, s AS (SELECT q.chunk_id AS qid, list_cosine_similarity(q.e, d.e) AS sim, row_number() OVER (PARTITION BY q.chunk_id ORDER BY round(list_cosine_similarity(q.e, d.e), 6) DESC, d.chunk_id) AS n FROM unit q, unit d WHERE q.n % 100 = 0)
SELECT qid, count(*) AS hits, round(avg(round(sim, 6)), 4) AS mean_similarity FROM s WHERE n <= 10 GROUP BY qid""")
def v09_query_chunk_mean(t: Tables) -> DataFrame:
    unit = vectors.valid(t.chunk_vectors, 96).filter(F.exists("embedding", lambda x: x != 0))
    stated = unit.filter(tx.hex_to_id(F.col("chunk_id")) % 100 == 0).withColumnRenamed("chunk_id", "qid")
    return vectors.nearest_by_blocks(stated, unit, 10).groupBy("qid").agg(F.count("*").alias("hits"), F.round(F.avg("similarity"), 4).alias("mean_similarity"))


@query(f"WITH {PAGE} SELECT page_id, coalesce(raw_text, '') <> coalesce(cleaned_text, '') AS differs, coalesce(used_ocr, false) AS used_ocr FROM page")
def t21_text_differs(t: Tables) -> DataFrame:
    text = lambda c: F.coalesce(c, F.lit(""))
    return pages_of(t.pages).select("page_id", (text("raw_text") != text("cleaned_text")).alias("differs"), F.coalesce("used_ocr", F.lit(False)).alias("used_ocr"))


@query("""WITH e AS (SELECT user_id, event_type, strftime(ts, '%Y-%m-%d') AS run_id, length(coalesce(props, '')) AS bytes FROM events)
SELECT user_id, count(*) AS events, max(bytes) AS max_size, list_sort(list(DISTINCT run_id)) AS run_ids FROM e GROUP BY user_id""")
def m04_trace_sizes(t: Tables) -> DataFrame:
    """A day is a run: the events carry no run ids of their own."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return t.events.groupBy("user_id").agg(F.count("*").alias("events"), F.max(F.length(F.coalesce("props", F.lit("")))).cast("bigint").alias("max_size"), F.sort_array(F.collect_set(day)).alias("run_ids"))


@query(f"""WITH {_HITS}, h AS (SELECT hit.*, coalesce(chunk.insurer, 'Unknown') AS company FROM hit JOIN chunk ON chunk.chunk_id = hit.chunk_id), g AS (SELECT qid, company, max(score) AS best, CAST(sum(length(text)) AS BIGINT) AS chars, count(*) AS chunks FROM h GROUP BY qid, company),
o AS (SELECT *, row_number() OVER w AS pos, sum(chars) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM g WINDOW w AS (PARTITION BY qid ORDER BY best DESC, company)), e AS (SELECT qid, min(pos) AS stop FROM o WHERE used > 4000 GROUP BY qid)
SELECT qid, company, CAST(pos AS INT) AS pos, CAST(used AS BIGINT) AS used, chunks FROM o LEFT JOIN e USING (qid) WHERE stop IS NULL OR pos < stop""")
def x06_company_groups(t: Tables) -> DataFrame:
    """Hits grouped by company, whole groups in order of their best score until the first that would overflow."""
    named = _hits(t).join(chunks_of(t.chunks).select("chunk_id", F.coalesce("insurer", F.lit("Unknown")).alias("company")), "chunk_id")
    groups = named.groupBy("qid", "company").agg(F.max("score").alias("best"), F.sum(F.length("text")).alias("chars"), F.count("*").alias("chunks"))
    return context.within_budget(groups, "qid", [F.desc("best"), "company"], F.col("chars"), 4000, 10**6).select("qid", "company", "pos", "used", "chunks")


@query(f"WITH {_HITS} SELECT qid, chunk_id, substr(text, 1, 400) AS excerpt, score FROM hit {best('score', 5)}")
def x16_diagnostics(t: Tables) -> DataFrame:
    return retrieval.top(_hits(t), 5, "score").select("qid", "chunk_id", F.substring("text", 1, 400).alias("excerpt"), "score")


def _folder(t: Tables, name: str) -> str:
    """A new folder beside the staged tables, for a round trip through files."""
    return f"{shared_dir(t.events.sparkSession)}/written/{name}-{uuid.uuid4().hex}"


_FIELDS = "chunk_id, document_id, insurer, document_type, chunk_type, section, page_number, table_id, row_number, text"


@query(f"WITH {CHUNK} SELECT {_FIELDS} FROM chunk WHERE coalesce(text, '') <> '' OR coalesce(embedding_text, '') <> ''")
def s08_payload_files(t: Tables) -> DataFrame:
    """Chunks written as payload files of lists, read back with their texts."""
    path = _folder(t, "payloads")
    chunks = chunks_of(t.chunks).select(*_FIELDS.split(", "), "embedding_text")
    slots = F.pmod(F.xxhash64("chunk_id"), F.lit(64))
    listed = chunks.groupBy(F.coalesce("document_id", F.concat(F.lit("none-"), slots.cast("string"))).alias("d")).agg(F.to_json(F.struct(F.collect_list(F.struct(*chunks.columns)).alias("chunks"))).alias("value"))
    listed.select("value").write.option("lineSep", "\n").text(f"{path}/lines")
    lines = t.events.sparkSession.read.text(f"{path}/lines")
    got, bad = documents.parse_chunks(lines.withColumn("path", F.col("_metadata.file_path")))
    return got.select(*_FIELDS.split(", "))


@query(f"WITH {CHUNK} SELECT coalesce(insurer, 'none') AS insurer, coalesce(document_type, 'none') AS document_type, count(*) AS chunks, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM chunk GROUP BY ALL")
def s10_partitioned_sink(t: Tables) -> DataFrame:
    """Chunks written by insurer and document type, counted from the files."""
    path = _folder(t, "chunks")
    named = {c: F.coalesce(c, F.lit("none")) for c in ("insurer", "document_type")}
    documents.write_chunks(chunks_of(t.chunks).withColumns(named), path)
    return t.events.sparkSession.read.option("basePath", path).parquet(path).groupBy("insurer", "document_type").agg(F.count("*").alias("chunks"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, count(*) AS events, round(sum(coalesce(value, 0)), 3) AS total_latency FROM events WHERE ts IS NOT NULL GROUP BY user_id")
def s13_trace_files(t: Tables) -> DataFrame:
    """Events appended as JSON lines by session and read back."""
    path = _folder(t, "traces")
    rows = t.events.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), F.lit("run").alias("run_id"), F.col("user_id").cast("string").alias("session_id"), F.col("event_type").alias("node"), F.col("value").alias("latency_ms"))
    documents.append_traces(rows, path, files=16)
    got = documents.read_traces(t.events.sparkSession, path)
    return got.groupBy("session_id").agg(F.count("*").alias("events"), F.round(F.sum(F.coalesce("latency_ms", F.lit(0.0))), 3).alias("total_latency"))
