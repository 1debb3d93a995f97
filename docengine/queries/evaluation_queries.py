"""Context, evaluation, analysis, session and trace queries (G*, E*, X*, M*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx
from docengine.plans.corrective import corrective_loop
from docengine.operators import analysis, context, evaluation, lexical, retrieval
from docengine.operators.records import chunks_of, requests_of, responses_of
from docengine.queries.registry import Registry, Tables
from docengine.queries.retrieval_queries import _BTOK, _WTOK, BASE, COS, REQ, asked, best, docs_of
from docengine.queries.text_queries import CHUNK, once

query = Registry()
RESP = once("query_responses", "request_id", "responded_at", "resp")


def cases_of(t: Tables) -> DataFrame:
    return t.eval_items.filter("text is not null").select(F.col("item_id").alias("qid"), F.col("text").alias("qtext"), "case_type", "expected_keywords", "prefers_table")


def _hits(t: Tables, k: int = 20) -> DataFrame:
    near = retrieval.top(lexical.term_cosine(asked(t), docs_of(t), best=k).select("qid", "chunk_id", F.col("sim").alias("score")), k, "score").drop("rank")
    return near.join(docs_of(t).select("chunk_id", "text"), "chunk_id").join(asked(t), "qid")


_HITS = f"{BASE}, {COS}, hit AS (SELECT qid, chunk_id, sim AS score, text, qtext FROM (SELECT qid, chunk_id, sim FROM cs {best('sim', 20)}) JOIN doc USING (chunk_id) JOIN q USING (qid))"
_POOL = rf"""{_HITS}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS idx FROM hit),
sp AS (SELECT qid, qtext, chunk_id, idx, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), '\s+\|\s+', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS ss FROM rk),
se AS (SELECT qid, qtext, chunk_id, idx, unnest(ss) AS sentence, generate_subscripts(ss, 1) AS i FROM sp),
po AS (SELECT *, len(list_intersect(list_distinct({_WTOK.format('sentence')}), list_distinct({_WTOK.format('qtext')}))) AS overlap, greatest(1, CAST(floor(len({_BTOK.format('sentence')}) * 1.3) AS INT)) AS tokens FROM se),
pp AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY overlap DESC, idx, i) AS INT) AS pos FROM po),
pool AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_id ORDER BY pos) AS nc FROM pp)"""


@query()
def g01_greedy_dedupe(t: Tables) -> DataFrame:
    return context.greedy_dedupe(_hits(t)).select("qid", "chunk_id", "score")


@query(f"WITH {_POOL} SELECT qid, chunk_id, pos, sentence, CAST(overlap AS INT) AS overlap, tokens FROM pool")
def g02_sentence_pool(t: Tables) -> DataFrame:
    return context.sentence_pool(_hits(t)).select("qid", "chunk_id", "pos", "sentence", "overlap", "tokens")


_USED = f"{_POOL}, used AS (SELECT qid, chunk_id, string_agg(sentence, ' ' ORDER BY pos) AS text, CAST(sum(tokens) AS BIGINT) AS tokens, min(pos) AS first_pos, 'C_' || substr(md5(chunk_id), 1, 8) AS tag FROM pool WHERE nc <= 4 GROUP BY qid, chunk_id)"


@query(f"WITH {_USED} SELECT * FROM used")
def g05_compress(t: Tables) -> DataFrame:
    return context.compress(_hits(t))


@query(f"""WITH {_POOL}, c AS (SELECT *, coalesce(sum(CASE WHEN nc <= 4 THEN tokens ELSE 0 END) OVER (PARTITION BY qid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM pool),
e AS (SELECT qid, min(pos) AS stop FROM c WHERE before + tokens > 200 AND before > 0 GROUP BY qid)
SELECT c.qid, chunk_id, string_agg(sentence, ' ' ORDER BY pos) AS text, CAST(sum(tokens) AS BIGINT) AS tokens, min(pos) AS first_pos, 'C_' || substr(md5(chunk_id), 1, 8) AS tag FROM c LEFT JOIN e USING (qid) WHERE nc <= 4 AND (stop IS NULL OR pos < stop) GROUP BY c.qid, chunk_id""")
def g04_compress_budget(t: Tables) -> DataFrame:
    return context.compress(_hits(t), budget=200)


@query(f"""WITH {_USED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_pos) AS n FROM used)
SELECT qid, string_agg(text || ' [' || tag || ']', ' ' ORDER BY n) FILTER (WHERE n <= 4) AS answer FROM r GROUP BY qid""")
def g09_extractive_answer(t: Tables) -> DataFrame:
    return context.extractive_answer(context.compress(_hits(t))).select("qid", "answer")


_SENT = r"""list_filter(list_transform(string_split(regexp_replace(replace(regexp_replace(regexp_replace({t}, '^\s+|\s+$', '', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1) || '[C_', ' [C_'), '(\])\s+(\p{{Lu}})', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"""
_TAGS = r"list_distinct(regexp_extract_all({t}, '\[(C_[0-9A-Za-z]+)\]', 1))"
_FACT = r"list_filter({s}, lambda x: len(list_filter(regexp_split_to_array(lower(regexp_replace(x, '\[C_[0-9A-Za-z]+\]', '', 'g')), '\s+'), lambda w: w <> '')) >= 4)"


@query(f"""WITH {_USED}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first_pos) AS n FROM used), an AS (SELECT qid, string_agg(text || ' [' || tag || ']', ' ' ORDER BY n) FILTER (WHERE n <= 4) AS answer, list(tag) AS ctx FROM r GROUP BY qid),
y AS (SELECT qid, ctx, {_TAGS.format(t='answer')} AS cited, {_FACT.format(s=_SENT.format(t='answer'))} AS facts FROM an)
SELECT qid, CAST(len(list_intersect(cited, ctx)) AS INT) AS valid, CAST(len(list_filter(cited, lambda c: NOT list_contains(ctx, c))) AS INT) AS invalid, CAST(len(facts) AS INT) AS factual,
round(CASE WHEN len(facts) = 0 THEN 1e0 ELSE len(list_filter(facts, lambda f: len(list_intersect({_TAGS.format(t='f')}, ctx)) > 0)) / len(facts) END, 3) AS citation_coverage FROM y""")
def g12_citation_coverage(t: Tables) -> DataFrame:
    made = context.extractive_answer(context.compress(_hits(t)))
    return made.select("qid", *[c.alias(k) for k, c in context.citation_report(F.col("answer"), F.col("context_tags")).items()])


@query(rf"""WITH {RESP}, x AS (SELECT request_id, list_distinct(regexp_extract_all(coalesce(synthesized_answer, ''), '\[(C_[0-9A-Za-z]+)\]', 1)) AS cited, list_transform(coalesce(sources, []), lambda s: s) AS ctx FROM resp)
SELECT request_id, len(cited) AS cited, len(list_intersect(cited, ctx)) AS valid FROM x""")
def g11_citation_tags(t: Tables) -> DataFrame:
    cited = F.array_distinct(tx.tags(F.col("synthesized_answer")))
    known = F.coalesce("sources", F.array().cast("array<string>"))
    return responses_of(t.query_responses).select("request_id", F.size(cited).cast("bigint").alias("cited"), F.size(F.array_intersect(cited, known)).cast("bigint").alias("valid"))


_CASE = "CASE " + " ".join(f"WHEN regexp_matches(lower(qtext), '{p}') THEN '{k}'" for k, p in lx.BENCHMARK_INTENTS.items()) + " ELSE 'general' END"
_JAC = "CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) END"
_SCORES = f"""{CHUNK}, doc AS (SELECT chunk_id, text, chunk_type, table_id, row_number FROM chunk WHERE text <> ''),
kase AS (SELECT item_id AS qid, text AS qtext, case_type, expected_keywords, coalesce(prefers_table, false) AS prefers_table, {_CASE.replace('qtext', 'text')} AS intent FROM eval_items WHERE text IS NOT NULL), q AS (SELECT qid, qtext FROM kase), {COS},
flag AS (SELECT chunk_id, coalesce(table_id, '') <> '' OR row_number IS NOT NULL OR chunk_type IN ('table_row', 'table_meta') AS is_table, chunk_type = 'exclusion' OR contains(lower(text), 'not covered') AS excl, contains(lower(text), 'waiting') AS waits,
  contains(lower(text), 'claim') AS claims, contains(lower(text), 'premium') AS prem, contains(lower(text), 'cover') OR contains(lower(text), 'benefit') AS covers FROM doc),
b AS (SELECT qid, chunk_id, raw, 0.7e0 * raw + 0.3e0 * jac AS base, CASE WHEN prefers_table AND is_table THEN 0.12e0 * least(1e0, greatest(0e0, 0.7e0 * raw + 0.3e0 * jac) / 0.5e0) ELSE 0e0 END AS bonus,
  CASE WHEN intent = 'exclusion' AND excl THEN 0.16e0 WHEN intent = 'waiting_period' AND waits THEN 0.14e0 WHEN intent = 'claim' AND claims THEN 0.14e0 WHEN intent = 'premium' AND prem THEN 0.12e0 WHEN intent = 'coverage' AND covers THEN 0.10e0 ELSE 0e0 END AS boost
  FROM cs JOIN kase USING (qid) JOIN flag USING (chunk_id)),
sc AS (SELECT qid, chunk_id, 'naive' AS strategy, round(raw, 4) AS score FROM b UNION ALL SELECT qid, chunk_id, 'hybrid', round(base, 4) FROM b UNION ALL SELECT qid, chunk_id, 'table_aware', round(base + bonus, 4) FROM b UNION ALL SELECT qid, chunk_id, 'full_agentic', round(base + bonus + boost, 4) FROM b),
hits AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid, strategy ORDER BY score DESC, chunk_id) AS INT) AS rank FROM sc QUALIFY row_number() OVER (PARTITION BY qid, strategy ORDER BY score DESC, chunk_id) <= 5)"""
_METRICS = f"""{_SCORES}, rows AS (SELECT h.*, qtext, case_type, coalesce(len(list_filter(expected_keywords, lambda w: contains(lower(text), lower(w)))) > 0, false) AS rel, list_distinct({_WTOK.format('qtext')}) AS qs, list_distinct({_WTOK.format('text')}) AS ts,
  list_distinct({_WTOK.format("'Relevant policy details: ' || substr(text, 1, 600)")}) AS ans FROM hits h JOIN doc USING (chunk_id) JOIN kase USING (qid)),
g AS (SELECT qid, strategy, case_type, count_if(rel) AS n_rel, min(CASE WHEN rel THEN rank END) AS first, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0e0 END) AS dcg, max(CASE WHEN rank = 1 THEN score END) AS top_score, max(CASE WHEN rank = 1 THEN CAST(rel AS INT) END) AS top_rel,
  max(CASE WHEN rank = 1 THEN {_JAC.format(a='qs', b='ans')} END) AS arel, avg(CASE WHEN rank <= 3 THEN CAST({_JAC.format(a='qs', b='ts')} >= 0.3 AS INT) END) AS cprec, avg(CAST(score >= 0.2 AS INT)) AS noise FROM rows GROUP BY qid, strategy, case_type),
m AS (SELECT qid, strategy, case_type, CASE WHEN n_rel > 0 THEN 1e0 ELSE 0e0 END AS recall_at_5, round(CASE WHEN first IS NOT NULL THEN 1 / first ELSE 0e0 END, 3) AS mrr,
  round(CASE WHEN n_rel > 0 THEN least(1e0, dcg / (SELECT sum(CASE WHEN i <= n_rel THEN 1 / log2(i + 1) ELSE 0e0 END) FROM range(1, 6) r(i))) ELSE 0e0 END, 3) AS ndcg_at_5, CAST(top_rel AS DOUBLE) AS faithfulness, CAST(1 - top_rel AS DOUBLE) AS hallucination,
  round(arel, 3) AS answer_relevancy, round(cprec, 3) AS context_precision, round(noise, 3) AS noise_robustness, CASE WHEN top_score < 0.2 OR top_rel = 0 THEN 1e0 ELSE 0e0 END AS clarification FROM g)"""


@query(f"WITH {_SCORES} SELECT qid, strategy, chunk_id, score, rank FROM hits")
def e07_strategy_scores(t: Tables) -> DataFrame:
    return evaluation.best_hits(evaluation.strategy_scores(cases_of(t), docs_of(t), 5)).select("qid", "strategy", "chunk_id", "score", F.col("rank").cast("int").alias("rank"))


def _metrics(t: Tables) -> DataFrame:
    return evaluation.case_metrics(cases_of(t), evaluation.best_hits(evaluation.strategy_scores(cases_of(t), docs_of(t), 5)), docs_of(t))


@query(f"WITH {_METRICS} SELECT * EXCLUDE (case_type) FROM m")
def e11_retrieval_metrics(t: Tables) -> DataFrame:
    return _metrics(t)


_MEANS = ", ".join(f"round(avg({m}), 3) AS {m}" for m in evaluation.METRICS)


@query(f"WITH {_METRICS} SELECT strategy, count(*) AS cases, {_MEANS} FROM m GROUP BY strategy")
def e14_strategy_report(t: Tables) -> DataFrame:
    return evaluation.report(_metrics(t))


@query(f"WITH {_METRICS} SELECT case_type, " + ", ".join(f"round(avg(CASE WHEN strategy = '{s}' THEN ndcg_at_5 END), 3) AS {s}" for s in evaluation.STRATEGIES) + " FROM m GROUP BY case_type")
def e14_category_pivot(t: Tables) -> DataFrame:
    typed = _metrics(t).join(cases_of(t).select("qid", "case_type"), "qid")
    return typed.groupBy("case_type").pivot("strategy", list(evaluation.STRATEGIES)).agg(F.round(F.avg("ndcg_at_5"), 3))


_BIAS = " + ".join(f"CAST(contains(lower(synthesized_answer), '{w}') AS INT)" for w in lx.BIAS_TERMS)


@query(f"WITH {RESP} SELECT coalesce(intent, 'none') AS intent, count(*) AS answers, round(avg(confidence), 3) AS confidence, round(avg(least(1e0, ({_BIAS}) / 3)), 3) AS bias FROM resp WHERE synthesized_answer IS NOT NULL GROUP BY ALL")
def e15_scorecard(t: Tables) -> DataFrame:
    hits = sum((F.contains(F.lower("synthesized_answer"), F.lit(w)).cast("int") for w in lx.BIAS_TERMS), F.lit(0))
    got = responses_of(t.query_responses).filter("synthesized_answer is not null")
    return got.groupBy(F.coalesce("intent", F.lit("none")).alias("intent")).agg(
        F.count("*").alias("answers"), F.round(F.avg("confidence"), 3).alias("confidence"), F.round(F.avg(F.least(F.lit(1.0), hits / 3)), 3).alias("bias"))


def _slot(name: str, cond: str) -> str:
    return f"coalesce(arg_max(text, chunk_id) FILTER (WHERE {cond}), 'not mentioned') AS {name}"


def _words(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"


_WAIT = _words(("waiting period", "ped"))
_PROFILE = ", ".join(_slot(k, _words(v)) for k, v in lx.PROFILE_SLOTS.items()) + ", " + _slot("ped_waiting", f"{_WAIT} AND contains(lower(text), 'pre-existing')") + ", " + _slot("specific_waiting", f"{_WAIT} AND NOT contains(lower(text), 'pre-existing')")


@query(f"WITH {CHUNK} SELECT insurer, {_PROFILE}, CAST(count_if({_words(('exclusion', 'not payable'))}) AS BIGINT) AS exclusions FROM chunk WHERE text IS NOT NULL GROUP BY insurer")
def x01_policy_profile(t: Tables) -> DataFrame:
    return analysis.profiles(chunks_of(t.chunks).filter("text is not null"), "insurer", ["chunk_id"])


@query(f"""WITH {CHUNK}, r AS (SELECT document_id, chunk_id, length(text) AS n, row_number() OVER w AS pos, sum(length(text)) OVER (w ROWS UNBOUNDED PRECEDING) AS used FROM chunk WHERE text <> '' AND document_id IS NOT NULL WINDOW w AS (PARTITION BY document_id ORDER BY page_number NULLS FIRST, chunk_id)),
e AS (SELECT document_id, min(pos) AS stop FROM r WHERE used > 1500 GROUP BY document_id)
SELECT document_id, chunk_id, CAST(pos AS INT) AS pos, CAST(used AS BIGINT) AS used FROM r LEFT JOIN e USING (document_id) WHERE (stop IS NULL OR pos < stop) AND pos <= 10""")
def x03_char_budget_context(t: Tables) -> DataFrame:
    rows = chunks_of(t.chunks).filter("text <> '' and document_id is not null")
    return context.within_budget(rows, "document_id", ["page_number", "chunk_id"], F.length("text"), 1500, 10).select("document_id", "chunk_id", "pos", "used")


@query(f"""WITH {CHUNK}, x AS (SELECT insurer, chunk_id, chunk_type = 'exclusion' AS excl, length(text) AS n FROM chunk WHERE text IS NOT NULL)
SELECT insurer, chunk_id, excl, CAST(row_number() OVER (PARTITION BY insurer ORDER BY excl DESC, n DESC, chunk_id) AS INT) AS rank FROM x QUALIFY row_number() OVER (PARTITION BY insurer ORDER BY excl DESC, n DESC, chunk_id) <= 8""")
def x05_exclusion_first(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    rows = chunks_of(t.chunks).filter("text is not null").select("insurer", "chunk_id", (F.col("chunk_type") == "exclusion").alias("excl"), F.length("text").alias("n"))
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("insurer").orderBy(F.desc("excl"), F.desc("n"), "chunk_id")))
    return ranked.filter("rank <= 8").select("insurer", "chunk_id", "excl", "rank")


@query(f"WITH {CHUNK} SELECT document_id, list_sort(list(DISTINCT page_number) FILTER (WHERE page_number IS NOT NULL)) AS pages FROM chunk WHERE document_id IS NOT NULL GROUP BY document_id HAVING count(page_number) > 0")
def x09_source_pages(t: Tables) -> DataFrame:
    got = chunks_of(t.chunks).filter("document_id is not null and page_number is not null")
    return got.groupBy("document_id").agg(F.sort_array(F.collect_set("page_number")).alias("pages"))


@query()
def x14_entity_index(t: Tables) -> DataFrame:
    found = analysis.mentions(chunks_of(t.chunks).filter("text is not null"), "chunk_id")
    return analysis.entity_index(analysis.distinct_mentions(found, "chunk_id"), "chunk_id")


@query(rf"""WITH {CHUNK}, m AS (SELECT chunk_id, unnest(regexp_extract_all(text, '\b([A-Z]{{2}}-[0-9]{{3,5}})\b', 1)) AS mention FROM chunk WHERE text IS NOT NULL)
SELECT lower(mention) AS entity, count(DISTINCT chunk_id) AS records, min(chunk_id) AS first_record FROM m GROUP BY lower(mention)""")
def x13_file_numbers(t: Tables) -> DataFrame:
    found = analysis.mentions(chunks_of(t.chunks).filter("text is not null"), "chunk_id").filter("label = 'FILE'")
    return analysis.entity_index(analysis.distinct_mentions(found, "chunk_id"), "chunk_id").drop("label")


@query(f"WITH {REQ} SELECT session_id, request_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY requested_at DESC NULLS LAST, request_id DESC) AS INT) AS back FROM req WHERE session_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY requested_at DESC NULLS LAST, request_id DESC) <= 20")
def m01_last_turns(t: Tables) -> DataFrame:
    return analysis.last_turns(requests_of(t.query_requests).filter("session_id is not null"), "session_id", ["requested_at", "request_id"]).select("session_id", "request_id", "back")


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS us, event_id FROM events), n AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) < 3600000000 THEN 0 ELSE 1 END AS new FROM e),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM n) SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS events FROM i GROUP BY user_id, island""")
def m02_session_islands(t: Tables) -> DataFrame:
    return analysis.session_islands(t.events, "user_id", "ts").drop("island")


@query(f"WITH {REQ}, {RESP} SELECT request_id, session_id FROM req WHERE request_id NOT IN (SELECT request_id FROM resp)")
def m03_unanswered(t: Tables) -> DataFrame:
    return requests_of(t.query_requests).join(responses_of(t.query_responses).select("request_id"), "request_id", "left_anti").select("request_id", "session_id")


@query("SELECT user_id, event_type, count(*) AS n, round(sum(coalesce(value, 0)), 3) AS total_latency, round(avg(coalesce(value, 0)), 3) AS mean_latency, CAST(count_if(event_type = 'error') AS BIGINT) AS errors, max(coalesce(value, 0)) AS max_latency FROM events GROUP BY user_id, event_type")
def m04_trace_summary(t: Tables) -> DataFrame:
    return analysis.trace_summary(t.events)


@query(f"WITH {REQ} SELECT md5(query) AS key, count(*) AS asked, count(*) - 1 AS hits FROM req WHERE query IS NOT NULL GROUP BY md5(query)")
def m06_prompt_cache(t: Tables) -> DataFrame:
    return analysis.prompt_cache(requests_of(t.query_requests).filter("query is not null"), "query")


@query()
def m08_json_extract(t: Tables) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    return t.events.select("event_id", F.to_json(analysis.json_part(fenced)).alias("body")).filter("body is not null")


@query()
def g18_corrective_loop(t: Tables) -> DataFrame:
    """Overlap retrieval, judged by the mean share of query tokens that the hits hold."""
    docs = docs_of(t)

    def judge(hits: DataFrame) -> DataFrame:
        own = F.size(tx.word_set(F.col("qtext")))
        score = F.avg(F.col("shared") / F.greatest(own, F.lit(1)))
        return hits.groupBy("qid").agg(F.round(score, 6).alias("score")).select("qid", (F.col("score") >= 0.6).alias("passed"), "score")

    found = lambda q, k: retrieval.overlap_retriever(q, docs, k).join(q, "qid")
    return corrective_loop(asked(t), found, judge)


@query(f"""WITH {_HITS}, r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS n FROM hit)
SELECT qid, count(*) AS hits, max(score) AS best, round(avg(score), 3) AS mean, min(score) AS worst, round(max(CASE WHEN n = 1 THEN score END) - max(CASE WHEN n = 2 THEN score END), 3) AS gap FROM r GROUP BY qid""")
def g19_retrieval_stats(t: Tables) -> DataFrame:
    return context.retrieval_stats(_hits(t))


@query(f"WITH {_HITS} SELECT qid, chunk_id, score FROM hit WHERE score >= 0.35 {best('score', 10)}")
def x04_relevance_cut(t: Tables) -> DataFrame:
    return retrieval.top(_hits(t).filter("score >= 0.35"), 10, "score").select("qid", "chunk_id", "score")


@query(rf"WITH {REQ} SELECT request_id, regexp_replace(coalesce(session_id, 'anonymous'), '[^A-Za-z0-9_.-]', '_', 'g') AS session FROM req")
def l14_session_slug(t: Tables) -> DataFrame:
    return requests_of(t.query_requests).select("request_id", F.regexp_replace(F.coalesce("session_id", F.lit("anonymous")), r"[^A-Za-z0-9_.-]", "_").alias("session"))


@query(f"WITH {CHUNK} SELECT insurer, count(*) AS chunks, CAST(sum(greatest(1, CAST(floor(len({_BTOK.format('text')}) * 1.3) AS INT))) AS BIGINT) AS tokens FROM chunk WHERE text IS NOT NULL GROUP BY insurer")
def e16_token_cost(t: Tables) -> DataFrame:
    return chunks_of(t.chunks).filter("text is not null").groupBy("insurer").agg(F.count("*").alias("chunks"), F.sum(tx.token_estimate(F.col("text"))).alias("tokens"))


@query(f"WITH {CHUNK}, {once('chunk_vectors', 'chunk_id', 'model_name', 'v')} SELECT insurer, chunk_type, count(*) AS chunks, count(v.chunk_id) AS indexed FROM chunk LEFT JOIN v ON v.chunk_id = chunk.chunk_id GROUP BY ROLLUP (insurer, chunk_type)")
def c14_index_coverage(t: Tables) -> DataFrame:
    """Chunks and indexed chunks by insurer and type, with subtotals."""
    known = t.chunk_vectors.select("chunk_id").distinct().withColumn("has", F.lit(1))
    return chunks_of(t.chunks).join(known, "chunk_id", "left").rollup("insurer", "chunk_type").agg(F.count("*").alias("chunks"), F.count("has").alias("indexed"))
