"""Lexical, vector, query-understanding and retrieval queries (L*, V*, Q*, R*).

Searches take every request whose request_id is divisible by 100 as a query, against all chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx
from docengine.operators import lexical, retrieval, understanding, vectors
from docengine.operators.records import chunks_of, requests_of
from docengine.queries.registry import Registry, Tables
from docengine.queries.text_queries import CHUNK, once

query = Registry()
REQ = once("query_requests", "request_id", "logged_at", "req")


def docs_of(t: Tables) -> DataFrame:
    """The chunks with text, each once: what every search of a query runs over."""
    return t.staged("_docs", lambda: chunks_of(t.chunks).filter("text <> ''").select("chunk_id", "text", "chunk_type", "table_id", "row_number", "row_part", "section", "page_start"))


def asked(t: Tables) -> DataFrame:
    """The stated query set."""
    return t.staged("_asked", lambda: requests_of(t.query_requests.filter("request_id % 100 = 0")).filter("query is not null").select(F.col("request_id").alias("qid"), F.col("query").alias("qtext")))


_BTOK = "list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')"
_WTOK = "regexp_extract_all(lower({}), '[a-z0-9]+')"
BASE = f"""{CHUNK}, {REQ}, doc AS (SELECT chunk_id, text, chunk_type, table_id, row_number, row_part, section, page_start FROM chunk WHERE text <> ''),
q AS (SELECT request_id AS qid, query AS qtext FROM req WHERE request_id % 100 = 0 AND query IS NOT NULL)"""
BM25 = f"""dt AS (SELECT chunk_id, tok, count(*) AS tf FROM (SELECT chunk_id, unnest({_BTOK.format('text')}) AS tok FROM doc) GROUP BY chunk_id, tok),
df AS (SELECT tok, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM dt GROUP BY tok), tot AS (SELECT count(*) AS n, avg(len({_BTOK.format('text')})) AS avgdl FROM doc),
stats AS (SELECT tok, df, cf, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, tot),
dl AS (SELECT chunk_id, len({_BTOK.format('text')}) AS dl FROM doc), qt AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT qid, unnest({_BTOK.format('qtext')}) AS tok FROM q) GROUP BY qid, tok),
bm AS (SELECT qid, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (avgdl + 1e-6)) + 1e-6)), 6) AS bm25 FROM qt JOIN dt USING (tok) JOIN stats USING (tok) JOIN dl USING (chunk_id), tot GROUP BY qid, chunk_id),
low AS (SELECT qid, CASE WHEN count(*) < (SELECT n FROM tot) THEN 0.0 ELSE min(bm25) END AS lo, max(bm25) AS hi FROM bm GROUP BY qid),
nm AS (SELECT qid, chunk_id, bm25, round((bm25 - lo) / (hi - lo + 1e-6), 6) AS norm FROM bm JOIN low USING (qid))"""
COS = f"""wt AS (SELECT chunk_id, tok, count(*) AS tf FROM (SELECT chunk_id, unnest({_WTOK.format('text')}) AS tok FROM doc) GROUP BY chunk_id, tok),
qw AS (SELECT qid, tok, count(*) AS qtf FROM (SELECT qid, unnest({_WTOK.format('qtext')}) AS tok FROM q) GROUP BY qid, tok),
qn AS (SELECT qid, sqrt(sum(qtf * qtf)) AS qn, count(*) AS qs FROM qw GROUP BY qid), dn AS (SELECT chunk_id, sqrt(sum(tf * tf)) AS dn, count(*) AS ds FROM wt GROUP BY chunk_id),
cs AS (SELECT qid, chunk_id, round(dot / (qn * dn), 6) AS sim, dot / (qn * dn) AS raw, shared, shared / (qs + ds - shared) AS jac FROM (SELECT qid, chunk_id, sum(qtf * tf) AS dot, count(*) AS shared FROM wt JOIN qw USING (tok) GROUP BY qid, chunk_id) JOIN qn USING (qid) JOIN dn USING (chunk_id))"""
_BOOST = "round(CASE chunk_type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in lx.TYPE_BOOST.items()) + " ELSE 0e0 END + CASE WHEN coalesce(table_id, '') <> '' THEN 0.08e0 ELSE 0e0 END, 6)"


def best(score: str, k: int, by: str = "qid") -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY {score} DESC, chunk_id) <= {k}"


def hybrid_sql(k: int) -> str:
    return f"""near AS (SELECT qid, chunk_id, sim FROM cs {best('sim', 3 * k)}),
hits AS (SELECT qid, doc.*, sim, norm, {_BOOST} AS boost, round(0.7 * sim + 0.3 * coalesce(norm, 0.0) + {_BOOST}, 6) AS retrieval_score FROM near JOIN doc USING (chunk_id) LEFT JOIN nm USING (qid, chunk_id))"""


def expand_sql(expand: int, keep: int) -> str:
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY retrieval_score DESC, chunk_id) AS pr FROM hits),
par AS (SELECT * FROM ranked WHERE pr <= {expand}),
emit AS (SELECT qid, chunk_id, pr, 0 AS expanded, retrieval_score, retrieval_score AS fs FROM par UNION ALL
  SELECT p.qid, d.chunk_id, p.pr, 1, CAST(NULL AS DOUBLE), p.retrieval_score FROM par p JOIN doc d ON d.table_id = p.table_id AND d.chunk_id <> p.chunk_id WHERE coalesce(p.table_id, '') <> ''),
uniq AS (SELECT * FROM emit QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY pr, expanded) = 1),
wide AS (SELECT qid, expanded, retrieval_score, doc.*, round(fs + {_BOOST}, 6) AS final_score FROM uniq JOIN doc USING (chunk_id) {best('final_score', keep)})"""


@query(f"WITH {BASE}, {BM25} SELECT tok, df, cf, round(idf, 6) AS idf FROM stats")
def l03_term_stats(t: Tables) -> DataFrame:
    return lexical.term_stats(docs_of(t)).select("tok", "df", "cf", F.round("idf", 6).alias("idf"))


@query(f"WITH {BASE}, {BM25} SELECT qid, chunk_id, bm25 FROM bm {best('bm25', 10)}")
def l05_bm25_topk(t: Tables) -> DataFrame:
    return retrieval.top(lexical.bm25(asked(t), docs_of(t)), 10, "bm25").select("qid", "chunk_id", "bm25")


@query(f"WITH {BASE}, {BM25} SELECT qid, count(*) AS n, round(sum(norm), 3) AS total, max(norm) AS top FROM nm GROUP BY qid")
def l06_bm25_minmax(t: Tables) -> DataFrame:
    docs = docs_of(t)
    scaled = lexical.min_max(lexical.bm25(asked(t), docs), docs.agg(F.count("*").alias("n_docs")))
    return scaled.groupBy("qid").agg(F.count("*").alias("n"), F.round(F.sum("norm"), 3).alias("total"), F.max("norm").alias("top"))


@query(f"WITH {BASE}, {COS} SELECT qid, chunk_id, round(jac, 6) AS jaccard, sim FROM cs {best('sim', 10)}")
def l07_jaccard_cosine(t: Tables) -> DataFrame:
    return retrieval.top(lexical.term_cosine(asked(t), docs_of(t), best=10), 10, "sim").select("qid", "chunk_id", F.round("jac", 6).alias("jaccard"), "sim")


@query(f"WITH {CHUNK} SELECT chunk_id, greatest(1, CAST(floor(len({_BTOK.format('text')}) * 1.3) AS INT)) AS tokens FROM chunk WHERE text IS NOT NULL")
def l09_token_estimate(t: Tables) -> DataFrame:
    return chunks_of(t.chunks).filter("text is not null").select("chunk_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(rf"""WITH {CHUNK}, s AS (SELECT chunk_id, unnest(string_split(regexp_replace(regexp_replace(text, '([.?!])\s+', '\1' || chr(1), 'g'), '\s+\|\s+', chr(1), 'g'), chr(1))) AS s FROM chunk WHERE text IS NOT NULL)
SELECT chunk_id, count(*) AS n, max(length(regexp_replace(s, '^\s+|\s+$', '', 'g'))) AS longest FROM s WHERE regexp_replace(s, '^\s+|\s+$', '', 'g') <> '' GROUP BY chunk_id""")
def l10_sentences(t: Tables) -> DataFrame:
    got = chunks_of(t.chunks).filter("text is not null").select("chunk_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return got.groupBy("chunk_id").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("bigint").alias("longest"))


@query()
def l12_sequence_ratio(t: Tables) -> DataFrame:
    got = requests_of(t.query_requests).filter("query is not null").select("request_id", "query", understanding.rewrite(F.col("query")).alias("rewritten"))
    return got.select("request_id", F.round(understanding.sequence_ratio("query", "rewritten"), 6).alias("ratio"))


_STOP = "[" + ", ".join(f"'{w}'" for w in lx.STOPWORDS) + "]"


@query(f"""WITH {REQ}, resp AS (SELECT * FROM query_responses WHERE request_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY responded_at DESC NULLS LAST) = 1),
k AS (SELECT request_id, list_filter(list_distinct({_WTOK.format("coalesce(query, '')")}), lambda x: NOT list_contains({_STOP}, x)) AS qs, list_distinct({_WTOK.format("coalesce(synthesized_answer, '')")}) AS a FROM req JOIN resp USING (request_id))
SELECT request_id, round(CASE WHEN len(qs) = 0 THEN 0.0 ELSE len(list_intersect(qs, a)) / len(qs) END, 6) AS coverage FROM k WHERE (SELECT count(*) FROM resp r2 WHERE r2.request_id = k.request_id) = 1""")
def l13_stopword_coverage(t: Tables) -> DataFrame:
    from docengine.operators.records import responses_of

    got = requests_of(t.query_requests).select("request_id", "query").join(responses_of(t.query_responses).select("request_id", "synthesized_answer"), "request_id")
    own = F.array_except(tx.word_set(F.col("query")), F.array(*[F.lit(w) for w in lx.STOPWORDS]))
    met = F.size(F.array_intersect(own, tx.word_set(F.col("synthesized_answer"))))
    return got.select("request_id", F.round(F.when(F.size(own) == 0, F.lit(0.0)).otherwise(met / F.size(own)), 6).alias("coverage"))


_VEC = "vec AS (SELECT chunk_id, max(embedding) AS e FROM chunk_vectors WHERE chunk_id IS NOT NULL AND len(embedding) = 96 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 GROUP BY chunk_id)"


@query(f"WITH {_VEC} SELECT chunk_id, round(sqrt(list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS norm FROM vec")
def v01_vector_norms(t: Tables) -> DataFrame:
    return vectors.valid(t.chunk_vectors, 96).select("chunk_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"))


@query(f"""WITH {BASE}, s AS (SELECT chunk_id, list_transform({_WTOK.format('text')}, lambda w: CAST(('0x' || substr(md5(w), 1, 4)) AS INT) % 64) AS slots FROM doc),
c AS (SELECT chunk_id, list_transform(range(0, 64), lambda i: CAST(len(list_filter(slots, lambda x: x = i)) AS DOUBLE)) AS c FROM s), n AS (SELECT chunk_id, c, sqrt(list_sum(list_transform(c, lambda x: x * x))) AS n FROM c)
SELECT chunk_id, list_transform(c, lambda x: round(CASE WHEN n = 0 THEN x ELSE x / n END, 6)) AS embedding FROM n""")
def v01_hashing_embedding(t: Tables) -> DataFrame:
    unit = vectors.hashing_embedding(F.col("text"))
    return docs_of(t).select("chunk_id", F.transform(unit, lambda x: F.round(x, 6)).alias("embedding"))


_ID = "CAST(('0x' || substr(replace(chunk_id, 'C_', ''), 1, 15)) AS BIGINT)"
_UNIT = f"unit AS (SELECT chunk_id, {_ID} AS n, list_transform(e, lambda x: CAST(x AS DOUBLE)) AS e FROM vec WHERE len(list_filter(e, lambda x: x <> 0)) > 0)"


@query(f"""WITH {_VEC}, {_UNIT}, s AS (SELECT q.chunk_id AS qid, d.chunk_id, round(list_cosine_similarity(q.e, d.e), 6) AS similarity FROM unit q, unit d WHERE q.n % 100 = 0)
SELECT qid, chunk_id, similarity, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, chunk_id) AS INT) AS rank FROM s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, chunk_id) <= 10""")
def v02_vector_topk(t: Tables) -> DataFrame:
    unit = vectors.valid(t.chunk_vectors, 96).filter(F.exists("embedding", lambda x: x != 0))
    asked_here = unit.filter(tx.hex_to_id(F.col("chunk_id")) % 100 == 0).withColumnRenamed("chunk_id", "qid")
    return vectors.nearest_by_blocks(asked_here, unit, 10)


@query(f"WITH {CHUNK} SELECT DISTINCT v.chunk_id, coalesce(text, '') AS text, coalesce(chunk_type, 'unknown') AS chunk_type, c.chunk_id IS NOT NULL AS known FROM chunk_vectors v LEFT JOIN chunk c ON v.chunk_id = c.chunk_id")
def v03_payload_fallback(t: Tables) -> DataFrame:
    return vectors.payloads(t.chunk_vectors, chunks_of(t.chunks))


@query(f"WITH {CHUNK} SELECT chunk_id, embedding_text FROM chunk WHERE coalesce(embedding_text, '') <> '' AND chunk_id NOT IN (SELECT chunk_id FROM chunk_vectors WHERE chunk_id IS NOT NULL)")
def v04_upsert_new(t: Tables) -> DataFrame:
    return vectors.upsert_new(chunks_of(t.chunks), t.chunk_vectors.filter("chunk_id is not null"))


@query(f"WITH {CHUNK} SELECT chunk_id, {_ID} AS id FROM chunk")
def v06_hex_ids(t: Tables) -> DataFrame:
    return chunks_of(t.chunks).select("chunk_id", tx.hex_to_id(F.col("chunk_id")).alias("id"))


@query(f"""WITH {CHUNK}, {_VEC}, p AS (SELECT document_id, chunk_id, lag(chunk_id) OVER (PARTITION BY document_id ORDER BY chunk_id) AS before FROM chunk JOIN vec USING (chunk_id) WHERE document_id IS NOT NULL),
c AS (SELECT p.document_id, list_transform(a.e, lambda x: CAST(x AS DOUBLE)) AS x, list_transform(b.e, lambda x: CAST(x AS DOUBLE)) AS y FROM p JOIN vec a ON a.chunk_id = p.chunk_id JOIN vec b ON b.chunk_id = p.before)
SELECT document_id, count(*) AS pairs, round(avg(CASE WHEN list_dot_product(x, x) = 0 OR list_dot_product(y, y) = 0 THEN 0.0 ELSE list_dot_product(x, y) / sqrt(list_dot_product(x, x) * list_dot_product(y, y)) END), 5) AS mean_similarity FROM c GROUP BY document_id""")
def v09_mean_similarity(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    vec = chunks_of(t.chunks).filter("document_id is not null").select("chunk_id", "document_id").join(vectors.valid(t.chunk_vectors, 96), "chunk_id")
    before = F.lag("embedding").over(W.partitionBy("document_id").orderBy("chunk_id"))
    pairs = vec.withColumn("before", before).filter("before is not null")
    return pairs.groupBy("document_id").agg(F.count("*").alias("pairs"), F.round(F.avg(vectors.cosine(F.col("embedding"), F.col("before"))), 5).alias("mean_similarity"))


@query("SELECT count(*) AS vectors, max(len(embedding)) AS dim, count(DISTINCT model_name) AS models FROM chunk_vectors")
def v08_index_stats(t: Tables) -> DataFrame:
    return vectors.index_stats(t.chunk_vectors).select("vectors", F.col("dim").cast("bigint").alias("dim"), "models")


def _case(patterns: dict[str, str], column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{k}'" for k, p in patterns.items()) + " ELSE 'general' END"


_FIX = "qr"
for _wrong, _right in lx.QUERY_FIXES.items():
    _FIX = f"regexp_replace({_FIX}, '{_wrong}', '{_right}', 'gi')"
_PRE = rf"""{REQ}, p0 AS (SELECT request_id, regexp_replace(regexp_replace(query, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g') AS a FROM req WHERE query IS NOT NULL),
p1 AS (SELECT request_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(a, '|', ' '), '•', ' '), '—', '-'), '\?{{2,}}', '?', 'g'), '\.{{2,}}', '.', 'g'), ',{{2,}}', ',', 'g') AS qr FROM p0),
pre AS (SELECT request_id, {_FIX} AS query FROM p1)"""


@query(f"WITH {_PRE} SELECT request_id, query FROM pre")
def q01_query_preprocess(t: Tables) -> DataFrame:
    return requests_of(t.query_requests).filter("query is not null").select("request_id", understanding.preprocess(F.col("query")).alias("query"))


_TALK = " OR ".join(f"starts_with(lower(trim(query)), '{w}')" for w in lx.SMALL_TALK)


@query(f"""WITH {_PRE} SELECT request_id, {_case(lx.FIRST_INTENTS, 'lower(query)')} AS first_intent, {_case(lx.BENCHMARK_INTENTS, 'lower(query)')} AS benchmark_intent, regexp_matches(lower(query), '{lx.COMPARISON_PATTERN}') AS comparison,
({_TALK}) AS small_talk, NOT regexp_matches(lower(query), '{"|".join(lx.OFF_DOMAIN)}') AS in_domain FROM pre""")
def q02_first_intent(t: Tables) -> DataFrame:
    q = requests_of(t.query_requests).filter("query is not null").select("request_id", understanding.preprocess(F.col("query")).alias("query"))
    return q.select(
        "request_id", understanding.first_intent(F.col("query")).alias("first_intent"), understanding.benchmark_intent(F.col("query")).alias("benchmark_intent"),
        understanding.is_comparison(F.col("query")).alias("comparison"), understanding.is_small_talk(F.col("query")).alias("small_talk"), understanding.in_domain(F.col("query")).alias("in_domain"))


_MULTI = ", ".join(f"CASE WHEN regexp_matches(lower(query), '{p}') THEN 1e0 ELSE 0e0 END AS {k}" for k, p in lx.ROUTER_INTENTS.items())


@query(f"WITH {_PRE}, m AS (SELECT request_id, {_MULTI} FROM pre) SELECT *, CASE WHEN exclusion + coverage + claim + premium + waiting_period + definition > 0 THEN 0e0 ELSE 1e0 END AS general FROM m")
def q03_multi_intent(t: Tables) -> DataFrame:
    q = requests_of(t.query_requests).filter("query is not null").select("request_id", understanding.preprocess(F.col("query")).alias("query"))
    return q.select("request_id", *[c.alias(k) for k, c in retrieval.router_intents(F.col("query")).items()])


_NWORDS = "len(list_filter(regexp_split_to_array(query, '\\s+'), lambda x: x <> ''))"


@query(rf"""WITH {_PRE}, f AS (SELECT request_id, query, {_case(lx.FIRST_INTENTS, 'lower(query)')} AS intent FROM pre),
g AS (SELECT *, ends_with(query, '?') AND substr(query, 1, 1) = upper(substr(query, 1, 1)) AND substr(query, 1, 1) <> lower(substr(query, 1, 1)) AND {_NWORDS} >= 6 AND intent <> 'general' AS clean FROM f)
SELECT request_id, clean, CASE WHEN clean THEN 0.98e0 ELSE 0.5e0 END AS intent_confidence, upper(substr(regexp_replace(query, '[.!?\s]+$', ''), 1, 1)) || substr(regexp_replace(query, '[.!?\s]+$', ''), 2) || '?' AS normalized FROM g""")
def q07_clean_query(t: Tables) -> DataFrame:
    q = requests_of(t.query_requests).filter("query is not null").select("request_id", understanding.preprocess(F.col("query")).alias("query"))
    clean = understanding.is_clean(F.col("query"))
    return q.select("request_id", clean.alias("clean"), F.when(clean, 0.98).otherwise(0.5).alias("intent_confidence"), understanding.normalized(F.col("query")).alias("normalized"))


_SYN = "CASE " + " ".join(f"WHEN contains(lower(query), '{k}') THEN query || ' {v}'" for k, v in lx.SYNONYMS.items())


@query(rf"""WITH {REQ}, q AS (SELECT request_id, query, trim(regexp_replace(query, '{lx.QUERY_FILLER}', '', 'gi')) AS bare FROM req WHERE query IS NOT NULL)
SELECT request_id, {_SYN} WHEN bare = query THEN query || ' policy details' ELSE bare END AS rewritten FROM q""")
def q10_rewrite(t: Tables) -> DataFrame:
    return requests_of(t.query_requests).filter("query is not null").select("request_id", understanding.rewrite(F.col("query")).alias("rewritten"))


@query(f"WITH {BASE}, {BM25}, {COS}, {hybrid_sql(10)} SELECT qid, chunk_id, sim, coalesce(norm, 0e0) AS norm, boost, retrieval_score FROM hits {best('retrieval_score', 10)}")
def r03_hybrid_fusion(t: Tables) -> DataFrame:
    hits = retrieval.top(retrieval.hybrid(asked(t), docs_of(t), 10), 10, "retrieval_score")
    return hits.select("qid", "chunk_id", "sim", F.coalesce("norm", F.lit(0.0)).alias("norm"), "boost", "retrieval_score")


@query(f"WITH {BASE}, {BM25}, {COS}, {hybrid_sql(10)}, {expand_sql(20, 10)} SELECT qid, chunk_id, expanded, retrieval_score, final_score FROM wide")
def r06_neighbour_expand(t: Tables) -> DataFrame:
    docs = docs_of(t)
    wide = retrieval.with_neighbours(retrieval.hybrid(asked(t), docs, 10), docs, expand=20, keep=10)
    return wide.select("qid", "chunk_id", "expanded", "retrieval_score", "final_score")


_WANT = {k: f"regexp_matches(lower(qtext), '{p}')" for k, p in lx.ROUTER_INTENTS.items()}
_INTENT = f"""round(CASE WHEN {_WANT['exclusion']} AND chunk_type = 'exclusion' THEN 0.35e0 ELSE 0.0e0 END + CASE WHEN {_WANT['exclusion']} AND contains(lower(text), 'not covered') THEN 0.25e0 ELSE 0.0e0 END
+ CASE WHEN {_WANT['coverage']} AND chunk_type IN ('table_row', 'table_meta') THEN 0.15e0 ELSE 0.0e0 END + CASE WHEN {_WANT['coverage']} AND contains(lower(text), 'covered') THEN 0.10e0 ELSE 0.0e0 END
+ CASE WHEN {_WANT['claim']} AND contains(lower(text), 'claim') THEN 0.25e0 ELSE 0.0e0 END + CASE WHEN {_WANT['premium']} AND contains(lower(text), 'premium') THEN 0.25e0 ELSE 0.0e0 END
+ CASE WHEN {_WANT['waiting_period']} AND contains(lower(text), 'waiting') THEN 0.30e0 ELSE 0.0e0 END, 6)"""
_KEYWORD = f"round(0.1e0 * len(list_filter({_BTOK.format('qtext')}, lambda w: contains(lower(text), w))) + CASE chunk_type " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in lx.RERANK_BOOST.items()) + " ELSE 0e0 END, 6)"


@query(f"""WITH {BASE}, {COS}, near AS (SELECT qid, chunk_id, sim FROM cs {best('sim', 20)})
SELECT qid, chunk_id, {_INTENT} AS intent_boost, {_KEYWORD} AS keyword FROM near JOIN doc USING (chunk_id) JOIN q USING (qid)""")
def r08_intent_boost(t: Tables) -> DataFrame:
    near = retrieval.top(lexical.term_cosine(asked(t), docs_of(t), best=20).select("qid", "chunk_id", "sim"), 20, "sim").join(docs_of(t), "chunk_id").join(asked(t), "qid")
    return near.select(
        "qid", "chunk_id", retrieval.intent_boost(F.col("qtext"), F.col("text"), F.col("chunk_type")).alias("intent_boost"),
        retrieval.keyword_score(F.col("qtext"), F.col("text"), F.col("chunk_type")).alias("keyword"))


@query(f"""WITH {CHUNK}, p AS (SELECT table_id, row_number, row_part, chunk_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS final_score FROM chunk WHERE table_id IS NOT NULL AND row_number IS NOT NULL)
SELECT table_id, row_number, string_agg(text, chr(10) ORDER BY coalesce(row_part, 0), chunk_id) AS text, CAST(max(final_score) AS INT) AS final_score, count(*) AS parts, first(chunk_id ORDER BY coalesce(row_part, 0), chunk_id) AS chunk_id FROM p GROUP BY table_id, row_number""")
def r12_row_reconstruct(t: Tables) -> DataFrame:
    parts = chunks_of(t.chunks).filter("table_id is not null and row_number is not null").withColumn("final_score", F.length(F.coalesce("text", F.lit(""))))
    return retrieval.reconstruct_rows(parts, ["table_id", "row_number"])


_HINT = """concat_ws('|', CASE WHEN coalesce(table_id, '') <> '' THEN 'table_context' END, CASE WHEN chunk_type = 'exclusion' THEN 'high_priority_exclusion' END, CASE WHEN chunk_type = 'clause' THEN 'legal_clause' END, CASE WHEN row_number IS NOT NULL THEN 'row_' || row_number END)"""
FULL = f"""{BASE}, {BM25}, {COS}, {hybrid_sql(15)}, {expand_sql(30, 15)},
kw AS (SELECT wide.*, {_KEYWORD} AS keyword, {_INTENT} AS ib FROM wide JOIN q USING (qid)), rr AS (SELECT * FROM kw {best('keyword', 10)}),
bl AS (SELECT * EXCLUDE (final_score), round(0.9 * coalesce(retrieval_score, 0.0) + 0.1 * ib, 6) AS final_score FROM rr),
rw AS (SELECT qid, table_id, row_number, string_agg(text, chr(10) ORDER BY coalesce(row_part, 0), chunk_id) AS text, max(final_score) AS final_score, first(section ORDER BY coalesce(row_part, 0), chunk_id) AS section, first(page_start ORDER BY coalesce(row_part, 0), chunk_id) AS page_start,
  first(row_part ORDER BY coalesce(row_part, 0), chunk_id) AS row_part, first(chunk_id ORDER BY coalesce(row_part, 0), chunk_id) AS chunk_id, first(chunk_type ORDER BY coalesce(row_part, 0), chunk_id) AS chunk_type FROM bl WHERE coalesce(table_id, '') <> '' AND row_number IS NOT NULL GROUP BY qid, table_id, row_number
  UNION ALL SELECT qid, table_id, row_number, text, final_score, section, page_start, row_part, chunk_id, chunk_type FROM bl WHERE NOT (coalesce(table_id, '') <> '' AND row_number IS NOT NULL)),
pk AS (SELECT qid, table_id, section, page_start, string_agg(text, chr(10) || chr(10) ORDER BY coalesce(row_number, -1), coalesce(row_part, 0), chunk_id) AS text, max(final_score) AS final_score,
  first(chunk_id ORDER BY coalesce(row_number, -1), coalesce(row_part, 0), chunk_id) AS chunk_id, first(chunk_type ORDER BY coalesce(row_number, -1), coalesce(row_part, 0), chunk_id) AS chunk_type,
  first(row_number ORDER BY coalesce(row_number, -1), coalesce(row_part, 0), chunk_id) AS row_number FROM rw GROUP BY qid, table_id, section, page_start),
final AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY final_score DESC, chunk_id) AS INT) AS rank, {_HINT} AS context_hint FROM pk {best('final_score', 5)})"""


@query(f"WITH {FULL} SELECT qid, chunk_id, text, final_score, rank, context_hint FROM final")
def r16_full_retrieval(t: Tables) -> DataFrame:
    return retrieval.retrieve(asked(t), docs_of(t), 5).select("qid", "chunk_id", "text", "final_score", "rank", "context_hint")


@query(f"""WITH {FULL} SELECT qid, round((0.6 * least(greatest(max(final_score) / 6.0, 0.0), 1.0) + 0.3 * least(greatest(avg(final_score) / 6.0, 0.0), 1.0) + 0.1 * least(greatest(2 * stddev_pop(final_score) / 6.0, 0.0), 1.0)) * CASE WHEN count(*) < 2 THEN 0.7 ELSE 1.0 END, 3) AS confidence FROM final GROUP BY qid""")
def r18_retrieval_confidence(t: Tables) -> DataFrame:
    return retrieval.confidence(retrieval.retrieve(asked(t), docs_of(t), 5))


@query(f"WITH {BASE}, {COS} SELECT qid, chunk_id, shared FROM cs {best('shared', 5)}")
def r19_overlap_retriever(t: Tables) -> DataFrame:
    return retrieval.overlap_retriever(asked(t), docs_of(t), 5).select("qid", "chunk_id", "shared")
