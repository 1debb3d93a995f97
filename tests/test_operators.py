from collections import Counter

import math

import pytest
from pyspark.sql import functions as F

from docengine.operators import analysis, context, evaluation, lexical, records, retrieval, vectors
from docengine.plans.corrective import corrective_loop
from docengine.plans.staging import discard, exists, small_side, stage, staged_bytes

DOC = "chunk_id string, text string, chunk_type string, table_id string, row_number int, row_part int, section string, page_start int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [("a", "room rent is covered", "clause", None, None, None, "s", 1), ("b", "room rent room", "exclusion", "t1", 1, None, "s", 1),
            ("c", "other words here", "table_row", "t1", 2, None, "s", 1), ("d", "premium", "table_row", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOC)


def queries(spark, *rows):
    return spark.createDataFrame(list(rows), "qid int, qtext string")


def test_latest_record(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new"), ("k", 2, "new"), (None, 3, "x")], "id string, at int, v string")
    assert [tuple(r) for r in records.latest(rows, "id", "at").select("id", "v").collect()] == [("k", "new")]
    assert records.latest(rows.limit(0), "id", "at").count() == 0


def test_bm25_by_hand(spark, docs):
    got = {r.chunk_id: r.bm25 for r in lexical.bm25(queries(spark, (1, "room room zzz")), docs).collect()}
    n, df, avg = 4, 2, (4 + 3 + 3 + 1) / 4
    idf = math.log((n - df + 0.5) / (df + 0.5) + 1)
    part = lambda tf, dl: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (avg + 1e-6)) + 1e-6)
    assert got == {"a": round(2 * part(1, 4), 6), "b": round(2 * part(2, 3), 6)}
    assert lexical.bm25(queries(spark, (1, "zzz")), docs).count() == 0
    assert lexical.bm25(queries(spark, (1, "room")), docs.limit(0)).count() == 0


def test_hybrid_boosts_and_neighbours(spark, docs):
    q = queries(spark, (1, "room rent"))
    hits = {r.chunk_id: r for r in retrieval.hybrid(q, docs, 5).collect()}
    assert hits["b"].boost == 0.28 and hits["a"].boost == 0.12
    wide = {r.chunk_id: r for r in retrieval.with_neighbours(retrieval.hybrid(q, docs, 5), docs, 10, 10).collect()}
    assert wide["c"].expanded == 1 and wide["c"].retrieval_score is None
    assert wide["c"].final_score == pytest.approx(hits["b"].retrieval_score + 0.18)
    assert wide["b"].final_score == pytest.approx(hits["b"].retrieval_score + 0.28)
    got = retrieval.retrieve(q, docs, 5).collect()
    assert len(got) >= 1 and got[0]["rank"] == 1


def test_confidence(spark):
    hits = spark.createDataFrame([(1, 1.0), (2, 1.0), (2, 1.0)], "qid int, final_score double")
    got = {r.qid: r.confidence for r in retrieval.confidence(hits).collect()}
    assert got == {1: round((0.6 / 6 + 0.3 / 6) * 0.7, 3), 2: round(0.9 / 6, 3)}


def test_greedy_dedupe_matches_plain_loop(spark):
    texts = ["a b c d", "a b c d e", "x y z", "x y z w", "q"]
    rows = spark.createDataFrame([(1, f"c{i}", t, 1.0 - i / 10) for i, t in enumerate(texts)], "qid int, chunk_id string, text string, score double")
    kept = []
    for i, t in enumerate(texts):
        w = set(t.split())
        if all(len(w & k) / len(w | k) < 0.65 for _, k in kept):
            kept.append((f"c{i}", w))
    assert {r.chunk_id for r in context.greedy_dedupe(rows).collect()} == {k for k, _ in kept}


def test_compress_budget_and_tags(spark):
    text = "one two three. one two. one. four five six seven. one two three four."
    rows = spark.createDataFrame([(1, "q one two", "c1", text, 0.9)], "qid int, qtext string, chunk_id string, text string, score double")
    full = context.compress(rows).first()
    assert full.text.count(".") == 4 and full.tag.startswith("C_")
    assert context.compress(rows, budget=5).first().tokens <= 5
    answer = spark.createDataFrame([("It is fully covered here [C_1]. This one is not cited. Yes. Fake tag cited here [C_9].", ["C_1"])], "a string, t array<string>")
    report = answer.select(*[c.alias(k) for k, c in context.citation_report(F.col("a"), F.col("t")).items()]).first()
    assert (report.valid, report.invalid) == (1, 1) and 0 < report.citation_coverage < 1
    bare = answer.select(*[c.alias(k) for k, c in context.citation_report(F.lit("Yes."), F.col("t")).items()]).first()
    assert bare.citation_coverage == 1.0


def test_first_overflow_ends_the_context(spark):
    rows = spark.createDataFrame([("g", 1, "aaaa"), ("g", 2, "bbbbbbbb"), ("g", 3, "c")], "g string, o int, t string")
    assert [r.o for r in context.within_budget(rows, "g", ["o"], F.length("t"), 6, 10).collect()] == [1]


def test_metrics_bounds(spark, docs):
    cases = spark.createDataFrame([(1, "room rent covered", "x", ["rent"], True), (2, "nothing alike", "y", None, None)], "qid int, qtext string, case_type string, expected_keywords array<string>, prefers_table boolean")
    hits = evaluation.best_hits(evaluation.strategy_scores(cases, docs))
    got = evaluation.case_metrics(cases, hits, docs).collect()
    assert {r.strategy for r in got} == set(evaluation.STRATEGIES)
    assert all(0 <= r.ndcg_at_5 <= 1 and r.recall_at_5 == 1.0 for r in got if r.qid == 1)


def test_vectors(spark):
    rows = [("C_00000000000000a", [3.0, 4.0]), ("C_b", [0.0, 0.0]), ("C_c", [float("nan"), 1.0]), ("C_d", [1.0]), ("C_e", None), ("C_f", [3.0, 4.0])]
    table = spark.createDataFrame(rows, "chunk_id string, embedding array<float>")
    good = vectors.valid(table, 2)
    assert {r.chunk_id for r in good.collect()} == {"C_00000000000000a", "C_b", "C_f"}
    q = good.filter("chunk_id = 'C_f'").withColumnRenamed("chunk_id", "qid")
    top = vectors.nearest_by_blocks(q, good, 2).orderBy("rank").collect()
    assert [r.chunk_id for r in top] == ["C_00000000000000a", "C_f"] and top[0].similarity == 1.0
    fresh = spark.createDataFrame([("x", "t"), ("x", "t"), ("y", ""), ("z", "t")], "chunk_id string, embedding_text string")
    assert [r.chunk_id for r in vectors.upsert_new(fresh, spark.createDataFrame([("z",)], "chunk_id string")).collect()] == ["x"]
    emb = spark.createDataFrame([("a b a",), ("",)], "t string").select(vectors.hashing_embedding(F.col("t")).alias("e")).collect()
    assert sum(x * x for x in emb[0].e) == pytest.approx(1.0) and sum(emb[1].e) == 0


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:59:59"), (1, "2024-01-01 01:59:59"), (2, "2024-01-01 00:00:00")]
    events = spark.createDataFrame(rows, "u int, s string").select("u", F.to_timestamp("s").alias("ts"))
    got = sorted((r.u, r.events) for r in analysis.session_islands(events, "u", "ts").collect())
    assert got == [(1, 1), (1, 2), (2, 1)]  # a gap of exactly an hour parts sessions
    turns = spark.createDataFrame([("s", i) for i in range(25)], "s string, n int")
    assert analysis.last_turns(turns, "s", ["n"]).count() == 20
    body = spark.createDataFrame([('```json\n{"a": 1}\n```',), ("none",)], "t string").select(F.to_json(analysis.json_part(F.col("t"))).alias("j")).collect()
    assert [r.j for r in body] == ['{"a":1}', None]


def test_corrective_rules(spark):
    """Hard stop, no retryable reason, wide and slight widening."""
    q = queries(spark, (1, "room rent limit"), (2, "bad"), (3, "thin"), (4, "wide"), (5, "slight"))
    hits = lambda a, k: a.crossJoin(spark.range(1, k + 1).withColumnRenamed("id", "rank"))
    rows = {1: (True, 1.0, 1.0, []), 2: (False, 0.1, 0.1, ["low_relevance"]), 3: (False, 0.9, 0.9, ["partial"]), 4: (False, 0.9, 0.1, ["low_relevance: 0.1"]), 5: (False, 0.2, 0.9, ["hallucinated_citation"])}
    table = spark.createDataFrame([(k, *v) for k, v in rows.items()], "qid long, passed boolean, faithfulness double, relevance double, reasons array<string>")
    judge = lambda h: h.groupBy("qid").agg(F.count("*").cast("double").alias("score")).join(table, "qid")
    got = {r.qid: (r.passes, r.passed, r.score) for r in corrective_loop(q, hits, judge).collect()}
    assert got[1] == (1, True, 8.0) and got[2] == (1, False, 8.0) and got[3] == (1, False, 8.0) and got[5] == (3, False, 12.0)
    assert got[4][:2] == (3, False) and got[4][2] >= 24.0


def test_token_scores_against_brute_force(spark, docs, monkeypatch):
    texts = ["the room rent is due", "the premium of the room", None, "", "rent rent rent", "no common word here", "the the the room"]
    table = spark.createDataFrame([(f"c{i}", x) for i, x in enumerate(texts * 4)], "chunk_id string, text string").withColumn("chunk_id", F.concat("chunk_id", F.monotonically_increasing_id().cast("string")))
    q = queries(spark, (1, "the room"), (2, "rent"), (3, None))
    monkeypatch.setattr(lexical, "QUERY_BLOCK", 1)
    every = {(r.qid, r.chunk_id): r.sim for r in lexical.term_cosine(q, table).collect()}
    known = {r.chunk_id: r.text for r in table.collect()}
    for (qid, c), sim in every.items():
        a, b = Counter({1: "the room", 2: "rent"}[qid].split()), Counter(known[c].split())
        assert abs(sim - sum(a[w] * b[w] for w in a) / (sum(n * n for n in a.values()) * sum(n * n for n in b.values())) ** 0.5) < 1e-6
    assert len(every) == sum(bool(set(x.split()) & set(t.split())) for t in known.values() if t for x in ("the room", "rent"))
    top = retrieval.top(lexical.term_cosine(q, table), 2, "sim").select("qid", "chunk_id").collect()
    assert {tuple(r) for r in top} == {tuple(r) for r in retrieval.top(lexical.term_cosine(q, table, best=2), 2, "sim").select("qid", "chunk_id").collect()}
    assert lexical.term_cosine(q.filter("qid = 3"), table).count() == 0 and lexical.bm25(q, table.limit(0)).count() == 0


def test_corrective_loop_stops(spark, docs):
    q = queries(spark, (1, "room rent"), (2, "zzz"))
    judge = lambda hits: hits.groupBy("qid").agg(F.lit(True).alias("passed"), F.lit(1.0).alias("score"))
    got = {r.qid: (r.passes, r.passed) for r in corrective_loop(q, lambda a, k: retrieval.overlap_retriever(a, docs, k), judge).collect()}
    assert got == {1: (1, True), 2: (3, False)}


def test_staging(spark):
    staged = stage(spark.range(10))
    assert staged_bytes(staged) > 0 and staged.count() == 10
    folder = staged.inputFiles()[0].rsplit("/", 1)[0]
    discard(staged)
    assert not exists(spark, folder)
    assert small_side(spark.range(3)).count() == 3
