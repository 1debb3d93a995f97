"""Retrieval writes what it keeps of each query, not a row for each pair of query and document."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from docengine.operators import lexical, retrieval
from docengine.plans.staging import _own_dir, release

DOC = "chunk_id string, text string, chunk_type string, table_id string, row_number int, row_part int, section string, page_start int"
N_DOCS, N_QUERIES = 900, 40
SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    dice = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    rows = [(f"C_{i:04d}", "the " + " ".join(dice.choices(words, k=dice.randint(1, 12))), dice.choice(["clause", "exclusion", "table_row"]), f"t{i // 3}" if i % 2 else None, i % 3, None, f"s{i % 4}", i % 5) for i in range(N_DOCS)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def queries(spark):
    dice = random.Random(8)
    return spark.createDataFrame([(i, "the " + " ".join(dice.choices([f"w{j}" for j in range(60)], k=4))) for i in range(N_QUERIES)], "qid int, qtext string")


def largest_staged(spark):
    """Rows of the largest table staged and kept since the last release."""
    root = spark._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return max(spark.read.parquet(f.getPath().toString()).count() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root))


def by_pairs(queries, docs, best):
    """What the scan is to give, from a row for each pair."""
    near = retrieval.top(lexical.term_cosine(queries, docs).select("qid", "chunk_id", "sim"), best, "sim").drop("rank")
    scaled = lexical.min_max(lexical.bm25(queries, docs), docs.agg(F.count("*").alias("n_docs")))
    return sorted((r.qid, r.chunk_id, r.sim, r.norm) for r in near.join(scaled.select("qid", "chunk_id", "norm"), ["qid", "chunk_id"], "left").collect())


def test_hybrid_stages_no_row_for_each_pair(spark, queries, docs):
    release(spark)
    assert retrieval.hybrid(queries, docs, 2).count() == N_QUERIES * 6
    assert largest_staged(spark) <= N_QUERIES * 6


def test_nearest_with_norm_against_all_pairs(spark, queries, docs, monkeypatch):
    monkeypatch.setattr(lexical, "HELD_BLOCK", 7)
    monkeypatch.setattr(lexical, "DOC_BLOCK", 50)
    odd = [("x1", None), ("x2", ""), ("x3", "the-the the."), ("x4", "?!"), *[(f"y{i:02d}", "w1 w2") for i in range(80)]]
    table = docs.select("chunk_id", "text").unionByName(spark.createDataFrame(odd, "chunk_id string, text string"))
    asked = queries.unionByName(spark.createDataFrame([(90, "w1 w2"), (91, None), (92, "?!"), (93, "zzz"), (94, "w1, w2, W1 the."), (95, "")], "qid int, qtext string"))
    for t in (table, docs.select("chunk_id", "text")):  # the second has "the" in all documents, so that the least score counts
        got = sorted((r.qid, r.chunk_id, r.sim, r.norm) for r in lexical.nearest_with_norm(asked, t, 5).collect())
        assert got == by_pairs(asked, t, 5)
    assert lexical.nearest_with_norm(asked, table.limit(0), 5).count() == 0
    assert lexical.nearest_with_norm(asked.limit(0), table, 5).count() == 0


def test_halves_are_rounded_as_in_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    pairs = [(s / 1e6, n / 1e6) for s in range(400_001, 401_000, 7) for n in range(700_001, 700_400, 9)]
    got = spark.createDataFrame(pairs, "s double, n double").select(retrieval.round6(0.7 * F.col("s") + 0.3 * F.col("n") + F.lit(0.0))).collect()
    frame = {"s": [s for s, _ in pairs], "n": [n for _, n in pairs]}
    want = duckdb.execute("SELECT round(0.7 * s + 0.3 * n + 0e0, 6) FROM (SELECT unnest($s::DOUBLE[]) AS s, unnest($n::DOUBLE[]) AS n)", frame).fetchall()
    assert [r[0] for r in got] == [w for w, in want]


@pytest.mark.parametrize("name", ["r16_full_retrieval", "r18_retrieval_confidence", "r06_neighbour_expand", "r17_routed_retrieval"])
def test_queries_stage_no_row_for_each_pair(spark, name):
    """Of 8 queries and 2,469 documents, 11,476 pairs have a token in common."""
    duckdb = pytest.importorskip("duckdb")
    release(spark)
    df = __spark_entry__.queries()[name](spark, SMALL)
    got = sorted(repr(tuple(r)) for r in df.collect())
    assert largest_staged(spark) <= 2500
    for f in os.listdir(SMALL):
        duckdb.execute(f"CREATE OR REPLACE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    want = duckdb.sql(f"SELECT {', '.join(df.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert got == sorted(map(repr, want))
