"""Retrieval strategies scored over all cases and chunks, and their metrics."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import text as tx
from docengine.operators import lexical, understanding
from docengine.plans.staging import ship_with_tasks

ship_with_tasks(__name__)

STRATEGIES = ("naive", "hybrid", "table_aware", "full_agentic")


#: What a record gains for an intent: the record's mark and the amount.
INTENT_GAINS = {"exclusion": ("excl", 0.16), "waiting_period": ("waits", 0.14), "claim": ("claims", 0.14), "premium": ("prem", 0.12), "coverage": ("covers", 0.10)}
MARKS = ("is_table", *[mark for mark, _ in INTENT_GAINS.values()])


def _by_strategy(wants: dict):
    """The four scores of the pairs of a batch, by the wants (prefers_table, intent) of each case; rounding may gain as much as is added."""

    def by(raw, shared, jac, batch, ids):
        prefers, intents = (np.array([wants[i][k] for i in ids.tolist()]) for k in (0, 1))
        base = 0.7 * raw + 0.3 * jac
        tables = base + np.where(prefers[None, :] & batch["is_table"].to_numpy(bool)[:, None], 0.12 * np.minimum(1.0, np.maximum(0.0, base) / 0.5), 0.0)
        full = tables + sum(v * ((intents == intent)[None, :] & batch[mark].to_numpy(bool)[:, None]) for intent, (mark, v) in INTENT_GAINS.items())
        return [(score, 2e-4) for score in (raw, base, tables, full)]

    return by


def strategy_scores(cases: DataFrame, docs: DataFrame, best: int | None = None) -> DataFrame:
    """qid, chunk_id, strategy, score of every case and chunk that share a token, scores rounded to four places.

    With best, pairs that cannot be among the best of their case under any strategy are left out where they are scored.
    """
    low = F.lower("text")
    table = (F.coalesce("table_id", F.lit("")) != "") | F.col("row_number").isNotNull() | F.col("chunk_type").isin("table_row", "table_meta")
    marks = {"is_table": table, "excl": (F.col("chunk_type") == "exclusion") | low.contains("not covered"), "waits": low.contains("waiting"), "claims": low.contains("claim"), "prem": low.contains("premium"), "covers": low.contains("cover") | low.contains("benefit")}
    marked = docs.select("chunk_id", "text", *[F.coalesce(c, F.lit(False)).alias(k) for k, c in marks.items()])
    want = cases.select("qid", F.coalesce("prefers_table", F.lit(False)).alias("prefers_table"), understanding.benchmark_intent(F.col("qtext")).alias("intent"))
    wants = {r["qid"]: (r["prefers_table"], r["intent"]) for r in want.coalesce(1).toLocalIterator()} if best else {}  # the stated cases
    pairs = lexical.term_cosine(cases.select("qid", "qtext"), marked, best=best, by=_by_strategy(wants), columns=MARKS)
    rows = pairs.join(want, "qid").join(marked.drop("text"), "chunk_id")
    base = 0.7 * F.col("raw") + 0.3 * F.col("jac")
    bonus = F.when(F.col("prefers_table") & F.col("is_table"), 0.12 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), base) / 0.5)).otherwise(0.0)
    boost = F.coalesce(*[F.when((F.col("intent") == intent) & F.col(mark), v) for intent, (mark, v) in INTENT_GAINS.items()], F.lit(0.0))
    scores = {"naive": F.col("raw"), "hybrid": base, "table_aware": base + bonus, "full_agentic": base + bonus + boost}
    return rows.select("qid", "chunk_id", F.explode(F.array(*[F.struct(F.lit(s).alias("strategy"), F.round(c, 4).alias("score")) for s, c in scores.items()])).alias("s")).select("qid", "chunk_id", "s.*")


def best_hits(scores: DataFrame, k: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("qid", "strategy").orderBy(F.desc("score"), "chunk_id"))
    return scores.withColumn("rank", rank).filter(F.col("rank") <= k)


def _similar(a: Column, b: Column) -> Column:
    return tx.jaccard(tx.word_set(a), tx.word_set(b))


def case_metrics(cases: DataFrame, hits: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """Per case and strategy: hit rate, reciprocal rank, nDCG against the hits found, answer metrics, clarification."""
    low = F.lower("text")
    relevant = F.exists("expected_keywords", lambda w: F.contains(low, F.lower(w)))
    rows = hits.join(docs.select("chunk_id", "text"), "chunk_id").join(cases, "qid").withColumn("rel", F.coalesce(relevant, F.lit(False)))
    gain = F.when(F.col("rel"), 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)
    n_rel = F.count_if("rel")
    ideal = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(0.0), lambda s, i: s + F.when(i <= F.col("n_rel"), 1 / F.log2(i + 1)).otherwise(0.0))
    first = F.min(F.when(F.col("rel"), F.col("rank")))
    answer = F.concat(F.lit("Relevant policy details: "), F.substring("text", 1, 600))
    got = rows.groupBy("qid", "strategy").agg(
        n_rel.alias("n_rel"), first.alias("first"), F.sum(gain).alias("dcg"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"),
        F.max(F.when(F.col("rank") == 1, F.col("rel").cast("int"))).alias("top_rel"), F.max(F.when(F.col("rank") == 1, _similar(F.col("qtext"), answer))).alias("answer_relevancy"),
        F.avg(F.when(F.col("rank") <= 3, (_similar(F.col("qtext"), F.col("text")) >= 0.3).cast("double"))).alias("context_precision"),
        F.avg((F.col("score") >= 0.2).cast("double")).alias("noise_robustness"))
    return got.select(
        "qid", "strategy", F.when(F.col("n_rel") > 0, 1.0).otherwise(0.0).alias("recall_at_5"), F.round(F.when(F.col("first").isNotNull(), 1 / F.col("first")).otherwise(0.0), 3).alias("mrr"),
        F.round(F.when(F.col("n_rel") > 0, F.least(F.lit(1.0), F.col("dcg") / ideal)).otherwise(0.0), 3).alias("ndcg_at_5"), F.col("top_rel").cast("double").alias("faithfulness"),
        (1 - F.col("top_rel")).cast("double").alias("hallucination"), F.round("answer_relevancy", 3).alias("answer_relevancy"), F.round("context_precision", 3).alias("context_precision"), F.round("noise_robustness", 3).alias("noise_robustness"),
        F.when((F.col("top_score") < 0.2) | (F.col("top_rel") == 0), 1.0).otherwise(0.0).alias("clarification"))


def context_recall(hits: DataFrame, used: DataFrame) -> DataFrame:
    """qid, candidates, relevant, context_recall: the share of relevant hits whose chunk was used, 1 where none is relevant."""
    rows = hits.join(used.select("qid", "chunk_id", F.lit(True).alias("kept")), ["qid", "chunk_id"], "left").withColumn("rel", _similar(F.col("qtext"), F.col("text")) >= 0.3)
    n, kept = F.count_if("rel"), F.count_if(F.col("rel") & F.col("kept").isNotNull())
    return rows.groupBy("qid").agg(F.count("*").alias("candidates"), n.alias("relevant"), F.round(F.when(n == 0, F.lit(1.0)).otherwise(kept / n), 3).alias("context_recall"))


METRICS = ("recall_at_5", "mrr", "ndcg_at_5", "faithfulness", "hallucination", "answer_relevancy", "context_precision", "noise_robustness", "clarification")


def report(metrics: DataFrame) -> DataFrame:
    """Means per strategy."""
    return metrics.groupBy("strategy").agg(F.count("*").alias("cases"), *[F.round(F.avg(m), 3).alias(m) for m in METRICS])
