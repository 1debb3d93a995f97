"""The corrective loop: retrieve, judge, widen or rewrite the failing queries, at most three passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.operators import understanding
from docengine.plans.staging import stage


def _any(*reasons: str) -> Column:
    return F.exists("reasons", lambda r: F.lit(False) if not reasons else r.rlike("^(?:" + "|".join(reasons) + ")"))


def corrective_loop(queries: DataFrame, retrieve: Callable[[DataFrame, int], DataFrame], judge: Callable[[DataFrame], DataFrame], k: int = 8, retries: int = 2) -> DataFrame:
    """qid, passes, passed, score: each query's last pass.

    retrieve(queries, k) gives hits with qid and rank; judge(hits) gives qid, passed, score, and may give faithfulness, relevance and
    reasons. A query without hits has the reason no_supporting_chunks. A query stops when it passes, when faithfulness is below 0.3 and
    relevance below 0.2, or when none of its reasons is retryable. Else its search is widened, by much for lack of relevance or support
    and by little for lack of faithfulness, up to lx.WIDEST hits; once, for lack of relevance or support, its text is rewritten as
    well, unless the rewrite drifts from it, in which case the search is widened again. Only open queries go into the next pass.
    """
    open_queries, done = queries.select("qid", "qtext", F.lit(k).alias("k"), F.lit(False).alias("rewritten")), None
    for n in range(retries + 1):
        hits = retrieve(open_queries.select("qid", "qtext"), min(lx.WIDEST, k + 2 * n * lx.WIDER))
        hits = hits.join(open_queries.select("qid", "k"), "qid").filter(F.col("rank") <= F.col("k"))
        verdicts = judge(hits)
        for name, value in (("faithfulness", F.lit(1.0)), ("relevance", F.col("score")), ("reasons", F.array(F.lit("low_relevance")))):
            if name not in verdicts.columns:
                verdicts = verdicts.withColumn(name, value)
        got = open_queries.join(verdicts.select("qid", "passed", "score", "faithfulness", "relevance", "reasons"), "qid", "left")
        got = got.withColumn("reasons", F.coalesce("reasons", F.array(F.lit("no_supporting_chunks")))).withColumn("passed", F.coalesce("passed", F.lit(False)))
        lost = F.coalesce((F.col("faithfulness") < 0.3) & (F.col("relevance") < 0.2), F.lit(False))
        got = stage(got.withColumn("again", ~F.col("passed") & ~lost & _any(*lx.RETRYABLE)))
        final = got if n == retries else got.filter("not again")
        final = final.select("qid", F.lit(n + 1).alias("passes"), "passed", F.coalesce("score", F.lit(0.0)).alias("score"))
        done = final if done is None else done.unionByName(final)
        if n < retries:
            lacks = _any("low_relevance", "no_supporting_chunks")
            wider = F.when(lacks, lx.WIDER).when(_any("low_faithfulness", "hallucinated_citation"), lx.SLIGHTLY_WIDER).otherwise(0)
            next_pass = got.filter("again").withColumn("new", understanding.rewrite(F.col("qtext"))).withColumn("ratio", understanding.sequence_ratio("qtext", "new"))
            tried = lacks & ~F.col("rewritten")
            taken = tried & (F.col("ratio") >= lx.DRIFT)
            width = F.least(F.lit(lx.WIDEST), F.col("k") + wider + F.when(tried & ~taken, lx.WIDER).otherwise(0))
            open_queries = stage(next_pass.select("qid", F.when(taken, F.col("new")).otherwise(F.col("qtext")).alias("qtext"), width.cast("int").alias("k"), (F.col("rewritten") | taken).alias("rewritten")))
    return done
