"""Context compression, extractive answers, citations, reflection and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx


def greedy_dedupe(hits: DataFrame, threshold: float = lx.COMPRESS_JACCARD) -> DataFrame:
    """Hits in order of score, without those that are near a hit kept before (G01). A query has a bounded list of hits."""
    listed = hits.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("neg"), "chunk_id", tx.word_set(F.col("text")).alias("w")))).alias("l"))
    none = F.filter("l", lambda x: F.lit(False))
    kept = F.aggregate("l", none, lambda acc, x: F.when(F.exists(acc, lambda y: tx.jaccard(y["w"], x["w"]) >= threshold), acc).otherwise(F.concat(acc, F.array(x))))
    return listed.select("qid", F.explode(kept).alias("k")).select("qid", "k.chunk_id").join(hits, ["qid", "chunk_id"])


def sentence_pool(hits: DataFrame) -> DataFrame:
    """Sentences of each hit with the number of query tokens they share, numbered from the best."""
    order = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")).alias("idx")
    ranked = hits.select("qid", "qtext", "chunk_id", "text", "score", order)
    said = ranked.select("qid", "qtext", "chunk_id", "idx", F.posexplode(tx.sentences(F.col("text"))).alias("i", "sentence"))
    overlap = F.size(F.array_intersect(tx.word_set(F.col("sentence")), tx.word_set(F.col("qtext"))))
    pool = said.withColumn("overlap", overlap).withColumn("tokens", tx.token_estimate(F.col("sentence")))
    pool = pool.withColumn("pos", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("overlap"), "idx", "i")).cast("int"))
    return pool.withColumn("n_in_chunk", F.row_number().over(W.partitionBy("qid", "chunk_id").orderBy("pos")).cast("int"))


def compress(hits: DataFrame, per_chunk: int = lx.COMPRESS_SENTENCES, budget: int | None = None) -> DataFrame:
    """qid, chunk_id, tag, text, tokens: the chosen sentences of each chunk in order of choice.

    Without a budget all sentences within per_chunk stay. With one, sentences are taken up to the first that would overflow it, the
    first one always; a sentence beyond per_chunk costs nothing but can end the choice.
    """
    pool = sentence_pool(hits)
    cost = F.when(F.col("n_in_chunk") <= per_chunk, F.col("tokens")).otherwise(0)
    before = F.coalesce(F.sum(cost).over(W.partitionBy("qid").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pool = pool.withColumn("over", (before + F.col("tokens") > F.lit(budget)) & (before > 0)) if budget else pool.withColumn("over", F.lit(False))
    end = F.min(F.when(F.col("over"), F.col("pos"))).over(W.partitionBy("qid"))
    used = pool.withColumn("end", end).filter((F.col("end").isNull() | (F.col("pos") < F.col("end"))) & (F.col("n_in_chunk") <= per_chunk))
    parts = F.sort_array(F.collect_list(F.struct("pos", "sentence")))
    return used.groupBy("qid", "chunk_id").agg(F.array_join(F.transform(parts, lambda x: x["sentence"]), " ").alias("text"), F.sum("tokens").alias("tokens"), F.min("pos").alias("first_pos")).withColumn("tag", tag(F.col("chunk_id")))


def tag(chunk_id: Column) -> Column:
    return F.concat(F.lit("C_"), F.substring(F.md5(chunk_id), 1, 8))


def extractive_answer(used: DataFrame, n: int = 4) -> DataFrame:
    """qid, answer: the first n used chunks, each with its tag."""
    parts = F.slice(F.sort_array(F.collect_list(F.struct("first_pos", F.concat("text", F.lit(" ["), "tag", F.lit("]")).alias("t")))), 1, n)
    return used.groupBy("qid").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("answer"), F.sort_array(F.collect_list("tag")).alias("context_tags"))


def citation_report(answer: Column, context_tags: Column) -> dict[str, Column]:
    """Tags, those in and out of the context, factual sentences and the share of them that is cited."""
    cited = F.array_distinct(tx.tags(answer))
    bare = lambda s: F.regexp_replace(s, r"\[C_[0-9A-Za-z]+\]", "")
    factual = F.filter(tx.cited_sentences(answer), lambda s: F.size(tx.blank_tokens(bare(s))) >= 4)
    covered = F.filter(factual, lambda s: F.size(F.array_intersect(tx.tags(s), context_tags)) > 0)
    return {
        "valid": F.size(F.array_intersect(cited, context_tags)), "invalid": F.size(F.array_except(cited, context_tags)), "factual": F.size(factual),
        "citation_coverage": F.round(F.when(F.size(factual) == 0, F.lit(1.0)).otherwise(F.size(covered) / F.size(factual)), 3),
    }


def verdict(faithfulness: Column, relevance: Column, completeness: Column, coverage: Column, top_score: Column) -> dict[str, Column]:
    """Whether an answer passes, and why not (G15 - G17); a low best score is a reason but no failure."""
    v = lx.VERDICT
    fails = [F.when(faithfulness < v["faithfulness"], F.lit("low_faithfulness")), F.when(relevance < v["relevance"], F.lit("low_relevance")),
             F.when(completeness < v["completeness"], F.lit("low_completeness")), F.when(coverage < v["coverage"], F.lit("low_coverage"))]
    failed = F.array_compact(F.array(*fails))
    return {"passed": F.size(failed) == 0, "reasons": F.concat(failed, F.array_compact(F.array(F.when(top_score < v["top_score"], F.lit("low_retrieval")))))}


def correction(faithfulness: Column, relevance: Column, coverage: Column, invalid: Column, nothing_used: Column) -> dict[str, Column]:
    """Whether a corrective pass is due, for what first, and whether an answer is to be dropped at once."""
    v = lx.VERDICT
    low_rel, low_faith = relevance < v["relevance"], faithfulness < v["faithfulness"]
    return {
        "crag_required": low_rel | low_faith | invalid | (coverage < v["coverage"]), "crag_priority": F.when(low_rel, "low_relevance").when(low_faith | invalid, "low_faithfulness"),
        "drop_immediately": (relevance < 0.05) & (faithfulness < 0.05) & (coverage < 0.1) & nothing_used,
    }


def context_block(used: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, block, tokens_used, dropped, compression_ratio: a line [tag] (type, page n): text for each used chunk.

    used carries chunk_type and page_start; a query has a bounded list of hits.
    """
    line = F.concat(F.lit("["), "tag", F.lit("] ("), F.coalesce("chunk_type", F.lit("unknown")), F.lit(", page "), F.coalesce(F.col("page_start").cast("string"), F.lit("?")), F.lit("): "), "text")
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first_pos", line.alias("line")))), lambda x: x["line"]), "\n")
    blocks = used.groupBy("qid").agg(lines.alias("block"), F.sum("tokens").alias("tokens_used"), F.count("*").alias("used"))
    got = blocks.join(hits.groupBy("qid").agg(F.count("*").alias("candidates")), "qid")
    return got.select("qid", "block", "tokens_used", (F.col("candidates") - F.col("used")).alias("dropped"), _ratio().alias("compression_ratio"))


def _ratio() -> Column:
    return F.round(F.col("used") / F.greatest(F.lit(1), "candidates"), 2)


def single_pass(used: DataFrame, hits: DataFrame, n: int = 4) -> DataFrame:
    """qid, faithfulness, relevance, confidence, compression_ratio of the answer made of the first n used chunks.

    faithfulness is the share of the answer's words that the context holds, relevance that of the question's words in the answer.
    """
    texts = F.transform(F.sort_array(F.collect_list(F.struct("first_pos", "text"))), lambda x: x["text"])
    made = used.groupBy("qid").agg(texts.alias("texts"), F.count("*").alias("used"))
    asked = hits.groupBy("qid").agg(F.first("qtext").alias("qtext"), F.count("*").alias("candidates"), F.max("score").alias("top"))
    words = made.join(asked, "qid").select("qid", "used", "candidates", "top", tx.word_set(F.array_join(F.slice("texts", 1, n), " ")).alias("a"), tx.word_set(F.array_join("texts", " ")).alias("c"), tx.word_set(F.col("qtext")).alias("q"))
    share = lambda part, whole: F.round(F.when(F.size(part) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(part, whole)) / F.size(part)), 3)
    judged = words.withColumns({"faithfulness": share("a", "c"), "relevance": share("q", "a")})
    sure = 0.4 * F.col("faithfulness") + 0.3 * F.col("relevance") + 0.3 * F.least(F.lit(1.0), "top")
    return judged.select("qid", "faithfulness", "relevance", F.round(sure, 3).alias("confidence"), _ratio().alias("compression_ratio"))


def retrieval_stats(hits: DataFrame) -> DataFrame:
    """Per query the number of hits, their scores and the gap between the first two."""
    n = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "chunk_id"))
    place = lambda k: F.max(F.when(F.col("n") == k, F.col("score")))
    return hits.withColumn("n", n).groupBy("qid").agg(
        F.count("*").alias("hits"), F.max("score").alias("best"), F.round(F.avg("score"), 3).alias("mean"), F.min("score").alias("worst"), F.round(place(1) - place(2), 3).alias("gap"))


def within_budget(rows: DataFrame, by: str, order: list, size: Column, budget: int, most: int) -> DataFrame:
    """The first rows per group until one would overflow the budget, at most `most`."""
    w = W.partitionBy(by).orderBy(*order)
    run = rows.withColumn("pos", F.row_number().over(w)).withColumn("used", F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0)))
    end = F.min(F.when(F.col("used") > budget, F.col("pos"))).over(W.partitionBy(by))
    return run.withColumn("end", end).filter((F.col("end").isNull() | (F.col("pos") < F.col("end"))) & (F.col("pos") <= most)).drop("end")
