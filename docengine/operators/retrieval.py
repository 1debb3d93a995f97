"""Retrieval: fusion, structure boost, neighbours, rerank, blend, row reconstruction, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx
from docengine.operators import lexical
from docengine.plans.staging import small_side


def _table(values: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def round6(score: Column) -> Column:
    """Six places, halves of score * 1e6 away from zero, as in SQL; weighted sums of rounded scores often are halves, where F.round goes by the digits."""
    return F.signum(score) * F.floor(F.abs(score) * 1e6 + 0.5) / 1e6


def structure_boost(kind: Column, table_id: Column) -> Column:
    """By chunk type, and more for records of a table."""
    return F.round(F.coalesce(F.try_element_at(_table(lx.TYPE_BOOST), kind), F.lit(0.0)) + F.when(F.coalesce(table_id, F.lit("")) != "", lx.TABLE_BOOST).otherwise(0.0), 6)


def top(rows: DataFrame, k: int, score: str, by: str = "qid", key: str = "chunk_id", rank: str = "rank") -> DataFrame:
    """The k best rows per query, ties by key."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(by).orderBy(F.desc(score), key))).filter(F.col(rank) <= k)


def hybrid(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Vector candidates (3 k per query) re-scored with normalised BM25 and boosted (R01 - R04): adds sim, norm, boost, retrieval_score."""
    hits = small_side(lexical.nearest_with_norm(queries, docs, 3 * k)).join(docs, "chunk_id")
    boost = structure_boost(F.col("chunk_type"), F.col("table_id"))
    base = lx.VECTOR_WEIGHT * F.col("sim") + lx.BM25_WEIGHT * F.coalesce("norm", F.lit(0.0))
    return hits.withColumn("boost", boost).withColumn("retrieval_score", round6(base + boost))


def with_neighbours(hits: DataFrame, docs: DataFrame, expand: int, keep: int) -> DataFrame:
    """The best `expand` hits and all records of their tables, each record once under its best parent, then the best `keep`.

    A hit's final score is its retrieval score plus its boost; a neighbour's is its parent's retrieval score plus its own boost, and
    it has no retrieval score. A hit that a better hit has brought in as neighbour stays a neighbour.
    """
    best = top(hits, expand, "retrieval_score", rank="parent_rank").select("qid", "chunk_id", "table_id", "parent_rank", "retrieval_score")
    best = small_side(best)
    own = best.select("qid", "chunk_id", "parent_rank", F.lit(0).alias("expanded"), "retrieval_score", F.col("retrieval_score").alias("from_score"))
    tables = best.filter(F.coalesce("table_id", F.lit("")) != "").select("qid", "table_id", "parent_rank", F.col("retrieval_score").alias("from_score"), F.col("chunk_id").alias("parent"))
    kin = docs.select("chunk_id", "table_id").join(tables, "table_id").filter(F.col("chunk_id") != F.col("parent"))
    near = kin.select("qid", "chunk_id", "parent_rank", F.lit(1).alias("expanded"), F.lit(None).cast("double").alias("retrieval_score"), "from_score")
    first = W.partitionBy("qid", "chunk_id").orderBy("parent_rank", "expanded")
    every = small_side(own.unionByName(near).withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")).join(docs, "chunk_id")
    every = every.withColumn("final_score", F.round(F.col("from_score") + structure_boost(F.col("chunk_type"), F.col("table_id")), 6))
    return top(every, keep, "final_score").drop("from_score", "parent_rank")


def router_intents(text: Column) -> dict[str, Column]:
    """1.0 for each intent whose pattern is met, general if none (Q03)."""
    low = F.lower(text)
    hits = {k: low.rlike(p) for k, p in lx.ROUTER_INTENTS.items()}
    any_hit = None
    for h in hits.values():
        any_hit = h if any_hit is None else any_hit | h
    return {k: F.when(h, 1.0).otherwise(0.0) for k, h in hits.items()} | {"general": F.when(any_hit, 0.0).otherwise(1.0)}


def intent_boost(query: Column, text: Column, kind: Column) -> Column:
    """What a record gains from the query's intents."""
    want, low = router_intents(query), F.lower(text)
    has = lambda w: F.contains(low, F.lit(w))
    add = lambda intent, cond, v: F.when((want[intent] > 0) & cond, v).otherwise(0.0)
    return F.round(
        add("exclusion", kind == "exclusion", 0.35) + add("exclusion", has("not covered"), 0.25) + add("coverage", kind.isin("table_row", "table_meta"), 0.15)
        + add("coverage", has("covered"), 0.10) + add("claim", has("claim"), 0.25) + add("premium", has("premium"), 0.25) + add("waiting_period", has("waiting"), 0.30), 6)


def keyword_score(query: Column, text: Column, kind: Column) -> Column:
    """0.1 for each query word that the text holds, also inside words, and the type's boost."""
    low = F.lower(text)
    words = F.size(F.filter(tx.blank_tokens(query), lambda w: F.contains(low, w)))
    return F.round(0.1 * words + F.coalesce(F.try_element_at(_table(lx.RERANK_BOOST), kind), F.lit(0.0)), 6)


def context_hint() -> Column:
    """What a packed record says of itself."""
    return F.concat_ws(
        "|", F.when(F.coalesce("table_id", F.lit("")) != "", "table_context"), F.when(F.col("chunk_type") == "exclusion", "high_priority_exclusion"),
        F.when(F.col("chunk_type") == "clause", "legal_clause"), F.when(F.col("row_number").isNotNull(), F.concat(F.lit("row_"), "row_number")))


def reconstruct_rows(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of one table row in order as one record: text by line, greatest score, other fields of the first part."""
    order = F.struct(F.coalesce("row_part", F.lit(0)).alias("p"), F.col("chunk_id"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    return parts.groupBy(*keys).agg(text.alias("text"), F.max("final_score").alias("final_score"), F.min_by("chunk_id", order).alias("chunk_id"), F.count("*").alias("parts"))


def pack_related(rows: DataFrame) -> DataFrame:
    """Records of one table, section and page as one, by row and part; missing fields are alike."""
    order = F.struct(F.coalesce("row_number", F.lit(-1)).alias("r"), F.coalesce("row_part", F.lit(0)).alias("p"), F.col("chunk_id"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "\n\n")
    first = lambda c: F.min_by(c, order).alias(c)
    return rows.groupBy("qid", "table_id", "section", "page_start").agg(text.alias("text"), F.max("final_score").alias("final_score"), first("chunk_id"), first("chunk_type"), first("row_number"))


def whole_rows(rows: DataFrame) -> DataFrame:
    """Parts of one table row that a query met as one record, everything else as it is (R12 in the path of R16)."""
    part = (F.coalesce("table_id", F.lit("")) != "") & F.col("row_number").isNotNull()
    order = F.struct(F.coalesce("row_part", F.lit(0)).alias("p"), F.col("chunk_id"))
    first = lambda c: F.min_by(c, order).alias(c)
    fields = ("section", "page_start", "row_part", "chunk_id", "chunk_type")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order.alias("o"), F.col("text").alias("t")))), lambda x: x["t"]), "\n")
    made = rows.filter(part).groupBy("qid", "table_id", "row_number").agg(text.alias("text"), F.max("final_score").alias("final_score"), *[first(c) for c in fields])
    return made.unionByName(rows.filter(~part).select(*made.columns))


def retrieve(queries: DataFrame, docs: DataFrame, k: int = 5, blended: bool = True) -> DataFrame:
    """The whole path: fusion over 9 k vector candidates, neighbours, rerank of the best 2 k, blend, whole rows, packing, best k.

    With blended=False the path ends after the rerank: best k by keyword (R17).
    """
    wide = with_neighbours(hybrid(queries, docs, 3 * k), docs, expand=6 * k, keep=3 * k).drop("rank").join(queries, "qid")
    scored = wide.withColumn("keyword", keyword_score(F.col("qtext"), F.col("text"), F.col("chunk_type")))
    if not blended:
        return top(scored, k, "keyword")
    picked = top(scored, 2 * k, "keyword").drop("rank")
    hybrid_part = F.coalesce("retrieval_score", F.lit(0.0))
    a, b, c = lx.FINAL_WEIGHTS
    blend = (a + b) * hybrid_part + c * intent_boost(F.col("qtext"), F.col("text"), F.col("chunk_type"))
    packed = pack_related(whole_rows(picked.withColumn("final_score", round6(blend))))
    return top(packed, k, "final_score").withColumn("context_hint", context_hint())


def confidence(hits: DataFrame, score: str = "final_score", scale: float = 6.0) -> DataFrame:
    """qid, confidence: greatest, mean and spread of the scores, each scaled and clipped, less with a single hit."""
    n = lambda x: F.least(F.greatest(x / scale, F.lit(0.0)), F.lit(1.0))
    raw = 0.6 * n(F.max(score)) + 0.3 * n(F.avg(score)) + 0.1 * n(2 * F.stddev_pop(score))
    return hits.groupBy("qid").agg(F.round(raw * F.when(F.count("*") < 2, 0.7).otherwise(1.0), 3).alias("confidence"))


def overlap_retriever(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """Records by the number of query tokens they share, at least one, best k."""
    found = lexical.term_cosine(queries, docs, best=k, by=lexical.BY_SHARED).select("qid", "chunk_id", "shared")
    return top(found, k, "shared")
