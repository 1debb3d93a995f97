"""Dense vectors: checks, norms, exact search, ids, hashing embeddings, incremental upsert."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import text as tx
from docengine.plans.staging import ship_with_tasks

ship_with_tasks(__name__)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(0.0)).otherwise(dot(a, b) / n)


def valid(vectors: DataFrame, size: int) -> DataFrame:
    """Vectors of the given size with finite values."""
    ok = (F.size("embedding") == size) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38))
    return vectors.filter("chunk_id is not null").filter(ok).groupBy("chunk_id").agg(F.max("embedding").alias("embedding"))


def nearest_by_blocks(queries: DataFrame, vectors: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """qid, chunk_id, similarity, rank: exact inner product of unit vectors, top k per query.

    The stated query set is cut into blocks, each block goes once to every partition of the vectors, and a partition gives its best k only.
    """
    context = vectors.sparkSession.sparkContext
    total, found = queries.count(), None
    for part in range(max(1, -(-total // block))):
        own = queries.filter(F.pmod(F.xxhash64("qid"), F.lit(-(-total // block) or 1)) == part).select("qid", "embedding").toPandas()
        shared = context.broadcast((own["qid"].to_numpy(), np.array(own["embedding"].tolist(), np.float64)))
        hits = vectors.mapInPandas(_best(shared, k), "qid string, chunk_id string, similarity double")
        found = hits if found is None else found.unionByName(hits)
    rank = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("similarity"), "chunk_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def _best(shared, k: int):
    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        if not len(ids):
            return
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        best_so_far = None
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            sim = np.round(q @ x.T, 6)
            names = batch["chunk_id"].to_numpy()
            cut = np.partition(sim, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(sim), -2.0)
            row, col = np.nonzero(sim >= cut[:, None])  # ties at the cut stay, the rank below settles them
            found = pd.DataFrame({"qid": row, "chunk_id": names[col], "similarity": sim[row, col]})
            if best_so_far is not None:
                found = pd.concat([best_so_far, found])
            found = found.sort_values(["qid", "similarity", "chunk_id"], ascending=[True, False, True], kind="stable")
            best_so_far = found[found.groupby("qid").cumcount() < k]
        if best_so_far is not None:
            yield best_so_far.assign(qid=ids[best_so_far["qid"].to_numpy()])

    return best


def hashing_embedding(text: Column, size: int = 64) -> Column:
    """Unit vector of token counts by hashed position: the default where no model is plugged in."""
    slots = F.transform(tx.word_tokens(text), lambda w: F.pmod(F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"), F.lit(size)))
    count = lambda held: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.size(F.filter(held, lambda s: s == i)).cast("double"))
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x))
    unit = lambda c: tx.once(length(c), lambda n: F.when(n == 0, c).otherwise(F.transform(c, lambda x: x / n)))
    return tx.once(tx.once(slots, count), unit)


def index_stats(vectors: DataFrame) -> DataFrame:
    """vectors, dim, models."""
    return vectors.agg(F.count("*").alias("vectors"), F.max(F.size("embedding")).alias("dim"), F.count_distinct("model_name").alias("models"))


def upsert_new(chunks: DataFrame, indexed: DataFrame, text: str = "embedding_text") -> DataFrame:
    """chunk_id and text of records not indexed yet, each id once (V04); a second run over its own result adds nothing."""
    fresh = chunks.filter(F.coalesce(F.col(text), F.lit("")) != "").join(indexed.select("chunk_id"), "chunk_id", "left_anti")
    return fresh.groupBy("chunk_id").agg(F.max(text).alias(text))


def payloads(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each vector's chunk, with a stand-in record for an unknown id."""
    known = chunks.select("chunk_id", "text", "chunk_type", F.lit(True).alias("known"))
    got = vectors.select("chunk_id").distinct().join(known, "chunk_id", "left")
    return got.select("chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("chunk_type", F.lit("unknown")).alias("chunk_type"), F.coalesce("known", F.lit(False)).alias("known"))
