"""Most similar vectors for every vector (problem 2): learned partitions in two levels.

On a bounded sample, the neighbour graph is cut into balanced partitions and a small classifier learns to name a vector's
partition; inside each partition the same is done again on a sample of its own vectors, so that the number of partitions grows
with the number of vectors. Every vector is indexed in its most probable partition, every query is sent to the same number of
most probable ones at every size, and each partition is searched exactly, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from docengine.plans.staging import ship_with_tasks, small_side, stage

ship_with_tasks(__name__)

FIT_ROWS = 8000  # vectors that the first graph and classifier are fitted on, at most
PART_FIT_ROWS = 4000  # vectors that the graph and classifier inside a partition are fitted on, at most
PART_ROWS = 384  # vectors of a partition of the second level, aimed at
MAX_PARTS = 128  # partitions of the first level, and of the second inside one of the first, at most
BLOCK = 1024  # members of one search task at most (in expectation); a partition with more is cut
QUERY_BLOCK = 4096  # queries of one search task at most (in expectation)
PROBES = 6  # partitions that a query is sent to
ROUTES = 4  # partitions of the first level among which they are


def usable(vectors: DataFrame, size: int) -> DataFrame:
    """chunk_id, vec (unit length): vectors of the given size with finite values that are not all zero, each chunk_id once."""
    finite = F.forall("embedding", lambda x: F.coalesce(x.between(-3.4e38, 3.4e38) & ~F.isnan(x), F.lit(False)))
    good = vectors.filter(F.col("chunk_id").isNotNull() & (F.size("embedding") == size) & finite & F.exists("embedding", lambda x: x != 0))
    once = good.groupBy("chunk_id").agg(F.max("embedding").alias("embedding"))

    def scale(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                raw = np.stack(batch["embedding"].to_numpy()).astype(np.float64)
                unit = (raw / np.linalg.norm(raw / np.abs(raw).max(1, keepdims=True), axis=1, keepdims=True) / np.abs(raw).max(1, keepdims=True)).astype(np.float32)
                yield pd.DataFrame({"chunk_id": batch["chunk_id"], "vec": [v.tobytes() for v in unit]})

    return once.mapInPandas(scale, "chunk_id string, vec binary")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(len(column), -1)


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1000):
        sim = x[a : a + 1000] @ x.T
        sim[np.arange(len(sim)), np.arange(a, a + len(sim))] = -2
        out[a : a + 1000] = np.argpartition(-sim, k, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, rounds: int = 6) -> np.ndarray:
    """A part for each vertex of the neighbour graph: halves along principal axes first, then moves to the part of most
    neighbours while no part exceeds its capacity."""
    label = np.zeros(len(x), np.int64)
    queue, used = [(np.arange(len(x)), parts)], 0
    while queue:
        rows, n = queue.pop()
        if n == 1 or len(rows) < 2:
            label[rows] = used
            used += 1
            continue
        centred = x[rows] - x[rows].mean(0)
        axis = np.linalg.svd(centred[: min(len(rows), 2000)], full_matrices=False)[2][0]
        order = rows[np.argsort(centred @ axis, kind="stable")]
        cut = len(rows) * (n // 2) // n
        queue += [(order[:cut], n // 2), (order[cut:], n - n // 2)]
    capacity = int(1.15 * len(x) / parts) + 1
    load = np.bincount(label, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1)
        np.add.at(votes, (near.ravel(), np.repeat(label, near.shape[1])), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), label]
        for v in np.argsort(-gain, kind="stable"):
            if gain[v] <= 0:
                break
            if load[best[v]] < capacity:
                load[label[v]] -= 1
                load[best[v]] += 1
                label[v] = best[v]
    return label


def fit_router(x: np.ndarray, near: np.ndarray, label: np.ndarray, parts: int, epochs: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Weights of a softmax classifier whose targets are the shares of each part among a vector and its neighbours."""
    target = np.zeros((len(x), parts), np.float32)
    np.add.at(target, (np.repeat(np.arange(len(x)), near.shape[1]), label[near].ravel()), 1.0)
    target[np.arange(len(x)), label] += 2.0
    target /= target.sum(1, keepdims=True)
    rng = np.random.default_rng(7)
    weight = np.stack([x[label == p].mean(0) if (label == p).any() else x.mean(0) for p in range(parts)], 1).astype(np.float32) * 8
    bias = np.zeros(parts, np.float32)
    m, v, t = np.zeros_like(weight), np.zeros_like(weight), 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for rows in np.array_split(order, max(1, len(x) // 256)):
            score = x[rows] @ weight + bias
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = (p - target[rows]) / len(rows)
            grad, t = x[rows].T @ error, t + 1
            m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
            weight -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            bias -= 0.5 * error.sum(0)
    # the classifier places the rows, so its biases are shifted until no part takes much more than its share
    for _ in range(40):
        load = np.bincount((x @ weight + bias).argmax(1), minlength=parts) / (len(x) / parts)
        if load.max() <= 1.25:
            break
        bias -= np.float32(0.3) * np.log(np.clip(load, 0.5, 4.0)).astype(np.float32)
    return weight, bias


def fit_parts(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of the classifier over the balanced parts of the neighbour graph of x."""
    parts = max(1, min(parts, len(x) // 4))
    if parts == 1:
        return np.zeros((x.shape[1], 1), np.float32), np.zeros(1, np.float32)
    near = _neighbours(x, min(10, len(x) - 1))
    return fit_router(x, near, balanced_parts(x, near, parts), parts)


def _shares(x: np.ndarray, weight: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logarithms of the classifier's probabilities."""
    score = x @ weight + bias
    score -= score.max(1, keepdims=True)
    return score - np.log(np.exp(score).sum(1, keepdims=True))


def _routes(x: np.ndarray, first: tuple[np.ndarray, np.ndarray], inner: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The PROBES most probable partitions of each row, most probable first; -1 where there are no more."""
    starts = np.concatenate([[0], np.cumsum([len(b) for _, b in inner])])
    top = _shares(x, *first)
    best = np.argsort(-top, axis=1, kind="stable")[:, :ROUTES]
    wide = max(len(b) for _, b in inner)
    score = np.full((len(x), best.shape[1], wide), -np.inf, np.float32)
    part = np.full(score.shape, -1, np.int32)
    for p, (weight, bias) in enumerate(inner):
        row, col = np.nonzero(best == p)
        if len(row):
            score[row, col, : len(bias)] = top[row, p][:, None] + _shares(x[row], weight, bias)
            part[row, col, : len(bias)] = starts[p] + np.arange(len(bias))
    score, part = score.reshape(len(x), -1), part.reshape(len(x), -1)
    order = np.argsort(-score, axis=1, kind="stable")[:, :PROBES]
    return np.take_along_axis(part, order, 1)


def _fit(units: DataFrame, rows: int) -> tuple[tuple[np.ndarray, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """The classifier of the first level, fitted here on a bounded sample, and those inside its partitions, fitted in one task each."""
    wanted = -(-rows // PART_ROWS)
    sample = units.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(FIT_ROWS).select("vec").toPandas()
    first = fit_parts(_matrix(sample["vec"]), min(MAX_PARTS, int(np.ceil(wanted**0.5))))
    parts = len(first[1])

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"chunk_id": batch["chunk_id"], "vec": batch["vec"], "part": _shares(_matrix(batch["vec"]), *first).argmax(1).astype(np.int32)})

    named = units.mapInPandas(name, "chunk_id string, vec binary, part int")
    counts = {r["part"]: r["n"] for r in named.groupBy("part").agg(F.count("*").alias("n")).collect()}  # at most MAX_PARTS rows
    some = W.partitionBy("part").orderBy(F.xxhash64("chunk_id"), "chunk_id")
    drawn = named.withColumn("i", F.row_number().over(some)).filter(F.col("i") <= PART_FIT_ROWS)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        weight, bias = fit_parts(_matrix(group.sort_values("chunk_id")["vec"]), min(MAX_PARTS, -(-counts[part] // PART_ROWS)))
        return pd.DataFrame({"part": [part], "weight": [weight.astype(np.float32).tobytes()], "bias": [bias.astype(np.float32).tobytes()]})

    # one bounded row per partition of the first level
    fitted = {r["part"]: (np.frombuffer(r["weight"], np.float32), np.frombuffer(r["bias"], np.float32)) for r in drawn.groupBy("part").applyInPandas(fit, "part int, weight binary, bias binary").collect()}
    size = first[0].shape[0]
    none = (np.zeros(size, np.float32), np.zeros(1, np.float32))
    return first, [(w.reshape(size, -1), b) for w, b in (fitted.get(p, none) for p in range(parts))]


def _search(k: int):
    def search(group: pd.DataFrame) -> pd.DataFrame:
        own = group[group["member"]].sort_values("chunk_id")
        ask = pd.concat([group[~group["member"]], own[own["asks"]]])
        if not len(own) or not len(ask):
            return pd.DataFrame({"chunk_id": [], "neighbour": [], "similarity": []})
        names, x = own["chunk_id"].to_numpy(), _matrix(own["vec"])
        who, y = ask["chunk_id"].to_numpy(), _matrix(ask["vec"])
        at = {c: i for i, c in enumerate(names)}
        self_at = np.fromiter((at.get(c, -1) for c in who), np.int64, len(who))
        found = []
        for a in range(0, len(who), 512):
            sim, own_at = y[a : a + 512] @ x.T, self_at[a : a + 512]
            inside = np.nonzero(own_at >= 0)[0]
            sim[inside, own_at[inside]] = -3
            # all that may be among the k nearest: a float32 margin below the k-th similarity, then exact in float64
            least = np.partition(sim, len(names) - k, axis=1)[:, len(names) - k] - np.float32(1e-5) if len(names) > k else np.full(len(sim), -2, np.float32)
            row, col = np.nonzero((sim >= least[:, None]) & (sim > -2))
            exact = np.einsum("nd,nd->n", y[a + row].astype(np.float64), x[col].astype(np.float64))
            order = np.lexsort((col, -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            keep = rank < k
            found.append((who[a + row[keep]], names[col[keep]], exact[keep]))
        return pd.DataFrame({n: np.concatenate([f[i] for f in found]) for i, n in enumerate(("chunk_id", "neighbour", "similarity"))})

    return search


def _partition_hits(units: DataFrame, rows: int, k: int) -> DataFrame:
    """chunk_id, neighbour, similarity: the k nearest of each vector inside each partition that it is sent to."""
    shared = units.sparkSession.sparkContext.broadcast(_fit(units, rows))  # at most MAX_PARTS ** 2 columns of weights

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, inner = shared.value
        for batch in batches:
            for a in range(0, len(batch), 4096):
                b = batch[a : a + 4096]
                yield pd.DataFrame({"chunk_id": b["chunk_id"], "vec": b["vec"], "parts": list(_routes(_matrix(b["vec"]), first, inner))})

    routed = stage(units.mapInPandas(route, "chunk_id string, vec binary, parts array<int>"))
    sent = F.explode(F.filter("parts", lambda p: p >= 0)).alias("part")
    load = routed.select("parts", sent).groupBy("part").agg(F.count(F.when(F.col("part") == F.col("parts")[0], 1)).alias("n"), F.count("*").alias("q"))
    # One row per partition: how many blocks its members and its queries are cut into.
    blocks = small_side(load.filter("n > 0").select("part", F.ceil(F.col("n") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("q") / QUERY_BLOCK).cast("int").alias("qb")))
    slot = lambda n, seed: F.pmod(F.xxhash64("chunk_id", F.lit(seed)), n).cast("int")
    first = F.col("parts")[0]
    q = F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("q")
    member = routed.withColumn("part", first).join(blocks, "part").select("part", slot(F.col("mb"), 1).alias("m"), q, "chunk_id", "vec", F.lit(True).alias("member"), (F.col("mb") == 1).alias("alone"))
    # a member of an uncut partition asks there itself
    member = member.select("part", "m", "q", "chunk_id", "vec", "member", (F.col("alone") & (F.col("q") == 0)).alias("asks"))
    query = routed.select("chunk_id", "vec", first.alias("home"), sent).join(blocks, "part").filter((F.col("mb") > 1) | (F.col("part") != F.col("home"))).select(
        "part", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("m"), slot(F.col("qb"), 2).alias("q"), "chunk_id", "vec", F.lit(False).alias("member"), F.lit(False).alias("asks"))
    return member.unionByName(query).groupBy("part", "m", "q").applyInPandas(_search(k), "chunk_id string, neighbour string, similarity double")


def nearest(vectors: DataFrame, k: int = 5, size: int = 96) -> DataFrame:
    """chunk_id, neighbour, similarity, rank: for each usable vector its k nearest others by cosine, as far as its partitions hold them.

    Null, wrongly sized, NaN, infinite and all-zero vectors take no part; a chunk_id that comes twice counts once. Equal vectors are
    searched once and their copies named by chunk_id, so that ties go to the smaller chunk_id and copies of one vector may be any share
    of the rows. Up to PART_ROWS different vectors there is one partition, and the result is exact.
    """
    units = stage(usable(vectors, size).withColumns({"h1": F.xxhash64("vec"), "h2": F.xxhash64("vec", F.lit(7))}))
    alike = units.groupBy("h1", "h2").agg(F.count("*").alias("copies"), F.min("chunk_id").alias("head")).filter("copies > 1").drop("copies")
    marked = units.join(small_side(alike), ["h1", "h2"], "left").select("chunk_id", "vec", "head")
    single = stage(marked.filter("head is null or chunk_id = head").select("chunk_id", "vec"))
    copies = stage(marked.filter("head is not null").select("chunk_id", "head"))
    rows = single.count()
    if rows == 0:
        return units.select("chunk_id", F.col("chunk_id").alias("neighbour"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank"))
    best = W.partitionBy("chunk_id").orderBy(F.desc("similarity"), "neighbour")
    first = lambda hits, n: hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n)
    hits = first(_partition_hits(single, rows, k), k).drop("rank")
    # the k + 1 smallest chunk_ids of each class of equal vectors stand for it; its members share the class's neighbours
    few = copies.withColumn("i", F.row_number().over(W.partitionBy("head").orderBy("chunk_id"))).filter(F.col("i") <= k + 1).select("head", F.col("chunk_id").alias("named"))
    few = small_side(few)
    named = hits.join(few.withColumnRenamed("head", "neighbour"), "neighbour", "left").select("chunk_id", F.coalesce("named", "neighbour").alias("neighbour"), "similarity")
    own = few.select(F.col("head").alias("chunk_id"), F.col("named").alias("neighbour"), F.lit(1.0).alias("similarity"))
    heads = small_side(few.select(F.col("head").alias("chunk_id")).distinct())
    by_class = named.join(heads, "chunk_id", "left_semi").unionByName(own)
    of_class = first(by_class, k + 1).drop("rank")
    members = copies.join(of_class.withColumnRenamed("chunk_id", "head"), "head").filter("chunk_id <> neighbour").select("chunk_id", "neighbour", "similarity")
    return first(named.join(heads, "chunk_id", "left_anti").unionByName(members), k)


def neighbour_pairs(vectors: DataFrame, k: int = 5, size: int = 96) -> DataFrame:
    """a, b (a < b): two chunks of which at least one is among the k nearest of the other."""
    return nearest(vectors, k, size).select(F.least("chunk_id", "neighbour").alias("a"), F.greatest("chunk_id", "neighbour").alias("b")).distinct()
