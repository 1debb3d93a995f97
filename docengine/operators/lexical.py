"""Lexical statistics, BM25 and token similarity of a stated query set against all documents."""

from __future__ import annotations

import operator
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx
from docengine.plans.staging import ship_with_tasks, small_side, stage

ship_with_tasks(__name__)

#: Queries that are scored in one scan of the documents.
QUERY_BLOCK = 512

#: The same where a task keeps the best of each query over all of its documents, and the documents it inverts at a time.
HELD_BLOCK, DOC_BLOCK = 8192, 8192

_WORD, _BLANK = re.compile(r"[a-z0-9]+"), re.compile(r"[ \t\n\x0b\f\r]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _blank(text: str) -> list[str]:
    return [w for w in _BLANK.split(text.lower()) if w]


def postings(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, tok, tf: one row per document and different token."""
    return docs.select(key, F.explode(tokens).alias("tok")).groupBy(key, "tok").agg(F.count("*").alias("tf"))


def term_stats(docs: DataFrame, key: str = "chunk_id") -> DataFrame:
    """tok, df, cf, idf over all documents."""
    total = docs.agg(F.count("*").alias("n_docs"))
    df = postings(docs, key, tx.blank_tokens(F.col("text"))).groupBy("tok").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))
    return df.crossJoin(F.broadcast(total)).select("tok", "df", "cf", F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))  # total: one row


def _slices(queries: DataFrame, qid: str, block: int) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the stated query set, block at a time."""
    ids, texts = [], []
    for r in queries.filter("qtext is not null").select(qid, "qtext").coalesce(1).toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == block:
            yield ids, texts
            ids, texts = [], []
    if ids:
        yield ids, texts


def _columns(texts: list[str], split) -> tuple[dict[str, int], np.ndarray]:
    """The slice's vocabulary, and its counts with a row per token and a column per query."""
    counts = [Counter(split(t)) for t in texts]
    vocabulary = {w: i for i, w in enumerate(sorted(set().union(*counts)))}
    table = np.zeros((len(vocabulary), len(texts)))
    for j, c in enumerate(counts):
        for w, n in c.items():
            table[vocabulary[w], j] = n
    return vocabulary, table


def _counted(texts: pd.Series, vocabulary: dict[str, int], split) -> tuple[np.ndarray, list[Counter]]:
    """Counts of the slice's tokens with a row per document, and all counts of each."""
    counts = [Counter(split(t)) for t in texts]
    spots = [(i, vocabulary[w], n) for i, c in enumerate(counts) for w, n in c.items() if w in vocabulary]
    table = np.zeros((len(counts), len(vocabulary)))
    if spots:
        row, col, n = zip(*spots)
        table[list(row), list(col)] = n
    return table, counts


def _cut(batches: Iterator[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    """Batches so short that a table of width columns stays small."""
    step = max(16, min(1024, 4_000_000 // max(1, width)))
    for batch in batches:
        for a in range(0, len(batch), step):
            yield batch.iloc[a : a + step]


def _scan(queries: DataFrame, docs: DataFrame, qid: str, key: str, values: str, build, columns: tuple[str, ...] = (), block: int | None = None) -> DataFrame:
    """The union over the slices of the query set of one scan of the documents each, by the function that build() makes of a slice."""
    types = dict(queries.dtypes)[qid], dict(docs.dtypes)[key]
    schema, out = f"{qid} {types[0]}, {key} {types[1]}, {values}", None
    texts = docs.select(key, "text", *columns).filter("text <> ''")
    for ids, asked in _slices(queries, qid, block or QUERY_BLOCK):
        found = texts.mapInPandas(build(np.array(ids), asked), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _frequencies(queries: DataFrame, docs: DataFrame) -> tuple[float, int, dict[str, int]]:
    """Mean length and number of the documents, and the document frequencies of the query tokens."""
    text = F.col("text")
    length, known = docs.agg(F.avg(F.size(tx.blank_tokens(text))), F.count("*")).first()
    asked_tokens = queries.filter("qtext is not null").select(F.explode(tx.blank_tokens(F.col("qtext"))).alias("tok")).distinct()
    df = docs.select(F.explode(F.array_distinct(tx.blank_tokens(text))).alias("tok")).join(small_side(asked_tokens), "tok", "left_semi").groupBy("tok").agg(F.count("*").alias("df"))
    return length, known, {r["tok"]: r["df"] for r in df.coalesce(1).toLocalIterator()}  # the vocabulary of the stated queries


def bm25(queries: DataFrame, docs: DataFrame, qid: str = "qid", key: str = "chunk_id") -> DataFrame:
    """qid, key, bm25 of every document with a query token; a repeated query token counts again.

    Document frequencies are counted for the query tokens only; each task multiplies the weights of its documents by the counts of the
    queries, so that postings are never shuffled by token.
    """
    length, known, frequency = _frequencies(queries, docs)
    context = docs.sparkSession.sparkContext

    def build(ids: np.ndarray, asked: list[str]):
        vocabulary, table = _columns(asked, _blank)
        held = np.array([frequency.get(w, 0) for w in vocabulary], np.float64)
        idf = np.where(held > 0, np.log((known - held + 0.5) / (held + 0.5) + 1), 0.0)
        shared = context.broadcast((ids, vocabulary, table, idf))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vocabulary, table, idf = shared.value
            for batch in _cut(batches, len(vocabulary)):
                tf, counts = _counted(batch["text"], vocabulary, _blank)
                dl = np.array([sum(c.values()) for c in counts], np.float64)[:, None]
                weight = idf * tf * (lx.BM25_K1 + 1) / (tf + lx.BM25_K1 * (1 - lx.BM25_B + lx.BM25_B * dl / (length + lx.EPSILON)) + lx.EPSILON)
                row, col = np.nonzero((tf > 0).astype(np.float32) @ (table > 0).astype(np.float32))
                yield pd.DataFrame({qid: ids[col], key: batch[key].to_numpy()[row], "bm25": (weight @ table)[row, col]})

        return score

    return _scan(queries, docs, qid, key, "bm25 double", build).withColumn("bm25", F.round("bm25", 6))


def min_max(scores: DataFrame, n_docs: DataFrame, qid: str = "qid", score: str = "bm25") -> DataFrame:
    """Adds norm: the score scaled over the whole corpus, where documents without a row score 0."""
    scores = stage(scores)
    ends = scores.groupBy(qid).agg(F.count("*").alias("n"), F.min(score).alias("least"), F.max(score).alias("most")).crossJoin(F.broadcast(n_docs))  # n_docs: one row
    ends = ends.select(qid, F.when(F.col("n") < F.col("n_docs"), F.lit(0.0)).otherwise(F.col("least")).alias("low"), "most")
    return scores.join(small_side(ends), qid).withColumn("norm", F.round((F.col(score) - F.col("low")) / (F.col("most") - F.col("low") + lx.EPSILON), 6)).drop("low", "most")


#: What may be among the best of a task's documents: scores of pairs, with the amount by which a pair may yet gain on another.
BY_SIM = lambda raw, shared, jac, batch, ids: [(raw, 2e-6)]
BY_SHARED = lambda raw, shared, jac, batch, ids: [(shared, 0.0)]


def term_cosine(queries: DataFrame, docs: DataFrame, qid: str = "qid", key: str = "chunk_id", best: int | None = None, by=BY_SIM, columns: tuple[str, ...] = ()) -> DataFrame:
    """qid, key, sim (six places), raw, shared, jac: cosine of token counts and Jaccard of token sets, of pairs with a common token.

    With best, a task gives only the pairs that may be among the best of their query by one of the scores of by, ties included; by sees
    the columns named of the documents of its batch.
    """
    context = docs.sparkSession.sparkContext

    def build(ids: np.ndarray, asked: list[str]):
        shared_value = context.broadcast((ids, *_columns(asked, _words)))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, vocabulary, table = shared_value.value
            has, q_norm, q_size = (table > 0).astype(np.float32), np.sqrt((table * table).sum(0)), (table > 0).sum(0)
            for batch in _cut(batches, len(vocabulary)):
                tf, counts = _counted(batch["text"], vocabulary, _words)
                d_norm, d_size = np.array([sum(n * n for n in c.values()) for c in counts], np.float64) ** 0.5, np.array([len(c) for c in counts])
                shared = ((tf > 0).astype(np.float32) @ has).astype(np.int64)
                keep = shared > 0
                with np.errstate(invalid="ignore", divide="ignore"):
                    raw = (tf @ table) / (q_norm[None, :] * d_norm[:, None])
                    jac = shared / (q_size[None, :] + d_size[:, None] - shared)
                if best and len(batch) > best:
                    likely = np.zeros_like(keep)
                    for value, gain in by(raw, shared, jac, batch, ids):
                        value = np.where(keep, value, -np.inf)
                        likely |= value + gain >= np.partition(value, -best, axis=0)[-best]
                    keep &= likely
                row, col = np.nonzero(keep)
                yield pd.DataFrame({qid: ids[col], key: batch[key].to_numpy()[row], "raw": raw[row, col], "shared": shared[row, col], "jac": jac[row, col]})

        return score

    return _scan(queries, docs, qid, key, "raw double, shared bigint, jac double", build, columns).select(qid, key, F.round("raw", 6).alias("sim"), "raw", "shared", "jac")


def _inverted(texts: pd.Series, vocabulary: dict[str, int], split) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray, np.ndarray]:
    """Document and count of each posting of the vocabulary, by token; where each token's begin; length and norm of each document."""
    met, tok, tf, length, square = [], [], [], [], []
    for text in texts:
        count = Counter(split(text))
        own = [w for w in count if w in vocabulary]
        met.append(len(own))
        tok.extend([vocabulary[w] for w in own])
        tf.extend([count[w] for w in own])
        n = list(count.values())
        length.append(sum(n))
        square.append(sum(map(operator.mul, n, n)))
    tok = np.array(tok, np.int64)
    order = np.argsort(tok, kind="stable")
    begin = np.searchsorted(tok[order], np.arange(len(vocabulary) + 1)).tolist()
    return np.repeat(np.arange(len(met)), met)[order], np.array(tf, np.float64)[order], begin, np.array(length, np.float64), np.array(square, np.float64) ** 0.5


def _summed(doc: np.ndarray, weight: np.ndarray, begin: list[int], asked: list[tuple[int, int]], size: int) -> np.ndarray:
    """The weights of the query's postings, each by the token's count in the query, added up by document."""
    if not asked:
        return np.zeros(size)
    spans = [(begin[t], begin[t + 1], n) for t, n in asked]
    return np.bincount(np.concatenate([doc[a:b] for a, b, _ in spans]), np.concatenate([weight[a:b] * n if n > 1 else weight[a:b] for a, b, n in spans]), size)


def _held(keys: np.ndarray, raw: np.ndarray, score: np.ndarray, best: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Those that may be among the best by raw rounded to six places, ties by key, and the raw that another must come near to be one."""
    if len(raw) < best:
        return keys, raw, score, 0.0
    cut = np.partition(raw, -best)[-best]
    near = raw >= cut - 2e-6
    keys, raw, score = keys[near], raw[near], score[near]
    if len(raw) > 4 * best:  # of equal ones the first by key
        first = (pd.DataFrame({"raw": raw, "key": keys}).sort_values("key").groupby("raw").cumcount() < best).sort_index().to_numpy()
        keys, raw, score = keys[first], raw[first], score[first]
    return keys, raw, score, cut


def nearest_with_norm(queries: DataFrame, docs: DataFrame, best: int, qid: str = "qid", key: str = "chunk_id") -> DataFrame:
    """qid, key, sim, norm of the best documents by term cosine: what term_cosine, min_max and bm25 give, without a row for each pair.

    One scan: a task keeps the best of each query with their BM25, and the number, least and greatest BM25 of all documents that the query
    meets, which is what the norm needs of the rest.
    """
    length, known, frequency = _frequencies(queries, docs)
    context = docs.sparkSession.sparkContext

    def build(ids: np.ndarray, asked: list[str]):
        words, blanks = ([Counter(split(t)) for t in asked] for split in (_words, _blank))
        of = lambda counts: {w: i for i, w in enumerate(sorted(set().union(*counts)))}
        by_word, by_blank = of(words), of(blanks)
        held = np.array([frequency.get(w, 0) for w in by_blank], np.float64)
        idf = np.where(held > 0, np.log((known - held + 0.5) / (held + 0.5) + 1), 0.0)
        spots = lambda counts, vocabulary: [[(vocabulary[w], n) for w, n in c.items()] for c in counts]
        norms = [sum(n * n for n in c.values()) ** 0.5 for c in words]
        shared = context.broadcast((ids, by_word, by_blank, spots(words, by_word), spots(blanks, by_blank), norms, idf))

        def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, by_word, by_blank, in_words, in_blanks, norms, idf = shared.value
            kept, met, least, most = [None] * len(ids), np.zeros(len(ids), np.int64), np.full(len(ids), np.inf), np.full(len(ids), -np.inf)
            floor = np.zeros(len(ids))
            for batch in (b.iloc[a : a + DOC_BLOCK] for b in batches for a in range(0, len(b), DOC_BLOCK)):
                size, keys = len(batch), batch[key].to_numpy()
                doc, tf, begin, _, norm = _inverted(batch["text"], by_word, _words)
                norm[norm == 0] = 1.0
                b_doc, b_tf, b_begin, dl, _ = _inverted(batch["text"], by_blank, _blank)
                weight = np.repeat(idf, np.diff(b_begin)) * b_tf * (lx.BM25_K1 + 1) / (b_tf + lx.BM25_K1 * (1 - lx.BM25_B + lx.BM25_B * dl[b_doc] / (length + lx.EPSILON)) + lx.EPSILON)
                for j in range(len(ids)):
                    bm = _summed(b_doc, weight, b_begin, in_blanks[j], size)
                    n = np.count_nonzero(bm)
                    if n:
                        met[j] += n
                        most[j] = max(most[j], bm.max())
                        least[j] = min(least[j], bm.min() if n == size else bm[bm > 0].min())
                    raw = _summed(doc, tf, begin, in_words[j], size) / ((norms[j] or 1.0) * norm)
                    at = np.flatnonzero(raw >= max(floor[j] - 2e-6, 1e-12))
                    if len(at):
                        new = keys[at], raw[at], bm[at]
                        *kept[j], floor[j] = _held(*(new if kept[j] is None else map(np.concatenate, zip(kept[j], new))), best)
            own = np.flatnonzero(met)
            yield pd.DataFrame({qid: ids[own], key: None, "raw": None, "bm25": None, "n": met[own], "least": least[own], "most": most[own]})
            own = [j for j, found in enumerate(kept) if found is not None]
            for some in (own[a : a + QUERY_BLOCK] for a in range(0, len(own), QUERY_BLOCK)):
                keys, raw, bm = map(np.concatenate, zip(*[kept[j] for j in some]))
                yield pd.DataFrame({qid: np.repeat(ids[some], [len(kept[j][0]) for j in some]), key: keys, "raw": raw, "bm25": bm, "n": None, "least": None, "most": None})

        return score

    tasks = 4 * max(4, context.defaultParallelism)  # each gives its own best
    found = _scan(queries, docs.coalesce(tasks), qid, key, "raw double, bm25 double, n bigint, least double, most double", build, block=HELD_BLOCK)
    own, is_pair = W.partitionBy(qid), F.col("n").isNull()
    low = F.when(F.sum("n").over(own) < known, F.lit(0.0)).otherwise(F.round(F.min("least").over(own), 6))
    ranked = found.withColumn("sim", F.round("raw", 6)).withColumn("low", low).withColumn("high", F.round(F.max("most").over(own), 6)).filter(is_pair)
    ranked = ranked.withColumn("rank", F.row_number().over(own.orderBy(F.desc("sim"), key))).filter(F.col("rank") <= best)
    norm = F.round((F.round("bm25", 6) - F.col("low")) / (F.col("high") - F.col("low") + lx.EPSILON), 6)
    return ranked.select(qid, key, "sim", F.when(F.col("bm25") > 0, norm).alias("norm"))
