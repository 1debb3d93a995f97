"""Evaluation texts leaking into training text (problem 7): q-gram lemma filtering over diagonal bands.

A passage of n characters that is met with at most k edits shares n + 1 - q * (k + 1) q-grams with the document inside a band of
diagonals. Bands with fewer are dropped, the rest is verified by banded alignment of the passages, with k = 0 as one case of it.
The q-gram index of few items goes to every task and the documents are scanned once; more items are met by a join on q-grams.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docengine.plans.staging import ship_with_tasks, stage

ship_with_tasks(__name__)

Q = 32  # characters of a q-gram at most; less where passages are short or the edit budget asks for it
LEAST_Q = 4
BAND = 64  # width of a diagonal band; bands overlap by half
#: Characters of item text up to which the index (24 bytes a character) is sent to every task.
INDEX_CHARS = 1024 * 1024

_WORD = re.compile(r"[^\W_]+")
_BASE = 1_000_003


def normal(text: str) -> str:
    """The words of text, without case, each after one blank and before one."""
    return " " + " ".join(_WORD.findall(text.casefold())) + " "


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def qgrams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each window of q characters: windows of one, two, four ... characters put together."""
    block, size, power = codes.astype(np.uint64), 1, _BASE
    out, length, n = np.zeros(len(codes), np.uint64), 0, len(codes) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    while size <= q:
        if q & size:
            m = len(block) - length
            out = out[:m] * np.uint64(power) + block[length:]
            length += size
        if 2 * size <= q:
            block = block[:-size] * np.uint64(power) + block[size:]
        power = power * power % 2**64
        size *= 2
    out = out[:n]
    return out ^ (out >> np.uint64(29))


def _all_qgrams(texts: list[str], q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, number of the text and position of every q-gram of the texts; none spans two texts."""
    codes = [_codes(t) for t in texts]
    sizes = np.fromiter(map(len, codes), np.int64, len(codes))
    if sizes.sum() < q:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    grams = qgrams(np.concatenate(codes), q)
    who = np.repeat(np.arange(len(texts)), sizes)[: len(grams)]
    at = np.arange(len(grams)) - np.repeat(np.cumsum(sizes) - sizes, sizes)[: len(grams)]
    whole = at + q <= sizes[who]
    return grams[whole], who[whole], at[whole]


def passages(item: str, words: int) -> list[tuple[int, int]]:
    """Start and end, in the normal text of the item, of each run of so many words with the blanks around it."""
    blanks = [m.start() for m in re.finditer(" ", item)]
    return [(a, b + 1) for a, b in zip(blanks, blanks[words:])]


def aligned(item: str, runs: list[tuple[int, int]], doc: str, low: int, high: int, edits: int) -> bool:
    """Whether one of the runs of the item aligns with a stretch of doc within the edit budget on diagonals low to high.

    The diagonal of a cell is its position in doc less that in the item. Only these diagonals and as many as the budget beside them are
    filled, for all runs at once; a run may begin and end on any of them.
    """
    if not runs:
        return False
    low, high = low - edits, high + edits
    a, d = _codes(item), _codes(doc)
    begins, lengths = np.array([r[0] for r in runs]), np.array([r[1] - r[0] for r in runs])
    diagonals, steps = np.arange(low, high + 1), np.arange(lengths.max())
    at_item = np.minimum(begins[:, None] + steps, len(a) - 1)
    at_doc = at_item[:, :, None] + diagonals
    differs = (at_doc < 0) | (at_doc >= len(d)) | (d[np.clip(at_doc, 0, len(d) - 1)] != a[at_item][:, :, None])
    differs &= (steps < lengths[:, None])[:, :, None]
    if edits == 0:  # no step leaves its diagonal
        return bool((~differs.any(axis=1)).any())
    cost = np.zeros((len(runs), len(diagonals)), np.int32)
    slope, left_out = np.arange(len(diagonals), dtype=np.int32), np.full_like(cost, edits + 1)
    for i in range(lengths.max()):
        # an item character left out moves one diagonal down, a doc character put in one up
        left_out[:, :-1] = cost[:, 1:] + 1
        step = np.minimum(cost + differs[:, i], left_out) - slope
        step = np.minimum(np.minimum.accumulate(step, axis=1) + slope, edits + 1)
        cost = np.where((i < lengths)[:, None], step, cost)
    return bool((cost <= edits).any())


def _bands(doc_no: np.ndarray, item_no: np.ndarray, at: np.ndarray, item_at: np.ndarray, least: np.ndarray) -> list[tuple[int, int, int, int, np.ndarray]]:
    """(doc, item, lowest and highest diagonal, item positions) of the bands that share enough q-grams of the item."""
    out = []
    diagonal = at - item_at
    for shift in (0, BAND // 2):
        band = (diagonal + shift) // BAND
        order = np.lexsort((item_at, band, item_no, doc_no))
        w, n, b, p, g = doc_no[order], item_no[order], band[order], item_at[order], diagonal[order]
        new = np.ones(len(w), bool)
        new[1:] = (np.diff(w) != 0) | (np.diff(n) != 0) | (np.diff(b) != 0)
        starts = np.nonzero(new)[0]
        # the lemma counts q-grams of the passage, so one that is met several times counts once
        fresh = new.copy()
        fresh[1:] |= np.diff(p) != 0
        count = np.add.reduceat(fresh.astype(np.int64), starts) if len(starts) else starts
        ends = np.append(starts[1:], len(w))
        lows, highs = (np.minimum.reduceat(g, starts), np.maximum.reduceat(g, starts)) if len(starts) else (starts, starts)
        for k in np.nonzero(count >= least[n[starts]])[0]:
            s, e = starts[k], ends[k]
            out.append((int(w[s]), int(n[s]), int(lows[k]), int(highs[k]), p[s:e][fresh[s:e]]))
    return out


def _verified(item: str, doc: str, words: int, edits: int, q: int, low: int, high: int, met: np.ndarray) -> bool:
    """Whether a run of the item with enough of its q-grams among those met (sorted positions) is aligned in the band."""
    runs = np.array(passages(item, words))
    held = np.searchsorted(met, runs[:, 1] - q, "right") - np.searchsorted(met, runs[:, 0], "left")
    spare = held - np.maximum(1, runs[:, 1] - runs[:, 0] + 1 - q * (edits + 1))
    order = np.argsort(-spare, kind="stable")
    order = order[spare[order] >= 0].tolist()
    # the likeliest run first: where it is aligned, the others need not be
    return any(aligned(item, [tuple(runs[k]) for k in some], doc, low, high, edits) for some in (order[:1], order[1:]))


def leaks(documents: DataFrame, items: DataFrame, words: int = 12, edits: int = 0) -> DataFrame:
    """doc_id, item_id, first_char, last_char: the documents that hold a passage of an item, with offsets in their normal text.

    A passage is words consecutive words of the item. With edits=0 it must occur word for word; with edits>0 it may differ by so many
    characters, which must be less than half a band and leave q-grams of at least LEAST_Q characters to count (else ValueError).
    Null, empty and short texts give no rows; an item_id with several texts is held by each of them; copies of a document are reported
    each under its own doc_id; rows repeated under one doc_id give one row.
    """
    if not 0 <= edits < BAND // 2:
        raise ValueError("edits must be less than half a band")

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [normal(t) for t in batch["text"]]
            shortest = [min((b - a for a, b in passages(t, words)), default=0) for t in texts]
            yield pd.DataFrame({"item_id": batch["item_id"], "text": texts, "shortest": np.array(shortest, np.int32)})

    held = stage(items.filter("text is not null").select("item_id", "text").distinct().mapInPandas(prepare, "item_id bigint, text string, shortest int").filter("shortest > 0"))
    size = held.agg(F.sum(F.length("text")).alias("chars"), F.min("shortest").alias("shortest")).first()
    texts = documents.select("doc_id", "text").filter(F.length("text") > 0)
    if size["chars"] is None:
        return texts.limit(0).select("doc_id", F.lit(0).cast("bigint").alias("item_id"), F.lit(0).alias("first_char"), F.lit(0).alias("last_char"))
    q = min(Q, size["shortest"] * 3 // (4 * (edits + 1)))  # so that a fair share of a passage's q-grams must be met
    if q < LEAST_Q:
        raise ValueError("the edit budget is too large for passages of this length")
    found = _by_index(texts, held, words, edits, q) if size["chars"] <= INDEX_CHARS else _by_join(texts, held, words, edits, q)
    return found.groupBy("doc_id", "item_id").agg(F.min("first_char").alias("first_char"), F.max("last_char").alias("last_char"))


_FOUND = "doc_id bigint, item_id bigint, first_char int, last_char int"


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["doc_id", "item_id", "first_char", "last_char"]).astype({"doc_id": "int64", "item_id": "int64", "first_char": "int32", "last_char": "int32"})


def _by_index(texts: DataFrame, held: DataFrame, words: int, edits: int, q: int) -> DataFrame:
    """One scan of the documents against the index of all items, which is at most INDEX_CHARS long."""
    items = [(r["item_id"], r["text"], r["shortest"]) for r in held.orderBy("item_id", "text").toLocalIterator()]
    keys, who, at = _all_qgrams([t for _, t, _ in items], q)
    order = np.argsort(keys, kind="stable")
    distinct, starts = np.unique(keys[order], return_index=True)
    sizes = np.diff(np.append(starts, len(keys)))
    least = np.maximum(1, np.array([n for _, _, n in items]) + 1 - q * (edits + 1))
    # a first look at 22 bits of the hash leaves few q-grams to be searched
    seen = np.zeros(1 << 22, bool)
    seen[(distinct & np.uint64(0x3FFFFF)).astype(np.int64)] = True
    shared = texts.sparkSession.sparkContext.broadcast((items, distinct, starts, sizes, who[order], at[order], least, seen))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, distinct, starts, sizes, who, at, least, seen = shared.value
        for whole in batches:
            for a in range(0, len(whole), 256):
                batch, rows = whole[a : a + 256], []
                docs = [normal(t) for t in batch["text"]]
                grams, doc_no, doc_at = _all_qgrams(docs, q)
                some = np.nonzero(seen[(grams & np.uint64(0x3FFFFF)).astype(np.int64)])[0]
                slot = np.minimum(np.searchsorted(distinct, grams[some]), len(distinct) - 1)
                met = distinct[slot] == grams[some]
                some, slot = some[met], slot[met]
                n = sizes[slot]
                back = np.repeat(some, n)
                entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[slot], n)
                done = set()
                for d, i, low, high, met in _bands(doc_no[back], who[entry], doc_at[back], at[entry], least):
                    if (d, i) not in done and _verified(items[i][1], docs[d], words, edits, q, low, high, met):
                        done.add((d, i))
                        rows.append((batch["doc_id"].iloc[d], items[i][0], max(0, met[0] + low), met[-1] + high + q))
                yield _rows(rows)

    return texts.mapInPandas(scan, _FOUND)


def _by_join(texts: DataFrame, held: DataFrame, words: int, edits: int, q: int) -> DataFrame:
    """Documents and items meet by q-gram in a shuffle; bands are counted before any text is fetched."""

    def cut(table: DataFrame, key: str) -> DataFrame:
        def grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for whole in batches:
                for a in range(0, len(whole), 256):
                    batch = whole[a : a + 256]
                    hashes, who, at = _all_qgrams(list(batch["text"]), q)
                    yield pd.DataFrame({key: batch[key].to_numpy()[who], "gram": hashes.view(np.int64), f"{key}_at": at.astype(np.int32)})

        return table.mapInPandas(grams, f"{key} bigint, gram bigint, {key}_at int")

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=[normal(t) for t in batch["text"]])

    key = lambda t, c: t.withColumn(c, F.xxhash64("text"))
    docs = stage(key(texts.mapInPandas(plain, "doc_id bigint, text string"), "doc"))
    held = stage(key(held, "item"))
    once = docs.groupBy("doc").agg(F.min("text").alias("text"))  # copies of a document are looked at once
    met = cut(once, "doc").join(cut(held.select("item", "text").distinct(), "item"), "gram")
    shift = F.explode(F.array(F.lit(0), F.lit(BAND // 2))).alias("shift")
    banded = met.select("doc", "item", "item_at", (F.col("doc_at") - F.col("item_at")).alias("diagonal"), shift).withColumn("band", F.floor((F.col("diagonal") + F.col("shift")) / BAND))
    counted = banded.groupBy("doc", "item", "shift", "band", "item_at").agg(F.min("diagonal").alias("low"), F.max("diagonal").alias("high")).groupBy("doc", "item", "shift", "band")
    counted = counted.agg(F.count("*").alias("shared"), F.min("low").alias("low"), F.max("high").alias("high"), F.sort_array(F.collect_list("item_at")).alias("met"))  # at most an item's length
    known = held.groupBy("item").agg(F.min("shortest").alias("shortest"), F.min("text").alias("item_text"))
    likely = counted.join(known, "item").filter(F.col("shared") >= F.greatest(F.lit(1), F.col("shortest") + 1 - q * (edits + 1))).join(once, "doc")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [_verified(r.item_text, r.text, words, edits, q, r.low, r.high, np.asarray(r.met)) for r in batch.itertuples()]
            kept = batch[np.array(good, bool)]
            first, last = (np.array([m[k] for m in kept["met"]], np.int64) for k in (0, -1))
            yield pd.DataFrame({"doc": kept["doc"], "item": kept["item"], "first_char": np.maximum(0, first + kept["low"]).astype(np.int32), "last_char": (last + kept["high"] + q).astype(np.int32)})

    good = likely.select("doc", "item", "item_text", "text", "low", "high", "met").mapInPandas(verify, "doc bigint, item bigint, first_char int, last_char int")
    return good.join(docs.select("doc_id", "doc"), "doc").join(held.select("item_id", "item"), "item").select("doc_id", "item_id", "first_char", "last_char")
