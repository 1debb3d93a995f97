"""Near-duplicate records with small edits (problem 6): multi-index hashing.

A record's fingerprint is SEGMENTS * WIDTH minimum-hash symbols of its word set. In each segment the Hamming ball of radius one
is enumerated by leaving out one symbol at a time, so two records meet in a table if any segment differs in at most one symbol.
A 128-bit parity sketch of the words bounds the complete distance from below inside the join, and the word sets decide.
At similarity 0.7 a pair is missed with probability (1 - 5 * 0.7**4 * 0.3 - 0.7**5) ** 9 = 0.0012, at 0.8 with 0.00001.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docengine.plans.staging import discard, ship_with_tasks, small_side, stage

ship_with_tasks(__name__)

SEGMENTS, WIDTH = 9, 5
#: Records with one key in one table up to which they are paired in one task; the rest are dealt to slots of this size.
BUCKET = 1024
#: Rows of the tables that one join task gets, in expectation.
TASK_ROWS = 250_000
#: One in so many word sets is looked at to find the keys that are dealt to slots; a key missed there is only dealt less evenly.
SAMPLE = 16
#: Bits of a set_id that give the set's size, at most this; larger sets count as this large until their words are compared.
SIZES = 0xFFF
#: Records whose words are hashed at once, so that the arrays stay in a core's cache.
AT_ONCE = 1024
#: Records of a class of identical word sets that are paired in one slot, in expectation.
SLOT = 256

_WORD = re.compile(r"[a-z0-9]+")
_SIGNED = "id string, at double, text_id bigint, set_id bigint, n int, sketch bigint, sketch2 bigint, symbols array<int>"


def _hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240601)
    return rng.integers(1, 2**32, size, dtype=np.uint32) | np.uint32(1), rng.integers(0, 2**32, size, dtype=np.uint32)


def _signed(records: DataFrame, min_words: int) -> DataFrame:
    """id, at, text_id, set_id, n, sketch and symbols of every record; n is 0 if it has fewer than min_words different words."""

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factor, shift = _hash_family(SEGMENTS * WIDTH)
        known: dict[str, int] = {}
        for whole in batches:
            for start in range(0, len(whole), AT_ONCE):
                batch = whole.iloc[start : start + AT_ONCE]
                flat, sizes = [], np.zeros(len(batch), np.int32)
                for i, text in enumerate(batch["text"]):
                    words = set(_WORD.findall(text.lower())) if text else ()
                    if len(words) >= min_words:
                        for w in words:
                            if w not in known:
                                known[w] = xxhash.xxh64_intdigest(w)
                        sizes[i] = len(words)
                        flat += [known[w] for w in words]
                if len(known) > 2_000_000:
                    known.clear()
                signed = sizes > 0
                few = batch.loc[~signed, ["id", "at", "text_id"]]
                if len(few):
                    yield few.assign(set_id=np.int64(0), n=np.int32(0), sketch=np.int64(0), sketch2=np.int64(0), symbols=[np.empty(0, np.int32)] * len(few))
                if not flat:
                    continue
                sizes, flat = sizes[signed], np.array(flat, np.uint64)
                starts = np.cumsum(sizes) - sizes
                # the exclusive and the sum of well-mixed words name the set, whatever the order of its words
                mixed = (flat ^ (flat >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                set_id = np.bitwise_xor.reduceat(mixed, starts) * np.uint64(0xBF58476D1CE4E5B9) + np.add.reduceat(mixed ^ (mixed >> np.uint64(29)), starts)
                set_id = (set_id & ~np.uint64(SIZES)) | np.minimum(sizes, SIZES).astype(np.uint64)
                short = (flat >> np.uint64(11)).astype(np.uint32)
                hashed, symbols = np.empty_like(short), np.empty((len(sizes), len(factor)), np.uint32)
                for k in range(len(factor)):
                    np.multiply(short, factor[k], out=hashed)
                    np.bitwise_xor(hashed, shift[k], out=hashed)
                    symbols[:, k] = np.minimum.reduceat(hashed, starts)
                # every word flips one of 128 bits: the sketches of two sets differ in at most as many bits as the sets in words
                bit, half = np.uint64(1) << (flat >> np.uint64(58)), (flat & np.uint64(1 << 20)) > 0
                sketch, sketch2 = (np.bitwise_xor.reduceat(np.where(h, bit, np.uint64(0)), starts) for h in (half, ~half))
                yield batch.loc[signed, ["id", "at", "text_id"]].assign(set_id=set_id.view(np.int64), n=sizes, sketch=sketch.view(np.int64), sketch2=sketch2.view(np.int64), symbols=list(symbols.view(np.int32)))

    return records.withColumn("text_id", F.xxhash64("text")).mapInPandas(sign, _SIGNED)


def _tables() -> list[Column]:
    """One key for each segment and each symbol left out of it."""
    return [
        F.xxhash64(F.lit(s * WIDTH + out), *[F.col("symbols")[s * WIDTH + k] for k in range(WIDTH) if k != out])
        for s in range(SEGMENTS) for out in range(WIDTH)
    ]


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1))


def _met(classes: DataFrame, threshold: float) -> DataFrame:
    """set_a, set_b: word sets with a table key in common whose sketches and sizes allow the similarity.

    The sets of a key of more than BUCKET sets are dealt to slots, each slot meeting all sets of the key.
    """
    rows = classes.select("set_id", "sketch", "sketch2", F.explode(F.array(*_tables())).alias("key"))
    n_rows = classes.count() * SEGMENTS * WIDTH
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // TASK_ROWS)
    some = classes.filter(F.pmod(F.xxhash64("set_id"), F.lit(SAMPLE)) == 0).select(F.explode(F.array(*_tables())).alias("key"))
    hot = some.groupBy("key").agg(F.count("*").alias("held")).filter(F.col("held") * SAMPLE * 2 > BUCKET)
    hot = small_side(hot.select("key", F.ceil(F.col("held") * SAMPLE / BUCKET).cast("int").alias("slots")))
    most = (1 - threshold) / (1 + threshold)  # of the words of both, at this similarity, occur in one only

    def pairs(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        apart = F.bit_count(F.col("a.sketch").bitwiseXOR(F.col("b.sketch"))) + F.bit_count(F.col("a.sketch2").bitwiseXOR(F.col("b.sketch2")))
        n_a, n_b = (F.col(f"{t}.set_id").bitwiseAND(F.lit(SIZES)) for t in "ab")
        likely = (F.col("a.set_id") < F.col("b.set_id")) & (apart <= most * (n_a + n_b) + 1e-6) & (n_a >= threshold * n_b - 1e-6) & (n_b >= threshold * n_a - 1e-6)
        for c in on:
            likely = likely & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        return a.join(b, likely).select(F.col("a.set_id").alias("set_a"), F.col("b.set_id").alias("set_b"))

    cold = rows.join(hot, "key", "left_anti").repartition(tasks, "key")
    dealt = stage(rows.join(hot, "key"))
    one = dealt.withColumn("slot", F.pmod(F.xxhash64("set_id"), "slots").cast("int"))
    every = dealt.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    return pairs(cold, cold, ["key"]).union(pairs(one, every, ["key", "slot"])).distinct()


def similar_sets(records: DataFrame, threshold: float, min_words: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, set_id, text_id) and links (set_a, set_b, similarity) between different word sets."""
    signed = stage(_signed(records, min_words))
    ends = lambda c: [F.min(c).alias(f"{c}_low"), F.max(c).alias(f"{c}_high")]
    per = stage(signed.groupBy("id").agg(*ends("text_id"), F.max("set_id").alias("set_id"), F.max("n").alias("n")))
    # few records come with several texts; of these the latest counts
    several = small_side(per.filter("text_id_low <> text_id_high").select("id"))
    last = signed.join(several, "id").groupBy("id").agg(F.max_by(F.struct("set_id", "text_id", "n"), F.struct("at", "text_id")).alias("r")).select("id", "r.*")
    one = per.filter("text_id_low = text_id_high").select("id", "set_id", F.col("text_id_low").alias("text_id"), "n")
    members = stage(one.unionByName(last).filter(F.col("n") > 0).drop("n"))
    classes = stage(signed.filter(F.col("n") > 0).groupBy("set_id").agg(*[F.first(c).alias(c) for c in ("text_id", "sketch", "sketch2", "symbols")]))  # alike in a class, but for the text
    discard(signed, per)
    met = stage(_met(classes, threshold))
    needed = small_side(met.select(F.col("set_a").alias("set_id")).union(met.select("set_b")).distinct().join(classes.select("set_id", "text_id"), "set_id"))
    discard(classes)
    # the words of a class are those of one of its texts, whatever records came with it
    texts = records.select("text", F.xxhash64("text").alias("text_id")).join(needed, "text_id").groupBy("set_id").agg(F.first("text").alias("text"))
    words = stage(texts.select("set_id", _words(F.col("text")).alias("words")))
    both = met.join(words.select(F.col("set_id").alias("set_a"), F.col("words").alias("words_a")), "set_a").join(words.select(F.col("set_id").alias("set_b"), F.col("words").alias("words_b")), "set_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    links = both.select("set_a", "set_b", (shared / (F.size("words_a") + F.size("words_b") - shared)).alias("similarity")).filter(F.col("similarity") >= threshold)
    return members, links


def _records(table: DataFrame, key: str, text: str, latest_by: str | None) -> DataFrame:
    at = F.col(latest_by) if latest_by else F.lit(None)
    if latest_by and dict(table.dtypes)[latest_by].startswith(("timestamp", "date")):
        at = at.cast("timestamp")
    return table.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"), at.cast("double").alias("at")).filter("id is not null")


def near_duplicate_pairs(table: DataFrame, key: str = "chunk_id", text: str = "text", threshold: float = 0.7, min_words: int = 20, latest_by: str | None = None, copies_written_out: int = 64) -> DataFrame:
    """a, b: the keys of every two records whose word sets have a Jaccard similarity of threshold or more, a < b.

    Records with fewer than min_words different words, null or empty text or a null key take no part; a record that comes again counts
    once, by its latest text in the order of latest_by. Identical word sets are linked too, each with each. copies_written_out bounds the
    pairs among exact copies of one text only: up to so many copies are paired each with each; of more, the first record stands for all,
    its copies are linked to it and links to other texts go to it alone. near_duplicate_groups names the copies of each
    representative, so that a join of the two gives every pair.
    """
    members, links = similar_sets(_records(table, key, text, latest_by), threshold, min_words)
    copies = members.groupBy("set_id", "text_id").agg(F.count("*").alias("size"), F.min("id").alias("head"))
    many = small_side(copies.filter(F.col("size") > copies_written_out).select("set_id", "text_id", "head"))
    known = members.join(many, ["set_id", "text_id"], "left")
    star = known.filter(F.col("id") != F.col("head")).select(F.col("head").alias("x"), F.col("id").alias("y"))
    spoken = known.filter(F.col("head").isNull() | (F.col("id") == F.col("head"))).select("set_id", "id")
    size = stage(spoken.groupBy("set_id").agg(F.count("*").alias("size")).filter("size > 1"))
    # A large class is dealt to slots by record, and what meets it is repeated for each slot.
    slots = small_side(size.filter(F.col("size") > SLOT).select("set_id", F.ceil(F.col("size") / SLOT).cast("int").alias("slots")))
    dealt = spoken.join(slots, "set_id", "left").withColumn("slot", F.coalesce(F.pmod(F.xxhash64("id"), "slots").cast("int"), F.lit(0)))
    in_each = F.explode(F.sequence(F.lit(0), F.coalesce("slots", F.lit(1)) - 1)).alias("slot")
    across = links.select("set_a", "set_b")
    for side, name in (("set_a", "x"), ("set_b", "y")):
        asked = across.withColumnRenamed(side, "set_id").join(slots, "set_id", "left")
        asked = asked.select("set_id", *[c for c in across.columns if c != side], in_each)
        across = asked.join(dealt.select("set_id", "slot", F.col("id").alias(name)), ["set_id", "slot"]).drop("set_id", "slot")
    shared = stage(dealt.join(size.select("set_id"), "set_id", "left_semi"))
    p, q = shared.select("set_id", "slot", F.col("id").alias("x")), shared.select("set_id", F.col("id").alias("y"), in_each)
    inside = p.join(q, ["set_id", "slot"]).filter(F.col("x") < F.col("y")).select("x", "y")
    pairs = across.select("x", "y").unionByName(inside).unionByName(star)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """node, root: the smallest node that each linked node is connected with. Minimum labels with pointer jumping, staged each round."""
    edges = stage(links.select(F.col(left).alias("u"), F.col(right).alias("v")).union(links.select(right, left)).distinct())
    roots = stage(edges.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("node"), F.least("u", "low").alias("root")))
    while True:
        near = edges.join(roots.select(F.col("node").alias("v"), F.col("root").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
        nearer = roots.join(near.withColumnRenamed("u", "node"), "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("far"))
        new = stage(nearer.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("far", "root")).alias("root")))
        roots = new.select("node", "root")
        if new.filter("root <> was").isEmpty():
            return roots


def near_duplicate_groups(table: DataFrame, key: str = "chunk_id", text: str = "text", threshold: float = 0.7, min_words: int = 20, latest_by: str | None = None) -> DataFrame:
    """One row per record that takes part: key, group (a class id), head (the first record with the very same text), first (the first
    record with the same words), copies (records with the same words), links (to other word sets)."""
    members, links = similar_sets(_records(table, key, text, latest_by), threshold, min_words)
    links = stage(links)
    roots = components(links, "set_a", "set_b")
    degree = links.select(F.col("set_a").alias("set_id")).union(links.select("set_b")).groupBy("set_id").agg(F.count("*").alias("links"))
    size = members.groupBy("set_id").agg(F.count("*").alias("copies"))
    heads = members.groupBy("set_id", "text_id").agg(F.min("id").alias("head"))
    firsts = heads.groupBy("set_id").agg(F.min("head").alias("first"))
    out = members.join(heads, ["set_id", "text_id"]).join(firsts, "set_id").join(size, "set_id").join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").join(degree, "set_id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("root", "set_id").alias("group"), "head", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"))
