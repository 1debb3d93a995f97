"""Profiles, comparisons, entities, sessions, traces and prompts (X*, M*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.functions import lexicon as lx
from docengine.functions import text as tx


def profiles(chunks: DataFrame, company: str, order: list[str]) -> DataFrame:
    """Per company the last text that meets each slot, 'not mentioned' without one, and the number of exclusions."""
    low, place = F.lower("text"), F.struct(*order)
    slot = lambda cond: F.coalesce(F.max_by(F.when(cond, F.col("text")), F.when(cond, place)), F.lit("not mentioned"))
    wait = F.contains(low, F.lit("waiting period")) | F.contains(low, F.lit("ped"))
    pre = F.contains(low, F.lit("pre-existing"))
    out = [slot(tx.contains_any(low, words)).alias(name) for name, words in lx.PROFILE_SLOTS.items()]
    out += [slot(wait & pre).alias("ped_waiting"), slot(wait & ~pre).alias("specific_waiting"), F.count_if(F.contains(low, F.lit("exclusion")) | F.contains(low, F.lit("not payable"))).alias("exclusions")]
    return chunks.groupBy(company).agg(*out)


def mentions(docs: DataFrame, key: str) -> DataFrame:
    """key, mention, label: capitalised words in a row after a lower-case one, numbers of files and sums: the default entity matcher."""
    names = F.transform(F.regexp_extract_all("text", F.lit(r"(?<=[a-z,] )(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"), 1), lambda x: F.struct(x.alias("mention"), F.lit("NAME").alias("label")))
    codes = F.transform(F.regexp_extract_all("text", F.lit(r"\b([A-Z]{2}-[0-9]{3,5})\b"), 1), lambda x: F.struct(x.alias("mention"), F.lit("FILE").alias("label")))
    return docs.select(key, F.posexplode(F.concat(names, codes)).alias("pos", "m")).select(key, "pos", "m.*")


def distinct_mentions(found: DataFrame, key: str) -> DataFrame:
    """Each mention once per record and label without case, in its first spelling."""
    return found.groupBy(key, F.lower("mention").alias("entity"), "label").agg(F.min_by("mention", "pos").alias("mention"))


def entity_index(entities: DataFrame, key: str) -> DataFrame:
    """entity, records, first_record: the inverted index in rows; a frequent entity is never collected into one."""
    return entities.groupBy("entity", "label").agg(F.count("*").alias("records"), F.min(key).alias("first_record"))


def last_turns(turns: DataFrame, session: str, order: list, most: int = lx.SESSION_TURNS) -> DataFrame:
    """The last turns of each session, the newest first."""
    newest = W.partitionBy(session).orderBy(*[F.desc(c) for c in order])
    return turns.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= most)


def session_islands(events: DataFrame, user: str, time: str, gap: int = lx.SESSION_SECONDS) -> DataFrame:
    """user, island, start, end, events: runs of events with less than gap seconds between neighbours."""
    w = W.partitionBy(user).orderBy("us", "tie")
    seen = events.withColumn("us", F.unix_micros(F.col(time).cast("timestamp"))).withColumn("tie", F.xxhash64(*events.columns))
    marked = seen.withColumn("new", F.when(F.col("us") - F.lag("us").over(w) < gap * 1_000_000, 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    return marked.groupBy(user, "island").agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"), F.count("*").alias("events"))


def trace_summary(events: DataFrame) -> DataFrame:
    """Per session and node: events, total and mean latency with missing ones as 0, errors, greatest value, runs."""
    latency = F.coalesce("value", F.lit(0.0))
    return events.groupBy("user_id", "event_type").agg(
        F.count("*").alias("n"), F.round(F.sum(latency), 3).alias("total_latency"), F.round(F.avg(latency), 3).alias("mean_latency"),
        F.count_if(F.col("event_type") == "error").alias("errors"), F.max(latency).alias("max_latency"))


def prompt_cache(prompts: DataFrame, text: str) -> DataFrame:
    """key, asked, hits: each different prompt is answered once, the rest are hits."""
    return prompts.groupBy(F.md5(text).alias("key")).agg(F.count("*").alias("asked")).withColumn("hits", F.col("asked") - 1)


def json_part(text):
    """The JSON object in a text, with or without a fence around it; null if there is none."""
    body = F.regexp_replace(text, r"```(?:json)?", "")
    return F.try_parse_json(F.nullif(F.regexp_extract(body, r"(?s)(\{.*\})", 1), F.lit("")))
