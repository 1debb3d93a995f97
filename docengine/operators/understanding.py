"""Query understanding: repair, intents, flags, rewriting."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from docengine.functions import lexicon as lx
from docengine.functions import text as tx
from docengine.plans.staging import ship_with_tasks

ship_with_tasks(__name__)


def preprocess(query: Column) -> Column:
    """Trimmed, blanks and repeated marks collapsed, known misreadings repaired (Q01)."""
    out = F.regexp_replace(tx.strip(query), r"\s+", " ")
    out = F.replace(F.replace(F.replace(out, F.lit("|"), F.lit(" ")), F.lit("•"), F.lit(" ")), F.lit("—"), F.lit("-"))
    for mark, plain in ((r"\?{2,}", "?"), (r"\.{2,}", "."), (",{2,}", ",")):
        out = F.regexp_replace(out, mark, plain)
    for wrong, right in lx.QUERY_FIXES.items():
        out = F.regexp_replace(out, f"(?i){wrong}", right)
    return out


def _first(patterns: dict[str, str], text: Column) -> Column:
    out = None
    for name, p in patterns.items():
        hit = F.lower(text).rlike(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def first_intent(query: Column) -> Column:
    """The first of 20 ordered patterns that matches (Q02)."""
    return _first(lx.FIRST_INTENTS, query)


def benchmark_intent(query: Column) -> Column:
    return _first(lx.BENCHMARK_INTENTS, query)


def is_comparison(query: Column) -> Column:
    return F.lower(query).rlike(lx.COMPARISON_PATTERN)


def is_small_talk(query: Column) -> Column:
    """Begins with a small-talk phrase, also inside a longer word (Q05)."""
    out = F.lit(False)
    for w in lx.SMALL_TALK:
        out = out | F.startswith(F.lower(F.trim(query)), F.lit(w))
    return out


def in_domain(query: Column) -> Column:
    return ~tx.contains_any(F.lower(query), lx.OFF_DOMAIN)


def is_clean(query: Column) -> Column:
    """Ends with a question mark, begins with a capital, six words or more, intent known (Q07)."""
    first = F.substring(query, 1, 1)
    words = F.size(F.filter(F.split(query, r"\s+"), lambda x: x != ""))
    return F.endswith(query, F.lit("?")) & (first == F.upper(first)) & (first != F.lower(first)) & (words >= 6) & (first_intent(query) != "general")


def normalized(query: Column) -> Column:
    """Capitalised, with one question mark at the end (Q08)."""
    bare = F.regexp_replace(query, r"[.!?\s]+$", "")
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substr(bare, F.lit(2)), F.lit("?"))


def valid_confidence(confidence: Column) -> Column:
    """Between 0 and 1; a half where it is missing (Q09)."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.when(~F.isnan(confidence), confidence), F.lit(0.5))))


def final_intent(query: Column, told: Column, confidence: Column) -> Column:
    """The intent told, if it is a known one, else general; a comparison overrules it, and a pattern where the confidence is low (Q08, Q09)."""
    found, named = first_intent(query), F.lower(told)
    known = F.when(named.isin(*lx.FIRST_INTENTS, *lx.OTHER_INTENTS), named).otherwise("general")
    return F.when(is_comparison(query), "comparison").when((confidence < 0.75) & (found != "general"), found).otherwise(known)


def rewrite(query: Column) -> Column:
    """The first known term's synonym added; else filler removed; else a suffix (Q10)."""
    out = None
    for term, synonym in lx.SYNONYMS.items():
        hit, wide = F.contains(F.lower(query), F.lit(term)), F.concat(query, F.lit(" " + synonym))
        out = F.when(hit, wide) if out is None else out.when(hit, wide)
    bare = F.trim(F.regexp_replace(query, "(?i)" + lx.QUERY_FILLER, ""))
    return out.when(bare == query, F.concat(query, F.lit(" policy details"))).otherwise(bare)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching blocks of two texts, the drift check of a rewritten query."""
    return pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() for x, y in zip(a, b)])
