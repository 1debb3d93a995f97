"""Text expressions: cleaning, tokens, sentences. All are JVM columns except nfkc()."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docengine.functions import lexicon as lx
from docengine.plans.staging import ship_with_tasks

ship_with_tasks(__name__)

_W = r"[\p{L}\p{N}_]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility normalisation, which Spark lacks."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def replace_literals(text: Column) -> Column:
    """The literal replacements that follow normalisation."""
    marks = lx.REPLACED_BY_BLANK + lx.DOUBLE_QUOTES + lx.SINGLE_QUOTES + lx.DASHES
    return F.translate(text, marks + lx.REMOVED, " " + '""' + "''" + "-" * len(lx.DASHES))


def drop_control(text: Column) -> Column:
    """Without characters of category C other than newline and tab."""
    return F.regexp_replace(text, r"[\p{C}&&[^\n\t]]", "")


def join_hyphenated(text: Column) -> Column:
    return F.regexp_replace(text, rf"({_W})-\n({_W})", "$1$2")


def unix_lines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def trim_lines(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"^\s+|\s+$", "")), "\n")


def squeeze_blank_lines(text: Column) -> Column:
    return F.regexp_replace(text, "\n{3,}", "\n\n")


def drop_number_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*[0-9]+\s*$")), "\n")


def drop_repeated_neighbours(text: Column) -> Column:
    """Each run of equal lines as one line; one pass, whatever the number of lines."""
    return F.regexp_replace(text, r"(?md)^(.*+)(?:\n\1$)+", "$1")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clean_text(text: Column) -> Column:
    """The cleaning chain without NFKC, which callers put in front with nfkc() (T09); null stays null."""
    out = unix_lines(drop_control(replace_literals(text)))
    out = trim_lines(join_hyphenated(out))
    return strip(squeeze_blank_lines(drop_number_lines(drop_repeated_neighbours(out))))


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def blank_tokens(text: Column) -> Column:
    """Lower-case tokens parted by white space, with repeats."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def word_tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text, with repeats."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), 1)


def word_set(text: Column) -> Column:
    return F.array_distinct(word_tokens(text))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token sets; 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def token_estimate(text: Column) -> Column:
    """At least 1, else 1.3 per blank-parted word, rounded down."""
    return F.greatest(F.lit(1), F.floor(F.size(blank_tokens(text)) * 1.3)).cast("int")


def sentences(text: Column) -> Column:
    """After a full stop and blank, or at pipes between blanks; without empty ones."""
    return F.filter(F.transform(F.split(text, r"(?<=[.?!])\s+|\s+\x7C\s+"), strip), lambda s: s != "")


def cited_sentences(text: Column) -> Column:
    """Sentences that keep a following citation tag."""
    return F.filter(F.transform(F.split(strip(text), r"(?<=[.!?])\s+(?!\[C_)|(?<=\])\s+(?=\p{Lu})"), strip), lambda s: s != "")


def tags(text: Column) -> Column:
    """Citation tags in order of appearance."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[(C_[0-9A-Za-z]+)\]"), 1)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def symbol_ratio(text: Column) -> Column:
    """Share of characters that are neither letters, digits nor white space; 1 for an empty text."""
    return F.when(F.length(text) == 0, F.lit(1.0)).otherwise(F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s]", "")) / F.length(text))


def needs_ocr(text: Column) -> Column:
    """Null, shorter than 40 without outer blanks, or more than a fifth symbols."""
    return text.isNull() | (F.length(strip(text)) < 40) | (symbol_ratio(strip(text)) > 0.2)


def hex_to_id(text: Column) -> Column:
    """The first 15 hexadecimal digits after the prefix as a number."""
    return F.conv(F.substring(F.regexp_replace(text, "^C_", ""), 1, 15), 16, 10).cast("bigint")
