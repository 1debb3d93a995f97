"""Mixing sources to target weights (problem 8): iterative proportional fitting over token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docengine.plans.staging import stage

#: Largest change of a cell in one round, as a share of all tokens, at which the fitting ends, and the rounds after which it ends anyway.
TOLERANCE, MOST_ROUNDS = 1e-7, 60
#: Rounds between two looks at the change.
LOOK = 4


def token_count(text: Column) -> Column:
    """Runs of letters and digits, and single other characters except white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"(?U)[\p{L}\p{Nd}]+|[^\s\p{L}\p{Nd}]")), F.lit(0)).cast("bigint")


def _counted(documents: DataFrame) -> DataFrame:
    lang, topic = F.coalesce(F.lower(F.substring("lang", 1, 2)), F.lit("un")), F.coalesce("document_type", F.lit("other"))
    return documents.select("doc_id", "source", lang.alias("lang"), topic.alias("topic"), token_count(F.col("text")).alias("tokens"))


def _wanted(targets: DataFrame) -> DataFrame:
    return targets.groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(0)).alias("max_repeats"))


def _goals(cells: DataFrame, key: str, shares: DataFrame | None) -> DataFrame:
    """key and its share of the mixture: as given, scaled to those that the cells have, or else its share of the corpus."""
    given = cells.groupBy(key).agg(F.sum("tokens").cast("double").alias("share"))
    if shares is not None:
        given = given.drop("share").join(shares.groupBy(key).agg(F.max("share").cast("double").alias("share")), key, "left").fillna(0.0, ["share"])
    total = F.sum("share").over(W.partitionBy())  # a row per language or topic
    return given.select(key, F.when(total > 0, F.col("share") / total).otherwise(F.lit(0.0)).alias(f"{key}_share"))


def rake(documents: DataFrame, targets: DataFrame, lang_shares: DataFrame | None = None, topic_shares: DataFrame | None = None) -> DataFrame:
    """source, lang, topic, docs, tokens, source_goal, weight, rate: the cells of the corpus with weights fitted to three marginals.

    The marginals are the tokens that each source is to give (its target_share of all tokens of sources with a target, at most max_repeats
    times its own), and shares of languages and topics: lang_shares (lang, share) and topic_shares (topic, share), or those of the corpus.
    Iterative proportional fitting over the cell table (a row per source, language and topic, never per document): language, then topic,
    then source, until no cell changes by more than TOLERANCE of all tokens or MOST_ROUNDS are over. The source step bounds each cell at
    max_repeats times its tokens and gives the rest to the source's open cells, so that source totals are exact and no rate exceeds
    max_repeats. Null shares and repeats count as 0, a source named twice counts once with the larger values, and documents of
    sources without target take no part.
    """
    want = _wanted(targets)
    cells = _counted(documents).groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    cells = stage(cells.join(want, "source"))
    sums = {k: W.partitionBy(k) for k in ("source", "lang", "topic")}
    own = F.sum("tokens").over(sums["source"])
    total = F.sum("tokens").over(W.partitionBy())  # the cell table is small; one task adds it up
    fit = cells.withColumns({"own": own, "total": total}).withColumn("source_goal", F.least(F.col("max_repeats") * F.col("own"), F.greatest(F.col("target_share") * F.col("total"), F.lit(0.0))))
    fit = fit.withColumn("weight", F.col("source_goal") * F.col("tokens") / F.greatest("own", F.lit(1))).withColumn("most", (F.col("max_repeats") * F.col("tokens")).cast("double"))
    fit = fit.withColumn("all_goals", F.sum("weight").over(W.partitionBy()))
    for key, shares in (("lang", lang_shares), ("topic", topic_shares)):
        fit = fit.join(_goals(cells, key, shares), key)
    fit = stage(fit.withColumn("change", F.lit(0.0)))
    # The cells that a common factor lifts to their bound first come first. The tokens that a factor gives are the least of the sums
    # "cells before at their bound, the others times the factor", so the factor that gives the goal is the largest that any of them needs.
    order = W.partitionBy("source").orderBy(F.col("most") / F.nullif("weight", F.lit(0.0)), "lang", "topic")
    full = F.coalesce(F.sum("most").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    still = F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing))
    for _ in range(MOST_ROUNDS // LOOK):
        for n in range(LOOK):
            if n == LOOK - 1:
                fit = fit.withColumn("change", F.col("weight"))
            for key in ("lang", "topic"):
                now = F.sum("weight").over(sums[key])
                fit = fit.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"{key}_share") * F.col("all_goals") / now).otherwise(F.lit(0.0)))
            fit = fit.withColumn("factor", F.when(still > 0, (F.col("source_goal") - full) / still))
            fit = fit.withColumn("weight", F.coalesce(F.least("most", F.col("weight") * F.max("factor").over(sums["source"])), F.lit(0.0))).drop("factor")
        fit = stage(fit.withColumn("change", F.abs(F.col("weight") - F.col("change")) / F.greatest("all_goals", F.lit(1.0))))
        if (fit.agg(F.max("change")).first()[0] or 0.0) <= TOLERANCE:
            break
    rate = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(F.lit(0.0))
    return fit.select("source", "lang", "topic", "docs", "tokens", "total", "source_goal", "weight", rate.alias("rate"))


def source_plan(documents: DataFrame, targets: DataFrame, **shares: DataFrame) -> DataFrame:
    """source, tokens, total, target_share, max_repeats, copies, status, actual_share: a row per source of targets.

    copies is the fitted weight of the source in passes over its documents, rounded up: the least whole number of passes that reaches
    target_share of all tokens, at most max_repeats. status is 'short' if that does not suffice or the source has no tokens, else 'met'.
    """
    fitted = rake(documents, targets, **shares).groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("weight").alias("weight"), F.max("total").alias("all"))
    plan = _wanted(targets).join(fitted, "source", "left").withColumns({"tokens": F.coalesce("tokens", F.lit(0)).cast("bigint"), "weight": F.coalesce("weight", F.lit(0.0))})
    plan = plan.withColumn("total", F.coalesce(F.max("all").over(W.partitionBy()), F.lit(0)).cast("bigint"))  # a row per source with a target
    need, most, tokens = F.col("target_share") * F.col("total"), F.col("max_repeats").cast("bigint"), F.col("tokens")
    copies = F.least(F.ceil(F.col("weight") / F.greatest(tokens, F.lit(1))), most)
    # sums of weights may lie a rounding error beside the whole number: the products decide
    copies = F.when((copies > 0) & ((copies - 1) * tokens >= need), copies - 1).when((copies < most) & (copies * tokens < need), copies + 1).otherwise(copies)
    plan = plan.withColumn("copies", F.when(tokens == 0, 0).otherwise(copies).cast("int"))
    plan = plan.withColumn("status", F.when((tokens > 0) & (F.col("copies") * tokens >= need), "met").otherwise("short"))
    given = F.sum(F.col("copies") * tokens).over(W.partitionBy())  # a row per source with a target
    return plan.drop("weight", "all").withColumn("actual_share", F.when(given > 0, F.col("copies") * tokens / given).otherwise(F.lit(0.0)))


def mix(documents: DataFrame, targets: DataFrame, seed: int = 17, **shares: DataFrame) -> DataFrame:
    """doc_id, source, tokens, repeats: how often each document goes into the mixture.

    A document's expected repeats are its cell's calibrated rate, which is at most max_repeats; the fraction is settled by a hash of doc_id,
    so the draw is repeatable and needs no shuffle of texts. Documents without tokens or of other sources get no row.
    """
    rates = rake(documents, targets, **shares).select("source", "lang", "topic", "rate")
    hit = _counted(documents).filter("tokens > 0").join(rates, ["source", "lang", "topic"])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    repeats = (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")
    return hit.select("doc_id", "source", "tokens", repeats.alias("repeats")).filter("repeats > 0")


def mixture_report(documents: DataFrame, targets: DataFrame, **shares: DataFrame) -> DataFrame:
    """source, target_share, drawn_tokens, drawn_share of the mixture that mix() draws."""
    drawn = mix(documents, targets, **shares).groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn_tokens"))
    out = targets.groupBy("source").agg(F.max("target_share").alias("target_share")).join(drawn, "source", "left")
    out = out.withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
    return out.withColumn("drawn_share", F.col("drawn_tokens") / F.sum("drawn_tokens").over(W.partitionBy()))
