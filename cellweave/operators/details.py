"""Withheld details found again in responses, and the depth index made of them.

A detail counts by its level; lists score by the items found as whole tokens, phrases by a whole match (number words are
digits) or else by the share of their content words that the response has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.rates import DIGITS, ratio

# Level weights, the least score that counts, the least length of a response with an index.
RATIOS = {1: 0.25, 2: 0.5, 3: 1.0}
LEAST_SCORE = 1.0 / 3.0
LENGTH_GATE = 200
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten")
#: Words that carry no content, for the share of content words.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with")
NOT_TOKEN = r"[^\p{L}\p{N}]+"


def tokens_text(text: Column) -> Column:
    """Tokens with single spaces, padded by one on either side, so that ``contains`` finds whole tokens."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.replace(text, F.lit("’"), F.lit("'")), NOT_TOKEN, " ")), F.lit(" "))


def canonical(tokens: Column) -> Column:
    """Lower case, number words as digits."""
    out = F.lower(tokens)
    for value, word in enumerate(NUMBERS):
        out = F.replace(out, F.lit(f" {word} "), F.lit(f" {value} "))
    return out


def details_of(papers: DataFrame) -> DataFrame:
    """(probe, detail_id, level, kind, needle, items, content) of every withheld detail; short lists, prepared once."""
    rows = papers.select(F.lower(F.concat(F.lit("is-"), F.trim("paper_id"))).alias("probe"), F.posexplode("probe.withheld_details").alias("pos", "d"))
    text = F.coalesce(F.col("d.text"), F.lit(""))
    kind = F.when(F.col("d.match_type").isin("exact_list", "exact_list_case_insensitive"), F.col("d.match_type")).otherwise("phrase_match")
    items = F.filter(F.transform(F.split(text, ","), lambda i: F.trim(i)), lambda i: i != "")
    padded = F.transform(items, tokens_text)
    content = F.array_distinct(F.filter(F.split(F.trim(F.lower(tokens_text(text))), " "), lambda w: (w != "") & ~w.isin(*STOP)))
    return rows.select(
        "probe", "pos", F.coalesce("d.id", F.col("pos").cast("string")).alias("detail_id"), F.col("d.level").alias("level"), kind.alias("kind"), canonical(tokens_text(text)).alias("needle"),
        F.when(kind == "exact_list", padded).otherwise(F.transform(padded, F.lower)).alias("items"), content.alias("content"),
    )


def ceilings(papers: DataFrame) -> DataFrame:
    """Per probe: the index of a response that has every detail, and how the details are made up."""
    per_level = details_of(papers).groupBy("probe", "level").agg(F.count("*").alias("k"))
    weight = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in RATIOS.items()])
    sums = per_level.groupBy("probe").agg(
        F.sum("k").alias("n_details"), F.round(F.sum(F.col("k") * weight) / F.sum("k"), DIGITS).alias("ceiling"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "k"))), lambda x: F.concat(x["k"].cast("string"), F.lit("xL"), x["level"].cast("string"))), ", ").alias("mix"),
    )
    return sums


def matches(results: DataFrame, papers: DataFrame) -> DataFrame:
    """(row_no, run, probe, model, pos, detail_id, level, score, at) of every detail found with at least LEAST_SCORE.

    ``at`` has the items of a list in the order of their first places in the text. The details of a probe come as one array, so
    that a response's texts are not multiplied by them; only what is found becomes a row.
    """
    columns = ("pos", "detail_id", "level", "kind", "needle", "items", "content")
    known = details_of(papers).groupBy("probe").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("details"))
    rows = results.where(F.length("text") > 0).select("row_no", "run", "probe", "model", tokens_text(F.col("text")).alias("hay")).join(known, "probe")
    rows = rows.select("row_no", "run", "probe", "model", "details", "hay", F.lower("hay").alias("low"))
    rows = rows.select("*", canonical(F.col("low")).alias("canon"), F.split(F.trim("low"), " ").alias("words"))
    found = lambda d, text: F.size(F.filter(d["items"], lambda i: F.contains(text, i))) / F.greatest(F.size(d["items"]), F.lit(1))

    def scored(d: Column) -> Column:
        share = F.size(F.array_intersect(d["content"], "words")) / F.greatest(F.size(d["content"]), F.lit(1))
        phrase = F.when((F.trim(d["needle"]) != "") & F.contains("canon", d["needle"]), 1.0).otherwise(share)
        text = F.when(d["kind"] == "exact_list", F.col("hay")).otherwise(F.col("low"))
        score = F.when(d["kind"] == "phrase_match", phrase).otherwise(found(d, text))
        places = F.transform(d["items"], lambda i: F.struct(F.instr(text, i).alias("place"), F.trim(i).alias("item")))
        at = F.when(d["kind"] != "phrase_match", F.transform(F.array_sort(F.filter(places, lambda x: x["place"] > 0)), lambda x: x["item"]))
        return F.struct(d["pos"].alias("pos"), d["detail_id"].alias("detail_id"), d["level"].alias("level"), F.round(score, DIGITS).alias("score"), at.alias("at"))

    hits = F.filter(F.transform("details", scored), lambda x: x["score"] >= F.lit(round(LEAST_SCORE, DIGITS)))
    return rows.select("row_no", "run", "probe", "model", F.inline(hits))


def depth(results: DataFrame, papers: DataFrame) -> DataFrame:
    """(row_no, run, probe, model, edi, skipped): the depth index of every response, or why it has none."""
    weight = F.coalesce(*[F.when(F.col("level") == k, F.lit(v)) for k, v in RATIOS.items()], F.lit(0.0))
    sums = matches(results, papers).groupBy("row_no").agg(F.sum(weight * F.col("score")).alias("total"), F.count("*").alias("n_matches"), F.count_if(F.col("level") >= 2).alias("n_deep"))
    counts = details_of(papers).groupBy("probe").agg(F.count("*").alias("n_details"))
    rows = results.select("row_no", "run", "probe", "model", F.length(F.coalesce("text", F.lit(""))).alias("size")).join(counts, "probe", "left").join(sums, "row_no", "left")
    skipped = F.when(F.coalesce("n_details", F.lit(0)) == 0, "no_withheld_details").when(F.col("size") < LENGTH_GATE, "below_length_gate")
    edi = F.when(skipped.isNull(), F.round(F.coalesce("total", F.lit(0.0)) / F.col("n_details"), DIGITS))
    return rows.select("row_no", "run", "probe", "model", edi.alias("edi"), skipped.alias("skipped"), F.coalesce("n_matches", F.lit(0)).alias("n_matches"), F.coalesce("n_deep", F.lit(0)).alias("n_deep"))


def by_level(found: DataFrame) -> DataFrame:
    """Scores per level, over all responses."""
    return found.groupBy("level").agg(F.count("*").alias("n"), F.round(F.sum("score"), 6).alias("score"))


def depth_stats(indexed: DataFrame, caps: DataFrame, by: list[str]) -> DataFrame:
    """Engagement depth of each group: mean and exact median (no index counts 0), and achievement (of those with index and ceiling)."""
    rows = indexed.join(caps.select("probe", "ceiling"), "probe", "left")
    counted = F.col("edi").isNotNull() & (F.coalesce("ceiling", F.lit(0.0)) > 0)
    value = F.coalesce("edi", F.lit(0.0))
    sums = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.round(F.avg(value), 6).alias("mean_edi"), F.round(F.median(value), 6).alias("median_edi"),
        F.sum(F.when(counted, F.col("edi"))).alias("got"), F.sum(F.when(counted, F.col("ceiling"))).alias("could"),
    )
    return sums.select(*by, "n", "mean_edi", "median_edi", F.round(ratio(F.col("got"), F.col("could")), 6).alias("achievement"))
