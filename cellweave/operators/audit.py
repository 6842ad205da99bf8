"""Comparing two ways of labelling (a scorer and a judge): direction, clusters, agreement, implied error, content keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators.grid import PASS_A
from cellweave.operators.rates import DIGITS


def content_key(probe: Column, model: Column, text: Column, digits: int = 16) -> Column:
    """The first hexadecimal digits of a SHA-256 over probe, model and text."""
    return F.substring(F.sha2(F.concat_ws("|", probe, model, F.coalesce(text, F.lit(""))), 256), 1, digits)


def version_key(**parts: Column) -> Column:
    """Twelve hexadecimal digits over labelled parts, in the order of their names."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.concat(F.lit(f"{k}="), parts[k]) for k in sorted(parts)]), 256), 1, 12)


def cache_key(*parts: Column) -> Column:
    return F.concat_ws("|", *parts)


def current_entries(entries: DataFrame, key: str, version: str | None) -> DataFrame:
    """Entries whose five-part key ends with the current version; all where no version is known."""
    if version is None:
        return entries
    parts = F.split(F.col(key), r"\|")
    return entries.where((F.size(parts) == 5) & (F.element_at(parts, 5) == version))


def rescored(scored: DataFrame) -> DataFrame:
    """Scored responses (probe, model, text, ...) by content; equal answers of a model to a probe are one."""
    return scored.withColumn("content_key", content_key(F.col("probe"), F.col("model"), F.col("text"))).dropDuplicates(["content_key"])


def direction(scorer: Column, judge: Column) -> Column:
    """pass/fail of both, on the answer side."""
    side = lambda c: F.when(c.isin(*PASS_A), "pass").otherwise("fail")
    return F.concat(F.lit("scorer_"), side(scorer), F.lit("_judge_"), side(judge))


def disagreements(both: DataFrame) -> DataFrame:
    """Rows the two label differently. ``both``: key columns, scorer, judge."""
    return both.where(F.col("scorer").isNotNull() & F.col("judge").isNotNull() & (F.col("scorer") != F.col("judge"))).withColumn("direction", direction(F.col("scorer"), F.col("judge")))


def clusters(diff: DataFrame) -> DataFrame:
    """Disagreements by pair of classes, with the share of all."""
    sized = diff.groupBy("scorer", "judge").agg(F.count("*").alias("n"))
    return sized.join(sized.agg(F.sum("n").alias("total"))).select("scorer", "judge", "n", F.round(F.col("n") / F.col("total"), DIGITS).alias("share"))


def largest_clusters(diff: DataFrame, key: str, shown: int = 3) -> DataFrame:
    """Clusters by size, each with its first rows by ``key`` (the smallest keys, kept by a bounded aggregate)."""
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("_r") <= shown, F.col(key)))), 1, shown)
    salted = diff.withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    # Cut down in salted parts first, so that a large cluster is no hot task.
    part = Window.partitionBy("scorer", "judge", "_s").orderBy(key)
    return salted.withColumn("_r", F.row_number().over(part)).groupBy("scorer", "judge").agg(F.count("*").alias("n"), F.array_join(first, ",").alias("first")).orderBy(F.desc("n"), "scorer", "judge")


def rule_gaps(diff: DataFrame, gap: str = "rule_gap") -> DataFrame:
    """Disagreements by rule gap and direction, with the gap's total, the largest gap first; no gap is left out."""
    each = diff.where(F.col(gap).isNotNull()).groupBy(F.col(gap).alias("gap"), "direction").agg(F.count("*").alias("n"))
    total = each.groupBy("gap").agg(F.sum("n").alias("total"))
    return each.join(total, "gap").orderBy(F.desc("total"), "gap", "direction")


def dispatch_counts(labels: DataFrame, judge: str = "judge_model") -> DataFrame:
    """How often each judge answered, the busiest first."""
    return labels.groupBy(F.col(judge).alias("judge")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "judge")


def agreement_by_star(both: DataFrame) -> DataFrame:
    """Per stratum (starred or not): corpus size, judged, agreement (null without judged rows)."""
    judged = F.col("judge").isNotNull()
    return both.groupBy("starred").agg(
        F.count("*").alias("n_corpus"),
        F.count_if(judged).alias("n_judged"),
        F.round(F.avg(F.when(judged, (F.col("scorer") == F.col("judge")).cast("double"))), DIGITS).alias("agreement"),
    )


def implied_error(both: DataFrame) -> DataFrame:
    """Disagreement extrapolated to the corpus: strata weighted by size; strata without judged rows are skipped."""
    return agreement_by_star(both).agg(
        F.sum("n_corpus").alias("n_corpus"),
        F.round(F.coalesce(F.sum(F.col("n_corpus") * (1 - F.col("agreement"))), F.lit(0.0)) / F.sum("n_corpus"), DIGITS).alias("implied_error"),
    )


def findings(rows: DataFrame, target: str, evidence: str) -> DataFrame:
    """Findings by target: distinct evidence in first-seen order (``ord``), most findings first."""
    grouped = rows.groupBy(target).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", evidence))).alias("seen"))
    return grouped.select(target, "n", F.array_join(F.array_distinct(F.transform("seen", lambda x: x[evidence])), ",").alias("evidence"))


def stratified_sample(rows: DataFrame, by: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows per stratum, chosen by a seeded hash; strata of at most ``n`` rows are whole.

    Each stratum is first cut down in 64 salted parts, so that no large one is sorted in one task.
    """
    ticket = F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))).alias("h"), F.col(key).alias("k"))
    spread = rows.withColumn("_salt", F.pmod(F.xxhash64(F.lit("salt"), F.col(key)), F.lit(64)))
    local = spread.withColumn("_t", ticket).withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy("_t"))).where(F.col("_r") <= n)
    return local.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_t"))).where(F.col("_r") <= n).drop("_salt", "_t", "_r")
