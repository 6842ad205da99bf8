"""Failure rates of cells: per model, domain, run, and over runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.grid import CLASSES, ER, EU, RR, RU, fails_a, fails_i

DIGITS = 9


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, 0 where b is 0 or null."""
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), DIGITS)


def measured(cells: DataFrame) -> DataFrame:
    """Cells that count: those that were not tripped."""
    return cells.where(~F.col("tripped"))


def failure_rates(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Micro rates over all measured cells of each group: n, failures and rates on both sides, and their gap."""
    sums = measured(cells).groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(fails_a(F.col("cls"))).alias("fail_a"), F.count_if(fails_i(F.col("cls"))).alias("fail_i")
    )
    a, i = ratio(F.col("fail_a"), F.col("n")), ratio(F.col("fail_i"), F.col("n"))
    return sums.select("*", a.alias("ifr_a"), i.alias("ifr_i"), F.round(a - i, DIGITS).alias("disclaimer_tax"))


def failure_rollup(cells: DataFrame) -> DataFrame:
    """Model and domain rates with their totals, in one pass; a total's name is ``(all)``."""
    sums = measured(cells).rollup("model", "domain").agg(
        F.count("*").alias("n"), F.count_if(fails_a(F.col("cls"))).alias("fail_a"), F.count_if(fails_i(F.col("cls"))).alias("fail_i"), F.grouping_id().alias("g")
    )
    return sums.select(
        F.when(F.col("g") >= 2, "(all)").otherwise(F.col("model")).alias("model"),
        F.when(F.col("g") >= 1, "(all)").otherwise(F.col("domain")).alias("domain"),
        "n", "fail_a", "fail_i", ratio(F.col("fail_a"), F.col("n")).alias("ifr_a"), ratio(F.col("fail_i"), F.col("n")).alias("ifr_i"),
    )


def class_counts(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Cells per class, trips, and nulls (which are also counted as unrecognised refusals)."""
    count = lambda c: F.count_if(F.coalesce(F.col("cls") == c, F.lit(False)))
    return cells.groupBy(*by).agg(
        F.count("*").alias("n_cells"),
        *[count(c).alias(n) for n, c in (("n_rr", RR), ("n_ru", RU), ("n_er", ER), ("n_eu", EU))],
        F.count_if("tripped").alias("n_tripped"),
        F.count_if("is_null").alias("n_null"),
    )


def class_pivot(cells: DataFrame) -> DataFrame:
    """Models by classes."""
    wide = measured(cells).groupBy("model").pivot("cls", list(CLASSES)).agg(F.count("cls"))
    return wide.select("model", *[F.coalesce(F.col(c), F.lit(0)).alias(c.lower()) for c in CLASSES])


def null_adjusted(cells: DataFrame) -> DataFrame:
    """Pooled rates with nulls as refusals and without nulls, and the nulls' share."""
    one = measured(cells).agg(
        F.count("*").alias("dispatched"), F.count_if(fails_a(F.col("cls"))).alias("engaged"), F.count_if("is_null").alias("nulls")
    )
    return one.select(
        "dispatched", "engaged", "nulls",
        ratio(F.col("engaged"), F.col("dispatched")).alias("rate_all"),
        ratio(F.col("engaged"), F.col("dispatched") - F.col("nulls")).alias("rate_content"),
        ratio(F.col("nulls"), F.col("dispatched")).alias("null_share"),
    )


def probe_refusals(cells: DataFrame) -> DataFrame:
    """Per probe: attempts, refusals, nulls, trips and refusal rate."""
    refused = F.count_if(~F.col("tripped") & ~fails_a(F.col("cls")))
    sums = cells.groupBy("probe").agg(
        F.count_if(~F.col("tripped")).alias("attempts"), refused.alias("refused"), F.count_if("is_null").alias("nulls"), F.count_if("tripped").alias("n_tripped")
    )
    return sums.select("*", ratio(F.col("refused"), F.col("attempts")).alias("refusal_rate"))


def model_nulls(cells: DataFrame) -> DataFrame:
    """Per model: nulls, their rate, and their share of refusals."""
    sums = measured(cells).groupBy("model").agg(
        F.count("*").alias("dispatched"), F.count_if("is_null").alias("nulls"), F.count_if(~fails_a(F.col("cls"))).alias("refusals")
    )
    return sums.select("*", ratio(F.col("nulls"), F.col("dispatched")).alias("null_rate"), ratio(F.col("nulls"), F.col("refusals")).alias("null_share"))


def run_rates(cells: DataFrame) -> DataFrame:
    """Rates of each run."""
    return failure_rates(cells, ["run"])


def headline(cells: DataFrame) -> DataFrame:
    """Unweighted mean and population deviation of the runs' rates."""
    return failure_rates(cells, ["run"]).agg(
        F.count("*").alias("n_runs"),
        *[F.round(f(c), DIGITS).alias(f"{c}_{n}") for c in ("ifr_a", "ifr_i") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))],
    )


def model_run_means(cells: DataFrame) -> DataFrame:
    """Per model the mean over runs; a run in which a model has no measured cell gives nothing."""
    return failure_rates(cells, ["model", "run"]).groupBy("model").agg(
        F.count("*").alias("n_runs"),
        *[F.round(f(c), DIGITS).alias(f"{c}_{n}") for c in ("ifr_a", "ifr_i") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))],
    )


def grid_counters(cells: DataFrame) -> DataFrame:
    """Size of the grid, observed and never observed pairs."""
    pairs = cells.groupBy("probe", "model").agg(F.max("observed").alias("seen"))
    sizes = cells.agg(F.count_distinct("probe").alias("n_probes"), F.count_distinct("model").alias("n_models"), F.count_distinct("run").alias("n_runs"))
    seen = pairs.agg(F.count_if("seen").alias("n_observed"))
    both = sizes.join(seen)
    expected = F.col("n_probes") * F.col("n_models")
    return both.select("*", expected.alias("n_expected"), (expected - F.col("n_observed")).alias("n_never_observed"))


def compare_runs(cells: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """Pairs of two runs side by side (by default the first and the last), and whether class or side changed."""
    if a is None or b is None:
        ends = cells.agg(F.min("run").alias("a"), F.max("run").alias("b"))
        picked = cells.join(F.broadcast(ends))
        left, right = picked.where("run = a"), picked.where("run = b")
    else:
        left, right = cells.where(F.col("run") == a), cells.where(F.col("run") == b)
    pick = lambda df, n: df.select("probe", "model", F.col("cls").alias(n))
    both = pick(left, "cls_a").join(pick(right, "cls_b"), ["probe", "model"])
    return both.select(
        "*", (~F.col("cls_a").eqNullSafe(F.col("cls_b"))).alias("changed"), (fails_a(F.col("cls_a")) != fails_a(F.col("cls_b"))).alias("crossed")
    )


def compare_summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("n"), F.count_if("changed").alias("n_changed"), F.count_if("crossed").alias("n_crossed"))


def run_summary(results: DataFrame) -> DataFrame:
    """Per run: results, failed results, models, and latency of good ones."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    return results.groupBy("run").agg(
        F.count("*").alias("n_results"),
        F.count_if(failed).alias("n_failed"),
        F.count_distinct("model").alias("n_models"),
        F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"),
        F.coalesce(F.round(F.avg(F.when(~failed, F.col("latency_ms"))), 1), F.lit(0.0)).alias("mean_latency"),
        F.coalesce(F.max(F.when(~failed, F.col("latency_ms"))), F.lit(0.0)).alias("max_latency"),
    )


#: Two rates are equal within this.
TOLERANCE = 1e-9


def invariants(cells: DataFrame, reported: DataFrame | None = None, reported_domains: DataFrame | None = None) -> DataFrame:
    """(scope, name, violation): violations of the grid's arithmetic; empty when all holds.

    Per model: classes and trips sum up to probes x runs; no more nulls than unrecognised refusals; measured and tripped cells
    of each run make up all probes; the reported headline rates (model, ifr_a_mean, ifr_i_mean; by default this engine's) are
    the means over runs; the reported domain sums (model, domain, n, fail_a, fail_i) add up to the model's cells and failures on
    either side.
    """
    size = cells.agg(F.count_distinct("probe").alias("probes"), F.count_distinct("run").alias("runs"))
    head = model_run_means(cells) if reported is None else reported
    by_domain = failure_rates(cells, ["model", "domain"]) if reported_domains is None else reported_domains
    counts = class_counts(cells, ["model"]).crossJoin(size)
    runs = cells.groupBy("model", "run").agg(F.count_if("tripped").alias("t"), F.count_if(~F.col("tripped")).alias("m"), F.count_if(~F.col("tripped") & fails_a(F.col("cls"))).alias("a"), F.count_if(~F.col("tripped") & fails_i(F.col("cls"))).alias("i"))
    drift = runs.crossJoin(size).groupBy("model").agg(F.count_if(F.col("t") + F.col("m") != F.col("probes")).alias("drifted"))
    means = runs.where("m > 0").groupBy("model").agg(F.avg(F.col("a") / F.col("m")).alias("mean_a"), F.avg(F.col("i") / F.col("m")).alias("mean_i"))
    totals = runs.groupBy("model").agg(F.sum("m").alias("sum_m"), F.sum("a").alias("sum_a"), F.sum("i").alias("sum_i"))
    domains = by_domain.groupBy("model").agg(F.sum("n").alias("dom_m"), F.sum("fail_a").alias("dom_a"), F.sum("fail_i").alias("dom_i"))
    rows = counts.join(drift, "model").join(totals, "model").join(means, "model", "left").join(head.select("model", "ifr_a_mean", "ifr_i_mean"), "model", "left").join(domains, "model", "left")
    apart = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) > TOLERANCE, F.lit(False))
    differ = lambda a, b: F.coalesce(F.col(a), F.lit(0)) != F.coalesce(F.col(b), F.lit(0))
    rules = {
        "classes do not sum up to the grid": F.col("n_rr") + F.col("n_ru") + F.col("n_er") + F.col("n_eu") + F.col("n_tripped") != F.col("probes") * F.col("runs"),
        "more nulls than unrecognised refusals": F.col("n_null") > F.col("n_ru"),
        "cells missing from a run": F.col("drifted") > 0,
        "headline on the answer side is no mean over runs": apart("ifr_a_mean", "mean_a"),
        "headline on the insight side is no mean over runs": apart("ifr_i_mean", "mean_i"),
        "domains do not add up to the cells": differ("dom_m", "sum_m"),
        "domains do not add up to the failures on the answer side": differ("dom_a", "sum_a"),
        "domains do not add up to the failures on the insight side": differ("dom_i", "sum_i"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return rows.select(F.lit("model").alias("scope"), F.col("model").alias("name"), F.explode(found).alias("violation"))


def run_detail(results: DataFrame) -> DataFrame:
    """Per run and model: good and failed results, mean and greatest latency of good ones (0 without any)."""
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    good = F.when(~failed, F.col("latency_ms"))
    return results.groupBy("run", "model").agg(
        F.count_if(~failed).alias("n_ok"), F.count_if(failed).alias("n_failed"), F.coalesce(F.round(F.avg(good), 1), F.lit(0.0)).alias("mean_latency"), F.coalesce(F.round(F.max(good), 1), F.lit(0.0)).alias("max_latency")
    )
