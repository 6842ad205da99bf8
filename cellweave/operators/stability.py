"""How stable the class of each (probe, model) pair is over runs."""

from __future__ import annotations

import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators.grid import fails_a, fails_i
from cellweave.operators.rates import DIGITS, failure_rates, ratio


def pair_stability(cells: DataFrame) -> DataFrame:
    """Per pair: class counts, mode (ties: the class seen first, by run), consensus, status and stability flags.

    Stability looks at the non-null cells if there are any, else at all cells that were not tripped.
    """
    live = ~F.col("tripped")
    content = live & ~F.col("is_null")
    per_class = cells.where(live).groupBy("probe", "model", "cls").agg(F.count("*").alias("k"), F.min("run").alias("first_run"))
    # The later a class is first seen, the less it counts among equals: its runs are ranked backwards by text.
    mode = per_class.groupBy("probe", "model").agg(
        F.max("k").alias("consensus"),
        F.min_by("cls", F.struct(-F.col("k"), F.col("first_run"), F.col("cls"))).alias("modal"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), F.col("cls").alias("c")))), 1, 2), lambda x: F.concat_ws(":", x["c"], (-x["k"]).cast("string"))), ",").alias("top_two"),
    )
    pairs = cells.groupBy("probe", "model").agg(
        F.count_if(live).alias("n_live"),
        F.count_if("is_null").alias("n_null"),
        F.count_if("tripped").alias("n_tripped"),
        F.count_if(~F.col("observed")).alias("n_unseen"),
        F.count_if(content).alias("n_content"),
        *[F.count_distinct(F.when(content, v)).alias(f"d_{n}") for n, v in (("cls", F.col("cls")), ("a", fails_a(F.col("cls"))), ("i", fails_i(F.col("cls"))))],
    )
    status = (
        F.when(F.col("n_content") > 0, "non_null")
        .when(F.col("n_live") == 0, "all_tripped")
        .when(F.col("n_unseen") == F.col("n_live"), "never_observed")
        .otherwise("all_null_content")
    )
    flag = lambda c: (F.col("n_content") == 0) | (F.col(c) <= 1)
    return pairs.join(mode, ["probe", "model"], "left").select(
        "probe", "model", "n_live", "n_null", "n_tripped", "n_unseen", "modal", "top_two", F.coalesce("consensus", F.lit(0)).alias("consensus"),
        status.alias("status"), flag("d_cls").alias("stable"), flag("d_a").alias("a_stable"), flag("d_i").alias("i_stable"),
    )


def stability_totals(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("n_pairs"), F.count_if("stable").alias("n_stable"), F.count_if(~F.col("stable")).alias("n_unstable"),
        F.count_if("a_stable").alias("n_a_stable"), F.count_if("i_stable").alias("n_i_stable"), F.sum("n_null").alias("n_null"),
        F.count_if(F.col("status") == "all_null_content").alias("n_all_null"), F.count_if(F.col("status") == "all_tripped").alias("n_all_tripped"),
        F.count_if(F.col("status") == "never_observed").alias("n_never_observed"),
    )


def interesting_pairs(pairs: DataFrame, everything: bool = False) -> DataFrame:
    """Unstable pairs and those with a null, or all."""
    return pairs if everything else pairs.where(~F.col("stable") | (F.col("n_null") > 0))


RESAMPLES, ALPHA, SEED = 10_000, 0.05, 42
INTERVAL = "model string, n_runs long, ci_low double, ci_mid double, ci_high double"


def percentile_interval(values: list[float], resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> tuple[float, float, float]:
    """(low, median, high) of bootstrap means; (0, 0, 1) for no values, the value itself for one."""
    if not values:
        return 0.0, 0.0, 1.0
    if len(values) == 1:
        return values[0], values[0], values[0]
    draw = random.Random(seed)
    means = sorted(sum(draw.choices(values, k=len(values))) / len(values) for _ in range(resamples))
    at = lambda share: means[min(resamples - 1, int(resamples * share))]
    return at(alpha / 2), means[resamples // 2], at(1 - alpha / 2)


class _Bootstrap:
    def __init__(self, resamples: int, alpha: float, seed: int) -> None:
        self.settings = resamples, alpha, seed

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(m, len(v), *percentile_interval([float(x) for x in v], *self.settings)) for m, v in zip(pdf.model, pdf.rates)]
            yield pd.DataFrame(rows, columns=["model", "n_runs", "ci_low", "ci_mid", "ci_high"])


def bootstrap_intervals(cells: DataFrame, rate: str = "ifr_a", resamples: int = RESAMPLES, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """Percentile bootstrap of each model's per-run rates, in run order; only one number per run reaches Python."""
    runs = failure_rates(cells, ["model", "run"])
    lists = runs.groupBy("model").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", rate))), lambda x: x[rate]).alias("rates"))
    return lists.mapInPandas(_Bootstrap(resamples, alpha, seed), INTERVAL)


def pair_depth(depths: DataFrame) -> DataFrame:
    """Mean, population deviation and number of the depth indices (not null) of each pair over runs."""
    return depths.where("edi IS NOT NULL").groupBy("probe", "model").agg(
        F.round(F.avg("edi"), DIGITS).alias("edi_mean"), F.round(F.stddev_pop("edi"), DIGITS).alias("edi_sd"), F.count("*").alias("n")
    )


__all__ = ["bootstrap_intervals", "interesting_pairs", "pair_depth", "pair_stability", "percentile_interval", "ratio", "stability_totals"]
