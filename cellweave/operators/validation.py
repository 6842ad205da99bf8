"""Checks of labels and configurations: each gives the rows that break a rule, none if all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.grid import CLASSES

# Confidences of a label.
CONFIDENCES = ("high", "low", "medium")


def _broken(rows: DataFrame, keys: tuple[str, ...], rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return rows.select(*keys, F.explode(found).alias("issue"))


def label_issues(labels: DataFrame, gaps: tuple[str, ...], key: str = "key") -> DataFrame:
    """(key, issue) of labels with an unknown class, confidence or rule gap, or without the detail that the gap ``other`` needs."""
    return _broken(
        labels,
        (key,),
        {
            "bad_classification": ~F.coalesce(F.col("classification").isin(*CLASSES), F.lit(False)),
            "bad_confidence": ~F.coalesce(F.col("confidence").isin(*CONFIDENCES), F.lit(False)),
            "bad_rule_gap": F.col("rule_gap").isNotNull() & ~F.col("rule_gap").isin(*gaps, "other"),
            "no_gap_detail": (F.col("rule_gap") == "other") & (F.trim(F.coalesce("rule_gap_detail", F.lit(""))) == ""),
            "pass_contradicts_class": F.col("pass") != F.startswith("classification", F.lit("REFUSED")),
        },
    )


def valid_findings(findings: DataFrame, locators: DataFrame, locator: str = "locator") -> DataFrame:
    """Findings whose locator is a listed one."""
    return findings.join(locators.select(locator), locator, "left_semi")


def dangling_references(models: DataFrame, providers: DataFrame) -> DataFrame:
    """Configured models whose provider is not configured. ``models``: model, provider; ``providers``: provider."""
    return models.join(providers.select("provider"), "provider", "left_anti")


def self_judges(panel: DataFrame, benchmarked: DataFrame) -> DataFrame:
    """Panel members that are benchmarked themselves. ``panel``: member; ``benchmarked``: model."""
    return panel.join(benchmarked.select(F.col("model").alias("member")), "member", "left_semi")


def threshold_issues(settings: DataFrame) -> DataFrame:
    """(name, issue) of settings out of their range. ``settings``: name, value, least, most (null for no bound)."""
    return _broken(settings, ("name",), {"missing": F.col("value").isNull(), "too_small": F.col("value") < F.col("least"), "too_large": F.col("value") > F.col("most")})
