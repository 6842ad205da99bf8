"""Queries on the resolved grid: rates, decompositions, runs, stability, comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import grid, rates, selection, stability
from cellweave.plans.base import RESULTS, cells, on_cells, outcomes
from cellweave.session import materialise, table

Query = Callable[[SparkSession, str], DataFrame]


def _on(build: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return build(cells(spark, sf_dir))

    query.__doc__ = build.__doc__
    return query


def work_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinations of the grid still to be dispatched: those without a successful result."""
    got = materialise(outcomes(spark, sf_dir).select(*grid.KEY, "error"), "outcomes")
    work = grid.work_list(got.select("probe").distinct(), got.select("model").distinct(), got.select("run").distinct())
    return grid.remaining(work, got)


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.run_summary(outcomes(spark, sf_dir)).withColumn("mean_latency", F.round("mean_latency", 0))


def run_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.run_detail(outcomes(spark, sf_dir)).withColumn("mean_latency", F.round("mean_latency", 0))


def run_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running counts of every run in the order of arrival."""
    return selection.progress(outcomes(spark, sf_dir)).select("run", "row_no", "done", "failed", "of")


def tripped_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models with tripped cells."""
    return selection.offenders(cells(spark, sf_dir))


def backfilled_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates per model with never observed probes of the corpus counted as null refusals."""
    all_cells = cells(spark, sf_dir)
    seen = all_cells.where("observed AND NOT tripped").select("probe", "model", "cls", "is_null")
    probes = grid.domains(table(spark, sf_dir, "papers")).select("probe")
    expected = probes.crossJoin(seen.select("model").distinct())
    both = seen.unionByName(grid.backfill(seen, expected)).withColumn("tripped", F.lit(False))
    return rates.failure_rates(both, ["model"])


def duplicates_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The delivery that counts for each cell."""
    return outcomes(spark, sf_dir).select("run", "probe", "model", "row_no")


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run that received a result last."""
    return outcomes(spark, sf_dir).agg(F.max_by("run", F.struct("received_at", "run")).alias("run"), F.max("received_at").alias("received_at"))


RATE = "count(*) AS n, count(*) FILTER (fa) AS fail_a, count(*) FILTER (fi) AS fail_i, round(count(*) FILTER (fa) / count(*), 9) AS ifr_a, round(count(*) FILTER (fi) / count(*), 9) AS ifr_i, round(round(count(*) FILTER (fa) / count(*), 9) - round(count(*) FILTER (fi) / count(*), 9), 9) AS disclaimer_tax"
COUNTS = "count(*) AS n_cells, count(*) FILTER (cls = 'REFUSED_RECOGNIZED') AS n_rr, count(*) FILTER (cls = 'REFUSED_UNRECOGNIZED') AS n_ru, count(*) FILTER (cls = 'ENGAGED_RECOGNIZED') AS n_er, count(*) FILTER (cls = 'ENGAGED_UNRECOGNIZED') AS n_eu, count(*) FILTER (tripped) AS n_tripped, count(*) FILTER (is_null) AS n_null"
MEANS = "count(*) AS n_runs, round(avg(ifr_a), 9) AS ifr_a_mean, round(stddev_pop(ifr_a), 9) AS ifr_a_sd, round(avg(ifr_i), 9) AS ifr_i_mean, round(stddev_pop(ifr_i), 9) AS ifr_i_sd"
PAIRS = """perc AS (SELECT probe, model, cls, count(*) AS k, min(run) AS first_run FROM live GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY probe, model ORDER BY k DESC, first_run, cls) AS r, row_number() OVER (PARTITION BY probe, model ORDER BY k DESC, cls) AS t FROM perc),
modes AS (SELECT probe, model, max(k) AS consensus, max(cls) FILTER (r = 1) AS modal, string_agg(cls || ':' || k, ',' ORDER BY t) FILTER (t <= 2) AS top_two FROM ranked GROUP BY ALL),
agg AS (SELECT probe, model, count(*) FILTER (NOT tripped) AS n_live, count(*) FILTER (is_null) AS n_null, count(*) FILTER (tripped) AS n_tripped, count(*) FILTER (NOT observed) AS n_unseen,
    count(*) FILTER (NOT tripped AND NOT is_null) AS n_content, count(DISTINCT cls) FILTER (NOT tripped AND NOT is_null) AS d_cls,
    count(DISTINCT cls IN ('ENGAGED_RECOGNIZED', 'ENGAGED_UNRECOGNIZED')) FILTER (NOT tripped AND NOT is_null) AS d_a, count(DISTINCT cls = 'ENGAGED_UNRECOGNIZED') FILTER (NOT tripped AND NOT is_null) AS d_i FROM cells GROUP BY ALL),
pairs AS (SELECT agg.probe, agg.model, n_live, n_null, n_tripped, n_unseen, modal, top_two, coalesce(consensus, 0) AS consensus,
    CASE WHEN n_content > 0 THEN 'non_null' WHEN n_live = 0 THEN 'all_tripped' WHEN n_unseen = n_live THEN 'never_observed' ELSE 'all_null_content' END AS status,
    n_content = 0 OR d_cls <= 1 AS stable, n_content = 0 OR d_a <= 1 AS a_stable, n_content = 0 OR d_i <= 1 AS i_stable
    FROM agg LEFT JOIN modes ON modes.probe = agg.probe AND modes.model = agg.model)"""
COMPARED = """ends AS (SELECT min(run) AS a, max(run) AS b FROM cells),
compared AS (SELECT l.probe, l.model, l.cls AS cls_a, r.cls AS cls_b, l.cls IS DISTINCT FROM r.cls AS changed,
    (l.cls IS NULL OR l.cls LIKE 'ENGAGED%') <> (r.cls IS NULL OR r.cls LIKE 'ENGAGED%') AS crossed
    FROM cells l, cells r, ends WHERE l.run = a AND r.run = b AND l.probe = r.probe AND l.model = r.model)"""

QUERIES: dict[str, Query] = {
    "model_failure_rates": _on(lambda c: rates.failure_rates(c, ["model"])),
    "domain_failure_rates": _on(lambda c: rates.failure_rates(c, ["model", "domain"])),
    "run_failure_rates": _on(rates.run_rates),
    "model_run_failure_rates": _on(lambda c: rates.failure_rates(c, ["model", "run"])),
    "failure_rollup": _on(rates.failure_rollup),
    "cells": _on(lambda c: c.select("run", "probe", "model", "domain", "cls", "is_null", "tripped", "observed")),
    "class_counts": _on(lambda c: rates.class_counts(c, ["model"])),
    "class_pivot": _on(rates.class_pivot),
    "domain_class_counts": _on(lambda c: rates.class_counts(c, ["domain", "model"])),
    "null_adjusted": _on(rates.null_adjusted),
    "probe_refusals": _on(rates.probe_refusals),
    "model_nulls": _on(rates.model_nulls),
    "headline": _on(rates.headline),
    "model_run_means": _on(rates.model_run_means),
    "grid_counters": _on(rates.grid_counters),
    "compare_runs": _on(rates.compare_runs),
    "compare_summary": _on(lambda c: rates.compare_summary(rates.compare_runs(c))),
    "grid_invariants": _on(rates.invariants),
    "pair_stability": _on(stability.pair_stability),
    "stability_totals": _on(lambda c: stability.stability_totals(stability.pair_stability(c))),
    "interesting_pairs": _on(lambda c: stability.interesting_pairs(stability.pair_stability(c)).select("probe", "model", "modal", "consensus", "top_two", "status")),
    "bootstrap_intervals": _on(stability.bootstrap_intervals),
    "work_remaining": work_remaining,
    "run_summary": run_summary,
    "run_detail": run_detail,
    "run_progress": run_progress,
    "tripped_models": tripped_models,
    "backfilled_rates": backfilled_rates,
    "duplicates_resolved": duplicates_resolved,
    "latest_run": latest_run,
}

ORACLE: dict[str, str] = {
    "model_failure_rates": on_cells(f"SELECT model, {RATE} FROM live GROUP BY model"),
    "domain_failure_rates": on_cells(f"SELECT model, domain, {RATE} FROM live GROUP BY model, domain"),
    "run_failure_rates": on_cells(f"SELECT run, {RATE} FROM live GROUP BY run"),
    "model_run_failure_rates": on_cells(f"SELECT model, run, {RATE} FROM live GROUP BY model, run"),
    "failure_rollup": on_cells(
        "SELECT coalesce(model, '(all)') AS model, coalesce(domain, '(all)') AS domain, count(*) AS n, count(*) FILTER (fa) AS fail_a, count(*) FILTER (fi) AS fail_i, round(count(*) FILTER (fa) / count(*), 9) AS ifr_a, round(count(*) FILTER (fi) / count(*), 9) AS ifr_i FROM live GROUP BY ROLLUP (model, domain)"
    ),
    "cells": on_cells("SELECT run, probe, model, domain, cls, is_null, tripped, observed FROM cells"),
    "class_counts": on_cells(f"SELECT model, {COUNTS} FROM cells GROUP BY model"),
    "class_pivot": on_cells(
        "SELECT model, " + ", ".join(f"count(*) FILTER (cls = '{c}') AS {c.lower()}" for c in grid.CLASSES) + " FROM live GROUP BY model"
    ),
    "domain_class_counts": on_cells(f"SELECT domain, model, {COUNTS} FROM cells GROUP BY domain, model"),
    "null_adjusted": on_cells(
        "SELECT count(*) AS dispatched, count(*) FILTER (fa) AS engaged, count(*) FILTER (is_null) AS nulls, round(count(*) FILTER (fa) / count(*), 9) AS rate_all, round(coalesce(count(*) FILTER (fa) / nullif(count(*) FILTER (NOT is_null), 0), 0), 9) AS rate_content, round(count(*) FILTER (is_null) / count(*), 9) AS null_share FROM live"
    ),
    "probe_refusals": on_cells(
        "SELECT probe, count(*) FILTER (NOT tripped) AS attempts, count(*) FILTER (NOT tripped AND cls LIKE 'REFUSED%') AS refused, count(*) FILTER (is_null) AS nulls, count(*) FILTER (tripped) AS n_tripped, round(coalesce(count(*) FILTER (NOT tripped AND cls LIKE 'REFUSED%') / nullif(count(*) FILTER (NOT tripped), 0), 0), 9) AS refusal_rate FROM cells GROUP BY probe"
    ),
    "model_nulls": on_cells(
        "SELECT model, count(*) AS dispatched, count(*) FILTER (is_null) AS nulls, count(*) FILTER (NOT fa) AS refusals, round(count(*) FILTER (is_null) / count(*), 9) AS null_rate, round(coalesce(count(*) FILTER (is_null) / nullif(count(*) FILTER (NOT fa), 0), 0), 9) AS null_share FROM live GROUP BY model"
    ),
    "headline": on_cells(f"SELECT {MEANS} FROM (SELECT run, {RATE} FROM live GROUP BY run)"),
    "model_run_means": on_cells(f"SELECT model, {MEANS} FROM (SELECT model, run, {RATE} FROM live GROUP BY model, run) GROUP BY model"),
    "grid_counters": on_cells(
        "SELECT *, n_probes * n_models AS n_expected, n_probes * n_models - n_observed AS n_never_observed FROM (SELECT count(DISTINCT probe) AS n_probes, count(DISTINCT model) AS n_models, count(DISTINCT run) AS n_runs, (SELECT count(*) FROM (SELECT DISTINCT probe, model FROM cells WHERE observed)) AS n_observed FROM cells)"
    ),
    "compare_runs": on_cells(f", {COMPARED} SELECT * FROM compared").replace(") ,", "),"),
    "compare_summary": on_cells(f", {COMPARED} SELECT count(*) AS n, count(*) FILTER (changed) AS n_changed, count(*) FILTER (crossed) AS n_crossed FROM compared").replace(") ,", "),"),
    "grid_invariants": "SELECT '' AS scope, '' AS name, '' AS violation WHERE false",
    "pair_stability": on_cells(f", {PAIRS} SELECT * FROM pairs").replace(") ,", "),"),
    "stability_totals": on_cells(
        f", {PAIRS} SELECT count(*) AS n_pairs, count(*) FILTER (stable) AS n_stable, count(*) FILTER (NOT stable) AS n_unstable, count(*) FILTER (a_stable) AS n_a_stable, count(*) FILTER (i_stable) AS n_i_stable, sum(n_null)::BIGINT AS n_null, count(*) FILTER (status = 'all_null_content') AS n_all_null, count(*) FILTER (status = 'all_tripped') AS n_all_tripped, count(*) FILTER (status = 'never_observed') AS n_never_observed FROM pairs"
    ).replace(") ,", "),"),
    "interesting_pairs": on_cells(f", {PAIRS} SELECT probe, model, modal, consensus, top_two, status FROM pairs WHERE NOT stable OR n_null > 0").replace(") ,", "),"),
    "work_remaining": f"WITH {RESULTS} SELECT r.run, p.probe, m.model FROM (SELECT DISTINCT run FROM res) r, (SELECT DISTINCT probe FROM res) p, (SELECT DISTINCT model FROM res) m WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.run = r.run AND res.probe = p.probe AND res.model = m.model AND coalesce(error, '') = '')",
    "run_summary": f"WITH {RESULTS} SELECT run, count(*) AS n_results, count(*) FILTER (coalesce(error, '') <> '') AS n_failed, count(DISTINCT model) AS n_models, string_agg(DISTINCT model, ',' ORDER BY model) AS models, coalesce(round(round(avg(latency_ms) FILTER (coalesce(error, '') = ''), 1), 0), 0) AS mean_latency, coalesce(max(latency_ms) FILTER (coalesce(error, '') = ''), 0) AS max_latency FROM res GROUP BY run",
    "run_detail": f"WITH {RESULTS} SELECT run, model, count(*) FILTER (coalesce(error, '') = '') AS n_ok, count(*) FILTER (coalesce(error, '') <> '') AS n_failed, coalesce(round(round(avg(latency_ms) FILTER (coalesce(error, '') = ''), 1), 0), 0) AS mean_latency, coalesce(round(max(latency_ms) FILTER (coalesce(error, '') = ''), 1), 0) AS max_latency FROM res GROUP BY run, model",
    "run_progress": f"WITH {RESULTS} SELECT run, row_no, row_number() OVER w AS done, sum((coalesce(error, '') <> '')::INT) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS failed, count(*) OVER (PARTITION BY run) AS of FROM res WHERE received_at IS NOT NULL WINDOW w AS (PARTITION BY run ORDER BY received_at, row_no)",
    "tripped_models": on_cells("SELECT model, count(*) FILTER (tripped) AS n_tripped FROM cells GROUP BY model HAVING count(*) FILTER (tripped) > 0"),
    "backfilled_rates": on_cells(
        f", obs AS (SELECT probe, model, cls, fa, fi FROM live WHERE observed), filled AS (SELECT * FROM obs UNION ALL SELECT p.probe, m.model, 'REFUSED_UNRECOGNIZED', false, false FROM dom p, (SELECT DISTINCT model FROM obs) m WHERE NOT EXISTS (SELECT 1 FROM obs WHERE obs.probe = p.probe AND obs.model = m.model)) SELECT model, {RATE} FROM filled GROUP BY model"
    ).replace(") ,", "),"),
    "duplicates_resolved": f"WITH {RESULTS} SELECT run, probe, model, row_no FROM res",
    "latest_run": f"WITH {RESULTS} SELECT arg_max(run, (received_at, run)) AS run, max(received_at) AS received_at FROM res",
}
