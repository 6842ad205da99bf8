"""Choosing rows: allow and deny lists, status of runs, changes between runs, work that is left."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def names(listed: str | Iterable[str] | None) -> list[str]:
    """Distinct names of a comma list or an iterable, trimmed, without empty ones, in order."""
    parts = listed.split(",") if isinstance(listed, str) else (listed or ())
    return list(dict.fromkeys(p.strip() for p in parts if p.strip()))


def choose(rows: DataFrame, column: str, allow: str | Iterable[str] = (), deny: str | Iterable[str] = (), deny_suffix: str | None = None) -> DataFrame:
    """Rows of allowed (all, if none are named) and not denied values; a name that never occurs is an error that lists some that do."""
    allow, deny = names(allow), names(deny)
    if asked := sorted({*allow, *deny}):
        seen = {r[0] for r in rows.where(F.col(column).isin(*asked)).select(column).distinct().collect()}
        if missing := [a for a in asked if a not in seen]:
            some = [r[0] for r in rows.select(column).distinct().orderBy(column).limit(20).collect()]
            raise ValueError(f"unknown {column}: {', '.join(missing)}; there are {', '.join(map(str, some))}")
    out = rows.where(F.col(column).isin(*allow)) if allow else rows
    if deny_suffix is not None:
        out = out.where(~F.endswith(column, F.lit(deny_suffix)))
    return out.where(~F.col(column).isin(*deny)) if deny else out


def run_status(runs: DataFrame, results: DataFrame, reports: DataFrame) -> DataFrame:
    """missing (no results read), empty, no_report or ok, per run. ``runs``: run; ``reports``: run."""
    n = results.groupBy("run").agg(F.count("*").alias("n"), F.count_if(F.coalesce("error", F.lit("")) == "").alias("n_ok"))
    reported = reports.select("run").distinct().withColumn("reported", F.lit(True))
    rows = runs.join(n, "run", "left").join(reported, "run", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n_ok") == 0, "empty").when(F.col("reported").isNull(), "no_report").otherwise("ok")
    return rows.select("run", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def depth_delta(a: Column, b: Column) -> Column:
    """Signed change of two depth indices with two digits; n/a where neither is known."""
    return F.when(a.isNull() & b.isNull(), "n/a").otherwise(F.format_string("%+.2f", F.coalesce(b, F.lit(0.0)) - F.coalesce(a, F.lit(0.0))))


def starred(scored: DataFrame, models: Iterable[str] = ()) -> DataFrame:
    """Rows with a reason to be looked at, perhaps of some models only."""
    rows = scored.where(F.col("star_reason") != "not_starred")
    wanted = sorted(set(models))
    return rows.where(F.col("model").isin(*wanted)) if wanted else rows


def pending_documents(files: DataFrame) -> DataFrame:
    """Folders that have a source document but neither a record nor a parsed form. ``files``: folder, name."""
    has = lambda pattern: F.max(F.lower("name").rlike(pattern))
    flags = files.groupBy("folder").agg(has(r"\.pdf$").alias("pdf"), has(r"^paper\.(ya?ml|json)$").alias("record"), has(r"\.tei\.xml$").alias("tei"))
    return flags.where("pdf AND NOT record AND NOT tei AND NOT startswith(element_at(split(folder, '/'), -1), '_')").select("folder")


def waves(work: DataFrame, in_flight: int) -> DataFrame:
    """Static dispatch order: the n-th wave has at most ``in_flight`` items of each model.

    Items are numbered inside a model's runs; narrow counts per run carry the numbers over, so that no model is one task.
    """
    before = Window.partitionBy("model").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    carried = work.groupBy("model", "run").agg(F.count("*").alias("n")).select("model", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("model", "run").orderBy("probe"))
    return work.join(carried, ["model", "run"]).select(*work.columns, F.floor((place - 1) / in_flight).cast("int").alias("wave"))


def offenders(cells: DataFrame) -> DataFrame:
    """Models with tripped cells, the worst first."""
    return cells.groupBy("model").agg(F.count_if("tripped").alias("n_tripped")).where("n_tripped > 0").orderBy(F.desc("n_tripped"), "model")


def progress(results: DataFrame, total: int | None = None) -> DataFrame:
    """Running counts of each run in the order of arrival, failures so far, and the seconds that the rest would take at this pace."""
    order = Window.partitionBy("run").orderBy("received_at", "row_no")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = F.col("received_at").cast("timestamp")
    rows = results.where("received_at IS NOT NULL").select(
        "run", "row_no", F.row_number().over(order).alias("done"), F.sum(F.when(F.coalesce("error", F.lit("")) != "", 1).otherwise(0)).over(so_far).alias("failed"),
        (F.unix_micros(at) - F.min(F.unix_micros(at)).over(so_far)).alias("spent"),
        (F.lit(total) if total is not None else F.count("*").over(Window.partitionBy("run"))).cast("long").alias("of"),
    )
    left = F.col("of") - F.col("done")
    return rows.select("run", "row_no", "done", "failed", "of", F.when(F.col("done") > 1, F.round(F.col("spent") / 1e6 / (F.col("done") - 1) * left, 1)).alias("seconds_left"))


def in_corpus(results: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of papers that are there, and how many others there are by probe. ``papers``: probe."""
    known = papers.select("probe").distinct()
    return results.join(known, "probe", "left_semi"), results.join(known, "probe", "left_anti").groupBy("probe").agg(F.count("*").alias("n"))
