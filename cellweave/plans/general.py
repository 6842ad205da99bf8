"""Queries of the general data problems (p4, p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from cellweave.operators import drift
from cellweave.plans.base import fold
from cellweave.session import materialise, table
from cellweave.streaming.deliveries import Feed, surplus_copies

RESULT_ID = ("run_id", "probe_id", "model")
VERDICT_ID = (*RESULT_ID, "response_sha256", "judge_version")


#: Micro-batches that a table of many files is taken in.
BATCHES = 4


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every surplus copy of a result or a verdict."""
    feeds = [
        Feed("raw_results", f"{sf_dir}/raw_results.parquet", RESULT_ID, "record_no"),
        Feed("panel_verdicts", f"{sf_dir}/panel_verdicts.parquet", VERDICT_ID, "verdict_no", digests=("response_sha256",)),
    ]
    files = max(len(spark.read.parquet(f.path).inputFiles()) for f in feeds)
    return surplus_copies(spark, feeds, files_per_batch=-(-files // BATCHES))


#: The columns of the two unified tables.
RESULT_COLUMNS = {
    "probe_id": "string",
    "paper_id": "string",
    "model": "string",
    "response_text": "string",
    "latency_ms": "double",
    "prompt_tokens": "int",
    "completion_tokens": "int",
    "finish_reason": "string",
    "timestamp": "string",
    "error": "string",
    "domain": "string",
}
VERDICT_COLUMNS = {
    "probe_id": "string",
    "model": "string",
    "response_sha256": "string",
    "aggregated_label": "string",
    "aggregated_refused": "boolean",
    "intra_panel_kappa": "double",
    "refusal_count": "int",
    "judge_version": "string",
    "evidence_validation_issues": "array<string>",
}


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every difference between a file's fields and those of the file before it."""
    return drift.schema_changes(table(spark, sf_dir, "result_dumps"))


def _unified(kind: str, columns: dict[str, str]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = table(spark, sf_dir, "result_dumps")
        changes = materialise(drift.schema_changes(lines).where("change_type = 'renamed'"), "renames")
        kinds = lines.select("file_id", "record_kind").distinct()
        renames = changes.join(kinds.where(F.col("record_kind") == kind), "file_id", "left_semi")
        names = materialise(drift.canonical_names(renames, tuple(columns)), "names")
        out = drift.unify(lines.where(F.col("record_kind") == kind), names, columns)
        return out.withColumn("extras", F.to_json("extras"))

    query.__doc__ = f"All {kind} records of every file in one table with fixed columns; other fields as JSON in extras."
    return query


def _copies_sql(table: str, row: str, ids: tuple[str, ...]) -> str:
    bare = lambda c: f"regexp_replace({fold(c)}, '^sha256:', '')" if c == "response_sha256" else fold(c)
    keys = ", ".join(map(bare, ids))
    return f"""SELECT '{table}' AS source_table, {row} AS row_no FROM (
        SELECT {row}, row_number() OVER (PARTITION BY {keys} ORDER BY received_at, {row}) AS k FROM {table}) WHERE k > 1"""


QUERIES = {
    "p4_found": p4_found,
    "p4_results": _unified("raw_result", RESULT_COLUMNS),
    "p4_verdicts": _unified("panel_verdict", VERDICT_COLUMNS),
    "p5_found": p5_found,
}
ORACLE = {
    "p5_found": _copies_sql("raw_results", "record_no", RESULT_ID)
    + " UNION ALL "
    + _copies_sql("panel_verdicts", "verdict_no", VERDICT_ID),
}
