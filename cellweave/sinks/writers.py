"""Sinks: partitioned tables, nested JSON, review queues, idempotent appends and replaced tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The columns of a review queue as CSV.
QUEUE_COLUMNS = (
    "item_id", "run", "probe", "model", "kind", "triggers", "label", "reference_label", "violations", "n_verdicts", "agreement",
    "refusal_count", "evidence_issues", "judge_version", "excerpt", "human_label", "human_notes",
)


def write_runs(results: DataFrame, path: str, run: str = "run") -> None:
    """One partition per run; writing a run again replaces only its own partition."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def nested(rows: DataFrame, outer: str, inner: str) -> DataFrame:
    """(outer, json): one JSON object per outer key, by inner key. Written distributed, a line each."""
    rest = [c for c in rows.columns if c not in (outer, inner)]
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(inner).cast("string"), F.struct(*rest)))))
    return rows.groupBy(outer).agg(F.to_json(entries).alias("json"))


def write_queue(queue: DataFrame, path: str, csv: bool = False) -> None:
    """The review queue as JSON lines, or as CSV with fixed columns (missing ones are empty)."""
    kinds = dict(queue.dtypes)
    flat = lambda c: F.concat_ws(",", c).alias(c) if kinds[c].startswith("array") and csv else F.col(c)
    fixed = queue.select(*[flat(c) if c in kinds else F.lit(None).cast("string").alias(c) for c in QUEUE_COLUMNS])
    (fixed.write.mode("overwrite").option("header", "true").csv if csv else fixed.write.mode("overwrite").json)(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """A report or a JSON document of the driver as one file of any file system, replaced as a whole."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    stream.write(text.encode("utf-8"))
    stream.close()


def run_metadata(results: DataFrame, verdicts: DataFrame, **versions: str) -> DataFrame:
    """One row on a judge run: counters of its results and verdicts, and the versions of its parts. ``results``: error; ``verdicts``: label, error."""
    n = results.agg(F.count("*").alias("n_results"), F.count_if(F.coalesce("error", F.lit("")) != "").alias("n_failed"))
    v = verdicts.agg(F.count("*").alias("n_verdicts"), F.count_if(F.col("label").isNull()).alias("n_no_majority"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    return n.crossJoin(v).select("*", *[F.lit(value).alias(name) for name, value in sorted(versions.items())])


def yaml_text(value: object) -> str:
    """A record as YAML, texts of several lines in block style. Needs the yaml package."""
    import yaml

    class Dumper(yaml.SafeDumper):
        pass

    Dumper.add_representer(str, lambda d, s: d.represent_scalar("tag:yaml.org,2002:str", s, style="|" if "\n" in s else None))
    return yaml.dump(value, Dumper=Dumper, sort_keys=False, allow_unicode=True)


def append_new(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str], exists: bool) -> int:
    """Append rows whose key is not stored yet, one per key; returns how many. Doing it again appends nothing."""
    fresh = rows.dropDuplicates(list(keys))
    if exists:
        fresh = fresh.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def replace(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """Replace a table as a whole: written beside it, then moved in its place."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    new, old, here = (hadoop.Path(f"{path}{s}") for s in (".new", ".old", ""))
    files = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    rows.write.mode("overwrite").parquet(f"{path}.new")
    files.delete(old, True)
    if files.exists(here):
        files.rename(here, old)
    if not files.rename(new, here):
        raise OSError(f"could not put {path} in place")
    files.delete(old, True)
