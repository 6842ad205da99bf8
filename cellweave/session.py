"""Session helpers: building a session, loading tables, and shared working folders."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "cellweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; every one can be overridden."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset a session on one machine gets a temporary one; a cluster must name it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        existing = spark.sparkContext._jsc.sc().getCheckpointDir()
        if existing.isDefined():
            root = existing.get()
        elif re.match(r"local(\[|$)", spark.sparkContext.master):
            root = f"file://{tempfile.mkdtemp(prefix='cellweave-')}"
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def _own(spark: SparkSession) -> str:
    return f"{shared_root(spark)}/cellweave/{spark.sparkContext.applicationId}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path or glob leads anywhere."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(where))


_cleaned: set[str] = set()


def work_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared root; its files outlive a lost executor and go with the application (see clear)."""
    own = _own(spark)
    if own not in _cleaned:
        _cleaned.add(own)
        atexit.register(_forget, spark, own)
    return f"{own}/work/{purpose}-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jvm.org.apache.hadoop.conf.Configuration()).delete(where, True)


def _forget(spark: SparkSession, own: str) -> None:
    try:
        _delete(spark, own)
    except Exception:  # the JVM has gone already; the folder is named after the application, so that it can be found
        pass


def clear(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Results not yet read out depend on them."""
    _delete(spark, f"{_own(spark)}/work")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Cut lineage: write ``df`` to the shared folder and read it back (survives executor loss)."""
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Narrow rows (some tens of bytes each) that may go to every executor.
BROADCAST_ROWS = 400_000


def sized(df: DataFrame, most: int | None = None) -> DataFrame:
    """A written table of narrow rows, to be broadcast if it is counted to be short; the planner chooses how to join a longer one."""
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan over all cores, where its files are fewer than those; a table of many files stays as it is read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (``__`` for ``.``) for the time of a block, put back afterwards."""
    names = {key.replace("__", "."): value for key, value in conf.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    try:
        for key, value in names.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of every executor (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for file in sorted(here.rglob("*.py")):
            archive.write(file, file.relative_to(here.parent))
    path = f"{_own(spark)}/package/cellweave_package.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(packed.getvalue())
    stream.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
