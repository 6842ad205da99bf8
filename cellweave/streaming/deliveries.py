"""Exactly one copy of messages that were delivered at least once (keyed streaming state).

The stream keeps one state entry per identifier: its earliest copy and how many copies it had. Entries live in the state
store (RocksDB), are updated in the JVM, and expire when the event-time watermark passes their window. Every entry that a
micro-batch touches is written to its ``batch=<id>`` folder, which a replay overwrites, so that output and checkpointed
state agree after any failure; these folders are also the archive of expired entries. A copy that comes after its
identifier has expired opens a new entry, and the late-arrival lookup joins the entries of one identifier across windows:
one pass over narrow entries for each run, not for each micro-batch.

Event time is the arrival time that the feed had reached with a row's file (the latest arrival in that file and the files
before it). It never runs backwards, so that the engine takes no row for late and drops it, however old its arrival is.

Skew: copies are reduced to one row per identifier and task before the shuffle (the aggregation's map side), so a message
that holds a third of all rows is no hot task. Rows of repeated identifiers are found by a join with one narrow row per
repeated identifier, which is broadcast only when its written size allows that.

Defined cases: identifiers are compared after trimming, white-space folding, folding of full-width forms and lower-casing;
a digest may carry the name of its algorithm; a row with a null or blank identifier part belongs to no message and is never
a copy; on equal arrival times (a null one counts as last) the lowest row number is kept; other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.functions.identifiers import fold_digest, fold_identifier
from cellweave.session import materialise, path_exists, settings, work_folder

#: How long an identifier stays in the state at least.
HORIZON = "30 days"
#: A null arrival time, after all others.
LAST = (1 << 63) - 1
ENTRY = "src int, h1 long, h2 long, opened timestamp, at long, row_no long, n long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@dataclass(frozen=True)
class Feed:
    """One table of messages: where it lies, its identifier parts (``digests`` are those that hold hashes), its row number and arrival time."""

    name: str
    path: str
    ids: Sequence[str]
    row: str
    arrived: str = "received_at"
    digests: Sequence[str] = field(default=())


def _keyed(raw: DataFrame, feed: Feed, number: int, *more: Column) -> DataFrame:
    """src, row_no, at, h1, h2 of every row: a 128-bit hash of its folded identifier, or of its row number where a part is missing."""
    column = lambda c: raw[f"`{c}`"]
    parts = [(fold_digest if c in feed.digests else fold_identifier)(column(c).cast("string")) for c in feed.ids]
    known = F.lit(True)
    for part in parts:
        known = known & part.isNotNull() & (part != "")
    row = column(feed.row).cast("long")
    own = F.when(known, F.lit(None)).otherwise(row)
    key = [F.lit(number), own, *[F.when(known, p) for p in parts]]
    return raw.select(
        F.lit(number).alias("src"),
        row.alias("row_no"),
        F.coalesce(F.unix_micros(column(feed.arrived).cast("timestamp")), F.lit(LAST)).alias("at"),
        F.xxhash64(*key).alias("h1"),
        F.xxhash64(F.lit("second"), *key).alias("h2"),
        *more,
    )


def _reached(spark: SparkSession, feed: Feed) -> DataFrame:
    """(file, reached): the latest arrival up to each file, in the order in which the stream takes them; one narrow row per file."""
    rows = spark.read.parquet(feed.path)
    arrived = rows[f"`{feed.arrived}`"].cast("timestamp")
    files = rows.groupBy(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_modification_time").alias("modified")).agg(F.max(arrived).alias("latest"))
    so_far = Window.orderBy("modified").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return files.select("file", F.coalesce(F.max("latest").over(so_far), F.timestamp_seconds(F.lit(0))).alias("reached"))


def _stream(spark: SparkSession, feed: Feed, number: int, files_per_batch: int | None, horizon: str) -> DataFrame:
    # A stream takes a folder or a glob; the bracket makes a glob of the path, whether it is a file or a folder.
    reader = spark.readStream.schema(spark.read.parquet(feed.path).schema).option("maxFileAge", "100000d")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.parquet(f"{feed.path[:-1]}[{feed.path[-1]}]")
    rows = _keyed(raw, feed, number, F.col("_metadata.file_path").alias("file"))
    # A file that came after the list was made counts as arriving now.
    timed = rows.join(materialise(_reached(spark, feed), "files"), "file", "left").withColumn("reached", F.coalesce("reached", F.current_timestamp()))
    return timed.drop("file").withWatermark("reached", horizon)


class _Sink:
    """Writes the entries that a micro-batch touched under its own id."""

    def __init__(self, folder: str) -> None:
        self.folder = folder

    def __call__(self, entries: DataFrame, batch: int) -> None:
        entries.write.mode("overwrite").parquet(f"{self.folder}/out/batch={batch}")


def entries(spark: SparkSession, feeds: Sequence[Feed], folder: str, horizon: str = HORIZON, files_per_batch: int | None = None, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Drains the stream and gives all entries ever touched: src, h1, h2, opened, at and row_no of the earliest copy, n.

    Called again with the same ``folder`` it goes on with the files that came since, also after a failure.
    """
    union: DataFrame | None = None
    for number, feed in enumerate(feeds):
        one = _stream(spark, feed, number, files_per_batch, horizon)
        union = one if union is None else union.unionByName(one)
    held = union.groupBy("src", "h1", "h2", F.window("reached", horizon).alias("w")).agg(F.min(F.struct("at", "row_no")).alias("kept"), F.count("*").alias("n"))
    out = held.select("src", "h1", "h2", F.col("w.start").alias("opened"), "kept.at", "kept.row_no", "n")
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__streaming__multipleWatermarkPolicy="min"):
        query = out.writeStream.outputMode("update").foreachBatch(sink or _Sink(folder)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    if not path_exists(spark, f"{folder}/out"):
        return spark.createDataFrame([], ENTRY)
    return spark.read.schema(ENTRY).option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")


def surplus_copies(
    spark: SparkSession, feeds: Sequence[Feed], *, horizon: str = HORIZON, files_per_batch: int | None = None, folder: str | None = None, sink: Callable[[DataFrame, int], None] | None = None
) -> DataFrame:
    """(source_table, row_no) of every surplus copy in the tables of ``feeds``.

    ``horizon`` is how long an identifier stays in the state at least; ``files_per_batch`` is how many files of each table a
    micro-batch takes (by default all that are there); ``sink`` takes the place of the writer of micro-batches.
    """
    folder = folder or work_folder(spark, "deliveries")
    touched = entries(spark, feeds, folder, horizon, files_per_batch, sink)
    # The late-arrival lookup: an identifier is repeated if an entry saw several copies, or if it has entries in several windows.
    merged = touched.groupBy("src", "h1", "h2").agg(F.min(F.struct("at", "row_no")).alias("kept"), F.max("n").alias("n"), F.min("opened").alias("a"), F.max("opened").alias("b"))
    repeated = merged.where((F.col("n") > 1) | (F.col("a") < F.col("b"))).select("src", "h1", "h2", F.col("kept.row_no").alias("kept_row"))
    repeated = materialise(repeated, "repeated")
    rows: DataFrame | None = None
    for number, feed in enumerate(feeds):
        one = _keyed(spark.read.parquet(feed.path), feed, number).select("src", "row_no", "h1", "h2", F.lit(feed.name).alias("source_table"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.join(repeated, ["src", "h1", "h2"]).where("row_no <> kept_row").select("source_table", "row_no")
