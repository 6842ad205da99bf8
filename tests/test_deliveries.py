"""Surplus copies: keyed stream state, late lookups, defined cases."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from cellweave.plans.general import _copies_sql
from cellweave.streaming import deliveries
from cellweave.streaming.deliveries import Feed, surplus_copies

T0 = datetime.datetime(2025, 1, 1)


def at(hours):
    return None if hours is None else T0 + datetime.timedelta(hours=hours)


SCHEMA = "record_no long, run string, model string, received_at timestamp, row_no string, bucket int"


def write(spark, path, rows, mode="overwrite"):
    spark.createDataFrame([(n, r, m, at(h), "clash", 1) for n, r, m, h in rows], SCHEMA).coalesce(1).write.mode(mode).parquet(path)


def found(spark, path, **kw):
    out = surplus_copies(spark, [Feed("t", path, ["run", "model"], "record_no")], **kw)
    return sorted(r["row_no"] for r in out.collect())


def test_earliest_copy_stays(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write(spark, path, [(1, "r1", "a/b", 5), (2, "R1 ", "A/B\t", 3), (3, "r1", "a/b:free", 1), (4, "r1", "a/b", 4), (5, "r2", "a/b", 9)])
    assert found(spark, path) == [1, 4]


def test_nulls_ties_and_blanks(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write(
        spark,
        path,
        [(1, None, "m", 1), (2, None, "m", 2), (3, " ", "m", 1), (4, " ", "m", 2), (7, "r", "m", 1), (6, "r", "m", 1), (8, "r", "m", None), (9, "x", "\u200bm", 1), (10, "x", "m\u00a0", 2)],
    )
    assert found(spark, path) == [7, 8, 10]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write(spark, path, [])
    assert found(spark, path) == []


def test_hot_message(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3000).selectExpr(
        "id AS record_no", "IF(id % 3 = 0, 'hot', concat('r', id)) AS run", "'m' AS model", "timestamp_seconds(1700000000 + id) AS received_at"
    ).repartition(3).write.parquet(path)
    assert found(spark, path) == list(range(3, 3000, 3))


def test_later_batches_and_expired_identifiers(spark, tmp_path):
    path, folder = str(tmp_path / "t.parquet"), str(tmp_path / "work")
    write(spark, path, [(1, "r1", "m", 0), (2, "r2", "m", 1)])
    assert found(spark, path, folder=folder, horizon="1 day") == []
    write(spark, path, [(3, "r1", "m", 2), (4, "r9", "m", 24 * 10)], "append")
    assert found(spark, path, folder=folder, horizon="1 day") == [3]
    write(spark, path, [(5, "r8", "m", 24 * 20)], "append")  # moves the watermark past r2
    assert found(spark, path, folder=folder, horizon="1 day") == [3]
    write(spark, path, [(6, "r2", "m", 24 * 20 + 1), (7, "r1", "m", 24 * 20 + 1)], "append")
    assert found(spark, path, folder=folder, horizon="1 day") == [3, 6, 7]


def test_late_copy_that_beats_the_held_one(spark, tmp_path):
    path, folder = str(tmp_path / "t.parquet"), str(tmp_path / "work")
    write(spark, path, [(1, "r1", "m", 0)])
    assert found(spark, path, folder=folder, horizon="1 day") == []
    write(spark, path, [(2, "r8", "m", 24 * 4)], "append")
    assert found(spark, path, folder=folder, horizon="1 day") == []
    write(spark, path, [(3, "r9", "m", 24 * 4)], "append")  # r1 goes into the archive
    assert found(spark, path, folder=folder, horizon="1 day") == []
    write(spark, path, [(4, "r1", "m", 100)], "append")
    assert found(spark, path, folder=folder, horizon="1 day") == [4]
    write(spark, path, [(5, "r1", "m", 90)], "append")
    assert found(spark, path, folder=folder, horizon="1 day") == [4, 5]


def test_files_in_batches_of_their_own_against_sql(spark, tmp_path):
    path, folder = str(tmp_path / "t.parquet"), tmp_path / "work"
    files = [
        [(1, "r1", "m", 0), (2, "r2", "m", 3), (3, "r1", "m", 2)],
        [(4, "r8", "m", 240), (5, "R2 ", "m", 5)],
        [(6, "r9", "m", 241), (7, "r3", "m", 236)],
        [(8, "r1", "m", 100), (9, "r2", "m", 1), (10, "r9", "m", 242)],
        [(11, "R1", "M", 90), (12, "r3", "m", 230), (13, "r8", "m", 500)],
        [(14, "r2", "m", 501), (15, "r8", "m", 499), (16, "r5", "m", 502)],
    ]
    for rows in files:
        write(spark, path, rows, "append")
    sql = _copies_sql(f"read_parquet('{path}/*.parquet')", "record_no", ("run", "model")).replace(f"'read_parquet('{path}/*.parquet')'", "'t'")
    want = sorted(n for _, n in duckdb.sql(sql).fetchall())
    assert found(spark, path, folder=str(folder), horizon="1 day", files_per_batch=1) == want
    # One batch each, and one without rows that lets entries expire.
    assert len(list((folder / "out").glob("batch=*"))) == len(files) + 1
    # r1, r2 and r8 expired and came again: their entries were joined by the lookup.
    opened = spark.read.parquet(str(folder / "out" / "batch=*")).groupBy("h1", "h2").agg(F.count_distinct("opened").alias("k"))
    assert opened.where("k > 1").count() >= 2


def test_killed_batch_is_replayed(spark, tmp_path):
    path, folder = str(tmp_path / "t.parquet"), str(tmp_path / "work")
    for rows in ([(1, "r1", "m", 0), (2, "r2", "m", 3)], [(3, "r1", "m", 2), (4, "r3", "m", 240)], [(5, "r2", "m", 1), (6, "r3", "m", 239)], [(7, "r1", "m", 500), (8, "r4", "m", 501)]):
        write(spark, path, rows, "append")
    want = [2, 3, 4, 7]
    writer = deliveries._Sink(folder)

    def killed(entries, batch):
        writer(entries, batch)
        if batch == 1:
            raise RuntimeError("lost after writing, before the commit")

    with pytest.raises(Exception, match="lost after writing"):
        found(spark, path, folder=folder, horizon="1 day", files_per_batch=1, sink=killed)
    assert found(spark, path, folder=folder, horizon="1 day", files_per_batch=1) == want
    assert found(spark, path, folder=folder, horizon="1 day", files_per_batch=1) == want


def test_digests_and_other_parts(spark, tmp_path):
    path, digest = str(tmp_path / "t.parquet"), "ab" * 32
    rows = [(1, digest, "m", 1), (2, f"sha256:{digest.upper()}", "m", 2), (3, f"SHA-256: {digest}", "m", 3), (4, "sha256:abc", "m", 4), (5, "abc", "m", 5)]
    write(spark, path, rows)
    out = surplus_copies(spark, [Feed("t", path, ["run", "model"], "record_no", digests=("run",))])
    assert sorted(r["row_no"] for r in out.collect()) == [2, 3]


def test_identifiers_in_compatibility_form(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    write(spark, path, [(1, "run-7", "a/b", 1), (2, "\uff52un\uff0d\uff17", "A/\uff22", 2), (3, "run-8", None, 1), (4, "é", "m", 1), (5, "É", "m", 2)])
    assert found(spark, path) == [2, 5]


def test_rerun_gives_the_same(spark, tmp_path):
    path, folder = str(tmp_path / "t.parquet"), str(tmp_path / "work")
    write(spark, path, [(1, "r1", "m", 5), (2, "r1", "m", 3)])
    assert found(spark, path, folder=folder) == [1]
    assert found(spark, path, folder=folder) == [1]


def test_earlier_copy_in_a_later_batch(spark, tmp_path):
    path, folder = str(tmp_path / "t.parquet"), str(tmp_path / "work")
    write(spark, path, [(1, "r1", "m", 5)])
    found(spark, path, folder=folder)
    write(spark, path, [(2, "r1", "m", 3)], "append")
    assert found(spark, path, folder=folder) == [1]
