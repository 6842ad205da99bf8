"""The circuit breaker as a stateful stream, and watermarked windows over attempts."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cellweave.operators.health import Thresholds

OUT = "model string, reason string, tripped_at timestamp, attempts long, successes long, tripped boolean"
STATE = "recent array<boolean>, streak int, quiet_from timestamp, attempts long, successes long, reason string, tripped_at timestamp"


class _Breaker:
    """Folds a model's new attempts, in time order, into its state; a tripped model stays so."""

    def __init__(self, limits: Thresholds) -> None:
        self.limits = limits

    def __call__(self, key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        lim = self.limits
        recent, streak, quiet_from, attempts, successes, reason, tripped_at = state.get if state.exists else ([], 0, None, 0, 0, None, None)
        last = deque(recent or [], maxlen=lim.window)
        rows = pd.concat(list(batches)).sort_values(["at", "ord"])
        for at, ok in zip(rows["at"], rows["ok"]):
            if reason is not None:
                break
            attempts += 1
            last.append(bool(ok))
            if ok:
                successes, streak, quiet_from = successes + 1, 0, at
                continue
            streak += 1
            quiet_from = at if quiet_from is None or pd.isna(quiet_from) else quiet_from
            failed = last.count(False)
            if streak >= lim.consecutive:
                reason = "consecutive"
            elif len(last) >= lim.least and failed / len(last) >= lim.rate:
                reason = "rate"
            elif (at - quiet_from).total_seconds() >= lim.quiet_seconds:
                reason = "wallclock"
            tripped_at = at if reason else None
        state.update((list(last), streak, quiet_from, attempts, successes, reason, tripped_at))
        row = {"model": key[0], "reason": reason, "tripped_at": tripped_at, "attempts": attempts, "successes": successes, "tripped": reason is not None}
        yield pd.DataFrame([row]).astype({"reason": "object", "tripped_at": "datetime64[us]"})


def breaker_stream(attempts: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """The latest state of every model that had attempts in the batch. ``attempts`` is a stream of model, at, ord, ok."""
    return attempts.groupBy("model").applyInPandasWithState(_Breaker(limits), OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def windowed_failures(attempts: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Attempts and failures per model and tumbling window, with a watermark for late ones; for batches and streams."""
    marked = attempts.withWatermark("at", late)
    return marked.groupBy("model", F.window("at", length).alias("w")).agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failures")).select("model", F.col("w.start").alias("start"), "n", "failures")


def sessions(attempts: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Attempts per model in sessions that end after a pause."""
    return attempts.groupBy("model", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("n")).select("model", F.col("w.start").alias("start"), "n")


def run_to_table(stream: DataFrame, folder: str, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Drain a stream into batch folders (a replay overwrites its own) and read them; of updates the last per key holds."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    out = stream.sparkSession.read.schema(stream.schema).option("basePath", f"{folder}/out").parquet(f"{folder}/out/batch=*")
    if mode != "update" or not keys:
        return out.drop("batch")
    rest = [c for c in out.columns if c not in (*keys, "batch")]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")
