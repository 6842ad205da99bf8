"""Endpoint health from a log of attempts: circuit breaker, request rate, bulkhead.

A model may have a large part of all attempts. Windows therefore run inside blocks of time; what a block needs of the time
before it (counts, the last outcomes, the last success) is carried over from narrow summaries, one row per model and block.

``attempts``: model, at (timestamp), ord (tie-break), ok, and optionally immediate (a reason that trips at once).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    """When a breaker trips."""

    consecutive: int = 5
    window: int = 10
    least: int = 5
    rate: float = 0.7
    quiet_seconds: float = 120.0


#: Length of the blocks of time that a model's attempts are split into, in seconds.
BLOCK = 86_400


def block_of(micros: Column, seconds: int = BLOCK) -> Column:
    return F.floor(micros / (seconds * 1_000_000))


def breaker_log(attempts: DataFrame, limits: Thresholds = Thresholds(), block: int = BLOCK) -> DataFrame:
    """Every attempt with the signals of its model so far and the reason that would trip it, in the order of the checks."""
    keep = limits.window - 1
    rows = attempts.withColumn("_b", block_of(F.unix_micros("at"), block))
    order = Window.partitionBy("model", "_b").orderBy("at", "ord")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ok, rn = F.col("ok"), F.row_number().over(order)
    rows = rows.withColumn("_rn", rn).withColumn("_left", F.count("*").over(Window.partitionBy("model", "_b")) - F.col("_rn"))
    # One row per block: its size, first attempt, last success, and last outcomes.
    blocks = rows.groupBy("model", "_b").agg(
        F.count("*").alias("n"), F.min("at").alias("first"), F.max(F.when(ok, F.col("_rn"))).alias("ok_rn"), F.max(F.when(ok, F.col("at"))).alias("ok_at"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("_left") < keep, F.struct("_rn", "ok")))), lambda x: x["ok"]).alias("tail"),
    )
    before = Window.partitionBy("model").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("prior", F.coalesce(F.sum("n").over(before), F.lit(0)))
    recent = F.flatten(F.collect_list("tail").over(Window.partitionBy("model").orderBy("_b").rowsBetween(-keep, -1)))
    carried = blocks.select(
        "model", "_b", "prior", F.min("first").over(before).alias("prior_first"), F.last("ok_at", ignorenulls=True).over(before).alias("prior_ok_at"),
        F.coalesce(F.last(F.col("prior") + F.col("ok_rn"), ignorenulls=True).over(before), F.lit(0)).alias("prior_ok"), recent.alias("prior_tail"),
    )
    rows = rows.join(carried, ["model", "_b"])
    attempt = F.col("prior") + F.col("_rn")
    last_ok = F.coalesce(F.col("prior") + F.max(F.when(ok, F.col("_rn"))).over(so_far), F.col("prior_ok"))
    here = F.count_if(~ok).over(order.rowsBetween(-keep, Window.currentRow))
    missing = F.least(F.greatest(F.lit(limits.window) - F.col("_rn"), F.lit(0)), F.size("prior_tail"))
    earlier = F.size(F.filter(F.slice("prior_tail", F.size("prior_tail") - missing + 1, missing), lambda x: ~x))
    since = F.coalesce(F.max(F.when(ok, F.col("at"))).over(so_far), "prior_ok_at", "prior_first", F.first("at").over(so_far))
    rows = rows.select(
        *attempts.columns,
        (attempt - last_ok).alias("streak"),
        F.least(attempt, F.lit(limits.window)).alias("n_recent"),
        ((here + earlier) / F.least(attempt, F.lit(limits.window))).alias("fail_rate"),
        ((F.unix_micros("at") - F.unix_micros(since)) / 1e6).alias("quiet"),
        attempt.alias("attempt"),
    )
    immediate = F.col("immediate") if "immediate" in attempts.columns else F.lit(None).cast("string")
    return rows.withColumn("reason", F.when(~F.col("ok"), F.coalesce(immediate, trip_reason(limits))))


def trip_reason(limits: Thresholds) -> Column:
    return (
        F.when(F.col("streak") >= limits.consecutive, "consecutive")
        .when((F.col("n_recent") >= limits.least) & (F.col("fail_rate") >= limits.rate), "rate")
        .when(F.col("quiet") >= limits.quiet_seconds, "wallclock")
    )


def breaker_state(attempts: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """Per model: whether and why it tripped first (for good), and its attempts and successes up to then."""
    log = breaker_log(attempts, limits)
    first = log.where("reason IS NOT NULL").groupBy("model").agg(F.min(F.struct("attempt", "reason", "at")).alias("t"))
    joined = log.join(first, "model", "left")
    counted = joined.where(F.col("t").isNull() | (F.col("attempt") <= F.col("t.attempt")))
    return counted.groupBy("model").agg(
        F.first(F.col("t.reason")).alias("reason"), F.first(F.col("t.at")).alias("tripped_at"), F.count("*").alias("attempts"), F.count_if("ok").alias("successes")
    ).withColumn("tripped", F.col("reason").isNotNull())


def availability(state: DataFrame) -> DataFrame:
    """Models exercised and tripped, by reason."""
    return state.groupBy(F.coalesce("reason", F.lit("healthy")).alias("state")).agg(F.count("*").alias("n_models"), F.sum("attempts").alias("attempts"))


def request_rate(attempts: DataFrame, seconds: int = 60) -> DataFrame:
    """Per model: the most attempts in any trailing window of so many seconds."""
    size = max(BLOCK, seconds)
    t = F.unix_micros("at")
    block = block_of(t, size)
    # The last attempts of a block are looked back on from the next one.
    late = t >= ((block + 1) * size - seconds) * 1_000_000
    rows = attempts.select("model", t.alias("t"), F.explode(F.when(late, F.array(F.struct(block.alias("b"), F.lit(True).alias("own")), F.struct((block + 1).alias("b"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(block.alias("b"), F.lit(True).alias("own"))))).alias("x"))
    trailing = Window.partitionBy("model", "x.b").orderBy("t").rangeBetween(-(seconds * 1_000_000) + 1, 0)
    return rows.withColumn("n", F.count("*").over(trailing)).where("x.own").groupBy("model").agg(F.max("n").alias("most"))


def in_flight(calls: DataFrame) -> DataFrame:
    """Per model: the most calls under way at once. ``calls``: model, at, seconds. A call ends before one that starts then."""
    start, end = F.unix_micros("at"), F.unix_micros("at") + (F.col("seconds") * 1_000_000).cast("long")
    steps = calls.select("model", F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("s"))
    # Steps at one instant are summed first, which also shortens a busy model's list.
    sums = steps.groupBy("model", F.col("s.t").alias("t"), F.col("s.d").alias("d")).agg(F.sum("s.d").alias("k")).withColumn("b", block_of(F.col("t")))
    before = Window.partitionBy("model").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.groupBy("model", "b").agg(F.sum("k").alias("k")).select("model", "b", F.coalesce(F.sum("k").over(before), F.lit(0)).alias("open_before"))
    running = Window.partitionBy("model", "b").orderBy("t", "d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = sums.join(carried, ["model", "b"]).withColumn("open", F.col("open_before") + F.sum("k").over(running))
    return opened.groupBy("model").agg(F.greatest(F.max("open"), F.lit(0)).alias("most"))


def from_events(events: DataFrame) -> DataFrame:
    """The test events as attempts: a user is a model, an event of type error a failure."""
    return events.select(F.col("user_id").cast("string").alias("model"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("ord"), (F.col("event_type") != "error").alias("ok"))
