"""Filling containers of fixed capacity with items of varying size.

Hierarchical residual packing: every input partition packs its own items best-fit, largest first, in bounded portions, and
emits the nearly full containers. The others become items themselves, as large as their content, and are packed again
in ever fewer partitions, until one portion holds them all or a round joins too few. No item is split unless it alone
exceeds the capacity; such an item fills containers of its own, and only its rest is packed.

Defined cases: a null or negative size counts as 0; an item of size 0 goes into a container of its portion that needs no
room for it; items with equal keys are separate items; containers are numbered by text ids that say nothing but identity;
no items or no capacities give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import materialise

#: Items packed together in a worker; a portion needs some tens of bytes for each.
PORTION = 100_000
#: A container at least this full is emitted at once.
NEARLY_FULL = 0.985
MAX_ROUNDS = 8
#: Capacities that items are packed for at once; more of them are packed in turn.
WINDOWS_AT_ONCE = 1000

PLACED = "window_name string, capacity long, bin string, fill long, key string, piece_no long, first_token long, tokens long"
MERGED = "window_name string, capacity long, bin string, into string, fill long"


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container number of each item, and the fill of each container: largest first, into the least room that suffices."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    place, fill = [0] * len(sizes), []
    room: dict[int, list[int]] = {}
    open_rooms = 0  # bit r is set while a container with room r is open
    for i in order:
        size = sizes[i]
        fits = open_rooms >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            stack = room[r]
            b = stack.pop()
            if not stack:
                open_rooms &= ~(1 << r)
        else:
            r, b = capacity, len(fill)
            fill.append(0)
        fill[b] += size
        place[i] = b
        left = r - size
        room.setdefault(left, []).append(b)
        open_rooms |= 1 << left
    return place, fill


class _Local:
    """Packs the rows of a partition portion by portion; ``level`` makes the container ids unique."""

    def __init__(self, level: int, portion: int, merge: bool) -> None:
        self.level, self.portion, self.merge = level, portion, merge

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held: list[pa.RecordBatch] = []
        number = rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= self.portion:
                yield self.pack(pa.Table.from_batches(held), f"{self.level}-{task}-{number}")
                held, rows, number = [], 0, number + 1
        if rows:
            yield self.pack(pa.Table.from_batches(held), f"{self.level}-{task}-{number}")

    def pack(self, table: pa.Table, prefix: str) -> pa.RecordBatch:
        table = table.sort_by([("window_name", "ascending"), ("capacity", "ascending")]).combine_chunks()
        windows = list(zip(table["window_name"].to_pylist(), table["capacity"].to_pylist()))
        sizes = table["fill" if self.merge else "tokens"].to_pylist()
        bins, fills, at = [], [], 0
        for (window, capacity), same in groupby(windows):
            n = sum(1 for _ in same)
            place, fill = best_fit(sizes[at : at + n], capacity)
            bins += [f"{window}-{prefix}-{b}" for b in place]
            fills += [fill[b] for b in place]
            at += n
        if self.merge:
            columns = {"window_name": table["window_name"], "capacity": table["capacity"], "bin": table["bin"], "into": bins, "fill": fills}
        else:
            columns = {"window_name": table["window_name"], "capacity": table["capacity"], "bin": bins, "fill": fills} | {c: table[c] for c in ("key", "piece_no", "first_token", "tokens")}
        return pa.table(columns).combine_chunks().to_batches()[0]


def pieces(items: DataFrame, windows: list[tuple[str, int]], key: str, size: str) -> DataFrame:
    """One row per window and piece: whole items, or, of an item beyond the capacity, full pieces and the rest."""
    each = F.array(*[F.struct(F.lit(w).alias("window_name"), F.lit(c).cast("long").alias("capacity")) for w, c in windows])
    rows = items.select(items[f"`{key}`"].cast("string").alias("key"), F.greatest(F.coalesce(items[f"`{size}`"].cast("long"), F.lit(0)), F.lit(0)).alias("size"))
    rows = rows.select("key", "size", F.inline(each))
    parts = F.greatest(F.ceil(F.col("size") / F.col("capacity")), F.lit(1)).cast("long")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("piece_no"))
    first = F.col("piece_no") * F.col("capacity")
    return rows.select("window_name", "capacity", "key", "piece_no", first.alias("first_token"), F.least(F.col("capacity"), F.col("size") - first).alias("tokens"))


def pack(items: DataFrame, capacities: DataFrame, *, key: str, size: str, window: str = "window_name", capacity: str = "capacity_tokens", portion: int = PORTION) -> DataFrame:
    """window_name, container_id, ``key``, piece_no, first_token, tokens of every piece of every item, for each capacity.

    ``capacities`` is a list of containers, not of items; a null capacity or one below 1 is no container.
    """
    listed = capacities.select(capacities[f"`{window}`"].cast("string").alias("w"), capacities[f"`{capacity}`"].cast("long").alias("c")).where("w IS NOT NULL AND c >= 1").distinct()
    windows = sorted((r["w"], r["c"]) for r in listed.toLocalIterator())
    kind = items.schema[key].dataType.simpleString()
    out = items.sparkSession.createDataFrame([], f"window_name string, container_id string, {key} {kind}, piece_no long, first_token long, tokens long")
    if not windows:
        return out
    parts = [_packed(items, windows[k : k + WINDOWS_AT_ONCE], key, size, kind, portion) for k in range(0, len(windows), WINDOWS_AT_ONCE)]
    for part in parts[1:]:
        parts[0] = parts[0].unionByName(part)
    return parts[0]


def _packed(items: DataFrame, windows: list[tuple[str, int]], key: str, size: str, kind: str, portion: int) -> DataFrame:
    todo = pieces(items, windows, key, size)
    placed = materialise(todo.mapInArrow(_Local(0, portion, False), PLACED), "packed")
    rest = placed.where(F.col("fill") < F.col("capacity") * NEARLY_FULL).groupBy("window_name", "capacity", "bin").agg(F.max("fill").alias("fill"))
    rest = materialise(rest, "bins")
    left = rest.count()
    chain: DataFrame | None = None
    for level in range(1, MAX_ROUNDS + 1):
        tasks = -(-left // portion)
        merged = rest.repartition(max(tasks, 1), F.xxhash64("bin", F.lit(level))).mapInArrow(_Local(level, portion, True), MERGED)
        merged = materialise(merged, f"merge{level}")
        step = merged.select("bin", "into")
        # Where a bin ends after all rounds so far.
        chain = step if chain is None else materialise(
            chain.join(step.select(F.col("bin").alias("into"), F.col("into").alias("next")), "into", "left").select("bin", F.coalesce("next", "into").alias("into")).unionByName(
                step.join(chain.select(F.col("into").alias("bin")).distinct(), "bin", "left_anti")
            ),
            f"chain{level}",
        )
        before = left
        rest = merged.where(F.col("fill") < F.col("capacity") * NEARLY_FULL).groupBy("window_name", "capacity", F.col("into").alias("bin")).agg(F.max("fill").alias("fill"))
        rest = materialise(rest, "bins")
        left = rest.count()
        if tasks <= 1 or left > 0.98 * before:
            break
    near = F.col("fill") >= F.col("capacity") * NEARLY_FULL
    full = placed.where(near).select("*", F.col("bin").alias("container_id"))
    others = placed.where(~near).join(chain, "bin", "left").select(*[placed[c] for c in placed.columns], F.coalesce("into", "bin").alias("container_id"))
    return full.unionByName(others).select("window_name", "container_id", F.col("key").cast(kind).alias(key), "piece_no", "first_token", "tokens")
