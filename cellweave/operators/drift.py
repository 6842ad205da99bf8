"""Schemas that drift between files: profiles, changes, rename matching and unification.

Lines meet their file's place in its feed (a join by file; its skew handling splits a file that holds very many lines). Each
Arrow batch is parsed once and reduced to one profile row per file and field: types, moments of length, character classes
and magnitude, and a sketch of the words (the least hash values). A profile takes part in two steps: as the newer file of
its own and as the older one of the next file's. Profiles of a step meet in one task, are merged and compared there: fields
that only one of the two files has are matched one to one (best total similarity of sketch, shape and name); matched ones
are renames, the others additions and removals.

Defined cases: a record that is null, not JSON or not an object has no fields; of a key given twice in a record the last one
holds; a field whose values are all null has no type; a field with several types in a file counts by the set of its types;
files of a feed with equal sequence numbers are ordered by their id; lines stored twice change nothing but counts; values are
read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.hashing import Powers, slice_hashes
from cellweave.session import materialise

#: A pair of fields below this similarity is no rename.
MATCH = 0.42
#: Hash values a sketch keeps.
SKETCH = 128
TYPES = ("string", "number", "boolean", "array", "object")
STRING, NUMBER, BOOLEAN, ARRAY, OBJECT = (1 << k for k in range(5))
#: Sums of a profile: values with a text, its length and classes; numbers, their magnitude, its square, and broken ones.
SUMS = ("texts", "length", "digits", "upper", "lower", "spaces", "numbers", "size", "size2", "fraction")
PROFILE = "step string, newer boolean, field string, types int, " + ", ".join(f"{c} double" for c in SUMS) + ", words array<long>"
CHANGE = "file_id string, change_type string, old_field string, new_field string"


def _whole(digits: str) -> int | float:
    return int(digits) if len(digits) < 300 else float(digits)


def _refuse(name: str) -> None:
    raise ValueError(name)


@cache
def _decoder() -> json.JSONDecoder:
    return json.JSONDecoder(parse_int=_whole, parse_constant=_refuse)


def parse_record(payload: str | None) -> dict | None:
    """The object that a payload holds, or None."""
    if payload is None:
        return None
    try:
        doc = _decoder().decode(payload)
    except (ValueError, RecursionError):
        return None
    return doc if type(doc) is dict else None


@cache
def _classes() -> np.ndarray:
    """Per byte: begins a character, digit, upper, lower, space, part of a word."""
    table = np.zeros((6, 256), np.uint8)
    table[0] = 1
    table[0, 0x80:0xC0] = 0
    for row, (a, z) in ((1, (48, 57)), (2, (65, 90)), (3, (97, 122)), (4, (32, 32))):
        table[row, a : z + 1] = 1
    table[5] = table[1] | table[2] | table[3]
    table[5, 0x80:] = 1
    return table


def word_hashes(data: np.ndarray, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash, of a buffer that neither begins nor ends inside a word."""
    inside = _classes()[5][data].astype(bool)
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return begin, slice_hashes(np.where((data >= 65) & (data <= 90), data + 32, data), begin, end, powers)


def least_hashes(group: np.ndarray, value: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` least distinct values of each group, by group."""
    order = np.lexsort((value, group))
    group, value = group[order], value[order]
    keep = np.ones(len(group), bool)
    keep[1:] = (group[1:] != group[:-1]) | (value[1:] != value[:-1])
    group, value = group[keep], value[keep]
    if not len(group):
        return group, value
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    place = np.arange(len(group)) - np.repeat(first, np.diff(np.append(first, len(group))))
    return group[place < k], value[place < k]


def _rows(step: list, newer: list, field: list, types: np.ndarray, sums: np.ndarray, group: np.ndarray, words: np.ndarray) -> pa.RecordBatch:
    """Profile rows; ``words`` of all rows one after another, ``group`` is the row of each."""
    offsets = np.searchsorted(group, np.arange(len(step) + 1)).astype(np.int32)
    columns = [pa.array(step, pa.string()), pa.array(newer, pa.bool_()), pa.array(field, pa.string()), pa.array(types, pa.int32())]
    columns += [pa.array(s, pa.float64()) for s in sums]
    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(words, pa.int64())))
    return pa.RecordBatch.from_arrays(columns, ["step", "newer", "field", "types", *SUMS, "words"])


class _Profile:
    """Profile rows of the lines (file_id, prev_id, next_id, payload) of each batch."""

    def __init__(self, k: int) -> None:
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            yield self.batch(batch, powers)

    def batch(self, batch: pa.RecordBatch, powers: Powers) -> pa.RecordBatch:
        files: dict[tuple, int] = {}
        groups: dict[tuple[int, str], int] = {}
        owner, kinds, texts, text_of, numbers, number_of = [], [], [], [], [], []
        for file, before, after, payload in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if (doc := parse_record(payload)) is None:
                continue
            place = files.setdefault((file, before, after), len(files))
            for name, value in doc.items():
                g = groups.setdefault((place, name), len(groups))
                owner.append(g)
                kind = type(value)
                if value is None:
                    kinds.append(0)
                    continue
                if kind is str:
                    kinds.append(STRING)
                elif kind is bool:
                    kinds.append(BOOLEAN)
                    value = "true" if value else "false"
                elif kind is int or kind is float:
                    kinds.append(NUMBER)
                    numbers.append(value)
                    number_of.append(g)
                    value = repr(value)
                else:
                    kinds.append(ARRAY if kind is list else OBJECT)
                    value = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
                texts.append(value.encode("utf-8", "surrogatepass"))
                text_of.append(g)
        n = len(groups)
        types = np.zeros(n, np.int32)
        np.bitwise_or.at(types, np.array(owner, np.int64), np.array(kinds, np.int32))
        sums = np.zeros((len(SUMS), n))
        of = np.array(text_of, np.int64)
        if texts:
            # One blank behind each text keeps slices from being empty and words apart.
            data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
            sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
            begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            chars, digits, upper, lower, spaces = (np.add.reduceat(c[data], begin, dtype=np.int64) for c in _classes()[:5])
            chars, spaces = chars - 1, spaces - 1
            for row, values in enumerate((np.ones(len(of)), np.log1p(chars), *(c / np.maximum(chars, 1) for c in (digits, upper, lower, spaces)))):
                sums[row] = np.bincount(of, values, n)
            at, hashes = word_hashes(data, powers)
            group, words = least_hashes(of[np.searchsorted(begin, at, "right") - 1], hashes, self.k)
        else:
            group, words = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if numbers:
            value, whose = np.array(numbers, np.float64), np.array(number_of, np.int64)
            size = np.sign(value) * np.log1p(np.abs(value))
            for row, values in enumerate((np.ones(len(value)), size, size**2, value != np.floor(value)), 6):
                sums[row] = np.bincount(whose, values, n)
        # Each profile takes part as the newer file of its own step and as the older one of the next.
        known, fields = list(files), list(groups)
        ends = np.searchsorted(group, np.arange(n + 1))
        pick, step, newer = [], [], []
        for g, (place, _) in enumerate(fields):
            file, before, after = known[place]
            if before is not None:
                pick.append(g), step.append(file), newer.append(True)
            if after is not None:
                pick.append(g), step.append(after), newer.append(False)
        chosen = np.array(pick, np.int64)
        counts = ends[chosen + 1] - ends[chosen] if len(chosen) else np.zeros(0, np.int64)
        source = np.repeat(ends[chosen] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum()) if len(chosen) else np.zeros(0, np.int64)
        return _rows(step, newer, [fields[g][1] for g in pick], types[chosen], sums[:, chosen], np.repeat(np.arange(len(chosen)), counts), words[source.astype(np.int64)])


@lru_cache(maxsize=100_000)
def name_similarity(a: str, b: str) -> float:
    """The better of edit similarity and the share of common name parts."""
    a, b = a.lower(), b.lower()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    parts = [re.split(r"[^a-z0-9]+", c) for c in (a, b)]
    common = len({*parts[0]} & {*parts[1]}) / min(map(len, parts))
    return max(1 - row[-1] / max(len(a), len(b), 1), common * 0.9)


class Field:
    """One merged profile."""

    def __init__(self, name: str, types: int, sums: np.ndarray, words: np.ndarray) -> None:
        self.name, self.types, self.words = name, int(types), words
        texts, length, digits, upper, lower, spaces, numbers, size, size2, fraction = sums.tolist()
        t, n = max(texts, 1), max(numbers, 1)
        self.length, self.shares = length / t, (digits / t, upper / t, lower / t, spaces / t)
        self.size, self.fraction = size / n, fraction / n
        self.spread = math.sqrt(max(size2 / n - self.size**2, 0.0))

    def overlap(self, other: Field, k: int) -> float:
        """Estimated share of the smaller word set that both have."""
        a, b = self.words, other.words
        if not len(a) or not len(b):
            return 0.0
        # Below the common bound both sketches are complete.
        whole = [len(w) < k for w in (a, b)]
        bound = min([w[-1] for w, full in ((a, whole[0]), (b, whole[1])) if not full], default=1 << 63)
        sizes = [int(np.searchsorted(w, bound, "right")) for w in (a, b)]
        common = len(np.intersect1d(a[: sizes[0]], b[: sizes[1]], assume_unique=True))
        return min(common / max(min(sizes), 1), 1.0)

    def similarity(self, other: Field, k: int) -> float:
        """Of two profiles, 0 where their types differ."""
        both = self.types & other.types
        if not both:
            return 0.0
        if both & NUMBER:
            # Of numbers, how they are written says nothing; magnitude does.
            away = abs(self.size - other.size) * 0.8 + (abs(self.spread - other.spread) + abs(self.fraction - other.fraction)) * 0.3
        else:
            away = abs(self.length - other.length) * 0.8 + 2 * sum(abs(x - y) for x, y in zip(self.shares, other.shares))
        shape = math.exp(-1.5 * away)
        value = max(0.5 * shape + 0.5 * self.overlap(other, k), shape * 0.8)
        names = name_similarity(self.name, other.name)
        # All booleans look alike, so that mostly their names decide.
        return 0.25 * value + 0.75 * names if both & BOOLEAN else 0.85 * value + 0.15 * names


def best_matching(scores: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The one-to-one matching of greatest total score (successive shortest paths); unmatched costs nothing."""
    left, right = sorted({a for a, _ in scores}), sorted({b for _, b in scores})
    if not scores:
        return []
    mate: dict[str, str] = {}
    owner: dict[str, str] = {}
    for _ in left:
        # Bellman-Ford over alternating paths for the augmentation that gains most.
        gain = {a: 0.0 for a in left if a not in mate}
        came: dict[str, str] = {}
        reach: dict[str, float] = {}
        for _ in range(len(left) + 1):
            changed = False
            for (a, b), s in scores.items():
                if a in gain and mate.get(a) != b and gain[a] + s > reach.get(b, -1e9) + 1e-12:
                    reach[b], came[b] = gain[a] + s, a
                    changed = True
                    if b in owner:
                        back = reach[b] - scores[owner[b], b]
                        if back > gain.get(owner[b], -1e9) + 1e-12:
                            gain[owner[b]] = back
            if not changed:
                break
        ends = [(g, b) for b, g in reach.items() if b not in owner]
        if not ends or max(ends)[0] <= 0:
            break
        b = max(ends)[1]
        while True:
            a = came[b]
            before = mate.get(a)
            mate[a], owner[b] = b, a
            if before is None:
                break
            b = before
    return sorted(mate.items())


def step_changes(old: dict[str, Field], new: dict[str, Field], k: int = SKETCH) -> Iterator[tuple[str, str, str]]:
    """(change_type, old_field, new_field) of every difference between the fields of two files."""
    for name in sorted(old.keys() & new.keys()):
        a, b = old[name].types, new[name].types
        if a and b and a != b:
            yield "retyped", name, name
    gone, come = sorted(old.keys() - new.keys()), sorted(new.keys() - old.keys())
    scores = {(a, b): s for a in gone for b in come if (s := old[a].similarity(new[b], k)) >= MATCH}
    renamed = best_matching(scores)
    for a, b in renamed:
        yield "renamed", a, b
    used = {x for pair in renamed for x in pair}
    yield from (("removed", a, "") for a in gone if a not in used)
    yield from (("added", "", b) for b in come if b not in used)


class _Compare:
    """Merges the profile rows of each step (sorted by step, side and field) and compares its two files."""

    def __init__(self, k: int) -> None:
        self.k = k

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            merged = self.merge(table.to_batches()[0])
            # The last step may go on in the next batch; what is carried is one row per side and field.
            step = merged.column("step")
            last = step[merged.num_rows - 1].as_py()
            cut = merged.num_rows
            while cut and step[cut - 1].as_py() == last:
                cut -= 1
            if cut:
                yield self.compare(merged.slice(0, cut))
            held = merged.slice(cut)
        if held is not None:
            yield self.compare(held)

    def merge(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        step, newer, field = (np.array(batch.column(c).to_pylist(), object) for c in ("step", "newer", "field"))
        new = np.ones(len(step), bool)
        new[1:] = (step[1:] != step[:-1]) | (newer[1:] != newer[:-1]) | (field[1:] != field[:-1])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        words = batch.column("words")
        sizes = np.diff(words.offsets.to_numpy())
        whose, least = least_hashes(np.repeat(group, sizes), words.flatten().to_numpy(), self.k)
        sums = np.stack([np.add.reduceat(batch.column(c).to_numpy(), first) for c in SUMS])
        types = np.bitwise_or.reduceat(batch.column("types").to_numpy(), first)
        return _rows(step[first].tolist(), newer[first].tolist(), field[first].tolist(), types, sums, whose, least)

    def compare(self, merged: pa.RecordBatch) -> pa.RecordBatch:
        step, newer, field = (merged.column(c).to_pylist() for c in ("step", "newer", "field"))
        types, sums = merged.column("types").to_numpy(), np.stack([merged.column(c).to_numpy() for c in SUMS])
        words, ends = merged.column("words").flatten().to_numpy(), merged.column("words").offsets.to_numpy() - merged.column("words").offsets[0].as_py()
        out: list[tuple] = []
        sides: tuple[dict, dict] = {}, {}
        for i, name in enumerate(field):
            sides[newer[i]][name] = Field(name, types[i], sums[:, i], words[ends[i] : ends[i + 1]])
            if i + 1 == len(field) or step[i + 1] != step[i]:
                out += [(step[i], *change) for change in step_changes(*sides, self.k)]
                sides = {}, {}
        columns = zip(*out) if out else ([], [], [], [])
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in columns], ["file_id", "change_type", "old_field", "new_field"])


def neighbours(lines: DataFrame, feed: str = "feed_id", file: str = "file_id", seq: str = "file_seq") -> DataFrame:
    """(feed_id, file_id, prev_id, next_id) of every file; the window runs over one narrow row per file."""
    files = lines.groupBy(lines[f"`{feed}`"].alias("feed_id"), lines[f"`{file}`"].alias("file_id")).agg(F.min(lines[f"`{seq}`"]).alias("seq"))
    w = Window.partitionBy("feed_id").orderBy("seq", "file_id")
    return files.select("feed_id", "file_id", F.lag("file_id").over(w).alias("prev_id"), F.lead("file_id").over(w).alias("next_id"))


def schema_changes(lines: DataFrame, *, feed: str = "feed_id", file: str = "file_id", seq: str = "file_seq", payload: str = "payload", sketch: int = SKETCH) -> DataFrame:
    """file_id, change_type, old_field, new_field of every difference between a file and its predecessor."""
    rows = lines.select(lines[f"`{feed}`"].cast("string").alias("feed_id"), lines[f"`{file}`"].cast("string").alias("file_id"), lines[f"`{payload}`"].alias("payload"))
    # Sorted by file, so that a batch holds whole files and gives one row per file and field.
    placed = rows.join(neighbours(lines, feed, file, seq).hint("merge"), ["feed_id", "file_id"]).select("file_id", "prev_id", "next_id", "payload")
    profiles = placed.mapInArrow(_Profile(sketch), PROFILE)
    steps = profiles.repartition("step").sortWithinPartitions("step", "newer", "field")
    return steps.mapInArrow(_Compare(sketch), CHANGE)


def json_type(value: Column) -> Column:
    """string, number, boolean, array, object, or null for a JSON null."""
    name = F.schema_of_variant(value)
    return (
        F.when(name == "VOID", F.lit(None))
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name.startswith("ARRAY"), "array")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def record_fields(lines: DataFrame, payload: str = "payload", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per top-level field of each JSON object: the ``keep`` columns, field, type, text."""
    parsed = lines.select(*[lines[f"`{c}`"] for c in keep], F.try_parse_json(lines[f"`{payload}`"]).alias("doc"))
    objects = parsed.where(F.schema_of_variant("doc").startswith("OBJECT"))
    each = objects.lateralJoin(objects.sparkSession.tvf.variant_explode(F.col("doc").outer()))
    return each.select(
        *[F.col(c) for c in keep],
        F.col("key").alias("field"),
        json_type(F.col("value")).alias("type"),
        F.when(~F.is_variant_null("value"), F.coalesce(F.try_variant_get("value", "$", "string"), F.to_json("value"))).alias("text"),
    )


def canonical_names(renames: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """(field, target): the target column each field name stands for, over any number of renames seen in any feed.

    Names are reached from the targets, round by round; a name belongs to the target that it has most renames with, among
    the names reached one round before.
    """
    spark = renames.sparkSession
    edges = renames.select(F.col("old_field").alias("a"), F.col("new_field").alias("b"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a", "b").agg(F.count("*").alias("n"))
    both = materialise(both, "edges")
    known = reached = spark.createDataFrame([(t, t) for t in targets], "field string, target string")
    while True:
        votes = both.join(reached.select(F.col("field").alias("b"), "target"), "b").groupBy(F.col("a").alias("field"), "target").agg(F.sum("n").alias("n"))
        best = votes.join(known.select("field"), "field", "left_anti").groupBy("field").agg(F.max_by("target", F.struct("n", "target")).alias("target"))
        reached = materialise(best, "names")
        if reached.isEmpty():
            return known
        known = materialise(known.unionByName(reached), "names")


def scalar_text(type_: Column, text: Column) -> Column:
    """The value inside a one-element array or a wrapping object, else the text itself; null for a longer array."""
    doc = F.try_parse_json(text)
    wrapped = F.coalesce(*[F.try_variant_get(doc, f"$.{k}", "string") for k in ("name", "value", "label", "text", "v")])
    only = F.when(F.json_array_length(text) == 1, F.try_variant_get(doc, "$[0]", "string"))
    return F.when(type_ == "array", only).when(type_ == "object", F.coalesce(wrapped, text)).otherwise(text)


def unify(lines: DataFrame, names: DataFrame, targets: dict[str, str], row: str = "line_id", keep: tuple[str, ...] = ("feed_id", "file_id", "file_seq", "written_at")) -> DataFrame:
    """One row per record with the fixed columns ``targets`` (name to type) and ``extras``, a map of all other fields.

    Array targets keep the JSON array; other targets take the value inside one-element arrays and wrapping objects. A value
    that can't be read in the target's type is null there and stays, as written, in ``extras``. Of several fields of one
    record that stand for one target, the one of the target's name is taken, else the first by name that can be read; the
    others stay in ``extras``. No value is lost.
    """
    fields = record_fields(lines, keep=(row,)).join(names, "field", "left")
    plain = scalar_text(F.col("type"), F.col("text"))

    def reads(kind: str) -> Column:
        return F.from_json(F.col("text"), kind).isNotNull() & (F.col("type") == "array") if kind.startswith("array") else plain.try_cast(kind).isNotNull()

    readable = F.coalesce(*[F.when(F.col("target") == t, reads(kind)) for t, kind in targets.items()], F.lit(False))
    whole = F.col("target").isin(*[t for t, kind in targets.items() if kind.startswith("array")])
    entry = F.struct((F.col("field") != F.col("target")).alias("other"), "field", "target", "text", F.when(whole, F.col("text")).otherwise(plain).alias("plain"), readable.alias("ok"))
    # One record's fields; as long as the record.
    records = fields.groupBy(row).agg(F.array_sort(F.collect_list(entry)).alias("all"))
    fits = lambda t: lambda x: x["ok"] & (x["target"] == t)
    first = {t: F.try_element_at(F.filter("all", fits(t)), F.lit(1)) for t in targets}
    records = records.select(row, "all", *[f.alias(f"_{t}") for t, f in first.items()])
    taken = F.array_compact(F.array(*[F.col(f"_{t}.field") for t in targets]))
    value = {t: F.from_json(F.col(f"_{t}.plain"), kind) if kind.startswith("array") else F.col(f"_{t}.plain").try_cast(kind) for t, kind in targets.items()}
    # A null says nothing where the target has a column; elsewhere the field is kept.
    left = F.filter("all", lambda x: ~F.array_contains(taken, x["field"]) & (x["target"].isNull() | x["text"].isNotNull()))
    extras = F.map_from_entries(F.transform(left, lambda x: F.struct(x["field"], x["text"])))
    records = records.select(row, *[v.alias(t) for t, v in value.items()], extras.alias("extras"))
    return lines.select(row, *keep).join(records, row, "left")
