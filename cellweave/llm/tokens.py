"""Encoding texts with a public byte-level tokenizer (pair merging over 50 257 ids), and decoding by offsets.

Pre-tokenisation uses no regular expression: a table maps code points to classes, and a token starts where the state of
a small automaton says so. Almost everywhere the automaton's transition function is constant (the class alone decides);
only around a possible contraction (an apostrophe and the letters after it) does the state before matter. Those functions
are composed by a parallel associative scan. The slices between starts are merged once per distinct slice and cached.

Defined cases: a null or empty text has the ids []; texts are encoded whole, whatever their length; strings of special
tokens are ordinary text; repeated texts are encoded alike; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import spread

TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Slices kept per worker; the cache is emptied when it is full, which changes nothing but time.
CACHE_LIMIT = 400_000

LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3
# Code points of white space in the sense of the tokenizer's pattern.
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# What may follow an apostrophe in a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")

#: States after a code point: plain, inside a contraction with one or two to come, just after one, in a run of marks.
PLAIN, ONE, TWO, ENDED, MARKS = range(5)


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    # Planes 4 to 13 hold no characters; private and format characters are marks as all others.
    for p in (*range(0x40000), *range(0xE0000, 0xE1000)):
        kind = unicodedata.category(chr(p))[0]
        if kind == "L":
            table[p] = LETTER
        elif kind == "N":
            table[p] = NUMBER
    table[WHITE] = BLANK
    return table


def compose_runs(functions: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Inclusive scan by composition inside each run: out[i] = f[i] o ... o f[first of the run]. Doubling steps."""
    out = functions.copy()
    index = np.arange(len(out))
    first = np.maximum.accumulate(np.where(run, index, 0))
    step = 1
    longest = int((index - first).max(initial=0)) + 1
    while step < longest:
        has = index - step >= first
        at = index[has]
        out[at] = np.take_along_axis(out[at], out[at - step], axis=1)
        step *= 2
    return out


def token_starts(points: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each code point. ``text_start`` marks the first one of each text."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    before = np.empty(n, np.uint8)
    before[0], before[1:] = BLANK, kind[:-1]
    glue = np.zeros(n, bool)  # the space before belongs to this token
    glue[1:] = (points[:-1] == 0x20) & (kind[1:] != BLANK)
    glue &= ~text_start
    last = np.zeros(n, bool)  # the last code point of its text
    last[:-1] = text_start[1:]
    last[-1] = True
    # Possible contractions, by what follows the apostrophe in the same text.
    follow = np.zeros((2, n), points.dtype)
    follow[0, :-1] = np.where(text_start[1:], 0, points[1:])
    if n > 2:
        follow[1, :-2] = np.where(text_start[1:-1] | text_start[2:], 0, points[2:])
    mark = points == 0x27
    one = mark & np.isin(follow[0], [ord(c) for c in SHORT])
    two = np.zeros(n, bool)
    for a, b in LONG:
        two |= mark & (follow[0] == ord(a)) & (follow[1] == ord(b))
    candidate = one | two
    # Where the state before decides: candidates, and the letters after them.
    open_ = candidate.copy()
    open_[1:] |= candidate[:-1]
    open_[2:] |= two[:-2]
    state = np.where(kind == OTHER, MARKS, PLAIN).astype(np.uint8)
    at = np.flatnonzero(open_)
    if len(at):
        functions = np.empty((len(at), 5), np.uint8)
        functions[:] = np.where(kind[at] == OTHER, MARKS, PLAIN)[:, None]
        functions[:, ONE], functions[:, TWO] = ENDED, ONE
        c = candidate[at]
        # A candidate opens a contraction unless it goes on a run of marks or belongs to the space before.
        opened = np.where(two[at], TWO, ONE)[:, None]
        functions[c] = np.where(glue[at][c][:, None], MARKS, opened[c])
        functions[c, MARKS] = MARKS
        functions[c & text_start[at]] = opened[c & text_start[at]]
        run = np.ones(len(at), bool)
        run[1:] = (at[1:] != at[:-1] + 1) | text_start[at[1:]]
        whole = compose_runs(functions, run)
        heads = at[run]
        entry = np.where((heads > 0) & ~text_start[heads], state[heads - 1], PLAIN)
        state[at] = whole[np.arange(len(at)), entry[np.cumsum(run) - 1]]
    prior = np.empty(n, np.uint8)
    prior[0], prior[1:] = PLAIN, state[:-1]
    prior[text_start] = PLAIN
    inside = (prior == ONE) | (prior == TWO)
    starts = np.where(
        kind == BLANK,
        # Of a run of white space before something else, the last code point stands apart.
        (before != BLANK) | (~last & np.append(kind[1:] != BLANK, False)),
        np.where(kind == OTHER, prior != MARKS, (kind != before) | (prior == ENDED)) & ~glue,
    )
    starts &= ~inside
    return starts | text_start


class Vocabulary:
    """Ranks of byte sequences and a cache of merged slices."""

    def __init__(self, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> None:
        with open(f"{folder}/{name}", "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: always the pair of lowest rank is joined, the leftmost first."""
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        ranks = self.ranks
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(len(piece))]
        after, prior = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, 2) for i in range(len(parts) - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left, j = parts[i], after[i]
            if left is None or j >= len(parts) or len(left) + len(parts[j]) != size:
                continue  # one of the two has been joined meanwhile
            parts[i], parts[j] = left + parts[j], None
            after[i] = after[j]
            if after[j] < len(parts):
                prior[after[j]] = i
            for a, b in ((prior[i], i), (i, after[i])):
                if a >= 0 and b < len(parts):
                    pair = parts[a] + parts[b]
                    if (r := ranks.get(pair)) is not None:
                        heapq.heappush(heap, (r, a, len(pair)))
        return tuple(ranks[p] for p in parts if p is not None)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (one entry more than texts)."""
        return self.located(texts)[:2]

    def located(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``encode``, and for each id the code point of its text at which its slice begins."""
        lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
        whole = "".join(t for t in texts if t)
        edges = np.concatenate([[0], np.cumsum(lengths)])
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
        text_start = np.zeros(len(points), bool)
        text_start[edges[:-1][lengths > 0]] = True
        begin = np.flatnonzero(token_starts(points, text_start))
        cuts = [*begin.tolist(), len(points)]
        slices = [whole[a:b] for a, b in zip(cuts, cuts[1:])]
        known = self.known
        for piece in set(slices).difference(known):
            known[piece] = self.merge(piece.encode("utf-8", "surrogatepass"))
        merged = [known[s] for s in slices]
        counts = np.fromiter(map(len, merged), np.int64, len(merged))
        ids = np.fromiter(chain.from_iterable(merged), np.int32, int(counts.sum()))
        if len(known) > CACHE_LIMIT:
            known.clear()
        upto = np.concatenate([[0], np.cumsum(counts)])
        owner = np.searchsorted(edges, begin, "right") - 1
        return ids, upto[np.searchsorted(begin, edges)], np.repeat((begin - edges[owner]).astype(np.int32), counts)

    @cached_property
    def bytes_of(self) -> dict[int, bytes]:
        """The bytes of every id, turned round once."""
        return {i: b for b, i in self.ranks.items()}

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that make up no character become the replacement character."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@cache
def vocabulary(folder: str, name: str) -> Vocabulary:
    return Vocabulary(folder, name)


#: Texts encoded at a time, by characters, so that a worker's memory stays bounded by the longest text.
CHUNK = 1 << 20


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about ``limit`` characters."""
    start = size = 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class _Encoder:
    def __init__(self, folder: str, name: str, counts_only: bool) -> None:
        self.folder, self.name, self.counts_only = folder, name, counts_only

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(self.folder, self.name)
        for batch in batches:
            key, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, edges = words.encode(texts[a:b])
                if self.counts_only:
                    value: pa.Array = pa.array(np.diff(edges), pa.int64())
                else:
                    value = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([key.slice(a, b - a), value], ["key", "value"])


class _Locator:
    def __init__(self, folder: str, name: str) -> None:
        self.folder, self.name = folder, name

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(self.folder, self.name)
        for batch in batches:
            key, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                ids, edges, starts = words.located(texts[a:b])
                lists = [pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(v, pa.int32())) for v in (ids, starts)]
                yield pa.RecordBatch.from_arrays([key.slice(a, b - a), *lists], ["key", "ids", "starts"])


class _Decoder:
    def __init__(self, folder: str, name: str) -> None:
        self.folder, self.name = folder, name

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(self.folder, self.name)
        for batch in batches:
            texts = [None if ids is None else words.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["key", "value"])


def located(texts: DataFrame, key: str, text: str = "text", *, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(``key``, ids, starts) of every row: for each id the code point at which the slice begins that it belongs to."""
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(texts[f"`{key}`"].alias("key"), texts[f"`{text}`"].cast("string").alias("value"))
    return spread(rows).mapInArrow(_Locator(folder, name), f"key {kind}, ids array<int>, starts array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, key: str, ids: str = "ids", *, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(``key``, text) of every row of ids; no ids give an empty text, null ids null."""
    kind = encoded.schema[key].dataType.simpleString()
    rows = encoded.select(encoded[f"`{key}`"].alias("key"), encoded[f"`{ids}`"].cast("array<int>").alias("value"))
    return spread(rows).mapInArrow(_Decoder(folder, name), f"key {kind}, value string").select(F.col("key").alias(key), F.col("value").alias("text"))


def encode(texts: DataFrame, key: str, text: str = "text", *, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(``key``, ids) of every row: one narrow pass, no shuffle."""
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(texts[f"`{key}`"].alias("key"), texts[f"`{text}`"].cast("string").alias("value"))
    return spread(rows).mapInArrow(_Encoder(folder, name, False), f"key {kind}, value array<int>").select(F.col("key").alias(key), F.col("value").alias("ids"))


def count(texts: DataFrame, key: str, text: str = "text", *, folder: str = TOKENIZER_DIR, name: str = VOCABULARY) -> DataFrame:
    """(``key``, tokens) of every row."""
    kind = texts.schema[key].dataType.simpleString()
    rows = texts.select(texts[f"`{key}`"].alias("key"), texts[f"`{text}`"].cast("string").alias("value"))
    return spread(rows).mapInArrow(_Encoder(folder, name, True), f"key {kind}, value long").select(F.col("key").alias(key), F.col("value").alias("tokens"))
