"""Texts that end before they should: inside a word, inside a sentence, or with a mark behind the cut.

One pass over the texts builds, per partition, two tries held as tables: of the letters of the corpus' words, and of its
word sequences (each node is a word behind its context, with how often a line or text ends there without a stop, and how
often a stop there ends a sentence). Where a text ends is then looked up:

* A final token that is unknown inside the corpus but a proper prefix of known words was cut inside a word (``word``); so
  was one that is only unknown behind its context, where longer words with this prefix are known (``context``).
* Otherwise the sequence node decides how likely an end without a stop is there (``sequence``; sparse nodes lean on the
  node of the word's shape); a number behind which a stop ends no sentence elsewhere is half a decimal (``number``), a word
  behind which it does not is an abbreviation (``stop``).
* Marks behind a cut (``mark``) and code fences left open (``fence``) are evidence of their own.

Length evidence is combined with that as log-odds: what the record says of a limit (finish reason), whether its number of
tokens is one at which its model's records pile up, and how many characters it has per token. How much each such
signature tells is counted in the corpus itself, from the texts cut inside a word or marked against those closed by a stop.
No length evidence decides alone.

Defined cases: null, empty and blank texts and bare marks are not cut; texts are read whole; every row of a repeated text is
judged by the same text (records may tell otherwise of its length); equal texts are counted once in the whole corpus, however
their rows are spread; a null or non-positive number of tokens tells nothing; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.hashing import Powers, slice_hashes
from cellweave.functions.identifiers import fold_identifier
from cellweave.llm.lookalikes import plain_texts
from cellweave.session import materialise, sized, spread

# Marks that a sender puts behind a cut.
MARK = re.compile(r"(?:\.\.\.|…|�|\[(?:truncated|cut|cut off|continued|\.\.\.)\]|<(?:truncated|cut|\.\.\.)>|\((?:truncated|cut|continued|\.\.\.)\))\Z", re.IGNORECASE)
#: No mark is longer.
MARK_SIZE = 16
#: A closed sentence: a final stop, perhaps with closing quotes or brackets behind it.
CLOSED = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*\Z")
NUMBER_STOP = re.compile(r"#[.][\"'”’»)\]*_`]*\Z")
# Finish reasons that speak of a limit.
LIMITS = ("length", "max_tokens", "max_output_tokens", "model_length", "token_limit")
LINE, END = "\x01", "\x03"
DIGITS = re.compile(r"\d+")
NUMBER = re.compile(r"[\W_]*#[#.,:%]*\Z")
OUTER = re.compile(r"^[^\w#]+|[^\w#]+$")
#: Distinct nodes held in a worker before their partial counts are sent on.
FLUSH = 400_000
#: Log-odds of the kinds of evidence, and of a cut before any.
SURE, WORD_CUT, CONTEXT_CUT, CLOSED_END, PRIOR = 9.0, 5.0, 3.0, -9.0, 0.5
#: Keeps a node's log-odds below about 4.
FLOOR = 0.02
#: Characters per token are told apart in steps, up to so many.
RATIO_STEP, RATIO_MOST = 0.5, 15
#: A value at which records pile up: so many times its neighbours' average, and so many more.
PILE_TIMES, PILE_MORE, PILE_NEAR = 3, 5, 10
#: In a length signature, the mark of a text whose size is that of many.
PILED = 1 << 10

SUMS = ("total", "open_end", "text_end", "stops", "sentence_end", "line_end")
SCAN = "kind string, row_no long, a string, flags int, sig int, pair long, shape long, ctx long, " + ", ".join(f"{c} long" for c in SUMS) + ", extra string"
MARKED, CLOSES, NUMERIC, BLANK, FENCE = 1, 2, 4, 8, 16

# What stands where an answer should, without markup and marks.
PLACEHOLDERS = {
    "", "null", "none", "nil", "nan", "n a", "na", "undefined", "empty", "blank", "no response", "no answer", "no output", "no content",
    "sin respuesta", "keine antwort", "pas de réponse", "aucune réponse", "vacío", "leer", "vide",
}
#: More letters and digits than any of them has.
CONTENT = max(len(p) for p in PLACEHOLDERS) + 1
TAG, OTHER = re.compile(r"<[^<>]*>"), re.compile(r"[\W_]+")
LETTERS = re.compile(rf"(?:[\W_]*[^\W_]){{{CONTENT}}}")
#: What a line starts with: the marker of a list item.
ITEM = re.compile(r"(?:[-*•+]|#[.)])\Z")


def is_placeholder(text: str) -> bool:
    """Whether a (plain) text has no content of its own."""
    bare = TAG.sub(" ", text) if "<" in text else text
    return LETTERS.match(bare) is None and OTHER.sub(" ", bare).strip().lower() in PLACEHOLDERS


def without_marks(text: str) -> tuple[str, bool]:
    """The text before any marks and blanks at its end, and whether there were marks."""
    body, marked = text.rstrip(), False
    while mark := MARK.search(body[-MARK_SIZE:]):
        body, marked = body[: len(body) - len(body[-MARK_SIZE:]) + mark.start()].rstrip(), True
    return body, marked


def hashes(values: list[str]) -> np.ndarray:
    """A 64-bit hash of every text."""
    joined = [v.encode("utf-8", "surrogatepass") for v in values]
    ends = np.cumsum([len(v) for v in joined], dtype=np.int64)
    return slice_hashes(np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends, Powers()).view(np.uint64) if values else np.zeros(0, np.uint64)


def _shape(token: str) -> str:
    return re.sub(r"(.)\1+", r"\1", "".join("X" if c.isupper() else "x" if c.isalpha() else "#" if c.isdigit() else c for c in token))


def mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of pairs, in order."""
    with np.errstate(over="ignore"):
        x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(salt) + (a >> np.uint64(29)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class Counts:
    """Partial counts by 64-bit key, merged with numpy; each key keeps the context and word it was first seen with."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, keys: np.ndarray, ctx: np.ndarray, word: np.ndarray, masks: np.ndarray) -> None:
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.stack([np.bincount(place, minlength=len(distinct))] + [np.bincount(place, m, len(distinct)) for m in masks]).astype(np.int64)
        self.parts.append((distinct, ctx[first], word[first], sums))
        self.size += len(distinct)

    def merged(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        keys, ctx, word = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        rows = np.concatenate([p[3] for p in self.parts], axis=1)
        distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
        return distinct, ctx[first], word[first], np.stack([np.bincount(place, r, len(distinct)) for r in rows]).astype(np.int64)


def _rows(n: int, kind: str, **columns: object) -> pa.RecordBatch:
    types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    names, out = [], []
    for name, type_ in (c.split(" ") for c in SCAN.split(", ")):
        value = [kind] * n if name == "kind" else columns.get(name)
        names.append(name)
        out.append(pa.nulls(n, types[type_]) if value is None else pa.array(value, types[type_], from_pandas=True))
    return pa.RecordBatch.from_arrays(out, names)


class Words:
    """The words of a batch of distinct plain texts, one after another, as codes and hashes.

    Positions are those of words and of line ends; ``owner`` is the text of each, ``begin`` each text's first (texts without
    any have an empty slice), ``word`` a hash of the bare lower-case word.
    """

    def __init__(self, texts: list[str]) -> None:
        self.texts, n = texts, len(texts)
        self.flags, bodies = np.zeros(n, np.int32), []
        for i, text in enumerate(texts):
            body, marked = without_marks(text)
            if is_placeholder(text):
                self.flags[i] = BLANK
            elif marked:
                self.flags[i] = MARKED
            if body.count("```") % 2:
                self.flags[i] |= FENCE
            bodies.append(body)
        whole = DIGITS.sub("#", f" {END} ".join(bodies)).replace("\n", f" {LINE} ")
        tokens = np.array([END, *whole.split(), END], dtype=object)
        self.token, self.known = pd.factorize(tokens)
        self.lower, self.names = pd.factorize(np.array([t.lower() for t in self.known], dtype=object))
        bare = [OUTER.sub("", t) for t in self.names]
        # Half a decimal is told from other numbers by its stop; marks alone stay as they are.
        keys = [t if not b or NUMBER_STOP.search(t) else b for t, b in zip(self.names, bare)]
        self.bare_names = np.array(bare, dtype=object)
        key, key_names = pd.factorize(np.array(keys, dtype=object))
        shape, shape_names = pd.factorize(np.array([_shape(t) for t in key_names], dtype=object))
        self.key_hash, self.shape_hash = hashes(list(key_names))[key], hashes(list(shape_names))[shape[key]]
        is_end = self.known == END
        ends = np.flatnonzero(is_end[self.token])
        self.ends, self.is_end = ends[1:], is_end
        self.owner = np.minimum(np.cumsum(is_end[self.token])[1:-1] - 1, n - 1)
        self.word = self.key_hash[self.lower[self.token[1:-1]]]
        self.inside = ~(is_end | (self.known == LINE))[self.token[1:-1]]

    def grams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text and hashes of the word, pair and run of three at each word, over line ends; pairs and runs over a text's bound are 0."""
        at = np.flatnonzero(self.inside)
        owner, one = self.owner[at], self.word[at]
        two, three = np.zeros_like(one), np.zeros_like(one)
        if len(at) > 1:
            same = owner[1:] == owner[:-1]
            two[1:] = np.where(same, mix(one[:-1], one[1:], 11), 0)
        if len(at) > 2:
            three[2:] = np.where(owner[2:] == owner[:-2], mix(two[1:-1], one[2:], 13), 0)
        return owner, one, two, three


class _Scan:
    """The pass over the texts. ``extra(words, pairs)`` may add a remark on each distinct pair (text number, other)."""

    def __init__(self, extra: Callable[[Words, list[tuple]], list[str | None]] | None = None) -> None:
        self.extra = extra

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, shapes = Counts(), Counts()
        words: dict[str, int] = {}
        for batch in batches:
            yield self.records(batch, pairs, shapes, words)
            if pairs.size + shapes.size > FLUSH or len(words) > FLUSH:
                yield from self.counts(pairs, shapes, words)
                pairs, shapes, words = Counts(), Counts(), {}
        yield from self.counts(pairs, shapes, words)

    def counts(self, pairs: Counts, shapes: Counts, words: dict[str, int]) -> Iterator[pa.RecordBatch]:
        for kind, counts in (("pair", pairs), ("shape", shapes)):
            if counts.parts:
                keys, ctx, word, sums = counts.merged()
                named = {"ctx": ctx.view(np.int64), "a": word} if kind == "pair" else {}
                yield _rows(len(keys), kind, pair=keys.view(np.int64), **named, **dict(zip(SUMS, sums)))
        if words:
            yield _rows(len(words), "word", a=list(words), total=list(words.values()))

    def records(self, batch: pa.RecordBatch, pairs: Counts, shapes: Counts, words: dict[str, int]) -> pa.RecordBatch:
        values = batch.column(1).to_pandas()
        codes, distinct = pd.factorize(values)
        gone = codes < 0
        # Every row is judged, but only one row of each distinct text in the corpus is counted.
        mine = np.zeros(len(distinct), bool)
        mine[codes[batch.column("own").to_numpy(zero_copy_only=False) & ~gone]] = True
        text = Words(plain_texts(list(distinct)) or [""])
        known, names, lower, token = text.known, text.names, text.lower, text.token
        upper = np.array([t[:1].isupper() for t in known])
        closed = np.array([bool(CLOSED.search(t)) for t in known])
        is_end, is_line = text.is_end, known == LINE
        # Items of lists end otherwise than prose, so that their nodes are counted apart.
        opens = np.concatenate([[False], (is_end | is_line)[token[:-1]]])
        marker = np.array([bool(ITEM.match(t)) for t in known])
        first = np.maximum.accumulate(np.where(opens, np.arange(len(token)), 0))
        item = marker[token[first]][1:-1].astype(np.uint64)
        here, after, before = token[1:-1], token[2:], lower[token[:-2]]
        now = lower[here]
        real = ~(is_end | is_line)[here]
        # A number says little of what follows; with it goes the word before it.
        number = np.array([bool(NUMBER.match(t)) for t in names])
        earlier = text.key_hash[lower[np.concatenate([token[:1], token[:-3]])]]
        context = np.where(number[before], text.key_hash[before] ^ (earlier * np.uint64(3)), text.key_hash[before]) + item
        pair, like = mix(context, text.key_hash[now], 1), mix(context, text.shape_hash[now], 2)
        line_end, text_end = is_line[after], is_end[after]
        stops = closed[here]
        masks = np.stack([(line_end | text_end) & ~stops, text_end, stops & ~text_end, stops & (upper[after] | line_end), line_end])
        counted = real & mine[text.owner] if len(distinct) else np.zeros(len(real), bool)
        bare = text.bare_names[now]
        if counted.any():
            few = masks[:, counted].astype(np.int64)
            pairs.add(pair[counted], context[counted], bare[counted], few)
            shapes.add(like[counted], context[counted], bare[counted], few)
        inner = np.bincount(now[counted & ~text_end], minlength=len(names))
        for i in np.flatnonzero(inner):
            if word := text.bare_names[i]:
                words[word] = words.get(word, 0) + int(inner[i])
        # The last token of each text stands before its end mark.
        flags = text.flags
        last = token[text.ends - 1]
        filled = ~(is_end | is_line)[last]
        for i in np.flatnonzero(filled):
            if closed[last[i]]:
                flags[i] |= CLOSES | (NUMERIC if NUMBER_STOP.search(known[last[i]]) else 0)
        at = np.maximum(text.ends - 2, 0)
        final = [text.bare_names[lower[t]] or None if ok else None for t, ok in zip(last, filled)]
        node = [np.where(filled, v[at] if len(v) else 0, 0).astype(np.uint64).view(np.int64) for v in (pair, like, context)]
        extra = None
        if self.extra is not None:
            others = batch.column("other").to_pylist()
            both, each = pd.factorize(pd.Series(list(zip(codes.tolist(), others)), dtype=object))
            done = self.extra(text, list(each))
            extra = [done[i] for i in both]
        sizes = np.array([len(t) for t in distinct] or [0])
        c = np.where(gone, 0, codes)
        return _rows(
            len(codes),
            "row",
            row_no=batch.column(0),
            a=[None if g else final[i] for g, i in zip(gone, c)],
            flags=np.where(gone, BLANK, flags[c]),
            sig=self.signature(batch, sizes[c]),
            pair=node[0][c],
            shape=node[1][c],
            ctx=node[2][c],
            total=np.where(gone, 0, sizes[c]),
            extra=extra,
        )

    def signature(self, batch: pa.RecordBatch, sizes: np.ndarray) -> np.ndarray:
        """What each record says of its length, as one small number."""
        limited, pile = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int32) for c in ("limited", "pile"))
        tokens = batch.column("tokens").fill_null(0).to_numpy(zero_copy_only=False)
        ratio = np.minimum(sizes / np.maximum(tokens, 1) / RATIO_STEP, RATIO_MOST - 1).astype(np.int32)
        return limited + 2 * pile + 4 * np.where(tokens > 0, ratio, RATIO_MOST)


def limited(finish_reason: Column) -> Column:
    """Whether a finish reason speaks of a length limit."""
    return F.coalesce(F.lower(F.trim(finish_reason)).isin(*LIMITS), F.lit(False))


def piles(records: DataFrame) -> DataFrame:
    """(model, tokens) at which a model's records pile up. ``records``: model, tokens; one narrow row per distinct value is compared with its neighbours."""
    counted = records.where("tokens > 0").groupBy("model", "tokens").agg(F.count("*").alias("n"))
    near = Window.partitionBy("model").orderBy("tokens").rangeBetween(-PILE_NEAR, PILE_NEAR)
    others = (F.sum("n").over(near) - F.col("n")) / (2 * PILE_NEAR)
    return counted.select("model", "tokens", "n", others.alias("others")).where(F.col("n") >= PILE_MORE + PILE_TIMES * F.col("others")).select("model", "tokens", F.lit(True).alias("pile"))


def scan(texts: DataFrame, row: str, text: str, finish_reason: str | None = None, tokens: str | None = None, model: str | None = None, other: Column | None = None, extra: Callable | None = None) -> DataFrame:
    """The pass over all texts, materialised: rows of kind row, pair, shape and word."""
    column = lambda name: texts[f"`{name}`"]
    number = F.lit(None).cast("long") if tokens is None else column(tokens).cast("long")
    whose = F.lit(None).cast("string") if model is None else fold_identifier(column(model).cast("string"))
    reason = F.lit(False) if finish_reason is None else limited(column(finish_reason))
    rows = texts.select(
        column(row).cast("long").alias("row_no"), column(text).cast("string").alias("text"), reason.alias("limited"), number.alias("tokens"), F.coalesce(whose, F.lit("")).alias("model"),
        *([] if other is None else [other.alias("other")]),
    )
    keys = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), F.col("text")).alias("h2")]
    repeats = rows.where("text IS NOT NULL").select("row_no", *keys).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("row_no").alias("first"))
    # A short list goes to every executor, a long one is joined by a shuffle.
    repeats = sized(materialise(repeats.where("n > 1").select("h1", "h2", "first"), "repeats"))
    own = F.coalesce(F.col("row_no") == F.col("first"), F.lit(True)).alias("own")
    marked = spread(rows).select("*", *keys).join(repeats, ["h1", "h2"], "left")
    if tokens is not None:
        marked = marked.join(sized(materialise(piles(rows.select("model", "tokens")), "piles")), ["model", "tokens"], "left")
    pile = F.coalesce("pile", F.lit(False)) if tokens is not None else F.lit(False)
    out = marked.select("row_no", "text", own, "limited", pile.alias("pile"), "tokens", *([] if other is None else ["other"])).mapInArrow(_Scan(extra), SCAN)
    return materialise(out, "ends")


def judged(scanned: DataFrame) -> DataFrame:
    """(row_no, cut, evidence, extra) of every text: whether it is cut, and what was seen of its end."""
    flag = lambda bit: F.col("flags").bitwiseAND(bit) > 0
    rows = scanned.where("kind = 'row'").select("row_no", "a", "flags", "sig", "pair", "shape", "ctx", F.col("total").alias("size"), "extra")
    # Fields of a fixed size leave many texts of one size.
    sizes = materialise(piles(rows.select(F.lit("").alias("model"), F.col("size").alias("tokens"))), "sizes").select(F.col("tokens").alias("size"), F.lit(PILED).alias("piled"))
    rows = rows.join(sizes, "size", "left").withColumn("sig", F.col("sig") + F.coalesce("piled", F.lit(0))).drop("size", "piled")
    closed = flag(CLOSES) & ~flag(NUMERIC) & ~flag(MARKED)
    open_ = rows.where(~flag(BLANK) & ~closed)

    vocabulary = scanned.where("kind = 'word'").groupBy(F.col("a").alias("word")).agg(F.sum("total").alias("n"))
    finals = open_.where("a IS NOT NULL").select(F.col("a").alias("word")).distinct()
    unknown = finals.join(vocabulary, "word", "left_anti")
    prefixes = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substring(F.col("word"), F.lit(1), n))
    nodes = vocabulary.where("n > 1 AND length(word) > 1").select(F.explode(prefixes).alias("word"))
    stubs = materialise(unknown.join(nodes, "word", "left_semi").select(F.col("word").alias("a"), F.lit(True).alias("stub")), "stubs")

    # How much each length signature tells, from texts that are cut or closed beyond doubt: one row per signature.
    told = rows.where(~flag(BLANK)).join(stubs, "a", "left").groupBy("sig").agg(
        F.count_if(flag(MARKED) | (F.coalesce("stub", F.lit(False)) & ~closed)).cast("double").alias("c"), F.count_if(closed).cast("double").alias("w")
    )
    both = told.agg(F.sum("c").alias("cs"), F.sum("w").alias("ws"))
    base = F.try_divide(F.col("c") + F.col("w"), F.col("cs") + F.col("ws"))
    weight = F.log((F.col("c") + base) / (F.col("cs") + 1)) - F.log((F.col("w") + base) / (F.col("ws") + 1))
    lengths = materialise(told.join(both).select("sig", F.coalesce(weight, F.lit(0.0)).alias("length")), "lengths")

    # A closed end is looked up only where the record's length speaks for a cut: it may be an abbreviation.
    doubtful = rows.where(closed & ~flag(BLANK)).join(lengths.where("length > 1"), "sig", "left_semi")
    sought = materialise(open_.unionByName(doubtful), "open")

    def counts(kind: str) -> DataFrame:
        sums = [F.sum(c).alias(f"{kind}_{c}") for c in SUMS]
        keys = sought.select(kind).distinct()
        return scanned.where(F.col("kind") == kind).select(F.col("pair").alias(kind), *SUMS).join(keys, kind, "left_semi").groupBy(kind).agg(*sums)

    # Words known behind a context, away from text ends.
    contexts = sought.where("a IS NOT NULL").select("ctx", "a").distinct()
    within = scanned.where("kind = 'pair'").select("ctx", "a", (F.col("total") - F.col("text_end")).alias("n")).join(contexts.select("ctx").distinct(), "ctx", "left_semi")
    within = within.groupBy("ctx", F.col("a").alias("word")).agg(F.sum("n").alias("n")).where("n > 0")
    strange = contexts.join(within, (contexts.ctx == within.ctx) & (contexts.a == within.word), "left_anti")
    longer = within.where("n > 1 AND length(word) > 1").select("ctx", F.explode(prefixes).alias("a"))
    here = strange.join(longer, ["ctx", "a"], "left_semi").withColumn("behind", F.lit(True))

    found = (
        sought.join(counts("pair"), "pair", "left").join(counts("shape"), "shape", "left").join(stubs, "a", "left").join(here, ["ctx", "a"], "left").join(lengths, "sig", "left")
    )
    # Other places than the text's own end; a node with few leans on that of the word's shape.
    seen = lambda name: F.greatest(F.coalesce(name, F.lit(0)) - 1, F.lit(0))
    by_shape = (seen("shape_open_end") + 1) / (seen("shape_total") + 2)
    share = (seen("pair_open_end") + 2 * by_shape) / (seen("pair_total") + 2)
    odds = lambda p: F.log((1 - p + FLOOR) / (p + FLOOR))
    # A number before the stop may be half a decimal: where it may end a sentence, sentences inside texts end so.
    ends_in = lambda kind: F.coalesce(f"{kind}_sentence_end", F.lit(0)) + F.coalesce(f"{kind}_line_end", F.lit(0)) >= 1 + 0.2 * F.coalesce(f"{kind}_text_end", F.lit(0))
    number_ends = ends_in("pair") | ((F.coalesce("pair_total", F.lit(0)) <= 5) & ends_in("shape"))
    # A word whose stops seldom end a sentence is an abbreviation; others end their text for sure.
    ending = (F.coalesce("pair_sentence_end", F.lit(0)) + 1) / (F.coalesce("pair_stops", F.lit(0)) + 1)
    abbreviated = (F.coalesce("pair_stops", F.lit(0)) > 5) & (ending < 0.5)
    true = lambda c: F.coalesce(c, F.lit(False))
    cases = [
        ("mark", flag(MARKED), F.lit(SURE)),
        ("number", flag(NUMERIC), F.when(number_ends, CLOSED_END).otherwise(SURE)),
        ("stop", flag(CLOSES), F.when(abbreviated, odds(ending)).otherwise(CLOSED_END)),
        ("word", true(F.col("stub")), F.lit(WORD_CUT)),
        ("fence", flag(FENCE), F.lit(SURE)),
        ("context", true(F.col("behind")), F.greatest(F.lit(CONTEXT_CUT), odds(share))),
        ("sequence", F.lit(True), odds(share)),
    ]
    first = lambda values: F.coalesce(*[F.when(case, value) for (_, case, _), value in zip(cases, values)])
    score = first([value for _, _, value in cases]) + F.coalesce("length", F.lit(0.0)) + PRIOR
    kind = first([F.lit(name) for name, _, _ in cases])
    done = found.select("row_no", (score > 0).alias("cut"), kind.alias("evidence"), "extra")
    whole = rows.join(lengths.where("length > 1").select("sig", F.lit(True).alias("speaks")), "sig", "left").where(flag(BLANK) | (closed & F.col("speaks").isNull()))
    return done.unionByName(whole.select("row_no", F.lit(False).alias("cut"), F.when(flag(BLANK), "blank").otherwise("stop").alias("evidence"), "extra"))


def cut_texts(texts: DataFrame, row: str, text: str, finish_reason: str | None = None, tokens: str | None = None, model: str | None = None) -> DataFrame:
    """(row_no, cut, evidence) of every row."""
    return judged(scan(texts, row, text, finish_reason, tokens, model)).select("row_no", "cut", "evidence")
