"""Reading level of documents, calibrated on reference passages of known level.

One pass over the texts gives, for each document in the asked language, its distinct words as hashes with counts, and its
sentence complexity: the median length of its sentences and the median of their mean word lengths. SQL ranks the words by
corpus frequency. A document's coverage rank is the size of the smallest frequency-ranked vocabulary that covers a fixed
share of its words: found in a broadcast list of the most frequent words (at most TOP_WORDS), and by a join with all ranks
for the documents that need rarer ones. Reference passages get the same measures; SQL turns them into one centre per level
and a common spread, and each document takes the nearest level. Shares and medians let a few sentences of another level
leave a document's level as it is.

Defined cases: a null, empty or wordless text, and one without a sentence of LEAST_WORDS words, has no level; a text without
letters is in no language; words of equal frequency share a rank; a word of a passage that no document has takes the last
rank; of two levels equally near the lower one holds; texts are read whole; repeated documents count as often as they come;
no documents or no passages give no levels; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.hashing import Powers, slice_hashes
from cellweave.llm import languages
from cellweave.llm.lookalikes import plain_texts
from cellweave.session import materialise, spread

#: Share of a document's words that the vocabulary must cover.
COVERAGE = 0.75
#: Words whose ranks go to the workers (16 bytes each); rarer ones are joined.
TOP_WORDS = 1_000_000
#: A shorter piece is no sentence (headings, labels).
LEAST_WORDS = 3
#: Characters analysed at once; a longer text is analysed alone.
PORTION = 1_000_000
MEASURES = ("rank", "length", "size")
MEASURED = "key string, reads boolean, words long, length double, size double, hashes array<long>, counts array<int>"
COVERED = "key string, reads boolean, words long, length double, size double, rank double, hashes array<long>, counts array<int>"
HIGH = 0x3000
LETTER, JOINER, STOP, CLOSER, SPACE, BREAK = (1 << k for k in range(6))


@cache
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """Classes and lower case of the code points below HIGH; those above count as letters."""
    kinds, lower = np.zeros(HIGH + 1, np.uint8), np.arange(HIGH + 1, dtype=np.uint32)
    for p in range(HIGH):
        c = chr(p)
        kinds[p] = LETTER * c.isalpha() | JOINER * (c in "'’-") | STOP * (c in ".!?") | CLOSER * (c in "\"'”’)]") | SPACE * c.isspace() | BREAK * (c == "\n")
        if len(c.lower()) == 1:
            lower[p] = ord(c.lower())
    kinds[HIGH] = LETTER
    return kinds, lower


def _shift(mask: np.ndarray) -> np.ndarray:
    """Each place's predecessor; nothing before the first."""
    return np.concatenate([[False], mask[:-1]])


def _runs(ids: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)


def _medians(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """The (upper) median of each owner's values; owners come in order; not a number without values."""
    out = np.full(n, np.nan)
    order = np.lexsort((value, owner))
    begin = _runs(owner)
    sizes = np.diff(np.append(begin, len(owner)))
    out[owner[begin]] = value[order][begin + sizes // 2]
    return out


def analyse(texts: list[str], powers: Powers) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text the medians of mean word length and sentence length; then text number, hash and count of each distinct word."""
    n = len(texts)
    points = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, texts), np.int64, n) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    kinds_of, lower_of = _characters()
    low = np.minimum(points, HIGH)
    kinds = kinds_of[low]
    letter = (kinds & LETTER) > 0
    # An apostrophe or hyphen between letters belongs to the word.
    inside = letter | (((kinds & JOINER) > 0) & _shift(letter) & np.concatenate([letter[1:], [False]]))
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A sentence ends at a line break, or at white space behind a stop and any closing marks.
    place = np.maximum.accumulate(np.where((kinds & CLOSER) > 0, 0, np.arange(len(kinds))))
    ended = (kinds[place] & STOP) > 0
    breaks = ((kinds & BREAK) > 0) | (((kinds & SPACE) > 0) & _shift(ended))
    sentence = np.cumsum(breaks)[begin]
    doc = np.searchsorted(starts, begin, "right") - 1
    first = _runs(sentence)
    count = np.diff(np.append(first, len(sentence)))
    mean = np.add.reduceat(end - begin, first) / count if len(first) else np.zeros(0)
    whole = count >= LEAST_WORDS
    owner = doc[first][whole]
    length, size = _medians(owner, mean[whole], n), _medians(owner, count[whole].astype(float), n)
    hashes = slice_hashes(np.where(points < HIGH, lower_of[low], points), begin, end, powers)
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return length, size, doc[at], hashes[at], np.diff(np.append(at, len(doc)))


def portions(texts: list[str], most: int = PORTION) -> Iterator[tuple[int, int]]:
    """Slices of about ``most`` characters, or of one longer text."""
    start = held = 0
    for i, text in enumerate(texts):
        if held and held + len(text) > most:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def _lists(owner: np.ndarray, n: int, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)), pa.array(values, kind))


class _Measure:
    def __init__(self, model: Broadcast, language: str, all_read: bool) -> None:
        self.model, self.language, self.all_read = model, language, all_read

    def reads(self, texts: list[str]) -> np.ndarray:
        """Whether each text is likeliest of the asked language."""
        if self.all_read or self.language not in self.model.value.languages:
            return np.full(len(texts), self.all_read)
        model = self.model.value
        scores, letters = model.scores(texts)
        return (scores.argmax(1) == model.languages.index(self.language)) & (letters > 0)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in portions([t or "" for t in texts]):
                yield self.portion(keys.slice(a, b - a), texts[a:b], powers)

    def portion(self, keys: pa.Array, texts: list[str | None], powers: Powers) -> pa.RecordBatch:
        plain = plain_texts([t or "" for t in texts])
        reads = self.reads(plain)
        n = len(texts)
        length, size, doc, hashes, counts = analyse([t if ok else "" for t, ok in zip(plain, reads)], powers)
        columns = [
            keys, pa.array(reads), pa.array([len(t.split()) if t else 0 for t in texts], pa.int64()), pa.array(length, from_pandas=True), pa.array(np.log(size), from_pandas=True),
            _lists(doc, n, hashes, pa.int64()), _lists(doc, n, counts.astype(np.int32), pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["key", "reads", "words", "length", "size", "hashes", "counts"])


def word_ranks(measured: DataFrame) -> DataFrame:
    """(h, rank) of every word: the number of words at least as frequent, without sorting the vocabulary."""
    words = measured.select(F.inline(F.arrays_zip("hashes", "counts"))).groupBy(F.col("hashes").alias("h")).agg(F.sum("counts").alias("n"))
    words = materialise(words, "words")
    # Few frequencies occur (about the square root of all words), so that one task can sum them up.
    classes = words.groupBy("n").agg(F.count("*").alias("k"))
    ranks = classes.select("n", F.sum("k").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("rank"))
    return materialise(words.join(ranks, "n").select("h", "rank"), "ranks")


class _Cover:
    """Adds the coverage rank where the top words suffice; the words stay with the other documents only."""

    def __init__(self, top: Broadcast, last: int, share: float) -> None:
        self.top, self.last, self.share = top, last, share

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = self.top.value
        missing = self.last if len(known) == self.last else np.inf
        for batch in batches:
            lists = batch.column(5)
            n, offsets = batch.num_rows, lists.offsets.to_numpy()
            hashes, counts = lists.flatten().to_numpy(), batch.column(6).flatten().to_numpy().astype(np.int64)
            owner = np.repeat(np.arange(n), np.diff(offsets))
            at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
            rank = np.where(known[at] == hashes, ranks[at], missing) if len(known) else np.full(len(hashes), missing)
            order = np.lexsort((rank, owner))
            rank, counts = rank[order], counts[order]
            so_far = np.cumsum(counts)
            before = np.concatenate([[0], so_far])[offsets - offsets[0]]
            need = before[:-1] + np.ceil(self.share * np.diff(before)).astype(np.int64)
            found = np.full(n, np.nan)
            full = np.diff(offsets) > 0
            found[full] = rank[np.searchsorted(so_far, need[full])]
            left = pa.array(~np.isinf(found) | ~full)  # nothing is left to look up
            nothing = lambda c: pa.array([None if done else v for done, v in zip(left.to_pylist(), c.to_pylist())], c.type)
            lists_ = [pa.nulls(n, batch.column(k).type) if not np.isinf(found).any() else nothing(batch.column(k)) for k in (5, 6)]
            rank_ = pa.array(np.where(np.isinf(found), np.nan, found), from_pandas=True)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), rank_, *lists_], [c.split(" ")[0] for c in COVERED.split(", ")])


def coverage(measured: DataFrame, ranks: DataFrame, top_words: int = TOP_WORDS, share: float = COVERAGE) -> DataFrame:
    """key, reads, words, length, size, rank of every measured row."""
    last = ranks.count()
    # At most top_words rows: a rank counts all words up to it.
    top = ranks.where(F.col("rank") <= top_words).toPandas().sort_values("h")
    shared = measured.sparkSession.sparkContext.broadcast((top["h"].to_numpy(np.int64), top["rank"].to_numpy(np.float64)))
    covered = materialise(measured.mapInArrow(_Cover(shared, last, share), COVERED), "covered")
    narrow = ("key", "reads", "words", "length", "size", "rank")
    done = covered.where("hashes IS NULL").select(*narrow)
    # The exact way for documents that need rarer words. Rows are told apart by an own number, as keys may repeat.
    rest = materialise(covered.where("hashes IS NOT NULL").withColumn("no", F.monotonically_increasing_id()), "rest")
    each = rest.select("no", F.inline(F.arrays_zip("hashes", "counts"))).join(ranks.withColumnRenamed("h", "hashes"), "hashes", "left")
    each = each.select("no", "counts", F.coalesce("rank", F.lit(last)).alias("r"))
    so_far = F.sum("counts").over(Window.partitionBy("no").orderBy("r").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    whole = F.sum("counts").over(Window.partitionBy("no"))
    least = each.select("no", "r", so_far.alias("so_far"), whole.alias("whole")).where(F.col("so_far") >= F.ceil(F.col("whole") * share)).groupBy("no").agg(F.min("r").cast("double").alias("found"))
    return done.unionByName(rest.drop("rank", "hashes", "counts").join(least, "no").withColumnRenamed("found", "rank").select(*narrow))


def levels(
    documents: DataFrame, references: DataFrame, model: languages.Model, *, key: str = "doc_id", text: str = "text", level: str = "level", language: str = "en", top_words: int = TOP_WORDS
) -> DataFrame:
    """``key``, reads (whether in the language), words, level, rank, length, size of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def measured(rows: DataFrame, name: str, all_read: bool) -> DataFrame:
        narrow = rows.select(rows[f"`{name}`"].cast("string").alias("key"), rows[f"`{text}`"].cast("string").alias("text"))
        return materialise(spread(narrow).mapInArrow(_Measure(shared, language, all_read), MEASURED), "measured")

    texts = measured(documents, key, False)
    ranks = word_ranks(texts)
    graded = coverage(texts, ranks, top_words).withColumn("rank", F.log("rank"))
    # Calibration: a centre per level, and of each measure the spread within levels, from all reference passages.
    passages = coverage(measured(references.where(references[f"`{level}`"].isNotNull()), level, True), ranks, top_words).withColumn("rank", F.log("rank"))
    known = passages.where(" AND ".join(f"{m} IS NOT NULL" for m in MEASURES)).groupBy(F.col("key").cast("double").alias("level"))
    centres = known.agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in MEASURES], *[F.var_pop(m).alias(f"{m}_var") for m in MEASURES])
    rows = sorted(centres.collect(), key=lambda r: r["level"])
    kind = documents.schema[key].dataType.simpleString()
    nearest = F.lit(None).cast("double")
    if rows:
        total = sum(r["n"] for r in rows)
        within = {m: max(sum(r["n"] * r[f"{m}_var"] for r in rows) / total, 1e-3) for m in MEASURES}
        away = [sum(((F.col(m) - F.lit(r[m])) ** 2 / F.lit(within[m]) for m in MEASURES[1:]), (F.col(MEASURES[0]) - F.lit(r[MEASURES[0]])) ** 2 / F.lit(within[MEASURES[0]])) for r in rows]
        best = F.least(*away) if len(away) > 1 else away[0]
        nearest = F.coalesce(*[F.when(a == best, F.lit(r["level"])) for a, r in zip(away, rows)])
    has = F.col("reads") & F.col("rank").isNotNull() & F.col("size").isNotNull()
    return graded.select(F.col("key").cast(kind).alias(key), "reads", "words", F.when(has, nearest).alias("level"), "rank", "length", "size")
