"""Language posteriors from a character n-gram naive Bayes model, vectorised over batches of texts.

Code points map to 40 letter classes (a to z, all else that separates, and 13 classes of other letters); the features are
trigrams of classes. The model is fitted on a bounded sample of labelled texts (SAMPLE per language).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled texts per language that the model is fitted on.
SAMPLE = 1500
#: Languages with fewer labelled texts are no class of their own.
LEAST = 20
#: Letters that one labelled text counts for at most, all of it read.
VOTE = 2000
WIDTH = 40
HIGH = 0x3000


@cache
def letter_classes() -> np.ndarray:
    table = np.zeros(HIGH, np.int64)
    for p in range(HIGH):
        c = chr(p).lower()[:1]
        if "a" <= c <= "z":
            table[p] = ord(c) - 96
        elif c.isalpha():
            table[p] = 27 + ord(c) % 13
    return table


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram indices of all texts, where each text's begin, and each text's number of letters."""
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    points = np.frombuffer("".join(f"  {t}" for t in texts).encode("utf-32-le", "surrogatepass"), "<u4")
    low = points < HIGH
    kind = np.where(low, letter_classes()[np.where(low, points, 0)], 27 + points % 13)
    index = kind.copy()
    index[1:] += kind[:-1] * WIDTH
    index[2:] += kind[:-2] * WIDTH * WIDTH
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    # The two leading blanks of a text keep the one before out of its trigrams, but not their own.
    index[begin] = 0
    if len(begin):
        index[begin + 1] = 0
    letters = np.add.reduceat((kind > 0).astype(np.int64), begin) if len(texts) else np.zeros(0, np.int64)
    return index, begin, letters


class Model:
    """Log-likelihoods of trigrams by language."""

    def __init__(self, languages: list[str], weights: np.ndarray) -> None:
        self.languages, self.weights = languages, weights

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood (texts by languages) and number of letters of each text."""
        if not texts:
            return np.zeros((0, len(self.languages))), np.zeros(0, np.int64)
        index, begin, letters = trigrams(texts)
        return np.add.reduceat(self.weights[index], begin, axis=0), letters


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, texts in pdf.groupby("lang").text:
            index, _, _ = trigrams(texts.tolist())
            sizes = texts.str.len().to_numpy() + 2
            # A long text weighs no more than VOTE letters, so that a mislabelled one cannot bend a language.
            weights = np.repeat(np.minimum(1.0, VOTE / sizes), sizes)
            total[lang] = total.get(lang, 0) + np.bincount(index, weights, WIDTH**3)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pd.DataFrame({"lang": lang, "feature": at, "n": counts[at]})


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Model:
    """The model of the languages that enough rows are labelled with (the label's first two letters, in lower case)."""
    code = F.regexp_extract(F.lower(F.trim(labelled[f"`{lang}`"].cast("string"))), r"^([a-z]{2})(?:[-_].*)?$", 1)
    rows = labelled.select(code.alias("lang"), labelled[f"`{text}`"].cast("string").alias("text")).where("lang != '' AND length(text) > 0")
    # The labels alone, so that this scan reads no texts.
    sizes = {r["lang"]: r["n"] for r in labelled.select(code.alias("lang")).where("lang != ''").groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST).collect()}
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sizes.items()], F.lit(0.0))
    chosen = rows.where(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_003)) < share * 1_000_003)
    grams = chosen.mapInPandas(_counts, "lang string, feature long, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sizes)
    counts = np.full((WIDTH**3, max(len(languages), 1)), 0.3)
    for k, name in enumerate(languages):
        mine = grams[grams.lang == name]
        counts[mine.feature, k] += mine.n
    weights = np.log(counts / counts.sum(0)).astype(np.float32)
    weights[0] = 0
    return Model(languages, weights)
