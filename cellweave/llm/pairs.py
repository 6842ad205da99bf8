"""Prompt and response pairs that are broken: empty, truncated, refused, copied, or answered in another language.

The pass that looks at where texts end (see truncation) also compares each distinct pair of prompt and response, on the
words it has cut the batch into: language posteriors of both from a character n-gram naive Bayes model, the share of the
response's words that stand in runs of three words of its prompt, and a classifier of refusals on word n-grams (see
refusals). Prompts travel to the workers as one table while they are small (checked); beyond that, each row is joined with
its prompt.

Defined cases: a null, empty or blank response, or one of placeholder words only, is ``empty`` and has no other defect; a
response without a known prompt is never ``copy`` or ``wrong_language``; a text with fewer letters than MIN_LETTERS has no
language, one of fewer than three words is no copy; texts are read whole; rows are judged one by one, repeated or not; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.functions.identifiers import fold_identifier
from cellweave.llm import languages, lookalikes, refusals, truncation
from cellweave.llm.truncation import BLANK, Words, mix

#: Prompts up to so many characters in all go to the workers at once.
PROMPT_LIMIT = 20_000_000
MIN_LETTERS = 9
#: How much likelier (nats, in all and per letter) another language than the prompt's must be.
MARGIN, MARGIN_EACH = 4.0, 0.12
#: Share of a response's words that runs of three words of the prompt must cover.
COPIED = 0.8


class _Prompts:
    """Languages and hashed runs of three words of prompts, by their number."""

    def __init__(self, texts: list[str], model: languages.Model) -> None:
        plain = lookalikes.plain_texts(texts)
        scores, letters = model.scores(plain)
        self.language = np.where(letters >= MIN_LETTERS, scores.argmax(1), -1) if scores.shape[1] else np.full(len(texts), -1)
        owner, _, _, three = Words(plain).grams()
        self.runs = np.unique(mix(three[three != 0], owner[three != 0].astype(np.uint64), 17))

    def has(self, three: np.ndarray, prompt: np.ndarray) -> np.ndarray:
        if not len(self.runs):
            return np.zeros(len(three), bool)
        sought = mix(three, prompt.astype(np.uint64), 17)
        return (self.runs[np.minimum(np.searchsorted(self.runs, sought), len(self.runs) - 1)] == sought) & (three != 0)


def copied(words: Words, text: np.ndarray, prompt: np.ndarray, prompts: _Prompts) -> np.ndarray:
    """Whether nearly all words of text ``text[k]`` stand in runs of prompt ``prompt[k]``, for every k."""
    owner, _, _, three = words.grams()
    begin = np.searchsorted(owner, np.arange(len(words.texts) + 1))
    counts = begin[text + 1] - begin[text]
    start = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(text) else np.zeros(0, np.int64)
    at = np.repeat(begin[text] - start, counts) + np.arange(counts.sum())
    pair = np.repeat(np.arange(len(text)), counts)
    hit = prompts.has(three[at], prompt[pair])
    # A run ends at its hit; it covers that word and the two before it, all of the same text.
    covered = hit.copy()
    covered[:-1] |= hit[1:]
    covered[:-2] |= hit[2:]
    share = np.bincount(pair, covered, len(text))
    return (counts >= 3) & (share >= COPIED * counts)


class PairCheck:
    """Remarks (comma-joined defects) on pairs of response texts and prompts (keys of ``prompts``, or texts)."""

    def __init__(self, model: Broadcast, classifier: Broadcast, prompts: Broadcast | None) -> None:
        self.model, self.classifier, self.prompts = model, classifier, prompts
        self.known: tuple[dict[str, int], _Prompts] | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": None}

    def compared(self, others: list[str | None]) -> tuple[np.ndarray, _Prompts]:
        """The number of each pair's prompt (-1 without one), and the prompts."""
        if self.prompts is None:
            place = {t: k for k, t in enumerate(dict.fromkeys(o for o in others if o is not None))}
            prompts = _Prompts(list(place), self.model.value)
        else:
            if self.known is None:
                texts = self.prompts.value
                self.known = {key: k for k, key in enumerate(texts)}, _Prompts(list(texts.values()), self.model.value)
            place, prompts = self.known
        return np.array([place.get(o, -1) for o in others], np.int64), prompts

    def __call__(self, words: Words, pairs: list[tuple]) -> list[str | None]:
        text, others = np.array([t for t, _ in pairs], np.int64), [o for _, o in pairs]
        prompt, prompts = self.compared(others)
        there = text >= 0
        blank = ~there | (words.flags[np.maximum(text, 0)] & BLANK > 0)
        refused = self.classifier.value.scores(words) > refusals.THRESHOLD
        scores, letters = self.model.value.scores(words.texts)
        asked = np.flatnonzero(~blank & (prompt >= 0))
        copy = np.zeros(len(pairs), bool)
        copy[asked] = copied(words, text[asked], prompt[asked], prompts)
        other_language = np.zeros(len(pairs), bool)
        if scores.shape[1]:
            mine, language = text[asked], prompts.language[prompt[asked]]
            ahead = scores[mine].max(1) - scores[mine, np.maximum(language, 0)]
            other_language[asked] = (language >= 0) & (letters[mine] >= MIN_LETTERS) & (ahead > np.maximum(MARGIN, MARGIN_EACH * letters[mine]))
        out: list[str | None] = []
        for k, t in enumerate(text):
            found = [name for name, yes in (("refusal", refused[t]), ("copy", copy[k]), ("wrong_language", other_language[k])) if yes]
            out.append("empty" if blank[k] else ",".join(found))
        return out


def prompt_text(preamble: Column, request: Column) -> Column:
    """Preamble, blank line, request."""
    return F.concat_ws("\n\n", preamble, request)


def broken_pairs(
    results: DataFrame, papers: DataFrame, model: languages.Model, classifier: refusals.Classifier, *, row: str = "record_no", probe: str = "probe_id", text: str = "response_text", finish_reason: str = "finish_reason", tokens: str | None = None, system: str | None = None
) -> DataFrame:
    """(row_no, defect) of every defect of every row of ``results``."""
    spark = results.sparkSession
    prompts = papers.select(
        fold_identifier(F.concat(F.lit("IS-"), papers["paper_id"])).alias("probe"),
        prompt_text(papers["probe.preamble"], papers["probe.operational_request"]).alias("prompt"),
    ).where("probe IS NOT NULL")
    prompts = prompts.groupBy("probe").agg(F.min("prompt").alias("prompt"))
    size = prompts.agg(F.coalesce(F.sum(F.length("prompt")), F.lit(0)).alias("n")).first()["n"]
    shared = spark.sparkContext.broadcast(model), spark.sparkContext.broadcast(classifier)
    key = fold_identifier(results[f"`{probe}`"])
    if size <= PROMPT_LIMIT:
        table = spark.sparkContext.broadcast({r["probe"]: r["prompt"] for r in prompts.toLocalIterator()})
        joined, other, check = results, key, PairCheck(*shared, table)
    else:
        # A prompt with very many responses is split by the skew handling of the join.
        named = prompts.select(F.col("probe").alias("_probe"), F.col("prompt").alias("_prompt"))
        joined = results.withColumn("_key", key).join(named, F.col("_key") == F.col("_probe"), "left")
        other, check = F.col("_prompt"), PairCheck(*shared, None)
    judged = truncation.judged(truncation.scan(joined, row, text, finish_reason, tokens, system, other, check))
    remarks = F.filter(F.split(F.coalesce("extra", F.lit("")), ","), lambda x: x != "")
    cut = F.when(F.col("cut") & ~F.array_contains(remarks, "empty"), F.array(F.lit("truncated"))).otherwise(F.array().cast("array<string>"))
    return judged.select("row_no", F.explode(F.concat(remarks, cut)).alias("defect"))
