"""The corpus of papers: projections, summaries, validation, mode inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellweave.operators.details import RATIOS

MATCH_TYPES = ("phrase_match", "exact_list", "exact_list_case_insensitive")
PLACEHOLDER = r"(?i)\b(todo|tbd|fixme|lorem ipsum|placeholder)\b"


def truncate(text: Column, n: int) -> Column:
    """On one line, at most ``n`` characters, with an ellipsis where something is left out."""
    flat = F.regexp_replace(F.trim(text), "[\r\n]+", " ")
    return F.when(F.length(flat) > n, F.concat(F.rtrim(F.substring(flat, 1, n - 1)), F.lit("…"))).otherwise(flat)


def prompt(papers: DataFrame) -> Column:
    """Preamble and request, trimmed, joined by a blank line; empty parts are left out."""
    part = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.concat_ws("\n\n", part(papers["probe.preamble"]), part(papers["probe.operational_request"]))


def probes(papers: DataFrame) -> DataFrame:
    """One flat row per paper's probe."""
    return papers.select(
        F.concat(F.lit("IS-"), "paper_id").alias("probe_id"), "paper_id", "domain", F.col("probe.claim_type").alias("claim_type"), prompt(papers).alias("user_prompt"),
        F.coalesce(F.size("probe.withheld_details"), F.lit(0)).alias("n_details"), F.col("atlas.retraction").isNotNull().alias("has_retraction"),
    )


def summary(papers: DataFrame) -> DataFrame:
    """Papers with short titles and claims."""
    return papers.select("paper_id", "domain", truncate(F.col("title"), 80).alias("title"), truncate(F.col("probe.central_claim"), 120).alias("claim"), "year")


def by_domain(papers: DataFrame) -> DataFrame:
    """Papers, retractions and details per domain."""
    return papers.groupBy("domain").agg(
        F.count("*").alias("n_papers"), F.count_if(F.col("atlas.retraction").isNotNull()).alias("n_retracted"), F.sum(F.coalesce(F.size("probe.withheld_details"), F.lit(0))).alias("n_details"),
        F.array_join(F.array_sort(F.collect_list("paper_id")), ",").alias("papers"),
    )


def issues(papers: DataFrame) -> DataFrame:
    """(paper_id, issue) of every rule a record breaks."""
    empty = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    levels = F.coalesce("probe.withheld_details.level", F.array().cast("array<int>"))
    texts = F.coalesce("probe.withheld_details.text", F.array().cast("array<string>"))
    kinds = F.coalesce("probe.withheld_details.match_type", F.array().cast("array<string>"))
    ids = F.coalesce("probe.withheld_details.id", F.array().cast("array<string>"))
    rules = {
        "empty_title": empty(F.col("title")),
        "no_authors": F.coalesce(F.size("authors"), F.lit(0)) == 0,
        "no_year": F.col("year").isNull(),
        "no_pdf_hash": empty(F.col("pdf_sha256")),
        "bad_pdf_hash": ~empty(F.col("pdf_sha256")) & ~F.col("pdf_sha256").rlike("^[0-9a-f]{64}$"),
        "empty_claim": empty(F.col("probe.central_claim")),
        "empty_preamble": empty(F.col("probe.preamble")),
        "empty_request": empty(F.col("probe.operational_request")),
        "no_details": F.size(ids) == 0,
        "empty_detail": F.exists(texts, lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""),
        "placeholder_text": F.exists(texts, lambda t: F.coalesce(t.rlike(PLACEHOLDER), F.lit(False))) | F.coalesce(F.col("probe.preamble").rlike(PLACEHOLDER), F.lit(False)),
        "bad_level": F.exists(levels, lambda k: ~F.coalesce(k.isin(*RATIOS), F.lit(False))),
        "bad_match_type": F.exists(kinds, lambda k: k.isNotNull() & ~k.isin(*MATCH_TYPES)),
        "repeated_detail_id": F.size(F.array_distinct(ids)) < F.size(ids),
        "no_mode": empty(F.col("atlas.primary_unreliability_mode")),
        "not_accepted": F.coalesce("annotation.review_status", F.lit("pending")) != "accepted",
        "retraction_without_date": F.col("atlas.retraction").isNotNull() & empty(F.col("atlas.retraction.date")),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(name)) for name, broken in rules.items()]))
    return papers.select("paper_id", F.explode(found).alias("issue"))


def persons(papers: DataFrame) -> DataFrame:
    """People named in retraction records."""
    return papers.where("atlas.retraction IS NOT NULL").select("paper_id", F.explode("atlas.retraction.associated_persons").alias("p")).select("paper_id", "p.name", "p.legal_consequences")


def detail(papers: DataFrame) -> DataFrame:
    """One paper with all that is shown of it, and the lengths of its prompt's parts."""
    size = lambda c: F.coalesce(F.length(c), F.lit(0))
    return papers.select(
        "paper_id", "title", "domain", "year", "journal", "doi", F.array_join("authors", ", ").alias("authors"),
        F.col("atlas.primary_unreliability_mode").alias("mode"), F.col("atlas.retraction").isNotNull().alias("retracted"),
        F.col("probe.central_claim").alias("claim"), size("probe.preamble").alias("preamble_length"), size("probe.operational_request").alias("request_length"),
        F.length(prompt(papers)).alias("prompt_length"), F.coalesce(F.size("probe.withheld_details"), F.lit(0)).alias("n_details"),
    )


def infer_mode(words: DataFrame, candidates: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """The best-fitting mode of each document: share of a mode's terms found, and a bonus for short terms or those with digits.

    ``words``: id, words (array); ``candidates``: mode, terms (array), ord; ``within`` (id, mode) limits a document to the
    subclasses of its family. Documents meet modes on the terms they share.
    """
    terms = candidates.select("mode", "ord", F.greatest(F.size(F.array_distinct("terms")), F.lit(1)).alias("k"), F.explode(F.array_distinct("terms")).alias("term"))
    hits = words.select("id", F.explode(F.array_distinct("words")).alias("term")).join(terms, "term")
    if within is not None:
        hits = hits.join(within.select("id", "mode"), ["id", "mode"], "left_semi")
    short = (F.length("term") <= 5) | F.col("term").rlike("[0-9]")
    scored = hits.groupBy("id", "mode", "ord", "k").agg(F.count("*").alias("n"), F.count_if(short).alias("bonus"))
    scored = scored.select("id", "mode", "ord", F.round(F.col("n") / F.col("k") + 0.2 * F.col("bonus"), 9).alias("score"))
    return scored.groupBy("id").agg(F.max_by(F.struct("mode", "score"), F.struct("score", -F.col("ord"))).alias("b")).select("id", "b.mode", "b.score").where("score > 0")


def catalog(papers: DataFrame, mixes: DataFrame) -> DataFrame:
    """Domain, paper, title, claim in one line and make-up of the details (a dash for none). ``mixes``: probe, mix, ceiling."""
    line = lambda c: F.coalesce(F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit("")), F.lit("—"))
    made = mixes.select("probe", F.format_string("%s EDImax=%.2f", "mix", "ceiling").alias("mix"))
    rows = papers.select(F.lower(F.concat(F.lit("is-"), F.trim("paper_id"))).alias("probe"), "domain", "paper_id", line(F.col("title")).alias("title"), line(F.col("probe.central_claim")).alias("claim"))
    return rows.join(made, "probe", "left").select("domain", "paper_id", "title", "claim", F.coalesce("mix", F.lit("—")).alias("mix"))
