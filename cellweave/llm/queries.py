"""Queries of the text and judgement problems, with SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.identifiers import CLASSES, fold_identifier
from cellweave.llm import consensus, languages, lookalikes, packing, pairs, reading, refusals, tokens, truncation
from cellweave.operators import grid
from cellweave.session import materialise, sized, table


def _judged(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return consensus.consensus(consensus.valid_votes(table(spark, sf_dir, "panel_votes")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consensus class of every item with valid votes of at least three members."""
    items, _ = _judged(spark, sf_dir)
    return items.select(F.col("item").alias("item_id"), F.array(*map(F.lit, CLASSES))[F.col("cls")].alias("label"))


def p1_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consensus class, its posterior, and the agreement of the votes of every item."""
    items, _ = _judged(spark, sf_dir)
    label = F.array(*map(F.lit, CLASSES))[F.col("cls")]
    return items.select(F.col("item").alias("item_id"), label.alias("label"), "confidence", "n_votes", "agreement")


def p1_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, chance-corrected skill and vote rates (true class by vote) of every member."""
    _, people = _judged(spark, sf_dir)
    return people.select(F.col("member").alias("member_id"), "n_votes", "accuracy", "skill", F.to_json("rates").alias("rates"))


def _cuts(results: DataFrame) -> DataFrame:
    return truncation.cut_texts(results, "record_no", "response_text", "finish_reason", "completion_tokens", "model")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every result whose text was cut off."""
    found = _cuts(table(spark, sf_dir, "raw_results"))
    return found.where("cut").select(F.col("row_no").alias("record_no"))


def p2_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts by what was seen of their end, and how many of them are cut."""
    found = _cuts(table(spark, sf_dir, "raw_results"))
    return found.groupBy("evidence").agg(F.count("*").alias("n"), F.count_if("cut").alias("n_cut"))


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per model: answers, cut answers and their share."""
    rows = table(spark, sf_dir, "raw_results")
    found = _cuts(rows)
    named = rows.select(F.col("record_no").alias("row_no"), fold_identifier(F.col("model")).alias("model"))
    counts = named.join(found, "row_no").groupBy("model").agg(F.count("*").alias("n"), F.count_if("cut").alias("n_cut"))
    return counts.withColumn("cut_rate", F.col("n_cut") / F.col("n"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, span list and quote list as a list of values."""
    results = table(spark, sf_dir, "raw_results").select(
        F.lit("raw_results").alias("source_table"), F.col("record_no").alias("row_no"), F.lit("response_text").alias("field_name"), F.array("response_text").alias("values")
    )
    lists = F.array(
        F.struct(F.lit("key_spans").alias("field_name"), F.col("key_spans").alias("values")),
        F.struct(F.lit("quote").alias("field_name"), F.col("source_identification_evidence.quote").alias("values")),
    )
    votes = table(spark, sf_dir, "panel_votes").select(F.lit("panel_votes").alias("source_table"), F.col("vote_no").alias("row_no"), F.inline(lists))
    return results.unionByName(votes)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored text, span list or quote list that holds look-alike or invisible characters."""
    return lookalikes.affected(_values(spark, sf_dir))


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts, spans and quotes in one consistent form."""
    return lookalikes.consistent(_values(spark, sf_dir))


def p3_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vote: spans and quotes, and how many of them are in the response as written and in consistent form."""
    votes = table(spark, sf_dir, "panel_votes")
    empty = F.array().cast("array<string>")
    spans = F.concat(F.coalesce("key_spans", empty), F.coalesce(F.col("source_identification_evidence.quote"), empty))
    keyed = votes.select("vote_no", *[fold_identifier(F.col(c)).alias(n) for c, n in (("run_id", "run"), ("probe_id", "probe"), ("model", "model"))], spans.alias("spans"))
    keyed = keyed.where(F.size("spans") > 0)
    # Only the judged results' texts travel: a short list of their keys is sent to the texts.
    judged = sized(materialise(keyed.select("run", "probe", "model").distinct(), "judged"))
    texts = grid.results(table(spark, sf_dir, "raw_results"), only=judged).select("run", "probe", "model", "text")
    rows = keyed.join(texts, ["run", "probe", "model"], "left")
    return rows.select("vote_no", lookalikes.located(F.col("text"), F.col("spans")).alias("s")).select("vote_no", "s.*")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every defect of every result, compared with its prompt."""
    results = table(spark, sf_dir, "raw_results")
    model, classifier = languages.fit(table(spark, sf_dir, "documents")), refusals.fit(results, table(spark, sf_dir, "panel_votes"))
    found = pairs.broken_pairs(results, table(spark, sf_dir, "papers"), model, classifier, tokens="completion_tokens", system="model")
    return found.select(F.col("row_no").alias("record_no"), "defect")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return tokens.encode(table(spark, sf_dir, "documents"), "doc_id")


def p7_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the place at which each one's slice of the text begins."""
    return tokens.located(table(spark, sf_dir, "documents"), "doc_id")


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every document, decoded from its ids; it equals the text that was encoded."""
    return tokens.decode(p7_ids(spark, sf_dir), "doc_id")


def p8_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document (or of each piece of one beyond the capacity), for each capacity."""
    counts = tokens.count(table(spark, sf_dir, "documents"), "doc_id")
    return packing.pack(counts, table(spark, sf_dir, "pack_windows"), key="doc_id", size="tokens")


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers used, the fewest that could do by volume, and the share of room used."""
    caps = table(spark, sf_dir, "pack_windows").select("window_name", F.col("capacity_tokens").cast("long").alias("capacity_tokens"))
    used = p8_packed(spark, sf_dir).groupBy("window_name", "container_id").agg(F.sum("tokens").alias("fill"))
    return (
        used.groupBy("window_name")
        .agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
        .join(F.broadcast(caps), "window_name")
        .select("window_name", "containers", "tokens", "fullest", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least"), (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("share_used"))
    )


#: Documents of fewer words have no level of their own.
LEAST_WORDS = 40


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return reading.levels(documents, table(spark, sf_dir, "reading_refs"), languages.fit(documents))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reading level of every document, where it has one."""
    return _levels(spark, sf_dir).select("doc_id", F.col("reads").alias("is_english"), "words", "level")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every English document of at least 40 words at the specialists' level."""
    return _levels(spark, sf_dir).where((F.col("words") >= LEAST_WORDS) & (F.col("level") >= 4)).select("doc_id")


QUERIES = {
    "p1_found": p1_found,
    "p1_items": p1_items,
    "p1_members": p1_members,
    "p2_found": p2_found,
    "p2_evidence": p2_evidence,
    "p2_rates": p2_rates,
    "p3_found": p3_found,
    "p3_canonical": p3_canonical,
    "p3_spans": p3_spans,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p7_offsets": p7_offsets,
    "p7_decoded": p7_decoded,
    "p8_packed": p8_packed,
    "p8_usage": p8_usage,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}
ORACLE: dict[str, str] = {
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
