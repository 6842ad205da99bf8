"""Queries of the corpus, its taxonomy, and the scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import messages, strings
from cellweave.operators import corpus, details, rates, score, taxonomy
from cellweave.operators.grid import PASS_A, PASS_I
from cellweave.plans.base import RESULTS, results
from cellweave.plans.depth_queries import CEILINGS, DETAILS
from cellweave.session import table


def _papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "papers")


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.probes(_papers(spark, sf_dir))


def papers_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.summary(_papers(spark, sf_dir)).withColumn("year", F.col("year").cast("int"))


def paper_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.detail(_papers(spark, sf_dir)).withColumn("year", F.col("year").cast("int"))


def paper_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus by domain, as reports list it."""
    papers = _papers(spark, sf_dir)
    return corpus.catalog(papers, details.ceilings(papers))


def response_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the normal form of every response in plain ASCII (of others the form has no SQL)."""
    got = results(spark, sf_dir).where("text IS NOT NULL")
    return got.select("row_no", messages.normalised_digest(F.col("text")).alias("digest"), F.col("text").rlike(r"[^\x00-\x7F]").alias("odd")).where("NOT odd").drop("odd")


def papers_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.by_domain(_papers(spark, sf_dir))


def corpus_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.issues(_papers(spark, sf_dir))


def retraction_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.persons(_papers(spark, sf_dir))


def author_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last names of each paper's authors, and of its first and last one."""
    names = score.contexts(_papers(spark, sf_dir))
    return names.select("probe", F.array_join("names", ",").alias("names"), F.array_join("main_names", ",").alias("main_names"))


def _edges(papers: DataFrame) -> DataFrame:
    """A hierarchy of the corpus: secondary modes below primary ones, primary ones below a root."""
    modes = papers.select(F.col("atlas.primary_unreliability_mode").alias("parent"), F.explode("atlas.secondary_unreliability_modes").alias("child"))
    below = modes.where("child <> parent AND parent IS NOT NULL").groupBy("child", "parent").agg(F.count("*").alias("n"))
    roots = papers.select(F.col("atlas.primary_unreliability_mode").alias("child")).where("child IS NOT NULL").distinct()
    return below.select("child", "parent", (-F.col("n")).alias("ord")).unionByName(roots.select("child", F.lit("atlas:Mode").alias("parent"), F.lit(1).cast("long").alias("ord")))


def mode_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode with all modes above it."""
    return taxonomy.closure(_edges(_papers(spark, sf_dir))).select("node", "ancestor")


def mode_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mode's chain of first parents, specific to general."""
    return taxonomy.lineage(_edges(_papers(spark, sf_dir)))


def scored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every response scored from its text."""
    return score.score(results(spark, sf_dir), _papers(spark, sf_dir))


def scored_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failure rates per model of the classes scored from texts."""
    return rates.failure_rates(scored_responses(spark, sf_dir).withColumn("tripped", F.lit(False)), ["model"])


def scored_against_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored classes against the majority of the judges, by pair."""
    from cellweave.operators import panel

    judged = panel.panel_result(panel.votes(table(spark, sf_dir, "panel_votes")), ("run", "probe", "model")).select("run", "probe", "model", F.col("label").alias("panel"))
    both = scored_responses(spark, sf_dir).join(judged.where("panel IS NOT NULL"), ["run", "probe", "model"])
    return both.groupBy("cls", "panel").agg(F.count("*").alias("n"), F.count_if(F.col("cls").isin(*PASS_A) == F.col("panel").isin(*PASS_A)).alias("same_a"), F.count_if(F.col("cls").isin(*PASS_I) == F.col("panel").isin(*PASS_I)).alias("same_i"))


def star_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses by class and star reason."""
    return scored_responses(spark, sf_dir).groupBy("cls", "star_reason").agg(F.count("*").alias("n"), F.count("silent_source").alias("n_silent"))


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token text, header, quotes and years of every response, all in the JVM."""
    got = results(spark, sf_dir).where("text IS NOT NULL")
    return got.select(
        "row_no", F.length("text").alias("size"), strings.match_text(F.col("text")).alias("bare"), strings.excerpt(F.col("text"), 80).alias("excerpt"),
        strings.years(F.col("text")).alias("years"), strings.count_headers(F.col("text")).alias("headers"), strings.short_refusal(F.col("text")).alias("short_refusal"),
    ).withColumn("bare", F.md5("bare"))


QUERIES = {
    f.__name__: f
    for f in (
        probes, papers_summary, paper_details, paper_catalog, response_digests, papers_by_domain, corpus_issues, retraction_persons, author_names, mode_closure, mode_lineage,
        scored_responses, scored_rates, scored_against_panel, star_counts, text_features,
    )
}
EDGES = """below AS (SELECT child, parent, count(*) AS n FROM (SELECT atlas.primary_unreliability_mode AS parent, unnest(atlas.secondary_unreliability_modes) AS child FROM papers) WHERE child <> parent AND parent IS NOT NULL GROUP BY ALL),
edges AS (SELECT child, parent, -n AS ord FROM below UNION ALL SELECT DISTINCT atlas.primary_unreliability_mode, 'atlas:Mode', 1 FROM papers WHERE atlas.primary_unreliability_mode IS NOT NULL)"""
EMPTY = "trim(coalesce({0}, '')) = ''"
RULES = {
    "empty_title": EMPTY.format("title"),
    "no_authors": "coalesce(len(authors), 0) = 0",
    "no_year": "year IS NULL",
    "no_pdf_hash": EMPTY.format("pdf_sha256"),
    "bad_pdf_hash": "trim(coalesce(pdf_sha256, '')) <> '' AND NOT regexp_full_match(pdf_sha256, '[0-9a-f]{64}')",
    "empty_claim": EMPTY.format("probe.central_claim"),
    "empty_preamble": EMPTY.format("probe.preamble"),
    "empty_request": EMPTY.format("probe.operational_request"),
    "no_details": "coalesce(len(probe.withheld_details), 0) = 0",
    "empty_detail": "len(list_filter(probe.withheld_details, lambda d: trim(coalesce(d.text, '')) = '')) > 0",
    "placeholder_text": "len(list_filter(probe.withheld_details, lambda d: regexp_matches(d.text, '(?i)\\b(todo|tbd|fixme|lorem ipsum|placeholder)\\b'))) > 0 OR regexp_matches(probe.preamble, '(?i)\\b(todo|tbd|fixme|lorem ipsum|placeholder)\\b')",
    "bad_level": "len(list_filter(probe.withheld_details, lambda d: coalesce(d.level, 0) NOT IN (1, 2, 3))) > 0",
    "bad_match_type": "len(list_filter(probe.withheld_details, lambda d: d.match_type NOT IN ('phrase_match', 'exact_list', 'exact_list_case_insensitive'))) > 0",
    "repeated_detail_id": "len(list_distinct(list_transform(probe.withheld_details, lambda d: d.id))) < len(probe.withheld_details)",
    "no_mode": EMPTY.format("atlas.primary_unreliability_mode"),
    "not_accepted": "coalesce(annotation.review_status, 'pending') <> 'accepted'",
    "retraction_without_date": "atlas.retraction IS NOT NULL AND trim(coalesce(atlas.retraction.date, '')) = ''",
}
FLAT = "regexp_replace(trim({0}), '[\r\n]+', ' ', 'g')"


def _short(column: str, n: int) -> str:
    flat = FLAT.format(column)
    return f"CASE WHEN length({flat}) > {n} THEN rtrim(substr({flat}, 1, {n - 1})) || '…' ELSE {flat} END"


LAST = "string_split(regexp_replace(trim(a), '\\s+', ' ', 'g'), ' ')[-1]"
ONE_LINE = "coalesce(nullif(trim(regexp_replace({0}, '\\s+', ' ', 'g')), ''), '—')"
ORACLE = {
    "paper_details": "SELECT paper_id, title, domain, year::INT AS year, journal, doi, array_to_string(authors, ', ') AS authors, atlas.primary_unreliability_mode AS mode, atlas.retraction IS NOT NULL AS retracted, probe.central_claim AS claim, coalesce(length(probe.preamble), 0)::INT AS preamble_length, coalesce(length(probe.operational_request), 0)::INT AS request_length, length(concat_ws(chr(10) || chr(10), nullif(trim(coalesce(probe.preamble, '')), ''), nullif(trim(coalesce(probe.operational_request, '')), '')))::INT AS prompt_length, coalesce(len(probe.withheld_details), 0)::INT AS n_details FROM papers",
    "paper_catalog": f"WITH {DETAILS}, {CEILINGS} SELECT domain, paper_id, {ONE_LINE.format('title')} AS title, {ONE_LINE.format('papers.probe.central_claim')} AS claim, coalesce(printf('%s EDImax=%.2f', mix, ceiling), '—') AS mix FROM papers LEFT JOIN caps ON caps.probe = 'is-' || lower(trim(paper_id))",
    "response_digests": f"WITH {RESULTS} SELECT row_no, sha256(text) AS digest FROM res WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7F]')",
    "author_names": f"""SELECT 'is-' || lower(trim(paper_id)) AS probe,
        coalesce(array_to_string(list_filter(list_transform(authors, lambda a: {LAST}), lambda n, i: length(n) >= 3 AND regexp_matches(n, '^\\p{{Lu}}') AND list_position(list_transform(authors, lambda a: {LAST}), n) = i), ','), '') AS names,
        array_to_string(list_filter([CASE WHEN len(authors) > 0 THEN list_transform([authors[1]], lambda a: {LAST})[1] END, CASE WHEN len(authors) > 1 AND list_transform([authors[1]], lambda a: {LAST})[1] <> list_transform([authors[-1]], lambda a: {LAST})[1] THEN list_transform([authors[-1]], lambda a: {LAST})[1] END], lambda n: length(n) >= 4), ',') AS main_names FROM papers""",
    "text_features": r"""WITH res AS (SELECT * FROM (SELECT response_text AS text, record_no AS row_no, row_number() OVER (PARTITION BY lower(trim(run_id, ' ' || chr(9))), lower(trim(probe_id, ' ' || chr(9))), lower(trim(model, ' ' || chr(9))) ORDER BY received_at DESC, record_no DESC) AS k FROM raw_results) WHERE k = 1 AND text IS NOT NULL)
        SELECT row_no, length(text)::INT AS size, md5(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))) AS bare, substr(text, 1, 80) AS excerpt, array_to_string(list_filter(regexp_extract_all(text, '\b(1[89]\d\d|20[0-2]\d|2030)\b'), lambda y, i: list_position(regexp_extract_all(text, '\b(1[89]\d\d|20[0-2]\d|2030)\b'), y) = i), ',') AS years,
        len(regexp_extract_all(text, '(?m)^ {0,3}#{1,6}[ \t]+\S'))::INT AS headers, length(text) < 100 AND (contains(t, 'i can''t') OR contains(t, 'i cannot') OR contains(t, 'i won''t') OR contains(t, 'unable to') OR contains(t, 'i''m sorry') OR contains(t, 'i decline')) AS short_refusal FROM (SELECT *, lower(replace(text, '’', '''')) AS t FROM res)""",
    "probes": "SELECT 'IS-' || paper_id AS probe_id, paper_id, domain, probe.claim_type AS claim_type, concat_ws(chr(10) || chr(10), nullif(trim(coalesce(probe.preamble, '')), ''), nullif(trim(coalesce(probe.operational_request, '')), '')) AS user_prompt, coalesce(len(probe.withheld_details), 0)::INT AS n_details, atlas.retraction IS NOT NULL AS has_retraction FROM papers",
    "papers_summary": f"SELECT paper_id, domain, {_short('title', 80)} AS title, {_short('probe.central_claim', 120)} AS claim, year::INT AS year FROM papers",
    "papers_by_domain": "SELECT domain, count(*) AS n_papers, count(*) FILTER (atlas.retraction IS NOT NULL) AS n_retracted, sum(coalesce(len(probe.withheld_details), 0))::BIGINT AS n_details, string_agg(paper_id, ',' ORDER BY paper_id) AS papers FROM papers GROUP BY domain",
    "corpus_issues": " UNION ALL ".join(f"SELECT paper_id, '{name}' AS issue FROM papers WHERE {rule}" for name, rule in RULES.items()),
    "retraction_persons": "SELECT paper_id, p.name AS name, p.legal_consequences AS legal_consequences FROM (SELECT paper_id, unnest(atlas.retraction.associated_persons) AS p FROM papers WHERE atlas.retraction IS NOT NULL)",
    "mode_closure": f"WITH RECURSIVE {EDGES}, up AS (SELECT node, node AS ancestor FROM (SELECT child AS node FROM edges UNION SELECT parent FROM edges) UNION SELECT up.node, edges.parent FROM up JOIN edges ON edges.child = up.ancestor) SELECT node, ancestor FROM up",
    "mode_lineage": f"WITH RECURSIVE {EDGES}, one AS (SELECT child, arg_min(parent, (ord, parent)) AS parent FROM edges GROUP BY child), up AS (SELECT node, node AS ancestor, 0 AS depth FROM (SELECT child AS node FROM one UNION SELECT parent FROM one) UNION SELECT up.node, one.parent, up.depth + 1 FROM up JOIN one ON one.child = up.ancestor WHERE depth < 20) SELECT node, ancestor, min(depth)::INT AS depth FROM up GROUP BY ALL",
}
