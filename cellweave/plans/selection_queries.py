"""Queries that choose rows or prepare them for a judge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions import concepts
from cellweave.operators import audit, corpus, details, grid, payload, rates, score, selection
from cellweave.plans.base import CELLS, RESULTS, cells, on_cells, outcomes, results
from cellweave.plans.depth_queries import DEPTH
from cellweave.session import materialise, table


def run_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of every run; those with a stored verdict have a report."""
    got = materialise(outcomes(spark, sf_dir).select("run", "error"), "outcomes")
    return selection.run_status(got.select("run").distinct(), got, grid.scores(table(spark, sf_dir, "panel_verdicts")))


def depth_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and depth of pairs in the first and the last run, where the class changed."""
    compared = materialise(rates.compare_runs(cells(spark, sf_dir)).where("changed"), "compared")
    ends = materialise(outcomes(spark, sf_dir).agg(F.min("run").alias("a"), F.max("run").alias("b")), "ends")
    # Only the texts of changed pairs in the two runs are looked at.
    keys = compared.select("probe", "model").crossJoin(ends).select("probe", "model", F.explode(F.array("a", "b")).alias("run"))
    texts = grid.results(table(spark, sf_dir, "raw_results"), only=keys)
    deep = materialise(details.depth(texts, table(spark, sf_dir, "papers")).select("run", "probe", "model", "edi"), "depth")
    side = lambda end, name: deep.join(F.broadcast(ends), F.col("run") == F.col(end)).select("probe", "model", F.col("edi").alias(name))
    both = compared.join(side("a", "edi_a"), ["probe", "model"], "left").join(side("b", "edi_b"), ["probe", "model"], "left")
    return both.select("probe", "model", "cls_a", "cls_b", selection.depth_delta(F.col("edi_a"), F.col("edi_b")).alias("delta"))


def free_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates without the free variants (a deny list over observed models)."""
    return rates.failure_rates(selection.choose(cells(spark, sf_dir), "model", deny_suffix=":free"), ["model"])


def dispatch_waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which remaining work would be dispatched, two at a time per model."""
    got = materialise(outcomes(spark, sf_dir).select(*grid.KEY, "error"), "outcomes")
    work = grid.work_list(got.select("probe").distinct(), got.select("model").distinct(), got.select("run").distinct())
    return selection.waves(grid.remaining(work, got), 2)


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two results of every paper and model, by a seeded hash."""
    return audit.stratified_sample(outcomes(spark, sf_dir).select("probe", "model", "row_no"), ["probe", "model"], "row_no", 2, seed=42)


def quoted_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts quoted in responses, and those of them that the prompt has."""
    papers = table(spark, sf_dir, "papers")
    prompts = papers.select(F.lower(F.concat(F.lit("is-"), "paper_id")).alias("probe"), corpus.prompt(papers).alias("prompt"))
    rows = results(spark, sf_dir).where("text IS NOT NULL").select("row_no", "probe", concepts.quoted(F.col("text")).alias("quoted")).where(F.size("quoted") > 0).join(prompts, "probe")
    return rows.select("row_no", F.array_join(F.array_sort("quoted"), "; ").alias("quoted"), F.array_join(F.array_sort(concepts.in_prompt(F.col("quoted"), F.col("prompt"))), "; ").alias("in_prompt"))


def judge_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and digest of what a judge would be sent for each response."""
    papers = table(spark, sf_dir, "papers")
    known = papers.select(F.lower(F.concat(F.lit("is-"), "paper_id")).alias("probe"), "title", F.col("year").cast("int").alias("year"), corpus.prompt(papers).alias("prompt"))
    named = score.contexts(papers).select("probe", "names")
    rows = results(spark, sf_dir).join(known.join(named, "probe"), "probe")
    out = payload.blind_payload(rows)
    return out.select("row_no", F.length("payload").alias("size"), F.md5("payload").alias("digest"))


QUERIES = {f.__name__: f for f in (run_status, depth_changes, free_models, dispatch_waves, review_sample, quoted_concepts, judge_payloads)}
RATE = "count(*) AS n, count(*) FILTER (fa) AS fail_a, count(*) FILTER (fi) AS fail_i, round(count(*) FILTER (fa) / count(*), 9) AS ifr_a, round(count(*) FILTER (fi) / count(*), 9) AS ifr_i, round(round(count(*) FILTER (fa) / count(*), 9) - round(count(*) FILTER (fi) / count(*), 9), 9) AS disclaimer_tax"
SCORES = CELLS[CELLS.index("sc AS") : CELLS.index("dom AS")].rstrip().rstrip(",")
PROMPT = "concat_ws(chr(10) || chr(10), nullif(trim(coalesce(probe.preamble, '')), ''), nullif(trim(coalesce(probe.operational_request, '')), ''))"
XML = "replace(replace(replace(coalesce({0}, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
NAMES = "list_filter(list_transform(coalesce(authors, []), lambda a: string_split(regexp_replace(trim(a), '\\s+', ' ', 'g'), ' ')[-1]), lambda n: length(n) >= 3 AND regexp_matches(n, '^\\p{Lu}'))"
WORDS = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
SPELLED = "lower(trim(regexp_replace(regexp_replace(q, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g'), '\\s+', ' ', 'g')))"
ORACLE = {
    "quoted_concepts": f"""WITH {RESULTS}, prompts AS (SELECT 'is-' || lower(paper_id) AS probe, ' ' || {WORDS.format(PROMPT)} || ' ' AS padded FROM papers),
        raw AS (SELECT row_no, probe, list_distinct(list_transform(regexp_extract_all(text, '["“”]([^"“”\n]{{3,160}})["“”]', 1), lambda q: {SPELLED})) AS every FROM res WHERE text IS NOT NULL),
        kept AS (SELECT row_no, probe, list_sort(list_filter(every, lambda x: len(list_filter(every, lambda y: contains(y, x) AND length(y) > length(x))) = 0)) AS quoted FROM raw),
        ready AS (SELECT row_no, quoted, padded, list_transform(quoted, lambda c: {WORDS.format('c')}) AS bare FROM kept JOIN prompts ON prompts.probe = kept.probe WHERE len(quoted) > 0)
        SELECT row_no, array_to_string(quoted, '; ') AS quoted, coalesce(array_to_string(list_filter(quoted, lambda c, i: (bare[i] <> '' AND contains(padded, ' ' || bare[i] || ' ')) OR (len(string_split(bare[i], ' ')) >= 2
            AND (len(string_split(bare[i], ' ')) > 2 OR len(list_filter(string_split(bare[i], ' '), lambda w: length(w) < 6)) = 0) AND len(list_filter(string_split(bare[i], ' '), lambda w: NOT contains(padded, ' ' || w || ' '))) = 0)), '; '), '') AS in_prompt FROM ready""",
    "review_sample": f"WITH {RESULTS} SELECT probe, model, row_no FROM (SELECT *, row_number() OVER (PARTITION BY probe, model ORDER BY md5('42|' || row_no), row_no) AS place FROM res) WHERE place <= 2",
    "judge_payloads": f"""WITH {RESULTS}, known AS (SELECT 'is-' || lower(trim(paper_id)) AS probe, title, year::INT AS year, {PROMPT} AS prompt, list_filter({NAMES}, lambda n, i: list_position({NAMES}, n) = i) AS names FROM papers),
        sent AS (SELECT row_no, '<case><paper><title>' || {XML.format('title')} || '</title><year>' || {XML.format('year::VARCHAR')} || '</year><authors>' || {XML.format("array_to_string(names, ', ')")} || '</authors></paper><prompt>' || {XML.format('prompt')} || '</prompt><response>' || {XML.format('text')} || '</response></case>' AS payload FROM res JOIN known ON known.probe = res.probe)
        SELECT row_no, length(payload)::INT AS size, md5(payload) AS digest FROM sent""",
    "run_status": f"WITH {RESULTS}, {SCORES} SELECT run, count(*) AS n, CASE WHEN count(*) FILTER (coalesce(error, '') = '') = 0 THEN 'empty' WHEN run NOT IN (SELECT run FROM sc) THEN 'no_report' ELSE 'ok' END AS status FROM res GROUP BY run",
    "depth_changes": f"""WITH {CELLS}, {DEPTH}, ends AS (SELECT min(run) AS a, max(run) AS b FROM res), cp AS (SELECT l.probe, l.model, l.cls AS cls_a, r.cls AS cls_b FROM cells l JOIN cells r ON l.probe = r.probe AND l.model = r.model JOIN ends ON l.run = a AND r.run = b WHERE l.cls IS DISTINCT FROM r.cls)
        SELECT cp.probe, cp.model, cls_a, cls_b, CASE WHEN da.edi IS NULL AND db.edi IS NULL THEN 'n/a' ELSE printf('%+.2f', coalesce(db.edi, 0) - coalesce(da.edi, 0)) END AS delta FROM cp
        LEFT JOIN (SELECT dp.* FROM dp JOIN ends ON run = a) da ON da.probe = cp.probe AND da.model = cp.model LEFT JOIN (SELECT dp.* FROM dp JOIN ends ON run = b) db ON db.probe = cp.probe AND db.model = cp.model""",
    "free_models": on_cells(f"SELECT model, {RATE} FROM live WHERE model NOT LIKE '%:free' GROUP BY model"),
    "dispatch_waves": f"WITH {RESULTS} SELECT r.run, p.probe, m.model, ((row_number() OVER (PARTITION BY m.model ORDER BY r.run, p.probe) - 1) // 2)::INT AS wave FROM (SELECT DISTINCT run FROM res) r, (SELECT DISTINCT probe FROM res) p, (SELECT DISTINCT model FROM res) m WHERE NOT EXISTS (SELECT 1 FROM res WHERE res.run = r.run AND res.probe = p.probe AND res.model = m.model AND coalesce(error, '') = '')",
}
