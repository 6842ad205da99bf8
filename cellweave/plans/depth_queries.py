"""Queries of withheld details and depth, and of endpoint health."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import details, grid, health, stability
from cellweave.plans.base import CELLS, RESULTS, cells, results
from cellweave.session import table, work_folder
from cellweave.streaming import breaker


def detail_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Withheld details found in responses."""
    return details.matches(results(spark, sf_dir), table(spark, sf_dir, "papers")).select("row_no", "pos", "detail_id", "level", "score")


def detail_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of list details found in responses, in the order of their places."""
    found = details.matches(results(spark, sf_dir), table(spark, sf_dir, "papers"))
    return found.where("at IS NOT NULL").select("row_no", "pos", F.array_join("at", "; ").alias("at"))


def depth_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth index of every response."""
    return details.depth(results(spark, sf_dir), table(spark, sf_dir, "papers")).select("row_no", "edi", "skipped", "n_matches")


def detail_ceilings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest index and make-up of each probe's details."""
    return details.ceilings(table(spark, sf_dir, "papers"))


def ceiling_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    caps = detail_ceilings(spark, sf_dir)
    return caps.agg(F.count("*").alias("n"), F.round(F.avg("ceiling"), 6).alias("mean"), F.min("ceiling").alias("least"), F.max("ceiling").alias("most"))


def reproduction_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return details.by_level(details.matches(results(spark, sf_dir), table(spark, sf_dir, "papers")))


def _engaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    engaged = cells(spark, sf_dir).where(F.col("cls").isin(grid.ER, grid.EU)).select("run", "probe", "model")
    return details.depth(grid.results(table(spark, sf_dir, "raw_results"), only=engaged), table(spark, sf_dir, "papers"))


def engaged_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of engaged cells per model."""
    return details.depth_stats(_engaged(spark, sf_dir), detail_ceilings(spark, sf_dir), ["model"])


def engaged_depth_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of engaged cells per run, then mean and population deviation over runs."""
    runs = details.depth_stats(_engaged(spark, sf_dir), detail_ceilings(spark, sf_dir), ["run"])
    return runs.agg(F.count("*").alias("n_runs"), *[F.round(f(c), 5).alias(f"{c}_{n}") for c in ("n", "mean_edi", "median_edi", "achievement") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])


def pair_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of each pair over the runs in which its cell is not null."""
    content = cells(spark, sf_dir).where("NOT is_null AND NOT tripped").select("run", "probe", "model")
    return stability.pair_depth(details.depth(grid.results(table(spark, sf_dir, "raw_results"), only=content), table(spark, sf_dir, "papers")))


def class_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth by class and domain of the cell, with totals (grouping sets)."""
    joined = cells(spark, sf_dir).where("cls IS NOT NULL AND NOT is_null").join(details.depth(results(spark, sf_dir), table(spark, sf_dir, "papers")), ["run", "probe", "model"])
    cube = joined.cube("cls", "domain").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce("edi", F.lit(0.0))), 6).alias("mean_edi"))
    return cube.select(F.coalesce("cls", F.lit("(all)")).alias("cls"), F.coalesce("domain", F.lit("(all)")).alias("domain"), "n", "mean_edi")


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.from_events(table(spark, sf_dir, "events"))


#: The test events are sparse, so that the quiet time is in days.
LIMITS = health.Thresholds(consecutive=3, rate=0.6, quiet_seconds=2 * 86400.0)


def breaker_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which models trip the breaker, when and why."""
    return health.breaker_state(_attempts(spark, sf_dir), LIMITS)


def breaker_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.availability(breaker_state(spark, sf_dir))


def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most attempts per model in any trailing hour."""
    return health.request_rate(_attempts(spark, sf_dir), 3600)


def calls_in_flight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most calls of a model under way at once, if an event's value were minutes."""
    events = table(spark, sf_dir, "events")
    calls = events.select(F.col("user_id").cast("string").alias("model"), F.col("ts").cast("timestamp").alias("at"), (F.round(F.abs("value")) * 60).alias("seconds"))
    return health.in_flight(calls)


def _attempt_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")
    return health.from_events(raw)


def breaker_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The breaker as a stateful stream; its last states equal those of the batch."""
    stream = breaker.breaker_stream(_attempt_stream(spark, sf_dir), LIMITS)
    return breaker.run_to_table(stream, work_folder(spark, "breaker"), "update", ["model"])


def failure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and failures per model and day, from a watermarked stream."""
    stream = breaker.windowed_failures(_attempt_stream(spark, sf_dir), "1 day", "2 days")
    return breaker.run_to_table(stream, work_folder(spark, "windows"), "update", ["model", "start"])


def attempt_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of attempts, ended by six quiet hours."""
    return breaker.sessions(_attempts(spark, sf_dir), "6 hours")


QUERIES = {
    f.__name__: f
    for f in (
        detail_matches, detail_places, depth_index, detail_ceilings, ceiling_summary, reproduction_by_level, engaged_depth, engaged_depth_runs, pair_depth, class_depth,
        breaker_state, breaker_availability, request_rate, calls_in_flight, breaker_stream, failure_windows, attempt_sessions,
    )
}

PAD = "' ' || trim(regexp_replace(replace({0}, '’', ''''), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"


def _pad(x: str) -> str:
    return PAD.format(x)


def _canonical(x: str) -> str:
    out = f"lower({x})"
    for value, word in enumerate(details.NUMBERS):
        out = f"replace({out}, ' {word} ', ' {value} ')"
    return out


STOPS = ", ".join(f"'{w}'" for w in details.STOP)
WEIGHT = "CASE level WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 WHEN 3 THEN 1.0 END::DOUBLE"
DETAILS = f"""dt0 AS (SELECT 'is-' || lower(trim(paper_id)) AS probe, generate_subscripts(probe.withheld_details, 1) - 1 AS pos, unnest(probe.withheld_details) AS d FROM papers),
dt AS (SELECT probe, pos, coalesce(d.id, pos::VARCHAR) AS detail_id, d.level AS level, CASE WHEN d.match_type IN ('exact_list', 'exact_list_case_insensitive') THEN d.match_type ELSE 'phrase_match' END AS kind,
    {_canonical(_pad("coalesce(d.text, '')"))} AS needle, list_transform(list_filter(list_transform(string_split(coalesce(d.text, ''), ','), lambda x: trim(x)), lambda x: x <> ''), lambda x: {_pad('x')}) AS items,
    list_distinct(list_filter(string_split(trim(lower({_pad("coalesce(d.text, '')")})), ' '), lambda w: w <> '' AND w NOT IN ({STOPS}))) AS content FROM dt0)"""
MATCHES = f"""{DETAILS}, hay AS (SELECT row_no, run, probe, model, {_pad('text')} AS hay FROM res WHERE length(text) > 0),
mm0 AS (SELECT row_no, run, hay.probe, model, pos, detail_id, level, kind,
    len(list_filter(items, lambda i: contains(hay, i))) / greatest(len(items), 1) AS cs, len(list_filter(items, lambda i: contains(lower(hay), lower(i)))) / greatest(len(items), 1) AS ci,
    CASE WHEN trim(needle) <> '' AND contains({_canonical('hay')}, needle) THEN 1.0 ELSE len(list_intersect(content, string_split(trim(lower(hay)), ' '))) / greatest(len(content), 1) END AS ph FROM hay JOIN dt ON dt.probe = hay.probe),
mm AS (SELECT row_no, run, probe, model, pos, detail_id, level, round(CASE kind WHEN 'exact_list' THEN cs WHEN 'exact_list_case_insensitive' THEN ci ELSE ph END, 9)::DOUBLE AS score FROM mm0 WHERE round(CASE kind WHEN 'exact_list' THEN cs WHEN 'exact_list_case_insensitive' THEN ci ELSE ph END, 9) >= 0.333333333)"""
DEPTH = f"""{MATCHES}, sums AS (SELECT row_no, sum({WEIGHT} * score) AS total, count(*) AS n_matches FROM mm GROUP BY row_no), cnt AS (SELECT probe, count(*) AS n_details FROM dt GROUP BY probe),
dp AS (SELECT res.row_no, run, res.probe, model, CASE WHEN coalesce(n_details, 0) = 0 THEN 'no_withheld_details' WHEN length(coalesce(text, '')) < 200 THEN 'below_length_gate' END AS skipped,
    CASE WHEN coalesce(n_details, 0) > 0 AND length(coalesce(text, '')) >= 200 THEN round(coalesce(total, 0) / n_details, 9) END AS edi, coalesce(n_matches, 0) AS n_matches FROM res LEFT JOIN cnt ON cnt.probe = res.probe LEFT JOIN sums ON sums.row_no = res.row_no)"""
CEILINGS = f"caps AS (SELECT probe, sum(k)::BIGINT AS n_details, round(sum(k * {WEIGHT}) / sum(k), 9) AS ceiling, string_agg(k || 'xL' || level, ', ' ORDER BY level) AS mix FROM (SELECT probe, level, count(*) AS k FROM dt GROUP BY ALL) GROUP BY probe)"
STATS = "count(*) AS n, round(avg(coalesce(edi, 0)), 6) AS mean_edi, round(median(coalesce(edi, 0)), 6) AS median_edi, round(coalesce(sum(edi) FILTER (edi IS NOT NULL AND coalesce(ceiling, 0) > 0) / nullif(sum(ceiling) FILTER (edi IS NOT NULL AND coalesce(ceiling, 0) > 0), 0), 0), 6) AS achievement"
ENGAGED = f"{CELLS}, {DEPTH.replace('cnt AS', 'cnt AS')}, {CEILINGS}, en AS (SELECT dp.*, ceiling FROM dp JOIN cells ON cells.run = dp.run AND cells.probe = dp.probe AND cells.model = dp.model AND cells.cls LIKE 'ENGAGED%' LEFT JOIN caps ON caps.probe = dp.probe)"
ATTEMPTS = f"""att AS (SELECT user_id::VARCHAR AS model, ts::TIMESTAMP AS tm, event_id AS ord, event_type <> 'error' AS ok FROM events),
a1 AS (SELECT *, sum(ok::INT) OVER p AS n_ok, row_number() OVER p AS attempt, count(*) OVER r AS n_recent, avg((NOT ok)::INT) OVER r AS fail_rate, coalesce(last_value(CASE WHEN ok THEN tm END IGNORE NULLS) OVER p, first_value(tm) OVER p) AS since FROM att
    WINDOW p AS (PARTITION BY model ORDER BY tm, ord ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY model ORDER BY tm, ord ROWS {LIMITS.window - 1} PRECEDING)),
a2 AS (SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY model, n_ok ORDER BY tm, ord ROWS UNBOUNDED PRECEDING) AS streak FROM a1),
a3 AS (SELECT *, CASE WHEN ok THEN NULL WHEN streak >= {LIMITS.consecutive} THEN 'consecutive' WHEN n_recent >= {LIMITS.least} AND fail_rate >= {LIMITS.rate} THEN 'rate' WHEN epoch_us(tm) - epoch_us(since) >= {int(LIMITS.quiet_seconds * 1e6)} THEN 'wallclock' END AS reason FROM a2),
ft AS (SELECT model, min(attempt) AS t FROM a3 WHERE reason IS NOT NULL GROUP BY model),
st AS (SELECT a3.model, max(reason) FILTER (attempt = t) AS reason, max(tm) FILTER (attempt = t) AS tripped_at, count(*) AS attempts, count(*) FILTER (ok) AS successes, max(t) IS NOT NULL AS tripped FROM a3 LEFT JOIN ft ON ft.model = a3.model WHERE t IS NULL OR attempt <= t GROUP BY a3.model)"""
ORACLE = {
    "detail_matches": f"WITH {RESULTS}, {MATCHES} SELECT row_no, pos, detail_id, level, score FROM mm",
    "detail_places": f"""WITH {RESULTS}, {MATCHES}, spots AS (SELECT mm.row_no, mm.pos, dt.kind, trim(i) AS item, CASE WHEN dt.kind = 'exact_list' THEN strpos(hay, i) ELSE strpos(lower(hay), lower(i)) END AS place
        FROM mm JOIN hay ON hay.row_no = mm.row_no JOIN dt ON dt.probe = mm.probe AND dt.pos = mm.pos, unnest(dt.items) AS u(i) WHERE dt.kind <> 'phrase_match')
        SELECT row_no, pos, string_agg(CASE WHEN kind = 'exact_list' THEN item ELSE lower(item) END, '; ' ORDER BY place, lower(item)) AS at FROM spots WHERE place > 0 GROUP BY row_no, pos""",
    "depth_index": f"WITH {RESULTS}, {DEPTH} SELECT row_no, edi, skipped, n_matches FROM dp",
    "detail_ceilings": f"WITH {DETAILS}, {CEILINGS} SELECT * FROM caps",
    "ceiling_summary": f"WITH {DETAILS}, {CEILINGS} SELECT count(*) AS n, round(avg(ceiling), 6) AS mean, min(ceiling) AS least, max(ceiling) AS most FROM caps",
    "reproduction_by_level": f"WITH {RESULTS}, {MATCHES} SELECT level, count(*) AS n, round(sum(score), 6) AS score FROM mm GROUP BY level",
    "engaged_depth": f"WITH {ENGAGED} SELECT model, {STATS} FROM en GROUP BY model",
    "engaged_depth_runs": f"WITH {ENGAGED} SELECT count(*) AS n_runs, "
    + ", ".join(f"round({f}({c}), 5) AS {c}_{n}" for c in ("n", "mean_edi", "median_edi", "achievement") for n, f in (("mean", "avg"), ("sd", "stddev_pop")))
    + f" FROM (SELECT run, {STATS} FROM en GROUP BY run)",
    "pair_depth": f"WITH {CELLS}, {DEPTH} SELECT dp.probe, dp.model, round(avg(edi), 9) AS edi_mean, round(stddev_pop(edi), 9) AS edi_sd, count(*) AS n FROM dp JOIN cells ON cells.run = dp.run AND cells.probe = dp.probe AND cells.model = dp.model WHERE edi IS NOT NULL AND NOT is_null AND NOT cells.tripped GROUP BY ALL",
    "class_depth": f"WITH {CELLS}, {DEPTH} SELECT coalesce(cls, '(all)') AS cls, coalesce(domain, '(all)') AS domain, count(*) AS n, round(avg(coalesce(edi, 0)), 6) AS mean_edi FROM dp JOIN cells ON cells.run = dp.run AND cells.probe = dp.probe AND cells.model = dp.model WHERE cls IS NOT NULL AND NOT is_null GROUP BY CUBE (cls, domain)",
    "breaker_state": f"WITH {ATTEMPTS} SELECT * FROM st",
    "breaker_stream": f"WITH {ATTEMPTS} SELECT * FROM st",
    "breaker_availability": f"WITH {ATTEMPTS} SELECT coalesce(reason, 'healthy') AS state, count(*) AS n_models, sum(attempts)::BIGINT AS attempts FROM st GROUP BY 1",
    "request_rate": "SELECT model, max(n) AS most FROM (SELECT user_id::VARCHAR AS model, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts::TIMESTAMP) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY model",
    "calls_in_flight": """WITH s AS (SELECT user_id::VARCHAR AS model, epoch_us(ts::TIMESTAMP) AS t, 1 AS d FROM events UNION ALL SELECT user_id::VARCHAR, epoch_us(ts::TIMESTAMP) + (round(abs(value)) * 60000000)::BIGINT, -1 FROM events),
        g AS (SELECT model, t, d, sum(d) AS k FROM s GROUP BY ALL), o AS (SELECT model, sum(k) OVER (PARTITION BY model ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS open FROM g) SELECT model, greatest(max(open), 0)::BIGINT AS most FROM o GROUP BY model""",
    "failure_windows": "SELECT user_id::VARCHAR AS model, date_trunc('day', ts::TIMESTAMP)::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS failures FROM events GROUP BY ALL",
    "attempt_sessions": "WITH g AS (SELECT user_id::VARCHAR AS model, ts::TIMESTAMP AS tm, CASE WHEN epoch_us(ts::TIMESTAMP) - epoch_us(lag(ts::TIMESTAMP) OVER w) >= 21600000000 OR lag(ts::TIMESTAMP) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY model ORDER BY tm RANGE UNBOUNDED PRECEDING) AS k FROM g) SELECT model, min(tm) AS start, count(*) AS n FROM s GROUP BY model, k",
}
