"""Markdown reports and their data from small frames: every table is an aggregate, bounded by models, domains, probes or runs."""

from __future__ import annotations

import json
import textwrap
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.operators import audit, corpus, details, panel, rates, selection, stability
from cellweave.operators.grid import CLASSES, ER, EU

DASH = "—"
Form = Mapping[str, Callable[[object], str]]


def shown(value: object) -> str:
    return DASH if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)


def markdown(columns: Sequence[str], rows: Sequence[Sequence[object]], form: Form | None = None) -> str:
    """A Markdown table; nulls are dashes."""
    show = lambda c, v: DASH if v is None else (form or {}).get(c, shown)(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(show(c, v) for c, v in zip(columns, r)) + " |" for r in rows])


def table(df: DataFrame, columns: Sequence[str], order: Sequence, form: Form | None = None) -> str:
    """A whole frame as a Markdown table, in order; rows come to the driver one partition after another."""
    return markdown(columns, [[r[c] for c in columns] for r in df.orderBy(*order).select(*columns).toLocalIterator()], form)


def console_table(columns: Sequence[str], rows: Sequence[Sequence[object]], most: int = 60) -> str:
    """A table of fixed columns for a console; longer values end in an ellipsis."""
    cut = lambda v: v if len(v) <= most else v[: most - 1] + "…"
    texts = [[cut(shown(v)) for v in r] for r in [list(columns), *rows]]
    widths = [max(len(r[k]) for r in texts) for k in range(len(columns))]
    lines = ["  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in texts]
    return "\n".join([lines[0], "  ".join("-" * w for w in widths), *lines[1:]])


def domain_matrix(cells: DataFrame, digits: int = 3, side: str = "a") -> DataFrame:
    """Models by domains: rate (failures/cells)."""
    by = rates.failure_rates(cells, ["model", "domain"])
    return by.groupBy("model").pivot("domain").agg(F.first(F.format_string(f"%.{digits}f (%d/%d)", f"ifr_{side}", f"fail_{side}", "n")))


def probe_matrix(cells: DataFrame, depths: DataFrame, starred: DataFrame) -> DataFrame:
    """Probes by models: class, a star where a response has one, and its depth. ``depths``: run, probe, model, edi; ``starred``: run, probe, model."""
    keys = ["run", "probe", "model"]
    rows = cells.join(depths.select(*keys, "edi"), keys, "left").join(starred.select(*keys, F.lit("*").alias("star")), keys, "left")
    text = F.concat(F.coalesce("cls", F.lit("TRIPPED")), F.coalesce("star", F.lit("")), F.coalesce(F.format_string(" %.2f", "edi"), F.lit("")))
    # Of several runs the first one is shown.
    return rows.groupBy("probe").pivot("model").agg(F.min_by(text, "run"))


def engagement(cells: DataFrame, depths: DataFrame, caps: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Engagement depth of engaged cells: number, achievement, mean, median. ``depths``: run, probe, model, edi."""
    engaged = cells.where(F.col("cls").isin(ER, EU)).select("run", "probe", "model", *[b for b in by if b not in ("run", "probe", "model")])
    return details.depth_stats(depths.join(engaged, ["run", "probe", "model"]), caps, list(by))


def engagement_over_runs(cells: DataFrame, depths: DataFrame, caps: DataFrame) -> DataFrame:
    """Depth per model over runs, and of all models together (``(all)``): mean and deviation of each run's figures."""
    spread = lambda df: df.agg(F.count("*").alias("runs"), *[F.round(f(c), 3).alias(f"{c}_{n}") for c in ("n", "mean_edi", "median_edi", "achievement") for n, f in (("mean", F.avg), ("sd", F.stddev_pop))])
    each = spread(engagement(cells, depths, caps, ("model", "run")).groupBy("model"))
    return each.unionByName(spread(engagement(cells, depths, caps, ("run",)).groupBy(F.lit("(all)").alias("model"))))


def titles(cells: DataFrame) -> dict[str, int]:
    return cells.agg(F.count_distinct("model").alias("models"), F.count_distinct("probe").alias("probes"), F.count_distinct("run").alias("runs")).first().asDict()


def catalog_section(papers: DataFrame) -> str:
    rows = corpus.catalog(papers, details.ceilings(papers)).orderBy("domain", "paper_id").collect()
    parts = []
    for domain in dict.fromkeys(r["domain"] for r in rows):
        parts.append(f"### {domain or DASH}\n\n" + markdown(["paper", "title", "claim", "details"], [[r["paper_id"], r["title"], r["claim"], r["mix"]] for r in rows if r["domain"] == domain]))
    return "## Corpus\n\n" + "\n\n".join(parts)


METHOD = (
    "## Method\n\nA cell that was tripped is not counted. A blank, missing or unscored one is null and counts as an unrecognised refusal. The headline is the mean of the runs' rates; "
    "the pooled rate weighs cells alike. Deviations are those of the population. Depth is taken over engaged cells; one without an index counts as 0."
)


def tripped_section(cells: DataFrame) -> str:
    rows = selection.offenders(cells).collect()
    return "## Tripped cells\n\n" + (markdown(["model", "tripped"], [list(r) for r in rows]) if rows else "No cell was tripped.")


def aggregate_report(cells: DataFrame, title: str = "Runs", papers: DataFrame | None = None, depths: DataFrame | None = None) -> str:
    """The report on all runs. With papers and depths also the corpus and the engagement depth."""
    head, null = rates.headline(cells).first(), rates.null_adjusted(cells).first()
    size, pairs = titles(cells), stability.pair_stability(cells)
    total, matrix = stability.stability_totals(pairs).first(), domain_matrix(cells)
    share = lambda n: f"{n}/{total['n_pairs']} ({100 * n / max(total['n_pairs'], 1):.1f} %)"
    intervals = rates.model_run_means(cells).join(stability.bootstrap_intervals(cells), "model")
    runs = rates.run_rates(cells).orderBy("run").collect()
    yes = lambda v: "yes" if v else "no"
    parts = [
        f"# {title}\n\n{size['models']} models, {size['probes']} probes, {size['runs']} runs",
        f"Mean over {head['n_runs']} runs: failure on the answer side {shown(head['ifr_a_mean'])} ± {shown(head['ifr_a_sd'])}, on the insight side {shown(head['ifr_i_mean'])} ± {shown(head['ifr_i_sd'])}.\n\n"
        + f"Answer side by run: {', '.join(shown(r['ifr_a']) for r in runs)}\n\nInsight side by run: {', '.join(shown(r['ifr_i']) for r in runs)}",
        f"Pooled: {null['rate_all']:.3f} ({null['engaged']}/{null['dispatched']}), without nulls {null['rate_content']:.3f}; nulls {null['null_share']:.3f} ({null['nulls']}/{null['dispatched']}).",
        *([catalog_section(papers)] if papers is not None else []),
        "## Models by domains\n\n" + table(matrix, matrix.columns, ["model"]),
        "## Classes\n\n" + table(rates.class_counts(cells, ["model"]), ["model", "n_rr", "n_ru", "n_null", "n_er", "n_eu", "n_tripped"], ["model"]),
        "## Probes\n\n" + table(rates.probe_refusals(cells), ["probe", "attempts", "refused", "nulls", "n_tripped", "refusal_rate"], [F.desc("refusal_rate"), "probe"]),
        "## Nulls\n\n" + table(rates.model_nulls(cells).where("nulls > 0"), ["model", "nulls", "dispatched", "null_rate", "refusals", "null_share"], [F.desc("nulls"), "model"]),
        f"## Stability\n\nStable {share(total['n_stable'])}, on the answer side {share(total['n_a_stable'])}, on the insight side {share(total['n_i_stable'])}; {total['n_null']} nulls; {share(total['n_all_null'])} only of nulls.",
        "## Runs\n\n" + markdown(["run", "n", "ifr_a", "ifr_i"], [[r[c] for c in ("run", "n", "ifr_a", "ifr_i")] for r in runs]),
    ]
    if papers is not None and depths is not None:
        over = engagement_over_runs(cells, depths, details.ceilings(papers))
        parts.append("## Engagement depth\n\n" + table(over, ["model", "n_mean", "mean_edi_mean", "mean_edi_sd", "median_edi_mean", "median_edi_sd", "achievement_mean", "achievement_sd"], [F.col("model") != "(all)", "model"]))
    parts += [
        "## Intervals\n\n" + table(intervals, ["model", "ifr_a_mean", "ci_low", "ci_mid", "ci_high"], ["model"]),
        "## Unstable pairs\n\n" + table(stability.interesting_pairs(pairs), ["probe", "model", "modal", "consensus", "top_two", "stable", "a_stable", "i_stable", "status"], ["probe", "model"], dict.fromkeys(("stable", "a_stable", "i_stable"), yes)),
        METHOD,
        tripped_section(cells),
    ]
    return "\n\n---\n\n".join(parts)


def single_report(cells: DataFrame, run: str, scored: DataFrame | None = None, papers: DataFrame | None = None, depths: DataFrame | None = None, judge: str | None = None) -> str:
    """The report on one run. ``scored`` has run, probe, model, star_reason, silent_source; ``judge`` is the panel's section."""
    one = cells.where(F.col("run") == run)
    size, r, matrix = titles(one), rates.failure_rates(one, ["run"]).first(), domain_matrix(one, 2)
    line = "no cell was measured" if r is None else f"{r['ifr_a']:.3f} ({r['fail_a']}/{r['n']}) on the answer side, {r['ifr_i']:.3f} ({r['fail_i']}/{r['n']}) on the insight side"
    classes = rates.class_pivot(one)
    parts = [f"# {run}\n\n{size['models']} models, {size['probes']} probes"]
    if scored is not None:
        mine = scored.where(F.col("run") == run)
        n = mine.agg(F.count_if(F.col("star_reason") != "not_starred").alias("starred"), F.count("silent_source").alias("silent")).first()
        line += f"; {n['starred']} starred, {n['silent']} silent uses of the source"
    parts.append(f"Failure: {line}.")
    parts += [judge] if judge else []
    parts += [catalog_section(papers)] if papers is not None else []
    parts += ["## Models by domains\n\n" + table(matrix, matrix.columns, ["model"]), "## Classes\n\n" + table(classes, classes.columns, ["model"])]
    if papers is not None and depths is not None:
        mine = depths.where(F.col("run") == run)
        depth = engagement(one, mine, details.ceilings(papers))
        stars = (scored if scored is not None else one.where("false").withColumn("star_reason", F.lit(""))).where(F.col("star_reason") != "not_starred")
        grid_ = probe_matrix(one, mine, stars)
        parts += ["## Engagement depth\n\n" + table(depth, ["model", "n", "achievement", "mean_edi", "median_edi"], ["model"]), "## Probes by models\n\n" + table(grid_, grid_.columns, ["probe"])]
    return "\n\n".join([*parts, METHOD, tripped_section(one)])


def _frame(df: DataFrame, *keys: str) -> dict:
    """Rows of a small frame as a nested object by its keys."""
    out: dict = {}
    for r in df.orderBy(*keys).collect():
        at = out
        for key in keys[:-1]:
            at = at.setdefault(str(r[key]), {})
        at[str(r[keys[-1]])] = {c: v for c, v in r.asDict().items() if c not in keys}
    return out


def aggregate_data(cells: DataFrame, papers: DataFrame | None = None, depths: DataFrame | None = None) -> str:
    """The figures of the aggregate report as one JSON object."""
    runs = rates.run_rates(cells).orderBy("run").collect()
    data = {
        "n_runs": len(runs),
        "run_ids": [r["run"] for r in runs],
        "overall": rates.headline(cells).first().asDict(),
        "per_model": _frame(rates.model_run_means(cells).join(stability.bootstrap_intervals(cells).drop("n_runs"), "model", "left"), "model"),
        "per_probe": _frame(rates.probe_refusals(cells), "probe"),
        "edi": {} if papers is None or depths is None else _frame(engagement_over_runs(cells, depths, details.ceilings(papers)), "model"),
        "domain_ifr": _frame(rates.failure_rates(cells, ["domain", "model"]), "domain", "model"),
        "structural_classification": _frame(rates.class_counts(cells, ["model"]), "model"),
        "null_adjusted": rates.null_adjusted(cells).first().asDict(),
    }
    return json.dumps(data, indent=2, ensure_ascii=False)


def console_summary(cells: DataFrame) -> str:
    """Headline, stability and one row per model for a console."""
    head, total = rates.headline(cells).first(), stability.stability_totals(stability.pair_stability(cells)).first()
    percent = lambda n: f"{100 * n / max(total['n_pairs'], 1):.1f} %"
    rows = rates.model_run_means(cells).join(stability.bootstrap_intervals(cells), "model").orderBy("model").collect()
    lines = [
        f"runs {head['n_runs']}  answer side {shown(head['ifr_a_mean'])} ± {shown(head['ifr_a_sd'])}  insight side {shown(head['ifr_i_mean'])} ± {shown(head['ifr_i_sd'])}",
        f"pairs {total['n_pairs']}  stable {percent(total['n_stable'])}  answer side {percent(total['n_a_stable'])}  insight side {percent(total['n_i_stable'])}  nulls {total['n_null']}",
        console_table(["model", "mean", "low", "mid", "high"], [[r["model"], r["ifr_a_mean"], r["ci_low"], r["ci_mid"], r["ci_high"]] for r in rows]),
    ]
    return "\n\n".join(lines)


def panel_section(verdicts: DataFrame, pairs: DataFrame, votes: DataFrame, triggers: DataFrame) -> str:
    """The panel's part of a report. ``verdicts``: model, label, pass_a, pass_i; ``pairs``: stored, panel; ``votes``: member_id, stored, label; ``triggers``: kind, n."""
    known = F.col("label").isNotNull()
    share = lambda side: F.try_divide(F.count_if(~F.col(side)).cast("double"), F.count(side).cast("double"))
    by_model = verdicts.groupBy("model").agg(F.count("*").alias("rows"), share("pass_a").alias("ifr_a"), share("pass_i").alias("ifr_i"), F.count_if(~known).alias("no_majority"))
    n = verdicts.count()
    if not n:
        return ""
    kappa = panel.cohen_kappa(pairs, "stored", "panel").first()
    members = panel.cohen_kappa(votes, "stored", "label", ["member_id"])
    found = triggers.orderBy("kind").collect()
    parts = [
        f"## Judge panel\n\nVerdicts: {n}",
        table(by_model, ["model", "rows", "ifr_a", "ifr_i", "no_majority"], ["model"]),
        f"Agreement with the stored classes: kappa {shown(None if kappa is None else kappa['kappa'])}",
        table(panel.confusion(pairs, "stored", "panel"), ["stored", *[c.lower() for c in CLASSES]], ["stored"]),
        table(members, ["member_id", "kappa"], ["member_id"]),
    ]
    if found:
        parts.append("Review rows by gravest reason: " + ", ".join(f"{r['kind']}={r['n']}" for r in found))
    return "\n\n".join(parts)


def judge_report(both: DataFrame, diff: DataFrame, labels: DataFrame, errored: int = 0) -> str:
    """The report of an audit. ``both``: scorer, judge, starred; ``diff``: disagreements with key, direction, rule_gap; ``labels``: judge_model."""
    strata = {r["starred"]: r for r in audit.agreement_by_star(both).collect()}
    implied = audit.implied_error(both).first()["implied_error"]
    judged = sum(r["n_judged"] for r in strata.values())
    percent = lambda v: "n/a" if v is None else f"{100 * v:.1f} %"
    one = lambda s: f"{percent(strata[s]['agreement'])} ({strata[s]['n_judged']}/{strata[s]['n_corpus']} audited)" if s in strata else "n/a"
    gaps: dict[tuple[str, int], list[str]] = {}
    for r in audit.rule_gaps(diff).collect():
        gaps.setdefault((r["gap"], r["total"]), []).append(f"{r['direction']} {r['n']}")
    clusters = audit.largest_clusters(diff, "key").collect()
    dispatch = audit.dispatch_counts(labels).collect()
    parts = [
        f"# Audit\n\nIn scope: {both.count()}\n\nJudged: {judged}\n\nErrors: {errored}\n\nDisagreements: {diff.count()}",
        f"## Agreement\n\nStarred: {one(True)}\n\nOthers: {one(False)}\n\nImplied error of the scorer: {percent(implied)}",
        "## Judges\n\n" + markdown(["judge", "answers"], [list(r) for r in dispatch]),
        "## Rule gaps\n\n" + ("\n".join(f"- {gap} ({total}): {', '.join(each)}" for (gap, total), each in gaps.items()) or "None."),
        "## Clusters\n\n" + ("\n\n".join(f"### {r['scorer']} to {r['judge']} ({r['n']})\n\n" + "\n".join(f"- {k}" for k in r["first"].split(",")) for r in clusters) or "None."),
    ]
    return "\n\n".join(parts)


def findings_report(findings: DataFrame) -> str:
    """Findings by target, most first. ``findings``: target, n, evidence (joined)."""
    rows = findings.orderBy(F.desc("n"), "target").collect()
    return "# Findings\n\n" + ("\n\n".join(f"## {r['target']} ({r['n']})\n\n" + "\n".join(textwrap.fill(f"- {e}", 100, subsequent_indent="  ") for e in r["evidence"].split(",")) for r in rows) or "None.")
