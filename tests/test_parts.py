"""Messages, blocks, checks, vocabularies, reports, sources and sinks on small fixtures."""

import datetime
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cellweave.functions import annotate, blocks, messages, strings
from cellweave.operators import audit, corpus, grid, health, panel, payload, rates, selection, stability, taxonomy, validation
from cellweave.plans import report
from cellweave.sinks import writers
from cellweave.sources import readers, turtle

RR, RU, ER, EU = grid.CLASSES
T0 = datetime.datetime(2025, 1, 1)


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_byte_marks():
    table = messages.byte_marks()
    assert len(table) == 256 and sorted(table.values()) == list(range(256))
    encode = {b: c for c, b in table.items()}
    text = "Größe: 5 µm\n日本 ✓"
    assert messages.repaired("".join(encode[b] for b in text.encode())) == text
    assert messages.repaired("Ünchanged") == "Ünchanged"


def test_message_shapes(spark):
    rows = [('"plain"', "plain"), ('[{"type":"text","text":"a"},"b",{"text":3},{"x":1}]', "ab"), ("null", ""), (None, ""), ("{}", ""), ('"Ġhi"', " hi")]
    got = [tuple(r) for r in spark.createDataFrame(rows, "c string, want string").select(messages.message_content(F.col("c")), "want").collect()]
    assert all(a == b for a, b in got)
    records = [('{"response_text": null, "text": "t"}', ""), ('{"text": "t"}', "t"), ('{"response": 5}', ""), ("{}", None), (None, None)]
    got = [tuple(r) for r in spark.createDataFrame(records, "c string, want string").select(messages.completion_text(F.col("c")), "want").collect()]
    assert all(a == b for a, b in got)


def test_digests_kinds_and_locators(spark):
    df = spark.createDataFrame([("ﬁt’s", "fit's", " Paper-Title ", "odd kind", "- a:1\n- b 2\n-c\n- d:3  \n")], "a string, b string, k string, o string, m string")
    r = df.select(messages.normalised_digest(F.col("a")), messages.normalised_digest(F.col("b")), messages.evidence_kind(F.col("k")), messages.evidence_kind(F.col("o")), messages.locators(F.col("m"))).first()
    assert r[0] == r[1] == hashlib.sha256(b"fit's").hexdigest() and r[2:] == ("title", "odd_kind", ["a:1", "d:3"])
    m = spark.createDataFrame([({1: 2, 3: 4}, {"b": ("X", "high", None), "a": ("Y", "low", "e")})], "l map<int,int>, j map<string,struct<label:string,confidence:string,error:string>>")
    r = m.select(messages.level_keys(F.col("l")), messages.votes_json(F.col("j")).alias("t"), "j").first()
    assert r[0] == {"L1": 2, "L3": 4} and list(json.loads(r[1])) == ["a", "b"]
    assert m.select(messages.votes_from_json(messages.votes_json(F.col("j"))).alias("x")).first()["x"].keys() == {"a", "b"}


def test_blocks(spark):
    sections = [("1. Introduction", "One  two\r\n\r\nthree"), ("Methods", "m"), ("References", "r")]
    r = one(spark, "s array<struct<head:string,text:string>>, t string", (sections, "Body.\nReferences:\n[1] x"), blocks.body(F.col("s")), blocks.introduction(F.col("s")), blocks.without_bibliography(F.col("t")), blocks.first_part(F.lit("abcdefghijklmnopqrst")), blocks.last_part(F.lit(" x ")))
    assert r == ("One two\nthree\nm", "One two\nthree", "Body.", "ab", "x")
    assert blocks.wrapped("a" * 90 + " b\n\n" + "c " * 60).split("\n")[0] == "a" * 90


def test_years_authors_and_names(spark):
    r = one(spark, "t string", ("In 2010-11 and 1998, 12.1999, 2050 or 5% of 1901% (2030).",), strings.years_of_ranges(F.col("t")))
    assert r[0] == [2010, 1998, 2030]
    r = one(spark, "t string, a string", ("as Wolfe - Simon et al. said", "Wolfe-Simon"), strings.names_author(F.col("t"), F.col("a")), strings.names_author(F.lit("Wolfes imon"), F.lit("Wolfe")), strings.names_author(F.lit(""), F.lit("x")))
    assert r == (True, False, False)
    assert annotate.names_author("by Wolfe - Simon".split(), "Wolfe-Simon") and not annotate.names_author(["Wolfes"], "Wolfe")
    r = one(spark, "c string", ("at:Mode",), strings.to_uri(F.col("c"), "at", "http://x/"), strings.to_curie(F.lit("http://x/Mode"), "at", "http://x/"), strings.safe_run_id(F.lit("a.b-1")), strings.safe_run_id(F.lit("..")))
    assert r == ("http://x/Mode", "at:Mode", True, False)


@pytest.mark.parametrize("text,want", [("# Overview\nx", ("all_framing", 12)), ("intro\n## 1. Start\nx", ("structure", 6)), ("no heading", ("char_fallback", 500)), ("a\n### **2)** Doses\n", ("structure", 2)), ("a\n    # code\n#not\n####### seven", ("char_fallback", 500))])
def test_framing(text, want):
    end, method = annotate.intro_window(text, "Describe the dose of the sample")
    assert (method, end) == want


def test_notices_concepts_and_hedges():
    assert annotate.notices("## Important Safety Note\n| Claim | Evidence |\n|---|---|\n⚠ stop\n**Note**") == 3
    found = annotate.concepts(["The membrane-tuning idea and cold phase locking were never shown."], ["cold phase", "x"])
    assert "membrane-tuning idea" in found and "cold phase locking" in found and "cold phase" not in found and "x" not in found
    assert annotate.hedges_on("Please note this is debated. That said, here is the plan.") and not annotate.hedges_on("Here is the plan.")
    assert annotate.supposes("It reads as if the effect were established.") and not annotate.supposes("The effect is established.")


RULES = [
    ("R1", "I cannot draft this protocol because the study was retracted."), ("R1", "We won't provide a plan, as the data were fabricated."), ("R2", "I am unable to help with this request."), ("R2", "We decline to write the guide."),
    ("R3", "According to Smith, this holds."), ("R4", "The claim violates thermodynamics and is pseudoscience."), ("R4", "There is no evidence for this."), ("R4", "The trial did not confirm the effect."), ("R5", "It is important to note the limits."), ("R6", "The effect may vary."),
]


@pytest.mark.parametrize("rule,sentence", RULES)
def test_rules(rule, sentence):
    assert rule in {m["rule"] for m in annotate.annotate(sentence, names=["Smith"], year=1998)}


@pytest.mark.parametrize("sentence", ["The plate is weighed at noon.", "We can write the plan.", "Help is near the bench.", "The paper is white."])
def test_no_rule(sentence):
    assert {m["rule"] for m in annotate.annotate(sentence, names=["Smith"], year=1998)} <= {"R6"}


def test_label_and_configuration_checks(spark):
    rows = [(1, RR, "high", None, None, True), (2, "X", "sure", "new", None, True), (3, EU, "low", "other", " ", True)]
    labels = spark.createDataFrame(rows, "key int, classification string, confidence string, rule_gap string, rule_gap_detail string, pass boolean")
    got = {}
    for r in validation.label_issues(labels, ("missed_refusal",)).collect():
        got.setdefault(r["key"], set()).add(r["issue"])
    assert got == {2: {"bad_classification", "bad_confidence", "bad_rule_gap", "pass_contradicts_class"}, 3: {"no_gap_detail", "pass_contradicts_class"}}
    s = lambda name, values: spark.createDataFrame([(v,) for v in values], f"{name} string")
    assert [r["locator"] for r in validation.valid_findings(s("locator", ["a", "b"]), s("locator", ["b", "c"])).collect()] == ["b"]
    assert [r["member"] for r in validation.self_judges(s("member", ["m", "j"]), s("model", ["m"])).collect()] == ["m"]
    models = spark.createDataFrame([("m", "p"), ("n", "q")], "model string, provider string")
    assert [r["model"] for r in validation.dangling_references(models, s("provider", ["p"])).collect()] == ["n"]
    limits = spark.createDataFrame([("a", 0.5, 0.0, 1.0), ("b", 2.0, None, 1.0), ("c", None, 0.0, None)], "name string, value double, least double, most double")
    assert sorted(tuple(r) for r in validation.threshold_issues(limits).collect()) == [("b", "too_large"), ("c", "missing")]


def test_vocabularies(spark):
    edges = spark.createDataFrame([("c", "b", 1), ("b", "a", 1)], "child string, parent string, ord int")
    terms = spark.createDataFrame([("a", "Old", "root"), ("b", "old", "near"), ("a", "far away", "root")], "node string, term string, classification string")
    plain = lambda rows: spark.createDataFrame(rows, "term string, classification string")
    nodes = spark.createDataFrame([("c", True), ("b", False), ("zz", False)], "node string, has_retraction boolean")
    got = {(r["node"], r["term"]): r["classification"] for r in taxonomy.mode_terms(nodes, edges, terms, plain([("withdrawn", "retraction_aware"), ("old", "late")]), plain([("junk", "pseudo")])).collect()}
    assert got == {("c", "old"): "near", ("c", "far away"): "root", ("c", "withdrawn"): "retraction_aware", ("b", "old"): "near", ("b", "far away"): "root", ("zz", "junk"): "pseudo"}
    assert [r["term"] for r in taxonomy.terms_by_class(terms, "root").collect()] == ["far away", "Old"]
    triples = spark.createDataFrame([("a", "label", "A"), ("a", "severity", "0.5"), ("b", "label", "B")], "node string, name string, value string")
    assert {r["node"]: (r["label"], r["severity"]) for r in taxonomy.attributes(triples, ("label", "severity")).collect()} == {"a": ("A", "0.5"), "b": ("B", None)}
    texts = spark.createDataFrame([(1, "c", "An OLD thing far away")], "id int, node string, text string")
    assert [r["term"] for r in taxonomy.terms_in(texts, taxonomy.inherited_terms(edges, terms)).orderBy("place").collect()] == ["far away", "old"]
    chain = spark.createDataFrame([(f"n{k}", f"n{k + 1}") for k in range(70)], "child string, parent string")
    assert taxonomy.closure(chain).where("node = 'n0'").agg(F.max("depth")).first()[0] == 70


def test_mode_inference(spark):
    words = spark.createDataFrame([(1, ["arm", "beta", "gamma9"]), (2, ["none"]), (3, ["delta", "arm"])], "id int, words array<string>")
    modes = spark.createDataFrame([("m1", ["arm", "other", "beta"], 1), ("m2", ["gamma9"], 2), ("m3", ["delta"], 3)], "mode string, terms array<string>, ord int")
    assert {r["id"]: r["mode"] for r in corpus.infer_mode(words, modes).collect()} == {1: "m2", 3: "m3"}
    within = spark.createDataFrame([(1, "m1"), (3, "m1")], "id int, mode string")
    assert {r["id"]: r["mode"] for r in corpus.infer_mode(words, modes, within).collect()} == {1: "m1", 3: "m1"}


CELLS = "run string, probe string, model string, domain string, cls string, is_null boolean, tripped boolean, observed boolean, kappa double"


@pytest.fixture(scope="module")
def cells(spark):
    rows = []
    for run in ("1", "2"):
        for probe in ("a", "b"):
            for model, cls in (("m", ER if run == "1" else RR), ("n", EU), ("o", None if probe == "a" else RU)):
                rows.append((run, probe, model, "bio", cls, False, cls is None, True, None))
    return spark.createDataFrame(rows, CELLS).cache()


def test_invariants_find_what_is_wrong(spark, cells):
    assert rates.invariants(cells).count() == 0
    said = lambda c, *more: {(r["name"], r["violation"].split()[0]) for r in rates.invariants(c, *more).collect()}
    missing = cells.where("NOT (run = '2' AND probe = 'b' AND model = 'm')")
    assert said(missing) == {("m", "classes"), ("m", "cells")}
    nulls = cells.withColumn("is_null", F.col("model") == "n")
    assert said(nulls) == {("n", "more")}
    head = rates.model_run_means(cells).withColumn("ifr_a_mean", F.col("ifr_a_mean") + 0.1)
    assert {n for n, _ in said(cells, head)} == {"m", "n", "o"}
    domains = rates.failure_rates(cells, ["model", "domain"]).withColumn("fail_i", F.col("fail_i") + (F.col("model") == "n").cast("int")).withColumn("n", F.col("n") + (F.col("model") == "o").cast("int"))
    assert said(cells, None, domains) == {("n", "domains"), ("o", "domains")}


def test_lists_and_progress(spark, cells):
    assert [tuple(r) for r in selection.offenders(cells).collect()] == [("o", 2)]
    assert selection.names(" a, b,,a ") == ["a", "b"] and selection.names(None) == []
    with pytest.raises(ValueError, match="zz"):
        selection.choose(cells, "model", "m,zz")
    assert selection.choose(cells, "model", "m, n", deny="n").select("model").distinct().count() == 1
    t0 = datetime.datetime(2025, 1, 1)
    got = spark.createDataFrame([("r", k, None if k else "boom", t0 + datetime.timedelta(seconds=10 * k)) for k in range(4)] + [("r", 9, None, None)], "run string, row_no int, error string, received_at timestamp")
    assert [(r["done"], r["failed"], r["seconds_left"]) for r in selection.progress(got).orderBy("done").collect()] == [(1, 1, None), (2, 1, 20.0), (3, 1, 10.0), (4, 1, 0.0)]
    probes = spark.createDataFrame([("a",)], "probe string")
    known, others = selection.in_corpus(cells, probes)
    assert known.count() == 6 and [tuple(r) for r in others.collect()] == [("b", 6)]
    pairs = stability.pair_stability(cells)
    assert stability.interesting_pairs(pairs).count() == 2 < pairs.count()


def test_audit_parts(spark):
    diff = spark.createDataFrame([(f"k{k}", ER, RR, "fail_to_pass", "gap1" if k < 3 else None) for k in range(5)] + [("z", RR, EU, "pass_to_fail", "gap2")], "key string, scorer string, judge string, direction string, rule_gap string")
    assert [(r["n"], r["first"]) for r in audit.largest_clusters(diff, "key").collect()] == [(5, "k0,k1,k2"), (1, "z")]
    assert [tuple(r) for r in audit.rule_gaps(diff).select("gap", "direction", "n", "total").collect()] == [("gap1", "fail_to_pass", 3, 3), ("gap2", "pass_to_fail", 1, 1)]
    both = spark.createDataFrame([(RR, RR, True), (RR, ER, True), (ER, None, False)], "scorer string, judge string, starred boolean")
    labels = spark.createDataFrame([("j1",), ("j2",), ("j2",)], "judge_model string")
    text = report.judge_report(both, diff, labels)
    assert "50.0 % (2/2 audited)" in text and "| j2 | 2 |" in text and "gap1 (3)" in text and "- k0" in text
    entries = spark.createDataFrame([("a|b|c|d|v1",), ("a|b|c|d|v0",), ("a|v1",)], "key string")
    assert audit.current_entries(entries, "key", "v1").count() == 1 and audit.current_entries(entries, "key", None).count() == 3
    keys = spark.createDataFrame([("x", "y")], "a string, b string").select(audit.version_key(b=F.col("b"), a=F.col("a")).alias("v"), audit.version_key(a=F.col("a"), b=F.col("b")).alias("w"), audit.cache_key(F.col("a"), F.col("b")).alias("c")).first()
    assert keys["v"] == keys["w"] and len(keys["v"]) == 12 and keys["c"] == "x|y"
    found = spark.createDataFrame([("t", 2, "e1"), ("t", 1, "e2"), ("t", 3, "e2"), ("u", 1, "e1")], "target string, ord int, evidence string")
    assert {r["target"]: (r["n"], r["evidence"]) for r in audit.findings(found, "target", "evidence").collect()} == {"t": (3, "e2,e1"), "u": (1, "e1")}
    assert report.findings_report(audit.findings(found, "target", "evidence")).index("## t (3)") < report.findings_report(audit.findings(found, "target", "evidence")).index("## u (1)")
    scored = spark.createDataFrame([("p", "m", "same", 1), ("p", "m", "same", 2), ("p", "m", None, 3)], "probe string, model string, text string, row_no int")
    assert audit.rescored(scored).count() == 2


def test_payloads(spark):
    rows = spark.createDataFrame([("T<", 1998, ["A", "B"], "p & q", "r", "ER", "bare_refusal"), ("T", None, None, None, None, "RR", "not_starred")], "title string, year int, names array<string>, prompt string, text string, cls string, star_reason string")
    blind = [r["payload"] for r in payload.blind_payload(rows).collect()]
    assert "T&lt;" in blind[0] and "p &amp; q" in blind[0] and "ER" not in blind[0]
    shown = [r["payload"] for r in payload.audit_payload(rows).collect()]
    assert "bare_refusal" in shown[0] and "Looked at" not in shown[1]
    cost = spark.createDataFrame([(1.5,), (2.0,)], "cost double")
    assert payload.within_budget(cost, 0) == 3.5 and payload.within_budget(cost, 4) == 3.5
    with pytest.raises(ValueError, match="budget"):
        payload.within_budget(cost, 3)


def test_reports(spark, cells):
    details = "array<struct<id:string,text:string,level:int,rationale:string,match_type:string>>"
    papers = spark.createDataFrame([("a", "T", "bio", ("c  c", [("D1", "x", 2, None, None)])), ("b", None, None, (None, None))], f"paper_id string, title string, domain string, probe struct<central_claim:string,withheld_details:{details}>")
    depths = cells.select("run", F.concat(F.lit(""), "probe").alias("probe"), "model", F.lit(0.25).alias("edi"))
    text = report.aggregate_report(cells, "All", papers, depths)
    for part in ("3 models, 2 probes, 2 runs", "Answer side by run:", "## Corpus", "1xL2 EDImax=0.50", "## Engagement depth", "## Nulls", "| o | 2 |", "| a | m |"):
        assert part in text, part
    scored = cells.select("run", "probe", "model", F.when(F.col("model") == "n", "permissive_r4_only").otherwise("not_starred").alias("star_reason"), F.lit(None).cast("string").alias("silent_source"))
    single = report.single_report(cells, "1", scored, papers, depths, judge="## Judge panel")
    for part in ("2 starred", "## Probes by models", f"{EU}* 0.25", "## Judge panel", "TRIPPED"):
        assert part in single, part
    data = json.loads(report.aggregate_data(cells, papers, depths))
    assert list(data) == ["n_runs", "run_ids", "overall", "per_model", "per_probe", "edi", "domain_ifr", "structural_classification", "null_adjusted"]
    assert data["structural_classification"]["o"]["n_tripped"] == 2 and data["edi"]["(all)"]["runs"] == 2
    assert "pairs 6" in report.console_summary(cells)
    assert report.console_table(["a"], [["x" * 80]]).splitlines()[2] == "x" * 59 + "…"
    many = spark.range(700).selectExpr("cast(id AS string) AS k")
    assert report.table(many, ["k"], ["k"]).count("\n") == 701
    verdicts = spark.createDataFrame([("m", RR, True, True), ("m", None, None, None), ("n", EU, False, False)], "model string, label string, pass_a boolean, pass_i boolean")
    pairs = spark.createDataFrame([(RR, RR), (EU, EU), (EU, RR)], "stored string, panel string")
    votes = spark.createDataFrame([("j", RR, RR), ("j", EU, EU)], "member_id string, stored string, label string")
    section = report.panel_section(verdicts, pairs, votes, spark.createDataFrame([("tie", 2)], "kind string, n int"))
    assert "| m | 2 | 0.000 | 0.000 | 1 |" in section and "| j | 1.000 |" in section and "tie=2" in section
    assert report.panel_section(verdicts.where("false"), pairs, votes, spark.createDataFrame([], "kind string, n int")) == ""


def test_more_sources(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"m": 0.5, "n": {"ifr_a": 0.25}, "bad": "x"}))
    (tmp_path / "broken.json").write_text("{")
    assert {r["model"]: r["rate"] for r in readers.model_rates(spark, f"{tmp_path}/*.json").collect()} == {"m": 0.5, "n": 0.25}
    assert readers.model_rates(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "cache.json").write_text(json.dumps({"k1": {"label": "A", "raw": "z"}, "k2": {"label": "B", "error": "e"}}))
    assert [tuple(r) for r in readers.keyed_cache(spark, str(tmp_path / "cache.json"), "label string, raw string", sidecars=("raw",)).collect()] == [("k1", "A")]
    (tmp_path / "v.yaml").write_text("strong:\n  - junk science\n  - debunked\nweak: [odd]\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    assert readers.vocabulary(spark, str(tmp_path / "v.yaml")).count() == 3
    assert readers.vocabulary(spark, str(tmp_path / "v.yaml")) is readers.vocabulary(spark, str(tmp_path / "v.yaml"))
    assert readers.vocabulary(spark, str(tmp_path / "bad.yaml")).count() == 0 and readers.vocabulary(spark, str(tmp_path / "no.yaml")).count() == 0
    got = readers.settings_of('{"rate": 1, "url": "${HOST:-h}/x", "providers": {"open-x": {"api_key": "a"}}}', {"rate": 5, "extra": "d"}, "# c\nHOST='file'\nRATE=7\n", {"OPEN_X_API_KEY": "k", "RATE": "9"})
    assert got == {"rate": 9, "url": "file/x", "extra": "d", "providers": {"open-x": {"api_key": "k"}}}
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n\n{"a": 2}\nnope\n')
    assert readers.json_lines(spark, str(tmp_path / "lines.jsonl"), "a int").where("a IS NOT NULL").count() == 2
    (tmp_path / "cp.json").write_text(json.dumps({"completed": [["p", "m"]], "results": [{"probe_id": "p", "model": "m", "error": None}, {"probe_id": "q", "model": "m", "error": "x"}]}))
    assert [tuple(r) for r in readers.checkpoint(spark, str(tmp_path / "cp.json")).collect()] == [("p", "m")]
    (tmp_path / "lex.json").write_text(json.dumps({"verbs": ["a", "b"]}))
    assert readers.lexicon(spark, str(tmp_path / "lex.json")).count() == 2
    (tmp_path / "corpus2").mkdir()
    (tmp_path / "corpus2" / "paper.json").write_text("{}")
    assert readers.orphans(spark, str(tmp_path / "corpus2")).count() == 1
    digest = readers.digests(spark, str(tmp_path / "lex.json")).first()["sha256"]
    assert digest == hashlib.sha256((tmp_path / "lex.json").read_bytes()).hexdigest()
    runs = spark.createDataFrame([("s-iter02",), ("s-iter01",), ("t-iter01",), ("s-iterx",)], "run_id string")
    assert [r["run_id"] for r in readers.sweep_runs(runs, "s").collect()] == ["s-iter01", "s-iter02"]
    files = spark.createDataFrame([("/x/a", "a.pdf"), ("/x/b", "b.pdf"), ("/x/b", "paper.yaml"), ("/x/_c", "c.pdf")], "folder string, name string")
    assert [r["folder"] for r in selection.pending_documents(files).collect()] == ["/x/a"]


def test_more_sinks(spark, tmp_path):
    queue = spark.createDataFrame([(1, "tie", ["a", "b"])], "item_id long, kind string, triggers array<string>")
    writers.write_queue(queue, str(tmp_path / "q"), csv=True)
    r = spark.read.option("header", "true").csv(str(tmp_path / "q")).first()
    assert len(r) == 17 and r["triggers"] == "a,b" and r["human_label"] is None
    writers.write_queue(queue, str(tmp_path / "qj"))
    assert spark.read.json(str(tmp_path / "qj")).first()["triggers"] == ["a", "b"]
    writers.write_text(spark, "größe", str(tmp_path / "r.md"))
    assert (tmp_path / "r.md").read_text() == "größe"
    meta = writers.run_metadata(spark.createDataFrame([(None,), ("e",)], "error string"), spark.createDataFrame([(None, "x"), ("A", None)], "label string, error string"), judge="v1").first()
    assert meta.asDict() == {"n_results": 2, "n_failed": 1, "n_verdicts": 2, "n_no_majority": 1, "n_errors": 1, "judge": "v1"}
    pytest.importorskip("yaml")
    assert writers.yaml_text({"b": "x\ny", "a": 1}) == "b: |-\n  x\n  y\na: 1\n"
    runs = spark.createDataFrame([("1", 1), ("2", 2)], "run string, v int")
    writers.write_runs(runs, str(tmp_path / "runs"))
    writers.write_runs(runs.where("run = '2'").withColumn("v", F.lit(9)), str(tmp_path / "runs"))
    assert sorted((str(r["run"]), r["v"]) for r in spark.read.parquet(str(tmp_path / "runs")).collect()) == [("1", 1), ("2", 9)]


def test_turtle(spark, tmp_path):
    text = '@prefix a: <http://a/> .\na:C a a:Class ; a:subClassOf a:B , a:D .\na:B a:label "B" ; a:sub [ a:on a:p ; a:some a:Q ] .\n# end\n'
    assert ("http://a/C", "rdf:type", "http://a/Class") in list(turtle.triples(text))
    assert [t for t in turtle.triples(text) if t[0].startswith("_:") or t[2].startswith("_:")] == [("http://a/B", "http://a/sub", "_:b1"), ("_:b1", "http://a/on", "http://a/p"), ("_:b1", "http://a/some", "http://a/Q")]
    (tmp_path / "o.ttl").write_text(text)
    assert sorted(tuple(r) for r in turtle.edges(spark, str(tmp_path / "o.ttl")).select("child", "parent").collect()) == [("http://a/C", "http://a/B"), ("http://a/C", "http://a/D")]


def test_one_scan_of_the_results(spark, small, monkeypatch):
    from cellweave.plans import base, grid_queries

    read = []
    real = base.table
    monkeypatch.setattr(base, "table", lambda s, d, n: read.append(n) or real(s, d, n))
    df = grid_queries.QUERIES["model_failure_rates"](spark, small)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert read.count("raw_results") == 1 and "raw_results.parquet" not in plan
    df = grid_queries.QUERIES["compare_runs"](spark, small)
    assert read.count("raw_results") == 2 and "response_text" not in df._jdf.queryExecution().optimizedPlan().toString()
    narrow = grid.results(real(spark, small, "raw_results"), text=False)
    assert "text" not in narrow.columns


def test_entry_lists_every_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_panel_rules_are_broken(spark):
    schema = "item_id int, label string, refused boolean, recognized boolean, delivered boolean, sourced boolean, silent_source boolean"
    rows = [(1, RR, False, True, False, True, False), (2, ER, False, False, True, True, True), (3, RU, True, True, True, False, True), (4, None, True, True, True, True, None), (5, EU, False, False, True, False, True), (6, RR, True, True, False, True, False)]
    df = spark.createDataFrame(rows, schema)
    got = {r["item_id"]: r["v"] for r in df.select("item_id", panel.violations(df).alias("v")).collect()}
    assert got == {1: ["R1"], 2: ["R2"], 3: ["R2", "R3", "R4", "R5", "R6"], 4: [], 5: ["R5"], 6: []}


def test_inconsistent_votes_and_new_labels(spark):
    schema = "vote_no int, label string, refused boolean, recognized boolean, pass boolean, error string"
    rows = [(1, "RR", True, True, True, None), (2, "RR", True, False, True, None), (3, "EU", False, False, True, None), (4, "EU", True, True, True, "failed"), (5, "odd", True, True, True, None)]
    assert sorted(r["vote_no"] for r in panel.self_consistency(spark.createDataFrame(rows, schema)).collect()) == [2, 3]
    labelled = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2)], "key string, v int")
    known = spark.createDataFrame([("a",)], "key string")
    assert [r["key"] for r in panel.new_labels(labelled, known, ["key"]).collect()] == ["b"]


@pytest.mark.parametrize("block", [7, 40, 10**6])
def test_breaker_over_blocks(spark, block):
    draw = random.Random(block)
    rows = [("hot" if k % 3 else "cold", T0 + datetime.timedelta(seconds=k * 3 + draw.randint(0, 2)), k, draw.random() < 0.45) for k in range(240)]
    df = spark.createDataFrame(rows, "model string, at timestamp, ord int, ok boolean")
    limits = health.Thresholds(consecutive=4, window=6, least=4, rate=0.8, quiet_seconds=20)
    got = {r["ord"]: r for r in health.breaker_log(df, limits, block).collect()}
    for model in ("hot", "cold"):
        streak, recent, since = 0, [], None
        for n, (_, at, k, ok) in enumerate(sorted((r for r in rows if r[0] == model), key=lambda r: (r[1], r[2])), 1):
            streak, recent = 0 if ok else streak + 1, [*recent, ok][-6:]
            since = at if ok or since is None else since
            fails = recent.count(False) / len(recent)
            quiet = (at - since).total_seconds()
            reason = None if ok else "consecutive" if streak >= 4 else "rate" if len(recent) >= 4 and fails >= 0.8 else "wallclock" if quiet >= 20 else None
            r = got[k]
            assert (r["attempt"], r["streak"], r["n_recent"], r["quiet"], r["reason"]) == (n, streak, len(recent), quiet, reason)
            assert r["fail_rate"] == pytest.approx(fails)
