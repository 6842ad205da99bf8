"""Reading run artefacts and corpora into typed DataFrames.

Strict readers fail on a missing or malformed file; tolerant ones give no rows.
"""

from __future__ import annotations

import json
import os
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.session import path_exists

RAW_RESULT = "run_id string, probe_id string, paper_id string, model string, response_text string, latency_ms double, prompt_tokens int, completion_tokens int, finish_reason string, timestamp string, error string, domain string"
SCORE = "struct<classification:string,refused:boolean,recognized:boolean,starred:boolean,null_content_kind:string,edi:double,sanewashing:boolean,reproductions:map<string,double>>"
PAPER = """paper_id string, doi string, title string, authors array<string>, journal string, year int, pdf_sha256 string,
  atlas struct<primary_unreliability_mode:string,secondary_unreliability_modes:array<string>,claimed_domain:string,detection_markers:array<string>,default_severity:double,
    retraction:struct<date:string,reason:string,notice_doi:string,severity:string,associated_persons:array<struct<name:string,legal_consequences:string>>>>,
  probe struct<claim_type:string,central_claim:string,preamble:string,operational_request:string,withheld_details:array<struct<id:string,text:string,level:int,rationale:string,match_type:string>>>,
  annotation struct<annotator:string,reviewer:string,review_status:string,date_annotated:string,date_reviewed:string,notes:string>"""


def raw_results(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Result arrays (JSON). ``ord`` is a record's place in its file, by which the last of repeated keys is told; ``has_text`` tells a null text from none."""
    if tolerant and not path_exists(spark, path):
        return spark.createDataFrame([], f"{RAW_RESULT}, source string, ord int, has_text boolean")
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), "value")
    if tolerant:
        docs = whole.select("source", F.try_parse_json("value").alias("doc")).where("doc IS NOT NULL")
    else:
        docs = whole.select("source", F.parse_json("value").alias("doc"))
    each = docs.lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select("source", F.col("pos").alias("ord"), "value")
    rows = each.select("source", "ord", F.from_json(F.to_json("value"), RAW_RESULT).alias("r"), F.schema_of_variant("value").rlike(r"[<, ]response_text:").alias("has_text"))
    return rows.select("r.*", "source", "ord", "has_text")


def nested_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score files: probe to model to score. A missing file is an error."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.from_json("value", f"map<string,map<string,{SCORE}>>").alias("m"))
    probes = whole.select("source", F.explode("m").alias("probe", "models"))
    return probes.select("source", "probe", F.explode("models").alias("model", "score")).select("source", "probe", "model", "score.*")


def model_rates(spark: SparkSession, path: str) -> DataFrame:
    """(source, model, rate) of files that map models to rates; missing and malformed ones give nothing."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "source string, model string, rate double")
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.try_parse_json("value").alias("doc"))
    each = whole.where(F.startswith(F.schema_of_variant("doc"), F.lit("OBJECT"))).lateralJoin(spark.tvf.variant_explode(F.col("doc").outer()))
    rate = F.coalesce(F.try_variant_get("value", "$", "double"), F.try_variant_get("value", "$.ifr_a", "double"))
    return each.select("source", F.col("key").alias("model"), rate.alias("rate")).where("rate IS NOT NULL")


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """One JSON object a line; blank lines are skipped; bad lines fail (strict) or are dropped."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """(probe, model) pairs of a checkpoint whose result has no error."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", f"completed array<array<string>>, results array<struct<{_struct(RAW_RESULT)}>>").alias("c"))
    rows = whole.select(F.explode("c.results").alias("r")).select("r.*")
    return rows.where(F.coalesce("error", F.lit("")) == "").select("probe_id", "model")


def _struct(ddl: str) -> str:
    return ",".join(part.strip().replace(" ", ":", 1) for part in ddl.split(","))


def keyed_cache(spark: SparkSession, path: str, verdict: str, sidecars: tuple[str, ...] = ()) -> DataFrame:
    """(key, verdict) of a cache file (a JSON object by key); entries with an error are dropped, a malformed file is empty.

    ``sidecars`` are fields of ``verdict`` that only accompany it and are left out.
    """
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    each = whole.where("doc IS NOT NULL").lateralJoin(spark.tvf.variant_explode(F.col("doc").outer())).select("key", "value")
    rows = each.select("key", F.from_json(F.to_json("value"), f"error string, {verdict}").alias("v"))
    return rows.where("v.error IS NULL").select("key", "v.*").drop("error", *sidecars)


def corpus(spark: SparkSession, root: str) -> DataFrame:
    """Paper records below ``root``/<family>/<paper>/paper.{json,yaml}; families that start with an underscore are skipped.

    The family is the domain. YAML needs the yaml package on the executors; JSON is read by Spark alone. Any bad file fails the read.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "paper.{json,yaml,yml}").load(root)
    parts = F.split("path", "/")
    family, folder = F.element_at(parts, -3), F.element_at(parts, -2)
    placed = files.select("path", family.alias("domain"), folder.alias("folder"), F.decode("content", "utf-8").alias("text")).where(~F.startswith("domain", F.lit("_")))
    plain = placed.mapInPandas(_to_json, "path string, domain string, folder string, text string")
    rows = plain.select("path", "domain", "folder", F.from_json("text", PAPER, {"mode": "FAILFAST"}).alias("p"))
    return rows.select("p.*", "domain", (F.col("p.paper_id") == F.col("folder")).alias("id_matches_folder"))


def _to_json(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf = pdf.copy()
        pdf["text"] = [t if p.endswith(".json") else _yaml_to_json(t) for p, t in zip(pdf.path, pdf.text)]
        yield pdf


def _yaml_to_json(text: str) -> str:
    import yaml

    return json.dumps(yaml.safe_load(text), default=str)


def orphans(spark: SparkSession, root: str) -> DataFrame:
    """Record files that lie directly below ``root``, outside any family."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "paper.*").load(root).select("path")


def lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, term) of a JSON object of lists."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    return whole.select(F.explode("m").alias("set_name", "terms")).select("set_name", F.explode("terms").alias("term"))


_vocabularies: dict[tuple[str, str], DataFrame] = {}


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(term, classification) of a vocabulary (YAML or JSON: a map of classes to terms, or a list of entries); none where it is missing or malformed.

    Read once per application and path.
    """
    key = spark.sparkContext.applicationId, path
    if key not in _vocabularies:
        rows = [] if not path_exists(spark, path) else [t for r in spark.read.text(path, wholetext=True).toLocalIterator() for t in _terms(r["value"])]
        _vocabularies[key] = spark.createDataFrame(rows, "term string, classification string")
    return _vocabularies[key]


def _terms(text: str) -> list[tuple[str, str | None]]:
    try:
        doc = json.loads(text) if text.lstrip()[:1] in ("{", "[") else json.loads(_yaml_to_json(text))
    except Exception:  # no vocabulary at all rather than half of one
        return []
    if isinstance(doc, dict) and set(doc) == {"terms"}:
        doc = doc["terms"]
    if isinstance(doc, dict):
        return [(str(t), str(c)) for c, terms in doc.items() for t in (terms or [])]
    if isinstance(doc, list):
        return [(str(e.get("term")), e.get("classification")) if isinstance(e, dict) else (str(e), None) for e in doc]
    return []


def _sections(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, content in zip(pdf.path, pdf.content):
            rows += [(path, n, head, text) for n, (head, text) in enumerate(tei_sections(bytes(content)))]
        yield pd.DataFrame(rows, columns=["path", "ord", "head", "text"])


def tei_sections(content: bytes) -> list[tuple[str, str]]:
    """(head, text) of every body section with a head; bibliography references are left out of paragraphs."""
    local = lambda e: e.tag.rsplit("}", 1)[-1]

    def plain(e: ET.Element) -> str:
        skip = local(e) == "ref" and e.get("type") == "bibr"
        inner = "" if skip else (e.text or "") + "".join(plain(c) for c in e)
        return inner + (e.tail or "")

    out = []
    for body in (e for e in ET.fromstring(content).iter() if local(e) == "body"):
        for div in (e for e in body.iter() if local(e) == "div"):
            head = next((c for c in div if local(c) == "head"), None)
            if head is None or not "".join(head.itertext()).strip():
                continue
            paragraphs = []
            for p in (c for c in div if local(c) == "p"):
                text = (p.text or "") + "".join(plain(c) for c in p)
                paragraphs.append(re.sub(r"\s+", " ", text).strip())
            out.append(("".join(head.itertext()).strip(), "\n\n".join(x for x in paragraphs if x)))
    return out


def sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, head, text) of the sections of TEI files."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_sections, "path string, ord int, head string, text string")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def substitute(value: object, environment: Mapping[str, str] | None = None) -> object:
    """Configuration values with ``${NAME}`` or ``${NAME:-default}`` filled in; an unknown name without default is an error."""
    env = os.environ if environment is None else environment

    def fill(m: re.Match) -> str:
        if m[1] in env:
            return env[m[1]]
        if m[2] is not None:
            return m[2]
        raise KeyError(f"no value for {m[1]}")

    if isinstance(value, str):
        return VARIABLE.sub(fill, value)
    if isinstance(value, dict):
        return {k: substitute(v, env) for k, v in value.items()}
    if isinstance(value, list):
        return [substitute(v, env) for v in value]
    return value


def environment_file(text: str) -> dict[str, str]:
    """Names and values of a file of assignments; comments and lines without one are skipped, quotes around a value are taken off."""
    out = {}
    for line in text.splitlines():
        name, equals, value = line.strip().removeprefix("export ").partition("=")
        if equals and name and not name.startswith("#"):
            value = value.strip()
            out[name.strip()] = value[1:-1] if len(value) > 1 and value[0] == value[-1] in "\"'" else value
    return out


def settings_of(text: str, defaults: Mapping[str, object], env_file: str = "", environment: Mapping[str, str] | None = None, prefix: str = "") -> dict:
    """A configuration (YAML or JSON): the shell's value of a name holds before that of the environment file, before the
    configuration's (with variables filled in), before the default. A provider's key may be set as <PROVIDER>_API_KEY."""
    shell = dict(os.environ if environment is None else environment)
    env = environment_file(env_file) | shell
    doc = json.loads(text) if text.lstrip()[:1] == "{" else json.loads(_yaml_to_json(text) if text.strip() else "{}")
    out = dict(defaults) | substitute(doc or {}, env)
    for name, value in list(out.items()):
        if (given := env.get(f"{prefix}{name}".upper())) is not None and not isinstance(value, (dict, list)):
            out[name] = type(value)(given) if isinstance(value, (int, float)) and not isinstance(value, bool) else given
    for provider, entry in (out.get("providers") or {}).items():
        if isinstance(entry, dict) and (given := env.get(f"{provider}_API_KEY".upper().replace("-", "_"))) is not None:
            entry["api_key"] = given
    return out


def sweep_runs(results: DataFrame, sweep: str) -> DataFrame:
    """Runs ``<sweep>-iterNN`` in lexical order."""
    return results.select("run_id").distinct().where(F.col("run_id").rlike(rf"^\Q{sweep}\E-iter\d+$")).orderBy("run_id")
