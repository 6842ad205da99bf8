"""Messages of text services: their content in any shape, byte artefacts, digests, aliases of names."""

from __future__ import annotations

import hashlib
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The marks of a blank and a line break that only byte-level tokens have.
SENTINELS = ("Ġ", "Ċ")
# Other names of kinds of evidence.
KIND_ALIASES = {
    "authors": "author", "author_name": "author", "publication_year": "year", "paper_year": "year", "paper_title": "title",
    "article_title": "title", "journal_name": "journal", "retracted": "retraction", "source": "source_reference", "source_ref": "source_reference",
}


@cache
def byte_marks() -> dict[str, int]:
    """What byte each character of a byte-level vocabulary stands for: printable ones for themselves, the others in order from 256 on."""
    printable = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


def repaired(text: str) -> str:
    """A text of byte-level tokens as the text they stand for; one without their sentinels stays."""
    if not any(s in text for s in SENTINELS):
        return text
    table, out, held = byte_marks(), [], bytearray()
    for c in text:
        if c in table:
            held.append(table[c])
            continue
        out += [held.decode("utf-8", "replace"), c]
        held = bytearray()
    return "".join([*out, held.decode("utf-8", "replace")])


def _per_distinct(values: pd.Series, work) -> pd.Series:
    known = {v: work(v) for v in values.dropna().unique()}
    return pd.Series([known.get(v) for v in values], values.index, object)


@F.pandas_udf(T.StringType())
def _repaired(values: pd.Series) -> pd.Series:
    return _per_distinct(values, repaired)


def repair_byte_marks(text: Column) -> Column:
    """Undo byte-level stand-ins; only texts that have their sentinels leave the JVM."""
    odd = text.rlike("[" + "".join(SENTINELS) + "]")
    return F.when(odd, _repaired(F.when(odd, text))).otherwise(text)


def message_content(content: Column) -> Column:
    """The text of a message's content (JSON): a string, or a list of strings and of parts with a text; else empty."""
    doc = F.try_parse_json(content)
    kind = F.schema_of_variant(doc)
    text_of = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    parts = F.transform(F.try_variant_get(doc, "$", "array<variant>"), lambda x: F.coalesce(text_of(x), text_of(F.try_variant_get(x, "$.text", "variant")), F.lit("")))
    joined = F.when(kind == "STRING", F.try_variant_get(doc, "$", "string")).when(F.startswith(kind, F.lit("ARRAY")), F.array_join(parts, ""))
    return repair_byte_marks(F.coalesce(joined, F.lit("")))


def completion_text(record: Column, keys: tuple[str, ...] = ("response_text", "response", "completion", "text", "content")) -> Column:
    """The completion of a record (JSON): the first of ``keys`` that is there; empty where it is no string, null where none is there."""
    doc = F.try_parse_json(record)
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        value = F.try_variant_get(doc, f"$.{key}", "variant")
        text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).otherwise("")
        out = F.when(value.isNotNull(), text).otherwise(out)
    return out


def normal_text(text: str) -> str:
    """Compatibility form with straight apostrophes."""
    return unicodedata.normalize("NFKC", text).replace("’", "'")


@F.pandas_udf(T.StringType())
def _digest(values: pd.Series) -> pd.Series:
    return _per_distinct(values, lambda t: hashlib.sha256(normal_text(t).encode("utf-8", "surrogatepass")).hexdigest())


def normalised_digest(text: Column) -> Column:
    """SHA-256 of a text's normal form; plain ASCII is hashed in the JVM."""
    odd = text.rlike(r"[^\x00-\x7F]")
    return F.when(odd, _digest(F.when(odd, text))).otherwise(F.sha2(text, 256))


def evidence_kind(value: Column) -> Column:
    """A kind of evidence under its own name."""
    plain = F.regexp_replace(F.lower(F.trim(value)), "[- ]", "_")
    known = F.create_map(*[F.lit(x) for pair in KIND_ALIASES.items() for x in pair])
    return F.coalesce(known[plain], plain)


def locators(markdown: Column) -> Column:
    """The locators that a Markdown list names, one an item."""
    return F.regexp_extract_all(markdown, F.lit(r"(?m)^- (\S+)\s*$"), F.lit(1))


def level_keys(counts: Column) -> Column:
    """A map by level with keys fit for JSON (L1, L2, ...)."""
    return F.transform_keys(counts, lambda k, v: F.concat(F.lit("L"), k.cast("string")))


def votes_json(per_judge: Column) -> Column:
    """A map of votes as JSON, members in order."""
    entries = F.transform(F.array_sort(F.map_keys(per_judge)), lambda m: F.struct(m.alias("key"), per_judge[m].alias("value")))
    return F.to_json(F.map_from_entries(entries))


def votes_from_json(text: Column) -> Column:
    return F.from_json(text, "map<string,struct<label:string,confidence:string,error:string>>")
