"""Text functions as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.operators.details import NUMBERS

# Words of a short text that declines.
SHORT_REFUSALS = ("i can't", "i cannot", "i won't", "unable to", "i'm sorry", "i decline")


def match_text(text: Column) -> Column:
    """Lower-case letters and digits with single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def concept(text: Column) -> Column:
    """A concept's spelling: no outer punctuation, single spaces, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""), r"\s+", " ")))


def contained_in_longer(concepts: Column) -> Column:
    """Concepts without those that are part of a longer one."""
    return F.filter(concepts, lambda x: ~F.exists(concepts, lambda y: F.contains(y, x) & (F.length(y) > F.length(x))))


def excerpt(text: Column, n: int = 800) -> Column:
    return F.substring(text, 1, n)


def years(text: Column) -> Column:
    """Publication years named in a text, in order, joined."""
    return F.array_join(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(1[89]\d\d|20[0-2]\d|2030)\b"), F.lit(1))), ",")


def count_headers(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?md)^ {0,3}#{1,6}[ \t]+\S"))


def short_refusal(text: Column, limit: int = 100) -> Column:
    """Whether a text below ``limit`` characters has the wording of a refusal."""
    low = F.lower(F.replace(text, F.lit("’"), F.lit("'")))
    said = F.lit(False)
    for phrase in SHORT_REFUSALS:
        said = said | F.contains(low, F.lit(phrase))
    return (F.length(text) < limit) & said


def list_items(text: Column) -> Column:
    """A comma list's items, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, ","), lambda i: F.trim(i)), lambda i: i != "")


def digits(text: Column) -> Column:
    """Number words as digits (whole words, any case becomes lower)."""
    out = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    for value, word in enumerate(NUMBERS):
        out = F.regexp_replace(out, rf"(?<=\s){word}(?=\s)", str(value))
    return F.trim(out)


def json_object(text: Column) -> Column:
    """The JSON object in a free text: the whole of it, else from its first to its last brace; null where there is none."""
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))))


def verbatim(quotes: Column, text: Column) -> Column:
    """Quotes that stand in the text as written."""
    return F.filter(quotes, lambda q: (q != "") & F.contains(text, q))


def edges_of(text: Column, share: float = 0.1) -> Column:
    """First and last tenth of a text."""
    n = F.floor(F.length(text) * F.lit(share)).cast("int")
    return F.struct(F.substring(text, F.lit(1), n).alias("head"), F.right(text, n).alias("tail"))


def safe_run_id(value: Column) -> Column:
    return value.rlike(r"^[A-Za-z0-9._-]+$") & ~value.rlike(r"^\.+$")


def years_of_ranges(text: Column) -> Column:
    """Years from 1800 to 2030, alone or at the head of a range (2010/2011, 2010-11), in order; decimals and shares are none."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![\w.,])(\d{4})(?:[/–-]\d{2,4})?(?![\w%]|[.,]\d)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(1800, 2030)))


def names_author(text: Column, author: Column, most: int = 6) -> Column:
    """Whether up to ``most`` words in a row spell an author's name, whatever marks are between its parts."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    target = F.regexp_replace(F.lower(author), "[^a-z0-9]", "")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)))
    spelled = lambda i: F.exists(F.sequence(F.lit(1), F.lit(most)), lambda n: F.array_join(F.slice(words, i, n), "") == target)
    return (target != "") & (F.size(words) > 0) & F.exists(starts, spelled)


def to_uri(curie: Column, prefix: str, base: str) -> Column:
    return F.when(F.startswith(curie, F.lit(f"{prefix}:")), F.concat(F.lit(base), F.substring(curie, F.lit(len(prefix) + 2), F.length(curie)))).otherwise(curie)


def to_curie(uri: Column, prefix: str, base: str) -> Column:
    return F.when(F.startswith(uri, F.lit(base)), F.concat(F.lit(f"{prefix}:"), F.substring(uri, F.lit(len(base) + 1), F.length(uri)))).otherwise(uri)


def percent(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit("—")).otherwise(F.format_string("%.1f%%", 100 * a / b))
