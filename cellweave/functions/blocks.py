"""Blocks of running text taken from documents."""

from __future__ import annotations

import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Own defaults: headings behind which the body of a paper is over.
STOP_HEADINGS = ("acknowledgements", "acknowledgments", "bibliography", "funding", "references")
INTRO_HEADINGS = ("background", "introduction")


def clean_block(text: Column) -> Column:
    """One kind of line end, single blanks, no empty lines."""
    lines = F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")
    plain = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(plain, lambda x: x != ""), "\n")


def without_bibliography(text: Column) -> Column:
    """The text up to a line that heads its bibliography."""
    return F.regexp_replace(text, r"(?is)(?:^|\n)[ \t]*(?:references|bibliography|literature cited)[ \t]*:?[ \t]*\n.*\z", "")


def heading(text: Column) -> Column:
    """A section's heading without numbers and marks, in lower case."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"^[\divx]+[.):]\s*", ""), r"[^a-z ]+", " "))


def body(sections: Column) -> Column:
    """The body of a paper from its sections (array of head, text), without those behind it."""
    kept = F.filter(sections, lambda s: ~heading(s["head"]).isin(*STOP_HEADINGS))
    return clean_block(without_bibliography(F.array_join(F.transform(kept, lambda s: s["text"]), "\n\n")))


def introduction(sections: Column) -> Column:
    """The first section that is headed as an introduction, else empty."""
    return F.coalesce(clean_block(F.try_element_at(F.filter(sections, lambda s: heading(s["head"]).isin(*INTRO_HEADINGS)), F.lit(1))["text"]), F.lit(""))


def wrapped(text: str, width: int = 80) -> str:
    paragraphs = [p.strip() for p in text.split("\n\n")]
    return "\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs if p)


@F.pandas_udf(T.StringType())
def wrap(values: pd.Series) -> pd.Series:
    """Paragraphs in lines of at most 80 characters; a longer word stays whole."""
    return values.map(wrapped, na_action="ignore")


def first_part(text: Column, share: float = 0.1) -> Column:
    """The first tenth of a text, one character at least."""
    plain = F.trim(text)
    return F.trim(F.left(plain, F.greatest(F.floor(F.length(plain) * share), F.lit(1)).cast("int")))


def last_part(text: Column, share: float = 0.1) -> Column:
    plain = F.trim(text)
    return F.trim(F.right(plain, F.greatest(F.floor(F.length(plain) * share), F.lit(1)).cast("int")))
