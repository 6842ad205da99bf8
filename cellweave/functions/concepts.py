"""Concepts named in the framing of a response, and how far the prompt already has them. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cellweave.functions.strings import concept, contained_in_longer, match_text


def quoted(text: Column) -> Column:
    """Quoted spans of 3 to 160 characters, spelled alike, without those that are part of a longer one."""
    spans = F.regexp_extract_all(text, F.lit('["“”]([^"“”\\n]{3,160})["“”]'), F.lit(1))
    return contained_in_longer(F.array_distinct(F.transform(spans, concept)))


def overlaps(found: Column, prompt: Column) -> Column:
    """Whether a concept stands in the prompt as a whole, or, having two words or more, with all of its words."""
    bare = match_text(found)
    padded = F.concat(F.lit(" "), match_text(prompt), F.lit(" "))
    words = F.split(bare, " ")
    whole = (bare != "") & F.contains(padded, F.concat(F.lit(" "), bare, F.lit(" ")))
    every = F.forall(words, lambda w: F.contains(padded, F.concat(F.lit(" "), w, F.lit(" "))))
    long_enough = (F.size(words) > 2) | F.forall(words, lambda w: F.length(w) >= 6)
    return whole | ((F.size(words) >= 2) & long_enough & every)


def in_prompt(concepts: Column, prompt: Column) -> Column:
    """The concepts that the prompt has."""
    return F.filter(concepts, lambda c: overlaps(c, prompt))
