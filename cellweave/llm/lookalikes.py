"""Text that looks like other text but consists of other characters.

``consistent`` brings values to one form: compatibility normalisation (composed), white space mapped to a space,
default-ignorable characters removed, letters of another script that look like Latin ones replaced inside words that are
otherwise Latin, and full case folding. A value is *affected* when this form, before case is folded and blanks are joined,
differs from the value itself with its typographic characters (those whose compatibility form looks otherwise) spelled out.
Everything works once per distinct value of a batch; code points are looked up for a whole batch at once, and only values
with a code point that the form could change are looked at one by one.

Defined cases: null stays null and is never affected; an empty text is unaffected; in an array, null elements stay null and
are skipped; texts of any length are read whole; every row of a repeated value is treated alike; an empty table gives no
rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.session import spread

# Letters that look the same as Latin ones, in the order of the Latin ones.
LOOKALIKE = {
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "k": "к", "l": "ӏ", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "ս", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уү",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "F": "Ϝ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ",
}
TO_LATIN = {ord(other): latin for latin, others in LOOKALIKE.items() for other in others}
FOREIGN = "".join(map(chr, TO_LATIN))
#: A Latin letter that is no ordinary one and looks like g.
ALWAYS = "ɡ"
# Default-ignorable code points outside the general category of format characters.
IGNORABLE = [(0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x2065, 0x2065), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF)]
#: Kinds of compatibility mapping under which the look stays: width, spacing and joined forms.
LINE_ENDS = "\t\n\v\f\r\x85\x1c\x1d\x1e\x1f"
SAME_LOOK = {"<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>", "<font>"}


#: Where characters of these kinds are (ideographs and Korean syllables are none).
RANGES = ((0, 0x3400), (0x9FFF, 0xAC00), (0xD7A4, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000))
LATIN = "A-Za-zªºÀ-ÖØ-öø-ɏḀ-ỿ"


@cache
def tables() -> tuple[dict[int, str], dict[int, str], np.ndarray]:
    """What each invisible, spacing, width or joined character stands for; the compatibility form of each typographic one;
    and, by code point, whether the consistent form could change it or what stands before it."""
    same: dict[int, str] = {ord(ALWAYS): "g"}
    typographic: dict[int, str] = {}
    suspect = np.zeros(0x110000, bool)
    for p in (p for a, b in RANGES for p in range(a, b)):
        c = chr(p)
        kind = unicodedata.category(c)
        if kind == "Cf" or any(a <= p <= b for a, b in IGNORABLE) or (kind == "Cc" and c not in LINE_ENDS):
            same[p] = ""
        elif kind == "Zs":
            if c != " ":
                same[p] = " "
        elif tag := unicodedata.decomposition(c):
            form, whole = tag.split(" ")[0], unicodedata.normalize("NFKC", c)
            if form in SAME_LOOK or (form == "<compat>" and len(whole) > 1 and whole.isalpha() and kind[0] == "L"):
                same[p] = whole
            elif form[0] == "<":
                typographic[p] = whole
            elif whole != c:  # composed otherwise
                suspect[p] = True
        if kind[0] == "M" or 0x1160 <= p < 0x1200:
            suspect[p] = True
    suspect[[*same, *TO_LATIN]] = True
    return same, typographic, suspect


WORD = re.compile(r"[^\W\d_]+")
HAS_FOREIGN = re.compile(f"[{FOREIGN}]")
HAS_LATIN = re.compile(f"[{LATIN}]")
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1b\x7f]")
BLANKS = re.compile(r"\s+")


def _latinise(word: re.Match) -> str:
    w = word.group()
    return w.translate(TO_LATIN) if HAS_FOREIGN.search(w) and HAS_LATIN.search(w) else w


def same_look(text: str) -> str:
    """``text`` in ordinary characters: composed, without invisible ones, with plain spaces and Latin letters in Latin words.

    Case, typographic marks and words of another script stay.
    """
    if text.isascii():
        return CONTROL.sub("", text)
    plain = text.translate(tables()[0])
    if not unicodedata.is_normalized("NFC", plain):
        plain = unicodedata.normalize("NFC", plain)
    return WORD.sub(_latinise, plain) if HAS_FOREIGN.search(plain) else plain


def composed(text: str) -> str:
    """The consistent form before case is folded and blanks are joined."""
    plain = same_look(text)
    return plain if plain.isascii() else unicodedata.normalize("NFKC", plain)


def spelled_out(text: str) -> str:
    """``text`` with its typographic characters in compatibility form, and nothing else changed."""
    if text.isascii():
        return text
    plain = text.translate(tables()[1])
    return unicodedata.normalize("NFC", plain) if unicodedata.is_normalized("NFC", text) else plain


def is_affected(text: str) -> bool:
    """Whether ``text`` has a character that is invisible or stands for other, ordinary ones."""
    return composed(text) != spelled_out(text)


def fold(text: str) -> str:
    """The consistent form for comparisons."""
    plain = composed(text)
    plain = plain.lower() if plain.isascii() else unicodedata.normalize("NFKC", plain.casefold())
    return BLANKS.sub(" ", plain).strip()


#: Characters looked up at once.
PORTION = 4_000_000


def suspects(texts: list[str]) -> np.ndarray:
    """Whether each text has a code point that its consistent form could change; no text without one is affected."""
    table, out = tables()[2], np.zeros(len(texts), bool)
    start = held = 0
    for i, text in enumerate(texts):
        held += len(text) + 1
        if held > PORTION or i + 1 == len(texts):
            part = texts[start : i + 1]
            points = np.frombuffer(("\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
            begin = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])[:-1]])
            out[start : i + 1] = np.logical_or.reduceat(table[points], begin)
            start, held = i + 1, 0
    return out


def plain_texts(texts: list[str]) -> list[str]:
    """The texts in ordinary characters (see same_look)."""
    return [same_look(t) if odd else t for t, odd in zip(texts, suspects(texts))]


VALUES = "source_table string, row_no long, field_name string, values array<string>"


class _Consistent:
    """The values of each row (source_table, row_no, field_name, values) in consistent form, or only the affected rows without them."""

    def __init__(self, found_only: bool) -> None:
        self.found_only = found_only

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            each = lists.flatten().dictionary_encode()
            distinct = each.dictionary.to_pylist()
            odd = suspects(distinct)
            if not self.found_only:
                forms = pa.array([fold(t) for t in distinct], pa.string()).take(each.indices)
                offsets = pa.array(np.concatenate([[0], np.cumsum([0 if v is None else v for v in lists.value_lengths().to_pylist()])]).astype(np.int32))
                values = pa.ListArray.from_arrays(offsets, forms, mask=lists.is_null())
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), values], ["source_table", "row_no", "field_name", "values"])
                continue
            found = np.zeros(len(distinct) + 1, bool)
            for i in np.flatnonzero(odd):
                found[i] = is_affected(distinct[i])
            hit = found[each.indices.fill_null(len(distinct)).to_numpy()]
            rows = np.unique(lists.value_parent_indices().to_numpy()[hit])
            yield batch.select(["source_table", "row_no", "field_name"]).take(pa.array(rows))


def consistent(values: DataFrame) -> DataFrame:
    """``values`` (VALUES) with each value in consistent form."""
    return spread(values).mapInArrow(_Consistent(False), VALUES)


def affected(values: DataFrame) -> DataFrame:
    """source_table, row_no, field_name of the rows of ``values`` (VALUES) that hold an affected value."""
    return spread(values).mapInArrow(_Consistent(True), VALUES.rpartition(",")[0])


def per_distinct(values: pd.Series, work: Callable[[str], object]) -> pd.Series:
    """``work`` of every value, once per distinct one; null for null."""
    codes, distinct = pd.factorize(values)
    done = pd.Series([work(v) for v in distinct] + [None], dtype="object")
    return pd.Series(done.to_numpy()[codes], index=values.index)


@F.pandas_udf(T.StringType())
def canonical(values: pd.Series) -> pd.Series:
    """Column of consistent forms."""
    return per_distinct(values, fold)


def _located(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
    folded = per_distinct(texts, fold)
    rows = []
    for text, plain, mine in zip(texts, folded, spans):
        known = [s for s in mine if s is not None and s.strip()] if mine is not None else []
        if text is None:
            rows.append((len(known), 0, 0))
        else:
            rows.append((len(known), sum(s in text for s in known), sum(fold(s) in plain for s in known)))
    return pd.DataFrame(rows, columns=["n_spans", "n_verbatim", "n_found"])


def located(text: Column, spans: Column) -> Column:
    """Of an array of spans (null and blank ones left out): how many, how many stand in the text as written, and in consistent form."""
    return F.pandas_udf(_located, "n_spans long, n_verbatim long, n_found long")(text, spans)
