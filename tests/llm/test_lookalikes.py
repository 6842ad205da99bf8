import unicodedata

import pytest
from pyspark.sql import functions as F

from cellweave.llm import lookalikes as look

CASES = [
    "na​ïve", "a b", "Ｆull", "ﬁrst", "naïve", "thе", "rinɡ", "so­ft", "οther", "bell\x07", "Ångström", "Å",
    "thin space", "wide　space", "﻿mark",
]
NO_CASES = ["", "plain", "naïve Äé", "“x” – … �", "журнал 12", "α-labelled Β-phase", "tab\t\r\n", "½ ² ™ µ", "日本語", "x" * 100000, "a̸b"]


@pytest.mark.parametrize("text", CASES)
def test_affected(text):
    assert look.is_affected(text)
    assert not look.is_affected(look.same_look(text))


@pytest.mark.parametrize("text", NO_CASES)
def test_unaffected(text):
    assert not look.is_affected(text)


def test_one_form():
    forms = ["The naïve ﬁrst", "Tһe naïve  ﬁrst", "ＴＨＥ naïve fir​st"]
    assert {look.fold(f) for f in forms} == {"the na\u00efve first"}
    assert look.fold("STRASSE ß ẞ") == "strasse ss ss"


def test_fold_is_stable():
    for text in (*CASES, *NO_CASES[:-2]):
        assert look.fold(look.fold(text)) == look.fold(text)


def test_screen_passes_every_case():
    singles = [chr(p) for p in range(0x30000) if unicodedata.category(chr(p)) not in ("Cs", "Cn")] + [chr(p) for p in (0x2065, 0xFFF3, 0xE0001)]
    texts = [t for c in singles for t in (c, f"a{c}b", f"e{c}", f"\u1100{c}")]
    odd = look.suspects(texts)
    bad = [t for t in texts if look.is_affected(t)]
    assert len(bad) > 800 and not {*bad} - {t for t, o in zip(texts, odd) if o}
    plain = "".join(chr(p) for p in (*range(0x20, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x180))) + "“”‘’–—…�\n\t"
    assert not any(look.is_affected(c) for c in plain if c not in "ĳĲŀĿŉǄſ")


def test_screen_in_portions(monkeypatch):
    monkeypatch.setattr(look, "PORTION", 7)
    texts = ["plain", "ﬁ", "", "x" * 50, "y" * 20 + "\u200b", "z"]
    assert look.suspects(texts).tolist() == [False, True, False, False, True, False]
    assert look.suspects([]).tolist() == []


def test_tables(spark):
    rows = [("t", 1, "f", ["ﬁ", None, "A  b"]), ("t", 2, "f", None), ("t", 3, "f", []), ("t", 4, "f", [None]), ("u", 5, "f", ["Plain…", "½"]), ("u", 6, "g", ["x" * 100000 + "\u00ad"]), ("u", 6, "g", ["x" * 100000 + "\u00ad"])]
    values = spark.createDataFrame(rows, look.VALUES)
    assert sorted(tuple(r) for r in look.affected(values).collect()) == [("t", 1, "f"), ("u", 6, "g"), ("u", 6, "g")]
    out = {(r[0], r[1]): r[3] for r in look.consistent(values).collect()}
    assert out == {("t", 1): ["fi", None, "a b"], ("t", 2): None, ("t", 3): [], ("t", 4): [None], ("u", 5): ["plain...", "1⁄2"], ("u", 6): ["x" * 100000]}
    assert look.affected(values.limit(0)).count() == 0 and look.consistent(values.limit(0)).count() == 0


def test_spans_are_found(spark):
    rows = spark.createDataFrame([(1, "The naıve ﬁrst plate", ["first plate", None, " ", "gone"]), (2, None, ["x"]), (3, "a​b", None)], "id int, text string, spans array<string>")
    out = {r["id"]: tuple(r["s"]) for r in rows.select("id", look.located(F.col("text"), F.col("spans")).alias("s")).collect()}
    assert out == {1: (2, 0, 1), 2: (1, 0, 0), 3: (0, 0, 0)}
