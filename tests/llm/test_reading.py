import math
import random
from collections import Counter

import numpy as np

from cellweave.llm import languages, reading

EASY = ["We ran the test two times.", "A man said that the tea can help.", "They put the box on the shelf.", "It was cold in the room.", "We do not know why."]
HARD = [
    "Multivariable recalibration attenuated the association between phytochemical formulations and cytokine expression.",
    "Thermodynamic implausibility precludes mechanistic interpretation.",
    "Immunofluorescence quantification lacked normalisation notwithstanding stratification.",
    "Heteroscedasticity invalidated conventional parametric inference.",
]
GERMAN = ["Die Kammer wird mit dem Mittel beladen und bleibt geschlossen.", "Die Bediener notieren den Beginn und den abgelesenen Wert."]


def text(draw, main, other, share):
    return " ".join(draw.choice(other if draw.random() < share else main) for _ in range(14))


def test_levels(spark):
    draw = random.Random(4)
    docs = [(k, text(draw, EASY, HARD, 0.15), "en", 1) for k in range(60)] + [(100 + k, text(draw, HARD, EASY, 0.2), "en", 4) for k in range(40)]
    docs += [(200 + k, text(draw, GERMAN, GERMAN, 0), "de", None) for k in range(30)] + [(300, None, "en", None), (301, "", "en", None), (302, "1 2 3", "en", None), (303, " ".join(HARD * 3000), "de", 4)]
    documents = spark.createDataFrame([(k, t, lang, "clash", 1.0) for k, t, lang, _ in docs], "doc_id long, text string, lang string, level string, rank double")
    refs = spark.createDataFrame([(k, lv, " ".join(s)) for k, (lv, s) in enumerate([(1, EASY), (4, HARD), (1, EASY[::-1]), (4, HARD[::-1]), (None, EASY)])], "ref_id long, level int, text string")
    model = languages.fit(documents)
    out = {r["doc_id"]: r for r in reading.levels(documents, refs, model).collect()}
    assert len(out) == len(docs)
    for key, _, lang, level in docs:
        if level is not None:
            assert out[key]["level"] == level, (key, out[key])
        else:
            assert out[key]["level"] is None
    assert out[303]["reads"] and not out[200]["reads"]
    assert reading.levels(documents.limit(0), refs, model).count() == 0
    assert {r["level"] for r in reading.levels(documents, refs.limit(0), model).collect()} == {None}


def test_rare_words_are_joined_exactly(spark):
    draw = random.Random(9)
    words = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    docs = [(k, " ".join(draw.choices(words, [1 / (j + 1) for j in range(len(words))], k=draw.randint(3, 60))) + ".") for k in range(80)]
    docs += [(k, t) for k, t in docs[:5]] + [(500, None), (501, ""), (502, "!")]
    documents = spark.createDataFrame(docs, "key long, text string")
    measured = documents.selectExpr("cast(key AS string) key", "text").mapInArrow(reading._Measure(None, "en", True), reading.MEASURED).cache()
    ranks = reading.word_ranks(measured)
    counts = Counter(w for _, t in docs for w in (t or "").rstrip(".!").split())
    rank = {w: sum(m >= n for m in counts.values()) for w, n in counts.items()}
    want = []
    for k, t in docs:
        found = sorted(rank[w] for w in (t or "").rstrip(".!").split())
        want.append((str(k), float(found[math.ceil(0.75 * len(found)) - 1]) if found else None))
    for top in (10**6, 7, 1, 0):
        got = [(r["key"], r["rank"]) for r in reading.coverage(measured, ranks, top).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)


def test_sentences_and_words():
    texts = ["One two-three. “Four five six!” 7 don't\nheading\nA b c d e f.", "", "Ünï 漢字 x", "." * 5]
    length, size, doc, hashes, counts = reading.analyse(texts, reading.Powers())
    # Of the sentences with three words: "Four five six", and "A b c d e f".
    assert size[0] == 6 and length[0] == (4 + 4 + 3) / 3 and size[2] == 3
    assert np.isnan(size[1]) and np.isnan(size[3])
    assert np.bincount(doc, counts, 4).tolist() == [13, 0, 3, 0]
    assert list(reading.portions(["a" * 5, "b" * 5, "c" * 50, "d"], 12)) == [(0, 2), (2, 3), (3, 4)]
