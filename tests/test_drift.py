"""Schema changes between files."""

import itertools
import json
import random

import numpy as np
import pytest

from cellweave.operators import drift
from cellweave.session import settings

SCHEMA = "line_id long, feed_id string, file_id string, file_seq int, payload string, field string"


def changes(spark, rows):
    lines = spark.createDataFrame([(n, f, i, s, p if p is None or isinstance(p, str) else json.dumps(p), "clash") for n, (f, i, s, p) in enumerate(rows)], SCHEMA)
    return sorted(tuple(r) for r in drift.schema_changes(lines).collect())


def test_added_removed_retyped_renamed(spark):
    models = ["alpha/one", "beta/two", "gamma/three", "delta/four"]
    first = [("f", "f1", 1, {"model": m, "n": 100 + k, "old": True, "x": "5"}) for k, m in enumerate(models)]
    second = [("f", "f2", 3, {"model_id": m, "n": 101 + k, "x": 5, "fresh": ["a"]}) for k, m in enumerate(models)]
    assert changes(spark, first + second) == [("f2", "added", "", "fresh"), ("f2", "removed", "old", ""), ("f2", "renamed", "model", "model_id"), ("f2", "retyped", "x", "x")]


def test_nulls_have_no_type_but_are_fields(spark):
    rows = [("f", "f1", 1, {"a": 1, "b": None}), ("f", "f2", 2, {"a": None, "b": "x", "c": None})]
    assert changes(spark, rows) == [("f2", "added", "", "c")]


def test_whole_and_broken_numbers_are_one_type(spark):
    assert changes(spark, [("f", "f1", 1, {"a": 1}), ("f", "f2", 2, {"a": 1.5})]) == []


def test_bad_lines_and_feeds_apart(spark):
    rows = [("f", "f1", 1, {"a": 1}), ("f", "f1", 1, "not json"), ("f", "f1", 1, None), ("f", "f1", 1, "[1]"), ("g", "g1", 2, {"b": 1}), ("f", "f2", 5, {"a": 2}), ("f", "f2", 5, {"a": 2})]
    assert changes(spark, rows) == []


def test_equal_sequence_numbers_go_by_file_id(spark):
    rows = [("f", "fb", 1, {"a": 1, "b": 1}), ("f", "fa", 1, {"a": 1})]
    assert changes(spark, rows) == [("fb", "added", "", "b")]


def test_empty(spark):
    assert changes(spark, []) == []


def test_long_values(spark):
    rows = [("f", "f1", 1, {"a": "x " * 50000}), ("f", "f2", 2, {"b": "x " * 50001})]
    assert changes(spark, rows) == [("f2", "renamed", "a", "b")]


@pytest.mark.parametrize("seed", range(30))
def test_matching_is_the_best_one(seed):
    draw = random.Random(seed)
    left, right = [f"a{k}" for k in range(draw.randint(1, 4))], [f"b{k}" for k in range(draw.randint(1, 4))]
    scores = {(a, b): draw.random() for a in left for b in right if draw.random() < 0.7}
    if not scores:
        return
    pairs = list(scores)
    best = max(
        sum(scores[p] for p in chosen)
        for k in range(len(pairs) + 1)
        for chosen in itertools.combinations(pairs, k)
        if len({a for a, _ in chosen}) == len(chosen) == len({b for _, b in chosen})
    )
    got = drift.best_matching(scores)
    assert len({a for a, _ in got}) == len(got) == len({b for _, b in got})
    assert sum(scores[p] for p in got) == pytest.approx(best)


def test_unified_table(spark):
    rows = [(1, "f", "f1", 1, "t", '{"label": "X", "n": "7", "more": 1}'), (2, "f", "f2", 2, "t", '{"tag": ["Y"], "n": "bad"}'), (3, "f", "f3", 3, "t", "broken")]
    lines = spark.createDataFrame(rows, "line_id long, feed_id string, file_id string, file_seq int, written_at string, payload string")
    renames = spark.createDataFrame([("label", "tag")], "old_field string, new_field string")
    names = drift.canonical_names(renames, ("label", "n"))
    out = {r["line_id"]: r for r in drift.unify(lines, names, {"label": "string", "n": "int"}).collect()}
    assert (out[1]["label"], out[1]["n"], out[1]["extras"]) == ("X", 7, {"more": "1"})
    assert (out[2]["label"], out[2]["n"], out[2]["extras"]) == ("Y", None, {"n": "bad"})
    assert (out[3]["label"], out[3]["extras"]) == (None, None)


def test_a_file_over_many_batches(spark):
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="3"):
        rows = [("f", f"f{k}", k, {"model": f"m{n % 5}/x", "n": n, f"only{k}": "a b c"}) for k in (1, 2, 3) for n in range(40)]
        rows += [("f", "f4", 4, {"model": [1], "n": n}) for n in range(10)]
        assert changes(spark, rows) == [
            ("f2", "renamed", "only1", "only2"), ("f3", "renamed", "only2", "only3"), ("f4", "removed", "only3", ""), ("f4", "retyped", "model", "model"),
        ]


def test_word_hashes_do_not_depend_on_place():
    powers = drift.Powers()
    text = "One two, one-TWO ünï 12 ünï"
    at, found = drift.word_hashes(np.frombuffer(f" {text} ".encode(), np.uint8), powers)
    words = "one two one two ünï 12 ünï".split()
    assert len(at) == len(words)
    assert [words.index(w) for w in words] == [found.tolist().index(h) for h in found.tolist()]


def test_renames_of_any_length_and_no_value_lost(spark):
    rows = [
        (1, "f", "f1", 1, "t", '{"d": "X", "n": [5]}'), (2, "f", "f1", 1, "t", '{"label": "A", "b": "B", "z": null}'), (3, "f", "f1", 1, "t", '{"c": ["P", "Q"], "many": "no list"}'),
        (4, "f", "f1", 1, "t", '{"many": ["x", "y"], "n": "7", "b": "B", "c": "C"}'), (5, "f", "f1", 1, "t", None), (5, "f", "f1", 1, "t", "{}"),
    ]
    lines = spark.createDataFrame(rows, "line_id long, feed_id string, file_id string, file_seq int, written_at string, payload string")
    renames = spark.createDataFrame([("d", "c"), ("b", "c"), ("b", "label"), ("x", "y")], "old_field string, new_field string")
    names = drift.canonical_names(renames, ("label", "n", "many"))
    assert {r["field"]: r["target"] for r in names.collect()} == {"label": "label", "n": "n", "many": "many", "b": "label", "c": "label", "d": "label"}
    out = {r["line_id"]: r for r in drift.unify(lines, names, {"label": "string", "n": "int", "many": "array<string>"}).collect()}
    assert (out[1]["label"], out[1]["n"], out[1]["extras"]) == ("X", 5, {})
    assert (out[2]["label"], out[2]["extras"]) == ("A", {"b": "B", "z": None})
    assert (out[3]["label"], out[3]["many"], out[3]["extras"]) == (None, None, {"c": '["P","Q"]', "many": "no list"})
    assert (out[4]["label"], out[4]["n"], out[4]["many"], out[4]["extras"]) == ("B", 7, ["x", "y"], {"c": "C"})
