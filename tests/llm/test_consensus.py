import random

import numpy as np
import pytest

from cellweave.functions.identifiers import CLASSES
from cellweave.llm import consensus

SCHEMA = "item_id long, member_id string, label string, error string, voted_at timestamp, w array<double>, cls string"


def frame(spark, rows):
    return spark.createDataFrame([(i, m, label, e, None, None, "clash") for i, m, label, e in rows], SCHEMA)


def judge(spark, rows, least=3):
    items, people = consensus.consensus(consensus.valid_votes(frame(spark, rows)), least)
    return {r["item"]: r for r in items.collect()}, {r["member"]: r for r in people.collect()}


@pytest.fixture(scope="module")
def votes():
    draw = random.Random(5)
    accuracy = {"good1": 0.9, "good2": 0.88, "fair": 0.7, "poor": 0.45, "noise": 0.25, "turned": 0.05, "lazy": None}
    truth, rows = {}, []
    for item in range(900):
        truth[item] = draw.choices(range(4), [1, 1, 4, 5])[0]
        for m, a in accuracy.items():
            if draw.random() < 0.75:
                if a is None:
                    vote = 3 if draw.random() < 0.9 else truth[item]
                elif draw.random() < a:
                    vote = truth[item]
                else:
                    vote = draw.choice([k for k in range(4) if k != truth[item]])
                rows.append((item, m, CLASSES[vote], None))
    return truth, rows, accuracy


def test_accuracies_and_consensus(spark, votes):
    truth, rows, accuracy = votes
    items, people = judge(spark, rows)
    for m in ("good1", "good2", "fair", "poor", "noise", "turned"):
        assert people[m]["accuracy"] == pytest.approx(accuracy[m], abs=0.08)
    right = np.mean([truth[i] == r["cls"] for i, r in items.items()])
    most = {}
    for i, _, label, _ in rows:
        most.setdefault(i, []).append(label)
    majority = np.mean([CLASSES[truth[i]] == max(sorted(set(most[i])), key=most[i].count) for i in items])
    assert right > 0.9 and right > majority
    assert all(0 < r["confidence"] <= 1 for r in items.values())


def test_valid_votes(spark):
    rows = [
        (1, "a", "FourClassLabel.ENGAGED_RECOGNIZED", None), (1, "a", "ER", None), (1, "b", "engaged-recognized", None), (1, "c", " Engaged Recognized ", None),
        (1, "d", "REFUSED_RECOGNIZED", "timeout"), (1, None, "ER", None), (None, "a", "ER", None), (2, "a", "nonsense", None), (2, "b", None, None), (3, "a", "RU", None), (3, "b", "RU", None),
    ]
    items, people = judge(spark, rows)
    assert {i: CLASSES[r["cls"]] for i, r in items.items()} == {1: "ENGAGED_RECOGNIZED"}
    assert items[1]["n_votes"] == 3 and items[1]["agreement"] == 1
    assert set(people) == {"a", "b", "c"}


def test_ties_have_one_answer(spark):
    rows = [(1, m, label, None) for m, label in (("a", "RR"), ("b", "RU"), ("c", "ER"), ("d", "EU"))]
    assert judge(spark, rows)[0][1]["cls"] == judge(spark, rows)[0][1]["cls"]


def test_empty(spark):
    items, people = judge(spark, [])
    assert not items and not people


def test_triplets_of_exact_moments():
    skill = np.array([0.9, 0.6, 0.4, -0.5, 0.0])
    agreement = np.outer(skill, skill)
    assert np.allclose(consensus.triplet_skill(agreement, np.ones((5, 5))), skill, atol=0.02)


def test_annotators_beyond_the_anchors(spark, votes, monkeypatch):
    truth, rows, accuracy = votes
    ballots = consensus.valid_votes(frame(spark, rows)).cache()
    whole = {r["member"]: r for r in consensus.annotators(ballots, 7)[0].collect()}
    monkeypatch.setattr(consensus, "FLUSH", 64)  # pair counts are sent on after every batch
    for anchors in (5, 4):
        few = {r["member"]: r for r in consensus.annotators(ballots, anchors)[0].collect()}
        assert set(few) == set(whole)
        for m in ("good1", "good2", "fair", "poor", "noise"):
            assert few[m]["accuracy"] == pytest.approx(whole[m]["accuracy"], abs=0.1)
            assert few[m]["n_votes"] == whole[m]["n_votes"]
    items = {r["item"]: r["cls"] for r in consensus.consensus(ballots, anchors=5)[0].collect()}
    assert np.mean([truth[i] == c for i, c in items.items()]) > 0.88


def test_annotator_without_company(spark, votes):
    rows = votes[1] + [(10_000 + k, "alone", CLASSES[k % 2], None) for k in range(30)]
    for anchors in (20, 5):
        people = {r["member"]: r for r in consensus.annotators(consensus.valid_votes(frame(spark, rows)), anchors)[0].collect()}
        assert people["alone"]["skill"] == pytest.approx(0, abs=0.05) and people["alone"]["n_votes"] == 30


def test_pair_counts_against_brute_force(spark, votes, monkeypatch):
    rows = [r for r in votes[1] if r[0] < 60]
    ballots = consensus.valid_votes(frame(spark, rows)).repartition(3)
    want = {}
    for i, m, a, _ in rows:
        for j, n, b, _ in rows:
            if i == j and n in ("fair", "poor"):
                key = (m, CLASSES.index(a), ("fair", "poor").index(n), CLASSES.index(b))
                want[key] = want.get(key, 0) + 1
    for flush in (4_000_000, 40):
        monkeypatch.setattr(consensus, "FLUSH", flush)
        got = {(r["member"], r["cls"], r["anchor"], k): r[f"c{k}"] for r in consensus.pair_counts(ballots, ["fair", "poor"]).collect() for k in range(4) if r[f"c{k}"]}
        assert got == want
