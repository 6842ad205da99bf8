import random

import pytest

from cellweave.llm import packing


def pack(spark, items, caps, **kw):
    df = spark.createDataFrame([(k, n, "clash", 0) for k, n in items], "doc_id long, tokens long, bin string, capacity int")
    windows = spark.createDataFrame(caps, "window_name string, capacity_tokens int")
    return [r.asDict() for r in packing.pack(df, windows, key="doc_id", size="tokens", **kw).collect()]


def check(rows, items, caps):
    for window, capacity in caps:
        mine = [r for r in rows if r["window_name"] == window]
        fill, got = {}, {}
        for r in mine:
            fill[r["container_id"]] = fill.get(r["container_id"], 0) + r["tokens"]
            got.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
        assert max(fill.values(), default=0) <= capacity
        want = {}
        for k, n in items:
            want[k] = want.get(k, 0) + max(n or 0, 0)
        assert {k: sum(n for _, n in v) for k, v in got.items()} == want
        for k, n in items:
            if (n or 0) <= capacity and sum(1 for j, _ in items if j == k) == 1:
                assert len(got[k]) == 1


def test_whole_and_split_items(spark):
    items = [(1, 5), (2, 5), (3, 0), (4, None), (5, 25), (6, 10), (7, 1), (8, 20), (9, 5), (9, 5)]
    caps = [("ten", 10), ("big", 100)]
    check(pack(spark, items, caps), items, caps)


def test_small_portions_merge(spark):
    draw = random.Random(2)
    items = [(k, int(draw.expovariate(1 / 60)) + 1) for k in range(3000)]
    caps = [("w", 512)]
    rows = pack(spark, items, caps, portion=50)
    check(rows, items, caps)
    used = len({r["container_id"] for r in rows})
    assert used <= 1.03 * -(-sum(n for _, n in items) // 512) + 1


def test_items_that_never_fit_together(spark):
    items = [(k, 60) for k in range(500)]
    rows = pack(spark, items, [("w", 100)], portion=40)
    check(rows, items, [("w", 100)])
    assert len({r["container_id"] for r in rows}) == 500


def test_nothing(spark):
    assert pack(spark, [], [("w", 10)]) == []
    assert pack(spark, [(1, 5)], []) == []
    assert pack(spark, [(1, 5)], [("w", None), (None, 5), ("z", 0)]) == []


@pytest.mark.parametrize("seed", range(20))
def test_best_fit(seed):
    draw = random.Random(seed)
    capacity = draw.randint(5, 300)
    sizes = [draw.randint(0, capacity) for _ in range(200)]
    place, fill = packing.best_fit(sizes, capacity)
    again = [0] * len(fill)
    for p, s in zip(place, sizes):
        again[p] += s
    assert again == fill and max(fill) <= capacity
    assert len(fill) <= 11 / 9 * -(-sum(sizes) // capacity) + 6


def test_more_capacities_than_at_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "WINDOWS_AT_ONCE", 2)
    draw = random.Random(2)
    items = [(k, draw.randint(0, 60)) for k in range(120)]
    caps = [(f"w{c}", c) for c in (20, 30, 50, 64, 90)]
    check(pack(spark, items, caps), items, caps)
