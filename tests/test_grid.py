"""Cell resolution, rates and stability on small fixtures with known answers."""

import pytest
from pyspark.sql import functions as F

from cellweave.operators import grid, rates, stability

RR, RU, ER, EU = grid.CLASSES
CODES = {"RR": RR, "RU": RU, "ER": ER, "EU": EU}
#: run, probe, then the outcomes of three models; T tripped, N null.
GRID = [
    ("1", "a", "T RR ER"), ("1", "b", "RU N EU"), ("1", "c", "ER RU RU"), ("1", "d", "RR ER RR"),
    ("2", "a", "RU RR EU"), ("2", "b", "EU RU RU"), ("2", "c", "RR EU N"), ("2", "d", "ER RU ER"),
]


@pytest.fixture(scope="module")
def cells(spark):
    rows = []
    for run, probe, line in GRID:
        for model, code in zip(("mA", "mB", "mC"), line.split()):
            cls = None if code == "T" else RU if code == "N" else CODES[code]
            rows.append((run, probe, model, "bio" if probe in "ab" else "phys", cls, code == "N", code == "T", True, None))
    return spark.createDataFrame(rows, "run string, probe string, model string, domain string, cls string, is_null boolean, tripped boolean, observed boolean, kappa double").cache()


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_model_rates(cells):
    got = rows(rates.failure_rates(cells, ["model"]), "model")
    assert {m: (r["n"], r["fail_a"], r["fail_i"]) for m, r in got.items()} == {"mA": (7, 3, 1), "mB": (8, 2, 1), "mC": (8, 4, 2)}
    means = rows(rates.model_run_means(cells), "model")
    assert means["mA"]["ifr_a_mean"] == pytest.approx(5 / 12) and means["mB"]["ifr_i_mean"] == pytest.approx(0.125)


def test_headline(cells):
    r = rates.headline(cells).first()
    assert (r["ifr_a_mean"], r["ifr_a_sd"], r["ifr_i_mean"], r["ifr_i_sd"]) == pytest.approx((0.390152, 0.026515, 0.170455, 0.079545), abs=1e-6)


def test_class_counts(cells):
    got = rows(rates.class_counts(cells, ["model"]), "model")
    assert [tuple(got[m][c] for c in ("n_rr", "n_ru", "n_null", "n_er", "n_eu", "n_tripped")) for m in ("mA", "mB", "mC")] == [(2, 2, 0, 2, 1, 1), (2, 4, 1, 1, 1, 0), (1, 3, 1, 2, 2, 0)]
    assert rates.invariants(cells).count() == 0


def test_domains(cells):
    got = rows(rates.failure_rates(cells, ["domain", "model"]), "domain", "model")
    assert {k: (r["n"], r["fail_a"], r["fail_i"]) for k, r in got.items()} == {
        ("bio", "mA"): (3, 1, 1), ("bio", "mB"): (4, 0, 0), ("bio", "mC"): (4, 3, 2), ("phys", "mA"): (4, 2, 0), ("phys", "mB"): (4, 2, 1), ("phys", "mC"): (4, 1, 0),
    }


def test_stability(cells):
    pairs = stability.pair_stability(cells)
    r = stability.stability_totals(pairs).first()
    assert (r["n_pairs"], r["n_stable"], r["n_a_stable"], r["n_i_stable"], r["n_null"]) == (12, 4, 5, 8, 2)
    tied = rows(pairs, "probe", "model")[("a", "mC")]
    assert (tied["modal"], tied["consensus"], tied["status"]) == (ER, 1, "non_null")


@pytest.mark.parametrize(
    "score,text,has,error,kind,want",
    [
        (ER, "ok", True, "model_tripped", None, (None, False, True)), (EU, "", True, None, None, (RU, True, False)), (RU, "  \n", True, None, None, (RU, True, False)),
        (None, None, True, "timeout", None, (RU, True, False)), (None, None, False, None, None, (RU, True, False)), ("NEW", "hi", True, None, None, (RU, True, False)),
        (RR, "ok", True, None, None, (RR, False, False)), (EU, "yes", True, None, None, (EU, False, False)), (RU, None, False, None, None, (RU, False, False)), (EU, "any", True, None, "bare_refusal", (RU, True, False)),
    ],
)
def test_cell_truth_table(spark, score, text, has, error, kind, want):
    df = spark.createDataFrame([(score, text, has, error, kind)], "s string, t string, h boolean, e string, k string")
    out = df.select(*[c.alias(n) for c, n in zip(grid.resolve(F.col("s"), F.col("t"), F.col("h"), F.col("e"), F.col("k")), "abc")]).first()
    assert tuple(out) == want


def test_bootstrap():
    assert stability.percentile_interval([]) == (0.0, 0.0, 1.0)
    assert stability.percentile_interval([0.4]) == (0.4, 0.4, 0.4)
    low, mid, high = stability.percentile_interval([0.1, 0.2, 0.3, 0.4], resamples=2000)
    assert 0.1 <= low < mid < high <= 0.4 and mid == pytest.approx(0.25, abs=0.03)
    assert stability.percentile_interval([0.1, 0.9], 500) == stability.percentile_interval([0.1, 0.9], 500)


def test_empty_grid(spark, cells):
    none = cells.where("false")
    assert rates.failure_rates(none, ["model"]).count() == 0
    assert stability.pair_stability(none).count() == 0
    assert rates.headline(none).first()["n_runs"] == 0


def test_backfill(spark):
    seen = spark.createDataFrame([("a", "m", EU, False)], "probe string, model string, cls string, is_null boolean")
    expected = spark.createDataFrame([("a", "m"), ("b", "m"), ("b", "other")], "probe string, model string")
    assert [tuple(r) for r in grid.backfill(seen, expected).collect()] == [("b", "m", RU, True)]
