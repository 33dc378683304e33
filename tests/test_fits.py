from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import fits, probes


def rows_of(spark, n=240, d=5, seed=1):
    """Two strata of uneven groups, with pairs inside of groups, a constant column and rows without label or vector."""
    rng, out = np.random.default_rng(seed), []
    for s in ("s", None):
        for i in range(n):
            g, y = int(i % 7 % 4), int(i // 7 % 2)
            x = rng.normal(size=d) * np.arange(1, d + 1) + np.array([1.2 * y, g, 0, -0.7 * y, 0][:d])
            x[2] = 3.0
            out.append((s, i, f"g{g}", y if i % 31 else None, x.tolist() if i % 37 else None, f"{g}-{i // 14}"))
    return spark.createDataFrame(out, "s string, k int, g string, y int, v array<double>, pair string").repartition(6)


def models(frame):
    return {(r.s, r.fold): np.append(r.weights, r.intercept) for r in frame.collect()}


@pytest.mark.parametrize(("probe", "residual"), [("logistic", False), ("logistic", True), ("pca", False), ("centroid", False), ("centroid", True)])
def test_equal_to_fits_of_gathered_rows(spark, probe, residual):
    rows = rows_of(spark)
    got = models(fits.fit_by_sums(rows, ["s"], "g", "y", "v", probe, residual=residual))
    want = models(probes.fit_leaving_out(rows, ["s"], "g", "k", "y", "v", probe, residual=residual))
    assert set(got) == set(want) and len(got) == 8
    for k in want:
        assert np.abs(got[k] - want[k]).max() < 1e-6 * max(1, np.abs(want[k]).max())


def test_contrast_by_pairs(spark):
    """Pairs with one member of each class, so that none depends on the order of rows."""
    rng = np.random.default_rng(2)
    rows = [("s", 2 * p + y, f"g{p % 3}", y, (rng.normal(size=4) + 0.8 * y * np.arange(4)).tolist(), f"p{p}") for p in range(40) for y in (0, 1)]
    frame = spark.createDataFrame(rows + [("s", 99, "g0", 1, [0.0] * 4, None), ("s", 98, "g1", 0, [1.0] * 4, "alone")], "s string, k int, g string, y int, v array<double>, pair string")
    got = models(fits.fit_by_sums(frame, ["s"], "g", "y", "v", "contrast", "pair"))
    want = models(probes.fit_leaving_out(frame, ["s"], "g", "k", "y", "v", "contrast", "pair"))
    assert set(got) == set(want) and all(np.abs(got[k] - want[k]).max() < 1e-6 for k in want)


def test_pairs_across_folds_leave_both(spark):
    rows = [(0, "a", 1, [1.0, 0.0], "p"), (1, "b", 0, [0.0, 0.0], "p"), (2, "c", 1, [0.0, 2.0], "q"), (3, "c", 0, [0.0, 0.0], "q"), (4, "b", 1, [1.0, 1.0], None), (5, "a", 0, [0.0, 1.0], None)]
    frame = spark.createDataFrame(rows, "k int, g string, y int, v array<double>, pair string").withColumn("s", F.lit("x"))
    got = models(fits.fit_by_sums(frame, ["s"], "g", "y", "v", "contrast", "pair"))
    assert got["x", "a"][0] == pytest.approx(0) and got["x", "b"][0] == pytest.approx(0)  # only the pair q is left
    assert got["x", "c"][1] == pytest.approx(0)


def test_folds_of_one_class_and_nothing_to_tell_apart(spark):
    rows = spark.createDataFrame([(0, 0, 1, [1.0]), (1, 0, 0, [0.0]), (2, 1, 1, [1.0])], "k int, g int, y int, v array<double>").withColumn("s", F.lit(1))
    assert [r.fold for r in fits.fit_by_sums(rows, ["s"], "g", "y", "v").collect()] == [1]
    alike = spark.createDataFrame([(i, i % 3, int(i % 4 == 0), [1.0, 2.0]) for i in range(24)], "k int, g int, y int, v array<double>").withColumn("s", F.lit(1))
    for r in fits.fit_by_sums(alike, ["s"], "g", "y", "v", "centroid").collect():
        assert not any(r.weights) and probes.sigmoid(np.array([r.intercept]))[0] == pytest.approx(0.25, abs=0.07)
    assert fits.fit_by_sums(alike.limit(0), ["s"], "g", "y", "v").count() == 0


def test_separable_classes_come_to_an_end(spark):
    rows = spark.createDataFrame([(i, i % 3, int(i % 2), [100.0 * (i % 2), 1e-3 * i]) for i in range(60)], "k int, g int, y int, v array<double>").withColumn("s", F.lit(1))
    got, want = models(fits.fit_by_sums(rows, ["s"], "g", "y", "v")), models(probes.fit_leaving_out(rows, ["s"], "g", "k", "y", "v"))
    assert all(np.abs(got[k] - want[k]).max() < 1e-5 for k in want)


@pytest.mark.parametrize("gathered", [0, 150, 10**6])
def test_small_and_large_strata_agree(spark, gathered):
    rows = rows_of(spark).where("s IS NOT NULL OR k < 120")
    got = models(probes.fitted(rows, ["s"], "g", "k", "y", "v", gathered=gathered))
    want = models(probes.fit_leaving_out(rows, ["s"], "g", "k", "y", "v"))
    assert set(got) == set(want) and all(np.abs(got[k] - want[k]).max() < 1e-6 for k in want)


@pytest.mark.parametrize(("values", "tasks"), [(1 << 20, 4), (250, 10)])
def test_tasks_of_a_pass_follow_the_rows(spark, monkeypatch, values, tasks):
    """Not the number of partitions that a shuffle left."""
    rows, seen, inner = rows_of(spark).repartition(40), [], fits._models
    monkeypatch.setattr(fits, "VALUES", values, raising=False)
    monkeypatch.setattr(fits, "_models", lambda frame, *rest: (seen.append((frame.rdd.getNumPartitions(), frame.count())), inner(frame, *rest))[1])
    got = models(probes.fitted(rows, ["s"], "g", "k", "y", "v", gathered=0))
    assert seen == [(tasks, 452)]
    want = models(probes.fit_leaving_out(rows, ["s"], "g", "k", "y", "v"))
    assert set(got) == set(want) and all(np.abs(got[k] - want[k]).max() < 1e-6 for k in want)


def test_evaluation_on_rows_that_were_held_out(spark):
    from wayline.operators import runs

    rows = rows_of(spark).where("s = 's'")
    found = {r.probe_name: r for r in runs.hold_out_evaluation(rows, ["s"], "k", "y", "v").collect()}
    dealt = {r.k: r for r in runs.hold_out(rows.where("y IS NOT NULL AND v IS NOT NULL"), "k", "y").collect()}
    train, test = [r for r in dealt.values() if not r.is_test], [r for r in dealt.values() if r.is_test]
    w, b = probes.fit_logistic(np.array([r.v for r in train]), np.array([r.y for r in train]), np.zeros(len(train)))
    z, y = np.array([r.v for r in test]) @ w + b, np.array([r.y for r in test])
    auc = np.mean([(p > q) + (p == q) / 2 for p in z[y == 1] for q in z[y == 0]])
    assert found["logistic"].n == len(test) and found["logistic"].auroc == pytest.approx(auc) and set(found) == {"logistic", "centroid"}
    assert found["logistic"].accuracy == pytest.approx(np.mean((z >= 0) == y))
