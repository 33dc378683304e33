from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import depth, resample


def scored(spark, n=900, seed=3):
    rng = np.random.default_rng(seed)
    rows = [("ab"[int(i % 3 == 0)], f"c{rng.integers(7 if i % 3 else 3)}{'ab'[int(i % 3 == 0)]}", float(rng.integers(0, 60)) / 60, int(rng.random() < 0.4)) for i in range(n)]
    rows += [("a", "c0a", 0.5, None), (None, "x", 0.2, 1), (None, "y", 0.1, 0), (None, "y", 0.1, 0), ("one", "z", 0.3, 1)]
    return spark.createDataFrame(rows, "g string, c string, score double, label int")


def auc(pos, neg):
    return None if not len(pos) or not len(neg) else float(((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)).mean())


def test_every_stratum_draws_its_own_clusters(spark):
    rows = scored(spark)
    held = [r.asDict() for r in rows.collect() if r.label is not None]
    weights = {}
    for r in resample.cluster_weights(rows, "c", 40, 5, ["g"]).where("g IS NOT NULL").collect():
        weights.setdefault((r.g, r.replicate), {})[r.c] = r.weight
    assert {g: {sum(w.values()) for (h, _), w in weights.items() if h == g} for g in ("a", "b", "one")} == {"a": {7}, "b": {3}, "one": {1}}
    got = resample.bootstrap_auroc(rows, ["g"], "c", 40, 5).collect()
    assert len(got) == 4 * 40
    for r in got:
        if r.g is None:
            assert r.auroc in (None, 1.0)
            continue
        own = [h for h in held if h["g"] == r.g for _ in range(weights[r.g, r.replicate].get(h["c"], 0))]
        s, y = np.array([h["score"] for h in own]), np.array([h["label"] for h in own])
        assert r.auroc == (pytest.approx(expected) if (expected := auc(s[y == 1], s[y == 0])) is not None else None)


def test_ranges_of_scores_do_not_change_the_result(spark):
    rows = scored(spark)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        seen = []
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, resample.bootstrap_auroc(rows, ["g"], "c", 9, 1).selectExpr("g", "replicate", "round(auroc, 10) AS a").collect())))
        assert seen[0] == seen[1]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_small_stratum_is_never_without_clusters(spark):
    """Strata of 2 and 20 clusters: the small one has a value in every replicate."""
    rows = spark.createDataFrame([("small" if c < 2 else "large", f"c{c:02}", i / 10, i % 2) for c in range(22) for i in range(10)], "g string, c string, score double, label int")
    counts = {r.g: r.n for r in resample.bootstrap_auroc(rows, ["g"], "c", 200).groupBy("g").agg(F.count("auroc").alias("n")).collect()}
    assert counts == {"small": 200, "large": 200}


def test_clusters_of_both_chain_lengths_must_agree(spark):
    from tests.test_runs import predictions

    p = predictions(spark)
    odd = p.where("NOT (match_group_id = 'g5' AND hop_mode = '3-hop')")
    assert [(r.match_group_id, r.sides) for r in depth.coverage_violations(odd).collect()] == [("g5", ["2-hop"])] and depth.coverage_violations(p).count() == 0
    with pytest.raises(Exception, match="same clusters"):
        depth.report(odd, replicates=3).collect()
    left = depth.report(odd, replicates=3, strict=False).collect()
    assert {r.record for r in left} == {"depth"} and len(left) == 22
    assert depth.coverage_violations(p.where("hop_mode = '2-hop'")).count() == 0


def test_paired_differences_draw_the_same_clusters(spark):
    from tests.test_runs import predictions

    p = predictions(spark)
    samples = {(r.hop_mode, r.replicate): r for r in depth.bootstrap(p, ["hop_mode"], replicates=30).collect()}
    apart = [samples["3-hop", k].brier - samples["2-hop", k].brier for k in range(30)]
    r = next(r for r in depth.report(p, ["hop_mode"], replicates=30).collect() if r.record == "delta" and r.metric == "brier")
    assert (r.low, r.high) == (pytest.approx(np.quantile(apart, 0.025)), pytest.approx(np.quantile(apart, 0.975))) and r.n == 30


# --- single rows


def test_draws_of_rows_are_multinomial(spark):
    rows, replicates = scored(spark), 400
    cells = resample.row_draws(rows, ["g"], replicates, 2).collect()
    for g in ("a", "b", None, "one"):
        own = [c for c in cells if c.g == g]
        n = sum(c.w1 + c.w0 for c in own)
        drawn = np.array([d for c in own for d in (c.drawn1, c.drawn0)])
        size = np.array([w for c in own for w in (c.w1, c.w0)])
        assert (drawn.sum(axis=0) == n).all() and (drawn[size == 0] == 0).all()
        if n > 100:
            live = size > 0
            expected = replicates * size[live]
            chi = ((drawn[live].sum(axis=1) - expected) ** 2 / expected).sum()
            k = live.sum() - 1
            assert abs(chi - k) < 5 * np.sqrt(2 * k)  # of k degrees of freedom
            spread = drawn[live].var(axis=1) / (size[live] * (1 - size[live] / n))
            assert 0.9 < spread.mean() < 1.1


def test_row_bootstrap_spreads_as_copied_rows_do(spark):
    rows = scored(spark)
    held = np.array([(r.score, r.label) for r in rows.where("g = 'a' AND label IS NOT NULL").collect()])
    rng, plain = np.random.default_rng(0), []
    for _ in range(400):
        own = held[rng.integers(len(held), size=len(held))]
        plain.append(auc(own[own[:, 1] == 1, 0], own[own[:, 1] == 0, 0]))
    got = [r.auroc for r in resample.row_bootstrap_auroc(rows, ["g"], 400, 9).where("g = 'a'").collect()]
    assert len(got) == 400 and abs(np.mean(got) - np.mean(plain)) < 4 * np.std(plain) / 20 and 0.85 < np.std(got) / np.std(plain) < 1.18
    cells = resample.row_draws(rows, ["g"], 400, 9).where("g = 'a'").orderBy("score").collect()
    for k in (0, 17, 399):
        pos, neg = np.repeat([c.score for c in cells], [c.drawn1[k] for c in cells]), np.repeat([c.score for c in cells], [c.drawn0[k] for c in cells])
        assert auc(pos, neg) == pytest.approx(got[k])


def test_row_bootstrap_has_no_global_list_and_repeats(spark):
    rows = scored(spark)
    made = resample.row_bootstrap_auroc(rows, ["g"], 5, 1)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
    again = resample.row_bootstrap_auroc(rows.repartition(7), ["g"], 5, 1)
    assert sorted(map(str, made.collect())) == sorted(map(str, again.collect()))
    assert resample.row_bootstrap_auroc(rows.limit(0), ["g"], 5).count() == 0
    one = {r.auroc for r in resample.row_bootstrap_auroc(rows.where("g = 'one'"), [], 5).collect()}
    assert one == {None}
