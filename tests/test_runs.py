"""Run records, artifacts, sinks and probes on small rows with known results."""

from __future__ import annotations

import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.operators import depth, metrics, probes, resample, runs, splits, validators
from wayline.sources import readers, sinks


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def npz(**arrays):
    raw = io.BytesIO()
    np.savez(raw, **arrays)
    return raw.getvalue()


def test_tensor_artifacts(spark, tmp_path):
    block = np.arange(6, dtype=np.float32).reshape(2, 3)
    (tmp_path / "a.npz").write_bytes(npz(layers=[32, 40], primary="last", last=block, first=block + np.nan))
    (tmp_path / "b.npz").write_bytes(npz(layers=[32], primary="last", last=block))
    (tmp_path / "c.npz").write_bytes(b"no archive")
    rows = readers.tensor_artifacts(spark, str(tmp_path)).collect()
    own = {r.layer: r for r in rows if r.source_file.endswith("a.npz")}
    assert own[40].vector == [3.0, 4.0, 5.0] and own[32].finite and own[32].sha256 == hashlib.sha256((tmp_path / "a.npz").read_bytes()).hexdigest() and own[32].checkpoint == "last"
    assert {r.source_file[-5:]: r.problem.split(" ")[0].rstrip(":") for r in rows if r.problem} == {"b.npz": "shape", "c.npz": "ValueError"}
    assert not any(r.finite for r in readers.tensor_artifacts(spark, str(tmp_path), "first", 3).where("source_file LIKE '%a.npz'").collect())
    path = own[32].source_file
    index = spark.createDataFrame([(path, own[32].sha256), (path.replace("a.npz", "b.npz"), "x"), (path.replace("a.npz", "z.npz"), "x")], "storage_path string, checksum_sha256 string")
    found = {r.storage_path[-5:]: r.problem for r in readers.checked_artifacts(index, readers.tensor_artifacts(spark, str(tmp_path))).collect()}
    assert found == {"b.npz": "shape 2x3", "z.npz": "missing"}


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replaced(spark, path, lambda p: spark.range(3).write.parquet(p))

    def fail(p):
        spark.range(9).write.parquet(p)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        sinks.replaced(spark, path, fail)
    assert spark.read.parquet(path).count() == 3
    sinks.replaced(spark, path, lambda p: spark.range(5).write.parquet(p))
    assert spark.read.parquet(path).count() == 5


def test_manifests_tiers_and_reports(spark, tmp_path):
    sinks.tiered_json(spark.createDataFrame([("definitive", "on", 1), ("exploratory", "off", 2)], "analysis_tier string, thinking_mode string, x int"), str(tmp_path / "live"))
    assert spark.read.json(str(tmp_path / "live" / "analysis_tier=definitive")).first().x == 1
    (tmp_path / "m" / "d").mkdir(parents=True)
    (tmp_path / "m" / "d" / "a.txt").write_text("a")
    manifest = spark.createDataFrame([("d/a.txt",), ("d/b.txt",), ("../live",)], "path string")
    assert {r.path for r in sinks.unresolved(manifest, str(tmp_path / "m")).collect()} == {"d/b.txt", "../live"}
    rows = spark.createDataFrame([("b|c", 0.123456789), ("a", None)], "name string, value double")
    assert sinks.markdown(rows, ["name", "value"], ["name"]) == "| name | value |\n|---|---|\n| a |  |\n| b\\|c | 0.123457 |\n"
    with pytest.raises(ValueError, match="more than 1"):
        sinks.markdown(rows, ["name"], ["name"], most=1)
    assert readers.tier_paths("/r/", ["definitive"], ["on", "off"]) == ["/r/definitive/on", "/r/definitive/off"]


def test_an_unknown_version_is_an_error(spark):
    rows = spark.createDataFrame([("v1", 1), ("v9", 2)], "v string, x int")
    with pytest.raises(Exception, match="unknown version v9"):
        runs.by_version(rows, "v", {"v1": lambda r: r.select("x")}).collect()
    with pytest.raises(Exception, match="unsupported outcome"):
        runs.score_rows(spark.createDataFrame([("odd", 1, True, 2)], "outcome_class string, unsafe_action_executed int, injection_present boolean, hop_index int")).collect()


def test_results_apply_to_their_events_only(spark):
    events = spark.createDataFrame([(1, "a", False, None), (2, "b", False, True)], "k int, message string, model_called boolean, reasoning_label boolean")
    out = {r.k: (r.message, r.model_called, r.generation_mode, r.reasoning_label) for r in runs.applied_results(events, spark.createDataFrame([(1, "x")], "k int, message string"), ["k"], ["message"]).collect()}
    assert out == {1: ("x", True, "real", None), 2: ("b", False, None, True)}


def test_times_domains_and_orders(spark):
    r = one(spark, a=validators.utc(F.lit("2026-01-02T03:04:05Z")), b=validators.utc(F.lit("2026-01-02T03:04:05+02:00")), c=validators.utc(F.lit("2026-01-02T03:04:05")), d=validators.utc(F.lit("soon")))
    assert r.a == r.c and (r.a - r.b).total_seconds() == 7200 and r.d is None
    assert validators.parsed_domains("all", ["x", "y"]) == ["x", "y"] and validators.parsed_domains("y, x,y", ["x", "y"]) == ["y", "x"]
    for bad in ("z", "", "x,z"):
        with pytest.raises(ValueError):
            validators.parsed_domains(bad, ["x", "y"])
    rows = spark.createDataFrame([("worker_1",), ("other",), ("planner_1",)], "a string")
    assert [r.a for r in validators.in_order(rows, "a", ["planner_1", "worker_1"], "a").collect()] == ["planner_1", "worker_1", "other"]
    with pytest.raises(ValueError):
        validators.selected_repairs(rows, ["a"], scope="some")


def test_smoke_repairs_are_the_planner_pair(spark):
    plan = spark.createDataFrame([("p", "off", "planner_1", "pending", 1), ("p", "off", "planner_1", "done", 2), ("p", "on", "planner_1", "pending", 3), ("q", "off", "planner_1", "pending", 4)], "matched_pair_id string, thinking_mode string, agent_id string, status string, k int")
    assert [r.k for r in validators.selected_repairs(plan, ["k"], "smoke_pair", smoke_pair="p").collect()] == [1] and validators.selected_repairs(plan, ["k"]).count() == 3
    assert [r.k for r in validators.selected_repairs(plan, ["k"], most=2).collect()] == [1, 3]


def test_metadata_that_contradicts_the_id_gives_no_protocol(spark):
    i = F.lit("t__prompt_neutral_v1__gen_controlled_v2__thinking_off")
    r = one(spark, a=validators.generation_protocol(i, F.lit(None).cast("string")), b=validators.generation_protocol(i, F.lit("other")), c=validators.prompt_profile(i, F.lit("neutral_v1")), d=validators.generation_protocol(F.lit("t"), F.lit("stated")))
    assert (r.a, r.b, r.c, r.d) == ("controlled_v2", None, "neutral_v1", "stated")


# --- the depth report


def predictions(spark, groups=6, fired=lambda g, hop: g % 3 != 2 if hop == "2-hop" else g % 3 == 0):
    """Trajectories of groups by chain length and condition, with scores that tell executed actions from the others well
    at two hops and hardly at three."""
    scores = {
        ("2-hop", "fired"): (0.1, 0.75, 0.9), ("2-hop", "injected"): (0.1, 0.45, 0.35), ("2-hop", "clean"): (0.05, 0.1, 0.1),
        ("3-hop", "fired"): (0.1, 0.5, 0.55, 0.55), ("3-hop", "injected"): (0.1, 0.45, 0.55, 0.6), ("3-hop", "clean"): (0.1, 0.25, 0.35, 0.45),
    }
    rows = []
    for g in range(groups):
        for hop in ("2-hop", "3-hop"):
            for condition in ("clean", "injected"):
                hit = condition == "injected" and fired(g, hop)
                agents = ("planner_1", "worker_1", "executor_1") if hop == "2-hop" else ("planner_1", "worker_1", "worker_2", "executor_1")
                outcome = "executed" if hit else "resisted" if condition == "injected" else "clean"
                for i, (agent, s) in enumerate(zip(agents, scores[hop, "fired" if hit else condition], strict=True)):
                    rows.append((f"{g}-{hop}-{condition}", f"g{g}", f"d{g % 2}", f"w{g % 3}", condition, condition == "injected", hop, agent, agent.split("_")[0], i, i - 1, "worker_1", 1, "m", "off", 40, "p", s, int(hit), "trajectory_action_executed", outcome, hit, "not_candidate", 42, "exploratory"))
    kind = (
        "trajectory_id string, match_group_id string, domain_id string, wording_id string, condition string, injection_present boolean, hop_mode string, agent_id string, agent_role string, hop_index int, distance_from_injection int, "
        "anchor_agent_id string, anchor_hop_index int, model string, thinking_mode string, layer int, probe_name string, score double, label int, label_target string, behavioral_outcome string, action_fired boolean, latent_compromise_status string, seed int, analysis_tier string"
    )
    return spark.createDataFrame(rows, kind)


def test_three_hops_discriminate_worse(spark):
    p = predictions(spark)
    found = depth.depth_metrics(p)
    rest = [s for s in depth.STRATA if s != "hop_mode"]
    delta = depth.depth_deltas(found, rest).first()
    assert delta.auroc < 0 < delta.brier and found.count() == 2
    two = found.where("hop_mode = '2-hop'").first()
    assert (two.n_trajectories, two.n_match_groups, two.n_positive, two.n_negative) == (12, 6, 4, 8) and two.auroc == 1.0
    assert two.temporal_pre_anchor_mean == pytest.approx(np.mean([0.1] * 6 + [0.05] * 6)) and two.temporal_post_anchor_mean == pytest.approx(np.mean([0.825] * 4 + [0.4] * 2 + [0.1] * 6)) and two.temporal_persistence_mean == 1.0
    assert [tuple(r) for r in depth.sampling_grid(p).collect()] == [(6, 2, 3, 6, True)] and depth.violations(p).count() == 0


def test_metrics_without_replicates_hold_nothing_by_cluster(spark):
    p = predictions(spark)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan(depth.depth_counts(p, ["hop_mode"])) and "Window" not in plan(depth.vectors(p, ["hop_mode"], replicates=0))
    drawn = {r.hop_mode: r for r in depth.vectors(p, ["hop_mode"], replicates=2).collect()}
    for r in depth.depth_metrics(p, ["hop_mode"]).collect():
        assert [r[m] for m in depth.METRICS] == pytest.approx([drawn[r.hop_mode][m][0] for m in depth.METRICS])


def test_one_file_of_customers_is_many_tasks(spark, tmp_path):
    from wayline.plans.depth_report import agent_scores
    from wayline.plans.frames import dealt

    c = spark.range(5000).select(F.col("id").alias("c_custkey"), (F.col("id") * 1.5).alias("c_acctbal"))
    c.coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    rows = agent_scores(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and rows.select("k").distinct().count() == 5000
    assert dealt(spark.read.parquet(str(tmp_path / "customer.parquet")), "c_custkey", 4096).rdd.getNumPartitions() >= 8  # more for more bytes


def test_without_positives_ranks_are_unknown(spark):
    p = predictions(spark, fired=lambda g, hop: False)
    r = {(x.hop_mode, x.metric): x for x in depth.report(p, replicates=8).collect()}
    assert r["2-hop", "auroc"].value is None and r["2-hop", "auroc"].low is None and r["3-hop_minus_2-hop", "auroc"].value is None
    assert r["2-hop", "brier"].low <= r["2-hop", "brier"].value <= r["2-hop", "brier"].high and len(r) == 33


def test_replicates_are_those_of_copied_rows(spark):
    p = predictions(spark)
    by = ["hop_mode"]
    weights = {(r.replicate, r.match_group_id): r.weight for r in resample.cluster_weights(p, "match_group_id", 4, 42).collect()}
    rows = depth.trajectories(p, by).collect()
    for r in depth.bootstrap(p, by, replicates=4).collect():
        own = [t for t in rows if t.hop_mode == r.hop_mode for _ in range(weights.get((r.replicate, t.match_group_id), 0))]
        y = np.array([t.label for t in own])
        for kind, s in (("", np.array([t.executor_score for t in own])), ("path_mean_", np.array([t.post_anchor_mean for t in own]))):
            assert r[f"{kind}brier"] == pytest.approx(np.mean((s - y) ** 2))
            bins = (s[:, None] >= np.array(metrics.edges(10)[1:])).sum(axis=1)
            assert r[f"{kind}ece"] == pytest.approx(sum(abs((s - y)[bins == b].sum()) for b in range(10)) / len(s), abs=1e-9)
            pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
            assert r[f"{kind}auroc"] == (pytest.approx(np.mean(pairs)) if pairs else None)
        assert r.temporal_divergence_mean == pytest.approx(np.mean([t.divergence for t in own])) and r.temporal_peak_shift_mean == pytest.approx(np.mean([t.peak_shift for t in own]))


@pytest.mark.parametrize(("column", "value", "rule"), [
    ("score", 1.5, "score"), ("hop_mode", "4-hop", "allowed:hop_mode"), ("anchor_hop_index", 2, "anchor"), ("distance_from_injection", 5, "distance"), ("action_fired", None, "action_known"), ("latent_compromise_status", "candidate", "latent_of_outcome"),
    ("agent_id", "worker_9", "agent_order"), ("wording_id", "w9", "depends"), ("layer", 41, "depends"), ("analysis_tier", "definitive", "one_value:analysis_tier"), ("match_group_id", "g9", "cells"), ("label", 1, "label_of_target"),
])
def test_one_changed_prediction_breaks_its_rule(spark, column, value, rule):
    p = predictions(spark)
    hit = (F.col("trajectory_id") == "0-2-hop-clean") & ((F.col("hop_index") == 1) | F.lit(column == "match_group_id"))
    changed = p.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)).cast(p.schema[column].dataType))
    assert rule in {r.rule_id for r in depth.violations(changed).collect()}


# --- probes


def layered(signal=(0.0, 4.0), n=80, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        label = i // 4 % 2
        for layer, s in zip((32, 40), signal, strict=True):
            out.append((i, i % 4, label, layer, "off", (rng.normal(size=3) + np.array([s * label, 0, 0])).tolist(), f"{i % 4}-{i // 8}"))
    return out


KIND = "k int, grp int, label int, layer int, mode string, v array<double>, pair string"


def test_layers_are_scanned_with_refits(spark):
    rows = spark.createDataFrame(layered(), KIND)
    flat = rows.withColumns({"mode": F.lit("flat"), "label": F.lit(1)})
    got = {(r["mode"], r.layer, r.probe_name): r for r in probes.layer_scan(rows.unionByName(flat), ["mode"], "layer", "grp", "k", "label", "v", ["logistic", "contrast"], "pair").collect()}
    assert len(got) == 8 and got["off", 40, "logistic"].pooled_auroc > 0.95 > 0.75 > got["off", 32, "logistic"].pooled_auroc and got["off", 40, "contrast"].n == 80
    assert got["flat", 40, "logistic"].status == "skipped" and got["flat", 40, "logistic"].reason == "single_class" and got["flat", 40, "logistic"].pooled_auroc is None


def test_scores_are_those_of_an_independent_fit(spark):
    rows = [r for r in layered() if r[3] == 40]
    got = {r.k: r.score for r in probes.scored_layers(spark.createDataFrame(rows, KIND), ["layer"], "grp", "k", "label", "v", ["logistic"]).collect()}
    x, y, g = np.array([r[5] for r in rows]), np.array([r[2] for r in rows]), np.array([r[1] for r in rows])
    for held in range(4):
        train = g != held
        mean, sd = x[train].mean(axis=0), x[train].std(axis=0)
        z = np.hstack([(x - mean) / sd, np.ones((len(x), 1))])
        w = np.zeros(4)
        for _ in range(20_000):  # plain gradient descent on |w|^2 / 2 + the sum of log losses
            p = 1 / (1 + np.exp(-z[train] @ w))
            w -= 0.01 * (np.append(w[:3], 0) + z[train].T @ (p - y[train]))
        want = 1 / (1 + np.exp(-z[~train] @ w))
        assert np.allclose([got[r[0]] for r in rows if r[1] == held], want, atol=1e-5)


def test_cohorts_filter_folds_or_refit(spark):
    rows = spark.createDataFrame([r for r in layered() if r[3] == 40], KIND)
    got = {(r.cohort, r.kind): r for r in probes.cohort_refits(rows, {"all": [0, 1, 2, 3], "two": [0, 1]}, "grp", "k", "label", "v").collect()}
    assert set(got) == {(c, k) for c in ("all", "two") for k in ("fold_filter", "full_refit")}
    assert got["all", "fold_filter"].pooled_auroc == pytest.approx(got["all", "full_refit"].pooled_auroc) and got["two", "full_refit"].n == 40
    scored = probes.scored_layers(rows, ["layer"], "grp", "k", "label", "v", ["logistic"]).where("grp < 2")
    assert got["two", "fold_filter"].pooled_auroc == pytest.approx(metrics.auroc(scored, []).first().auroc)


def test_folds_keep_pairs_whole(spark):
    rows = spark.createDataFrame([r for r in layered() if r[3] == 40], KIND)
    folded = splits.group_folds(rows, "pair", 5, 1)
    assert folded.groupBy("pair").agg(F.countDistinct("fold").alias("n")).where("n <> 1").count() == 0 and {r.fold for r in folded.collect()} == set(range(5))
    got = {(r.probe_name, r.scheme): r for r in probes.baselines(rows, ["layer"], "grp", "pair", "k", "label", "v").collect()}
    assert len(got) == 6 and all(r.pooled_auroc > 0.9 and r.n == 80 and r.accuracy > 0.8 for r in got.values()) and got["pca", "leave_group_out"].n_folds == 4


def test_directions_and_places(spark):
    models = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "weights array<double>")
    assert [r.direction for r in probes.directions(models).collect()] == [[0.6, 0.8], [0.0, 0.0]]
    out = probes.projected(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), "v", np.array([[1.0, 0.0], [0.5, 0.5]])).first()
    assert (out.pc1, out.pc2) == (1.0, 1.5)


def test_a_bounded_fit_takes_the_smallest_hashes(spark):
    rows = spark.range(5000).selectExpr("id", "CAST(id % 2 AS string) AS s")
    got = probes._bounded(rows, ["s"], "id", 100)
    assert [r.n for r in got.groupBy("s").agg(F.count("*").alias("n")).collect()] == [100, 100]
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 53))
    want = {r.id for s in "01" for r in rows.where(F.col("s") == s).orderBy(place).limit(100).collect()}
    assert {r.id for r in got.collect()} == want


def test_generated_text_becomes_a_result(spark):
    raw = "<think>why</think> done <tool_call>" + json.dumps({"name": "submit", "arguments": {"a": 1}}) + "</tool_call>"
    r = one(spark, g=runs.generation_result(F.lit(raw), F.lit(None).cast("string"), F.lit(10), F.lit(10), ["submit"]), h=runs.generation_result(F.lit("x"), F.lit("stop"), F.lit(10), F.lit(10)))
    assert (r.g.thinking, r.g.complete, r.g.truncated, r.g.finish_reason, r.g.calls[0].recognized) == ("why", True, True, "length", True) and (r.h.final, r.h.thinking, r.h.truncated) == ("x", None, False)


def test_folders_and_unreadable_documents(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        readers.json_folder(spark, str(tmp_path / "empty"), "a int")
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "b.jsonl").write_text('{"a": 2}\n\n')
    (tmp_path / "x" / "a.jsonl").write_text('{"a": 1}\n')
    assert [r.a for r in readers.json_folder(spark, str(tmp_path / "x"), "a int").orderBy("source_file").collect()] == [1, 2]
    (tmp_path / "y").mkdir()
    (tmp_path / "y" / "step_1.json").write_text('{"a": 1}')
    (tmp_path / "y" / "step_2.json").write_text("{broken")
    assert [r.a for r in readers.json_documents(spark, str(tmp_path / "y"), "a int", strict=False, pattern="step_*.json").collect()] == [1]


def test_cohorts_of_probes(spark):
    from wayline.operators import contracts

    kind = "trajectory_id string, step_index int, checkpoint string, analysis_tier string, label int, layers array<int>"
    good = [("a", 0, "c", "x", 1, [1, 2]), ("a", 1, "c", "x", 0, [2, 3]), ("b", 0, "c", "x", 0, [2])]
    found = lambda rows: {r.rule_id for r in contracts.cohort(spark.createDataFrame(rows, kind), ["trajectory_id", "step_index"], "label", "layers").collect()}
    assert found(good) == set()
    assert found([*good, ("a", 0, "c", "x", 1, [2])]) == {"unique"} and found([*good, ("d", 0, "e", None, None, [2])]) == {"one_value:checkpoint", "one_value:analysis_tier", "allowed:label"}
    assert found([*good, ("d", 0, "c", "x", 1, [9])]) == {"common_layer"}


def test_controls_over_modes_and_prompts(spark):
    from wayline.operators import contracts, controls

    per = spark.createDataFrame([("p", "off", True), ("p", "on", None), ("q", "off", True)], "k string, m string, passed boolean")
    assert {r.k: (r.n_modes, r.passed) for r in controls.strict_overall(per, ["k"]).collect()} == {"p": (2, False), "q": (1, True)}
    rows = spark.createDataFrame([("a", "c", "h"), ("a", "i", "h"), ("b", "c", "h"), ("b", "i", "g"), ("d", "c", "h")], "k string, t string, h string")
    assert {r.k for r in controls.prompt_mismatches(rows, ["k"], "t", "c", "i", "h").collect()} == {"b", "d"}
    configs = spark.createDataFrame([("off", "x", 1), ("off", "x", 2)], "thinking_mode string, model string, seed int")
    assert {(r.rule_id, r.detail) for r in contracts.equal_configs(configs, "thinking_mode", ["off", "on"], ["model", "seed"]).collect()} == {("depends", "seed"), ("covers:thinking_mode", "off")}
