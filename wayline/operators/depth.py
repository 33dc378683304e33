"""The depth report: eleven metrics of scored trajectories at two chain lengths, their differences, and intervals of both
by resampling clusters.

A prediction row is one agent's score in a trajectory. A trajectory is classified by its executor's score, and by the
mean of its scores from the anchor on (``path_mean``); its temporal statistics compare the scores before the anchor with
those from it on. Clusters are drawn from each stratum's own. All replicates are computed at once, as vectors: everything
but the ranks is a sum that clusters add up to, and ranks are prefix sums over counts of (cluster, score).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators import metrics, resample

# Fixed values.
EXECUTOR = "executor_1"
STRATA = ("model", "thinking_mode", "label_target", "probe_name", "layer", "seed", "hop_mode")
TEMPORAL = ("pre_anchor_mean", "post_anchor_mean", "divergence", "peak_shift", "persistence")
CLASSIFIED = ("auroc", "brier", "ece")
METRICS = (*CLASSIFIED, *(f"path_mean_{m}" for m in CLASSIFIED), *(f"temporal_{t.removesuffix('_mean')}_mean" for t in TEMPORAL))
_KINDS = ("", "path_mean_")


def trajectories(predictions: DataFrame, by: Sequence[str], key: str = "trajectory_id", cluster: str = "match_group_id", margin: float = 0.0) -> DataFrame:
    """(by, key, cluster, label, outcome, executor_score, n_executors, pre_anchor_mean, post_anchor_mean, divergence,
    peak_shift, persistence): one row for each trajectory of a stratum, from rows with agent_id, hop_index,
    anchor_hop_index, score, label and behavioral_outcome. A chain has a handful of agents, whose scores are gathered."""
    executor = F.col("agent_id") == EXECUTOR
    per = predictions.groupBy(*by, key).agg(
        F.min(cluster).alias(cluster), F.max("label").alias("label"), F.min("behavioral_outcome").alias("outcome"), F.max(F.when(executor, F.col("score"))).alias("executor_score"), F.count_if(executor).alias("n_executors"),
        F.min("anchor_hop_index").alias("_at"), F.array_sort(F.collect_list(F.struct("hop_index", "score"))).alias("_s"),
    )
    side = lambda test: F.transform(F.filter("_s", test), lambda s: s["score"])
    sided = per.withColumns({"_pre": side(lambda s: s["hop_index"] < F.col("_at")), "_post": side(lambda s: s["hop_index"] >= F.col("_at"))})
    avg = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda x, y: x + y), F.size(a))
    out = sided.withColumns({"pre_anchor_mean": avg("_pre"), "post_anchor_mean": avg("_post")})
    above = F.size(F.filter("_post", lambda s: s > F.col("pre_anchor_mean") + margin))
    return out.withColumns({
        "divergence": F.col("post_anchor_mean") - F.col("pre_anchor_mean"), "peak_shift": F.array_max("_post") - F.col("pre_anchor_mean"),
        "persistence": F.when(F.col("pre_anchor_mean").isNotNull(), F.try_divide(above.cast("double"), F.size("_post"))),
    }).drop("_pre", "_post", "_s", "_at")


def _classified(rows: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """(by, kind, cluster, score, label): the two scores of each labelled trajectory."""
    two = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("score")) for k, c in zip(_KINDS, (F.col("executor_score"), F.col("post_anchor_mean")), strict=True)]))
    return rows.where("label IS NOT NULL").select(*by, cluster, "label", two.alias("e")).select(*by, "e.kind", cluster, "e.score", "label")


def _placed_by(rows: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """Trajectories with the place of their cluster among those of their stratum, as ``_i`` and ``_n``."""
    return resample._placed(rows, resample.places(rows, by, cluster), by, cluster)


def vectors(predictions: DataFrame, by: Sequence[str] = STRATA, key: str = "trajectory_id", cluster: str = "match_group_id", replicates: int = 1000, seed: int = 42, n_bins: int = 10) -> DataFrame:
    """(by, the eleven metrics): each an array of the metric as it is and in every replicate, null without a value.

    A replicate draws as many of the stratum's own clusters as it has, with replacement. Strata of the same clusters draw
    the same ones, so that differences of replicates are paired.
    """
    rows = trajectories(predictions, by, key, cluster)
    if replicates:
        rows = _placed_by(rows, by, cluster)
        scored = _classified(rows, by, "_i").join(resample.places(rows, by, cluster).select(*by, "_n").distinct(), list(by))
    else:  # nothing is drawn: all clusters count as one, however many there are
        one = {"_i": F.lit(0).cast("long"), "_n": F.lit(1).cast("long")}
        rows = rows.where(F.col(cluster).isNotNull()).withColumns(one)
        scored = _classified(rows, by, "_i").withColumn("_n", one["_n"])
    d = metrics.exact(F.col("score")) - F.col("label").cast("decimal(1,0)")
    cells = scored.groupBy(*by, "kind", "_i", "_n", metrics.bin_of(F.col("score"), n_bins).alias("bin")).agg(
        F.count("*").alias("n"), F.sum((d * d).cast("decimal(28,18)")).cast("double").alias("square"), F.sum(d).cast("double").alias("apart")
    )
    sums = rows.groupBy(*by, "_i", "_n").agg(F.count("*").alias("n"), *[F.sum(t).alias(t) for t in TEMPORAL])
    slot = lambda at, **named: F.array(*[F.struct((at + F.lit(k)).cast("int").alias("slot"), F.col(c).cast("double").alias("value")) for k, c in enumerate(named.values())])
    base = F.when(F.col("kind") == "", 0).otherwise(3 * n_bins) + 3 * F.col("bin")
    first = 6 * n_bins
    long = cells.select(*by, "_i", "_n", F.inline(slot(base, a="n", b="square", c="apart"))).unionByName(
        sums.select(*by, "_i", "_n", F.inline(slot(F.lit(first), n="n", **{t: t for t in TEMPORAL})))
    )
    stratum = resample._keyed(by)
    summed = resample.sum_vectors(long, stratum, first + 1 + len(TEMPORAL), replicates, seed)
    counts = metrics.score_counts(scored, [*by, "kind", "_i", "_n"], "score", "label")
    found = resample.auroc_vectors(counts, F.concat("kind", F.lit(" "), stratum), replicates, seed)
    ranked = found.select(F.substring_index("_key", " ", 1).alias("kind"), F.expr("substring(_key, instr(_key, ' ') + 1)").alias("_key"), "auroc")
    ranked = ranked.groupBy("_key").agg(*[F.first(F.when(F.col("kind") == k, F.col("auroc")), ignorenulls=True).alias(f"{k}auroc") for k in _KINDS])
    get = lambda at: F.get("sums", F.lit(at))
    zipped = lambda a, b, f: F.zip_with(a, b, f)
    total = lambda ats, f=lambda x: x: reduce(lambda a, b: zipped(a, b, lambda x, y: x + y), [F.transform(get(at), f) for at in ats])
    ratio = lambda a, b: zipped(a, b, lambda x, y: F.try_divide(x, y))
    out = {}
    for k, at in zip(_KINDS, (0, 3 * n_bins), strict=True):
        n = total([at + 3 * b for b in range(n_bins)])
        out[f"{k}brier"] = ratio(total([at + 3 * b + 1 for b in range(n_bins)]), n)
        out[f"{k}ece"] = ratio(total([at + 3 * b + 2 for b in range(n_bins)], F.abs), n)
    out |= {name: ratio(get(first + 1 + i), get(first)) for i, name in enumerate(METRICS[6:])}
    strata = rows.select(*by).distinct().withColumn("_key", stratum)
    every = strata.join(summed.select("_key", *[c.alias(n) for n, c in out.items()]), "_key").join(ranked, "_key", "left")
    empty = F.array_repeat(F.lit(None).cast("double"), replicates + 1)
    return every.select(*by, *[F.coalesce(m, empty).alias(m) if m.endswith("auroc") else m for m in METRICS])


def depth_counts(predictions: DataFrame, by: Sequence[str] = STRATA, key: str = "trajectory_id", cluster: str = "match_group_id") -> DataFrame:
    """(by, counts) of each stratum's trajectories, match groups, labels and classes."""
    known = F.col("label").isNotNull()
    return trajectories(predictions, by, key, cluster).groupBy(*by).agg(
        F.count("*").alias("n_trajectories"), F.countDistinct(cluster).alias("n_match_groups"), F.count_if(known).alias("n_predictions"), F.count_if(~known).alias("n_excluded_unlabeled"),
        F.count_if(F.col("outcome") == "indeterminate").alias("n_indeterminate"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("label") == 0).alias("n_negative"),
    )


def depth_metrics(predictions: DataFrame, by: Sequence[str] = STRATA, key: str = "trajectory_id", cluster: str = "match_group_id", n_bins: int = 10) -> DataFrame:
    """(by, counts, the eleven metrics) of each stratum. A metric that needs a class that is absent is null."""
    found = vectors(predictions, by, key, cluster, 0, 0, n_bins).select(*by, *[F.get(m, F.lit(0)).alias(m) for m in METRICS])
    return depth_counts(predictions, by, key, cluster).join(found, list(by))


def bootstrap(predictions: DataFrame, by: Sequence[str] = STRATA, key: str = "trajectory_id", cluster: str = "match_group_id", replicates: int = 1000, seed: int = 42, n_bins: int = 10) -> DataFrame:
    """(by, replicate, the eleven metrics): each replicate draws as many of the stratum's clusters as it has, and recomputes
    everything."""
    return resample.by_replicate(vectors(predictions, by, key, cluster, replicates, seed, n_bins), by, METRICS)


def depth_deltas(snapshots: DataFrame, by: Sequence[str], over: str = "hop_mode", low: str = "2-hop", high: str = "3-hop", names: Sequence[str] = METRICS) -> DataFrame:
    """(by, the metrics): each metric at the longer chain less that at the shorter one, null if either is. A stratum
    without one of the two does not appear."""
    side = lambda v, n: F.max(F.when(F.col(over) == v, F.col(n)))
    wide = snapshots.where(F.col(over).isin(low, high)).groupBy(*by).agg(*[(side(high, n) - side(low, n)).alias(n) for n in names], F.countDistinct(over).alias("_sides"))
    return wide.where("_sides = 2").drop("_sides")


def coverage_violations(predictions: DataFrame, by: Sequence[str] = STRATA, cluster: str = "match_group_id", over: str = "hop_mode", low: str = "2-hop", high: str = "3-hop") -> DataFrame:
    """(by without ``over``, cluster, sides): the clusters of a comparison that only one of its two chain lengths has."""
    rest = [b for b in by if b != over]
    held = predictions.where(F.col(over).isin(low, high)).groupBy(*rest, cluster).agg(F.collect_set(over).alias("sides"))
    both = predictions.where(F.col(over).isin(low, high)).groupBy(*rest).agg(F.countDistinct(over).alias("_n")).where("_n = 2")
    return held.where(F.size("sides") < 2).join(both, rest, "left_semi") if rest else held.where(F.size("sides") < 2).join(both, how="left_semi")


def report(
    predictions: DataFrame, by: Sequence[str] = STRATA, key: str = "trajectory_id", cluster: str = "match_group_id", replicates: int = 1000, confidence: float = 0.95, seed: int = 42, n_bins: int = 10, strict: bool = True
) -> DataFrame:
    """(record, by, metric, value, n, low, high): every metric of every stratum (``depth``) and every difference of the
    two chain lengths (``delta``, its hop_mode ``3-hop_minus_2-hop``), with intervals of replicates (percentiles by linear
    interpolation; ``n`` replicates have a value).

    Both chain lengths of a comparison must have the same clusters, which then are drawn together; where they differ the
    report fails, or leaves the comparison out if not ``strict``.
    """
    rest = [b for b in by if b != "hop_mode"]
    found = vectors(predictions, by, key, cluster, replicates, seed, n_bins)
    odd = coverage_violations(predictions, by, cluster).select(*rest).distinct().withColumn("_odd", F.lit(True))
    # A comparison's strata stand in one row, so that what they and their difference need is computed once.
    sides = found.groupBy(*rest).agg(F.collect_list(F.struct("hop_mode", *METRICS)).alias("_s"))
    side = lambda hop: F.get(F.filter("_s", lambda s: s["hop_mode"] == hop), F.lit(0))
    sides = sides.withColumns({"_2": side("2-hop"), "_3": side("3-hop")})
    sides = sides.join(odd, rest, "left") if rest else sides.join(odd, how="left")
    both = F.col("_2").isNotNull() & F.col("_3").isNotNull()
    if strict:
        both = both & F.when(F.col("_odd"), F.raise_error(F.lit("a comparison of chain lengths needs the same clusters on both sides")).cast("boolean")).otherwise(True)
    else:
        both = both & F.col("_odd").isNull()
    apart = F.struct(F.lit("delta").alias("record"), F.lit("3-hop_minus_2-hop").alias("hop_mode"), *[F.zip_with(F.col("_3")[m], F.col("_2")[m], lambda x, y: x - y).alias(m) for m in METRICS])
    kept = F.transform("_s", lambda s: F.struct(F.lit("depth").alias("record"), *[s[c].alias(c) for c in ("hop_mode", *METRICS)]))
    rows = sides.select(*rest, F.explode(F.concat(kept, F.when(both, F.array(apart)).otherwise(F.array()))).alias("r"))
    tail = (1 - confidence) / 2
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.get(F.col(f"r.{n}"), F.lit(0)).alias("value"), F.array_sort(F.filter(F.slice(F.col(f"r.{n}"), 2, max(replicates, 1)), lambda x: x.isNotNull())).alias("s")) for n in METRICS])).alias("m")
    told = rows.select("r.record", *[F.col("r.hop_mode") if b == "hop_mode" else F.col(b) for b in by], named)
    return told.select("record", *by, "m.metric", "m.value", F.size("m.s").cast("long").alias("n"), resample.quantile(F.col("m.s"), tail, True).alias("low"), resample.quantile(F.col("m.s"), 1 - tail, True).alias("high"))


def violations(predictions: DataFrame, key: str = "trajectory_id") -> DataFrame:
    """(rule_id, key, detail) of what the report's input breaks: closed lists, scores, labels that do not follow from the
    outcome, trajectories and match groups whose fields vary, agents out of order, and designs with missing cells."""
    from wayline.operators import contracts
    from wayline.operators.labels import ACTION_TARGET, CANDIDATES, OUTCOMES, expected_label

    rows, c = [key, "agent_id", "layer"], F.col
    lists = {
        "hop_mode": ("2-hop", "3-hop"), "condition": ("clean", "injected"), "thinking_mode": ("off", "on"), "label_target": (ACTION_TARGET, "injection_present"), "behavioral_outcome": OUTCOMES,
        "latent_compromise_status": ("not_candidate", "candidate", "probe_supported"), "label": (0, 1, None),
    }
    outcome, fired = c("behavioral_outcome"), c("action_fired")
    holds = {
        "score": c("score").between(0, 1) & ~F.isnan("score"), "anchor": (c("anchor_agent_id") == "worker_1") & (c("anchor_hop_index") == 1), "distance": c("distance_from_injection") == c("hop_index") - 1,
        "condition": c("injection_present") == (c("condition") == "injected"), "action_known": F.when(outcome == "indeterminate", fired.isNull()).otherwise(fired.isNotNull()),
        "outcome_of_condition": F.when(c("condition") == "clean", outcome.isin("clean", "indeterminate")).otherwise(outcome != "clean"), "action_of_outcome": F.coalesce(fired, F.lit(False)) == (outcome == "executed"),
        "latent_of_outcome": F.when(outcome.isin(*CANDIDATES), c("latent_compromise_status").isin("candidate", "probe_supported")).otherwise(c("latent_compromise_status") == "not_candidate"),
        "label_of_target": c("label").eqNullSafe(expected_label(c("label_target"), c("injection_present"), fired, outcome)),
    }
    config = ["model", "thinking_mode", "label_target", "probe_name", "seed"]
    identity = ["match_group_id", "domain_id", "wording_id", "condition", "hop_mode", "model", "thinking_mode", "label_target", "behavioral_outcome", "action_fired", "seed", "label"]
    paths = predictions.groupBy(key, *config, "layer").agg(F.min("hop_mode").alias("hop_mode"), F.array_sort(F.collect_list(F.struct("hop_index", "agent_id", "agent_role"))).alias("p"))
    chain = F.array_join(F.transform("p", lambda p: F.concat_ws(":", p["hop_index"].cast("string"), p["agent_id"], p["agent_role"])), " ")
    two, three = "0:planner_1:planner 1:worker_1:worker 2:executor_1:executor", "0:planner_1:planner 1:worker_1:worker 2:worker_2:worker 3:executor_1:executor"
    layers = predictions.groupBy(*config, key).agg(F.array_join(F.transform(F.array_sort(F.collect_set("layer")), lambda x: x.cast("string")), ",").alias("layers"))
    cells = predictions.groupBy("match_group_id", "thinking_mode").agg(
        F.countDistinct("condition", "hop_mode").alias("n"), F.countDistinct("condition", "hop_mode", key).alias("t"),
    )
    return contracts.violations(
        *[contracts.allowed(predictions, rows, f, values) for f, values in lists.items()], *[contracts.holds(predictions, rows, n, test) for n, test in holds.items()],
        contracts.unique(predictions, [key, *config, "layer", "hop_index"]), contracts.depends(predictions, [key], identity), contracts.depends(predictions, ["match_group_id"], ["domain_id", "wording_id"]),
        contracts.holds(paths, [key, "layer"], "agent_order", chain == F.when(c("hop_mode") == "2-hop", two).otherwise(three), chain), contracts.depends(layers, config, ["layers"]),
        contracts.holds(cells, ["match_group_id", "thinking_mode"], "cells", (c("n") == 4) & (c("t") == 4), F.concat_ws("/", c("n").cast("string"), c("t").cast("string"))), contracts.one_value(predictions, "analysis_tier"),
    )


def sampling_grid(predictions: DataFrame, cluster: str = "match_group_id") -> DataFrame:
    """(n_clusters, n_domains, n_wordings, n_cells, crossed): whether every domain meets every wording."""
    g = predictions.agg(F.countDistinct(cluster).alias("n_clusters"), F.countDistinct("domain_id").alias("n_domains"), F.countDistinct("wording_id").alias("n_wordings"), F.countDistinct("domain_id", "wording_id").alias("n_cells"))
    return g.withColumn("crossed", F.col("n_cells") == F.col("n_domains") * F.col("n_wordings"))

