"""Linear probes on vectors, fitted leaving one group out and scored inside the JVM.

Fits use all rows of a stratum: small strata in one task, large ones by sums that partitions add up (``fits.fit_by_sums``).
Only where ``max_rows`` is given, a fit uses that many, those whose keys have the smallest hashes. Scoring joins the fitted weights, one row for each (stratum, fold), to all rows and is a dot product.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.vectors import dot
from wayline.session import ship

#: Rows of a stratum that a fit uses at most.
MAX_ROWS = 20_000


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def newton(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 100) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise |w|^2 / 2 + c * log-loss, the intercept free."""
    full = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.append(np.ones(x.shape[1]), 1e-9)

    def loss(v: np.ndarray) -> float:
        z = full @ v
        return 0.5 * (ridge * v * v).sum() + c * (np.logaddexp(0, z) - y * z).sum()

    w = np.zeros(full.shape[1])
    for _ in range(rounds):
        p = sigmoid(full @ w)
        slope = ridge * w + c * full.T @ (p - y)
        step = np.linalg.solve(np.diag(ridge) + c * (full * (p * (1 - p))[:, None]).T @ full, slope)
        size, now = 1.0, loss(w)
        while loss(w - size * step) > now and size > 1e-6:
            size /= 2
        w -= size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w[:-1], float(w[-1])


def standardized(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation of each column, 1 for a constant one."""
    sd = x.std(axis=0)
    return x.mean(axis=0), np.where(sd > 0, sd, 1.0)


def fit_logistic(x: np.ndarray, y: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, float]:
    """A logistic regression on standardised columns, as weights of the raw ones."""
    mean, sd = standardized(x)
    w, b = newton((x - mean) / sd, y)
    return w / sd, b - float((w / sd) @ mean)


def _calibrated(direction: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    if not np.linalg.norm(direction):  # nothing to tell the classes apart by: the share of positives
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        return np.zeros(x.shape[1]), float(np.log(share / (1 - share)))
    direction = direction / np.linalg.norm(direction)
    w, b = newton((x @ direction)[:, None], y)
    return direction * w[0], b


def fit_centroid(x: np.ndarray, y: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, float]:
    """The direction between the classes' means, with a logistic regression along it."""
    return _calibrated(x[y == 1].mean(axis=0) - x[y == 0].mean(axis=0), x, y)


def fit_contrast(x: np.ndarray, y: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, float]:
    """The main direction of the differences within pairs (the first component of the differences and their negatives,
    whose mean is 0), turned so that positives are ahead on average, with a logistic regression along it."""
    frame = pd.DataFrame({"pair": pair, "y": y, "i": np.arange(len(y))})
    sides = frame.pivot_table(index="pair", columns="y", values="i", aggfunc="first").dropna()
    if sides.shape[1] < 2 or not len(sides):
        return _calibrated(np.zeros(x.shape[1]), x, y)
    d = x[sides[1].astype(int)] - x[sides[0].astype(int)]
    direction = np.linalg.svd(d, full_matrices=False)[2][0] if d.any() else np.zeros(x.shape[1])
    return _calibrated(direction if (d @ direction).mean() >= 0 else -direction, x, y)


#: Components that a logistic regression on principal components keeps at most.
COMPONENTS = 50


def fit_pca(x: np.ndarray, y: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, float]:
    """A logistic regression on the first principal components of the standardised columns, as weights of the raw ones."""
    mean, sd = standardized(x)
    z = (x - mean) / sd
    directions = np.linalg.svd(z, full_matrices=False)[2][: min(COMPONENTS, len(x) - 1, x.shape[1])]
    w, b = newton(z @ directions.T, y)
    w = (w @ directions) / sd
    return w, b - float(w @ mean)


FITS: dict[str, Callable] = {"logistic": fit_logistic, "centroid": fit_centroid, "contrast": fit_contrast, "pca": fit_pca}


def _bounded(rows: DataFrame, by: Sequence[str], key: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` rows of a stratum, those whose keys have the smallest hashes. A threshold on the hash, which
    leaves a few more than are wanted, comes before the ranking, so that no task sorts a whole stratum."""
    share = (max_rows + 8 * max_rows**0.5 + 64) / F.col("_n")
    place = F.pmod(F.xxhash64(key), F.lit(1 << 53)) / F.lit(float(1 << 53))
    sizes = rows.groupBy(*[F.col(b).alias(f"_{b}") for b in by]).agg(F.count("*").alias("_n"))
    same = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    few = rows.join(sizes, reduce(lambda a, b: a & b, same)) if by else rows.crossJoin(sizes)
    few = few.withColumn("_at", place).where(F.col("_at") <= share).drop(*[f"_{b}" for b in by], "_n")
    w = Window.partitionBy(*by).orderBy("_at", key)
    return few.withColumn("_place", F.row_number().over(w)).where(F.col("_place") <= max_rows).drop("_place", "_at")


def _residual(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    frame = pd.DataFrame(x).groupby(pd.Series(group)).transform("mean").to_numpy()
    return x - frame


def fit_leaving_out(rows: DataFrame, by: Sequence[str], group: str, key: str, label: str, vector: str, probe: str = "logistic", pair: str | None = None, residual: bool = False, max_rows: int | None = MAX_ROWS) -> DataFrame:
    """(by, fold, weights, intercept): for each group a probe fitted to the other groups' labelled rows, gathered in one
    task: at most ``max_rows`` of a stratum, or all if that is None.

    With ``residual`` training rows are taken relative to their own group's mean and the test row's vector relative to
    the training rows' mean, which goes into the intercept. A fold whose training rows have one class only is left out.
    """
    ship(rows.sparkSession)
    fit, columns = FITS[probe], list(by)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([f"`{b}` {kinds[b]}" for b in columns] + [f"fold {kinds[group]}", "weights array<double>", "intercept double"])

    def folds(data: pd.DataFrame) -> pd.DataFrame:
        x = np.array(data[vector].tolist(), dtype=float)
        y, g = data[label].to_numpy(dtype=int), data[group].to_numpy()
        p = data[pair].to_numpy() if pair else np.zeros(len(y))
        out = []
        for fold in sorted(set(g)):
            train = g != fold
            if len(set(y[train])) < 2:
                continue
            xt = _residual(x[train], g[train]) if residual else x[train]
            w, b = fit(xt, y[train], p[train])
            out.append([*[data[c].iloc[0] for c in columns], fold, w.tolist(), b - (float(w @ x[train].mean(axis=0)) if residual else 0.0)])
        return pd.DataFrame(out, columns=[*columns, "fold", "weights", "intercept"])

    known = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    used = known if max_rows is None else _bounded(known, columns, key, max_rows)
    return used.select(*{*columns, group, label, vector, *([pair] if pair else [])}).groupBy(*columns).applyInPandas(folds, schema)


def fitted(
    rows: DataFrame, by: Sequence[str], group: str, key: str, label: str, vector: str, probe: str = "logistic", pair: str | None = None, residual: bool = False, max_rows: int | None = None, gathered: int = MAX_ROWS
) -> DataFrame:
    """(by, fold, weights, intercept): for each group a probe fitted to the other groups' rows, all of them or, if given, at
    most ``max_rows`` of a stratum. Strata of up to ``gathered`` rows are fitted by one task each, larger ones by sums over
    partitions; the two agree."""
    from wayline.operators.fits import fit_by_sums
    from wayline.operators.resample import _keyed

    if max_rows is not None:
        return fit_leaving_out(rows, by, group, key, label, vector, probe, pair, residual, max_rows)
    sizes = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).groupBy(_keyed(by).alias("_key")).agg(F.count("*").alias("n"), F.sum(F.size(vector)).alias("values")).collect()  # a design's strata
    large = {r["_key"]: r["values"] for r in sizes if r["n"] > gathered}
    few = lambda part: fit_leaving_out(part, by, group, key, label, vector, probe, pair, residual, None)
    many = lambda part: fit_by_sums(part, by, group, label, vector, probe, pair, residual, sum(large.values()))
    if not large:
        return few(rows)
    if len(large) == len(sizes):
        return many(rows)
    is_large = _keyed(by).isin(list(large))
    return few(rows.where(~is_large)).unionByName(many(rows.where(is_large)))


def held_out_scores(rows: DataFrame, models: DataFrame, by: Sequence[str], group: str, vector: str) -> DataFrame:
    """All rows with the score of the probe that was fitted without their group."""
    joined = rows.join(models.withColumnRenamed("fold", group), [*by, group])
    return joined.withColumn("score", 1 / (1 + F.exp(-(dot(F.col(vector), F.col("weights")) + F.col("intercept"))))).drop("weights", "intercept")


def scored_layers(rows: DataFrame, by: Sequence[str], group: str, key: str, label: str, vector: str, probes: Sequence[str], pair: str | None = None, residual: bool = False, max_rows: int | None = None) -> DataFrame:
    """All rows with the held-out score of every probe, ``probe_name``: one fit for each stratum (thinking mode, agent,
    layer, ...) and held-out group, all of them side by side. Strata where a fold lacks a class have no score there."""
    parts = [held_out_scores(rows, fitted(rows, by, group, key, label, vector, p, pair, residual, max_rows), by, group, vector).withColumn("probe_name", F.lit(p)) for p in probes]
    return reduce(DataFrame.unionByName, parts)


def layer_scan(rows: DataFrame, by: Sequence[str], layer: str, group: str, key: str, label: str, vector: str, probes: Sequence[str], pair: str | None = None, max_rows: int | None = None) -> DataFrame:
    """(by, layer, probe_name, status, reason, n, n_folds, pooled, mean, deviation and range of the folds' AUROC): a probe
    for every stratum and layer that can be cross-validated by group, and the reason why the others cannot."""
    from wayline.operators.metrics import fold_summary
    from wayline.operators.splits import fold_skips

    strata = [*by, layer]
    skips = fold_skips(rows, strata, group, label)
    blocked = skips.where("reason IS NOT NULL")
    usable = rows.join(blocked, strata, "left_anti")
    found = fold_summary(scored_layers(usable, strata, group, key, label, vector, probes, pair, max_rows=max_rows), [*strata, "probe_name"], group)
    every = skips.select(*strata, "reason", F.explode(F.array(*[F.lit(p) for p in probes])).alias("probe_name"))
    return every.join(found, [*strata, "probe_name"], "left").withColumn("status", F.when(F.col("reason").isNull(), "completed").otherwise("skipped"))


def baselines(rows: DataFrame, by: Sequence[str], group: str, pair: str, key: str, label: str, vector: str, probes: Sequence[str] = ("pca", "contrast"), k: int = 5, seed: int = 42, max_rows: int | None = None) -> DataFrame:
    """(by, probe_name, scheme, n, n_folds, the AUROCs, accuracy) of every probe under three ways of cross-validation:
    ``stratified`` folds, ``leave_group_out``, and ``pairs``, whose folds keep pairs whole."""
    from wayline.operators.metrics import accuracy, fold_summary
    from wayline.operators.splits import group_folds, stratified_folds

    known = rows.where(F.col(label).isNotNull())
    dealt = {"stratified": stratified_folds(known, key, label, k, seed), "leave_group_out": known.withColumn("fold", F.col(group)), "pairs": group_folds(known, pair, k, seed).where("fold IS NOT NULL")}
    out = []
    for scheme, folded in dealt.items():
        cast = folded.withColumnRenamed("fold", "_fold").withColumn("_fold", F.col("_fold").cast("string"))
        scored = scored_layers(cast, by, "_fold", key, label, vector, probes, pair, max_rows=max_rows).withColumnRenamed(label, "label")
        strata = [*by, "probe_name"]
        right = scored.groupBy(*strata).agg(accuracy(F.col("score"), F.col("label")).alias("accuracy"))
        out.append(fold_summary(scored, strata, "_fold").join(right, strata).withColumn("scheme", F.lit(scheme)))
    return reduce(DataFrame.unionByName, out)


def directions(models: DataFrame, weights: str = "weights") -> DataFrame:
    """Models with ``direction``, their weights at length 1 (all zero if they are)."""
    size = F.sqrt(dot(F.col(weights), F.col(weights)))
    return models.withColumn("direction", F.transform(weights, lambda w: F.when(size > 0, w / size).otherwise(0.0)))


def projected(rows: DataFrame, vector: str, axes: np.ndarray) -> DataFrame:
    """Adds ``pc1``, ``pc2``, ...: the rows' places along some directions, few by design, inside the JVM."""
    return rows.withColumns({f"pc{i + 1}": dot(F.col(vector), F.array(*[F.lit(float(x)) for x in axis])) for i, axis in enumerate(axes)})


def cohort_refits(rows: DataFrame, cohorts: dict[str, Sequence[str]], group: str, key: str, label: str, vector: str, probe: str = "logistic", max_rows: int | None = None) -> DataFrame:
    """(cohort, kind, n, n_folds, the AUROCs): each cohort of groups twice, as ``fold_filter`` with the scores of probes
    that saw all groups but the row's own, and as ``full_refit`` with probes that saw the cohort's groups only."""
    from wayline.operators.metrics import fold_summary
    from wayline.operators.pairs import membership

    one = rows.withColumn("cohort", F.lit("all"))
    scored = held_out_scores(one, fitted(one, ["cohort"], group, key, label, vector, probe, max_rows=max_rows), ["cohort"], group, vector)
    kept = membership(scored.drop("cohort"), cohorts, group)
    own = membership(rows, cohorts, group)
    refitted = held_out_scores(own, fitted(own, ["cohort"], group, key, label, vector, probe, max_rows=max_rows), ["cohort"], group, vector)
    both = kept.select("cohort", group, label, "score", F.lit("fold_filter").alias("kind")).unionByName(refitted.select("cohort", group, label, "score", F.lit("full_refit").alias("kind")))
    return fold_summary(both.withColumnRenamed(label, "label"), ["cohort", "kind"], group)


def _products(vector_at: int) -> Callable:
    """For each partition: the number of its vectors, their sum and the sum of their products, as rows (i, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | None = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column(vector_at).to_pylist(), dtype=float)
                x = np.hstack([np.ones((len(x), 1)), x])
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "values"])

    return run


def principal(rows: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k directions and their shares of the variance. Each partition sums its products, and d * d numbers reach
    the driver."""
    ship(rows.sparkSession)
    v = rows.where(F.col(vector).isNotNull()).select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
    parts = v.mapInArrow(_products(0), "i int, values array<double>").select("i", F.posexplode("values").alias("j", "x"))
    sums = parts.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = max(r["i"] for r in sums)
    total = np.zeros((d + 1, d + 1))
    for r in sums:
        total[r["i"], r["j"]] = r["x"]
    n, mean = total[0, 0], total[0, 1:] / total[0, 0]
    cov = total[1:, 1:] / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return vectors[:, order].T, values[order] / values.sum()
