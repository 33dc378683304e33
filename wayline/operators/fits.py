"""Probes fitted leaving one group out, from sums that partitions add up.

A probe is a logistic regression on a few linear features of a vector: its standardised columns, their first principal
components, or its place along one direction. Which features, follows from sums of products: of each group's vectors, and
for matched pairs of their differences. A fold is everything less its own group, so its sums are the total less the
group's, and so is the first step of the regression, which starts where all rows weigh alike. Every further step of all
strata and folds is one pass over the rows, in which each partition adds up gradients and Hessians; a step is solved by a
task of its own for each (stratum, fold). Rows are not dealt, gathered or sampled; only weights reach the driver.

Sums of products are as wide as the vector times itself: this suits vectors of up to about a thousand places.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.probes import COMPONENTS, sigmoid
from wayline.operators.resample import _keyed, _runs
from wayline.session import ship

#: Values of vectors to a task at least, of all rows that are fitted: every pass sends a few kB a task to the driver.
VALUES = 1 << 20
#: Newton steps at most, and the step after which a fold is done: the error then is about its square.
ROUNDS, CLOSE = 50, 1e-6
_RIDGE_OF_INTERCEPT = 1e-9


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _frame(rows: DataFrame, by: Sequence[str], group: str, label: str, vector: str, pair: str | None) -> DataFrame:
    known = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    fold = F.to_json(F.struct(F.col(group).alias("_")))
    return known.select(_keyed(by).alias("_key"), fold.alias("_fold"), F.col(label).cast("long").alias("_y"), F.transform(vector, lambda x: x.cast("double")).alias("_x"), *([F.col(pair).alias("_pair")] if pair else []))


_SUMS = "_key string, _fold string, n long, products array<double>, positive array<double>"


def _summed(parts: pd.DataFrame) -> pd.DataFrame:
    add = lambda c: np.sum([np.asarray(v) for v in parts[c]], axis=0)
    return pd.DataFrame({"_key": [parts["_key"].iloc[0]], "_fold": [parts["_fold"].iloc[0]], "n": [int(parts["n"].sum())], "products": [add("products")], "positive": [add("positive")]})


def moments(frame: DataFrame) -> DataFrame:
    """(_key, _fold, n, products, positive): of each group the sum of the products of (1, vector) with itself, and the sum
    of (1, vector) over positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.hstack([np.ones((batch.num_rows, 1)), _matrix(batch.column(3))])
            y = batch.column(2).to_numpy()
            keys, folds = (batch.column(c).dictionary_encode() for c in (0, 1))
            code = keys.indices.to_numpy() * len(folds.dictionary) + folds.indices.to_numpy()
            for c in np.unique(code).tolist():
                own = x[code == c]
                name = (keys.dictionary[c // len(folds.dictionary)].as_py(), folds.dictionary[c % len(folds.dictionary)].as_py())
                old = held.setdefault(name, [0, 0.0, 0.0])
                held[name] = [old[0] + len(own), old[1] + own.T @ own, old[2] + own[y[code == c] == 1].sum(axis=0)]
        for (key, fold), (n, products, positive) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([fold]), pa.array([n]), *[pa.array([v.ravel()], pa.list_(pa.float64())) for v in (products, positive)]], names=[c.split()[0] for c in _SUMS.split(", ")])

    return frame.mapInArrow(run, _SUMS).groupBy("_key", "_fold").applyInPandas(_summed, _SUMS)


def pair_moments(frame: DataFrame) -> DataFrame:
    """(_key, _fold, n, products, positive): the sums of products of the differences, positive less negative, within pairs,
    under each fold that a member of the pair is in (``positive`` holds the differences' sum); under fold '*' all of them.
    Of several members of one kind the first in the order of folds and vectors counts."""
    side = lambda v: F.min(F.when(F.col("_y") == v, F.struct("_fold", "_x")))
    both = frame.where("_pair IS NOT NULL").groupBy("_key", "_pair").agg(side(1).alias("a"), side(0).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    apart = F.zip_with("a._x", "b._x", lambda x, y: x - y)
    rows = both.select("_key", F.explode(F.array_distinct(F.array(F.lit("*"), "a._fold", "b._fold"))).alias("_fold"), F.lit(1).cast("long").alias("_y"), apart.alias("_x"))
    return moments(rows)


def _direction(products: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The first component of differences and their negatives, turned so that positives are ahead on average."""
    if not products.any():
        return np.zeros(len(total))
    direction = np.linalg.eigh(products)[1][:, -1]
    return direction if total @ direction >= 0 else -direction


def features(probe: str, sums: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], pairs: tuple[np.ndarray, np.ndarray] | None, residual: bool) -> tuple[np.ndarray, np.ndarray]:
    """The basis (k, d) and offset (k) of a fold's features, from its groups' (n, sum, products, positives' (1, sum)) and
    the pairs' (products, sum)."""
    n = sum(s[0] for s in sums)
    d = len(sums[0][1])
    centre = [s[1] / s[0] if residual else np.zeros(d) for s in sums]  # what each group's rows are relative to
    total = sum((s[1] - s[0] * c for s, c in zip(sums, centre, strict=True)), np.zeros(d))
    products = sum((s[2] - np.outer(c, s[1]) - np.outer(s[1], c) + s[0] * np.outer(c, c) for s, c in zip(sums, centre, strict=True)), np.zeros((d, d)))
    if probe in ("logistic", "pca"):
        mean = total / n
        variance = np.maximum(np.diag(products) / n - mean**2, 0)
        # What is left of a constant column by rounding is no deviation.
        sd = np.where(variance > 1e-14 * (np.diag(products) / n + 1e-300), np.sqrt(variance), 1.0)
        if probe == "logistic":
            return np.diag(1 / sd), -mean / sd
        cov = (products - n * np.outer(mean, mean)) / np.outer(sd, sd)
        basis = np.linalg.eigh(cov)[1][:, ::-1][:, : min(COMPONENTS, n - 1, d)].T / sd
        return basis, -basis @ mean
    if probe == "centroid":
        ones = sum(s[3][0] for s in sums)
        up = sum((s[3][1:] - s[3][0] * c for s, c in zip(sums, centre, strict=True)), np.zeros(d))
        direction = up / ones - (total - up) / (n - ones)
    else:
        direction = _direction(*pairs) if pairs is not None else np.zeros(d)
    size = np.linalg.norm(direction)
    return (direction / size)[None] if size > 1e-12 else np.zeros((1, d)), np.zeros(1)


class _Fold:
    """A regression on the way: weights of (features, 1), the loss there, and where it came from."""

    def __init__(self, basis: np.ndarray, offset: np.ndarray, centre: dict[str, np.ndarray]) -> None:
        self.basis, self.offset, self.centre = basis, offset, centre
        self.at = np.zeros(len(basis) + 1)
        self.before: tuple[np.ndarray, float] | None = None
        self.done = False

    def moved(self, loss: float, step: np.ndarray) -> None:
        """Goes on from here, or half-way back if the last step went too far."""
        if self.before is not None and loss > self.before[1] + 1e-12 * abs(self.before[1]) and np.abs(self.at - self.before[0]).max() > 1e-9:
            self.at = (self.at + self.before[0]) / 2
            return
        self.before, self.at = (self.at, loss), self.at - step
        self.done = bool(np.abs(step).max() < CLOSE)


_STEPS = "_key string, _fold string, loss double, slope array<double>, curve array<double>"


def _pass(frame: DataFrame, folds: dict[tuple[str, str], _Fold]) -> dict[tuple[str, str], tuple[float, np.ndarray]]:
    """The loss of every open fold and its Newton step: one pass over the rows."""
    spark = frame.sparkSession
    told = spark.sparkContext.broadcast({k: (f.basis, f.offset, f.centre, f.at) for k, f in folds.items()})  # weights of the design's strata and folds
    names = [c.split()[0] for c in _STEPS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, dict[str, tuple]] = {}
        for (key, fold), m in told.value.items():
            models.setdefault(key, {})[fold] = m
        held: dict[tuple[str, str], list] = {}
        for batch in batches:
            order = pa.compute.sort_indices(batch, sort_keys=[(batch.schema.names[0], "ascending"), (batch.schema.names[1], "ascending")])
            batch = batch.take(order)
            for key, lo, hi in _runs(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                x, y = _matrix(part.column(3)), part.column(2).to_numpy()
                groups = _runs(part.column(1))
                for fold, (basis, offset, centre, at) in models.get(key, {}).items():
                    keep = np.ones(len(y), bool)
                    rows = x
                    for name, a, b in groups:
                        if name == fold:
                            keep[a:b] = False
                        elif centre:
                            rows = rows.copy() if rows is x else rows
                            rows[a:b] -= centre[name]
                    u = np.hstack([rows[keep] @ basis.T + offset, np.ones((int(keep.sum()), 1))])
                    z = u @ at
                    p = sigmoid(z)
                    old = held.setdefault((key, fold), [0.0, 0.0, 0.0])
                    held[key, fold] = [old[0] + float((np.logaddexp(0, z) - y[keep] * z).sum()), old[1] + u.T @ (p - y[keep]), old[2] + (u * (p * (1 - p))[:, None]).T @ u]
        for (key, fold), (loss, slope, curve) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([fold]), pa.array([loss]), *[pa.array([v.ravel()], pa.list_(pa.float64())) for v in (slope, curve)]], names=names)

    def solved(parts: pd.DataFrame) -> pd.DataFrame:
        key, fold = parts["_key"].iloc[0], parts["_fold"].iloc[0]
        at = told.value[key, fold][3]
        add = lambda c: np.sum([np.asarray(v) for v in parts[c]], axis=0)
        return pd.DataFrame({"_key": [key], "_fold": [fold], **_step(at, float(parts["loss"].sum()), add("slope"), add("curve").reshape(len(at), len(at)))})

    sums = frame.drop("_pair").mapInArrow(run, _STEPS)
    rows = sums.groupBy("_key", "_fold").applyInPandas(solved, "_key string, _fold string, loss double, step array<double>").collect()
    told.unpersist()
    return {(r["_key"], r["_fold"]): (r["loss"], np.array(r["step"])) for r in rows}


def _step(at: np.ndarray, loss: float, slope: np.ndarray, curve: np.ndarray) -> dict[str, list]:
    ridge = np.append(np.ones(len(at) - 1), _RIDGE_OF_INTERCEPT)
    return {"loss": [0.5 * float((ridge * at * at).sum()) + loss], "step": [np.linalg.solve(np.diag(ridge) + curve, ridge * at + slope)]}


def fit_by_sums(rows: DataFrame, by: Sequence[str], group: str, label: str, vector: str, probe: str = "logistic", pair: str | None = None, residual: bool = False, values: int | None = None) -> DataFrame:
    """(by, fold, weights, intercept): for each group a probe fitted to all labelled rows of the other groups. It is what
    ``probes.fit_leaving_out`` gives for rows that fit into one task, and takes any number. If ``values``, the rows times
    the places of a vector, is given, a pass has no more tasks than these need.

    Probes are ``logistic``, ``pca``, ``centroid`` and ``contrast`` (which needs ``pair``). With ``residual`` training rows
    are relative to their own group's mean, and a scored row to that of the training rows, which goes into the intercept.
    A fold whose training rows have one class only is left out.
    """
    spark = rows.sparkSession
    ship(spark)
    frame = _frame(rows, by, group, label, vector, pair if probe == "contrast" else None).persist()
    # What is persisted has the partitions that a shuffle was set to, however few the rows; passes read several in a task.
    read = frame if values is None else frame.coalesce(max(spark.sparkContext.defaultParallelism, -(-values // VALUES)))
    try:
        out = _models(read, probe, residual)
    finally:
        frame.unpersist()
    models = spark.createDataFrame(out, "_key string, _fold string, weights array<double>, intercept double")
    named = rows.select(*by, F.col(group).alias("fold")).distinct().withColumns({"_key": _keyed(by), "_fold": F.to_json(F.struct(F.col("fold").alias("_")))})
    return named.join(F.broadcast(models), ["_key", "_fold"]).select(*by, "fold", "weights", "intercept")


def _models(frame: DataFrame, probe: str, residual: bool) -> list[tuple[str, str, list[float], float]]:
    strata: dict[str, dict[str, tuple]] = {}
    for r in moments(frame).collect():  # a row for each stratum and group of the design
        ones, d = np.array(r["positive"]), len(r["positive"]) - 1
        products = np.array(r["products"]).reshape(d + 1, d + 1)
        strata.setdefault(r["_key"], {})[r["_fold"]] = (r["n"], products[0, 1:], products[1:, 1:], ones)
    paired: dict[tuple[str, str], tuple[np.ndarray, np.ndarray]] = {}
    if probe == "contrast":
        for r in pair_moments(frame).collect():
            d = len(r["positive"]) - 1
            paired[r["_key"], r["_fold"]] = (np.array(r["products"]).reshape(d + 1, d + 1)[1:, 1:], np.array(r["positive"])[1:])
    folds: dict[tuple[str, str], _Fold] = {}
    for key, groups in strata.items():
        for fold in groups:
            own = [s for g, s in groups.items() if g != fold]
            n, ones = sum(s[0] for s in own), sum(s[3][0] for s in own)
            if not 0 < ones < n:
                continue
            pairs = None
            if (key, "*") in paired:
                gone = paired.get((key, fold))
                pairs = tuple(a - b for a, b in zip(paired[key, "*"], gone, strict=True)) if gone else paired[key, "*"]
                pairs = (np.zeros_like(pairs[0]), pairs[1]) if np.abs(pairs[0]).max() <= 1e-12 * np.abs(paired[key, "*"][0]).max() else pairs
            basis, offset = features(probe, own, pairs, residual)
            centre = {g: s[1] / s[0] for g, s in groups.items()} if residual else {}
            made = _Fold(basis, offset, centre)
            folds[key, fold] = made
            if not basis.any():  # nothing to tell the classes apart by: the share of positives
                share = np.clip(ones / n, 1e-6, 1 - 1e-6)
                made.at, made.done = np.array([0.0, np.log(share / (1 - share))]), True
                continue
            made.moved(np.inf, _first_step(made, own, n))
    for _ in range(ROUNDS):
        open_ = {k: f for k, f in folds.items() if not f.done}
        if not open_:
            break
        for k, (loss, step) in _pass(frame, open_).items():
            folds[k].moved(loss, step)
    out = []
    for (key, fold), f in folds.items():
        weights = f.at[:-1] @ f.basis
        intercept = float(f.at[-1] + f.at[:-1] @ f.offset)
        if residual:
            own = [s for g, s in strata[key].items() if g != fold]
            intercept -= float(weights @ (sum(s[1] for s in own) / sum(s[0] for s in own)))
        out.append((key, fold, weights.tolist(), intercept))
    return out


def _first_step(fold: _Fold, own: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The Newton step from weights of 0, where every row's probability is one half: sums of products say all of it."""
    d = len(own[0][1])
    total, products, up, ones = np.zeros(d), np.zeros((d, d)), np.zeros(d), 0.0
    for s in own:
        c = s[1] / s[0] if fold.centre else np.zeros(d)
        total += s[1] - s[0] * c
        products += s[2] - np.outer(c, s[1]) - np.outer(s[1], c) + s[0] * np.outer(c, c)
        up += s[3][1:] - s[3][0] * c
        ones += s[3][0]
    b, o = fold.basis, fold.offset
    sums = b @ total + n * o
    inner = b @ products @ b.T + np.outer(b @ total, o) + np.outer(o, b @ total) + n * np.outer(o, o)
    curve = np.block([[inner, sums[:, None]], [sums[None], np.array([[float(n)]])]]) / 4
    slope = np.append(sums / 2 - (b @ up + ones * o), n / 2 - ones)
    return _step(fold.at, 0.0, slope, curve)["step"][0]
