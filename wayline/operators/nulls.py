"""Permutation nulls: labels dealt out anew within their groups, for many replicates at once.

The task that holds a group's keys and labels makes all of its permutations from the seed, as a matrix of rows by
replicates, in blocks of replicates; a table of rows and replicates is nowhere. Where scores stay as they are, a replicate
is a product of the matrix with the scores' ranks. Where the probe is refitted, the groups' scores of all replicates are a
product of their vectors with the replicates' weights. What is shuffled does not depend on the number of replicates, but
for the results themselves and the labels of the rows that refits use.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.metrics import block_of, fold_summary, score_counts
from wayline.operators.probes import FITS, fit_leaving_out, held_out_scores, sigmoid
from wayline.operators.resample import permuted_labels
from wayline.session import ship

#: Replicates that a task works on at once, and the parts that refits are dealt in.
BLOCK, PARTS = 64, 32
#: Rows of a group that one task holds; larger groups take the way of joins.
GROUP_ROWS = 500_000


def permutations(keys: Sequence[str], labels: np.ndarray, replicates: Sequence[int], seed: int) -> np.ndarray:
    """(rows, replicates) of 0 and 1: in each replicate the rows whose digests come first have the group's positives, as
    :func:`wayline.operators.resample.permuted_labels` deals them."""
    n, positives = len(keys), int((labels == 1).sum())
    out = np.zeros((n, len(replicates)), np.uint8)
    raw = [str(k).encode() for k in keys]
    for column, r in enumerate(replicates):
        head = f"{seed}:{r}:".encode()
        order = np.argsort(np.array([hashlib.sha256(head + k).digest() for k in raw], "S32"), kind="stable")
        out[order[:positives], column] = 1
    return out


def ranked(rows: DataFrame, by: Sequence[str], score: str = "score", label: str = "label") -> DataFrame:
    """(by, score, rank): the mean rank, from 1, that labelled rows of a score have in their stratum."""
    counts = score_counts(rows, by, score, label).select(*by, "score", (F.col("w1") + F.col("w0")).alias("n"), block_of(F.col("score")).alias("_block"))
    blocks = counts.groupBy(*by, "_block").agg(F.sum("n").alias("all"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*[F.col(b).alias(f"_r{i}") for i, b in enumerate(by)], F.col("_block").alias("_rb"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    below = Window.partitionBy(*by, "_block").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("inner", F.coalesce(F.sum("n").over(below), F.lit(0)))
    test = F.col("_block") == F.col("_rb")
    for i, b in enumerate(by):
        test = test & F.col(b).eqNullSafe(F.col(f"_r{i}"))
    return inner.join(blocks, test).select(*by, "score", (F.col("base") + F.col("inner") + (F.col("n") + 1) / 2).alias("rank"))


def permuted_auroc(rows: DataFrame, by: Sequence[str], group: str, key: str, replicates: int, seed: int = 0) -> DataFrame:
    """(by, replicate, auroc) of rows with ``score`` and ``label`` when labels are permuted within each stratum's groups;
    null where a class is absent. Keys are unique; rows without a label take no part."""
    ship(rows.sparkSession)
    known = rows.where("label IS NOT NULL").select(*by, F.col(group).alias("_group"), F.col(key).cast("string").alias("_key"), F.col("label").cast("int").alias("_label"), F.col("score"))
    ranks = ranked(rows, by)
    right = ranks.select(*[F.col(b).alias(f"_r{i}") for i, b in enumerate(by)], F.col("score").alias("_rs"), "rank")
    test = F.col("score").eqNullSafe(F.col("_rs"))
    for i, b in enumerate(by):
        test = test & F.col(b).eqNullSafe(F.col(f"_r{i}"))
    placed = known.join(right, test).select(*by, "_group", "_key", "_label", "rank")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*[f"`{b}` {kinds[b]}" for b in by], "_n long, _p long, _sums array<double>"])

    def summed(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_key")
        labels, rank = own["_label"].to_numpy(), own["rank"].to_numpy(float)
        sums = [rank @ permutations(own["_key"].tolist(), labels, range(at, min(at + BLOCK, replicates)), seed) for at in range(0, replicates, BLOCK)]
        return pd.DataFrame({**{b: [own[b].iloc[0]] for b in by}, "_n": [len(own)], "_p": [int((labels == 1).sum())], "_sums": [np.concatenate(sums or [np.empty(0)])]})

    groups = placed.groupBy(*by, "_group").applyInPandas(summed, schema).select(*by, "_n", "_p", F.posexplode("_sums").alias("replicate", "_s"))
    total = groups.groupBy(*by, "replicate").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    p, q = F.col("_p"), F.col("_n") - F.col("_p")
    return total.select(*by, F.col("replicate").cast("long"), F.try_divide(F.col("_s") - p * (p + 1) / 2, (p * q).cast("double")).alias("auroc"))


def column_aurocs(z: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The AUROC of each column of scores under the same column of labels; NaN where a class is absent."""
    order = np.argsort(z, axis=0, kind="stable")
    z, y = np.take_along_axis(z, order, axis=0), np.take_along_axis(y, order, axis=0).astype(float)
    n = len(z)
    starts = np.vstack([np.ones((1, z.shape[1]), bool), z[1:] != z[:-1]])
    first = np.maximum.accumulate(np.where(starts, np.arange(n)[:, None], 0), axis=0)
    ends = np.vstack([starts[1:], np.ones((1, z.shape[1]), bool)])
    last = np.minimum.accumulate(np.where(ends, np.arange(n)[:, None], n)[::-1], axis=0)[::-1]
    p = y.sum(axis=0)
    with np.errstate(invalid="ignore", divide="ignore"):
        return ((y * ((first + last) / 2 + 1)).sum(axis=0) - p * (p + 1) / 2) / (p * (n - p))


def permutation_null(rows: DataFrame, group: str, key: str, label: str, vector: str, replicates: int, probe: str = "logistic", seed: int = 0, max_rows: int = 2000, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(replicate, mean_auroc) of complete refits under labels permuted within groups, the mean being that of the held-out
    groups' AUROCs. Labels of all rows are permuted and all rows are scored; a fit uses at most ``max_rows`` of them, those
    whose keys have the smallest hashes. Keys are unique. Groups of more than ``group_rows`` rows are not gathered: then
    rows and replicates are joined instead, which gives the same."""
    spark = rows.sparkSession
    ship(spark)
    used = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).alias("_id"), F.col(key).cast("string").alias("_key"), F.col(group).alias("_group"), F.col(label).cast("int").alias("_label"), F.col(vector).alias("_vector"))
    largest = used.groupBy("_group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    if largest is None:
        return spark.createDataFrame([], "replicate long, mean_auroc double")
    few = used.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    if largest > group_rows:
        return _joined(used, few, replicates, probe, seed, max_rows)
    kind = next(f.dataType.simpleString() for f in used.schema.fields if f.name == "_group")

    def deal(own: pd.DataFrame) -> pd.DataFrame:
        """The permuted labels of the rows that refits use."""
        own = own.sort_values("_key")
        picked = own["_vector"].notna().to_numpy()
        keys, labels = own["_key"].tolist(), own["_label"].to_numpy()
        bits = [permutations(keys, labels, range(at, min(at + BLOCK, replicates)), seed)[picked] for at in range(0, replicates, BLOCK)] if picked.any() else []
        mine = own[picked]
        return pd.DataFrame({"_key": mine["_key"], "_group": mine["_group"], "_vector": mine["_vector"], "_bits": [np.packbits(b).tobytes() for b in np.concatenate(bits, axis=1)] if bits else []})

    chosen = few.select(F.col("_key").alias("_k"), F.col("_vector").alias("_v"))
    marked = used.drop("_vector").join(chosen, F.col("_key") == F.col("_k"), "left").select("_key", "_group", "_label", F.col("_v").alias("_vector"))
    vectors = used.schema["_vector"].dataType.simpleString()
    dealt = marked.groupBy("_group").applyInPandas(deal, f"_key string, _group {kind}, _vector {vectors}, _bits binary")

    def refit(part: pd.DataFrame) -> pd.DataFrame:
        number, out = int(part["_part"].iloc[0]), []
        part = part.sort_values("_key")
        x, g = np.array(part["_vector"].tolist(), dtype=float), part["_group"].to_numpy()
        bits = np.array([np.unpackbits(np.frombuffer(b, np.uint8))[number:replicates:PARTS] for b in part["_bits"]])
        for at, r in enumerate(range(number, replicates, PARTS)):
            for fold in sorted(set(g)):
                train = g != fold
                y = bits[train, at].astype(int)
                if len(set(y)) == 2:
                    w, b = FITS[probe](x[train], y, np.zeros(len(y)))
                    out.append((r, fold, [*w.tolist(), b]))
        return pd.DataFrame(out, columns=["replicate", "_fold", "weights"])

    # The rows that refits use, max_rows at most, go to each part of the replicates.
    models = dealt.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(min(PARTS, max(replicates, 1)) - 1)))).groupBy("_part").applyInPandas(refit, f"replicate long, _fold {kind}, weights array<double>")

    def score(own: pd.DataFrame, fitted: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"replicate": [], "auroc": []})
        if not len(own) or not len(fitted):
            return empty
        own, fitted = own.sort_values("_key"), fitted.sort_values("replicate")
        x, keys, labels = np.array(own["_vector"].tolist(), dtype=float), own["_key"].tolist(), own["_label"].to_numpy()
        weights, numbers, out = np.array(fitted["weights"].tolist()), fitted["replicate"].tolist(), []
        for at in range(0, len(numbers), BLOCK):
            w = weights[at : at + BLOCK]
            out.append(column_aurocs(sigmoid(x @ w[:, :-1].T + w[:, -1]), permutations(keys, labels, numbers[at : at + BLOCK], seed)))
        return pd.DataFrame({"replicate": numbers, "auroc": np.concatenate(out)})

    folds = used.select("_key", "_group", "_label", "_vector").groupBy("_group").cogroup(models.groupBy("_fold")).applyInPandas(score, "replicate long, auroc double")
    return folds.groupBy("replicate").agg(F.avg(F.nanvl("auroc", F.lit(None).cast("double"))).alias("mean_auroc"))


def _joined(used: DataFrame, few: DataFrame, replicates: int, probe: str, seed: int, max_rows: int) -> DataFrame:
    """The same by joins of rows with replicates."""
    dealt = permuted_labels(used.drop("_vector", "_id"), "_group", "_key", "_label", replicates, seed).select("replicate", "_key", F.col("permuted").alias("label"))
    models = fit_leaving_out(dealt.join(few.select("_key", "_group", "_vector"), "_key"), ["replicate"], "_group", "_key", "label", "_vector", probe, max_rows=max_rows)
    scored = held_out_scores(used.select("_key", "_group", "_vector"), models, [], "_group", "_vector").drop("_vector")
    return fold_summary(scored.join(dealt, ["replicate", "_key"]), ["replicate"], "_group").select("replicate", "mean_auroc")
