"""Cluster bootstrap, row bootstrap and permutation nulls.

A cluster bootstrap weighs clusters. The weights of all replicates are one vector for each (stratum, cluster), drawn from
the stratum's own clusters; whatever a replicate needs is a sum of such vectors or, for ranks, a sum of their prefix sums
in the order of scores. So rows are counted by cluster and score once, and no row is ever copied for a replicate. Vectors
are made where they are needed, from the seed, and only their sums travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.operators.metrics import block_of, score_counts
from wayline.session import ship

#: Cells of a block of weights that a task holds at once.
CELLS = 1 << 20


def draw(seed: int, replicate: Column, k: Column, n: Column) -> Column:
    """The k-th draw of a replicate: a number from 0 to n - 1, from a digest, so that every engine draws the same."""
    digits = F.left(F.sha2(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), k.cast("string")), 256), F.lit(8))
    return F.conv(digits, 16, 10).cast("long") % n


@lru_cache(maxsize=4)
def _digests(seed: int, replicates: int, n: int) -> np.ndarray:
    told = (hashlib.sha256(f"{seed}:{r}:{k}".encode()).digest()[:4] for r in range(replicates) for k in range(n))
    return np.frombuffer(b"".join(told), ">u4").astype(np.int64).reshape(replicates, n)


@lru_cache(maxsize=8)
def draws(seed: int, replicates: int, n: int) -> np.ndarray:
    """(n, 1 + replicates): column 0 is 1, the rows as they are; column 1 + r says how often replicate r draws each of
    n clusters, by the same draws as :func:`draw`."""
    drawn = _digests(seed, replicates, n) % n
    counts = np.bincount((drawn * (replicates + 1) + 1 + np.arange(replicates)[:, None]).ravel(), minlength=n * (replicates + 1)).reshape(n, replicates + 1)
    counts[:, 0] = 1
    return counts.astype(np.float64)


def places(rows: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """(by, cluster, _i, _n): each cluster's place in the sorted list of its stratum's clusters, and their number. A
    design has few clusters to a stratum."""
    held = rows.where(F.col(cluster).isNotNull()).select(*by, cluster).distinct()
    w = Window.partitionBy(*by)
    return held.withColumns({"_i": F.row_number().over(w.orderBy(cluster)) - 1, "_n": F.count("*").over(w)})


def _keyed(by: Sequence[str]) -> Column:
    """A stratum as one string."""
    return F.to_json(F.struct(*[F.col(b) for b in by], F.lit(1).alias("_")))


def _placed(rows: DataFrame, where: DataFrame, by: Sequence[str], cluster: str) -> DataFrame:
    """``rows`` with their cluster's place; strata may be null in parts."""
    right = where.select(*[F.col(b).alias(f"_r{i}") for i, b in enumerate([*by, cluster])], "_i", "_n")
    same = [F.col(b).eqNullSafe(F.col(f"_r{i}")) for i, b in enumerate(by)]
    test = F.col(cluster) == F.col(f"_r{len(by)}")
    for s in same:
        test = test & s
    return rows.join(right, test).drop(*[f"_r{i}" for i in range(len(by) + 1)])


def _runs(keys: pa.ChunkedArray | pa.Array) -> list[tuple[str, int, int]]:
    """(key, from, to) of equal neighbours."""
    coded = keys.dictionary_encode()
    index = coded.indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(index)) + 1
    return [(coded.dictionary[index[lo]].as_py(), lo, hi) for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(index)], strict=True)] if len(index) else []


class _Ranked:
    """The ranked pairs of one stratum, of all replicates at once, from (score, positives, negatives) in ascending order."""

    def __init__(self, size: int) -> None:
        self.wins, self.pos, self.neg = np.zeros(size), np.zeros(size), np.zeros(size)
        self._last: float | None = None
        self._tie = (np.zeros(size), np.zeros(size))

    def add(self, score: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], score[1:] != score[:-1]]))
        pos, neg = np.add.reduceat(pos, first), np.add.reduceat(neg, first)
        if self._last == score[0]:
            pos[0] += self._tie[0]
            neg[0] += self._tie[1]
        else:
            self._settle(*(t[None] for t in self._tie))
        self._last, self._tie = score[-1], (pos[-1].copy(), neg[-1].copy())
        self._settle(pos[:-1], neg[:-1])

    def _settle(self, pos: np.ndarray, neg: np.ndarray) -> None:
        below = np.cumsum(neg, axis=0)
        self.wins += (pos * (self.neg + below - neg / 2)).sum(axis=0)
        self.pos += pos.sum(axis=0)
        self.neg += neg.sum(axis=0)

    def done(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._settle(*(t[None] for t in self._tie))
        return self.wins, self.pos, self.neg


def _put_together(parts: pd.DataFrame) -> pd.DataFrame:
    """The AUROC of a stratum's ranges of scores, each with its ranked pairs and its sums, in order."""
    wins, pos, neg = 0.0, 0.0, 0.0
    for r in parts.sort_values("first").itertuples():
        wins, pos, neg = wins + r.wins + r.pos * neg, pos + r.pos, neg + r.neg
    values = [float(w / p) if p else None for w, p in zip(wins, pos * neg, strict=True)]
    return pd.DataFrame({"_key": [parts["_key"].iloc[0]], "auroc": [values]})


_PARTS = "_key string, first double, wins array<double>, pos array<double>, neg array<double>"


def auroc_vectors(counts: DataFrame, key: Column, replicates: int, seed: int) -> DataFrame:
    """(_key, auroc): for each stratum, named by the string ``key``, an array of the AUROC as it is and in each
    replicate, null where a class is not drawn. ``counts`` has score, w1, w0 and the clusters' places ``_i``, ``_n``.

    Counts are dealt by ranges of (stratum, score), so that a stratum is spread over tasks; each walks through its range
    in order, and the ranges' sums of pairs and of negatives are put together in order.
    """
    spark: SparkSession = counts.sparkSession
    ship(spark)

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple[str, float, _Ranked] | None = None

        def row() -> pa.RecordBatch:
            made = open_[2].done()
            return pa.RecordBatch.from_arrays([pa.array([open_[0]]), pa.array([open_[1]]), *[pa.array([v], pa.list_(pa.float64())) for v in made]], names=[c.split()[0] for c in _PARTS.split(", ")])

        step = max(1, CELLS // (replicates + 1))
        for batch in batches:
            for name, lo, hi in _runs(batch.column(0)):
                if open_ is None or open_[0] != name:
                    if open_ is not None:
                        yield row()
                    open_ = (name, batch.column(1)[lo].as_py(), _Ranked(replicates + 1))
                for at in range(lo, hi, step):
                    part = batch.slice(at, min(step, hi - at))
                    score, i, n, pos, neg = (part.column(c).to_numpy() for c in range(1, 6))
                    weights = draws(seed, replicates, int(n[0]))[i]
                    open_[2].add(score, weights * pos[:, None], weights * neg[:, None])
        if open_ is not None:
            yield row()

    cells = counts.select(key.alias("_key"), F.col("score").cast("double").alias("score"), F.col("_i").cast("long"), F.col("_n").cast("long"), F.col("w1").cast("double"), F.col("w0").cast("double"))
    dealt = cells.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_key", "score").sortWithinPartitions("_key", "score")
    # One row for each range and stratum at most.
    return dealt.mapInArrow(ranked, _PARTS).groupBy("_key").applyInPandas(_put_together, "_key string, auroc array<double>")


def sum_vectors(cells: DataFrame, key: Column, slots: int, replicates: int, seed: int) -> DataFrame:
    """(_key, sums): for each stratum an array with the weighted sums of each of ``slots`` quantities, each an array of
    the sum as it is and in each replicate. ``cells`` has slot, value and the clusters' places ``_i``, ``_n``; each task
    adds up what it has, and a stratum's sums are added up in the end."""
    ship(cells.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for name, lo, hi in _runs(batch.column(0)):
                slot, value, i, n = (batch.column(c).slice(lo, hi - lo).to_numpy() for c in range(1, 5))
                np.add.at(held.setdefault((name, int(n[0])), np.zeros((int(n[0]), slots))), (i, slot), value)
        for (name, n), table in held.items():
            sums = draws(seed, replicates, n).T @ table
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sums.T.ravel()], pa.list_(pa.float64()))], names=["_key", "sums"])

    def added(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.asarray(s) for s in parts["sums"]], axis=0).reshape(slots, replicates + 1)
        return pd.DataFrame({"_key": [parts["_key"].iloc[0]], "sums": [total.tolist()]})

    rows = cells.select(key.alias("_key"), F.col("slot").cast("long"), F.col("value").cast("double"), F.col("_i").cast("long"), F.col("_n").cast("long")).where("value IS NOT NULL")
    return rows.mapInArrow(partial, "_key string, sums array<double>").groupBy("_key").applyInPandas(added, "_key string, sums array<array<double>>")


def by_replicate(vectors: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """(by, replicate, names): a row for each replicate of arrays whose first element is the rows as they are."""
    rows = vectors.select(*by, F.posexplode(F.arrays_zip(*names)).alias("_at", "_v"))
    return rows.where("_at > 0").select(*by, (F.col("_at") - 1).cast("long").alias("replicate"), *[F.col(f"_v.{n}").alias(n) for n in names])


def cluster_weights(clusters: DataFrame, cluster: str, replicates: int, seed: int = 0, by: Sequence[str] = ()) -> DataFrame:
    """(by, replicate, cluster, weight): how often each replicate draws each cluster of a stratum; as many draws as the
    stratum has clusters. This is a row for each replicate and cluster, to look at; nothing here is computed from it."""
    ranked = places(clusters, by, cluster)
    every = ranked.join(F.broadcast(clusters.sparkSession.range(replicates).select(F.col("id").alias("replicate"))))
    drawn = every.select(*by, "replicate", draw(seed, F.col("replicate"), F.col("_i"), F.col("_n")).alias("_i")).groupBy(*by, "replicate", "_i").agg(F.count("*").alias("weight"))
    return drawn.join(ranked, [*by, "_i"]).select(*by, "replicate", cluster, "weight")


def auroc_samples(rows: DataFrame, by: Sequence[str], cluster: str, replicates: int, seed: int = 0) -> DataFrame:
    """(by, auroc): an array of the AUROC of rows with ``score`` and ``label`` as they are, and in each replicate."""
    counts = score_counts(rows, [*by, cluster], "score", "label")
    key = _keyed(by)
    strata = counts.select(*by).distinct().withColumn("_key", key) if by else None
    found = auroc_vectors(_placed(counts, places(rows, by, cluster), by, cluster), key, replicates, seed)
    return strata.join(found, "_key").drop("_key") if by else found.drop("_key")


def bootstrap_auroc(rows: DataFrame, by: Sequence[str], cluster: str, replicates: int, seed: int = 0) -> DataFrame:
    """(by, replicate, auroc) of rows with ``score`` and ``label``; every stratum draws from its own clusters."""
    return by_replicate(auroc_samples(rows, by, cluster, replicates, seed), by, ["auroc"])


def _seeded(*told: object) -> np.random.Generator:
    """Random numbers that depend on what is told alone, and not on tasks or their order."""
    return np.random.Generator(np.random.Philox(key=int.from_bytes(hashlib.sha256(repr(told).encode()).digest()[:16], "big")))


def split_draws(rng: np.random.Generator, sizes: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """(len(sizes), len(draws)): how many of each replicate's ``draws`` fall on each of some parts of these sizes. The parts
    are halved again and again, and a half takes a binomial share of what its parent has; so the counts are multinomial."""
    if len(sizes) == 1:
        return draws[None]
    half = len(sizes) // 2
    total, left = int(sizes.sum()), int(sizes[:half].sum())
    taken = rng.binomial(draws, left / total) if total else np.zeros_like(draws)
    return np.concatenate([split_draws(rng, sizes[:half], taken), split_draws(rng, sizes[half:], draws - taken)])


def _row_cells(rows: DataFrame, by: Sequence[str], replicates: int, seed: int) -> DataFrame:
    """The counts of (stratum, score), in the order of scores within blocks of neighbouring scores; in front of each block
    stands a row with the block's number of draws in every replicate."""
    ship(rows.sparkSession)
    counts = score_counts(rows, by, "score", "label").select(_keyed(by).alias("_key"), block_of(F.col("score")).alias("_block"), F.col("score").cast("double").alias("score"), F.col("w1").cast("long"), F.col("w0").cast("long"))
    sizes = counts.groupBy("_key", "_block").agg(F.sum(F.col("w1") + F.col("w0")).alias("n"))

    def shared(blocks: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("_block")
        n = blocks["n"].to_numpy()
        drawn = split_draws(_seeded(seed, blocks["_key"].iloc[0]), n, np.full(replicates, n.sum()))
        return pd.DataFrame({"_key": blocks["_key"], "_block": blocks["_block"], "draws": list(drawn)})

    heads = sizes.groupBy("_key").applyInPandas(shared, "_key string, _block int, draws array<long>")  # some thousand blocks at most
    empty = lambda kind: F.lit(None).cast(kind)
    both = counts.select("_key", "_block", F.lit(False).alias("first"), "score", "w1", "w0", empty("array<long>").alias("draws")).unionByName(
        heads.join(sizes, ["_key", "_block"]).select("_key", "_block", F.lit(True).alias("first"), empty("double").alias("score"), F.col("n").alias("w1"), F.lit(0).cast("long").alias("w0"), "draws")
    )
    return both.repartition("_key", "_block").sortWithinPartitions("_key", "_block", F.desc("first"), "score")


def _drawn(batches: Iterator[pa.RecordBatch], replicates: int, seed: int) -> Iterator[tuple[str, int, float, int, int, np.ndarray, np.ndarray]]:
    """(stratum, block, score, w1, w0, positives drawn, negatives drawn) of each cell of sorted blocks. A block's draws
    are dealt to its cells one after the other, each taking a binomial share of what is left."""
    rng, left, size = None, None, 0
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in range(6)]
        heads = iter(batch.column(6).drop_null().to_pylist())
        for key, block, first, score, w1, w0 in zip(*columns, strict=True):
            if first:
                rng, left, size = _seeded(seed, key, block), np.array(next(heads), np.int64), w1
                continue
            out = []
            for n in (w1, w0):
                taken = left.copy() if n == size else rng.binomial(left, n / size) if n else np.zeros_like(left)
                left, size = left - taken, size - n
                out.append(taken)
            yield key, block, score, w1, w0, out[0], out[1]


def row_draws(rows: DataFrame, by: Sequence[str], replicates: int, seed: int = 0) -> DataFrame:
    """(by, score, w1, w0, drawn1, drawn0): how often the rows of each score and label are drawn in every replicate, when as
    many rows as a stratum has are drawn with replacement. Rows of one stratum, score and label are alike, so that these
    counts are the bootstrap of the rows themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, score, w1, w0, pos, neg in _drawn(batches, replicates, seed):
            kinds = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((key, score, w1, w0, pos, neg), kinds, strict=True)], names=["_key", "score", "w1", "w0", "drawn1", "drawn0"])

    found = _row_cells(rows, by, replicates, seed).mapInArrow(run, "_key string, score double, w1 long, w0 long, drawn1 array<long>, drawn0 array<long>")
    return rows.select(*by).distinct().withColumn("_key", _keyed(by)).join(found, "_key").drop("_key") if by else found.drop("_key")


def row_bootstrap_auroc(rows: DataFrame, by: Sequence[str], replicates: int, seed: int = 0) -> DataFrame:
    """(by, replicate, auroc) under resampling of single rows with ``score`` and ``label``; null where a class is not
    drawn. No list of all rows is made anywhere: draws are dealt to blocks of scores, and by these to scores."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, block), own in groupby(_drawn(batches, replicates, seed), key=lambda c: c[:2]):
            wins, pos, neg = (np.zeros(replicates) for _ in range(3))
            for *_, p, q in own:
                wins += p * (neg + q / 2)
                pos += p
                neg += q
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([float(block)]), *[pa.array([v], pa.list_(pa.float64())) for v in (wins, pos, neg)]], names=[c.split()[0] for c in _PARTS.split(", ")])

    parts = _row_cells(rows, by, replicates, seed).mapInArrow(run, _PARTS)
    found = parts.groupBy("_key").applyInPandas(_put_together, "_key string, auroc array<double>")
    out = rows.select(*by).distinct().withColumn("_key", _keyed(by)).join(found, "_key") if by else found
    return out.select(*by, F.posexplode("auroc").alias("_at", "auroc")).select(*by, F.col("_at").cast("long").alias("replicate"), "auroc")


def quantile(values: Column, q: float, ready: bool = False) -> Column:
    """The quantile of an array by linear interpolation; nulls are left out, and without values it is null. ``ready``
    arrays are sorted and have no nulls."""
    kept = values if ready else F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    at = (F.size(kept) - 1) * F.lit(q)
    low, high = F.get(kept, F.floor(at).cast("int")), F.get(kept, F.ceil(at).cast("int"))
    return low + (high - low) * (at - F.floor(at))


def interval(samples: DataFrame, by: Sequence[str], value: str, confidence: float = 0.95) -> DataFrame:
    """(by, n, low, high): percentiles by linear interpolation; replicates without a value are left out."""
    tail = (1 - confidence) / 2
    return samples.groupBy(*by).agg(F.count(value).alias("n"), F.percentile(value, tail).alias("low"), F.percentile(value, 1 - tail).alias("high"))


def paired_delta(samples: DataFrame, by: Sequence[str], over: str, low: str, high: str, value: str) -> DataFrame:
    """(by, replicate, delta) of two strata under the same draws."""
    wide = samples.where(F.col(over).isin(low, high)).groupBy(*by, "replicate").agg(F.max(F.when(F.col(over) == low, F.col(value))).alias("a"), F.max(F.when(F.col(over) == high, F.col(value))).alias("b"))
    return wide.select(*by, "replicate", (F.col("b") - F.col("a")).alias("delta"))


def null_summary(samples: DataFrame, observed: DataFrame, by: Sequence[str], value: str, seen: str) -> DataFrame:
    """(by, n, mean, sd, q025, q50, q975, n_reaching, p): the null distribution and the add-one share that reaches what
    was observed."""
    joined = samples.join(observed.select(*by, F.col(seen).alias("_seen")), list(by)) if by else samples.join(F.broadcast(observed.select(F.col(seen).alias("_seen"))))
    out = joined.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.percentile(value, 0.025).alias("q025"), F.percentile(value, 0.5).alias("q50"),
        F.percentile(value, 0.975).alias("q975"), F.count_if(F.col(value) >= F.col("_seen")).alias("n_reaching"),
    )
    return out.withColumn("p", (F.col("n_reaching") + 1) / (F.col("n") + 1))


def permuted_labels(rows: DataFrame, group: str, key: str, label: str, replicates: int, seed: int = 0) -> DataFrame:
    """(replicate, rows, permuted): each replicate deals a group's labels out anew, in hash order within the group, so
    that every group keeps its class balance."""
    every = rows.where(F.col(label).isNotNull()).crossJoin(F.broadcast(rows.sparkSession.range(replicates).select(F.col("id").alias("replicate"))))
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col("replicate").cast("string"), F.col(key).cast("string")), 256)
    w = Window.partitionBy("replicate", group)
    ranked = every.withColumns({"_place": F.row_number().over(w.orderBy(order, key)), "_positive": F.sum((F.col(label) == 1).cast("int")).over(w)})
    return ranked.withColumn("permuted", (F.col("_place") <= F.col("_positive")).cast("int")).drop("_place", "_positive")
