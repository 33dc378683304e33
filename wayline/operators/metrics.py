"""Exact discrimination and calibration metrics of scored rows, by any strata.

A row has a score in [0, 1] and a binary label; rows whose label is null take no part. Nothing here gathers the rows or
the scores of a stratum in one task: scores are first counted by (stratum, score), and ranked block by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def edges(n_bins: int, spaced: bool = True) -> list[float]:
    """The lower edges of equal-width bins: as multiples of the width (``spaced``), or as quotients i / n. Both are in
    use and differ in the last place for some edges, which moves scores that stand exactly on one."""
    width = 1.0 / n_bins
    return [i * width if spaced else i / n_bins for i in range(n_bins)]


def bin_of(score: Column, n_bins: int, spaced: bool = True) -> Column:
    """The bin of a score: how many edges above the first it reaches; the last bin is closed."""
    inner = edges(n_bins, spaced)[1:]
    return sum((F.when(score >= e, 1).otherwise(0) for e in inner), F.lit(0)).cast("int")


def score_counts(rows: DataFrame, by: Sequence[str], score: str, label: str, weight: str | None = None) -> DataFrame:
    """(by, score, w1, w0): the weight of positive and negative rows at each distinct score."""
    w = F.col(weight) if weight else F.lit(1)
    return rows.where(F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(
        F.sum(F.when(F.col(label) == 1, w).otherwise(0)).alias("w1"), F.sum(F.when(F.col(label) == 0, w).otherwise(0)).alias("w0")
    )


def block_of(score: Column) -> Column:
    """A number that grows with the score: its log odds in steps of 1/64, so that blocks stay small where scores crowd
    near 0 or 1. All scores outside of (0, 1) on one side share a block."""
    inside = F.least(F.greatest(F.floor(F.log2(score / (1 - score)) * 64), F.lit(-9000)), F.lit(9000))
    return F.when(score <= 0, -9999).when(score >= 1, 9999).otherwise(inside).cast("int")


def auroc(rows: DataFrame, by: Sequence[str], score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auroc): the probability that a positive outranks a negative, ties counting one half; null
    where a class is absent. Weighted rows count as that many copies.

    Scores are ranked inside blocks of neighbouring scores, and the blocks of a stratum, at most some thousand, by their
    totals; so a stratum with any number of different scores is spread over many tasks.
    """
    counts = score_counts(rows, by, score, label, weight).withColumn("_block", block_of(F.col("score")))
    below = Window.partitionBy(*by, "_block").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inner = counts.withColumn("pairs", F.col("w1") * (F.coalesce(F.sum("w0").over(below), F.lit(0)) + F.col("w0") / 2))
    blocks = inner.groupBy(*by, "_block").agg(F.sum("pairs").alias("pairs"), F.sum("w1").alias("w1"), F.sum("w0").alias("w0"))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    ranked = blocks.withColumn("pairs", F.col("pairs") + F.col("w1") * F.coalesce(F.sum("w0").over(before), F.lit(0)))
    total = ranked.groupBy(*by).agg(F.sum("pairs").alias("pairs"), F.sum("w1").alias("n_pos"), F.sum("w0").alias("n_neg"))
    return total.select(*by, "n_pos", "n_neg", F.try_divide("pairs", F.col("n_pos") * F.col("n_neg")).alias("auroc"))


def exact(score: Column) -> Column:
    """A score as a decimal of 12 places: sums do not depend on the order of rows, and a mean that lies between two
    rounded values stays there."""
    return score.cast("decimal(18,12)")


def mean(total: Column, n: Column) -> Column:
    """The quotient of a decimal sum and a number, as the nearest double."""
    return F.try_divide(total.cast("decimal(38,18)"), n.cast("decimal(20,0)")).cast("double")


def brier(score: Column, label: Column) -> Column:
    """The mean squared distance, as an aggregate."""
    d = exact(score) - label.cast("decimal(1,0)")
    return mean(F.sum(F.when(label.isNotNull(), (d * d).cast("decimal(28,18)"))), F.count(label))


def accuracy(score: Column, label: Column) -> Column:
    return F.avg(F.when(label.isNotNull(), ((score >= 0.5).cast("int") == label).cast("double")))


def bins(rows: DataFrame, by: Sequence[str], n_bins: int = 10, spaced: bool = True, score: str = "score", label: str = "label") -> DataFrame:
    """(by, bin, n, mean_score, mean_label, gap) of the bins that have rows: a reliability diagram."""
    return _bins(rows, by, n_bins, spaced, score, label).drop("apart")


def _bins(rows: DataFrame, by: Sequence[str], n_bins: int, spaced: bool, score: str, label: str) -> DataFrame:
    used = rows.where(F.col(label).isNotNull()).withColumn("bin", bin_of(F.col(score), n_bins, spaced))
    sums = used.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.sum(exact(F.col(score))).alias("_s"), F.sum(F.col(label).cast("decimal(18,0)")).alias("_l"))
    apart = F.abs(F.col("_s") - F.col("_l"))
    return sums.select(*by, "bin", "n", mean(F.col("_s"), F.col("n")).alias("mean_score"), mean(F.col("_l"), F.col("n")).alias("mean_label"), mean(apart, F.col("n")).alias("gap"), apart.alias("apart"))


def calibration(rows: DataFrame, by: Sequence[str], n_bins: int = 10, spaced: bool = True, score: str = "score", label: str = "label") -> DataFrame:
    """(by, n, ece, mce): expected and largest calibration error. A stratum without labelled rows does not appear."""
    b = _bins(rows, by, n_bins, spaced, score, label).groupBy(*by).agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"), F.max("gap").alias("mce"))
    return b.select(*by, "n", mean(F.col("apart"), F.col("n")).alias("ece"), "mce")


def snapshot(rows: DataFrame, by: Sequence[str], n_bins: int = 10, spaced: bool = True) -> DataFrame:
    """(by, n, n_pos, n_neg, auroc, brier, accuracy, ece, mce) of rows with ``score`` and ``label``."""
    flat = rows.where("label IS NOT NULL").groupBy(*by).agg(brier(F.col("score"), F.col("label")).alias("brier"), accuracy(F.col("score"), F.col("label")).alias("accuracy"))
    return auroc(rows, by).join(flat, list(by)).join(calibration(rows, by, n_bins, spaced), list(by)).select(
        *by, "n", "n_pos", "n_neg", "auroc", "brier", "accuracy", "ece", "mce"
    )


def fold_summary(rows: DataFrame, by: Sequence[str], fold: str) -> DataFrame:
    """(by, n, n_folds, pooled_auroc, mean_auroc, sd_auroc, min_auroc, max_auroc): the AUROC over all rows, and mean,
    population deviation and range of the folds' own. Folds with one class only have none and are left out of these."""
    folds = auroc(rows, [*by, fold]).groupBy(*by).agg(
        F.count("auroc").alias("n_folds"), F.avg("auroc").alias("mean_auroc"), F.stddev_pop("auroc").alias("sd_auroc"),
        F.min("auroc").alias("min_auroc"), F.max("auroc").alias("max_auroc"),
    )
    pooled = auroc(rows, by).select(*by, (F.col("n_pos") + F.col("n_neg")).alias("n"), F.col("auroc").alias("pooled_auroc"))
    return pooled.join(folds, list(by))


def deltas(metrics: DataFrame, by: Sequence[str], over: str, low: str, high: str, names: Sequence[str]) -> DataFrame:
    """(by, <name>_low, <name>_high, <name>_delta): each metric at two values of a stratum and the difference, null if
    either is. Strata that lack one of the two do not appear."""
    wide = metrics.where(F.col(over).isin(low, high)).groupBy(*by).agg(*[
        F.max(F.when(F.col(over) == value, F.col(n))).alias(f"{n}_{end}") for n in names for end, value in (("low", low), ("high", high))
    ], F.countDistinct(over).alias("sides"))
    out = wide.where("sides = 2")
    return out.select(*by, *[c for n in names for c in (F.col(f"{n}_low"), F.col(f"{n}_high"), (F.col(f"{n}_high") - F.col(f"{n}_low")).alias(f"{n}_delta"))])


def tidy(metrics: DataFrame, by: Sequence[str], names: Sequence[str], record: str) -> DataFrame:
    """One row for each metric: (record_type, by, metric, value)."""
    return metrics.select(F.lit(record).alias("record_type"), *by, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select("record_type", *by, "m.metric", "m.value")


def best(rows: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """The row of each stratum with the largest value; NaN and null count as smallest, ties go to the lowest ``order``."""
    rank = F.coalesce(F.nanvl(F.col(value), F.lit(float("-inf"))), F.lit(float("-inf")))
    w = Window.partitionBy(*by).orderBy(rank.desc(), F.col(order))
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def fold_band(folds: DataFrame, by: Sequence[str], value: str = "auroc") -> DataFrame:
    """(by, mean, q25, q75) of the folds' values, quantiles by linear interpolation."""
    return folds.groupBy(*by).agg(F.avg(value).alias("mean"), F.percentile(value, 0.25).alias("q25"), F.percentile(value, 0.75).alias("q75"))


def error_bars(df: DataFrame, value: str, low: str, high: str) -> DataFrame:
    """Adds ``bar_low`` and ``bar_high``: half-widths of an interval, not below 0; (0, 0) without an interval."""
    known = F.col(low).isNotNull() & F.col(high).isNotNull() & F.col(value).isNotNull()
    half = lambda x: F.when(known, F.greatest(x, F.lit(0.0))).otherwise(0.0)
    return df.withColumns({"bar_low": half(F.col(value) - F.col(low)), "bar_high": half(F.col(high) - F.col(value))})


def agent_summary(rows: DataFrame, by: Sequence[str], fold: str, key: str, n_bins: int = 10) -> DataFrame:
    """(by, n, n_trajectories, n_folds, pooled and the folds' AUROC, brier, ece) of scored rows, usually by thinking mode,
    agent, probe and layer."""
    known = rows.where("label IS NOT NULL")
    counts = known.groupBy(*by).agg(F.countDistinct(key).alias("n_trajectories"), brier(F.col("score"), F.col("label")).alias("brier"))
    return fold_summary(rows, by, fold).join(counts, list(by)).join(calibration(rows, by, n_bins, spaced=False).select(*by, "ece"), list(by))
