"""Deterministic splits of groups by hash order, and leave-one-group-out expansion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_key(seed: int | str, value: Column) -> Column:
    """The order key of a seeded shuffle: the hex digest of ``seed:value``."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), value.cast("string")), 256)


def split_counts(n: int, train: float, validation: float) -> list[int]:
    """How many of n groups are for training, validation and testing: the first two are rounded, half to even, to at
    least one, and testing has what is left. It gets its one group from training, then from validation. Fewer than three
    groups, or a share that is not positive, are an error."""
    if min(train, validation, 1.0 - train - validation) <= 0:
        raise ValueError("all shares must be positive")
    if n < 3:
        raise ValueError("at least three groups are needed for three splits")
    counts = [max(1, round(n * train)), max(1, round(n * validation))]
    for i in (0, 1):
        short = max(0, 1 - (n - sum(counts)))
        counts[i] -= min(short, counts[i] - 1)
    return [*counts, n - sum(counts)]


def assign_splits(groups: DataFrame, group: str, train: float = 0.6, validation: float = 0.2, seed: int = 42, names: Sequence[str] = ("train", "validation", "test")) -> DataFrame:
    """(group, place, split) of the distinct groups in hash order. The groups of a design are few; their ranks need one
    sorted list of them, not of the rows."""
    distinct = groups.select(group).where(F.col(group).isNotNull()).distinct()
    counts = split_counts(distinct.count(), train, validation)
    ranked = distinct.withColumn("place", F.row_number().over(Window.orderBy(hash_key(seed, F.col(group)))))
    split = F.coalesce(*[F.when(F.col("place") <= sum(counts[: i + 1]), F.lit(name)) for i, name in enumerate(names)])
    return ranked.select(group, "place", split.alias("split"))


def unsplit(groups: DataFrame, group: str, name: str = "all") -> DataFrame:
    """(group, split) with one split, for designs that are too small for three."""
    return groups.select(group).where(F.col(group).isNotNull()).distinct().withColumn("split", F.lit(name))


def leave_one_out(rows: DataFrame, groups: DataFrame, group: str, fold: str = "fold") -> DataFrame:
    """Each row once for each group, with ``is_test`` where the group is its own. For small tables of keys, and rows
    without their vectors; what only needs sums over a fold's rows is :func:`fold_totals`."""
    folds = groups.select(F.col(group).alias(fold)).distinct()
    return rows.crossJoin(folds).withColumn("is_test", F.col(group) == F.col(fold))


def fold_totals(rows: DataFrame, by: Sequence[str], group: str, sums: dict[str, Column], fold: str = "fold") -> DataFrame:
    """(by, fold, is_test, sums) over the rows that leave-one-group-out expansion would give, from each group's own sums:
    a fold's training rows are all rows less the group's. A side without rows does not appear."""
    own = rows.groupBy(*by, F.col(group).alias(fold)).agg(F.count("*").alias("_n"), *[F.sum(c).alias(n) for n, c in sums.items()])
    total = own.groupBy(*by).agg(*[F.sum(c).alias(f"_{c}_all") for c in ("_n", *sums)])
    both = own.join(total, list(by)) if by else own.crossJoin(total)  # one row
    side = lambda test: F.struct(F.lit(test).alias("is_test"), *[(F.col(c) if test else F.col(f"_{c}_all") - F.coalesce(F.col(c), F.lit(0))).alias(c) for c in ("_n", *sums)])
    return both.select(*by, fold, F.explode(F.array(side(True), side(False))).alias("_side")).where("_side._n > 0").select(*by, fold, "_side.is_test", *[f"_side.{c}" for c in sums])


def fold_skips(rows: DataFrame, by: Sequence[str], group: str, label: str) -> DataFrame:
    """(by, reason): why a stratum can't be cross-validated by group, null if it can.

    By training counts instead of an expansion: a fold's training rows are the stratum's less the group's own.
    """
    own = rows.groupBy(*by, group).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"), F.count_if(F.col(label).isNull()).alias("u"))
    w = Window.partitionBy(*by)
    folds = own.withColumns({"left_p": F.sum("p").over(w) - F.col("p"), "left_n": F.sum("n").over(w) - F.col("n")})
    per = folds.groupBy(*by).agg(F.sum("u").alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.count("*").alias("groups"), F.min(F.least("left_p", "left_n")).alias("least"))
    reason = (
        F.when(F.col("u") > 0, "missing_label").when((F.col("p") == 0) | (F.col("n") == 0), "single_class")
        .when(F.col("groups") < 2, "too_few_groups").when(F.col("least") == 0, "fold_lacks_class")
    )
    return per.select(*by, reason.alias("reason"))


def class_ranks(rows: DataFrame, key: str, label: str, seed: int = 0) -> DataFrame:
    """Adds ``_rank``, from 0, the place of a row in the hash order of its class. Rows are ranked among those that share
    the beginning of their hash, and the beginnings, at most 4,096 of a class, by their numbers of rows."""
    shown = F.when(F.col(label).isNull(), "n").otherwise(F.concat(F.lit("v"), F.col(label).cast("string")))
    hashed = rows.withColumns({"_h": hash_key(seed, F.col(key)), "_c": shown}).withColumn("_p", F.left("_h", F.lit(3))).withColumn("_k", F.concat_ws(" ", "_p", "_c"))
    sizes = hashed.groupBy("_k").agg(F.min("_c").alias("_c"), F.min("_p").alias("_p"), F.count("*").alias("_size"))
    before = Window.partitionBy("_c").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_k", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    ranked = hashed.withColumn("_r", F.row_number().over(Window.partitionBy("_k").orderBy("_h", key)) - 1)
    placed = ranked.join(starts, "_k")  # on the dealing that the ranks have already
    return placed.withColumn("_rank", F.col("_start") + F.col("_r")).drop("_h", "_p", "_c", "_k", "_start", "_r")


def stratified_folds(rows: DataFrame, key: str, label: str, k: int, seed: int = 0) -> DataFrame:
    """Adds ``fold``, 0 to k - 1: within each class rows are dealt round in hash order."""
    return class_ranks(rows, key, label, seed).withColumn("fold", (F.col("_rank") % k).cast("int")).drop("_rank")


def group_folds(rows: DataFrame, group: str, k: int, seed: int = 0) -> DataFrame:
    """Adds ``fold``, 0 to k - 1, by whole groups (match groups, pairs): the groups are dealt round in hash order, and rows
    without a group have no fold."""
    groups = rows.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_one", F.lit(1))
    return rows.join(stratified_folds(groups, group, "_one", k, seed).drop("_one"), group, "left")
