"""Pairs of treated and untreated rows, design grids and what is missing from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def paired(rows: DataFrame, key: Sequence[str], side: str, low: str, high: str, values: Sequence[str]) -> DataFrame:
    """(key, n_low, n_high, <value>_low, <value>_high, status) by one aggregate: status is ``complete``, ``duplicate``
    if a side has several rows (a join would multiply them), or ``incomplete``. Values of duplicates are null."""
    ends = (("low", low), ("high", high))
    wide = rows.where(F.col(side).isin(low, high)).groupBy(*key).agg(
        *[F.count_if(F.col(side) == v).alias(f"n_{e}") for e, v in ends],
        *[F.max(F.when(F.col(side) == v, F.col(c))).alias(f"{c}_{e}") for c in values for e, v in ends],
    )
    status = F.when((F.col("n_low") > 1) | (F.col("n_high") > 1), "duplicate").when((F.col("n_low") == 1) & (F.col("n_high") == 1), "complete").otherwise("incomplete")
    out = wide.withColumn("status", status)
    return out.select(*key, "n_low", "n_high", *[F.when(F.col(f"n_{e}") == 1, F.col(f"{c}_{e}")).alias(f"{c}_{e}") for c in values for e, _ in ends], "status")


def pair_deltas(rows: DataFrame, key: Sequence[str], side: str, low: str, high: str, value: str) -> DataFrame:
    """(key, low, high, delta) of complete pairs."""
    p = paired(rows, key, side, low, high, [value]).where("status = 'complete'")
    return p.select(*key, F.col(f"{value}_low").alias("low"), F.col(f"{value}_high").alias("high"), (F.col(f"{value}_high") - F.col(f"{value}_low")).alias("delta"))


def incomplete_pairs(rows: DataFrame, key: Sequence[str], side: str, low: str, high: str) -> DataFrame:
    """(key, n_low, n_high, status) of the pairs that are not complete."""
    return paired(rows, key, side, low, high, []).where("status <> 'complete'")


def grid(*dimensions: DataFrame) -> DataFrame:
    """Every combination of the rows of small design tables (a design has as many cells as it names, not as rows)."""
    out = dimensions[0]
    for d in dimensions[1:]:
        out = out.crossJoin(d)
    return out


def coverage(expected: DataFrame, observed: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key, n, status) of every expected or observed cell: ``present``, ``missing``, ``unexpected`` or ``duplicate``."""
    seen = observed.groupBy(*key).agg(F.count("*").alias("n"))
    want = expected.select(*key).distinct().withColumn("_want", F.lit(True))
    both = want.join(seen, list(key), "full_outer").select(*key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("_want", F.lit(False)).alias("_want"))
    status = F.when(~F.col("_want"), "unexpected").when(F.col("n") == 0, "missing").when(F.col("n") > 1, "duplicate").otherwise("present")
    return both.select(*key, "n", status.alias("status"))


def pending(plan: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """What of a plan has no finished row yet."""
    return plan.join(done.select(*key).distinct(), list(key), "left_anti")


def looked_up(rows: DataFrame, table: DataFrame, key: Sequence[str], flag: str = "missing") -> DataFrame:
    """A left join with a design table; ``flag`` marks rows whose key it lacks."""
    return rows.join(table.withColumn("_known", F.lit(True)), list(key), "left").withColumn(flag, F.col("_known").isNull()).drop("_known")


def membership(rows: DataFrame, cohorts: dict[str, Sequence[str]], group: str) -> DataFrame:
    """A row for each cohort that has the row's group: all cohorts in one pass."""
    pairs = [F.struct(F.lit(c).alias("cohort"), F.array(*[F.lit(g) for g in groups]).alias("groups")) for c, groups in cohorts.items()]
    own = F.transform(F.filter(F.array(*pairs), lambda c: F.array_contains(c["groups"], F.col(group))), lambda c: c["cohort"])
    return rows.withColumn("cohort", F.explode(own))


def contrast(rows: DataFrame, key: Sequence[str], label: str, vector: str) -> DataFrame:
    """(key, difference) of pairs with one positive and one negative row: their vectors' difference."""
    one = rows.groupBy(*key).agg(
        F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"),
        F.max_by(vector, F.when(F.col(label) == 1, 1)).alias("vp"), F.max_by(vector, F.when(F.col(label) == 0, 1)).alias("vn"),
    ).where("p = 1 AND n = 1")
    return one.select(*key, F.zip_with("vp", "vn", lambda a, b: a.cast("double") - b.cast("double")).alias("difference"))


def mismatches(rows: DataFrame, pairs: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds ``mismatch``: the names of the pairs of columns that differ, null equal to null."""
    return rows.withColumn("mismatch", F.array_compact(F.array(*[F.when(~a.eqNullSafe(b), F.lit(n)) for n, (a, b) in pairs.items()])))
