"""Controls of paired measurements: profiles of distances, strict and stochastic agreement, the negative control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(distances: DataFrame, by: Sequence[str], relative: str = "relative", cosine: str = "cosine") -> DataFrame:
    """(by, n, mean, median and largest relative distance, mean cosine)."""
    return distances.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(relative).alias("mean_relative"), F.median(relative).alias("median_relative"), F.max(relative).alias("max_relative"), F.avg(cosine).alias("mean_cosine")
    )


def strict(rows: DataFrame, by: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """(by, n, <condition>, passed): whether each condition holds for all rows; unknown does not hold."""
    per = rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.bool_and(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])
    passed = F.lit(True)
    for n in conditions:
        passed = passed & F.col(n)
    return per.withColumn("passed", passed)


def counted(rows: DataFrame, by: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    """(by, n, n_<condition>)."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[F.count_if(c).alias(f"n_{n}") for n, c in conditions.items()])


def negative_control(metrics: DataFrame, by: Sequence[str], item: str, value: str = "auroc", limit: float = 0.75) -> DataFrame:
    """(by, strongest, largest, verdict): a stratum fails if any item reaches the limit; without a value it is not
    available. Of equal values the first item in order is named."""
    per = metrics.groupBy(*by).agg(F.max(value).alias("largest"), F.min(F.when(F.col(value).isNotNull(), F.struct((-F.col(value)).alias("v"), F.col(item).alias("i")))).alias("s"))
    verdict = F.when(F.col("largest").isNull(), "NOT AVAILABLE").when(F.col("largest") >= limit, "FAIL").otherwise("PASS")
    return per.select(*by, F.col("s.i").alias("strongest"), "largest", verdict.alias("verdict"))


def strict_overall(per: DataFrame, by: Sequence[str], passed: str = "passed") -> DataFrame:
    """(by, n_modes, passed) over the modes of :func:`strict`: an AND of ANDs; without modes nothing passes."""
    return per.groupBy(*by).agg(F.count("*").alias("n_modes"), F.bool_and(F.coalesce(passed, F.lit(False))).alias("passed"))


def prompt_mismatches(rows: DataFrame, key: Sequence[str], side: str, low: str, high: str, digest: str) -> DataFrame:
    """(key, <digest>_low, <digest>_high) of the pairs whose two sides did not see the same prompt, or lack a side."""
    from wayline.operators.pairs import paired

    p = paired(rows, key, side, low, high, [digest])
    return p.where(~(F.col("status") == "complete") | ~F.col(f"{digest}_low").eqNullSafe(F.col(f"{digest}_high"))).drop("n_low", "n_high", "status")


def annotated(strata: DataFrame, states: DataFrame, on: Sequence[str], state: str = "state") -> DataFrame:
    """``strata`` with the state of the control that was run for their mode and checkpoint, say; ``NOT AVAILABLE`` where there
    was none, and ``AMBIGUOUS`` where several controls of one key differ."""
    one = states.groupBy(*on).agg(F.when(F.countDistinct(state) > 1, "AMBIGUOUS").otherwise(F.max(state)).alias("_state"))
    return strata.join(one, list(on), "left").withColumn(state, F.coalesce("_state", F.lit("NOT AVAILABLE"))).drop("_state")
