"""Ordered steps of trajectories: anchors, divergence around them, summaries, contiguity.

All of these are grouped aggregates wherever the order only decides a minimum or maximum; windows are partitioned by
trajectory.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def anchors(steps: DataFrame, key: str, step: str, is_anchor: Column) -> DataFrame:
    """(key, n_anchors, anchor): how many steps are anchors, and the step of the only one (null unless there is one)."""
    found = steps.groupBy(key).agg(F.count_if(is_anchor).alias("n_anchors"), F.min(F.when(is_anchor, F.col(step))).alias("first"))
    return found.select(key, "n_anchors", F.when(F.col("n_anchors") == 1, F.col("first")).alias("anchor"))


def temporal_divergence(steps: DataFrame, key: Sequence[str], step: str, score: str, anchor: str, margin: float = 0.0) -> DataFrame:
    """(key, n_pre, n_post, pre_mean, post_mean, divergence, peak_shift, persistence) around each row's ``anchor``.

    The anchor's own step counts as after it. Persistence is the share of later steps above pre_mean + margin. A
    trajectory without steps on one side has nulls for what needs them.
    """
    before = F.col(step) < F.col(anchor)
    sides = steps.where(F.col(anchor).isNotNull()).groupBy(*key).agg(
        F.count_if(before).alias("n_pre"), F.count_if(~before).alias("n_post"), F.avg(F.when(before, F.col(score))).alias("pre_mean"),
        F.avg(F.when(~before, F.col(score))).alias("post_mean"), F.max(F.when(~before, F.col(score))).alias("peak"),
    )
    # The mean before the anchor is needed row by row: joined back on the key that the aggregate is already dealt by.
    above = steps.where(~before).join(sides.select(*key, F.col("pre_mean").alias("_pre")), list(key))
    share = above.groupBy(*key).agg(F.avg((F.col(score) > F.col("_pre") + margin).cast("double")).alias("persistence"))
    return sides.join(share, list(key), "left").select(
        *key, "n_pre", "n_post", "pre_mean", "post_mean", (F.col("post_mean") - F.col("pre_mean")).alias("divergence"),
        (F.col("peak") - F.col("pre_mean")).alias("peak_shift"), "persistence",
    )


def contiguity_violations(steps: DataFrame, key: str, step: str) -> DataFrame:
    """(key, n, lowest, highest, different) of the trajectories whose steps are not 0, 1, ..., n - 1."""
    per = steps.groupBy(key).agg(F.count("*").alias("n"), F.min(step).alias("lowest"), F.max(step).alias("highest"), F.countDistinct(step).alias("different"))
    return per.where(~((F.col("lowest") == 0) & (F.col("highest") == F.col("n") - 1) & (F.col("different") == F.col("n"))) | F.col("lowest").isNull())


def with_previous(steps: DataFrame, key: str, step: str, columns: dict[str, str]) -> DataFrame:
    """Adds, for each column -> new name, the value of the step before."""
    w = Window.partitionBy(key).orderBy(step)
    return steps.withColumns({new: F.lag(old).over(w) for old, new in columns.items()})


def first_by_type(events: DataFrame, key: str, kind: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first event of each (key, kind): ``columns`` of the row that comes first in ``order``."""
    first = F.min(F.struct(*order, *[c for c in columns if c not in order]))
    return events.groupBy(key, kind).agg(first.alias("f")).select(key, kind, *[F.col(f"f.{c}").alias(c) for c in columns])


def handoff_distance(steps: DataFrame, key: str, step: str, injected: Column, compromised: Column) -> DataFrame:
    """(key, injected_at, compromised_at, handoffs): steps from the first injection to the first compromise; null
    without either. A negative distance is for a contract to report."""
    per = steps.groupBy(key).agg(F.min(F.when(injected, F.col(step))).alias("injected_at"), F.min(F.when(compromised, F.col(step))).alias("compromised_at"))
    return per.withColumn("handoffs", F.col("compromised_at") - F.col("injected_at"))


def trajectory_summary(steps: DataFrame, key: str, step: str, first: Sequence[str] = (), last: Sequence[str] = (), counts: dict[str, Column] | None = None) -> DataFrame:
    """One row for each trajectory: steps, the first value of some columns and the last of others in the order of the
    steps, nulls passed over, and sums of conditions."""
    col, at = F.col, F.col(step)
    return steps.groupBy(key).agg(
        F.count("*").alias("n_steps"),
        *[F.min_by(col(c), F.when(col(c).isNotNull(), at)).alias(f"first_{c}") for c in first],
        *[F.max_by(col(c), F.when(col(c).isNotNull(), at)).alias(f"last_{c}") for c in last],
        *[F.count_if(c).alias(n) for n, c in (counts or {}).items()],
    )


def grouped_rates(summaries: DataFrame, fields: Sequence[str], rates: dict[str, tuple[str, str]], sums: Sequence[str]) -> DataFrame:
    """Sums and rates (numerator, denominator) in total and by each field on its own, in one pass: (level, value, n,
    sums, rates). A rate with a denominator of 0 is null."""
    level = F.array(F.struct(F.lit("all").alias("level"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(f).alias("level"), F.col(f).cast("string").alias("value")) for f in fields])
    total = summaries.withColumn("_g", F.explode(level)).groupBy(F.col("_g.level").alias("level"), F.col("_g.value").alias("value")).agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in sums])
    return total.select("level", "value", "n", *sums, *[F.try_divide(F.col(a).cast("double"), F.col(b)).alias(r) for r, (a, b) in rates.items()])


def order_mismatches(steps: DataFrame, key: str, step: str, node: str, expected: Sequence[str]) -> DataFrame:
    """(key, path) of the trajectories whose nodes, in the order of the steps, are not the expected ones."""
    path = F.transform(F.array_sort(F.collect_list(F.struct(step, node))), lambda s: s[node])
    return steps.groupBy(key).agg(path.alias("path")).where(~F.col("path").eqNullSafe(F.array(*[F.lit(x) for x in expected])))


def position_profile(steps: DataFrame, step: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, step, n, mean) of the scores at each position."""
    return steps.groupBy(*by, step).agg(F.count(score).alias("n"), F.avg(score).alias("mean"))


def running_index(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "pair_index") -> DataFrame:
    """Numbers the rows of each group from 0 in a total order."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
