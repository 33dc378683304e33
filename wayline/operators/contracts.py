"""Data contracts as violation frames: each rule gives rows (rule_id, key, detail); no rule fails by itself."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A strict check found violations."""


def _key(columns: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def required(rows: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Fields that are null."""
    absent = F.array_compact(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]))
    return rows.select(F.lit("required").alias("rule_id"), _key(key).alias("key"), F.array_join(absent, ",").alias("detail")).where("detail <> ''")


def allowed(rows: DataFrame, key: Sequence[str], field: str, values: Sequence[object]) -> DataFrame:
    """Values outside a closed list; null is one only if it is listed."""
    ok = F.col(field).isin([v for v in values if v is not None]) if any(v is not None for v in values) else F.lit(False)
    ok = F.coalesce(ok, F.lit(None in values))
    return rows.where(~ok).select(F.lit(f"allowed:{field}").alias("rule_id"), _key(key).alias("key"), F.coalesce(F.col(field).cast("string"), F.lit("null")).alias("detail"))


def holds(rows: DataFrame, key: Sequence[str], rule: str, condition: Column, detail: Column | None = None) -> DataFrame:
    """Rows for which a condition is not true; unknown is not true."""
    return rows.where(~F.coalesce(condition, F.lit(False))).select(F.lit(rule).alias("rule_id"), _key(key).alias("key"), (detail if detail is not None else F.lit("")).cast("string").alias("detail"))


def unique(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that several rows have."""
    return rows.groupBy(*key).count().where("count > 1").select(F.lit("unique").alias("rule_id"), _key(key).alias("key"), F.col("count").cast("string").alias("detail"))


def depends(rows: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Functional dependencies: fields that have several values (null counting as one) for one key. The least and
    greatest value are enough to see that and combine before the shuffle."""
    shown = {f: F.coalesce(F.col(f).cast("string"), F.lit("\x00")) for f in fields}
    per = rows.groupBy(*key).agg(*[a for f, c in shown.items() for a in (F.min(c).alias(f"{f}__a"), F.max(c).alias(f"{f}__b"))])
    bad = F.array_compact(F.array(*[F.when(F.col(f"{f}__a") != F.col(f"{f}__b"), F.lit(f)) for f in fields]))
    return per.select(F.lit("depends").alias("rule_id"), _key(key).alias("key"), F.array_join(bad, ",").alias("detail")).where("detail <> ''")


def same_coverage(rows: DataFrame, key: Sequence[str], item: str) -> DataFrame:
    """Keys that don't have all the items that some key has."""
    per = rows.groupBy(*key).agg(F.countDistinct(item).alias("n"))
    most = rows.agg(F.countDistinct(item).alias("all"))
    return per.join(F.broadcast(most)).where("n <> all").select(F.lit(f"coverage:{item}").alias("rule_id"), _key(key).alias("key"), F.concat_ws("/", F.col("n").cast("string"), F.col("all").cast("string")).alias("detail"))


def one_value(rows: DataFrame, field: str) -> DataFrame:
    """A single row if a field has not exactly one value over all rows."""
    per = rows.agg(F.countDistinct(field).alias("n"))
    return per.where("n <> 1").select(F.lit(f"one_value:{field}").alias("rule_id"), F.lit("").alias("key"), F.col("n").cast("string").alias("detail"))


def violations(*rules: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, rules)


def enforce(rows: DataFrame, *rules: DataFrame, show: int = 5) -> DataFrame:
    """``rows`` if no rule is violated; else an error that names the first violations."""
    if found := violations(*rules).limit(show).collect():
        raise ContractError("; ".join(f"{r['rule_id']} at {r['key']}: {r['detail']}" for r in found))
    return rows


def cohort(index: DataFrame, sample: Sequence[str], label: str, layers: str) -> DataFrame:
    """What keeps an index from being one cohort of probes: several checkpoints or tiers, a sample that is there twice, a
    label that is not binary, and no layer that all samples have."""
    shared = index.select(*sample, F.explode(layers).alias("_layer")).distinct().groupBy("_layer").agg(F.count("*").alias("_n"))
    samples = index.select(*sample).distinct().agg(F.count("*").alias("_all"))
    common = samples.join(shared.agg(F.max("_n").alias("_most"))).select((F.col("_all") == F.col("_most")).alias("ok"))  # one row each
    return violations(
        one_value(index, "checkpoint"), one_value(index.withColumn("analysis_tier", F.coalesce("analysis_tier", F.lit("unclassified"))), "analysis_tier"), unique(index, sample), allowed(index, sample, label, [0, 1]),
        holds(common, [], "common_layer", F.col("ok")),
    )


def split_manifest(manifest: DataFrame, modes: Sequence[str] = ("train", "validation", "test"), group: str = "match_group_id", key: str = "trajectory_id") -> DataFrame:
    """What a split manifest (group, split, thinking_mode, condition, hop_mode, key) breaks: splits outside of the list or
    without groups, groups in several splits, cells that are missing or have several trajectories, and trajectories that
    leak from one split into another."""
    cells = manifest.groupBy(group, "thinking_mode").agg(F.countDistinct("condition", "hop_mode").alias("n"), F.countDistinct(key).alias("t"), F.count("*").alias("rows"))
    every = manifest.select("split").distinct().agg(F.array_sort(F.collect_set("split")).alias("v"))
    return violations(
        allowed(manifest, [group], "split", modes), depends(manifest, [group], ["split"]), depends(manifest, [key], ["split"]),
        holds(cells, [group, "thinking_mode"], "cells", (F.col("n") == 4) & (F.col("t") == 4) & (F.col("rows") == 4), F.concat_ws("/", F.col("n").cast("string"), F.col("t").cast("string"))),
        holds(every, [], "every_split", F.size(F.array_except(F.array(*[F.lit(m) for m in modes]), "v")) == 0, F.array_join("v", ",")),
    )


def equal_configs(rows: DataFrame, by: str, values: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Settings that are not one for each value of ``by``, and values that have none."""
    return violations(depends(rows, [by], fields), holds(rows.agg(F.collect_set(by).alias("v")), [], f"covers:{by}", F.size(F.array_except(F.array(*[F.lit(x) for x in values]), "v")) == 0, F.array_join(F.array_sort("v"), ",")))


def seeds_repeat(turns: DataFrame, key: str, stated: str, used: str) -> DataFrame:
    """(key, n, n_different) of the trajectories whose turns did not all use the seed that the trajectory states."""
    per = turns.groupBy(key).agg(F.count("*").alias("n"), F.count_if(~F.col(stated).eqNullSafe(F.col(used))).alias("n_different"))
    return per.where("n_different > 0")
