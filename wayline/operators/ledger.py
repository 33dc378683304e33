"""Cost ledgers in decimals: roll-ups, pivots, deduplication with conflicts, estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(38,18)"
SUM = "decimal(38,10)"


def money(c: Column) -> Column:
    """A cost as a decimal; null if it is no number or negative."""
    value = c.cast("string").try_cast(MONEY)
    return F.when(value >= 0, value)


def exploded(rows: DataFrame, keys: Sequence[str], costs: str) -> DataFrame:
    """(keys, resource, cost) of rows with a map of costs by resource."""
    return rows.select(*keys, F.explode(costs).alias("resource", "cost"))


def rollup(rows: DataFrame, app: str, resource: str, cost: str, at: str) -> DataFrame:
    """(level, app, resource, cost, first_at, last_at, n) for the total, each app and each (app, resource): one scan, one
    shuffle, exact sums."""
    total = rows.groupingSets([[], [F.col(app)], [F.col(app), F.col(resource)]], F.col(app), F.col(resource)).agg(
        F.grouping_id().alias("g"), F.sum(F.col(cost).cast(SUM)).alias("cost"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), F.count("*").alias("n")
    )
    level = F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "app").otherwise("resource")
    return total.select(level.alias("level"), F.col(app).alias("app"), F.col(resource).alias("resource"), "cost", "first_at", "last_at", "n")


def pivoted(rows: DataFrame, app: str, resource: str, cost: str, resources: Sequence[str]) -> DataFrame:
    """One column of cost for each resource, 0 where an app has none."""
    return rows.groupBy(app).agg(*[F.coalesce(F.sum(F.when(F.col(resource) == r, F.col(cost).cast(SUM))), F.lit(0).cast(SUM)).alias(f"cost_{r}") for r in resources])


def deduplicated(rows: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, fields, copies, conflict): one row for each key; ``conflict`` where its rows differ in some field, and the
    fields are then those of the smallest row."""
    shown = F.struct(*fields)
    per = rows.groupBy(*key).agg(F.count("*").alias("copies"), F.min(shown).alias("a"), F.max(shown).alias("b"))
    return per.select(*key, *[F.col(f"a.{f}").alias(f) for f in fields], "copies", (~F.col("a").eqNullSafe(F.col("b"))).alias("conflict"))


def imbalance(app_totals: DataFrame, resource_totals: DataFrame, app: str, tolerance: float = 1e-8) -> DataFrame:
    """Apps whose total is not the sum of their resources."""
    s = resource_totals.groupBy(app).agg(F.sum("cost").alias("resources"))
    both = app_totals.select(app, F.col("cost").alias("total")).join(s, app, "full_outer")
    return both.where(F.coalesce(F.abs(F.col("total") - F.col("resources")) > tolerance, F.lit(True)))


def gpu_cost(elapsed: Column, rate: float, gpus: Column, prompt_tokens: Column, new_tokens: Column) -> Column:
    """(seconds, cost, tokens_per_second, cost_per_1k): seconds and costs rounded half to even; rates null on 0."""
    seconds = F.bround(elapsed.cast("double"), 6)
    cost = F.bround(seconds * F.lit(rate) * gpus, 8)
    return F.struct(
        seconds.alias("seconds"), cost.alias("cost"), F.bround(F.try_divide(new_tokens.cast("double"), seconds), 6).alias("tokens_per_second"),
        F.bround(F.try_divide(cost * 1000, (prompt_tokens + new_tokens).cast("double")), 8).alias("cost_per_1k"),
    )


def token_usage(prompt: Column, thinking: Column, final: Column, total: Column) -> Column:
    """(generated, total, consistent): parts that are not negative and add up to no more than the stated total."""
    generated = thinking + final
    ok = (F.least(prompt, thinking, final) >= 0) & (prompt + generated <= total)
    return F.struct(generated.alias("generated"), (prompt + generated).alias("total"), F.coalesce(ok, F.lit(False)).alias("consistent"))


def protocol_ledger(turns: DataFrame, by: Sequence[str], tokens: str, cost: str, truncated: Column, order: Sequence[str]) -> DataFrame:
    """(by, n_turns, tokens, cost, n_truncated, and the turn with the most tokens): the first in ``order`` of ties."""
    largest = F.min(F.struct((-F.col(tokens)).alias("_t"), *order))
    per = turns.groupBy(*by).agg(F.count("*").alias("n_turns"), F.sum(tokens).alias("tokens"), F.sum(F.col(cost).cast(SUM)).alias("cost"), F.count_if(truncated).alias("n_truncated"), largest.alias("_l"))
    return per.select(*by, "n_turns", "tokens", "cost", "n_truncated", (-F.col("_l._t")).alias("largest_tokens"), *[F.col(f"_l.{o}").alias(f"largest_{o}") for o in order])


def deduplicated_costs(rows: DataFrame, key: str, cost: str, tier: str, wanted: str) -> DataFrame:
    """(n_rows, n_inputs, cost, n_conflicts, n_other_tier) in one row: cost records are read once for each input id, those
    whose copies differ are counted as conflicts and left out, and so are those of other tiers."""
    per = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct(cost, tier)).alias("a"), F.max(F.struct(cost, tier)).alias("b"))
    same = F.col("a").eqNullSafe(F.col("b"))
    own = same & (F.col(f"a.{tier}") == wanted)
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(own).alias("n_inputs"), F.coalesce(F.sum(F.when(own, F.col(f"a.{cost}").cast(SUM))), F.lit(0).cast(SUM)).alias("cost"),
        F.count_if(~same).alias("n_conflicts"), F.count_if(same & ~F.coalesce(F.col(f"a.{tier}") == wanted, F.lit(False))).alias("n_other_tier"),
    )


def outcome_sizes(rows: DataFrame, treatment: str, outcome: str, agent: str, key: str) -> DataFrame:
    """(kind, name, n): trajectories of each ``treatment:outcome``, and of each agent, in one pass."""
    each = F.explode(F.array(F.struct(F.lit("outcome").alias("kind"), F.concat_ws(":", treatment, outcome).alias("name")), F.struct(F.lit("agent").alias("kind"), F.col(agent).alias("name"))))
    return rows.select(key, each.alias("e")).groupBy("e.kind", "e.name").agg(F.countDistinct(key).alias("n"))


def referenced(apps: DataFrame, harvest: DataFrame, app: str, files: str = "files") -> DataFrame:
    """(app, cost and what else ``apps`` has, files, status): billed apps with the files that name them, ``referenced`` or
    ``unreferenced``; ids in files that were never billed are ``not billed``. ``harvest`` has a row for each id."""
    both = apps.join(harvest.select(app, F.col(files).alias("_files")), app, "full_outer").join(apps.select(app, F.lit(True).alias("_billed")).distinct(), app, "left")
    status = F.when(F.col("_billed").isNull(), "not billed").when(F.size("_files") > 0, "referenced").otherwise("unreferenced")
    return both.withColumn("status", status).withColumn(files, F.coalesce("_files", F.array().cast("array<string>"))).drop("_files", "_billed")
