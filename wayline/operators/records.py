"""Records of runs: optional filters, predicates on nested calls, normalisation, catalogues and acceptance reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where_equal(rows: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal to all given values; None is a wildcard."""
    tests = [F.col(k) == v for k, v in wanted.items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows


# Fixed values.
EXECUTED = ("executed", "completed", "succeeded", "success")
UNFINISHED = ("length", "timeout", "error", "failed", "cancelled", "canceled", "content_filter")
UNFINISHED_STATUS = ("timeout", "error", "failed", "cancelled", "canceled", "incomplete")
COMPROMISED = ("compromised_context", "unsafe_action_attempted", "unsafe_action_executed")


def any_call(calls: Column, *flags: str) -> Column:
    """Whether some call of an array has one of these fields true."""
    return F.coalesce(F.exists(calls, lambda c: reduce(lambda a, b: a | b, [F.coalesce(c[f], F.lit(False)) for f in flags])), F.lit(False))


def is_injection(point: Column, calls: Column) -> Column:
    """Whether a record carries the injection: it names an injection point, or one of its calls is the injection tool or
    has the status ``injected``."""
    call = F.exists(calls, lambda c: F.coalesce(c["tool"] == "injection", F.lit(False)) | F.coalesce(c["status"] == "injected", F.lit(False)))
    return F.coalesce(point != "", F.lit(False)) | F.coalesce(call, F.lit(False))


def is_compromised(label: Column, *seen: Column) -> Column:
    """Whether a step is compromised: by its label, or by one of the flags that say what was seen."""
    return reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), seen, F.coalesce(label.isin(*COMPROMISED), F.lit(False)))


def unsafe_calls(calls: Column, status: str | None = None) -> Column:
    """Calls whose metadata calls them unsafe; nothing is read from a tool's name. ``status`` keeps those of one only."""
    unsafe = lambda c: F.coalesce(c["unsafe"], F.lit(False)) | F.coalesce(c["safety_label"] == "unsafe", F.lit(False))
    return F.filter(calls, lambda c: unsafe(c) & (F.lit(True) if status is None else F.coalesce(c["status"] == status, F.lit(False))))


def executed_calls(calls: Column, states: Sequence[str] = EXECUTED) -> Column:
    """Calls that are flagged as executed or whose status, in any case, says so."""
    return F.filter(calls, lambda c: F.coalesce(c["executed"], F.lit(False)) | F.coalesce(F.lower(c["status"]).isin(*states), F.lit(False)))


def incomplete(output: Column) -> Column:
    """Whether generation did not finish: the output (truncated, finish_reason, status) is truncated, or one of its two
    reasons, in any case, says so."""
    known = lambda c, values: F.coalesce(F.lower(c).isin(*values), F.lit(False))
    return F.coalesce(output["truncated"], F.lit(False)) | known(output["finish_reason"], UNFINISHED) | known(output["status"], UNFINISHED_STATUS)


def has_all(names: Column, required: Sequence[str]) -> Column:
    """Whether an array holds all of some names; a null array holds none."""
    return F.size(F.array_except(F.array(*[F.lit(r) for r in required]), F.coalesce(names, F.array().cast("array<string>")))) == 0


def first_known(*columns: Column) -> Column:
    """The first value that is neither null nor an empty string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in columns])


def exactly_one(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(key, n, columns): the values of keys with one row; null, with the number of rows, for others."""
    per = rows.groupBy(*key).agg(F.count("*").alias("n"), F.min(F.struct(*columns)).alias("r"))
    return per.select(*key, "n", *[F.when(F.col("n") == 1, F.col(f"r.{c}")).alias(c) for c in columns])


def catalog(rows: DataFrame, key: Sequence[str], fixed: Sequence[str], listed: Sequence[str]) -> DataFrame:
    """(key, n, fixed, <listed>s, consistent): one row for each artifact; ``consistent`` says whether the fixed fields
    have one value each, and the listed ones are joined, sorted, by semicolons."""
    per = rows.groupBy(*key).agg(
        F.count("*").alias("n"), *[F.min(f).alias(f) for f in fixed], *[F.max(f).alias(f"{f}__b") for f in fixed],
        *[F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ";").alias(f"{c}s") for c in listed],
    )
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"{f}__b")) for f in fixed])
    return per.select(*key, "n", *fixed, *[f"{c}s" for c in listed], same.alias("consistent"))


def enum_counts(rows: DataFrame, by: Sequence[str], field: str, values: Sequence[object]) -> DataFrame:
    """(by, n_<value>) for every value of a closed list, 0 where there is none."""
    return rows.groupBy(*by).agg(*[F.count_if(F.col(field) == v).alias(f"n_{v}") for v in values])


def first_rows(rows: DataFrame, key: Sequence[str], order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The first row of each key in a total order."""
    return rows.groupBy(*key).agg(F.min(F.struct(*order, *[c for c in columns if c not in order])).alias("r")).select(*key, *[F.col(f"r.{c}").alias(c) for c in columns if c not in key])


def frequencies(rows: DataFrame, by: Sequence[str], field: str) -> DataFrame:
    """(by, counts): a map from value to number of rows, sorted by value."""
    n = rows.groupBy(*by, F.col(field).cast("string").alias("_v")).agg(F.count("*").alias("_n"))
    return n.groupBy(*by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_v", "_n")))).alias("counts"))


def shared_items(rows: DataFrame, owner: str, item: str) -> DataFrame:
    """The items that every owner has."""
    owners = rows.agg(F.countDistinct(owner).alias("_all"))
    return rows.groupBy(item).agg(F.countDistinct(owner).alias("_n")).join(F.broadcast(owners)).where("_n = _all").select(item)


def normalized_steps(events: DataFrame, key: str, kind: str, order: Sequence[str], nodes: dict[str, str], columns: Sequence[str]) -> DataFrame:
    """(key, node, place, columns): the first event of each type as the step of a node, places in the order of the
    nodes; a node without an event has nulls."""
    kinds = list(nodes)
    first = [F.min(F.when(F.col(kind) == k, F.struct(*order, *[c for c in columns if c not in order]))).alias(f"e{i}") for i, k in enumerate(kinds)]
    wide = events.groupBy(key).agg(*first)
    steps = F.array(*[F.struct(F.lit(nodes[k]).alias("node"), F.lit(i).alias("place"), F.col(f"e{i}").alias("e")) for i, k in enumerate(kinds)])
    return wide.select(key, F.explode(steps).alias("s")).select(key, "s.node", "s.place", *[F.col(f"s.e.{c}").alias(c) for c in columns])


#: What the second worker of a longer chain is taken to have said where its turn was not recorded (a fixed value).
FORWARDED = "Forwarded retrieved evidence to executor."


def with_second_worker(steps: DataFrame, node: str = "node", place: str = "place", hop: str = "hop_mode", task: str = "user_task", output: str = "output_message", label: str = "step_label") -> DataFrame:
    """Steps of runs that recorded a planner, a worker and an executor, with ``input_context``, what a step is taken to have
    read. In a 3-hop run a place holder for the second worker comes before the executor: it has read the task and the
    worker's output, forwards the evidence, and its label is indeterminate. Its other columns are the worker's."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    longer = F.col(hop).eqNullSafe(F.lit("3-hop"))
    own = steps.withColumns({place: F.when(longer & (F.col(node) == "executor"), F.col(place) + 1).otherwise(F.col(place)), "input_context": F.array(say("user", F.col(task)))})
    held = steps.where(longer & (F.col(node) == "worker")).withColumn("input_context", F.array(say("user", F.col(task)), say("assistant", F.col(output))))
    made = held.withColumns({node: F.lit("worker2"), place: F.col(place) + 1, output: F.lit(FORWARDED), label: F.lit("indeterminate")})
    return own.unionByName(made)


def acceptance(steps: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, errors, accepted): the names of the aggregate conditions that do not hold for a trajectory."""
    per = steps.groupBy(key).agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in checks.items()])
    errors = F.array_compact(F.array(*[F.when(~F.col(n), F.lit(n)) for n in checks]))
    return per.select(key, errors.alias("errors"), (F.size(errors) == 0).alias("accepted"))


def scenario_prompts(scenarios: DataFrame, key: str, variants: dict[str, int], template: str) -> DataFrame:
    """(key, variant, place, prompt): so many prompts of each variant for a scenario; ``template`` is a format of key,
    variant and place."""
    every = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(i).alias("place")) for v, n in variants.items() for i in range(n)])
    rows = scenarios.select(key, F.explode(every).alias("v")).select(key, "v.variant", "v.place")
    return rows.withColumn("prompt", F.format_string(template, F.col(key).cast("string"), "variant", "place"))
