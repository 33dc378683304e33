"""What a review packet is made of: covariates of each domain's runs, prefix sums over their order, and rows whose locked
fields are sealed by digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.hashing import canonical_json, canonical_row
from wayline.functions.text import occurrences

#: Rows of one order number's block in :func:`prefix_sums`: an order is cut into blocks of so many numbers.
WIDTH = 4096


def prefix_sums(rows: DataFrame, by: Sequence[str], order: str, values: Sequence[str], width: int = WIDTH) -> DataFrame:
    """``rows`` with ``place``, from 0, and ``<value>_before``, the sums over the rows of the stratum that come before in
    order of an integer column. Rows are ordered within blocks of neighbouring numbers, and the blocks by their sums, so
    that a stratum of any size is spread over tasks; several rows of one number are ordered by their values. Nulls add
    nothing; a row without an order has no place and no sums and counts for nobody."""
    block = F.floor(F.col(order) / width)
    keyed = rows.withColumn("_block", block)
    sums = {"place": F.count("*"), **{f"{v}_before": F.sum(v) for v in values}}
    totals = keyed.where("_block IS NOT NULL").groupBy(*by, "_block").agg(*[F.coalesce(c, F.lit(0)).alias(n) for n, c in sums.items()])
    earlier = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(b).alias(f"_r{i}") for i, b in enumerate(by)], F.col("_block").alias("_rb"), *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_s_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_block").orderBy(order, *values).rowsBetween(Window.unboundedPreceding, -1)
    told = keyed.withColumns({"_i_place": F.count("*").over(inside), **{f"_i_{v}_before": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values}})
    test = F.col("_block") == F.col("_rb")
    for i, b in enumerate(by):
        test = test & F.col(b).eqNullSafe(F.col(f"_r{i}"))
    return told.join(starts, test, "left").select(*rows.columns, *[(F.col(f"_s_{n}") + F.col(f"_i_{n}")).alias(n) for n in sums])


def injected_position(prompt: Column, injected: Column) -> Column:
    """(start_char, end_char, prompt_chars, normalized) of a text that stands in a prompt exactly once, else null;
    ``normalized`` is its middle as a share of the prompt."""
    at = F.position(injected, prompt) - 1
    end = at + F.length(injected)
    told = F.struct(at.alias("start_char"), end.alias("end_char"), F.length(prompt).alias("prompt_chars"), ((at + end) / 2 / F.length(prompt)).alias("normalized"))
    return F.when((F.length(injected) > 0) & (occurrences(prompt, injected) == 1), told)


def covariates(runs: DataFrame, domain: str, order: Sequence[str], fields: Sequence[str], expected: int | None = None) -> DataFrame:
    """(domain, n_runs, runs, complete): a domain's runs, few by design, in order, with some of their fields. ``complete``
    says that there are as many as ``expected`` and that no two share their order."""
    each = F.array_sort(F.collect_list(F.struct(*order, *fields)))
    per = runs.groupBy(domain).agg(F.count("*").alias("n_runs"), F.countDistinct(F.struct(*order)).alias("_cells"), each.alias("runs"))
    whole = F.col("_cells") == F.col("n_runs")
    return per.select(domain, "n_runs", "runs", (whole & (F.col("n_runs") == expected) if expected is not None else whole).alias("complete"))


def packet(pairs: DataFrame, metadata: Sequence[str], locked: Sequence[str], manual: Sequence[str], reviewers: int = 2) -> DataFrame:
    """A row for each pair and reviewer: the pair's metadata, the slot, the locked fields, empty fields to be filled in by hand,
    and ``locked_sha256``, the digest of everything but these as canonical JSON."""
    rows = pairs.withColumn("reviewer_slot", F.explode(F.sequence(F.lit(1), F.lit(reviewers)))).select(*metadata, "reviewer_slot", *locked)
    sealed = rows.withColumn("locked_sha256", F.sha2(canonical_row(rows, rows.columns), 256))
    return sealed.select("*", *[F.lit(None).cast("string").alias(f) for f in manual])


def broken_seals(returned: DataFrame, metadata: Sequence[str], locked: Sequence[str]) -> DataFrame:
    """The rows of a returned packet whose locked fields are not what their digest says."""
    names = [*metadata, "reviewer_slot", *locked]
    kinds = returned.select(*names)
    return returned.where(~F.sha2(canonical_row(kinds, names), 256).eqNullSafe(F.col("locked_sha256")))


def packet_digest(rows: DataFrame, order: Sequence[str], columns: Sequence[str], by: Sequence[str] = ("reviewer_slot",)) -> DataFrame:
    """(by, n, rows_sha256): the digest of one reviewer's rows as a canonical JSON list in order. A packet has some hundred
    rows to a reviewer."""
    kinds = rows.select(*columns)
    line = canonical_json(F.struct(*[F.col(c) for c in columns]), kinds.schema)
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))), lambda r: r["_line"])
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]")), 256).alias("rows_sha256"))
