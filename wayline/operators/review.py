"""Blind review: order of the samples, blank forms, agreement of two reviewers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators import contracts
from wayline.operators.pairs import coverage


def blind_order(rows: DataFrame, pair: Sequence[str], key: str, name: str = "sample") -> DataFrame:
    """Letters A, B, ... within each pair, by a digest of pair and key, which tells nothing of the treatment."""
    digest = F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in pair], F.col(key).cast("string")), 256)
    w = Window.partitionBy(*pair).orderBy(digest, key)
    return rows.withColumn(name, F.char(F.row_number().over(w) + 64))


def blank_forms(pairs: DataFrame, fields: Sequence[str], reviewers: int = 2) -> DataFrame:
    """A row for each pair and reviewer, with empty fields."""
    slots = pairs.withColumn("reviewer_slot", F.explode(F.sequence(F.lit(1), F.lit(reviewers))))
    return slots.select("*", *[F.lit(None).cast("string").alias(f) for f in fields])


def disagreements(reviews: DataFrame, key: Sequence[str], slot: str, fields: Sequence[str]) -> DataFrame:
    """(key, differing, n_slots): the fields in which the two reviewers of a pair differ, null equal to null."""
    per = reviews.groupBy(*key).agg(
        F.countDistinct(slot).alias("n_slots"), *[F.max(F.when(F.col(slot) == s, F.col(f))).alias(f"{f}_{s}") for f in fields for s in (1, 2)]
    )
    differing = F.array_compact(F.array(*[F.when(~F.col(f"{f}_1").eqNullSafe(F.col(f"{f}_2")), F.lit(f)) for f in fields]))
    return per.select(*key, differing.alias("differing"), "n_slots")


def form_violations(forms: DataFrame, expected: DataFrame, key: Sequence[str], slot: str, reviewer: str, allowed: dict[str, Sequence[str]], reviewers: int = 2) -> DataFrame:
    """What is wrong with filled review forms: pairs that are missing or not expected, values outside the lists, rows
    that are there twice, forms without a reviewer, and pairs whose forms name one reviewer only."""
    cells = coverage(expected.withColumn(slot, F.explode(F.sequence(F.lit(1), F.lit(reviewers)))), forms, [*key, slot])
    named = forms.groupBy(*key).agg(F.countDistinct(reviewer).alias("n"))
    return contracts.violations(
        contracts.holds(cells, [*key, slot], "coverage", F.col("status") == "present", F.col("status")), contracts.required(forms, [*key, slot], [reviewer, *allowed]),
        *[contracts.allowed(forms.where(F.col(f).isNotNull()), [*key, slot], f, values) for f, values in allowed.items()],
        contracts.holds(named, key, "distinct_reviewers", F.col("n") == reviewers, F.col("n")),
    )


def joined_forms(blinded: DataFrame, unblinded: DataFrame, protocol: DataFrame, pair: Sequence[str], slot: str) -> DataFrame:
    """(pair, slot, the fields of all three, status) of the forms that reviewers filled in before and after unblinding and of
    the pairs' protocol: ``complete``, or what a cell lacks (``blinded``, ``unblinded``, ``protocol``), or ``repeated`` where a
    form or a pair's protocol is there more than once. Fields keep their names, with ``_unblinded`` after those that both
    forms have."""
    key = [*pair, slot]
    shared = {c for c in unblinded.columns if c in blinded.columns and c not in key}
    after = unblinded.withColumnsRenamed({c: f"{c}_unblinded" for c in shared})

    def one(frame: DataFrame, by: Sequence[str], mark: str) -> DataFrame:
        rest = [c for c in frame.columns if c not in by]
        return frame.groupBy(*by).agg(F.count("*").alias(mark), *[F.first(c).alias(c) for c in rest])

    both = one(blinded, key, "_b").join(one(after, key, "_u"), key, "full_outer")
    told = both.join(one(protocol.drop(slot), pair, "_p"), list(pair), "left")
    status = (
        F.when((F.col("_b") > 1) | (F.col("_u") > 1) | (F.col("_p") > 1), "repeated").when(F.col("_b").isNull(), "blinded").when(F.col("_u").isNull(), "unblinded")
        .when(F.col("_p").isNull(), "protocol").otherwise("complete")
    )
    return told.withColumn("status", status).drop("_b", "_u", "_p")
