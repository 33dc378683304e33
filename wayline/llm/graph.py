"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.shared import discard, materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b): the smallest node that it is connected with.

    In each round every node hooks to its smallest neighbour, chains of hooks are halved until they reach their roots,
    and the edges between different roots are carried to the next round. At least half of the nodes that still have an
    edge disappear in a round, and each round's tables are written to shared storage. Neighbours are only ever reduced
    to their minimum, so a node with very many edges needs no large task.
    """
    rest = materialize(_between(edges.select("a", "b")), "edges")
    labels: DataFrame | None = None
    while labels is None or rest.take(1):
        ends = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = ends.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), F.least("a", "root").alias("root"))
        hooks = _to_roots(materialize(hooks, "hooks"))
        if labels is None:
            labels = hooks
        else:
            step = hooks.select(F.col("node").alias("component"), F.col("root").alias("next"))
            old = labels
            labels = materialize(
                labels.withColumnRenamed("root", "component").join(step, "component", "left").select("node", F.coalesce("next", "component").alias("root")),
                "labels",
            )
            discard(old)
        left, right = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        carried = materialize(_between(rest.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))), "edges")
        discard(rest)
        rest = carried
    return labels.select("node", F.col("root").alias("component"))


def _between(edges: DataFrame) -> DataFrame:
    """Each edge between two different nodes once, the larger node first."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _to_roots(hooks: DataFrame) -> DataFrame:
    while True:
        up = hooks.where("root < node").select(F.col("node").alias("root"), F.col("root").alias("next"))
        if not hooks.where("root < node").select("root").join(up, "root", "left_semi").take(1):
            return hooks
        jumped = materialize(hooks.join(up, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "hooks")
        discard(hooks)
        hooks = jumped
