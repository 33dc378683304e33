"""The driver tables as the frames that the operators work on: predictions, steps, ledger rows, vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files to a task, where each row is made into many wider ones.
PART = 1 << 20


def dealt(rows: DataFrame, key: str, part: int = PART) -> DataFrame:
    """The rows of a table dealt by key to a task for every ``part`` bytes of its files, and at least one for each core: a
    file is read by few tasks, which would hold all that its rows are made into."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // part)), key)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a score that depends on id and length; stratum ``lang``, held-out group ``source``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    scored = docs.select("doc_id", "lang", "source", (((F.col("doc_id") * 7919 + F.col("n_chars")) % 1000) / F.lit(1000.0)).alias("score"))
    hop = F.when(F.col("doc_id") % 2 == 0, "2-hop").otherwise("3-hop")
    return scored.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "lang", "source", "score", hop.alias("hop"), F.col("quality").alias("label"), "toxic")


P = """p AS (SELECT d.doc_id, d.lang, d.source, (d.doc_id * 7919 + d.n_chars) % 1000 AS k, CAST((d.doc_id * 7919 + d.n_chars) % 1000 AS DOUBLE) / 1000 AS score,
                CASE WHEN d.doc_id % 2 = 0 THEN '2-hop' ELSE '3-hop' END AS hop, l.quality AS label, l.toxic
         FROM documents d JOIN labels l USING (doc_id))"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as trajectory steps."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", "role", "text", (((F.length("text") * 31 + F.col("turn") * 7) % 100) / F.lit(100.0)).alias("score"))


S = "s AS (SELECT conv_id, turn, role, text, CAST((length(text) * 31 + turn * 7) % 100 AS DOUBLE) / 100 AS score FROM conversations)"


def event_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of their user, numbered from 0 in the order of time and id."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1)


E = "e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step FROM events)"


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as costs of an app (the order's priority) by resource (the return flag)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("app"), F.col("o_orderdate").alias("at"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("resource"), F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"))
    return items.join(o, "l_orderkey")


L = """l AS (SELECT l_orderkey, l_returnflag AS resource, CAST(l_extendedprice AS DECIMAL(18,2)) AS cost, o_orderpriority AS app, o_orderdate AS billed
               FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with a binary label, a group of nine and the pair of the label's rank within its group."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("label"), (F.col("vec_id") % 9).alias("grp"))
    return v.withColumn("pair_id", F.row_number().over(Window.partitionBy("grp", "label").orderBy("vec_id")))
