"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
A stage works on everything that the one before it kept, and what it decides takes effect in the rows that it returns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.exact_dedup import exact_dedup
from wayline.llm.near_dedup import near_dedup
from wayline.llm.packing import pack
from wayline.llm.shared import materialize, spread
from wayline.llm.substring_dedup import substring_dedup
from wayline.llm.toxicity import toxicity


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """The rows whose id is not in ``dropped``; a row without an id stays."""
    return docs.join(dropped.select("doc_id").where("doc_id IS NOT NULL").hint("merge"), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity(docs, labels, carry=True).where("predicted = 0").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that differ in white space only, the rows of the document with the smallest id stay. Rows are judged, not
    ids: another text of an id that has a copy elsewhere stays."""
    return exact_dedup(docs, carry=True).where("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 80 % of equal five-word shingles connect, the one with the smallest id stays."""
    return _without(docs, near_dedup(docs).where("NOT kept"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document with a smaller id has too are cut out; a text that loses all its
    words stays as an empty one."""
    cut = substring_dedup(docs, carry=True).withColumn("cut", F.col("n_removed") > 0)
    text = F.when(F.col("cut"), F.col("kept_text")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("cut"), F.length("kept_text").cast("long")).otherwise(F.col("row.n_chars"))}
    return cut.select(*[new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns])


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack_documents),
]

#: Not all stages can be stated in SQL; the tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
