"""Scans with declared schemas: nothing is inferred, and what doesn't fit stops the read or is marked."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wayline.session import ship


def json_lines(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, strict: bool = True, pattern: str | None = None) -> DataFrame:
    """A JSON object a line; blank lines are skipped. ``strict`` fails on the first line that doesn't fit, else such
    lines are dropped. ``pattern`` selects files of a folder by name. Adds ``source_file``."""
    read = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    if pattern:
        read = read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return read.json(paths if isinstance(paths, str) else list(paths)).withColumn("source_file", F.col("_metadata.file_path"))


def json_folder(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.jsonl", strict: bool = True) -> DataFrame:
    """As :func:`json_lines`, of all files of a folder that match; a folder without any is an error. Files are read side by
    side; ``source_file`` orders their rows."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path")
    if not found.take(1):
        raise FileNotFoundError(f"no {pattern} below {folder}")
    return json_lines(spark, folder, schema, strict, pattern)


def json_documents(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str, strict: bool = True, pattern: str | None = None) -> DataFrame:
    """One JSON object a file; without ``strict`` files that cannot be read, or are no object, are passed over."""
    read = spark.read.schema(schema).option("multiLine", "true").option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    if not strict:
        read = read.option("ignoreCorruptFiles", "true")
    if pattern:
        read = read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return read.json(paths).withColumn("source_file", F.col("_metadata.file_path"))


def csv_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A CSV file whose header must be the schema's columns, in order."""
    return spark.read.schema(schema).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)


def texts(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(source_file, text) of whole text files of a folder and those below it."""
    read = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return read.text(path).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("text"))


def harvest(files: DataFrame, pattern: str, name: str = "found") -> DataFrame:
    """(found, files): what a pattern finds in texts and in which files."""
    hits = files.select("source_file", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))).alias(name))
    return hits.groupBy(name).agg(F.array_sort(F.collect_set("source_file")).alias("files"))


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(source_file, bytes, sha256) of files as they are."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("path").alias("source_file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


TENSORS = "source_file string, checkpoint string, layer int, vector array<float>, finite boolean, sha256 string, problem string"


def _tensor_rows(checkpoint: str | None, hidden: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in TENSORS.split(", ")]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32()), pa.bool_(), pa.string(), pa.string()]
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                digest, rows = hashlib.sha256(raw).hexdigest(), []
                try:
                    with np.load(io.BytesIO(raw), allow_pickle=False) as arrays:
                        layers = arrays["layers"].astype(int).tolist()
                        wanted = checkpoint or (str(arrays["primary"]) if "primary" in arrays.files else "primary")
                        block = arrays[wanted].astype(np.float32)
                    if block.ndim != 2 or len(block) != len(layers) or hidden not in (None, block.shape[-1]):
                        rows = [(file, wanted, None, None, None, digest, f"shape {'x'.join(map(str, block.shape))}")]
                    else:
                        rows = [(file, wanted, layer, v.tolist(), bool(np.isfinite(v).all()), digest, None) for layer, v in zip(layers, block, strict=True)]
                except (ValueError, KeyError, OSError, zipfile.BadZipFile) as error:
                    rows = [(file, checkpoint, None, None, None, digest, f"{type(error).__name__}: {error}"[:200])]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def tensor_artifacts(spark: SparkSession, path: str, checkpoint: str | None = None, hidden: int | None = None, pattern: str = "*.npz") -> DataFrame:
    """A row for each layer of one checkpoint of every artifact below a folder: an archive of arrays with ``layers``, the
    numbers of the layers, and for each checkpoint a block [layers, hidden]; without a name the one that ``primary`` names.
    ``sha256`` is the file's digest and ``finite`` says whether the vector has numbers only. A file that cannot be read, or
    whose block has another shape, gives one row with its ``problem``."""
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "content").mapInArrow(_tensor_rows(checkpoint, hidden), TENSORS)


def checked_artifacts(index: DataFrame, artifacts: DataFrame, path: str = "storage_path", checksum: str = "checksum_sha256") -> DataFrame:
    """(path, problem) of an index's artifacts that are missing, unreadable, changed or not finite."""
    own = artifacts.groupBy(F.col("source_file").alias(path)).agg(F.min("sha256").alias("_sha"), F.min("problem").alias("_problem"), F.bool_and(F.coalesce("finite", F.lit(True))).alias("_finite"))
    both = index.select(path, checksum).distinct().join(own, path, "left")
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("_problem").isNotNull(), F.col("_problem")).when(F.col("_sha") != F.col(checksum), "checksum").when(~F.col("_finite"), "not finite")
    return both.select(path, problem.alias("problem")).where("problem IS NOT NULL")


def of_tier(rows: DataFrame, tier: str, tiers: Sequence[str] = ("exploratory", "definitive")) -> DataFrame:
    """Rows whose ``source_file`` lies in a folder of the tier; ``unclassified`` are those in none of the tiers'."""
    own = F.coalesce(*[F.when(F.contains("source_file", F.lit(f"/{t}/")), F.lit(t)) for t in tiers], F.lit("unclassified"))
    return rows.where(own == tier)


def tier_paths(root: str, tiers: Sequence[str], modes: Sequence[str] = ("*",)) -> list[str]:
    """The folders of some tiers and modes below a root, so that a scan lists no other files."""
    return [f"{root.rstrip('/')}/{t}/{m}" for t in tiers for m in modes]


def versioned_index(rows: DataFrame, current: str, legacy: Sequence[str] = (), version: str = "schema_version", tier: str = "analysis_tier") -> DataFrame:
    """An index of one schema version: rows of a legacy version get the tier ``unclassified``; an unknown version or a
    mixture is an error when the rows are read."""
    w = rows.agg(F.countDistinct(version).alias("_versions"))
    ok = F.col(version).isin(current, *legacy) & (F.col("_versions") == 1)
    checked = rows.join(F.broadcast(w)).where(F.assert_true(ok, F.lit("unknown or mixed schema versions")).isNull()).drop("_versions")
    return checked.withColumn(tier, F.when(F.col(version) == current, F.coalesce(tier, F.lit("unclassified"))).otherwise("unclassified"))


def agent_turns(documents: DataFrame, events: str = "full_events", checkpoints: str = "checkpoints") -> DataFrame:
    """Nested run documents flattened to a row for each agent turn and checkpoint."""
    turns = documents.withColumn("event", F.explode(F.filter(events, lambda e: e["type"] == "agent_turn"))).drop(events)
    return turns.select(*[c for c in turns.columns if c != "event"], "event.*").withColumn("checkpoint", F.explode(checkpoints)).drop(checkpoints)
