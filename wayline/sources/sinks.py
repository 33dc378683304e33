"""Sinks whose output does not depend on how rows were partitioned. Appends and changes by key are in ``versions``."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stable_json(rows: DataFrame, path: str, order: Sequence[str]) -> None:
    """JSON lines with sorted keys, nulls written out, ordered over all files; NaN and infinities are an error."""
    checked = rows
    for c, kind in rows.dtypes:
        if kind in ("double", "float"):
            checked = checked.withColumn(c, F.when(F.col(c).isNull() | (F.abs(F.col(c)) < F.lit(float("inf"))), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not finite")).cast(kind)))
    checked.orderBy(*order).select(*sorted(rows.columns)).write.option("ignoreNullFields", "false").mode("overwrite").json(path)


def stable_csv(rows: DataFrame, path: str, order: Sequence[str], columns: Sequence[str] | None = None, by: Sequence[str] = ()) -> None:
    """CSV with a header and a fixed order of columns, ``by`` as folders; an empty table is refused."""
    if not rows.take(1):
        raise ValueError("no rows to write")
    out = rows.orderBy(*by, *order).select(*(columns or rows.columns))
    (out.write.partitionBy(*by) if by else out.write).option("header", "true").mode("overwrite").csv(path)


def sparse_union(*parts: DataFrame) -> DataFrame:
    """Rows of several shapes: all columns, sorted, null where a part lacks one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def replaced(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """``write`` gets a path beside ``path`` to write to; only when it is done is the old table moved away and the new one
    put in its place. A failure before that leaves the old table as it was."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = lambda p: hadoop.Path(p)
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex[:12]
    new, old = f"{path.rstrip('/')}.new-{mark}", f"{path.rstrip('/')}.old-{mark}"
    write(new)
    if fs.exists(at(path)) and not fs.rename(at(path), at(old)):
        raise OSError(f"{path} cannot be moved")
    if not fs.rename(at(new), at(path)):
        fs.rename(at(old), at(path))
        raise OSError(f"{new} cannot be moved")
    fs.delete(at(old), True)


def tiered_json(rows: DataFrame, path: str, by: Sequence[str] = ("analysis_tier", "thinking_mode")) -> None:
    """JSON lines in a folder for each tier and mode."""
    rows.write.partitionBy(*by).option("ignoreNullFields", "false").mode("append").json(path)


def unresolved(manifest: DataFrame, root: str, path: str = "path") -> DataFrame:
    """The rows of a manifest whose path, relative to ``root``, is no file there, or leads out of it. Only names are read."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.col("path").alias("_file"))
    base = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/") + "/"
    there = files.select(F.substr(F.col("_file"), F.position(F.lit(base), F.col("_file")) + len(base)).alias(path)).distinct()
    out = F.array_contains(F.split(path, "/"), "..") | F.startswith(path, F.lit("/"))
    inside = manifest.where(~out).join(there, path, "left_anti")
    return inside.unionByName(manifest.where(out))


def markdown(rows: DataFrame, columns: Sequence[str], order: Sequence[str], most: int = 1000) -> str:
    """A report's table in Markdown. Reports are small: more than ``most`` rows are an error, not cut."""
    found = rows.orderBy(*order).select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    shown = lambda v: "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join([*lines, *("| " + " | ".join(shown(v) for v in r) + " |" for r in found)]) + "\n"
