"""Tables that several writers change: every change is a version, committed as a whole or not at all.

A table is a folder of Parquet parts and, in ``_versions``, a small file for each version that names the parts which make it
up. A write adds parts first, which nobody reads yet, and then commits by creating the next version's file, which only one
writer can; one that comes second looks at what the other has done and tries again. Readers see one version, however long
they read. A part is what one write wrote; a change rewrites the parts that hold its keys and no others.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Attempts of a commit before it gives up.
ATTEMPTS = 20


def _hadoop(spark: SparkSession, path: str) -> tuple[object, Callable[[str], object]]:
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = lambda p: jvm.Path(p)
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def versions(spark: SparkSession, path: str) -> list[int]:
    system, at = _hadoop(spark, path)
    folder = at(f"{path}/_versions")
    if not system.exists(folder):
        return []
    names = [s.getPath().getName() for s in system.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n.removesuffix(".json").isdigit())


def parts(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, list[str], StructType | None]:
    """The number of a version (the last one if none is given, 0 before the first), its parts and its schema."""
    known = versions(spark, path)
    version = (known[-1] if known else 0) if version is None else version
    if not version:
        return 0, [], None
    told = json.loads("".join(r.value for r in spark.read.option("wholetext", "true").text(f"{path}/_versions/{version}.json").collect()))
    return version, told["parts"], StructType.fromJson(told["schema"])


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The rows of a version; None if there is none yet."""
    number, held, schema = parts(spark, path, version)
    if not number:
        return None
    if not held:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{p}" for p in held])


def _commit(spark: SparkSession, path: str, version: int, held: Sequence[str], schema: StructType) -> bool:
    """Creates the file of a version; False if another writer was first."""
    system, at = _hadoop(spark, path)
    system.mkdirs(at(f"{path}/_versions"))
    mark, target = f"{path}/_versions/.{uuid.uuid4().hex}", f"{path}/_versions/{version}.json"
    out = system.create(at(mark), False)
    out.write(bytearray(json.dumps({"parts": list(held), "schema": schema.jsonValue()}).encode()))
    out.close()
    try:
        if system.getScheme() == "file":  # a rename would replace the other writer's file, a link does not
            plain = lambda p: at(p).toUri().getPath()
            try:
                os.link(plain(mark), plain(target))
            except FileExistsError:
                return False
            return True
        return bool(system.rename(at(mark), at(target)))  # such stores don't rename onto a file
    finally:
        system.delete(at(mark), False)


def _changed(spark: SparkSession, path: str, make: Callable[[int, list[str]], tuple[list[str], StructType] | None], attempts: int) -> int:
    """Commits what ``make`` makes of the last version's parts, over again while other writers come first."""
    for attempt in range(attempts):
        version, held, _ = parts(spark, path)
        made = make(version, held)
        if made is None:
            return version
        if _commit(spark, path, version + 1, *made):
            return version + 1
        time.sleep(0.05 * attempt)
    raise OSError(f"other writers were first {attempts} times: {path}")


def _written(rows: DataFrame, path: str) -> str:
    part = f"part-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{part}")
    return part


def append(rows: DataFrame, path: str, key: Sequence[str] = (), attempts: int = ATTEMPTS) -> int:
    """Adds rows whose key is not there yet, one of each key; all rows without a key. Returns the version that has them,
    which is the last one if nothing was to be added. Doing it again adds nothing."""
    spark = rows.sparkSession
    own = rows.dropDuplicates(list(key)) if key else rows
    schema = rows.schema

    def make(version: int, held: list[str]) -> tuple[list[str], StructType] | None:
        old = read_version(spark, path, version) if version else None
        fresh = own if old is None or not key else own.join(old.select(*key), list(key), "left_anti").select(rows.columns)
        part = _written(fresh, path)
        if version and spark.read.schema(schema).parquet(f"{path}/{part}").isEmpty():
            return None
        return [*held, part], schema

    return _changed(spark, path, make, attempts)


def conflicts(old: DataFrame, changes: DataFrame, key: Sequence[str], expect: Mapping[str, str]) -> DataFrame:
    """(key, problem) of changes that cannot be made: ``missing`` keys, keys that are ``repeated`` among changes or rows, and
    ``changed`` rows, whose columns no longer are what ``expect`` says they were (column of the row: column of the change)."""
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}")) for k in key]
    n = changes.groupBy(*key).agg(F.count("*").alias("_n"), *[F.min(F.struct(F.col(c).alias("v"))).alias(f"_e_{c}") for c in dict.fromkeys(expect.values())])
    o = old.groupBy(*key).agg(F.count("*").alias("_o"), *[F.min(F.struct(F.col(c).alias("v"))).alias(f"_w_{c}") for c in expect])
    both = n.alias("n").join(o.alias("o"), [*same] if len(same) > 1 else same[0], "left")
    differs = F.lit(False)
    for row, change in expect.items():
        differs = differs | ~F.col(f"o._w_{row}.v").eqNullSafe(F.col(f"n._e_{change}.v"))
    problem = F.when(F.col("_o").isNull(), "missing").when((F.col("_o") > 1) | (F.col("_n") > 1), "repeated").when(differs, "changed")
    return both.select(*[F.col(f"n.{k}").alias(k) for k in key], problem.alias("problem")).where("problem IS NOT NULL")


def upsert(
    changes: DataFrame, path: str, key: Sequence[str], update: Callable[[Callable[[str], Column], Callable[[str], Column]], Mapping[str, Column]], expect: Mapping[str, str] | None = None, insert: bool = False, attempts: int = ATTEMPTS
) -> DataFrame:
    """Changes rows by key and returns the conflicts, (key, problem) as of :func:`conflicts`, whose rows stay as they were.

    ``update`` gets two functions, for the columns of a row and of its change, and says what columns become; nested fields
    are changed by ``withField``. With ``insert`` a missing key is no conflict: its change is added as a row. Parts without
    any of the keys stay as they are. Another writer's version in between is taken into account, its rows too.
    """
    spark = changes.sparkSession
    changes = changes.persist()  # every attempt and both sides see the same changes
    refused: list[DataFrame] = []

    def make(version: int, held: list[str]) -> tuple[list[str], StructType] | None:
        refused.clear()
        old = read_version(spark, path, version)
        if old is None:
            raise ValueError(f"no table at {path}")
        schema = parts(spark, path, version)[2]
        odd = conflicts(old, changes, key, expect or {})
        if insert:
            odd = odd.where("problem <> 'missing'")
        report = f"{path}/_conflicts/{uuid.uuid4().hex}"
        odd.write.parquet(report)
        refused.append(spark.read.schema(odd.schema).parquet(report))
        null_safe = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in key]
        join = lambda left, right, how: left.alias("a").join(right.alias("b"), null_safe("a", "b"), how)
        good = join(changes, refused[0], "left_anti").select("a.*")
        placed = old.select(*key, F.col("_metadata.file_path").alias("_file"))
        touched = {r[0] for r in join(placed, good, "left_semi").select(F.regexp_extract("_file", r"/(part-[0-9a-f]{32})/[^/]*$", 1)).distinct().collect()}  # parts, one for each write
        rest = [p for p in held if p not in touched]
        new = []
        if touched:
            rows = spark.read.schema(schema).parquet(*[f"{path}/{p}" for p in held if p in touched])
            marked = good.select(F.struct("*").alias("_change"), *[F.col(k).alias(f"_k_{i}") for i, k in enumerate(key)])
            met = rows.join(marked, [F.col(k).eqNullSafe(F.col(f"_k_{i}")) for i, k in enumerate(key)], "left")
            told = update(F.col, lambda c: F.col("_change")[c])
            there = F.col("_change").isNotNull()
            new.append(_written(met.select(*[F.when(there, told[c]).otherwise(F.col(c)).cast(f.dataType).alias(c) if (c := f.name) in told else F.col(f.name) for f in rows.schema.fields]), path))
        if insert:
            more = join(good.dropDuplicates(list(key)), old.select(*key), "left_anti").select(*[f"a.{c}" for c in old.columns])
            if not more.isEmpty():
                new.append(_written(more, path))
        return ([*rest, *new], schema) if new else None

    try:
        _changed(spark, path, make, attempts)
    finally:
        changes.unpersist()
    return refused[0]


#: Fields of an event's activation metadata that a repair replaces, and where they come from in the repaired metadata (fixed values).
REPAIRED = {
    "requested_layers": "layers", "layers_extracted": "layers", "token_position_convention": "token_position", "sequence_length": "sequence_length", "storage_path": "storage_path", "storage_status": "storage_status",
    "artifact_format_version": "artifact_format_version", "primary_checkpoint": "primary_checkpoint", "checkpoint_positions": "checkpoint_positions", "checkpoint_forward_scopes": "checkpoint_forward_scopes", "checkpoint_shapes": "checkpoint_shapes",
}


def repaired_metadata(old: Column, new: Column, fields: Sequence[str]) -> Column:
    """An event's activation metadata with what a repair has made anew; of ``REPAIRED`` the fields that both sides have,
    named in ``fields``. Other fields, and an event without metadata, stay as they are."""
    out = old
    for name in fields:
        out = out.withField(name, new[REPAIRED[name]])
    return F.when(old.isNotNull(), out)
