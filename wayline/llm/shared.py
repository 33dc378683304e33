"""Tables that outlive a task: written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.session import ship

_roots: dict[str, str] = {}
#: Whether a query's shuffle files go when it ends, instead of when the driver happens to collect its garbage.
_SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a temporary folder of this machine is used; a session that is
    not local must name a shared folder.
    """
    app = spark.sparkContext.applicationId
    if app not in _roots:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="wayline-")
        _roots[app] = f"{base.rstrip('/')}/wayline-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _roots[app])
    return _roots[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written once as Parquet to shared storage and read back: lineage ends here, and the
    table is still there when an executor is lost. What was shuffled to make it is deleted."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(_SWEEP, None)
    spark.conf.set(_SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_SWEEP, before) if before is not None else spark.conf.unset(_SWEEP)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes a table that :func:`materialize` wrote and nothing reads any more."""
    for file in df.inputFiles()[:1]:
        _delete(df.sparkSession, file.rpartition("/")[0])


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session is gone already: nothing left to delete with
        return


#: Bytes a core below which a table is dealt out anew.
SMALL = 8 << 20


def spread(rows: DataFrame) -> DataFrame:
    """The rows of a table that is small for the cluster, dealt to all of its cores: a small file is one task, however much
    work its rows are. Larger tables are read by many tasks as they are, and are not shuffled."""
    spark = rows.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < SMALL * cores else rows


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def prepare(spark: SparkSession) -> None:
    """For operators with Python code: sends the package to the executors, and has Arrow batches bounded by bytes, not
    only by rows, so that a batch of very long texts stays small."""
    ship(spark)
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in _user_set(spark):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


#: Keys that may be heavy at most: each of them has more than this part of all rows.
HEAVY = 1000


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, heavy: DataFrame, salts: int) -> DataFrame:
    """A join whose heavy keys are dealt to ``salts`` tasks: rows of ``left`` by a hash of all their columns, and those
    of ``right``, few for a key, to each of them. ``heavy`` has the keys ``on`` that hold more than one in ``HEAVY`` of
    the rows of ``left``; there are no more than ``HEAVY`` of them, so that they may be broadcast."""
    mark = F.broadcast(heavy.select(*on, F.lit(True).alias("_heavy")))
    own = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*left.columns), F.lit(salts))).otherwise(0).cast("int")
    every = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    dealt = left.join(mark, on, "left").withColumn("_salt", own).drop("_heavy")
    copied = right.join(mark, on, "left").withColumn("_salt", F.explode(every)).drop("_heavy")
    return dealt.hint("merge").join(copied, [*on, "_salt"], how).drop("_salt")


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def released(run: Run) -> Run:
    """``run``, and after it what the task no longer needs goes back to the system: a Python worker lives on for tasks of
    other kinds, and what its allocators hold back would be added to their memory."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def _user_set(spark: SparkSession) -> set[str]:
    return {k for k, _ in spark.sparkContext.getConf().getAll()}
