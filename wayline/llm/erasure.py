"""Cascading erasure: rows to be forgotten, and all rows that hang on them, leave the Parquet files that hold them.

Spark's hidden file metadata (path, row index) says where a row lies. Victims are found table by table: those of a root
table, then the rows of each further table whose key is a victim's, by joins that read keys and metadata only. Positions
are dealt by file and sorted; a rewrite task walks through its original file and the positions side by side and writes
the survivors to a file beside the table, so that no row of data is shuffled. What a task returns names the file that it
wrote; only named files are published, so that a lost executor leaves nothing behind that counts. Publishing moves a new
file into the table, and then removes the old one; done twice, it does nothing more.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.shared import _delete, discard, materialize, prepare, released, shuffle_partitions

#: Rows that a rewrite reads at once, and bytes of a row group that it writes.
BATCH_ROWS, GROUP_BYTES = 1 << 15, 32 << 20
#: Bits of a row's place that count rows within a partition.
_PLACE = 33


@dataclass(frozen=True)
class Link:
    """Rows of ``table`` are victims when their ``on`` is the ``parent_on`` of a victim of ``parent``."""

    table: str
    on: str
    parent: str
    parent_on: str


def _free(name: str, columns: Sequence[str]) -> str:
    """A name like this one that no column has; Spark's names ignore case."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def write_sorted(rows: DataFrame, key: Column, columns: Sequence[str], path: str, files: int = 250) -> int:
    """Writes ``columns`` of the rows below ``path``, sorted by ``key`` and then all columns, ascending and nulls first, as
    files ``part-NNNNN…`` of 1 + floor(n / files) consecutive rows, numbered from 0. Returns n; without rows there is no
    file. Equal rows may stand in any order, which shows nowhere.

    Rows are dealt by ranges of all that they are sorted by, so that a key with a third of the rows takes many tasks; the
    numbers of a partition's rows, and not the rows, are added up to give every row its place.
    """
    spark = rows.sparkSession
    k, place = _free("_key", columns), _free("_place", columns)
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (k, *columns)]
    keyed = rows.select(key.alias(k), *[F.col(f"`{c}`") for c in columns])
    dealt = keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    stored = materialize(dealt.drop(k).withColumn(place, F.monotonically_increasing_id()), "sorted")
    part = F.shiftright(F.col(place), _PLACE)
    counts = stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # one for each partition
    n = sum(r.n for r in counts)
    if n:
        before = list(itertools.accumulate((r.n for r in counts), initial=0))
        starts = spark.createDataFrame([(r.part, at) for r, at in zip(counts, before, strict=False)], "_part long, _start long")
        size = 1 + n // files
        row = F.col("_start") + F.col(place).bitwiseAND((1 << _PLACE) - 1)
        placed = stored.join(F.broadcast(starts), part == F.col("_part")).withColumn(place, row)
        number = F.floor(F.col(place) / F.lit(size)).cast("int")
        whole = placed.repartitionById(-(-n // size), number).sortWithinPartitions(place)
        whole.select(*[F.col(f"`{c}`") for c in columns]).write.parquet(path)
    discard(stored)
    return n


def file_number(path: Column) -> Column:
    return F.regexp_extract(path, r"/part-(\d+)[^/]*$", 1).cast("long")


def victims(spark: SparkSession, paths: Mapping[str, str], root: str, forgotten: DataFrame, on: str, links: Sequence[Link]) -> DataFrame:
    """Where the victims lie: table_name, file, row, once each. Victims of ``root`` are the rows whose ``on`` is one of
    ``forgotten``'s; links follow in the order given. A null key hangs on nothing."""
    out, found = None, {}
    for table, column, keys in [(root, on, forgotten.select(F.col(f"`{on}`").alias("_on"))), *((x.table, x.on, x) for x in links)]:
        if isinstance(keys, Link):
            keys = found[keys.parent].select(F.col(f"keys.`{keys.parent_on}`").alias("_on")) if keys.parent in found else None
        if table not in paths or keys is None:
            continue
        needed = sorted({x.parent_on for x in links if x.parent == table} | {column})
        rows = spark.read.parquet(paths[table]).select(
            F.col(f"`{column}`").alias("_on"), F.struct(*[F.col(f"`{c}`") for c in needed]).alias("keys"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
        )
        # Written first: a join of two plain exchanges can be split where a key is hot.
        wanted = materialize(keys.where("_on IS NOT NULL").distinct(), f"keys-{table}")
        here = rows.join(wanted, "_on", "left_semi")
        if table in found:  # a table that several links reach
            here = here.select("_on", "keys", "file", "row").join(found[table].select("file", "row"), ["file", "row"], "left_anti").select("_on", "keys", "file", "row")
        here = materialize(here.select("keys", "file", "row"), f"victims-{table}")
        found[table] = found[table].unionByName(here) if table in found else here
        placed = here.select(F.lit(table).alias("table_name"), "file", "row")
        out = placed if out is None else out.unionByName(placed)
    return out if out is not None else spark.createDataFrame([], "table_name string, file string, row long")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray]]:
    """(file, rows) of sorted batches: a file's rows may come in several pieces, one after the other."""
    for batch in batches:
        names = batch.column("file").dictionary_encode()
        index = names.indices.to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(index)) + 1).tolist(), len(index)] if len(index) else [0]
        rows = batch.column("row").to_numpy()
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            yield names.dictionary[index[lo]].as_py(), rows[lo:hi]


class _Survivors:
    """Writes batches as row groups of bounded size; makes the file with the first row."""

    def __init__(self, uri: str, schema: pa.Schema, int96: bool) -> None:
        self._uri, self._schema, self._int96 = uri, schema, int96
        self._held: list[pa.RecordBatch] = []
        self._writer: pq.ParquetWriter | None = None
        self.rows = 0

    def add(self, batch: pa.RecordBatch) -> None:
        self.rows += batch.num_rows
        if batch.num_rows:
            self._held.append(batch)
        if sum(b.nbytes for b in self._held) >= GROUP_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self._writer is None:
            system, where = _opened(self._uri)
            system.create_dir(where.rpartition("/")[0], recursive=True)
            self._sink = system.open_output_stream(where)
            self._writer = pq.ParquetWriter(self._sink, self._schema, compression="snappy", store_schema=False, use_deprecated_int96_timestamps=self._int96)
        self._writer.write_table(pa.Table.from_batches(self._held, self._schema))
        self._held = []

    def close(self) -> bool:
        """Whether there is a file."""
        if self._held:
            self._flush()
        if self._writer is not None:
            self._writer.close()
            self._sink.close()
        return self._writer is not None


def rewritten(uri: str, rows: Iterator[np.ndarray], target: str) -> tuple[int, int]:
    """Copies a Parquet file without the rows of these ascending indices; the numbers of rows that stay and that go. If
    none stays, no file is written."""
    system, where = _opened(uri)
    with system.open_input_file(where) as source, pq.ParquetFile(source) as file:
        kinds = {file.schema.column(i).physical_type for i in range(len(file.schema))}
        out = _Survivors(target, file.schema_arrow, "INT96" in kinds)
        base, gone, ahead = 0, 0, np.empty(0, np.int64)
        for batch in file.iter_batches(batch_size=BATCH_ROWS):
            end = base + batch.num_rows
            while (not len(ahead) or ahead[-1] < end) and (more := next(rows, None)) is not None:
                ahead = np.concatenate([ahead, more])
            here = int(np.searchsorted(ahead, end))
            keep = np.ones(batch.num_rows, bool)
            keep[ahead[:here] - base] = False
            gone += int((~keep).sum())
            out.add(batch.filter(pa.array(keep)))
            base, ahead = end, ahead[here:]
        if len(ahead) or next(rows, None) is not None:
            raise ValueError(f"positions beyond the last row of {uri}")
        out.close()
    return out.rows, gone


_WRITTEN = "table_name string, file string, new_file string, n_rows long, n_erased long"


def rewrite(places: DataFrame, staged: str) -> DataFrame:
    """Writes each file that holds victims anew, without them, below ``staged``: table_name, file, new_file (null when
    nothing is left), n_rows, n_erased. Every attempt of a task writes files of its own; the rows returned name those
    that count."""
    spark = places.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for uri, pieces in itertools.groupby(_runs(batches), key=lambda x: x[0]):
            folder, _, name = uri.rpartition("/")
            table = folder.rpartition("/")[2]
            number = re.match(r"part-\d+", name)
            target = f"{staged}/{table}/{number.group() if number else name.partition('.')[0]}-{uuid.uuid4().hex}.parquet"
            stay, gone = rewritten(uri, (rows for _, rows in pieces), target)
            values = ([table], [uri], [target if stay else None], [stay], [gone])
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if i > 2 else pa.string()) for i, v in enumerate(values)], names=[c.split()[0] for c in _WRITTEN.split(", ")])

    dealt = places.select("file", "row").repartition(shuffle_partitions(spark), "file").sortWithinPartitions("file", "row")
    return materialize(dealt.mapInArrow(released(run), _WRITTEN), "rewritten")


def publish(written: DataFrame) -> DataFrame:
    """Moves new files to where the old ones lie, which go: ``written`` with the new files' places. A reader that lists a
    table meanwhile may see an old file beside its new one, never neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = []
            for uri, new in zip(batch.column("file").to_pylist(), batch.column("new_file").to_pylist(), strict=True):
                system, old = _opened(uri)
                final = None if new is None else f"{uri.rpartition('/')[0]}/{new.rpartition('/')[2]}"
                if final is not None and system.get_file_info(_opened(final)[1]).type == fs.FileType.NotFound:
                    system.move(_opened(new)[1], _opened(final)[1])
                folder, _, name = old.rpartition("/")
                for gone in (old, f"{folder}/.{name}.crc"):
                    if system.get_file_info(gone).type != fs.FileType.NotFound:
                        system.delete_file(gone)
                places.append(final)
            at = batch.schema.get_field_index("new_file")
            yield batch.set_column(at, "new_file", pa.array(places, pa.string()))

    return materialize(written.mapInArrow(run, _WRITTEN), "published")


def erase(spark: SparkSession, paths: Mapping[str, str], root: str, forgotten: DataFrame, on: str, links: Sequence[Link] = ()) -> DataFrame:
    """Erases victims from tables of Parquet files: ``paths`` has the folder of each table, all of one parent folder and
    named like the table. Returns a row for each file that is there in the end: table_name, path, n_rows, n_erased,
    rewritten.

    Files with victims are replaced by files of the survivors in their order, whose footers know these alone; files that
    are left without rows are removed, all others are not touched. Rows with a null key stay. Without victims nothing
    is written. A table whose folder is missing from ``paths`` has no rows and ends its links.
    """
    counted = [
        spark.read.parquet(path).select(F.lit(table).alias("table_name"), F.col("_metadata.file_path").alias("file")).groupBy("table_name", "file").agg(F.count("*").alias("n_rows"))
        for table, path in paths.items()
    ]
    if not counted:
        return spark.createDataFrame([], "table_name string, path string, n_rows long, n_erased long, rewritten boolean")
    before = counted[0]
    for more in counted[1:]:
        before = before.unionByName(more)
    before = materialize(before, "files")
    staged = f"{next(iter(paths.values())).rstrip('/').rpartition('/')[0]}-staged-{uuid.uuid4().hex[:8]}"
    places = victims(spark, paths, root, forgotten, on, links)
    changed = publish(rewrite(places, staged))
    _delete(spark, staged)
    untouched = before.join(changed.select("file"), "file", "left_anti").select("table_name", F.col("file").alias("path"), "n_rows", F.lit(0).cast("long").alias("n_erased"), F.lit(False).alias("rewritten"))
    new = changed.where("new_file IS NOT NULL").select("table_name", F.col("new_file").alias("path"), "n_rows", "n_erased", F.lit(True).alias("rewritten"))
    return untouched.unionByName(new)


_READ = "path string, n_rows long, cents long, ids_sha256 string, columns string"


def read_back(files: DataFrame, amounts: Mapping[str, str]) -> DataFrame:
    """``files`` with what their own bytes say: n_rows, cents (sum of floor(100 x + 0.5) of the column that ``amounts``
    names for the table, null or not a number as 0), ids_sha256 (of the first column's values in file order, decimal,
    null empty, joined by commas) and columns. Each file is read by one task as a stream."""
    spark = files.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for table, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, where = _opened(path)
                digest, n, cents = hashlib.sha256(), 0, 0
                with system.open_input_file(where) as source, pq.ParquetFile(source) as file:
                    names = file.schema_arrow.names
                    wanted = [names[0], amounts[table]]
                    for rows in file.iter_batches(batch_size=BATCH_ROWS, columns=wanted):
                        ids = pc.fill_null(rows.column(wanted[0]).cast(pa.string()), "")
                        digest.update((("," if n else "") + ",".join(ids.to_pylist())).encode())
                        x = rows.column(wanted[1]).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)
                        cents += int(np.floor(100 * np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0) + 0.5).astype(np.int64).sum())
                        n += rows.num_rows
                out.append((path, n, cents, digest.hexdigest(), ",".join(names)))
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=[c.split()[0] for c in _READ.split(", ")])

    seen = files.select("table_name", "path").repartition(shuffle_partitions(spark), "path").mapInArrow(released(run), _READ)
    return files.drop("n_rows").join(seen, "path")


def most_referenced(rows: DataFrame, on: str, owners: DataFrame, owner: str) -> DataFrame:
    """The one ``owner`` of ``owners`` whose keys ``on`` have most rows; of several, even at no rows, the smallest."""
    counts = rows.where(F.col(on).isNotNull()).groupBy(on).agg(F.count("*").alias("_n"))
    held = owners.where(F.col(owner).isNotNull()).select(owner, on).distinct().join(counts, on, "left")
    sums = held.groupBy(owner).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_n"))
    return sums.agg(F.max(F.struct("_n", (-F.col(owner)).alias("_less"))).alias("top")).where("top IS NOT NULL").select((-F.col("top._less")).alias(owner))
