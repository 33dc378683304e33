"""Tensor artifacts as a data source: archives of arrays, and the zip layout of tensor pickles, below one root folder.

An artifact lies at ``root/<tier>/<mode>/…/<name>.npz`` or ``.pt``; beside it may lie its metadata, ``<name>.json``. Planning
lists files and drops those whose tier or mode a filter rules out; filters on checkpoint and layer go to the readers, which
then skip blocks. Only files that may have matching rows are opened. Pickles are read without executing anything: only the
few names that a tensor is made of are known, and storages become arrays.
"""

from __future__ import annotations

import hashlib
import io
import json
import pickle
import re
import zipfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from wayline.session import ship

SCHEMA = "path string, tier string, mode string, checkpoint string, layer int, vector array<float>, dtype string, finite boolean, sha256 string, bytes long, metadata string, problem string"
#: Bytes of files that one task reads.
TASK_BYTES = 128 << 20
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_KINDS = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32()), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string()]
#: The storage classes of tensor pickles, and how their bytes are read. bfloat16 is the upper half of a float.
STORAGES = {"DoubleStorage": "<f8", "FloatStorage": "<f4", "HalfStorage": "<f2", "BFloat16Storage": "bfloat16", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "<i1", "ByteStorage": "<u1", "BoolStorage": "<?"}


class Tensor:
    """A block of numbers and the name of their kind."""

    def __init__(self, values: np.ndarray, dtype: str) -> None:
        self.values, self.dtype = values, dtype


class _Restricted(pickle.Unpickler):
    def __init__(self, data: io.BytesIO, archive: zipfile.ZipFile, prefix: str) -> None:
        super().__init__(data, encoding="utf-8")
        self._archive, self._prefix = archive, prefix

    def find_class(self, module: str, name: str) -> object:
        if (module, name) == ("torch._utils", "_rebuild_tensor_v2"):
            return _rebuilt
        if (module, name) == ("collections", "OrderedDict"):
            return OrderedDict
        if module == "torch" and name in STORAGES:
            return name
        raise pickle.UnpicklingError(f"{module}.{name} is not allowed")

    def persistent_load(self, told: tuple) -> Tensor:
        kind, storage, key, _, n = told
        if kind != "storage" or not re.fullmatch(r"\w+", str(key)):
            raise pickle.UnpicklingError("unknown storage")
        raw = self._archive.read(f"{self._prefix}data/{key}")
        dtype = STORAGES[storage]
        if dtype == "bfloat16":
            flat = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
        else:
            flat = np.frombuffer(raw, dtype)
        if len(flat) != n:
            raise pickle.UnpicklingError("a storage of another size")
        return Tensor(flat, {"<f8": "float64", "<f4": "float32", "<f2": "float16", "bfloat16": "bfloat16"}.get(dtype, dtype.strip("<")))


def _rebuilt(storage: Tensor, offset: int, size: tuple, stride: tuple, *_: object) -> Tensor:
    ends = offset + sum((n - 1) * s for n, s in zip(size, stride, strict=True)) if all(size) else offset
    if offset < 0 or min((*size, *stride), default=0) < 0 or all(size) and ends >= len(storage.values):
        raise pickle.UnpicklingError("a tensor beyond its storage")
    flat = storage.values[offset:]
    return Tensor(np.lib.stride_tricks.as_strided(flat, size, [s * flat.itemsize for s in stride]).copy(), storage.dtype)


def unpickled(raw: bytes) -> object:
    """What a tensor pickle in its zip layout holds, with :class:`Tensor` in the place of tensors."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        inside = [n for n in archive.namelist() if n.endswith("/data.pkl") or n == "data.pkl"]
        if len(inside) != 1:
            raise pickle.UnpicklingError("no single data.pkl")
        prefix = inside[0].removesuffix("data.pkl")
        if f"{prefix}byteorder" in archive.namelist() and archive.read(f"{prefix}byteorder") != b"little":
            raise pickle.UnpicklingError("big-endian storages")
        return _Restricted(io.BytesIO(archive.read(inside[0])), archive, prefix).load()


def blocks(raw: bytes, kind: str, wanted: set[str] | None) -> tuple[list[int], dict[str, Tensor]]:
    """The layers of an artifact and its wanted checkpoints (None: the primary one). A pickle holds ``layers``,
    ``activations`` with the name ``primary_checkpoint``, and in its present form ``position_activations`` by name; an
    archive of arrays ``layers``, ``primary`` and an array for each name."""
    if kind == "pt":
        held = unpickled(raw)
        if not isinstance(held, dict):
            raise ValueError("not a mapping")
        layers, primary = held.get("layers"), str(held.get("primary_checkpoint") or "primary")
        named = held.get("position_activations") if isinstance(held.get("position_activations"), dict) else {}
        found = {primary: held.get("activations"), **named} if wanted is not None else {primary: held.get("activations")}
    else:
        with np.load(io.BytesIO(raw), allow_pickle=False) as arrays:
            layers = arrays["layers"].tolist() if "layers" in arrays.files else None
            primary = str(arrays["primary"]) if "primary" in arrays.files else "primary"
            names = [n for n in arrays.files if n not in ("layers", "primary")]
            found = {n: Tensor(arrays[n], str(arrays[n].dtype)) for n in names if (n in wanted if wanted is not None else n == primary)}
    if not isinstance(layers, list) or not layers or not all(isinstance(x, int) and not isinstance(x, bool) for x in layers):
        raise ValueError("invalid layers")
    return layers, {n: t for n, t in found.items() if wanted is None or n in wanted}


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", uri) if ":" in uri else f"file://{uri}")


@dataclass
class Files(InputPartition):
    """Files that one task reads: (path, tier, mode)."""

    files: list[tuple[str, str, str]]


class _Reader(DataSourceReader):
    """Filters that are understood: equality and membership of tier, mode, checkpoint and layer."""

    def __init__(self, options: dict[str, str]) -> None:
        self._root = options["path"].rstrip("/")
        self._hidden = int(options["hidden"]) if "hidden" in options else None
        self._task_bytes = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))
        self._only: dict[str, set] = {}

    def pushFilters(self, filters: list) -> Iterator:  # noqa: N802  (the name of the interface)
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            name = f.attribute[0] if values is not None and len(f.attribute) == 1 else None
            if name in ("tier", "mode", "checkpoint", "layer"):
                self._only[name] = self._only.get(name, values) & values
            else:
                yield f
        # An artifact that cannot be read says so in a row without checkpoint and layer; Spark filters these again.

    def partitions(self) -> list[Files]:
        system, root = _opened(self._root)
        prefix = self._root[: len(self._root) - len(root)] if self._root.endswith(root) else ""
        out, held, size = [], [], 0
        for info in sorted(system.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            way = info.path[len(root) :].strip("/").split("/")
            if info.type != fs.FileType.File or len(way) < 3 or info.extension not in ("npz", "pt"):
                continue
            if any(way[i] not in self._only[n] for i, n in enumerate(("tier", "mode")) if n in self._only):
                continue
            held.append((prefix + info.path, way[0], way[1]))
            size += info.size
            if size >= self._task_bytes:
                out, held, size = [*out, Files(held)], [], 0
        return [*out, Files(held)] if held or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        for path, tier, mode in partition.files:
            system, where = _opened(path)
            with system.open_input_file(where) as file:
                raw = file.read()
            beside = f"{where.rpartition('.')[0]}.json"
            metadata = None
            if system.get_file_info(beside).type == fs.FileType.File:
                with system.open_input_file(beside) as file:
                    metadata = file.read().decode(errors="replace")
            rows = list(self._rows(path, tier, mode, raw, metadata))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)

    def _rows(self, path: str, tier: str, mode: str, raw: bytes, metadata: str | None) -> Iterator[tuple]:
        digest, wanted = hashlib.sha256(raw).hexdigest(), self._only.get("checkpoint")
        told = lambda problem, checkpoint=None: (path, tier, mode, checkpoint, None, None, None, None, digest, len(raw), metadata, problem[:200])
        try:
            layers, found = blocks(raw, path.rpartition(".")[2], wanted)
        except (ValueError, KeyError, OSError, EOFError, IndexError, TypeError, AttributeError, OverflowError, pickle.UnpicklingError, zipfile.BadZipFile) as error:
            yield told(f"{type(error).__name__}: {error}")
            return
        for name, tensor in found.items():
            if not isinstance(tensor, Tensor):
                yield told("no tensor", name)
            elif tensor.values.ndim != 2 or len(tensor.values) != len(layers) or self._hidden not in (None, tensor.values.shape[1]):
                yield told(f"shape {'x'.join(map(str, tensor.values.shape))}", name)
            else:
                for layer, vector in zip(layers, tensor.values.astype(np.float32), strict=True):
                    if "layer" not in self._only or layer in self._only["layer"]:
                        yield (path, tier, mode, name, layer, vector, tensor.dtype, bool(np.isfinite(vector).all()), digest, len(raw), metadata, None)


class TensorSource(DataSource):
    """``format("tensors")`` with ``path`` and, if vectors must have one, their length ``hidden``."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return _Reader(dict(self.options))


def tensor_rows(spark: SparkSession, root: str, hidden: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """A row for each layer and checkpoint of every artifact below ``root`` (see the module). Without a filter on
    ``checkpoint`` an artifact gives its primary one. A file that cannot be read, or whose block has another shape, gives
    one row with its ``problem`` and without a layer."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it filters are right, but nothing is skipped
    spark.dataSource.register(TensorSource)
    reader = spark.read.format("tensors").option("taskBytes", str(task_bytes))
    return (reader.option("hidden", str(hidden)) if hidden else reader).load(root)


def repair_problems(requests: DataFrame, artifacts: DataFrame, dtype: str = "bfloat16") -> DataFrame:
    """(trajectory_id, path, problem) of repairs whose bytes are not what they say: ``requests`` has trajectory_id, path,
    expected_checksum, new_checksum, layers and hidden; ``artifacts`` are :func:`tensor_rows` of what was written.

    missing, unreadable or of another shape, not the digest that the result tells, still the digest from before, another
    dtype, other layers, another length, or values that are not finite."""
    own = artifacts.groupBy(F.col("path").alias("_path"), F.col("checkpoint").alias("_checkpoint")).agg(
        F.min("sha256").alias("_sha"), F.min("problem").alias("_problem"), F.min("dtype").alias("_dtype"), F.array_sort(F.collect_list("layer")).alias("_layers"),
        F.max(F.size("vector")).alias("_long"), F.min(F.size("vector")).alias("_short"), F.bool_and(F.coalesce("finite", F.lit(True))).alias("_finite"),
    )
    both = requests.join(own, F.col("path") == F.col("_path"), "left")
    problem = (
        F.when(F.col("_sha").isNull(), "missing").when(F.col("_problem").isNotNull(), F.col("_problem")).when(F.col("_sha") != F.col("new_checksum"), "checksum")
        .when(F.col("new_checksum") == F.col("expected_checksum"), "unchanged").when(F.col("_dtype") != dtype, "dtype").when(F.col("_layers") != F.array_sort("layers"), "layers")
        .when((F.col("_long") != F.col("hidden")) | (F.col("_short") != F.col("hidden")), "hidden").when(~F.col("_finite"), "not finite")
    )
    return both.select("trajectory_id", "path", problem.alias("problem")).where("problem IS NOT NULL").distinct()


def pair_differences(pairs: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(pair columns, checkpoint, layer, exact, max_abs) of two artifacts: ``pairs`` has ``clean_path`` and
    ``injected_path``; ``exact`` says whether the vectors are equal, ``max_abs`` is their largest difference."""
    side = lambda p: artifacts.where("problem IS NULL").select(F.col("path").alias(f"{p}_path"), "checkpoint", "layer", F.col("vector").alias(f"_{p}"))
    both = pairs.join(side("clean"), "clean_path").join(side("injected"), ["injected_path", "checkpoint", "layer"])
    apart = F.array_max(F.zip_with("_clean", "_injected", lambda x, y: F.abs(x.cast("double") - y.cast("double"))))
    return both.select(*pairs.columns, "checkpoint", "layer", F.col("_clean").eqNullSafe(F.col("_injected")).alias("exact"), apart.alias("max_abs"))


def write_archives(rows: DataFrame, root: str) -> DataFrame:
    """Writes archives of arrays: ``rows`` has path (below the root), layers, primary, metadata (JSON text or null) and
    ``named``, a map from checkpoint to its layers' vectors. (path, sha256) of what was written; a task that is run again
    writes the same bytes to the same place."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = io.BytesIO()
                np.savez(data, layers=np.array(r["layers"]), primary=np.array(r["primary"]), **{n: np.array(v, np.float32) for n, v in r["named"]})
                system, where = _opened(f"{root}/{r['path']}")
                system.create_dir(where.rpartition("/")[0], recursive=True)
                for place, raw in ((where, data.getvalue()), (f"{where.rpartition('.')[0]}.json", (r["metadata"] or "").encode())):
                    if raw:
                        with system.open_output_stream(place) as sink:
                            sink.write(raw)
                out.append((f"{root}/{r['path']}", hashlib.sha256(data.getvalue()).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], names=["path", "sha256"])

    return rows.select("path", "layers", "primary", "metadata", "named").mapInArrow(run, "path string, sha256 string")


def metadata_fields(artifacts: DataFrame, *names: str) -> DataFrame:
    """``artifacts`` with fields of their metadata, as text; null where there is no metadata or it is no JSON."""
    return artifacts.withColumns({n: F.get_json_object("metadata", f"$.{json.dumps(n)[1:-1]}") for n in names})
