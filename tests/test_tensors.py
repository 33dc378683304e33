from __future__ import annotations

import hashlib
import io
import pickle
import sys
import types
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.sources import tensors


def tensor_pickle(values, storages=("FloatStorage",), evil=None):
    """The zip layout of a tensor pickle, written without the library that defines it."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    for name in tensors.STORAGES:
        setattr(torch, name, type(name, (), {"__module__": "torch"}))

    def _rebuild_tensor_v2(*a):
        return a

    _rebuild_tensor_v2.__module__, _rebuild_tensor_v2.__qualname__ = "torch._utils", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = _rebuild_tensor_v2
    stored = []

    class Block:
        def __init__(self, array, storage):
            self.array, self.storage = array, storage

        def __reduce__(self):
            n, step = self.array.size, [s // self.array.itemsize for s in self.array.strides]
            stored.append(self.array.tobytes() if self.storage != "BFloat16Storage" else (np.ascontiguousarray(self.array, np.float32).view(np.uint32) >> 16).astype("<u2").tobytes())
            return utils._rebuild_tensor_v2, (Key(self.storage, str(len(stored) - 1), n), 0, self.array.shape, tuple(step), False, {})

    class Key:
        def __init__(self, *told):
            self.told = told

    class Pickler(pickle.Pickler):
        def persistent_id(self, obj):
            return ("storage", getattr(torch, obj.told[0]), obj.told[1], "cpu", obj.told[2]) if isinstance(obj, Key) else None

    names = iter(storages * 50)
    turn = lambda v: Block(v, next(names)) if isinstance(v, np.ndarray) else {k: turn(x) for k, x in v.items()} if isinstance(v, dict) else v
    sys.modules |= {"torch": torch, "torch._utils": utils}
    try:
        body = io.BytesIO()
        Pickler(body, protocol=2).dump(evil if evil is not None else turn(values))
    finally:
        del sys.modules["torch"], sys.modules["torch._utils"]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("archive/data.pkl", body.getvalue())
        z.writestr("archive/byteorder", "little")
        for i, raw in enumerate(stored):
            z.writestr(f"archive/data/{i}", raw)
    return out.getvalue()


def archive(**arrays):
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("artifacts")
    x = np.arange(6, dtype=np.float32).reshape(2, 3)
    files = {
        "exploratory/off/a.npz": archive(layers=[8, 40], primary=np.array("last"), last=x, mid=x + 10),
        "exploratory/on/b.pt": tensor_pickle({"layers": [8, 40], "artifact_format_version": "v2", "primary_checkpoint": "last", "activations": x, "position_activations": {"last": x, "mid": x + 0.5}}, ("BFloat16Storage",)),
        "definitive/off/deep/c.pt": tensor_pickle({"layers": [1], "activations": np.array([[1.0, np.nan]], np.float64)}, ("DoubleStorage",)),
        "definitive/on/broken.npz": b"no archive", "definitive/on/shape.npz": archive(layers=[1, 2], primary=np.array("p"), p=x[:1]), "definitive/on/layers.npz": archive(primary=np.array("p"), p=x),
        "definitive/on/evil.pt": tensor_pickle(None, evil=OSError("x")), "definitive/on/list.pt": tensor_pickle([1]), "readme.npz": b"", "exploratory/off/a.json": b'{"token_id": 17}',
    }
    for name, raw in files.items():
        (top / name).parent.mkdir(parents=True, exist_ok=True)
        (top / name).write_bytes(raw)
    return top


def found(frame):
    return sorted((r.path.rpartition("/")[2], r.checkpoint, r.layer, tuple(r.vector)) for r in frame.where("problem IS NULL").collect() if r.finite)


def test_rows_of_both_kinds(spark, root):
    every = tensors.tensor_rows(spark, str(root))
    assert found(every) == [("a.npz", "last", 8, (0, 1, 2)), ("a.npz", "last", 40, (3, 4, 5)), ("b.pt", "last", 8, (0, 1, 2)), ("b.pt", "last", 40, (3, 4, 5))]
    kinds = {r.path.rpartition("/")[2]: (r.dtype, r.finite, r.tier, r.mode, r.metadata) for r in every.where("problem IS NULL").collect()}
    assert kinds == {"a.npz": ("float32", True, "exploratory", "off", '{"token_id": 17}'), "b.pt": ("bfloat16", True, "exploratory", "on", None), "c.pt": ("float64", False, "definitive", "off", None)}
    problems = {r.path.rpartition("/")[2]: r.problem for r in every.where("problem IS NOT NULL").collect()}
    assert set(problems) == {"broken.npz", "shape.npz", "layers.npz", "evil.pt", "list.pt"} and problems["shape.npz"] == "shape 1x3" and "not allowed" in problems["evil.pt"]
    for r in every.collect():
        assert r.sha256 == hashlib.sha256((root / r.path.partition(str(root))[2].strip("/")).read_bytes()).hexdigest()
    assert [r.token_id for r in tensors.metadata_fields(every, "token_id").where("mode = 'off' AND tier = 'exploratory'").select("token_id").distinct().collect()] == ["17"]


def test_filters_on_checkpoint_and_layer(spark, root):
    rows = tensors.tensor_rows(spark, str(root))
    assert found(rows.where("checkpoint = 'mid' AND layer = 40")) == [("a.npz", "mid", 40, (13, 14, 15)), ("b.pt", "mid", 40, (3.5, 4.5, 5.5))]
    assert found(rows.where("layer IN (8, 9) AND mode = 'off'")) == [("a.npz", "last", 8, (0, 1, 2))]
    assert rows.where("tier = 'nowhere'").count() == 0 and found(tensors.tensor_rows(spark, str(root), hidden=4)) == []


def test_only_matching_files_are_opened(spark, root, tmp_path):
    """Files of other tiers and modes are gone when the rows are read, which nobody notices."""
    import shutil

    own = tmp_path / "own"
    shutil.copytree(root, own)
    reader = tensors._Reader({"path": str(own)})
    from pyspark.sql.datasource import EqualTo, In

    assert list(reader.pushFilters([EqualTo(("tier",), "exploratory"), In(("mode",), ("on", "x")), EqualTo(("checkpoint",), "mid"), EqualTo(("dtype",), "float32")])) == [EqualTo(("dtype",), "float32")]
    parts = reader.partitions()
    assert [f[0].rpartition("/")[2] for p in parts for f in p.files] == ["b.pt"]
    rows = tensors.tensor_rows(spark, str(own)).where("tier = 'exploratory' AND mode = 'on'")
    (own / "exploratory/off/a.npz").chmod(0)
    shutil.rmtree(own / "definitive")
    assert found(rows) == [("b.pt", "last", 8, (0, 1, 2)), ("b.pt", "last", 40, (3, 4, 5))]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "tensors" in plan.lower()


def test_tasks_are_cut_by_bytes(root):
    one, many = tensors._Reader({"path": str(root)}), tensors._Reader({"path": str(root), "taskBytes": "1"})
    assert len(one.partitions()) == 1 and len([p for p in many.partitions() if p.files]) == 8


def test_strides_and_bounds():
    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    held = tensors.unpickled(tensor_pickle({"t": x.T}))
    assert held["t"].values.shape == (4, 3) and held["t"].values.strides
    storage = tensors.Tensor(np.arange(4.0), "float64")
    assert tensors._rebuilt(storage, 1, (2, 1), (1, 1)).values.tolist() == [[1.0], [2.0]]
    for bad in ((0, (5,), (1,)), (3, (2,), (1,)), (0, (2,), (-1,)), (-1, (1,), (1,))):
        with pytest.raises(pickle.UnpicklingError):
            tensors._rebuilt(storage, *bad)


def test_repairs_are_judged_by_their_bytes(spark, root):
    sha = lambda n: hashlib.sha256((root / n).read_bytes()).hexdigest()
    paths = {r.path.rpartition("/")[2]: r.path for r in tensors.tensor_rows(spark, str(root)).select("path").distinct().collect()}
    b = sha("exploratory/on/b.pt")
    rows = [
        ("good", paths["b.pt"], "old", b, [40, 8], 3), ("checksum", paths["b.pt"], "old", "other", [8, 40], 3), ("unchanged", paths["b.pt"], b, b, [8, 40], 3), ("layers", paths["b.pt"], "old", b, [8], 3), ("hidden", paths["b.pt"], "old", b, [8, 40], 4),
        ("missing", str(root / "none.pt"), "old", "new", [8], 3), ("dtype", paths["a.npz"], "old", sha("exploratory/off/a.npz"), [8, 40], 3), ("shape 1x3", paths["shape.npz"], "old", "new", [1, 2], 3),
    ]
    requests = spark.createDataFrame(rows, "trajectory_id string, path string, expected_checksum string, new_checksum string, layers array<int>, hidden int")
    got = {r.trajectory_id: r.problem for r in tensors.repair_problems(requests, tensors.tensor_rows(spark, str(root))).collect()}
    assert got == {t: t for t, *_ in rows if t != "good"}
    pairs = spark.createDataFrame([("p", paths["a.npz"], paths["b.pt"])], "pair string, clean_path string, injected_path string")
    both = tensors.pair_differences(pairs, tensors.tensor_rows(spark, str(root)).where(F.col("checkpoint").isin("last", "mid"))).collect()
    assert sorted((r.checkpoint, r.layer, r.exact, r.max_abs) for r in both) == [("last", 8, True, 0.0), ("last", 40, True, 0.0), ("mid", 8, False, 9.5), ("mid", 40, False, 9.5)]


def test_query_finds_every_vector_of_a_tier(spark):
    import pyarrow.parquet as pq

    from wayline.plans.artifacts import tensor_scan

    folder = "/root/testdata/sf0.001"
    held = {r["vec_id"]: np.array(r["embedding"], np.float32) for r in pq.read_table(f"{folder}/embeddings.parquet").to_pylist()}
    got = {r.vec_id: r for r in tensor_scan(spark, folder).collect()}
    assert set(got) == {i for i in held if i // 16 % 3}
    for i, r in got.items():
        assert r.as_written and r.finite and r.problem is None and r.mode == ("on" if i // 16 % 2 else "off")
        assert r.total == pytest.approx(float((held[i] * np.float32(2)).astype(float).sum()), abs=1e-9)
