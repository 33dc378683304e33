from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from wayline.sources import versions

SCHEMA = "k int, v string, meta struct<storage_path:string,sequence_length:int,kept:string>"


def rows(spark, ks, v="a"):
    return spark.createDataFrame([(k, v, (f"p{k}", 1, "x")) for k in ks], SCHEMA)


def held(spark, path, version=None):
    return sorted((r.k, r.v, r.meta and r.meta.storage_path) for r in versions.read_version(spark, path, version).collect())


def test_appends_are_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.read_version(spark, path) is None
    assert versions.append(rows(spark, [1, 2, 2]), path, ["k"]) == 1
    assert versions.append(rows(spark, [2, 3], "b"), path, ["k"]) == 2
    assert versions.append(rows(spark, [2, 3], "c"), path, ["k"]) == 2  # again: nothing new
    assert held(spark, path) == [(1, "a", "p1"), (2, "a", "p2"), (3, "b", "p3")] and held(spark, path, 1) == [(1, "a", "p1"), (2, "a", "p2")]
    assert versions.append(rows(spark, [9, 9]), str(tmp_path / "all")) == 1 and len(held(spark, str(tmp_path / "all"))) == 2


def test_writers_at_once_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.append(rows(spark, [0]), path, ["k"])
    with ThreadPoolExecutor(4) as pool:
        done = list(pool.map(lambda w: versions.append(rows(spark, range(10 * w, 10 * w + 12), f"w{w}"), path, ["k"]), range(4)))
    assert len(set(done)) == 4 and [k for k, *_ in held(spark, path)] == list(range(42))


def test_a_failed_write_is_invisible(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.append(rows(spark, [1]), path, ["k"])
    bad = rows(spark, [2, 3]).withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="no"):
        versions.append(bad, path, ["k"])
    versions._written(rows(spark, [7]), path)  # a writer that died before its commit
    assert held(spark, path) == [(1, "a", "p1")] and versions.versions(spark, path) == [1]


def change(spark, told):
    return spark.createDataFrame(told, "k int, was string, v string, new struct<storage_path:string,sequence_length:int>")


def update(row, new):
    return {"v": new("v"), "meta": versions.repaired_metadata(row("meta"), new("new"), ["storage_path", "sequence_length"])}


def test_changes_by_key(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.append(rows(spark, [1, 2, 3]), path, ["k"])
    versions.append(rows(spark, [4, 5]).unionByName(spark.createDataFrame([(6, "a", None), (None, "a", ("pn", 1, "x"))], SCHEMA)), path, ["k"])
    first = versions.parts(spark, path)[1]
    told = [(4, "a", "n4", ("q4", 7)), (6, "a", "n6", ("q6", 7)), (None, "a", "nn", ("qn", 7)), (99, "a", "x", None), (5, "old", "x", None), (1, "a", "x", None), (1, "a", "y", None)]
    report = versions.upsert(change(spark, told), path, ["k"], update, {"v": "was"})
    assert sorted((r.k, r.problem) for r in report.collect()) == [(1, "repeated"), (5, "changed"), (99, "missing")]
    got = {r.k: r for r in versions.read_version(spark, path).collect()}
    assert {k: (r.v, r.meta and tuple(r.meta)) for k, r in got.items()} == {
        1: ("a", ("p1", 1, "x")), 2: ("a", ("p2", 1, "x")), 3: ("a", ("p3", 1, "x")), 4: ("n4", ("q4", 7, "x")), 5: ("a", ("p5", 1, "x")), 6: ("n6", None), None: ("nn", ("qn", 7, "x")),
    }
    now = versions.parts(spark, path)[1]
    assert first[0] in now and first[1] not in now and len(now) == 2  # the part without changed keys is the same
    again = versions.upsert(change(spark, told[:1]), path, ["k"], update, {"v": "was"}).collect()
    assert [(r.k, r.problem) for r in again] == [(4, "changed")] and versions.parts(spark, path)[1] == now


def test_changes_at_once(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.append(rows(spark, range(8)), path, ["k"])
    with ThreadPoolExecutor(2) as pool:
        reports = list(pool.map(lambda w: versions.upsert(change(spark, [(k, "a", f"w{w}", ("q", w)) for k in ((0, 1, 2, 7) if w else (4, 5, 6, 7))]), path, ["k"], update, {"v": "was"}).collect(), (0, 1)))
    got = {k: v for k, v, _ in held(spark, path)}
    assert {got[k] for k in (0, 1, 2)} == {"w1"} and {got[k] for k in (4, 5, 6)} == {"w0"} and got[3] == "a" and got[7] in ("w0", "w1")
    assert [(r.k, r.problem) for rep in reports for r in rep] == [(7, "changed")]  # whoever came second


def test_missing_keys_may_be_added(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.append(rows(spark, [1]), path, ["k"])
    more = rows(spark, [1, 2], "n")
    assert versions.upsert(more, path, ["k"], lambda row, new: {"v": new("v")}, insert=True).count() == 0
    assert held(spark, path) == [(1, "n", "p1"), (2, "n", "p2")]


def test_query_repairs_what_it_may(spark):
    from wayline.plans.artifacts import metadata_repairs

    folder = "/root/testdata/sf0.001"
    users = {r.event_id: r.user_id for r in spark.read.parquet(f"{folder}/events.parquet").collect()}
    want = {}
    for e, user in users.items():
        want[e] = (f"live/{e}", 0, 1, None)
        if e % 7 == 0 and e % 35 == 0:
            want[-e - 1] = (None, None, None, "missing")
        elif e % 21 == 0:
            want[e] = (*want[e][:3], "changed")
        elif e % 7 == 0:
            want[e] = (f"repaired/{e}", user, 2, None)
    got = {r.event_id: (r.storage_path, r.sequence_length, r.n_layers, r.problem) for r in metadata_repairs(spark, folder).collect()}
    assert got == want
