from __future__ import annotations

import hashlib
import json
import random
import struct

import pytest
from pyspark.sql import functions as F

from wayline.functions import hashing

NUMBERS = [0.0, -0.0, 1.0, -1.5, 0.1, 1e-4, 1e-5, 123456789.125, 1e15, 1e16, 1.5e16, 1e22, 1e23, 2e-3, 5.684341886080802e-14, 2.2250738585072014e-308, 5e-324, 1.7976931348623157e308, 1 / 3, 100.0, 9007199254740993.0, 0.30000000000000004]
TEXTS = ["", "plain", 'quo"te', "back\\slash", "a\nb\tc\r\b\f", "\x00\x1f\x7f", "ünïcode", "漢字", "😀 x 👩‍👩‍👧", "/slash", "  "]


def written(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False)


def test_numbers_and_texts(spark):
    rng = random.Random(4)
    numbers = NUMBERS + [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)) if x == x and abs(x) != float("inf")] + [rng.random() for _ in range(2000)] + [round(rng.uniform(-100, 100), 2) for _ in range(500)]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double").select("i", hashing.canonical_json(F.col("x"), hashing.DoubleType()).alias("j")).collect()
    bad = [(numbers[r.i], r.j) for r in got if r.j != ("-0.0" if str(numbers[r.i]) == "-0.0" else written(numbers[r.i]))]
    assert not bad, bad[:5]
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", hashing.canonical_json(F.col("t"), hashing.StringType()).alias("j")).collect()
    assert {r.i: r.j for r in texts} == {i: written(t) for i, t in enumerate(TEXTS)}
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(float("nan"),)], "x double").select(hashing.canonical_json(F.col("x"), hashing.DoubleType())).collect()


def test_nested_values(spark):
    kind = "struct<z:int,a:struct<y:array<double>,x:string>,m:map<string,boolean>,n:array<struct<q:long,b:string>>,e:array<string>>"
    value = {"z": None, "a": {"y": [1.0, None, 0.25], "x": "é"}, "m": {"k2": True, "k1": None}, "n": [{"q": 5, "b": None}, None], "e": []}
    row = spark.createDataFrame([(json.dumps(value),)], "t string").select(F.from_json("t", kind).alias("v"))
    assert row.select(hashing.canonical_json(F.col("v"), row.schema["v"].dataType).alias("j")).first().j == written(value)
    with pytest.raises(TypeError):
        hashing.canonical_json(F.col("d"), spark.sql("SELECT DATE '2024-01-01' AS d").schema["d"].dataType)


def test_rows_of_a_prediction_manifest(spark):
    """Rows with nested and missing values, as a JSON writer with sorted keys writes them."""
    rows = [{"trajectory_id": f"t{i}", "layer": 40 + i, "score": i / 7, "label": None if i % 3 else i % 2, "match_group": {"b": "ü", "a": i}} for i in range(20)]
    frame = spark.createDataFrame([(json.dumps(r),) for r in rows], "t string").select(F.from_json("t", "struct<trajectory_id:string,layer:int,score:double,label:int,match_group:struct<b:string,a:int>>").alias("v")).select("v.*")
    got = sorted(r.j for r in frame.select(hashing.canonical_row(frame, frame.columns).alias("j")).collect())
    assert got == sorted(map(written, rows))
    whole = "[" + ",".join(r.j for r in frame.orderBy("layer").select(hashing.canonical_row(frame, frame.columns).alias("j")).collect()) + "]"
    assert hashlib.sha256(whole.encode()).hexdigest() == hashlib.sha256(written(rows).encode()).hexdigest()


def test_tables_as_multisets(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.5), ("b", 2, None), (None, 3, 1.0)], "g string, x int, y double")
    one = {r.g: (r.n, r.table_sha256) for r in hashing.table_sha256(df, ["g"], ["x", "y"]).collect()}
    assert one == {r.g: (r.n, r.table_sha256) for r in hashing.table_sha256(df.repartition(5, "y"), ["g"], ["y", "x"]).collect()}
    lanes = [2 * int(hashlib.sha256(b'{"x":1,"y":0.5}').hexdigest()[16 * i : 16 * i + 16], 16) % 2**64 for i in range(4)]
    assert one["a"] == (2, hashlib.sha256(":".join(map(str, [2, *lanes])).encode()).hexdigest())
    assert len({v for _, v in one.values()}) == 3 and hashing.table_sha256(df.limit(0), [], ["x"]).first().n == 0
    plan = hashing.table_sha256(df, ["g"], ["x"])._jdf.queryExecution().executedPlan().toString()
    assert "collect" not in plan.lower() and "ObjectHash" not in plan
