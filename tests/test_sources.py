from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from wayline.sources import readers, sinks, versions
from wayline.streaming import ingest

SCHEMA = "schema_version string, trajectory_id string, step_index int, score double"


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join("" if r is None else r if isinstance(r, str) else json.dumps(r) for r in rows) + "\n")


def test_json_lines_skip_blanks_and_fail_on_bad_ones(spark, tmp_path):
    lines(tmp_path / "a" / "x.jsonl", [{"trajectory_id": "t", "step_index": 0}, None, {"trajectory_id": "t", "step_index": 1}])
    lines(tmp_path / "a" / "deep" / "y.jsonl", [{"trajectory_id": "u", "step_index": 0}])
    lines(tmp_path / "a" / "z.txt", ["not json"])
    got = readers.json_lines(spark, str(tmp_path / "a"), SCHEMA, pattern="*.jsonl")
    assert got.count() == 3 and got.select("source_file").distinct().count() == 2
    lines(tmp_path / "bad.jsonl", [{"trajectory_id": "t", "step_index": 0}, "{broken"])
    assert readers.json_lines(spark, str(tmp_path / "bad.jsonl"), SCHEMA, strict=False).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST"):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl"), SCHEMA).collect()


def test_one_document_a_file(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"trajectory_id": str(i), "full_events": [{"type": "agent_turn", "agent_id": "a", "checkpoints": ["p", "q"]}, {"type": "tool_call", "agent_id": "b", "checkpoints": []}]}, indent=1))
    docs = readers.json_documents(spark, str(tmp_path), "trajectory_id string, full_events array<struct<type:string,agent_id:string,checkpoints:array<string>>>")
    turns = readers.agent_turns(docs)
    assert turns.count() == 6 and {(r.agent_id, r.checkpoint) for r in turns.collect()} == {("a", "p"), ("a", "q")}


def test_csv_header_must_fit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,fired\nx,True\n")
    assert readers.csv_table(spark, str(tmp_path / "a.csv"), "k string, fired boolean").first().fired is True
    with pytest.raises(Exception, match="(?i)header"):
        readers.csv_table(spark, str(tmp_path / "a.csv"), "k string, other boolean").collect()


def test_tiers_and_versions(spark, tmp_path):
    for tier in ("exploratory", "definitive", "old"):
        lines(tmp_path / tier / "x.jsonl", [{"schema_version": "v3", "trajectory_id": tier, "step_index": 0}])
    rows = readers.json_lines(spark, str(tmp_path), SCHEMA, pattern="*.jsonl")
    assert {t: readers.of_tier(rows, t).first().trajectory_id for t in ("exploratory", "definitive", "unclassified")} == {"exploratory": "exploratory", "definitive": "definitive", "unclassified": "old"}
    index = rows.withColumn("analysis_tier", F.lit("definitive"))
    assert {r.analysis_tier for r in readers.versioned_index(index, "v3", ["v2"]).collect()} == {"definitive"}
    old = index.withColumn("schema_version", F.lit("v2"))
    assert {r.analysis_tier for r in readers.versioned_index(old, "v3", ["v2"]).collect()} == {"unclassified"}
    with pytest.raises(Exception, match="mixed"):
        readers.versioned_index(index.unionByName(old), "v3", ["v2"]).collect()


def test_texts_harvest_and_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "a.md").write_text("ap-1 and ap-2\nap-1")
    (tmp_path / "b.md").write_text("ap-2")
    found = {r.found: len(r.files) for r in readers.harvest(readers.texts(spark, str(tmp_path), "*.md"), r"ap-\d+").collect()}
    assert found == {"ap-1": 1, "ap-2": 2}
    assert {r.sha256 for r in readers.file_digests(spark, str(tmp_path), "b.md").collect()} == {hashlib.sha256(b"ap-2").hexdigest()}


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("b", 2.0, None), ("a", 1.0, 3)], "k string, v double, n int")
    sinks.stable_json(rows.repartition(3), str(tmp_path / "j"), ["k"])
    text = "".join(p.read_text() for p in sorted((tmp_path / "j").glob("part-*")))
    assert text == '{"k":"a","n":3,"v":1.0}\n{"k":"b","n":null,"v":2.0}\n'
    with pytest.raises(Exception, match="not finite"):
        sinks.stable_json(rows.withColumn("v", F.lit(float("nan"))), str(tmp_path / "n"), ["k"])
    sinks.stable_csv(rows, str(tmp_path / "c"), ["v"], by=["k"])
    assert {p.name for p in (tmp_path / "c").glob("k=*")} == {"k=a", "k=b"}
    with pytest.raises(ValueError, match="no rows"):
        sinks.stable_csv(rows.limit(0), str(tmp_path / "e"), ["k"])
    assert sinks.sparse_union(rows, spark.createDataFrame([("c", "z")], "k string, a string")).columns == ["a", "k", "n", "v"]


def test_stream_of_event_files(spark, tmp_path):
    day = "timestamp '2024-01-01 00:00:00'"
    events = spark.range(20).selectExpr("id AS event_id", f"{day} + make_interval(0,0,0,0,0,id * 10,0) AS ts", "id % 3 AS user_id", "'view' AS event_type", "CAST(id AS double) AS value", "'{}' AS props")
    events.unionByName(events.limit(5)).write.parquet(str(tmp_path / "in"))
    stream = ingest.once(ingest.event_stream(spark, str(tmp_path / "in")))
    for _ in range(2):
        ingest.append_log(stream, str(tmp_path / "log"), str(tmp_path / "checkpoint")).awaitTermination()
    assert versions.read_version(spark, str(tmp_path / "log")).count() == 20
