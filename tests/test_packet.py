from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from wayline.operators import packet


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_prefix_sums(spark, width):
    rng = random.Random(width)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(-30, 60)]), rng.choice([None, 1, 2, 5]), i) for i in range(150)]
    got = packet.prefix_sums(spark.createDataFrame(rows, "g string, o long, v long, i long"), ["g"], "o", ["v"], width).collect()
    assert len(got) == 150
    for g in ("a", "b", None):
        own = sorted((r for r in got if r.g == g and r.o is not None), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and [r.o for r in own] == sorted(r.o for r in own)
        total = 0
        for r in own:
            assert r.v_before == total
            total += r.v or 0
    assert all(r.place is None and r.v_before is None for r in got if r.o is None)


def test_positions(spark):
    r = spark.range(1).select(*[packet.injected_position(F.lit(t), F.lit(x)).alias(n) for n, t, x in (("one", "say bad now", "bad"), ("two", "bad bad", "bad"), ("none", "x", "bad"), ("empty", "x", ""))]).first()
    assert tuple(r.one) == (4, 7, 11, pytest.approx(5.5 / 11)) and r.two is None and r.none is None and r.empty is None


def test_covariates(spark):
    rows = spark.createDataFrame([("d", m, h, f"{m}{h}") for m in ("off", "on") for h in (2, 3)] + [("e", "off", 2, "x"), ("e", "off", 2, "y"), ("f", "off", 2, "z")], "domain string, mode string, hop int, id string")
    got = {r.domain: (r.n_runs, [x.id for x in r.runs], r.complete) for r in packet.covariates(rows, "domain", ["mode", "hop"], ["id"], 4).collect()}
    assert got == {"d": (4, ["off2", "off3", "on2", "on3"], True), "e": (2, ["x", "y"], False), "f": (1, ["z"], False)}
    assert {r.domain: r.complete for r in packet.covariates(rows, "domain", ["mode", "hop"], ["id"]).collect()} == {"d": True, "e": False, "f": True}


def test_seals(spark):
    pairs = spark.createDataFrame([("p", "d", "é"), ("q", "d", None)], "pair_id string, domain string, text string")
    made = packet.packet(pairs, ["pair_id", "domain"], ["text"], ["verdict"])
    row = {"pair_id": "p", "domain": "d", "reviewer_slot": 1, "text": "é"}
    assert made.count() == 4 and {r.verdict for r in made.collect()} == {None}
    assert made.where("pair_id = 'p' AND reviewer_slot = 1").first().locked_sha256 == hashlib.sha256(json.dumps(row, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    filled = made.withColumn("verdict", F.lit("yes"))
    assert packet.broken_seals(filled, ["pair_id", "domain"], ["text"]).count() == 0
    changed = filled.withColumn("text", F.when(F.col("reviewer_slot") == 2, "other").otherwise(F.col("text")))
    assert {(r.pair_id, r.reviewer_slot) for r in packet.broken_seals(changed, ["pair_id", "domain"], ["text"]).collect()} == {("p", 2), ("q", 2)}
    digest = {r.reviewer_slot: (r.n, r.rows_sha256) for r in packet.packet_digest(made, ["pair_id"], ["pair_id", "text"]).collect()}
    told = hashlib.sha256(json.dumps([{"pair_id": "p", "text": "é"}, {"pair_id": "q", "text": None}], separators=(",", ":")).encode()).hexdigest()
    assert digest == {1: (2, told), 2: (2, told)}
