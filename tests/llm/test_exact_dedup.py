from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest

from wayline.llm.exact_dedup import _ENTRY, exact_dedup, merged


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("fan_in", [2, 8])
def test_against_groups(docs, fan_in):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[normal(t)].append(i)
    got = exact_dedup(docs, fan_in=fan_in).collect()
    assert len(got) == len(rows)
    expected = []
    for i, t in rows:
        own = groups[normal(t)]
        keep = min((x for x in own if x is not None), default=None)
        expected.append((i, keep, len(own), i == keep, hashlib.sha256(normal(t).encode()).hexdigest()))
    assert sorted(map(str, expected)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256)) for r in got)


def test_empty(empty):
    assert exact_dedup(empty).collect() == []


def test_many_copies_reach_one_entry(spark):
    docs = spark.range(5000).selectExpr("5000 - id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'copy' ELSE CAST(id AS string) END AS text")
    got = exact_dedup(docs).where("text_sha256 = sha2('copy', 256)").select("keep_id", "group_size").distinct().collect()
    assert [tuple(r) for r in got] == [(2, 1667)]


def _run(rows):
    out = np.zeros(len(rows), _ENTRY)
    for i, (digest, size, keep, n) in enumerate(rows):
        out[i] = (digest, 7, size, keep, n)
    return out


def test_runs_merge_in_order_and_keep_the_smallest():
    rng = np.random.default_rng(4)
    digests = [bytes(rng.integers(0, 256, 32, dtype=np.uint8).tolist()) for _ in range(60)] + [b"\0" * 32, b"\0" * 31 + b"\1"]
    every, blocks = [], []
    for run in range(8):
        own = sorted({digests[i] for i in rng.integers(0, len(digests), 40)})
        rows = [(d, digests.index(d), int(rng.integers(0, 1000)), run + 1) for d in own]
        every += rows
        blocks += [_run(rows[i : i + 6]) for i in range(0, len(rows), 6)]
    blocks.sort(key=lambda b: b[:1].tobytes()[:32])
    parts = list(merged(iter(blocks)))
    out = np.concatenate(parts)
    want = {d: (min(r[2] for r in every if r[0] == d), sum(r[3] for r in every if r[0] == d)) for d, *_ in every}
    got = [(e.tobytes()[:32], (int(e["keep_id"]), int(e["n"]))) for e in out]
    assert got == sorted(want.items()) and len(parts) > 5


def test_merge_refuses_a_collision():
    a = b"a" * 32
    with pytest.raises(ValueError, match="one digest"):
        list(merged(iter([_run([(a, 1, 9, 1)]), _run([(a, 2, 4, 1)])])))
    other = _run([(a, 1, 4, 1)])
    other["check"] = 8
    with pytest.raises(ValueError, match="one digest"):
        list(merged(iter([_run([(a, 1, 9, 1)]), other])))


def test_repeated_ids_and_heavy_texts(spark):
    docs = spark.createDataFrame([(5, "a"), (5, "b"), (5, "b"), (7, "b"), (None, "b")] + [(100 + i, "many") for i in range(50)], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).where("group_size < 50").collect())
    assert got == [(0, 5, 4, False), (5, 5, 1, True), (5, 5, 4, True), (5, 5, 4, True), (7, 5, 4, False)]
    assert exact_dedup(docs).where("group_size = 50 AND keep_id = 100").count() == 50
