from __future__ import annotations

import random
import time
import re

import numpy as np
import pytest

from wayline.llm import near_dedup as nd
from wayline.llm.graph import components
from wayline.llm.near_dedup import near_dedup

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, k):
    w = [x for x in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    return frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)])


def brute(known, k, percent):
    sets = {i: shingles(t, k) for i, t in known.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent", "limits"), [(3, 85, {}), (5, 80, {}), (3, 85, {"bucket": 3, "group_shingles": 400})])
def test_against_all_pairs(docs, known, k, percent, limits):
    got = near_dedup(docs, shingle=k, percent=percent, **limits).collect()
    assert len(got) == docs.count()
    expected = brute(known, k, percent)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == expected[r.doc_id], r
            assert r.kept == (r.component_id == r.doc_id)


def test_empty(empty):
    assert near_dedup(empty).collect() == []


def test_large_family_in_tiles(spark):
    """A family of near copies, each linked with some others only, found alike in one task and in many small tiles."""
    rng = random.Random(3)
    base = [str(rng.randrange(10**6)) for _ in range(120)]
    rows = [(i, " ".join(w if rng.random() > 0.03 else str(rng.randrange(10**6)) for w in base)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = brute(dict(rows), 3, 85)
    for limits in ({}, {"bucket": 16, "group_shingles": 2000}):
        got = {r.doc_id: r.component_id for r in near_dedup(docs, shingle=3, percent=85, **limits).collect()}
        assert got == {i: c for i, (_, c) in expected.items()}
    assert len({c for _, c in expected.values()}) not in (1, 120)


def test_every_pair_within_the_distance_shares_an_entry():
    rng = np.random.default_rng(1)
    for errors in (0, 1, 11, 22, 23):
        a = rng.integers(0, 1 << 16, (200, nd.SYMBOLS)).astype(np.uint16)
        b = a.copy()
        for row in b:
            at = rng.choice(nd.SYMBOLS, errors, replace=False)
            row[at] ^= rng.integers(1, 1 << 16, errors).astype(np.uint16)
        assert ((a != b).sum(axis=1) == errors).all()
        assert (nd.entries(a) == nd.entries(b)).any(axis=1).all()


def test_links_connect_what_all_pairs_connect():
    rng = np.random.default_rng(2)
    for _ in range(30):
        base = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(np.where(rng.random(60) < rng.choice([0.0, 0.02, 0.06, 0.2]), rng.integers(0, 2**63, 60).astype(np.uint64), base)) for _ in range(25)]
        got, want = _roots(len(sets), nd.links(sets, 85)), _roots(len(sets), [(a, b) for a in range(25) for b in range(a) if _linked(sets[a], sets[b])])
        assert got == want


def _linked(a, b):
    both = len(np.intersect1d(a, b))
    return both * 100 >= 85 * (len(a) + len(b) - both)


def _roots(n, edges):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_a_hot_key_is_passed_on(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(nd, "_HELD", 10)
    rows = [(1, i) for i in range(35)] + [(2, 1), (3, 1), (3, 5)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k for k, _ in part]), pa.array([r for _, r in part])], names=["key", "rep"]) for part in (rows[:12], rows[12:20], rows[20:36], rows[36:])]
    out = pa.Table.from_batches(list(nd._buckets(iter(batches))))
    by = {}
    for b, r in zip(out.column("bucket").to_pylist(), out.column("rep").to_pylist(), strict=True):
        by.setdefault(b, set()).add(r)
    assert sorted(map(len, by.values())) == [2, 35]


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1040)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*chain, *star, (5, 5)], "a long, b long")).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 7 for i in (7, *range(1000, 1040))) and 5 not in got
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_an_id_with_several_texts_is_one_document(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(5, a), (5, b), (7, b), (3, a), (9, "other words altogether"), (9, ""), (9, None), (11, ""), (11, b + " end"), (12, None), (12, ""), (13, f"{a}\n{b}"), (None, a), (None, a)]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), shingle=3, percent=85).collect()
    want = [(5, 116, 5), (5, 116, 5), (7, 58, 7), (3, 58, 3), *[(9, 1, 9)] * 3, (11, 59, 7), (11, 59, 7), (12, 0, 12), (12, 0, 12), (13, 118, 5), (None, 58, None), (None, 58, None)]
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == sorted((str(i), n, str(c)) for i, n, c in want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_dense_groups_take_about_linear_time():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**63, 40).astype(np.uint64)

    def compared(n):
        sets = [np.unique(np.append(base, rng.integers(0, 2**63, 1).astype(np.uint64))) for _ in range(n)]
        began = time.process_time()
        assert len(nd.links(sets, 85)) == n - 1
        return time.process_time() - began

    compared(200)
    small, large = compared(500), compared(4000)
    assert large < 40 * small  # 64 times would be quadratic
