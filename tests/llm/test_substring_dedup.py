from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from wayline.llm.fm_index import BitVector, FMIndex, WaveletMatrix
from wayline.llm.substring_dedup import earliest, segments, substring_dedup
from wayline.llm.words import hash_words


def brute(known, window):
    words = {i: (t or "").encode().split() for i, t in known.items()}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        cut = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                cut[j : j + window] = [True] * window
        kept = [x for x, c in zip(w, cut, strict=True) if not c]
        out[i] = (len(w), sum(cut), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "anchor", "hot"), [(50, 8, 4000), (10, 3, 4000), (10, 3, 1)])
def test_against_all_windows(docs, known, window, anchor, hot):
    got = substring_dedup(docs, window=window, anchor=anchor, hot_segments=hot).collect()
    assert len(got) == docs.count()
    expected = brute(known, window)
    for r in got:
        if r.doc_id is None:
            assert r.n_removed == 0
        else:
            assert (r.n_words, r.n_removed, r.kept_sha256) == expected[r.doc_id], r.doc_id
    assert sum(v[1] for v in expected.values()) > 100


def test_empty(empty):
    assert substring_dedup(empty).collect() == []


def test_untouched_texts_keep_their_space(docs, known):
    for r in substring_dedup(docs, carry=True).collect():
        if not r.n_removed:
            assert r.kept_text == r.row.text


def test_ranks_are_counts():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 37, 1000)
    w = WaveletMatrix(x, 36)
    symbol, at = rng.integers(0, 37, 500), rng.integers(0, 1001, 500)
    assert w.rank(symbol, at).tolist() == [int((x[:p] == s).sum()) for s, p in zip(symbol, at, strict=True)]


def test_backward_search_finds_every_occurrence():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 4, 400)
    x[::57] = 0
    x[-1] = 0
    index = FMIndex(x, 6)
    for n in range(1, 7):
        for _ in range(40):
            p = rng.integers(1, 4, n)
            low, high = np.array([0]), np.array([len(x)])
            for s in p[::-1]:
                low, high = index.extend(np.array([s]), low, high)
            expected = [i for i in range(len(x) - n + 1) if (x[i : i + n] == p).all()]
            assert sorted(index.locate(np.arange(low[0], high[0])).tolist()) == expected


def test_earliest_document_of_each_window():
    rng = random.Random(1)
    base = [str(rng.randrange(3)) for _ in range(300)]
    for _ in range(60):
        window = rng.choice([3, 5, 8, 50])
        parts = [base[a : a + rng.randrange(window, window + 30)] for a in (rng.randrange(200) for _ in range(rng.randrange(1, 30)))]
        documents = np.array([rng.randrange(10) for _ in parts])
        first = {}
        for p, d in zip(parts, documents, strict=True):
            for j in range(len(p) - window + 1):
                first[tuple(p[j : j + window])] = min(first.get(tuple(p[j : j + window]), 99), d)
        got, _ = earliest([" ".join(p).encode() for p in parts], documents, window)
        assert got.tolist() == [first[tuple(p[j : j + window])] for p in parts for j in range(len(p) - window + 1)]


def test_matching_statistics_of_texts_that_are_not_indexed():
    rng = np.random.default_rng(7)
    for order in (3, 6, 50):
        parts = [rng.integers(1, 4, rng.integers(1, 60)) for _ in range(12)]
        owner = rng.integers(0, 5, 12) * 10
        flat = np.concatenate([np.append(p, 0) for p in parts])
        index = FMIndex(flat, order, np.repeat(owner, [len(p) + 1 for p in parts]))
        streamed = [np.concatenate([parts[3][:20], rng.integers(1, 6, 30), parts[5]]), rng.integers(1, 4, 80), np.array([9]), np.empty(0, np.int64)]
        size = np.array([len(x) for x in streamed])
        length, low, high = index.matches(np.concatenate(streamed), np.cumsum(size) - size, size)
        at = 0
        has = lambda run: [o for p, o in zip(parts, owner, strict=True) if any((p[k : k + len(run)] == run).all() for k in range(len(p) - len(run) + 1))]
        for x in streamed:
            for i in range(len(x)):
                want = max(n for n in range(min(order, len(x) - i) + 1) if n == 0 or has(x[i : i + n]))
                assert length[at] == want
                if want == order:
                    assert index.smallest(low[at : at + 1], high[at : at + 1])[0] == min(has(x[i : i + order]))
                at += 1


def test_positions_of_ones_and_least_symbols():
    rng = np.random.default_rng(2)
    for n in (1, 63, 64, 65, 700):
        bits = rng.random(n) < 0.3
        v = BitVector(bits)
        ones = np.flatnonzero(bits)
        assert v.select(np.arange(len(ones) + 1)).tolist() == [*ones.tolist(), n] and v.get(np.arange(n)).tolist() == bits.tolist()
    x = rng.integers(0, 23, 300)
    w = WaveletMatrix(x, 22)
    low = rng.integers(0, 299, 200)
    high = low + 1 + rng.integers(0, 300 - low - 1 + 1, 200).clip(0, 299 - low)
    assert w.least(low, high).tolist() == [int(x[a:b].min()) for a, b in zip(low, high, strict=True)] and w.get(np.arange(300)).tolist() == x.tolist()


def test_segments_cover_each_window_once_and_equal_windows_meet():
    rng = random.Random(4)
    docs = [[str(rng.randrange(6)) for _ in range(n)] for n in (0, 10, 49, 50, 51, 200, 300)]
    words = hash_words([w.encode() for d in docs for w in d])
    document, start, windows, mini, whole = segments(words, np.array([len(d) for d in docs]), 50, 8)
    seen, meet, same = set(), {}, {}
    for d, s, n, m, h in zip(document, start, windows, mini, whole, strict=True):
        assert same.setdefault(h, tuple(docs[d][s : s + n + 49])) == tuple(docs[d][s : s + n + 49])
        for i in range(n):
            seen.add((d, s + i))
            assert meet.setdefault(tuple(docs[d][s + i : s + i + 50]), m) == m
    assert seen == {(i, j) for i, d in enumerate(docs) for j in range(len(d) - 49)} and len(seen) == windows.sum()


def test_texts_of_one_id_are_judged_each_by_itself(spark):
    words = [f"w{i}" for i in range(130)]
    rows = [(5, " ".join(words[:60])), (5, " ".join(words[60:64])), (5, " ".join(words[50:120])), (5, " ".join(words[:60])), (7, " ".join(words)), (3, " ".join(words[64:115]))]
    got = sorted((r.doc_id, r.n_words, r.n_removed) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 51, 0), (5, 4, 0), (5, 60, 0), (5, 60, 0), (5, 70, 51), (7, 130, 120)]
