from __future__ import annotations

import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from wayline.llm import toxicity as tx
from wayline.llm.toxicity import forward_backward, toxicity, train


@pytest.mark.parametrize("n", [1, 2, 5, 7])
def test_marginals_are_those_of_all_taggings(n):
    rng = np.random.default_rng(n)
    unary, pair, counts = rng.normal(size=2 * n), rng.normal(size=(2, 2)), np.array([n, 0, n])
    p, pairs = forward_backward(unary, counts, pair)
    want, want_pairs = [], np.zeros((2, 2))
    for u in (unary[:n], unary[n:]):
        total, m, e = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(a * b for a, b in zip(u, y, strict=True)) + sum(pair[a, b] for a, b in zip(y, y[1:], strict=False)))
            total, m = total + w, m + w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                e[a, b] += w
        want += list(m / total)
        want_pairs += e / total
    assert np.allclose(p, want) and np.allclose(pairs, want_pairs)


def test_passes_in_parts_are_the_whole_pass():
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 900, 20)
    unary, pair = rng.normal(size=counts.sum()), rng.normal(size=(2, 2))
    a, b = forward_backward(unary, counts, pair), tx._marginals(unary, counts, pair, most=1000)
    assert np.allclose(a[0], b[0]) and np.allclose(a[1], b[1])


def corpus(n, seed=1):
    rng = random.Random(seed)
    bad, out = ["idiot", "moron", "scum", "loser"], []
    for i in range(n):
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 120))]
        toxic = int(i % 4 == 0)
        for _ in range(toxic * rng.randint(2, 5)):
            w.insert(rng.randrange(len(w)), rng.choice(bad) + rng.choice(["", ",", "!"]))
        out.append((i, " ".join(w), toxic))
    return out


def test_held_out_documents_and_spans(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t, _ in rows], "doc_id long, text string, label int, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (10**9, 1), (5, None), (6, 7), (1, 0)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    truth = {i: y for i, _, y in rows}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.97 * len(held)
    text = {i: t for i, t, _ in rows}
    words = {text[i][s.begin : s.end].strip(",!") for i, r in got.items() for s in r.spans}
    assert {"idiot", "moron", "scum", "loser"} <= words and len(words) < 12
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_labels_of_the_held_out_fold_are_not_learned(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    flip = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, toxic int")
    same = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = ({r.doc_id: r.score for r in toxicity(docs, x).collect()} for x in (flip, same))
    assert a == b


def test_messy_tables(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.0} and {r.predicted for r in got} == {0}
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    got = toxicity(docs, labels, carry=True)
    assert sorted(map(str, got.select("row.*").collect())) == sorted(map(str, docs.collect()))
    assert toxicity(empty, labels).collect() == []


def test_one_class_and_no_words():
    assert train(["a", "b"], np.array([1, 1])).constant == 1.0 and train([], np.empty(0, np.int64)).constant == 0.0
    model = train([None, "", "  ", "x"], np.array([0, 1, 0, 1]))
    score, spans = tx._Tagger(model).score(pa.array([None, "", "x y"], pa.string()))
    assert len(score) == 3 and spans[0] == []


def test_sample_is_bounded(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = tx.sample(docs, labels, "doc_id", "text", "toxic", (10, 20), 5, 0).collect()
    assert sum(r.label for r in got) == 10 and len(got) == 30 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in got)
