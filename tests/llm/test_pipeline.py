from __future__ import annotations

import random
import re

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from wayline.llm import queries

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_stages_on_messy_rows(spark, docs, known, tmp_path):
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
        kept[name] = [(r.doc_id, r.text, r.n_chars) for r in at.collect()]
    assert len(kept["toxicity"]) == docs.count()
    spaces = [" ".join((t or "").split()) for i, t, _ in kept["exact dedup"] if i is not None]
    assert {i for i, *_ in kept["near dedup"]} <= {i for i, *_ in kept["exact dedup"]} and len(spaces) < len(known)
    for i, t, n in kept["substring dedup"]:
        assert i is None or len((t or "").split()) <= len((known[i] or "").split())
        assert t is None or n in (len(t), None)
    total = sum(r.length for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert total > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near dedup", "substring dedup", "packing"]


def test_a_unique_text_of_a_repeated_id_stays(spark):
    rows = [(3, "same text here"), (5, "same  text here"), (5, "a unique text of doc five"), (8, "another"), (8, "another"), (None, "another"), (None, "only here")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted((str(r.doc_id), r.text) for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    assert kept == sorted([("3", "same text here"), ("5", "a unique text of doc five"), ("8", "another"), ("8", "another"), ("None", "only here")])


@pytest.fixture(scope="module")
def corpus():
    """Documents of ordinary words, a quarter of them toxic, with exact copies, near copies and shared passages."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(3000)]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    rows, toxic = {}, {}
    for i in range(240):
        text = say(rng.randint(5, 120))
        toxic[i] = int(i % 4 == 0)
        for _ in range(toxic[i] * rng.randint(2, 4)):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron", "scum", "loser"]))
        rows[i] = " ".join(text)
    for i in range(300, 320):
        rows[i] = "  ".join(rows[rng.choice([k for k in range(240) if k % 4])].split(" ")) + rng.choice(["", "\n"])
    near = say(150)
    for i in range(400, 412):
        own = list(near)
        for _ in range(rng.choice([0, 1, 2, 3, 8])):
            own[rng.randrange(150)] = rng.choice(words)
        rows[i] = " ".join(own)
    passage = say(70)
    for i in range(500, 506):
        rows[i] = " ".join(say(20) + passage[rng.randrange(10) :] + say(rng.randrange(30)))
    rows[600], rows[601], rows[602] = "", None, " \t"
    return rows, toxic


def without_copies(rows):
    by = {}
    for i in sorted(rows):
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    return {i: t for i, t in rows.items() if i in by.values()}


def without_near_copies(rows, size=5, least=0.8):
    sets = {}
    for i, t in rows.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in rows:
        for j in rows:
            if j < i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: t for i, t in rows.items() if find(i) == i}


def without_repeats(rows, window=50):
    words, first, out = {i: (t or "").split() for i, t in rows.items()}, {}, {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    for i, w in words.items():
        cut = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                cut[j : j + window] = [True] * window
        out[i] = " ".join(x for x, c in zip(w, cut, strict=True) if not c) if any(cut) else rows[i]
    return out


def test_each_stage_against_brute_force(spark, corpus, tmp_path):
    from tokenizers import Tokenizer

    rows, toxic = corpus
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(i, 1, y) for i, y in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    want = {i: t for i, t in rows.items() if not toxic.get(i)}
    for (name, stage), brute in zip(corpus_pipeline.STAGES[:-1], (lambda r: want, without_copies, without_near_copies, without_repeats), strict=True):
        at = spark.createDataFrame(stage(spark, at, str(tmp_path)).collect(), frame.schema)
        before, want = len(want), brute(want)
        got = {r.doc_id: r.text for r in at.collect()}
        assert got == want, name
        assert name in ("toxicity", "substring dedup") or len(want) < before
    tokenizer = Tokenizer.from_file(PATH)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in want.items()}
    pieces = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: np.frombuffer(b"".join(x for _, x in sorted(p)), "<u4").tolist() for i, p in pieces.items()} == ids


def test_registered_names():
    names = queries.queries()
    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in names if k.startswith("op")} and "pipeline" in names
    assert set(queries.oracle_sql()) <= set(names)
