from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from wayline.llm.bpe import PairTable, merge_all
from wayline.llm.prefix_bpe import Compatibility, SuffixAutomaton, encode_bpe, prefix_tokenizer

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "l'été 's 're 123 x²½ ΣΑΣ İI \x1c\x85\xa0a é <|endoftext|>x <|startoftext|> ﬁ  ́", "a<|b", "ABC'LL I'M'S", "aaaaaaaaaaa", "漢字かな交じり文 " * 3, "x" * 3000,
    "<|endoftext|><|endoftext|>", "a" * 513 + "漢" * 200, "qz" * 2000, "​﻿😀👩‍👩‍👧", "thethethethe" * 60,
]


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(texts, library):
    every = [*texts, *ODD]
    flat, sizes = prefix_tokenizer(PATH).encode(pa.array(every, pa.string()))
    for t, ids in zip(every, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_random_words_as_merged_one_by_one():
    """Of random bytes too, in blocks of all widths, equal to merging pair by pair; each word alone and all at once."""
    tokenizer, rng = prefix_tokenizer(PATH), random.Random(3)
    words = [[rng.choice(b"aehlnt\x80\xc3") for _ in range(rng.choice((1, 2, 3, 9, 40, 200)))] for _ in range(400)]
    for w in words:
        w[-1] += 256
    sizes = np.array([len(w) for w in words])
    symbols = np.concatenate([np.array(w) for w in words])
    flat, counts = tokenizer.encode_words(symbols, sizes)
    wanted, n = merge_all(tokenizer._pairs, np.concatenate([tokenizer._inside, tokenizer._last])[symbols], sizes)
    assert flat.tolist() == wanted.tolist() and counts.tolist() == n.tolist()
    for w, ids in zip(words, np.split(wanted, np.cumsum(n)[:-1]), strict=True):
        assert tokenizer._long(w)[::-1] == ids.tolist()


def test_automaton_finds_every_token_that_ends():
    rng = random.Random(1)
    tokens = list({tuple(rng.choice((0, 1, 2)) for _ in range(rng.randint(1, 6))) for _ in range(60)})
    auto = SuffixAutomaton(tokens)
    text = [rng.choice((0, 1, 2, 3)) for _ in range(500)]
    state, matched = np.zeros(1, np.int32), np.zeros(1, np.int32)
    for k, symbol in enumerate(text, 1):
        state, matched = auto.advance(state, matched, np.array([symbol]))
        found, node = [], auto.first(state, matched)
        while node[0] >= 0:
            found.append(tokens[auto.token[node[0]]])
            node = auto.shorter[node]
        assert found == sorted((t for t in tokens if tuple(text[max(0, k - len(t)) : k]) == t), key=len, reverse=True)


def test_pairs_are_judged_as_merging_does():
    rng = random.Random(2)
    merges, known = [], [(i,) for i in range(3)]
    while len(merges) < 40:  # random merges, each of two tokens that are there already
        a, b = rng.randrange(len(known)), rng.randrange(len(known))
        if known[a] + known[b] not in known:
            merges.append((a, b, len(known)))
            known.append(known[a] + known[b])
    left, right, merged = np.array(merges).T
    pairs = PairTable(left, right, np.arange(len(merges)), merged, len(known))
    encode = lambda s: merge_all(pairs, np.array(s), np.array([len(s)]))[0].tolist()
    real = [i for i, s in enumerate(known) if encode(s) == [i]]
    compatible = Compatibility(left, right, merged, len(known), pairs)
    for a in real:
        for b in real:
            expected = encode(known[a] + known[b]) == [a, b]
            assert compatible.one(a, b) == expected
            assert compatible(np.array([a, a]), np.array([b, b])).tolist() == [expected] * 2
    with pytest.raises(ValueError):
        Compatibility(np.array([4, 0]), np.array([0, 1]), np.array([5, 4]), 6, pairs)  # made before its part


def test_query(docs, library):
    rows = docs.collect()
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, []).append(r.text or "")
    got = encode_bpe(docs, PATH).collect()
    assert len(got) == len(rows)
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.n_tokens == len(ids) and r.decoded == library.decode(ids, skip_special_tokens=False)
        assert ids in [library.encode(t, add_special_tokens=False).ids for t in texts[r.doc_id]]


def test_empty(empty):
    assert encode_bpe(empty, PATH).collect() == []


def test_registered_query_on_given_texts(spark, tmp_path, library):
    from wayline.llm.queries import op11_bpe

    rows = [(i, t) for i, t in enumerate(["", None, "Two words", *ODD])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op11_bpe(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (
            len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()
        )
