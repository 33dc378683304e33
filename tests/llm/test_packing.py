from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from wayline.llm.packing import HarmonicPacker, cuts, inner_classes, pack, tokenizer_of

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def test_ids_are_the_library_s(texts, library):
    odd = ["l'été 's 're 123 x²½ ΣΑΣ İI \x1c\x85\xa0a é <|endoftext|>x <|startoftext|> ﬁ  ́", "a<|b", "ABC'LL I'M'S"]
    every = [*texts, *odd]
    flat, sizes = tokenizer_of(PATH).encode(pa.array(every, pa.string()))
    for t, ids in zip(every, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert ids.tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_every_id_in_one_piece(docs, library):
    got = pack(docs, PATH).collect()
    wanted = sorted(((r.doc_id if r.doc_id is not None else -1), r.text or "") for r in docs.collect())
    pieces = {}
    for r in got:
        pieces.setdefault(-1 if r.doc_id is None else r.doc_id, []).append(r)
    for i, text in wanted:
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        own = sorted((p for p in pieces[i] if p.doc_tokens == len(ids)), key=lambda p: (p.start, p.sequence_id))
        assert own
        for p in own:
            part = ids[p.start : p.start + p.length]
            assert len(part) == p.length and (i < 0 or zlib.crc32(part.tobytes()) == p.ids_crc32)
    copies = {}
    for i, _ in wanted:
        copies[i] = copies.get(i, 0) + 1
    for i, own in pieces.items():
        assert sum(p.length for p in own) == sum(len(library.encode(t, add_special_tokens=False).ids) + 1 for j, t in wanted if j == i), copies[i]


def test_sequences_are_gapless_and_within_capacity(docs):
    by = {}
    for r in pack(docs, PATH, capacity=64).collect():
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64


def test_empty(empty):
    assert pack(empty, PATH).collect() == []


def test_bins_take_a_fixed_number_and_little_is_padded():
    rng = np.random.default_rng(0)
    packer, rows, total = HarmonicPacker(4096, 0), [], 0
    for i in range(4000):
        n = int(rng.lognormal(6.5, 1)) + 1
        total += n
        rows += packer.add(i, np.zeros(n, dtype="<u4"))
    filled = {}
    for r in rows:
        filled.setdefault(r[5], []).append(r[2])
    for lengths in filled.values():
        assert len(lengths) == packer.class_of(max(lengths)) and sum(lengths) <= 4096
    rows += packer.finish()
    size = {}
    for r in rows:
        size[r[5]] = size.get(r[5], 0) + r[2]
    assert sum(size.values()) == total
    assert sum(4096 - s for s in size.values() if s & (s - 1)) < 0.01 * total


def test_classes():
    packer = HarmonicPacker(4096, 0)
    for n in range(1, 4097):
        j = packer.class_of(n)
        assert j * n <= 4096
    assert all(sum(cuts(n, 4096)) == n for n in range(1, 9000, 7)) and inner_classes(4096)[-1] == 4096
    with pytest.raises(ValueError, match="power of two"):
        HarmonicPacker(1000, 0)


def test_ids_of_documents_are_in_the_sequences(docs, library):
    rows = [r for r in pack(docs, PATH).collect() if r.doc_id is not None]
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, {})[r.start, r.length] = np.frombuffer(r.ids, "<u4").tolist()
    once = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count = 1").select("doc_id")
    for r in docs.join(once, "doc_id").collect():
        assert sum((by[r.doc_id][k] for k in sorted(by[r.doc_id])), []) == [*library.encode(r.text or "", add_special_tokens=False).ids, 2]


def test_the_last_stage_keeps_ids(spark, docs):
    import corpus_pipeline

    assert "ids" in corpus_pipeline.pack_documents(spark, docs, "").columns
