from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm.pieces import CharacterMap, encode_pieces, encoder_of

sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a", " ", "  a  b ", " \n\n x\n", "▁x ▁▁ y", "über   ñandú\t\x00z 漢字 😀  ", "a▁", "Hello <s> <0x41> world", "x" * 500 + " y" * 300, "é" * 130, "á ﬁ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_ids_are_the_library_s(texts, library):
    every = [t or "" for t in texts] + ODD
    flat, sizes = encoder_of(PATH).encode(every)
    for t, ids in zip(every, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert ids.tolist() == library.encode(t, add_bos=True, add_eos=True)


def test_spans_tile_the_source():
    encoder = encoder_of(PATH)
    for t in ODD:
        spans = encoder.spans(t)
        assert spans[0][1] == 0 and spans[-1][2] == len(t.encode()) and all(a[2] == b[1] for a, b in zip(spans, spans[1:], strict=False))
        for i, begin, end in spans:
            piece = encoder.library.id_to_piece(i)
            if not encoder.library.is_byte(i):
                assert piece.replace("▁", " ").encode().lstrip(b" ") == t.encode()[begin:end].replace("▁".encode(), b" ").lstrip(b" ")
    assert encoder.spans("") == [] and encoder.spans(None) == []


def test_query(docs, library):
    for r in encode_pieces(docs, PATH, keep=True).collect():
        text = next(d.text or "" for d in docs.where("doc_id <=> %s" % ("NULL" if r.doc_id is None else r.doc_id)).collect() if len(library.encode(d.text or "")) + 2 == r.n_tokens)
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) == len(r.pieces) + 2 and r.decoded == library.decode(ids)
        if r.doc_id is not None:
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_empty(empty):
    assert encode_pieces(empty, PATH).collect() == []


def _trie(entries):
    """A double array for a few entries, laid out by hand: node by node, each child block at a free multiple of 256."""
    blob, strings = b"", {}
    for out in sorted(set(entries.values())):
        strings[out] = len(blob)
        blob += out + b"\0"
    units, free = {0: 0}, [256]

    def place(prefix, at):
        children = sorted({e[len(prefix)] for e in entries if len(e) > len(prefix) and e.startswith(prefix)})
        base = free[0]
        free[0] += 256
        offset = at ^ base
        units[at] = units.get(at, 0) | (offset << 10)
        if prefix in entries:
            units[at] |= 1 << 8
            units[base] = (1 << 31) | strings[entries[prefix]]
        for c in children:
            units[base ^ c] = c
            place(prefix + bytes([c]), base ^ c)

    place(b"", 0)
    size = max(units) + 256
    raw = b"".join(units.get(i, 0).to_bytes(4, "little") for i in range(size))
    return len(raw).to_bytes(4, "little") + raw + blob


def test_longest_entry_of_a_compiled_map():
    table = CharacterMap(_trie({b"a": b"1", b"abc": b"23", "é".encode(): b"e", b"x": b""}))
    assert table.longest(b"abd", 0) == (b"1", 1) and table.longest(b"zabc", 1) == (b"23", 3)
    assert table.longest("é".encode(), 0) == (b"e", 2) and table.longest(b"x", 0) == (b"", 1) and table.longest(b"b", 0) is None
    assert CharacterMap(b"").longest(b"a", 0) is None


def test_normalising_with_a_map_remembers_the_source():
    encoder = encoder_of.__wrapped__(PATH) if hasattr(encoder_of, "__wrapped__") else type(encoder_of(PATH))(PATH)
    encoder.map, encoder._plain, encoder._squeeze = CharacterMap(_trie({b"ab": b"X Y", "é".encode(): b"e"})), False, True
    out, where = encoder.normalize("  ab  é ")
    assert out.decode() == "▁X▁Y▁e" and where.tolist() == [2, 2, 2, 2, 2, 2, 2, 2, 4, 4, 4, 6, 8]


def test_normalising_without_a_map_is_the_general_way(texts):
    encoder = type(encoder_of(PATH))(PATH)
    every = [t or "" for t in texts if len(t or "") < 20_000] + ODD + ["\ud800 a", "", " "]
    fast = [encoder.normalize(t) for t in every]
    encoder._plain = False
    for t, (data, where) in zip(every, fast, strict=True):
        want = encoder.normalize(t)
        assert data == want[0] and where.tolist() == want[1].tolist()


def test_the_query_aligns_every_document(spark, monkeypatch, tmp_path, docs):
    from wayline.llm import pieces, queries

    kept, encode = [], pieces.encode_pieces

    def spy(*args, **named):
        made = encode(*args, **named)
        kept.append(made)
        return made

    monkeypatch.setattr(pieces, "encode_pieces", spy)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op10_sentencepiece(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"]
    encoder = encoder_of(PATH)
    for r in kept[0].where("doc_id IS NOT NULL").collect():
        text = docs.where(F.col("doc_id") == r.doc_id).first().text
        spans = encoder.spans(text)
        assert [tuple(p) for p in r.pieces] == spans
        assert r.spans_sha256 == hashlib.sha256(np.array([p[1:] for p in spans], dtype="<u4").tobytes()).hexdigest()
