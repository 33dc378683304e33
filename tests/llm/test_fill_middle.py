from __future__ import annotations

import hashlib

import pytest
import regex

from wayline.llm.fill_middle import CODE_POINT, cut_at, fill_in_middle, rebuilt, restored, seeds, unit_ends


def plain_version(key, text):
    """The contract, word by word."""
    n, digest = len(text), hashlib.sha256(f"1:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    if text == "" or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def test_rows(docs):
    rows = docs.collect()
    wanted = sorted((r.doc_id is not None, r.doc_id or 0, *map(str, plain_version("" if r.doc_id is None else r.doc_id, r.text or ""))) for r in rows)
    made = fill_in_middle(docs)
    got = made.withColumn("back", restored("output", "form")).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, *map(str, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output))) for r in got) == wanted
    texts = {}
    for r in rows:
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    for r in got:
        assert r.back.text in texts[r.doc_id] and r.back.text_sha256 == hashlib.sha256(r.back.text.encode()).hexdigest()
        assert r.output_sha256 == hashlib.sha256(r.output.encode()).hexdigest()
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_markers_and_broken_markers_in_texts(spark):
    texts = ["a <P> b", "<S>", "x<M>", "<<<P", "<P", "S>", ">>", "<", "a<b>c" * 9, "\n\r\n", "😀é́漢" * 3]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 20)], "doc_id long, text string")
    for r in fill_in_middle(frame).withColumn("back", restored("output", "form").text).collect():
        text = texts[r.doc_id % len(texts)]
        assert r.back == text and (r.form == "plain" or not any(m in text for m in ("<P>", "<S>", "<M>")))


def test_units_of_other_kinds(spark):
    words = regex.compile(r"\S+")
    assert list(unit_ends(words, " ab  c d ")) == [2 + 1, 6, 8] and list(unit_ends(regex.compile(CODE_POINT), "a\n😀")) == [1, 2, 3]
    assert cut_at([3, 6, 8], 9, 4) == (0, 3) and cut_at([], 5, 7) == (0, 0)
    frame = spark.createDataFrame([(i, "one two  three ") for i in range(60)], "doc_id long, text string")
    for r in fill_in_middle(frame, unit=r"\S+", percent=100, spm_percent=50).withColumn("back", restored("output", "form").text).collect():
        assert r.n == 3 and r.back == "one two  three " and r.prefix_chars in (0, 3, 7, 14) and r.prefix_chars + r.middle_chars in (0, 3, 7, 14)


def test_parameters():
    assert seeds(1, "5") == tuple(int(hashlib.sha256(b"1:5").hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4))
    assert rebuilt("|s2|p1|m3", "spm", ("|p", "|s", "|m")) == "132"
    with pytest.raises(ValueError):
        fill_in_middle(None, markers=("<P>", "<P>", "<M>"))
    with pytest.raises(ValueError):
        fill_in_middle(None, markers=("<P>", "P<", "<M>"))


def test_empty(empty):
    assert fill_in_middle(empty).collect() == []
