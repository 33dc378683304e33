from __future__ import annotations

import base64
import hashlib
from pathlib import Path

import numpy as np
import pytest

from wayline.llm import warc
from wayline.llm.warc import read_warc, warc_round_trip, write_warc

FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
HTML = [
    "<p>a</p>", "<p>a</p>", None, "", f"<pre>{FAKE}</pre>", FAKE * 3, "WARC/1.1\r\n", "WARC/1.1\r\nWARC/1.1\r\n\r\n\r\n", "WWARC/1.1\r\n", "é漢" * 1000, "\r\n\r\n", "x" * 300_000, f"<pre>{FAKE}</pre>", "Content-Length: 7\r\n\r\n", "\x00\x01",
    *(f"a WARC/1.1\r\nContent-Length: {n}\r\n\r\nx" for n in ("9999999999", "2147483648", "9" * 15, "9" * 19, "9" * 40)),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def frame(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}?ü x\r\nWARC-Type: no", h, "p", 1, "s") for i, h in rows], "page_id long, url string, html string, payload string, refers_to long, same string").repartition(3)


def expected(rows, least=0):
    last = {}
    for i, h in rows:
        if i is not None:
            last[h or ""] = max(last.get(h or "", i), i)
    out = []
    for i, h in rows:
        to = last[h or ""] if i is not None and len((h or "").encode()) >= least and last[h or ""] != i else None
        out.append((i, len((h or "").encode()), digest(h), "response" if to is None else "revisit", to))
    return sorted(map(str, out))


@pytest.mark.parametrize("least", [0, 9])
def test_round_trip(spark, least):
    rows = [*enumerate(HTML), (3, ""), (None, "no id"), (None, "<p>a</p>")]
    # One id with two payloads, each of which a later page has too.
    rows += [(100, "first payload"), (100, "second payload"), (101, "first payload"), (102, "second payload"), (102, "third"), (102, "third")]
    got = warc_round_trip(frame(spark, rows), least).collect()
    assert sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got) == expected(rows, least)


def test_many_small_splits_find_the_same_records(spark, tmp_path):
    rows = [(i, HTML[i % len(HTML)] if i % 3 else f"page {i}") for i in range(150)]
    write_warc(frame(spark, rows).coalesce(1), str(tmp_path / "w"), compression="none")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        got = {}
        for size in ("128m", "40k", "7k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got[size] = sorted(str((r.record_id, r.payload_bytes, r.payload_digest, r.record_type)) for r in read_warc(spark, str(tmp_path / "w")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got["128m"] == got["40k"] == got["7k"] and len(got["7k"]) == 150 and not any("666" in r for r in got["7k"])


def test_a_plain_reader_sees_the_same_chain(spark, tmp_path):
    rows = list(enumerate(HTML))
    write_warc(frame(spark, rows), str(tmp_path / "w"), compression="none")
    seen = []
    for file in Path(tmp_path / "w").glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            head, _, _ = data[at:].partition(b"\r\n\r\n")
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1" and all(":" in x for x in lines[1:])
            fields = dict(x.split(": ", 1) for x in lines[1:])
            at += len(head) + 4 + int(fields["Content-Length"])
            assert data[at : at + 4] == b"\r\n\r\n"
            at += 4
            seen.append((fields["WARC-Record-ID"], fields["WARC-Payload-Digest"]))
    assert sorted(seen) == sorted((f"<urn:x-page:{i}>", f"sha1:{digest(h)}") for i, h in rows)


def test_broken_archives(spark, tmp_path):
    folder = tmp_path / "w"
    folder.mkdir()
    good = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:1>\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    (folder / "a.warc").write_bytes(("junk" + good).encode())
    (folder / "b.warc").write_bytes((good + "WARC/1.1\r\nno length\r\n\r\nhi\r\n\r\n" + good).encode())
    (folder / "c.warc").write_bytes(b"")
    assert [r.record_id for r in read_warc(spark, str(folder)).collect()] == ["<urn:x-page:1>"]


def test_empty(spark):
    assert warc_round_trip(frame(spark, [(1, "x")]).limit(0)).collect() == []


def test_pointers_double_to_where_the_chain_leaves():
    at, following = np.array([0, 10, 15, 30, 50]), np.array([10, 30, 22, 70, 60])
    step, leaves = warc._ends(at, following)
    assert step.tolist() == [1, 3, 2, 3, 4] and leaves.tolist() == [70, 70, 22, 70, 60]
