from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from wayline.llm import erasure
from wayline.llm.erasure import Link, erase, file_number, most_referenced, publish, rewrite, rewritten, victims, write_sorted

SCHEMAS = {
    "clients": "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, balance double",
    "clicks": "click_id long, ts timestamp_ntz, client_id long, kind string, value double, _key string, file string, row long",
    "sales": "sale_id long, client_id long, status string, total double",
    "sale_lines": "sale_id long, line_no int, item_id long, amount double, keys string",
}
AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def shop(seed=4):
    """Rows with nulls in every column, repeated rows, keys that hang on nothing, and a client of two masters."""
    rng = random.Random(seed)
    some = lambda x, p=0.06: None if rng.random() < p else x
    time = lambda: some(datetime(2024, 1, 1) + timedelta(seconds=rng.randrange(10**6)))
    money = lambda: some(round(rng.uniform(-50, 500), 2))
    clients = [(some(i), some(rng.randrange(700)), some(rng.choice(["web", "crm", "é"])), time(), some(f"n{i % 7}"), money()) for i in range(420)]
    clients += [(5, 100001, "web", None, None, 1.0), (5, 100002, "web", None, None, float("nan")), *clients[:9], (None, 3, None, None, None, None), (None, None, None, None, None, None)]
    clicks = [(some(i), time(), some(rng.choice([7, rng.randrange(430)])), some("k"), money(), None, some("f"), 1) for i in range(900)]
    sales = [(some(i), some(rng.choice([7, rng.randrange(430)])), some("done"), money()) for i in range(500)]
    lines = [(some(rng.choice([11, rng.randrange(520)])), some(rng.randrange(4)), some(3), money(), None) for _ in range(1100)]
    return {"clients": clients, "clicks": clicks + clicks[:20], "sales": sales + sales[:5] + [(30, 99, "x", 1.0)], "sale_lines": lines + lines[:30]}


def names(table):
    return [c.split()[0] for c in SCHEMAS[table].split(", ")]


def save(spark, rows, folder):
    for name, own in rows.items():
        spark.createDataFrame(own, SCHEMAS[name]).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def crc(value):
    return zlib.crc32(b"" if value is None else str(value).encode())


def expected(rows):
    """The contract by plain loops: (table, file_no) -> (rows that stay, number erased)."""
    owner = {}
    for sale, client, *_ in rows["sales"]:
        if sale is not None and client is not None:
            owner[sale] = min(owner.get(sale, client), client)
    hits = Counter(r[2] for r in rows["clicks"] if r[2] is not None)
    masters = {}
    for client, master, *_ in rows["clients"]:
        if master is not None:
            masters.setdefault(master, set()).add(client)
    gone = {m for m in masters if crc(m) % 200 == 0}
    if masters:
        gone.add(min(masters, key=lambda m: (-sum(hits.get(c, 0) for c in masters[m]), m)))
    clients = {r[0] for r in rows["clients"] if r[1] in gone and r[1] is not None and r[0] is not None}
    sales = {r[0] for r in rows["sales"] if r[1] in clients and r[0] is not None}
    client_of = {"clients": lambda r: r[0], "clicks": lambda r: r[2], "sales": lambda r: r[1], "sale_lines": lambda r: owner.get(r[0])}
    victim = {"clients": lambda r: r[1] in gone, "clicks": lambda r: r[2] in clients, "sales": lambda r: r[1] in clients, "sale_lines": lambda r: r[0] in sales}

    def place(v):
        if v is None:
            return (0,)
        if isinstance(v, float):
            return (1, math.isnan(v), 0 if math.isnan(v) else v)
        return (1, v.encode() if isinstance(v, str) else v)

    out = {}
    for table, own in rows.items():
        ordered = sorted(own, key=lambda r: (crc(client_of[table](r)), [place(v) for v in r]))
        size = 1 + len(own) // 250
        for at in range(0, len(ordered), size):
            part = ordered[at : at + size]
            stay = [r for r in part if not victim[table](r)]
            if stay:
                out[table, at // size] = (stay, len(part) - len(stay))
    return out


def cents(values):
    return sum(math.floor(100 * v + 0.5) for v in values if v is not None and not math.isnan(v))


def told(rows):
    return {
        (table, number): (len(stay), erased, cents([r[names(table).index(AMOUNTS[table])] for r in stay]), erased > 0,
                          hashlib.sha256(",".join("" if r[0] is None else str(r[0]) for r in stay).encode()).hexdigest(), ",".join(names(table)))
        for (table, number), (stay, erased) in expected(rows).items()
    }


def run(spark, folder):
    from wayline.llm.queries import op13_cascading_erasure

    return op13_cascading_erasure(spark, folder).collect()


def files_below(folder):
    return {str(p) for p in Path(folder).rglob("*") if p.is_file() and not p.name.startswith((".", "_"))}


def test_query_is_the_contract(spark, tmp_path):
    rows = shop()
    got = run(spark, save(spark, rows, tmp_path))
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r.columns) for r in got} == told(rows)
    assert len(got) == len({r.path for r in got}) and any(r.rewritten for r in got) and not all(r.rewritten for r in got)
    folder = Path(got[0].path).parent.parent
    assert files_below(folder) == {r.path for r in got}
    wanted = expected(rows)
    for r in got:  # the rows themselves, and what the footer says of them
        file = pq.ParquetFile(r.path)
        stay = wanted[r.table_name, r.file_no][0]
        read = [tuple(x.values()) for x in file.read().to_pylist()]
        assert [tuple(map(str, x)) for x in read] == [tuple(map(str, x)) for x in stay]
        first = [x[0] for x in stay if x[0] is not None]
        said = [file.metadata.row_group(g).column(0).statistics for g in range(file.num_row_groups)]
        assert sum(s.null_count for s in said) == len(stay) - len(first)
        if first:
            assert (min(s.min for s in said if s.has_min_max), max(s.max for s in said if s.has_min_max)) == (min(first), max(first))


def test_empty_tables(spark, tmp_path):
    assert run(spark, save(spark, {name: [] for name in SCHEMAS}, tmp_path / "none")) == []
    rows = {**shop(), "sales": [], "clicks": []}
    got = run(spark, save(spark, rows, tmp_path / "some"))
    assert {(r.table_name, r.file_no): (r.n_rows, r.n_erased, r.cents, r.rewritten, r.ids_sha256, r.columns) for r in got} == told(rows)


def test_only_files_with_victims_change(spark, tmp_path):
    frame = spark.createDataFrame([(i, i % 5) for i in range(100)] + [(None, 1)], "a long, g long")
    kid = spark.createDataFrame([(i, i) for i in range(60)], "b long, a long")
    from pyspark.sql import functions as F

    assert write_sorted(frame, F.col("a"), frame.columns, f"{tmp_path}/t/top", files=10) == 101
    assert write_sorted(kid, F.col("a"), kid.columns, f"{tmp_path}/t/kid", files=6) == 60
    before = {p: Path(p).read_bytes() for p in files_below(tmp_path / "t")}
    paths = {"top": f"{tmp_path}/t/top", "kid": f"{tmp_path}/t/kid"}
    gone = spark.createDataFrame([(i,) for i in [*range(10, 21), 40, 40, None, 7000]], "a long")
    links = [Link("kid", "a", "top", "a"), Link("nowhere", "a", "kid", "a")]
    got = {(r.table_name, r.n): r for r in erase(spark, paths, "top", gone, "a", links).withColumn("n", file_number(F.col("path"))).collect()}
    assert {k: (r.n_rows, r.n_erased, r.rewritten) for k, r in got.items() if r.rewritten} == {
        ("top", 3): (10, 1, True), ("kid", 0): (10, 1, True), ("kid", 1): (1, 10, True), ("kid", 3): (10, 1, True)
    } and len(got) == 9 + 6  # the file of 10 to 20 is gone
    for r in got.values():
        place = re.sub("^file:/+", "/", r.path)
        assert r.rewritten == (place not in before) and (r.rewritten or Path(place).read_bytes() == before[place])
    left = sorted(r.a for r in spark.read.parquet(paths["kid"]).collect())
    assert left == [i for i in range(60) if i not in {*range(10, 21), 40}]
    again = erase(spark, paths, "top", gone, "a", links).collect()
    assert not any(r.rewritten for r in again) and {r.path for r in again} == {r.path for r in got.values()}


def test_emptied_file_goes_and_publishing_twice_does_no_more(spark, tmp_path):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame([(i,) for i in range(20)], "a long")
    write_sorted(frame, F.col("a"), ["a"], f"{tmp_path}/t/top", files=10)
    places = victims(spark, {"top": f"{tmp_path}/t/top"}, "top", spark.createDataFrame([(0,), (1,), (2,), (4,)], "a long"), "a", [])
    written = rewrite(places, f"file://{tmp_path}/staged")
    first, second = publish(written).collect(), publish(written).collect()
    assert sorted(map(str, first)) == sorted(map(str, second)) and sorted(r.n_rows for r in first) == [0, 2]
    assert sorted(r.a for r in spark.read.parquet(f"{tmp_path}/t/top").collect()) == [3, *range(5, 20)]
    assert len(files_below(tmp_path / "t")) == 6


@pytest.mark.parametrize("pieces", [1, 3, 50])
def test_positions_in_pieces(tmp_path, monkeypatch, pieces):
    monkeypatch.setattr(erasure, "BATCH_ROWS", 7)
    monkeypatch.setattr(erasure, "GROUP_BYTES", 200)
    table = pa.table({"x": pa.array(range(100)), "t": pa.array([datetime(2024, 1, 1)] * 100, pa.timestamp("us")), "s": ["é", None] * 50})
    pq.write_table(table, tmp_path / "in.parquet")
    gone = np.array(sorted(random.Random(pieces).sample(range(100), 50)))
    assert rewritten(f"file://{tmp_path}/in.parquet", iter(np.array_split(gone, pieces)), f"file://{tmp_path}/out.parquet") == (50, 50)
    assert pq.read_table(tmp_path / "out.parquet").equals(table.take([i for i in range(100) if i not in set(gone.tolist())]))
    with pytest.raises(ValueError):
        rewritten(f"file://{tmp_path}/in.parquet", iter([np.array([3, 100])]), f"file://{tmp_path}/more.parquet")


def test_most_referenced(spark):
    owners = spark.createDataFrame([(1, 9), (1, 9), (2, 9), (3, 8), (None, 7), (4, None)], "c long, m long")
    rows = lambda cs: spark.createDataFrame([(c,) for c in cs], "c long")
    top = lambda cs: [r.m for r in most_referenced(rows(cs), "c", owners, "m").collect()]
    assert top([1, 3, 3, 4, 4, 4, None]) == [8] and top([1, 2, 3, 3]) == [8] and top([1, 1, 2, 3]) == [9] and top([]) == [7]
    assert most_referenced(rows([1]), "c", owners.where("m > 9"), "m").collect() == []
