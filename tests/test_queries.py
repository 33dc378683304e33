"""Every registered query of the library against its SQL, on the smallest driver tables."""

from __future__ import annotations

import hashlib
import math
import re
from pathlib import Path

import duckdb
import pytest

from wayline.plans import artifacts, depth_report, outcomes, record_checks, registry, reports, rule_cases, run_forms  # noqa: F401  (the modules register their queries)

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for file in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str([plain(x) for x in v]) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, database, name):
    got = registry.QUERIES[name](spark, str(FOLDER))
    want = database.execute(registry.SQL[name])
    columns = sorted(got.columns)
    order = {d[0]: i for i, d in enumerate(want.description)}
    assert columns == sorted(order)
    a = sorted(str([plain(r[c]) for c in columns]) for r in got.collect())
    b = sorted(str([plain(r[order[c]]) for c in columns]) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, str(FOLDER)).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_texts_of_every_language_and_length(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    digest = {i: None if t is None else hashlib.sha256(t.encode()).hexdigest() for i, t in docs.items()}
    got = {r.doc_id: (r.n, r.digest) for r in registry.QUERIES["collapsed_text"](spark, str(FOLDER)).collect()}
    assert got == {i: (None if t is None else len(re.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ")), digest[i]) for i, t in docs.items()}
    for r in registry.QUERIES["tag_values"](spark, str(FOLDER)).collect():
        clean = re.sub(r"[^A-Za-z0-9._-]+", "-", docs[r.doc_id]).strip("-_.")
        assert r.tag == (clean if len(clean) <= 63 else clean[:52].rstrip("-_.") + "-" + digest[r.doc_id][:10])


def test_grid_cells_of_odd_texts_and_ids(spark, tmp_path):
    """Texts that hold the signs, are empty or missing, and ids that are missing or negative, by the query's SQL; its types too."""
    texts = [None, "", "a", "\x01", "\x02", "\x01\x01\x02", "\x02" * 50, "\x01" * 50, "\x01payload\x02" * 5, "ab\x01" * 20, "\f" * 45, "ab\fcd\fef" * 9, "é\U0001f600" * 30, "a\x00b" * 20]
    rows = [(i, t) for i in [None, -45, -3, *range(44), 10**10 + 3] for t in texts]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.SQL["grid_cells"])
    got = registry.QUERIES["grid_cells"](spark, str(tmp_path))
    assert [(d[0], str(d[1])) for d in want.description] == list(zip(got.columns, ["BIGINT", "BIGINT", "BIGINT", "VARCHAR"], strict=True))
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "string"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want.fetchall()))
