from __future__ import annotations

import random

import pytest

#: Columns that clash with names which the operators use inside.
CLASH = "digest string, rep long, `key` string, payload string, component long, row string, spans string, text_ string, node int, label int, size int, piece int, mini long"


@pytest.fixture(scope="session")
def texts() -> list[str | None]:
    """Null, empty, blank, short, repeated, near-equal and very long texts."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 7)))
    base = [word() for _ in range(160)]
    near = [[w if rng.random() > e else word() for w in base] for e in (0.01, 0.02, 0.04, 0.1, 0.3)]
    passage = " ".join(word() for _ in range(70))
    long = " ".join(word() for _ in range(30_000))
    own = [" ".join(word() for _ in range(rng.randint(3, 90))) for _ in range(12)]
    return [
        None, "", " \t\n", "one", "One", "two words", "a  b\tc", "a b c", " a b c ", " ".join(base), "\n".join(base), *(" ".join(n) for n in near), passage, f"before {passage} after",
        f"{own[0]} {passage}", f"{passage} {passage}", long, long + " end", "x" * 200_000, "   odd\x1cspaces \x85", "tab\x0bform\x0c", *own, own[1], own[1], " ".join(base).upper(),
    ]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The texts in shuffled order of ids, one row twice, one without an id, with clashing columns."""
    ids = list(range(len(texts)))
    random.Random(9).shuffle(ids)
    rows = [(i, t) for i, t in zip(ids, texts, strict=True)]
    rows += [rows[9], (None, "without an id"), (None, texts[9])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return frame.selectExpr("doc_id", "text", "'en' AS lang", "'src' AS source", "CAST(length(text) AS long) AS n_chars", *[f"CAST(NULL AS {c.rsplit(' ', 1)[1]}) AS {c.rsplit(' ', 1)[0]}" for c in CLASH.split(", ")])


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def known(docs):
    """doc_id -> text, of the rows with an id."""
    return {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
