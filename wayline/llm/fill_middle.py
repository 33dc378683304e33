"""Fill-in-the-middle: a text is cut into prefix, middle and suffix, and the middle is moved to the end.

The work is one Arrow-batched pandas UDF: the ``regex`` library's ``finditer`` runs over a text once and leaves the end
offset of every unit in a compact array, two look-ups in it give the cuts, and ``hashlib`` gives the seeds that decide
about a document and the digests of what comes out. A second UDF rebuilds the text from the output and its form alone.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.shared import prepare

#: A code point, line feeds included.
CODE_POINT = r"(?s)."
#: The signs in front of prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
_MADE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def unit_ends(unit: regex.Pattern, text: str) -> array:
    """The offsets, in code points, at which the units of a text end. What stands between two units goes with the later."""
    return array("I", map(regex.Match.end, unit.finditer(text, concurrent=False)))


def seeds(seed: int, key: str) -> tuple[int, int, int, int]:
    """The first four 8-digit groups of the SHA-256 of ``seed:key``, as numbers."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[at : at + 4], "big") for at in (0, 4, 8, 12))


def cut_at(ends: Sequence[int], one: int, other: int) -> tuple[int, int]:
    """Where the prefix and the middle end: after the smaller and the larger of two numbers of units, each taken
    modulo the number of units and one."""
    first, last = sorted((one % (len(ends) + 1), other % (len(ends) + 1)))
    return (ends[first - 1] if first else 0), (ends[last - 1] if last else 0)


def rebuilt(output: str, form: str, markers: tuple[str, str, str] = MARKERS) -> str:
    """The text that ``output`` was made of. In a text that was cut no marker stood, so each is where it was put."""
    p, s, m = markers
    if form == "plain":
        return output
    order = (p, s, m) if form == "psm" else (s, p, m)
    ats = [output.index(x) for x in order]
    parts = dict(zip(order, (output[at + len(x) : end] for at, x, end in zip(ats, order, [*ats[1:], len(output)], strict=True)), strict=True))
    return parts[p] + parts[m] + parts[s]


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode(errors="replace")).hexdigest()


def _checked(markers: tuple[str, str, str]) -> None:
    """A marker must not arise where one meets the text: none may hold the first character of one but in front."""
    if len({*markers}) != 3 or any(not x or any(y[0] in x[1:] for y in markers) for x in markers):
        raise ValueError("markers must be three different strings, whose first characters occur in none of them further on")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: int = 1, percent: int = 90, spm_percent: int = 20, markers: tuple[str, str, str] = MARKERS
) -> DataFrame:
    """One row for each document: doc_id, n (units), form, prefix_chars, middle_chars (null for plain), output,
    output_sha256.

    A document is cut when its third seed modulo 100 is below ``percent`` and its text is neither empty nor holds a
    marker; it then becomes ``spm`` (suffix first) when its fourth seed modulo 100 is below ``spm_percent``, else
    ``psm``. All others are ``plain``: the text as it is. A null text counts as empty, a null id as the empty string.
    What a document becomes depends on its id and text alone: repeated rows give equal rows, the order and the number
    of tasks change nothing. An empty table gives no rows; other columns are ignored.
    """
    _checked(markers)
    prepare(docs.sparkSession)

    @F.pandas_udf(_MADE)
    def made(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern, (p, s, m) = regex.compile(unit), markers
        rows = []
        for key, text in zip(keys, texts, strict=True):
            ends = unit_ends(pattern, text)
            h1, h2, h3, h4 = seeds(seed, key)
            if not text or h3 % 100 >= percent or any(x in text for x in markers):
                rows.append((len(ends), "plain", None, None, text, _hex(text)))
                continue
            first, last = cut_at(ends, h1, h2)
            prefix, middle, suffix = text[:first], text[first:last], text[last:]
            spm = h4 % 100 < spm_percent
            output = f"{s}{suffix}{p}{prefix}{m}{middle}" if spm else f"{p}{prefix}{s}{suffix}{m}{middle}"
            rows.append((len(ends), "spm" if spm else "psm", first, last - first, output, _hex(output)))
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _MADE.split(", ")])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), made(key, F.coalesce(F.col(text_col), F.lit(""))).alias("made"))
    return rows.select("doc_id", "made.*")


def restored(output: Column | str, form: Column | str, markers: tuple[str, str, str] = MARKERS) -> Column:
    """A structure of the text rebuilt from an output and its form, and the text's SHA-256 in hexadecimal."""
    _checked(markers)

    @F.pandas_udf("text string, text_sha256 string")
    def back(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [rebuilt(o, f, markers) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": texts, "text_sha256": [_hex(t) for t in texts]})

    return back(output, form)
