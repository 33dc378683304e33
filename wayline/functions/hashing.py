"""Digests of texts, id sets, integer lists, rows and tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, FloatType, IntegralType, MapType, StringType, StructType


def text_sha256(text: Column) -> Column:
    """Hex digest; null for null."""
    return F.sha2(text, 256)


def token_ids_sha256(ids: Column) -> Column:
    """Digest of an integer list as compact JSON."""
    return F.sha2(F.to_json(ids), 256)


def id_set_sha256(ids: Column) -> Column:
    """As an aggregate: the digest of the sorted distinct ids, one to a line."""
    return F.sha2(F.array_join(F.array_sort(F.collect_set(ids)), "\n"), 256)


def _escaped(text: Column) -> Column:
    """A JSON string of ASCII characters: others as ``\\uXXXX``, beyond the basic plane as a pair of these."""
    unit = lambda n: F.concat(F.lit("\\u"), F.lower(F.lpad(F.hex(n), 4, "0")))

    def sign(ch: Column) -> Column:
        n = F.ascii(ch)
        short = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}
        out = F.when(n > 0xFFFF, F.concat(unit(F.shiftright(n - 0x10000, 10) + 0xD800), unit((n - 0x10000).bitwiseAND(0x3FF) + 0xDC00)))
        for ch_, told in short.items():
            out = out.when(ch == F.lit(ch_), F.lit(told))
        return out.when((n < 0x20) | (n > 0x7E), unit(n)).otherwise(ch)

    plain = ~F.rlike(text, F.lit(r'[^\x20-\x7E]|["\\]'))
    signs = F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), sign), "")
    return F.concat(F.lit('"'), F.when(plain, text).otherwise(signs), F.lit('"'))


def _number(x: Column) -> Column:
    """The shortest decimal that reads back as the same double, with a point or an exponent as Python writes it. NaN and
    infinities are an error."""
    told = x.cast("string")
    sign = F.when(F.startswith(told, F.lit("-")), F.lit("-")).otherwise(F.lit(""))
    body = F.regexp_replace(told, "^-", "")
    mantissa, power = F.substring_index(body, "E", 1), F.when(F.contains(body, F.lit("E")), F.substring_index(body, "E", -1).cast("int")).otherwise(0)
    whole, part = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    raw = F.concat(whole, part)
    lead = F.regexp_replace(raw, "^0+", "")
    # The value is 0.DIGITS * 10 ** at.
    at = F.length(whole) + power - (F.length(raw) - F.length(lead))
    digits = F.regexp_replace(lead, "0+$", "")
    digits = _shortest(F.abs(x), digits, at)
    digits, at = digits["d"], digits["at"]
    n = F.length(digits)
    exponent = at - 1
    power_text = F.concat(F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    science = F.concat(F.left(digits, F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(F.lit("")), F.lit("e"), power_text)
    plain = (
        F.when(at <= 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits)).when(at >= n, F.concat(digits, F.repeat(F.lit("0"), at - n), F.lit(".0")))
        .otherwise(F.concat(F.left(digits, at), F.lit("."), F.substr(digits, at + 1)))
    )
    value = F.when(x == 0, F.lit("0.0")).when((exponent < -4) | (exponent >= 16), science).otherwise(plain)
    finite = F.abs(x) < F.lit(float("inf"))
    return F.when(finite, F.concat(sign, value)).otherwise(F.raise_error(F.lit("a number that is not finite")).cast("string"))


def _shortest(x: Column, digits: Column, at: Column) -> Column:
    """(d, at): the fewest of these significant digits, rounded, that still read back as ``x``; Java writes up to two too many for
    some doubles."""
    wide = digits.cast("decimal(20,0)")

    def cut(k: Column) -> Column:
        unit = F.element_at(F.array(*[F.lit(10**i).cast("decimal(20,0)") for i in range(3)]), k + 1)
        kept = F.floor((wide + unit / 2) / unit).cast("decimal(20,0)").cast("string")
        longer = F.length(kept) > F.length(digits) - k
        return F.struct(F.regexp_replace(kept, "0+$", "").alias("d"), (at + F.when(longer, 1).otherwise(0)).cast("int").alias("at"))

    reads = lambda c: F.concat(F.lit("0."), c["d"], F.lit("E"), c["at"].cast("string")).cast("double") == x
    tried = F.filter(F.transform(F.array(F.lit(2), F.lit(1)), cut), reads)
    return F.coalesce(F.get(tried, F.lit(0)), F.struct(digits.alias("d"), at.cast("int").alias("at")))


def canonical_json(value: Column, kind: DataType) -> Column:
    """A value as compact JSON that does not depend on the engine: names sorted at every depth, nulls written out, ASCII
    only, doubles in their shortest form. Numbers are integers, booleans or doubles; map keys are strings."""
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(json.dumps(f.name) + ":"), canonical_json(value[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        out = F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}"))
    elif isinstance(kind, ArrayType):
        out = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: canonical_json(x, kind.elementType)), ","), F.lit("]"))
    elif isinstance(kind, MapType):
        pair = lambda e: F.concat(_escaped(e["key"]), F.lit(":"), canonical_json(e["value"], kind.valueType))
        out = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(value), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)), pair), ","), F.lit("}"))
    elif isinstance(kind, StringType):
        out = _escaped(value)
    elif isinstance(kind, (DoubleType, FloatType)):
        out = _number(value.cast("double"))
    elif isinstance(kind, (BooleanType, IntegralType)):
        out = value.cast("string")
    else:
        raise TypeError(f"{kind.simpleString()} has no canonical form")
    return F.when(value.isNull(), F.lit("null")).otherwise(out)


def canonical_row(rows: DataFrame, columns: Sequence[str]) -> Column:
    """A row's columns as canonical JSON."""
    kinds = {f.name: f for f in rows.schema.fields}
    return canonical_json(F.struct(*[F.col(f"`{c}`") for c in columns]), StructType([kinds[c] for c in columns]))


#: What lanes are added up modulo.
_LANE = 1 << 64


def table_sha256(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(by, n, table_sha256): a digest of a table as a multiset of rows. The SHA-256 of each row's canonical JSON is taken
    as four numbers of 64 bits, which are added up modulo 2 ** 64; the digest is that of the number of rows and the four
    sums. Partial sums are all that a task keeps. It tells tables apart that differ by chance, not ones made to collide."""
    h = rows.select(*by, F.sha2(canonical_row(rows, columns), 256).alias("_h"))
    lanes = [F.conv(F.substring("_h", 16 * i + 1, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = h.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(x).alias(f"_{i}") for i, x in enumerate(lanes)])
    told = F.concat_ws(":", F.col("n").cast("string"), *[(F.col(f"_{i}") % F.lit(Decimal(_LANE))).cast("decimal(20,0)").cast("string") for i in range(4)])
    return sums.select(*by, "n", F.sha2(told, 256).alias("table_sha256"))
