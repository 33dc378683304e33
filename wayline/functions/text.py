"""Text functions as columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def occurrences(text: Column, part: Column) -> Column:
    """How often a part occurs without overlap; 0 for an empty part."""
    n = (F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)
    return F.when(F.length(part) > 0, n).otherwise(F.when(text.isNotNull() & part.isNotNull(), 0)).cast("long")


def render_messages(messages: Column) -> Column:
    """``ROLE: content`` of an array of (role, content), with an empty line between."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.upper(m["role"]), F.lit(": "), m["content"])), "\n\n")


def words(text: Column) -> Column:
    """Runs of a-z of the lower-cased text: letters with accents part words."""
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), F.lit(1))


def lexicon_rates(rows: DataFrame, by: Sequence[str], text: str, lexicon: dict[str, Sequence[str]], per: int = 10_000) -> DataFrame:
    """(by, family, hits, tokens, rate): occurrences of each family's words for ``per`` tokens, rounded to 6 places; the
    rate is null without tokens. Counted inside each row, so that tokens are never shuffled."""
    def hits(terms: Sequence[str]) -> Column:
        return F.size(F.filter("_w", lambda w: w.isin(*terms)))

    own = rows.select(*by, words(F.col(text)).alias("_w"))
    counted = own.select(*by, F.size("_w").alias("_n"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("family"), hits(terms).alias("hits")) for f, terms in lexicon.items()
    ])).alias("_f"))
    total = counted.groupBy(*by, F.col("_f.family").alias("family")).agg(F.sum("_f.hits").alias("hits"), F.sum("_n").alias("tokens"))
    return total.withColumn("rate", F.round(F.try_divide(F.lit(float(per)) * F.col("hits"), F.col("tokens")), 6))


def rate_comparison(rates: DataFrame, key: Sequence[str], side: str, low: str, high: str, value: str = "rate") -> DataFrame:
    """(key, low, high, difference, ratio, higher): the ratio is null where the low rate is 0."""
    wide = rates.groupBy(*key).agg(F.max(F.when(F.col(side) == low, F.col(value))).alias("low"), F.max(F.when(F.col(side) == high, F.col(value))).alias("high"))
    return wide.select(*key, "low", "high", (F.col("high") - F.col("low")).alias("difference"), F.try_divide("high", "low").alias("ratio"), (F.col("high") > F.col("low")).alias("higher"))


def urls(text: Column) -> Column:
    """http and https addresses in a text, without punctuation at their end."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"']+)"), F.lit(1))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", ""))


def host_within(url: Column, domain: str) -> Column:
    host = F.lower(F.parse_url(url, F.lit("HOST")))
    return (host == domain) | F.endswith(host, F.lit("." + domain))


#: What Python's strip removes, as a class of a regular expression.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def stripped(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def split_thinking(text: Column, close: str = "</think>", opening: str = "<think>") -> Column:
    """(thinking, final, complete). With a closing mark, thinking is what stands before the last one, from the first
    opening mark on, and final what follows. With an opening mark only, all that follows the first one is thinking and
    complete is false. Without marks everything is final, and thinking and complete are null."""
    closed, opened = F.contains(text, F.lit(close)), F.contains(text, F.lit(opening))
    final = F.substring_index(text, close, -1)
    head = F.left(text, F.length(text) - F.length(final) - len(close))
    after = lambda c: F.substr(c, F.position(F.lit(opening), c) + len(opening))
    return F.struct(
        F.when(closed, stripped(F.when(F.contains(head, F.lit(opening)), after(head)).otherwise(head))).when(opened, stripped(after(text))).alias("thinking"),
        F.when(closed, stripped(final)).when(opened, F.lit("")).otherwise(stripped(text)).alias("final"),
        F.when(closed, True).when(opened, False).alias("complete"),
    )


def tool_calls(text: Column, tools: Sequence[str] = (), tag: str = "tool_call") -> Column:
    """(calls, errors) of the tagged JSON blocks of a text. A call is (name, arguments as JSON, recognized, status): an
    object with a name that is not blank and an object of arguments; ``recognized`` tells whether the name is one of
    ``tools``. An error is (code, index, raw): of the blocks in their order, after one, without an index, if there are
    more tags of one kind than of the other."""
    blocks = F.regexp_extract_all(text, F.lit(rf"(?s)<{tag}>\s*(.*?)\s*</{tag}>"), F.lit(1))

    def parsed(raw: Column, i: Column) -> Column:
        value = F.try_parse_json(raw)
        kind, name = F.schema_of_variant(value), F.try_variant_get(value, "$.name", "string")
        name_kind, args_kind = (F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant")) for f in ("name", "arguments"))
        good_name = F.coalesce((name_kind == "STRING") & F.rlike(name, F.lit(r"\S")), F.lit(False))
        code = (
            F.when(value.isNull(), "invalid_tool_call_json").when(~F.startswith(kind, F.lit("OBJECT")), "tool_call_must_be_object")
            .when(~good_name, "missing_tool_name").when(~F.coalesce(F.startswith(args_kind, F.lit("OBJECT")), F.lit(False)), "tool_arguments_must_be_object")
        )
        known = F.coalesce(stripped(name).isin(*tools), F.lit(False)) if tools else F.lit(False)
        call = F.struct(stripped(name).alias("name"), F.to_json(F.try_variant_get(value, "$.arguments", "variant")).alias("arguments"), known.alias("recognized"), F.lit("requested").alias("status"))
        return F.struct(call.alias("call"), F.struct(code.alias("code"), i.alias("index"), raw.alias("raw")).alias("error"))

    every = F.transform(blocks, parsed)
    errors = F.transform(F.filter(every, lambda p: p["error"]["code"].isNotNull()), lambda p: p["error"])
    unbalanced = occurrences(text, F.lit(f"<{tag}>")) != occurrences(text, F.lit(f"</{tag}>"))
    tags = F.struct(F.lit("unbalanced_tool_call_tags").alias("code"), F.lit(None).cast("int").alias("index"), F.lit(None).cast("string").alias("raw"))
    return F.struct(
        F.transform(F.filter(every, lambda p: p["error"]["code"].isNull()), lambda p: p["call"]).alias("calls"),
        F.when(unbalanced, F.concat(F.array(tags), errors)).otherwise(errors).alias("errors"),
    )


def option_mentions(text: Column) -> Column:
    """Options named in a text (``option a`` gives A), upper-cased, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\boption\s+([AB12])\b"), F.lit(1)), F.upper)


def id_suffix(text: Column, pattern: str) -> Column:
    """The first group of a pattern, null where it doesn't match."""
    found = F.regexp_extract(text, pattern, 1)
    return F.when(found != "", found)


def hops(mode: Column) -> Column:
    """``3-hop`` as 3; null for other values."""
    return F.try_to_number(id_suffix(mode, r"^(\d+)-hop$"), F.lit("999")).cast("int")


def tag_value(text: Column, limit: int = 63) -> Column:
    """A tag of letters, digits, dots, dashes and underscores, without signs at its ends; a longer one is cut and ends in
    ten digits of the text's digest. A text that leaves nothing is an error."""
    clean = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "-"), r"^[-_.]+|[-_.]+$", "")
    cut = F.concat(F.regexp_replace(F.left(clean, F.lit(limit - 11)), r"[-_.]+$", ""), F.lit("-"), F.left(F.sha2(text, 256), F.lit(10)))
    return F.when(clean == "", F.raise_error(F.lit("the tag is empty")).cast("string")).when(F.length(clean) <= limit, clean).otherwise(cut)


def page_spans(text: Column) -> Column:
    """(page, begin, end) of the pages that form feeds part, in characters, without the form feed."""
    pages = F.split(text, "\f", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page:int,begin:int,end:int>>").alias("out"))
    step = lambda a, p: F.struct(
        (a["at"] + F.length(p) + 1).alias("at"),
        F.concat(a["out"], F.array(F.struct((F.size(a["out"]) + 1).alias("page"), a["at"].alias("begin"), (a["at"] + F.length(p)).alias("end")))).alias("out"),
    )
    return F.aggregate(pages, start, step, lambda a: a["out"])


def page_of(spans: Column, offset: Column) -> Column:
    """The page whose span holds an offset, its end included."""
    return F.try_element_at(F.filter(spans, lambda s: (s["begin"] <= offset) & (offset <= s["end"])), F.lit(1))["page"]


# Fixed values.
NO_TITLE = r"(?i)(arxiv:|corresponding author|open access|micro report|viewpoint|research letter|https?://|@|page \d|vol\.|doi:)"
NO_NAME = "Paper "


def title(text: Column, fallback: Column, lines: int = 3, enough: int = 90, most: int = 180, least: int = 8) -> Column:
    """A title from the first lines that are no page furniture and have ``least`` characters: up to ``lines`` of them or
    until they have ``enough`` characters, white space collapsed, cut at ``most``. A fallback that already is a name, or
    a text without such a line, gives the fallback."""
    every = F.transform(F.split(text, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), stripped)
    kept = F.transform(F.filter(every, lambda x: (F.length(x) >= least) & ~F.rlike(x, F.lit(NO_TITLE))), lambda x: F.regexp_replace(x, f"{SPACE}+", " "))
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("size"))
    add = lambda a, x: F.when(a["size"] >= enough, a).otherwise(F.struct(F.when(a["out"] == "", x).otherwise(F.concat(a["out"], F.lit(" "), x)).alias("out"), (a["size"] + F.length(x)).alias("size")))
    made = F.aggregate(F.slice(kept, 1, lines), start, add, lambda a: F.left(a["out"], F.lit(most)))
    return F.when(~F.contains(fallback, F.lit(NO_NAME)) | (F.size(kept) == 0), fallback).otherwise(made)


def unique_anchor(text: Column, offset: Column, lengths: Sequence[int] = tuple(range(80, 241, 20))) -> Column:
    """The shortest of the given lengths of text before an offset that occurs once in the whole text. At the beginning it
    is what follows, and if none is alone the first 80 characters of a text that is not blank. Null if there is none."""
    start = offset <= 0
    cut = lambda n: F.when(start, F.left(text, n)).otherwise(F.substr(text, F.greatest(offset - n, F.lit(0)) + 1, F.least(n, offset)))
    only = lambda n: once(cut(n), lambda part: F.when((F.length(part) > 0) & (occurrences(text, part) == 1), part))
    alone = F.aggregate(F.array(*[F.lit(n) for n in lengths]), F.lit(None).cast("string"), lambda found, n: F.when(found.isNotNull(), found).otherwise(only(n)))
    return F.coalesce(alone, F.when(start & (stripped(text) != ""), F.left(text, F.lit(80))))


def token_span(offsets: Column, begin: Column, end: Column) -> Column:
    """(first, last, contiguous) of the tokens, given as (begin, end) in order, that overlap a span; null without any."""
    hit = F.filter(F.transform(offsets, lambda o, i: F.struct(i.alias("i"), o["begin"].alias("b"), o["end"].alias("e"))), lambda t: (t["e"] > begin) & (t["b"] < end))
    at = F.transform(hit, lambda t: t["i"])
    return F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("first"), F.array_max(at).alias("last"), (F.array_max(at) - F.array_min(at) + 1 == F.size(at)).alias("contiguous")))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that is computed once. A lambda evaluates an outer expression for every element and
    every mention of it, and projections that read a struct's fields copy what is below them; a variable is neither."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def common_prefix(a: Column, b: Column) -> Column:
    """The length of the longest common beginning, by halving: a comparison of two slices for each bit of the length."""

    def found(p: Column) -> Column:
        start = F.struct(F.lit(0).alias("low"), F.least(F.length(p["a"]), F.length(p["b"])).alias("high"))

        def halve(s: Column, _: Column) -> Column:
            middle = F.shiftright(s["low"] + s["high"] + 1, 1)
            same = F.left(p["a"], middle) == F.left(p["b"], middle)
            narrowed = F.when(same, F.struct(middle.alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), (middle - 1).alias("high")))
            return F.when(s["low"] >= s["high"], s).otherwise(narrowed)

        return F.aggregate(F.sequence(F.lit(1), F.lit(31)), start, halve, lambda s: s["low"])

    return once(F.struct(a.alias("a"), b.alias("b")), found)


def single_insertion(clean: Column, changed: Column) -> Column:
    """(position, inserted, single): where one text was put into another, the common beginning, what follows it in the
    longer text, and whether that insertion alone makes one of the other. Nulls give nulls."""

    def found(p: Column) -> Column:
        a, b, at = p["t"]["a"], p["t"]["b"], p["at"]
        size = F.length(b) - F.length(a)
        known = a.isNotNull() & b.isNotNull()
        single = (size > 0) & (F.substr(a, at + 1) == F.substr(b, at + size + 1))
        return F.struct(
            F.when(known, at).alias("position"), F.when(known, F.when(size > 0, F.substr(b, at + 1, size)).otherwise("")).alias("inserted"), F.when(known, single).alias("single"),
        )

    texts = F.struct(clean.alias("a"), changed.alias("b"))
    return once(texts, lambda t: once(F.struct(t.alias("t"), common_prefix(t["a"], t["b"]).alias("at")), found))


def insertion_span(clean: Column, changed: Column, wording: Column) -> Column:
    """(begin, end) of an insertion by the difference of the texts, else by the only occurrence of its wording."""
    found = single_insertion(clean, changed)
    by_difference = F.when(found["single"], F.struct(found["position"].alias("begin"), (found["position"] + F.length(found["inserted"])).alias("end")))
    at = F.position(wording, changed) - 1
    return F.coalesce(by_difference, F.when(occurrences(changed, wording) == 1, F.struct(at.alias("begin"), (at + F.length(wording)).alias("end"))))


def spliced(text: Column, offset: Column, payload: Column) -> Column:
    return F.concat(F.left(text, offset), payload, F.substr(text, offset + 1))


def checkpoint_positions(tokens: Column, special: Sequence[int], close: int) -> Column:
    """(before_close, last): the last position without a special token before the last closing mark, and in all tokens;
    null where there is none (without a closing mark, before_close is)."""
    placed = F.transform(tokens, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    plain = F.filter(placed, lambda p: ~p["t"].isin(*special, close))
    closed = F.array_max(F.transform(F.filter(placed, lambda p: p["t"] == close), lambda p: p["i"]))
    before = F.filter(plain, lambda p: p["i"] < closed)
    return F.struct(F.array_max(F.transform(before, lambda p: p["i"])).alias("before_close"), F.array_max(F.transform(plain, lambda p: p["i"])).alias("last"))


def checkpoint_scopes(names: Column, prompt: Sequence[str]) -> Column:
    """A map from checkpoint name to ``prompt`` or ``generation``."""
    return F.map_from_arrays(names, F.transform(names, lambda n: F.when(n.isin(*prompt), "prompt").otherwise("generation")))
