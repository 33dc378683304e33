"""Spans of characters and of tokens, by binary search in sorted offsets; contracts of results that tell such spans, and of
evidence that pages and budgets limit. All of it is expressions on one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.text import occurrences, stripped
from wayline.operators.labels import yes

#: Fixed value.
CONVENTION = "start_inclusive_end_exclusive"
_SOURCE = "clean_source_section_type"
_SPAN = "struct<start_char:int,end_char:int>"
_TOKENS = "struct<start_token:int,end_token:int>"
#: What a result tells of the text that was put into its prompt.
ALIGNMENT = f"struct<injection_present_in_prompt:boolean,char_span:{_SPAN},injection_token_span:{_TOKENS},tokenizer_name:string,tokenizer_revision:string,rendered_prompt_hash:string,truncation_removed_injection_tokens:boolean,span_convention:string>"
#: Which pages of a source may be evidence.
ELIGIBILITY = "struct<determined_from:string,all_pages_remain_indexed:boolean,non_evidence_pages:map<string,array<struct<page_number:int,reason:string>>>>"


def count_below(ordered: Column, value: Column) -> Column:
    """How many elements of an ascending array are smaller than a value: a comparison for each bit of its length."""
    start = F.struct(F.lit(0).alias("low"), F.size(ordered).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["low"] + s["high"], 1)
        less = F.get(ordered, middle) < value
        return F.when(s["low"] >= s["high"], s).when(less, F.struct((middle + 1).alias("low"), s["high"].alias("high"))).otherwise(F.struct(s["low"].alias("low"), middle.alias("high")))

    steps = F.ceil(F.log2(F.size(ordered) + 1)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), steps), start, halve, lambda s: s["low"])


def token_range(begins: Column, ends: Column, begin: Column, end: Column) -> Column:
    """(start_token, end_token) of the tokens, whose begins and ends ascend, that overlap the characters from ``begin`` to
    before ``end``; null without any."""
    first, last = count_below(ends, begin + 1), count_below(begins, end)
    return F.when(first < last, F.struct(first.alias("start_token"), last.alias("end_token")))


def char_range(begins: Column, ends: Column, start_token: Column, end_token: Column) -> Column:
    """(start_char, end_char) of tokens; null if there are none of these numbers."""
    inside = (start_token >= 0) & (start_token < end_token) & (end_token <= F.size(begins))
    return F.when(inside, F.struct(F.get(begins, start_token).alias("start_char"), F.get(ends, end_token - 1).alias("end_char")))


def injection_alignment(rendered: Column, injected: Column, begins: Column, ends: Column, name: Column, revision: Column) -> Column:
    """The alignment of a text that occurs once in a prompt, from the prompt's token offsets; without a text one that says so.
    Null where the text does not occur exactly once or no token overlaps it."""
    at = F.position(injected, rendered) - 1
    tokens = token_range(begins, ends, at, at + F.length(injected))
    told = lambda present, chars, spans: F.struct(
        F.lit(present).alias("injection_present_in_prompt"), chars.cast(_SPAN).alias("char_span"), spans.cast(_TOKENS).alias("injection_token_span"), name.alias("tokenizer_name"), revision.alias("tokenizer_revision"),
        F.sha2(rendered, 256).alias("rendered_prompt_hash"), F.lit(False).alias("truncation_removed_injection_tokens"), F.lit(CONVENTION).alias("span_convention"),
    )
    none = F.lit(None)
    chars = F.struct(at.alias("start_char"), (at + F.length(injected)).alias("end_char"))
    found = (occurrences(rendered, injected) == 1) & tokens.isNotNull()
    return F.when(injected.isNull(), told(False, none, none)).when(found, told(True, chars, tokens))


def result_violations(results: DataFrame, key: str, offsets: bool = True) -> DataFrame:
    """(key, errors): what the token alignment of a result breaks. ``results`` has rendered_input, rendered_input_sha256,
    input_token_ids, injection_text, raw_poison_exposed, tokenizer_name, tokenizer_revision and token_alignment as in
    ``ALIGNMENT``; with ``offsets`` also the tokens' ``begins`` and ``ends``, against which the spans are checked:
    ``offset_count`` says that they are not as many as ids, ``token_cover`` that the token span is not that of its
    characters. A result without injected text may lack an alignment."""
    c, a = F.col, F.col("token_alignment")
    chars, tokens, text = a["char_span"], a["injection_token_span"], F.col("injection_text")
    given, there, both = text.isNotNull(), a.isNotNull(), chars.isNotNull() & tokens.isNotNull()
    needed = there & given & both
    good_chars = (chars["start_char"] >= 0) & (chars["start_char"] < chars["end_char"]) & (chars["end_char"] <= F.length("rendered_input")) & (F.substr("rendered_input", chars["start_char"] + 1, chars["end_char"] - chars["start_char"]) == text)
    rules = {
        "alignment": there | ~given, "presence": ~there | a["injection_present_in_prompt"].eqNullSafe(c("raw_poison_exposed")), "tokenizer_name": ~there | a["tokenizer_name"].eqNullSafe(c("tokenizer_name")),
        "tokenizer_revision": ~there | a["tokenizer_revision"].eqNullSafe(c("tokenizer_revision")), "prompt_hash": ~there | a["rendered_prompt_hash"].eqNullSafe(c("rendered_input_sha256")), "input_hash": c("rendered_input_sha256").eqNullSafe(F.sha2("rendered_input", 256)),
        "truncated": ~there | a["truncation_removed_injection_tokens"].eqNullSafe(F.lit(False)), "convention": ~there | a["span_convention"].eqNullSafe(F.lit(CONVENTION)),
        "unexposed_spans": ~there | given | (chars.isNull() & tokens.isNull()), "spans": ~(there & given) | both, "char_span": ~needed | yes(good_chars),
        "token_span": ~needed | yes((tokens["start_token"] >= 0) & (tokens["start_token"] < tokens["end_token"]) & (tokens["end_token"] <= F.size("input_token_ids"))),
    }
    if offsets:
        covered = token_range(c("begins"), c("ends"), chars["start_char"], chars["end_char"])
        same = tokens["start_token"].eqNullSafe(covered["start_token"]) & tokens["end_token"].eqNullSafe(covered["end_token"])
        rules |= {"offset_count": (F.size("begins") == F.size("input_token_ids")) & (F.size("ends") == F.size("input_token_ids")), "token_cover": ~needed | ~yes(good_chars) | same}
    return results.select(key, F.array_compact(F.array(*[F.when(~yes(x), F.lit(n)) for n, x in rules.items()])).alias("errors"))


def pages_of(begins: Column, page_begins: Column) -> Column:
    """The page, from 1, in which each span begins, from the ascending begins of the pages."""
    return F.transform(begins, lambda b: count_below(page_begins, b + 1))


def _total(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.coalesce(F.transform(a, lambda x: F.coalesce(f(x), F.lit(0)).cast("long")), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda x, y: x + y)


def evidence_rules(t: Column, documents: Column) -> dict[str, Column]:
    """Rules on the evidence of a retrieval ``t``: pages that are no evidence are told for known sources, once each and with
    a reason; sources sum up their pages and chunks; no selected chunk lies on such a page; each document keeps its own
    budget, and the budgets together that of all. ``documents`` have ``doc_id``."""
    e, sources, chosen, budgets = t["evidence_eligibility"], t["source_documents"], t["selected_chunks"], t["document_token_budgets"]
    told = F.coalesce(F.map_entries(e["non_evidence_pages"]), F.array().cast("array<struct<key:string,value:array<struct<page_number:int,reason:string>>>>"))
    good = lambda p: p["page_number"].isNotNull() & (F.coalesce(stripped(p["reason"]), F.lit("")) != "")
    clean = lambda v: F.forall(v, lambda p: yes(good(p))) & (F.size(F.array_distinct(F.transform(v, lambda p: p["page_number"]))) == F.size(v))

    def excluded(doc: Column) -> Column:
        own = F.flatten(F.transform(F.filter(told, lambda m: (m["key"] == doc) & m["value"].isNotNull()), lambda m: m["value"]))
        return F.array_sort(F.array_distinct(F.transform(F.filter(own, lambda p: yes(good(p))), lambda p: p["page_number"])))

    def summed_up(s: Column) -> Column:
        pages = F.when(s["page_count"] > 0, F.sequence(F.lit(1), s["page_count"])).otherwise(F.array().cast("array<int>"))
        gone = excluded(s["doc_id"])
        whole = s["non_evidence_page_numbers"].eqNullSafe(gone) & s["evidence_eligible_page_numbers"].eqNullSafe(F.array_except(pages, gone))
        return s["page_count"].isNull() | (whole & yes(s["eligible_candidate_chunk_count"] + s["excluded_candidate_chunk_count"] == s["candidate_chunk_count"]))

    present = e.isNotNull()
    eligible, out = F.coalesce(t["eligible_candidate_chunk_count"], t["candidate_chunk_count"]), F.coalesce(t["excluded_candidate_chunk_count"], F.lit(0))
    ids = F.array_distinct(F.filter(F.transform(documents, lambda d: d["doc_id"]), lambda x: x.isNotNull()))
    values = F.map_values(budgets)
    valid = F.array_sort(F.map_keys(budgets)).eqNullSafe(F.array_sort(ids)) & F.forall(values, lambda v: yes(v >= 1)) & (_total(values, lambda v: v) <= F.coalesce(t["document_token_budget"], F.lit(-1)))
    spent = lambda doc: _total(F.filter(chosen, lambda c: c["doc_id"] == doc), lambda c: c["token_count"])
    kept = F.forall(ids, lambda d: yes(spent(d) <= F.try_element_at(budgets, d)))
    return {
        "evidence_source": ~present | yes((e["determined_from"] == _SOURCE) & e["all_pages_remain_indexed"]), "evidence_pages": F.forall(told, lambda m: m["value"].isNotNull() & yes(clean(m["value"]))),
        "evidence_unknown": F.forall(told, lambda m: m["value"].isNull() | F.coalesce(F.array_contains(F.transform(sources, lambda s: s["doc_id"]), m["key"]), F.lit(False))),
        "evidence_summary": ~present | F.coalesce(F.forall(sources, lambda s: yes(summed_up(s))), F.lit(True)),
        "evidence_counts": ~present | yes((_total(sources, lambda s: s["eligible_candidate_chunk_count"]) == eligible) & (_total(sources, lambda s: s["excluded_candidate_chunk_count"]) == out)),
        "evidence_chunk": F.coalesce(F.forall(chosen, lambda c: ~F.coalesce(F.array_contains(excluded(c["doc_id"]), c["page_number"]), F.lit(False))), F.lit(True)),
        "pdf": ~yes(t["source_pdf_verification_required"]) | t["source_pdf_verification"]["status"].eqNullSafe(F.lit("verified")), "budgets": budgets.isNull() | yes(valid), "budget_each": budgets.isNull() | ~yes(valid) | kept,
    }
