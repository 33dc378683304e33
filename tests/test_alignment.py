from __future__ import annotations

import bisect
import json
import random

from pyspark.sql import functions as F

from wayline.operators import alignment, validators
from wayline.plans import rule_cases
from wayline.plans.rule_cases import TRACED, changed


def test_binary_search(spark):
    rng = random.Random(1)
    rows = [(sorted(rng.randrange(20) for _ in range(rng.randrange(12))), rng.randrange(-2, 23)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a array<int>, x int").select("a", "x", alignment.count_below(F.col("a"), F.col("x")).alias("n")).collect()
    assert all(r.n == bisect.bisect_left(r.a, r.x) for r in got)


def test_tokens_and_characters(spark):
    rng, rows = random.Random(2), []
    for _ in range(150):
        at, begins, ends = 0, [], []
        for _ in range(rng.randrange(9)):
            at += rng.randrange(3)
            begins.append(at)
            at += rng.randrange(4)  # tokens may be empty, and stand apart
            ends.append(at)
        b = rng.randrange(14)
        rows.append((begins, ends, b, b + rng.randrange(1, 6)))
    frame = spark.createDataFrame(rows, "b array<int>, e array<int>, x int, y int").withColumn("t", alignment.token_range(F.col("b"), F.col("e"), F.col("x"), F.col("y")))
    frame = frame.withColumn("c", alignment.char_range(F.col("b"), F.col("e"), F.col("t.start_token"), F.col("t.end_token")))
    for r in frame.collect():
        hit = [i for i, (b, e) in enumerate(zip(r.b, r.e, strict=True)) if e > r.x and b < r.y]
        assert (r.t and tuple(r.t)) == ((hit[0], hit[-1] + 1) if hit else None)
        assert (r.c and tuple(r.c)) == ((r.b[hit[0]], r.e[hit[-1]]) if hit else None)


GOOD = {"injection_present_in_prompt": True, "char_span": {"start_char": 4, "end_char": 7}, "injection_token_span": {"start_token": 1, "end_token": 2}, "tokenizer_name": "n", "tokenizer_revision": "r", "truncation_removed_injection_tokens": False, "span_convention": alignment.CONVENTION}


CHANGES = [
    ((), ""), (("injection_present_in_prompt", False), "presence"), (("tokenizer_name", None), "tokenizer_name"), (("tokenizer_revision", "q"), "tokenizer_revision"), (("truncation_removed_injection_tokens", None), "truncated"), (("span_convention", "closed"), "convention"),
    (("char_span", None), "spans"), (("injection_token_span", None), "spans"), (("char_span.start_char", 3), "char_span"), (("char_span.end_char", None), "char_span"), (("char_span.end_char", 99), "char_span"), (("injection_token_span.end_token", 1), "token_span token_cover"),
    (("injection_token_span.end_token", 9), "token_span token_cover"), (("injection_token_span.start_token", -1), "token_span token_cover"), (("injection_token_span.start_token", 0), "token_cover"), (("rendered_prompt_hash", "x"), "prompt_hash"),
]


def test_one_changed_field_breaks_its_rule(spark):
    text = "say bad now"
    told = [(i, json.dumps(changed(GOOD, change) if change else GOOD)) for i, (change, _) in enumerate(CHANGES)]
    row = spark.createDataFrame(told, "k int, told string").select(
        "k", F.lit(text).alias("rendered_input"), F.sha2(F.lit(text), 256).alias("rendered_input_sha256"), F.array(F.lit(1), F.lit(2), F.lit(3)).alias("input_token_ids"), F.lit("bad").alias("injection_text"), F.lit(True).alias("raw_poison_exposed"),
        F.lit("n").alias("tokenizer_name"), F.lit("r").alias("tokenizer_revision"), F.array(F.lit(0), F.lit(4), F.lit(8)).alias("begins"), F.array(F.lit(3), F.lit(7), F.lit(11)).alias("ends"), F.from_json("told", alignment.ALIGNMENT).alias("token_alignment"),
    ).withColumn("token_alignment", F.col("token_alignment").withField("rendered_prompt_hash", F.coalesce(F.col("token_alignment.rendered_prompt_hash"), F.col("rendered_input_sha256"))))
    got = {r.k: " ".join(r.errors) for r in alignment.result_violations(row, "k").collect()}
    assert got == {i: code for i, (_, code) in enumerate(CHANGES)}


def test_results_without_injected_text(spark):
    rows = [("none", None, False, None), ("spans", None, False, changed(GOOD, ("injection_present_in_prompt", False))), ("lacking", "bad", True, None)]
    frame = spark.createDataFrame([(k, x, e, json.dumps(a) if a else None) for k, x, e, a in rows], "k string, injection_text string, raw_poison_exposed boolean, a string").select(
        "*", F.lit("say bad now").alias("rendered_input"), F.sha2(F.lit("say bad now"), 256).alias("rendered_input_sha256"), F.array(F.lit(1)).alias("input_token_ids"), F.lit("n").alias("tokenizer_name"), F.lit("r").alias("tokenizer_revision"))
    frame = frame.withColumn("token_alignment", F.from_json("a", alignment.ALIGNMENT))
    frame = frame.withColumn("token_alignment", F.when(F.col("a").isNotNull(), F.col("token_alignment").withField("rendered_prompt_hash", F.col("rendered_input_sha256"))))
    assert {r.k: r.errors for r in alignment.result_violations(frame, "k", offsets=False).collect()} == {"none": [], "spans": ["unexposed_spans"], "lacking": ["alignment"]}


# --- evidence

_E = {"determined_from": "clean_source_section_type", "all_pages_remain_indexed": True, "non_evidence_pages": {"d": [{"page_number": 2, "reason": "references"}]}}
_S = {"non_evidence_page_numbers": [2], "evidence_eligible_page_numbers": [1], "eligible_candidate_chunk_count": 2, "excluded_candidate_chunk_count": 1}
_T = {"non_evidence_page_numbers": [], "evidence_eligible_page_numbers": [], "eligible_candidate_chunk_count": 3, "excluded_candidate_chunk_count": 1}
EVIDENCE = changed(
    TRACED, ("retrieval_trace.evidence_eligibility", _E), ("retrieval_trace.source_documents.0", TRACED["retrieval_trace"]["source_documents"][0] | _S), ("retrieval_trace.source_documents.1", TRACED["retrieval_trace"]["source_documents"][1] | _T),
    ("retrieval_trace.document_token_budgets", {"d": 5, "e": 6}), ("retrieval_trace.selected_chunks.0.doc_id", "d"), ("retrieval_trace.selected_chunks.1.doc_id", "e"), ("retrieval_trace.selected_chunks.0.page_number", 1), ("retrieval_trace.selected_chunks.1.page_number", 1),
)
R = "retrieval_trace."


EVIDENCE_CHANGES = [
    ([], ""), ([(R + "evidence_eligibility.determined_from", "text")], "evidence_source"), ([(R + "evidence_eligibility.all_pages_remain_indexed", None)], "evidence_source"), ([(R + "evidence_eligibility.non_evidence_pages.d.0.reason", " ")], "evidence_pages evidence_summary"),
    ([(R + "evidence_eligibility.non_evidence_pages.d", [{"page_number": 2, "reason": "a"}, {"page_number": 2, "reason": "b"}])], "evidence_pages"), ([(R + "evidence_eligibility.non_evidence_pages.x", [])], "evidence_unknown"),
    ([(R + "source_documents.0.non_evidence_page_numbers", [])], "evidence_summary"), ([(R + "source_documents.0.evidence_eligible_page_numbers", [1, 2])], "evidence_summary"), ([(R + "source_documents.1.excluded_candidate_chunk_count", None)], "evidence_summary evidence_counts"),
    ([(R + "selected_chunks.0.page_number", 2)], "evidence_chunk"), ([(R + "source_pdf_verification_required", True)], "pdf"), ([(R + "source_pdf_verification_required", True), (R + "source_pdf_verification", {"status": "verified"})], ""),
    ([(R + "document_token_budgets", {"d": 5})], "budgets"), ([(R + "document_token_budgets", {"d": 0, "e": 6})], "budgets"), ([(R + "document_token_budgets", {"d": 15, "e": 6})], "budgets"), ([(R + "document_token_budgets", {"d": 4, "e": 7})], "budget_each"), ([(R + "evidence_eligibility", None)], ""),
]


def test_one_change_of_the_evidence(spark):
    rows = [(str(i), json.dumps(changed(EVIDENCE, *change))) for i, (change, _) in enumerate(EVIDENCE_CHANGES)]
    parsed = spark.createDataFrame(rows, "i string, t string").select("i", F.from_json("t", f"struct<{rule_cases._as_struct(validators.DOCUMENT)}>").alias("v")).select(F.col("v").withField("trajectory_id", F.col("i")).alias("v")).select("v.*")
    got = {r.trajectory_id: " ".join(e.removeprefix("INV-11:") for e in r.errors) for r in validators.invariants(parsed).collect()}
    assert got == {str(i): code for i, (_, code) in enumerate(EVIDENCE_CHANGES)}
