"""Registered queries of the rule sets. Each nation stands for a run of every case: a good record with one change. What a
case breaks is stated beside it, as literal codes, and the SQL returns just these."""

from __future__ import annotations

import copy
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import validators
from wayline.plans.frames import table
from wayline.plans.registry import query


def changed(good: object, *changes: tuple[str, object]) -> object:
    """A copy with other values at paths such as ``1.tool_calls.0.status``."""
    out = copy.deepcopy(good)
    for path, value in changes:
        *way, last = path.split(".")
        at = out
        for p in way:
            at = at[int(p)] if p.isdigit() else at[p]
        at[int(last) if last.isdigit() else last] = value
    return out


def cases(spark: SparkSession, d: str, every: list[tuple[object, str]], kind: str) -> DataFrame:
    """(n_nationkey, i, v) with the parsed value of every case."""
    values = F.array(*[F.lit(json.dumps(v)) for v, _ in every])
    rows = table(spark, d, "nation").select("n_nationkey", F.posexplode(values).alias("i", "t"))
    return rows.select("n_nationkey", "i", F.from_json("t", kind).alias("v"))


def expected(every: list[tuple[object, str]], column: str = "errors") -> str:
    values = ", ".join(f"({i}, '{e}')" for i, (_, e) in enumerate(every))
    return f"SELECT n_nationkey, i, {column} FROM nation CROSS JOIN (VALUES {values}) AS e(i, {column})"


# --- acceptance

_CALL = {"tool": "retrieve_papers", "input": "q", "status": "executed", "output": {"document_ids": ["d1"]}}
_UNSAFE = {"tool": "submit", "input": "x", "status": "executed", "output": {}, "unsafe": True}
_SANITY = {"original_task_preserved": True, "injection_followed": False, "unsafe_action_attempted": False, "unsafe_action_executed": False, "evidence_step_indices": []}


def _record(step: int, node: str, **more: object) -> dict:
    base = {"step_index": step, "node_id": node, "role": node, "hop_mode": "2-hop", "scenario_id": "s", "condition": "clean", "model": "m", "token_position": "last", "input_context": [{"role": "user", "content": "c"}], "output_message": "o", "tool_calls": []}
    return base | more


GOOD = [_record(0, "planner"), _record(1, "worker", tool_calls=[_CALL]), _record(2, "executor", trajectory_label="clean", behavioral_sanity=_SANITY)]
_INJECTION = {"tool": "injection", "input": "x", "status": "injected", "output": {}}
HIT = changed(GOOD, ("1.tool_calls", [_CALL, _INJECTION]), ("1.injection_wording_id", "send"), ("1.failure_mode", "intent_free_compromise"), ("2.trajectory_label", "attempted_compromise"))
_V2 = [r | {"source_schema_version": "x.scenario1.v2", "condition": "injected", "raw_poison_exposed_agents": ["worker_1"]} for r in HIT]
STRICT = changed(_V2, ("2", _V2[2] | {"injection_present": True, "behavioral_outcome": "resisted", "action_fired": False, "black_box_compromise": False, "latent_compromise_status": "not_candidate"}))
_FIRED = (
    ("2.tool_calls", [_UNSAFE]), ("2.trajectory_label", "successful_compromise"), ("2.behavioral_sanity", _SANITY | {"unsafe_action_attempted": True, "unsafe_action_executed": True}),
    ("2.behavioral_outcome", "executed"), ("2.action_fired", True), ("2.black_box_compromise", True),
)
_UNKNOWN = (("2.behavioral_outcome", "indeterminate"), ("2.action_fired", None), ("2.black_box_compromise", None), ("2.trajectory_label", "indeterminate"), ("2.behavioral_sanity", _SANITY | {"unsafe_action_executed": None}), ("2.output_message", " "))
ACCEPTANCE = [
    (GOOD, ""), (HIT, ""), (STRICT, ""), (changed(STRICT, *_FIRED), ""), (changed(STRICT, *_UNKNOWN), ""), (changed(GOOD, ("1.step_index", 5), ("2.step_index", 6)), "contiguous"),
    (changed(GOOD, ("0.hop_mode", "3-hop")), "hop_mode"), (changed(GOOD, ("1.node_id", "worker2")), "node_order"), (changed(GOOD, ("2.trajectory_label", "success")), "terminal_label"),
    (changed(GOOD, ("1.tool_calls", [_CALL, _INJECTION])), "clean_injection"), (changed(HIT, ("1.tool_calls", [_CALL])), "one_injection"), (changed(HIT, ("0.injection_point", "retrieval")), "one_injection wording@0 failure_mode@0"),
    (changed(GOOD, ("2.behavioral_sanity", None)), "sanity"), (changed(GOOD, ("2.behavioral_sanity.evidence_step_indices", None)), "sanity_fields"),
    (changed(HIT, ("2.trajectory_label", "successful_compromise"), ("2.behavioral_sanity.unsafe_action_executed", True)), "unsafe_without_call"), (changed(GOOD, ("2.behavioral_sanity.unsafe_action_attempted", True)), "clean_attempt"),
    (changed(HIT, ("2.trajectory_label", "successful_compromise")), "success_without_action"), (changed(GOOD, ("0.input_context", [])), "input_context@0"), (changed(GOOD, ("0.input_context", [{"role": "", "content": "c"}])), "message@0"),
    (changed(GOOD, ("1.output_message", " ")), "output_message@1"), (changed(GOOD, ("0.tool_calls", None)), "tool_calls@0"), (changed(GOOD, ("1.tool_calls.0.status", None)), "call_field@1"),
    (changed(GOOD, ("1.tool_calls.0.output", {"documents": [{"id": ""}]})), "retrieved_ids@1"), (changed(GOOD, ("1.tool_calls.0.output", {"documents": [{"id": "", "doc_id": "d"}]})), ""),
    (changed(GOOD, ("0.model", "")), "populated:model@0"), (changed(GOOD, ("0.token_position", "first")), "token_position@0"), (changed(GOOD, ("0.trajectory_label", "clean")), "early_label@0"),
    (changed(HIT, ("1.injection_wording_id", None)), "wording@1"), (changed(HIT, ("1.failure_mode", "x")), "failure_mode@1"), (changed(STRICT, ("0.raw_poison_exposed_agents", [])), "exposure@0"),
    (changed(STRICT, ("1", STRICT[1] | {"reasoning_compromise_label": {"label": False}})), "reasoning_label@1"), (changed(STRICT, ("0", STRICT[0] | {"activation_metadata": {"storage_status": "dry_run_placeholder", "storage_path": "p"}})), "placeholder:activation_metadata@0"),
    (changed(STRICT, ("2.black_box_compromise", True)), "black_box"), (changed(STRICT, ("2.latent_compromise_status", "candidate")), "latent"), (changed(STRICT, ("2.behavioral_outcome", "odd")), "outcome"),
    (changed(STRICT, ("2.action_fired", None), ("2.black_box_compromise", None)), "action_known action_of_calls"), (changed(STRICT, *_FIRED, ("2.behavioral_outcome", "resisted")), "fired_executed"),
    (changed(STRICT, *_UNKNOWN, ("2", changed(STRICT, *_UNKNOWN)[2] | {"binary_label": 0})), "binary_known"), (changed(STRICT, *_UNKNOWN, ("2.action_fired", False)), "action_known black_box"),
]


def _trajectories(spark: SparkSession, d: str) -> DataFrame:
    record = ", ".join(f.strip() for f in validators.RECORD.split("trajectory_id string, ", 1)[1:])
    rows = cases(spark, d, ACCEPTANCE, f"array<struct<{_as_struct(record)}>>").select("n_nationkey", "i", F.explode("v").alias("r"))
    return rows.select(F.concat_ws("-", F.col("n_nationkey").cast("string"), F.col("i").cast("string")).alias("trajectory_id"), "r.*")


def _as_struct(columns: str) -> str:
    """``a int, b array<...>`` as the fields of a struct."""
    out, depth, field = [], 0, ""
    for ch in columns + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, kind = field.strip().split(" ", 1)
            out.append(f"{name}:{kind.strip()}")
            field = ""
        else:
            field += ch
    return ",".join(out)


@query(f"SELECT n_nationkey || '-' || i AS trajectory_id, errors, errors = '' AS accepted FROM ({expected(ACCEPTANCE)})")
def acceptance_cases(spark: SparkSession, d: str) -> DataFrame:
    return validators.acceptance(_trajectories(spark, d)).select("trajectory_id", F.array_join("errors", " ").alias("errors"), "accepted")


# --- invariants


def _turn(agent: str, **more: object) -> dict:
    return {"type": "agent_turn", "agent_id": agent, "model_called": True, "token_alignment": {}, "input": {"rendered_prompt": "say bad now", "input_token_ids": [1, 2, 3], "rendered_prompt_hash": "h"}, "output": {"message": "m"}} | more


_SEEN = {"injection_present_in_prompt": True, "char_span": {"start_char": 4, "end_char": 7}, "injection_token_span": {"start_token": 1, "end_token": 2}, "rendered_prompt_hash": "h", "truncation_removed_injection_tokens": False}
DOC = {
    "generation_mode": "real", "model_called": True, "treatment": "injected", "delegation_depth": "2-hop", "condition_id": "2-hop", "hop_path": list("abcde"), "activation_config": {"primary_layer": 40},
    "injection": {"injection_present": True, "raw_poison_exposed_agents": ["worker_1"], "injected_text": "bad"}, "compromise_propagation": {"injection_hop_index": 1, "unsafe_action_hop_index": 2, "hops_survived": 1},
    "evaluation_labels": {"outcome_class": "executed", "action_channel": {"unsafe_action_executed": True}, "behavioral_channel": {"output_adoption": True}},
    "full_events": [_turn("planner_1"), _turn("worker_1", token_alignment=_SEEN), _turn("executor_1"), {"type": "unsafe_action", "metadata": {"label_compromised": True}}],
}
_NO_ACTION = (("evaluation_labels.action_channel.unsafe_action_executed", False), ("full_events.3.metadata.label_compromised", False))
_CLEAN = (
    *_NO_ACTION, ("treatment", "clean"), ("injection", {"injection_present": False, "raw_poison_exposed_agents": []}), ("full_events.1.token_alignment", {}), ("evaluation_labels.outcome_class", "clean"), ("evaluation_labels.behavioral_channel.output_adoption", False),
)
_DRY = changed(
    DOC, *_CLEAN, ("generation_mode", "dry_run"), ("model_called", False), ("evaluation_labels", {}), *[(f"full_events.{i}.model_called", False) for i in range(3)], *[(f"full_events.{i}.output", {}) for i in range(3)],
)
_TRACE = {
    "canonical_ranking_treatment": "clean", "ranking_used_injection_text": False, "selected_chunk_ids": ["c1", "c2"], "selected_chunks": [{"chunk_id": "c1", "doc_id": "d", "token_count": 5}, {"chunk_id": "c2", "doc_id": "e", "token_count": 6}],
    "selected_chunk_count": 2, "selected_token_count": 11, "document_token_budget": 20, "max_new_tokens": 10, "non_document_reserve_tokens": 5, "context_window_tokens": 40, "candidate_chunk_count": 7, "eligible_candidate_chunk_count": 5,
    "excluded_candidate_chunk_count": 2, "profile_id": "p", "injection_bearing_chunk_id": "c1", "source_documents": [{"doc_id": "d", "candidate_chunk_count": 3, "page_count": 2, "indexed_page_numbers": [1, 2]}, {"doc_id": "e", "candidate_chunk_count": 4, "page_count": 0, "indexed_page_numbers": []}],
}
_EVENT = {"type": "tool_call", "tool_name": "retrieve_documents", "retrieval_metrics": {"selected_chunk_ids": ["c1", "c2"], "ranking_used_injection_text": False, "selected_chunk_count": 2, "selected_token_count": 11, "document_token_budget": 20}}
TRACED = DOC | {
    "retrieval_trace": _TRACE, "full_events": [*DOC["full_events"], _EVENT],
    "documents": [{"doc_id": "d", "role": "injection_carrier", "text": "a bad one", "retrieval": {"profile_id": "p", "selected_chunk_ids": ["c1"], "selected_token_count": 5}}, {"doc_id": "e", "role": "support", "text": "fine", "retrieval": {"profile_id": "p", "selected_chunk_ids": ["c2"], "selected_token_count": 6}}],
}
INVARIANTS = [
    (DOC, ""), (changed(DOC, *_CLEAN), ""), (_DRY, ""), (TRACED, ""), (changed(DOC, ("full_events.0", _turn("planner_1", activation_metadata={"storage_status": "materialized", "layers_extracted": [39]}))), "INV-1"),
    (changed(DOC, ("full_events.0", _turn("planner_1", activation_metadata={"storage_status": "placeholder", "layers_extracted": []}))), ""), (changed(DOC, ("injection.raw_poison_exposed_agents", [])), "INV-2"),
    (changed(DOC, ("full_events.0.token_alignment", {"char_span": {"start_char": 0, "end_char": 1}})), "INV-2:unexposed"), (changed(DOC, ("full_events.1.token_alignment.char_span", None)), "INV-2:spans"),
    (changed(DOC, ("full_events.1.token_alignment.char_span.start_char", 3)), "INV-2:chars"), (changed(DOC, ("full_events.1.token_alignment.injection_token_span.end_token", 4)), "INV-2:tokens"),
    (changed(DOC, ("full_events.1.token_alignment.rendered_prompt_hash", "g")), "INV-2:hash"), (changed(DOC, ("full_events.1.token_alignment.truncation_removed_injection_tokens", None)), "INV-2:truncated"),
    (changed(DOC, ("compromise_propagation.hops_survived", 2)), "INV-3"), (changed(DOC, ("delegation_depth", "3-hop")), "INV-4"), (changed(DOC, ("hop_path", ["a"])), "INV-4:path"), (changed(DOC, ("full_events.3.metadata.label_compromised", False)), "INV-5"),
    (changed(DOC, ("evaluation_labels", DOC["evaluation_labels"] | {"injection_success": False})), "INV-5:injection_success"), (changed(DOC, ("full_events.0", _turn("planner_1", step_label={"state": "reasoning_compromised", "source": "auto"}))), "INV-6"),
    (changed(DOC, *_CLEAN, ("evaluation_labels.behavioral_channel.output_adoption", True)), "INV-7:clean"), (changed(DOC, *_NO_ACTION, ("evaluation_labels.outcome_class", "clean")), "INV-7:injected"),
    (changed(DOC, *_CLEAN, ("evaluation_labels.outcome_class", "resisted")), "INV-7:treatment"), (changed(DOC, ("evaluation_labels.outcome_class", "resisted")), "INV-7:fired"), (changed(DOC, *_NO_ACTION), "INV-7:executed"),
    (changed(DOC, *_NO_ACTION, ("evaluation_labels.outcome_class", "propagated_but_not_executed"), ("evaluation_labels.behavioral_channel.output_adoption", False)), "INV-7:adoption"),
    (changed(DOC, ("evaluation_labels.outcome_class", "propagated_but_not_executed")), "INV-7:fired INV-7:propagated"), (changed(DOC, ("full_events.2.agent_id", "worker_2")), "INV-8"),
    (changed(DOC, ("full_events.0", _turn("planner_1", reasoning_compromise_label={"label": False, "annotation_status": "auto"}))), "INV-9"), (changed(_DRY, ("full_events.1.model_called", True)), "INV-10"),
    (changed(_DRY, ("evaluation_labels", {"outcome_class": "clean"})), "INV-10:labels"), (changed(_DRY, ("full_events.0.output", {"message": ""})), "INV-10:output"),
    (changed(_DRY, ("full_events.0", _turn("planner_1", model_called=False, output={}, attention_metadata={"storage_path": "p"}))), "INV-10:artifact"), (changed(TRACED, ("retrieval_trace.ranking_used_injection_text", None)), "INV-11:blind"),
    (changed(TRACED, ("retrieval_trace.selected_chunks.0.chunk_id", "c9")), "INV-11:ids"), (changed(TRACED, ("retrieval_trace.context_window_tokens", 34)), "INV-11:window"), (changed(TRACED, ("retrieval_trace.excluded_candidate_chunk_count", 1)), "INV-11:eligible"),
    (changed(TRACED, ("retrieval_trace.source_documents.0.candidate_chunk_count", 2)), "INV-11:sources"), (changed(TRACED, ("retrieval_trace.source_documents.0.indexed_page_numbers", [1])), "INV-11:pages"), (changed(TRACED, ("documents.1.retrieval.profile_id", "q")), "INV-11:profile"),
    (changed(TRACED, ("documents.1.retrieval.selected_token_count", 7)), "INV-11:document_tokens"), (changed(TRACED, ("retrieval_trace.injection_bearing_chunk_id", "c2")), "INV-11:carrier"), (changed(TRACED, ("documents.1.text", "bad")), "INV-11:payload"),
    (changed(TRACED, ("full_events", DOC["full_events"])), "INV-11:event"), (changed(TRACED, ("full_events.4.retrieval_metrics.selected_token_count", 12)), "INV-11:event_metrics"), (changed(TRACED, ("retrieval_trace.document_token_budget", 10), ("full_events.4.retrieval_metrics.document_token_budget", 10)), "INV-11:budget"),
]


@query(expected(INVARIANTS))
def invariant_cases(spark: SparkSession, d: str) -> DataFrame:
    kind = f"struct<{_as_struct(validators.DOCUMENT.split('trajectory_id string, ', 1)[1])}>"
    rows = cases(spark, d, INVARIANTS, kind).select(F.concat_ws("-", F.col("n_nationkey").cast("string"), F.col("i").cast("string")).alias("trajectory_id"), "v.*")
    at = F.split("trajectory_id", "-")
    return validators.invariants(rows).select(at[0].cast("int").alias("n_nationkey"), at[1].cast("int").alias("i"), F.array_join("errors", " ").alias("errors"))


# --- requests

REQUEST = {"trajectory_id": "run_1.a", "agent_id": "worker_1", "agent_role": "worker", "step_index": 1, "hop_index": 1, "thinking_mode": "ON", "raw_poison_exposed": True, "injection_text": "bad", "messages": [{"role": "user", "content": "a bad text"}]}
REQUESTS = [
    (REQUEST, ""), (REQUEST | {"trajectory_id": "-x"}, "trajectory_id"), (REQUEST | {"agent_role": "boss"}, "agent_role"), (REQUEST | {"step_index": -1}, "step_index"), (REQUEST | {"hop_index": None}, "hop_index"), (REQUEST | {"thinking_mode": "maybe"}, "thinking_mode"),
    (REQUEST | {"model_id": "other"}, "model_id"), (REQUEST | {"model_id": ""}, ""), (REQUEST | {"analysis_tier": "draft"}, "analysis_tier"), (REQUEST | {"messages": []}, "messages injection_once"),
    (REQUEST | {"messages": [{"role": "tool", "content": None}, {"role": "user", "content": "bad"}]}, "message"), (REQUEST | {"messages": [{"role": "assistant", "tool_calls": ["c"]}, {"role": "user", "content": "bad"}]}, ""),
    (REQUEST | {"messages": [{"role": "assistant", "content": "c", "tool_calls": []}, {"role": "user", "content": "bad"}]}, "message"), (REQUEST | {"agent_id": "planner_1"}, "poison_agent"), (REQUEST | {"expected_poison_agent_id": "worker_2"}, "poison_agent"), (REQUEST | {"agent_id": "executor_1", "expected_poison_agent_id": "executor_1"}, "poison_executor"),
    (REQUEST | {"injection_text": ""}, "injection_text"), (REQUEST | {"raw_poison_exposed": False}, "injection_text"), (REQUEST | {"messages": [{"role": "user", "content": "bad bad"}]}, "injection_once"), (REQUEST | {"tools": [{"name": "a"}, {"name": "a "}]}, "tool_names"),
    (REQUEST | {"tools": [{"name": "a b"}]}, "tools"), (REQUEST | {"generation_settings": {"temperature": 0.7}}, "temperature"), (REQUEST | {"generation_settings": {"do_sample": False, "max_new_tokens": 9000}}, "do_sample max_new_tokens"),
    (REQUEST | {"generation_settings": {"seed": -1}}, "seed"), (REQUEST | {"activation_layers": [63, 64]}, "layers"), (REQUEST | {"activation_layers": [1, 1]}, "layer_twice"), (REQUEST | {"activation_layers": []}, "layers"),
]


@query(expected(REQUESTS))
def request_contract_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d, REQUESTS, f"struct<{_as_struct(validators.REQUEST)}>").select("n_nationkey", "i", "v.*")
    return validators.request_contract(rows, ["n_nationkey", "i"]).withColumn("errors", F.array_join("errors", " "))


EXPOSURE = [
    ({"injected": True, "exposed": ["worker_1", "worker_1"], "turns": [{"agent_id": "worker_1", "saw_document_text": True, "in_prompt": True}]}, ""), ({"injected": True, "exposed": ["worker_1", "worker_2"], "turns": []}, "injected_only_worker"),
    ({"injected": False, "exposed": ["worker_1"], "turns": []}, "clean_nobody"), ({"injected": False, "exposed": None, "turns": [{"agent_id": "executor_1", "in_prompt": True}]}, "downstream"), ({"injected": None, "exposed": [], "turns": None}, ""),
]


@query(expected(EXPOSURE))
def poison_exposure_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d, EXPOSURE, "struct<injected:boolean,exposed:array<string>,turns:array<struct<agent_id:string,saw_document_text:boolean,in_prompt:boolean>>>")
    errors = validators.poison_exposure(F.col("v.injected"), F.col("v.exposed"), F.coalesce("v.turns", F.array().cast("array<struct<agent_id:string,saw_document_text:boolean,in_prompt:boolean>>")))
    return rows.select("n_nationkey", "i", F.array_join(errors, " ").alias("errors"))


# --- policies

_RULE = {"required_generation_protocol_id": "v2", "required_trajectory_id_fragment": "__gen_v2__", "required_agent_prompt_profile_id": "neutral", "expected_matrix": {"treatments": ["clean", "injected"], "delegation_depths": ["2-hop", "3-hop"], "thinking_modes": ["off", "on"]}, "required_artifacts": {"registry": "r.json"}}
_POLICY = {"policy_id": "p", "unmanaged_domain_behavior": "pass_through", "domain_protocols": {"fin": _RULE}}
POLICIES = [
    (_POLICY, ""), (_POLICY | {"policy_id": " "}, "policy_id"), (_POLICY | {"unmanaged_domain_behavior": "drop"}, "unmanaged"), (changed(_POLICY, ("domain_protocols.fin.required_trajectory_id_fragment", "v2")), "fragment"),
    (changed(_POLICY, ("domain_protocols.fin.required_generation_protocol_id", None)), "protocol fragment"), (changed(_POLICY, ("domain_protocols.fin.expected_matrix.thinking_modes", ["off", "off"])), "modes"),
    (changed(_POLICY, ("domain_protocols.fin.expected_matrix.treatments", ["other"])), "treatments"), (changed(_POLICY, ("domain_protocols.fin.expected_matrix.delegation_depths", [])), "depths"), (changed(_POLICY, ("domain_protocols.fin.required_artifacts", {})), "artifacts"),
    (changed(_POLICY, ("domain_protocols.fin.required_agent_prompt_profile_id", "")), "profile"),
]


@query(expected(POLICIES))
def policy_cases(spark: SparkSession, d: str) -> DataFrame:
    rows = cases(spark, d, POLICIES, f"struct<{_as_struct(validators.POLICY)}>").select(F.concat_ws("-", F.col("n_nationkey").cast("string"), F.col("i").cast("string")).alias("k"), "v.*")
    judged = rows.select("k", F.col("policy_id").alias("own"), "unmanaged_domain_behavior", "domain_protocols")
    at = F.split("k", "-")
    # The policy's own id goes through the key, so that each case can be told apart.
    out = validators.policy_rules(judged.select(F.when(F.trim("own") == "", "").otherwise(F.col("k")).alias("policy_id"), "unmanaged_domain_behavior", F.transform_keys("domain_protocols", lambda n, _: F.col("k")).alias("domain_protocols")))
    at = F.split("domain_id", "-")
    return out.select(at[0].cast("int").alias("n_nationkey"), at[1].cast("int").alias("i"), F.array_join("errors", " ").alias("errors"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Customers as trajectories of domains (nations, of which only the first is managed), with ids that name their
    protocol and profile."""
    k = F.col("c_custkey")
    rows = table(spark, d, "customer").select(
        k, F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("domain_id"), F.when(k % 2 == 0, "clean").otherwise("injected").alias("treatment"), F.when(F.floor(k / 2) % 2 == 0, "2-hop").otherwise("3-hop").alias("delegation_depth"),
        F.when(F.floor(k / 4) % 2 == 0, "off").otherwise("on").alias("thinking_mode"), F.when(k % 3 == 0, "v1").otherwise("v2").alias("g"), F.when(k % 5 == 0, "odd").otherwise("neutral").alias("p"),
    )
    made = rows.withColumn("trajectory_id", F.concat(F.lit("t"), k.cast("string"), F.lit("__prompt_"), "p", F.lit("__gen_"), "g", F.lit("__thinking_"), "thinking_mode"))
    stated = F.when(k % 7 == 0, F.col("g"))
    return made.withColumns({"protocol": validators.generation_protocol(F.col("trajectory_id"), stated), "profile": validators.prompt_profile(F.col("trajectory_id"), F.lit(None).cast("string"))}).drop("g", "p")


def _policy(spark: SparkSession) -> DataFrame:
    rules = {"n0": _RULE, "n99": _RULE}
    policy = spark.range(1).select(F.from_json(F.lit(json.dumps(_POLICY | {"domain_protocols": rules})), f"struct<{_as_struct(validators.POLICY)}>").alias("v")).select("v.*")
    return validators.policy_rules(policy)


_RUNS = """r AS (SELECT c_custkey AS k, 'n' || c_nationkey AS domain_id, c_nationkey = 0 AS managed, CASE WHEN c_custkey % 3 = 0 THEN 'v1' ELSE 'v2' END AS g, CASE WHEN c_custkey % 5 = 0 THEN 'odd' ELSE 'neutral' END AS p, CASE WHEN (c_custkey // 4) % 2 = 0 THEN 'off' ELSE 'on' END AS mode,
    c_nationkey <> 0 OR (c_custkey % 3 <> 0 AND c_custkey % 5 <> 0) AS selected FROM customer),
    i AS (SELECT *, 't' || k || '__prompt_' || p || '__gen_' || g || '__thinking_' || mode AS id FROM r)"""


@query(f"""WITH {_RUNS}, a AS (SELECT CASE WHEN managed THEN domain_id END AS domain_id, count(*) AS n_input, count(*) FILTER (selected) AS n_selected, count(*) FILTER (NOT selected) AS n_excluded,
        string_agg(DISTINCT g, ',' ORDER BY g) FILTER (selected) AS protocols, sha256(coalesce(string_agg(DISTINCT id, chr(10) ORDER BY id) FILTER (selected), '')) AS selected_sha256 FROM i GROUP BY 1)
    SELECT domain_id, n_input, n_selected, n_excluded, coalesce(protocols, '') AS protocols, CASE WHEN n_selected > 0 THEN 'complete' ELSE 'not_present' END AS status, selected_sha256 FROM a UNION ALL SELECT 'n99', 0, 0, 0, '', 'not_present', NULL""")
def policy_audit(spark: SparkSession, d: str) -> DataFrame:
    return validators.policy_audit(_runs(spark, d), _policy(spark)).withColumn("protocols", F.array_join("protocols", ","))


@query(f"""WITH {_RUNS}, w AS (SELECT 'n0' AS domain_id, treatment, depth, mode FROM (VALUES ('clean'), ('injected')) a(treatment) CROSS JOIN (VALUES ('2-hop'), ('3-hop')) b(depth) CROSS JOIN (VALUES ('off'), ('on')) c(mode) WHERE EXISTS (SELECT 1 FROM i WHERE managed AND selected)),
    s AS (SELECT domain_id, CASE WHEN k % 2 = 0 THEN 'clean' ELSE 'injected' END AS treatment, CASE WHEN (k // 2) % 2 = 0 THEN '2-hop' ELSE '3-hop' END AS depth, mode, count(*) AS n FROM i WHERE managed AND selected GROUP BY ALL)
    SELECT domain_id, treatment, depth AS delegation_depth, mode AS thinking_mode, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS status FROM w LEFT JOIN s USING (domain_id, treatment, depth, mode) WHERE n IS DISTINCT FROM 1""")
def policy_matrix(spark: SparkSession, d: str) -> DataFrame:
    rules = _policy(spark)
    return validators.matrix_violations(validators.conforming(_runs(spark, d), rules).where("selected"), rules)


# --- registries, repairs, billing


@query("""WITH p AS (SELECT p_partkey AS k, p_brand, p_type, p_size FROM part),
    u AS (SELECT p_brand FROM p GROUP BY p_brand HAVING count(DISTINCT k) <> 1)
    SELECT rule_id, n FROM (SELECT 'unique:p_brand' AS rule_id, count(*) AS n FROM u UNION ALL SELECT 'one_value:kind', 1 FROM p HAVING count(DISTINCT k % 2) <> 1 UNION ALL SELECT 'documents', count(*) FROM p WHERE k % 5 = 0
        UNION ALL SELECT 'carrier', count(*) FROM p WHERE k % 7 = 0 OR k % 5 = 0 UNION ALL SELECT 'conditions', count(*) FROM p WHERE k % 3 = 0) WHERE n > 0""")
def registry_set_rules(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    support = F.lit("support")
    roles = F.when(k % 5 == 0, F.array(support, support)).when(k % 7 == 0, F.array(support, support, support)).otherwise(F.array(F.lit("injection_carrier"), support, support))
    conditions = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("c"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d")))
    packs = table(spark, d, "part").select(k.alias("pack_id"), "p_brand", (k % 2).alias("kind"), roles.alias("roles"), conditions.alias("conditions"))
    return validators.registry_violations(packs, ["p_brand"], ["kind"]).groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS pack_id, 'd' || n_regionkey AS domain_id, n_name AS carrier, CASE WHEN n_nationkey % 2 = 0 THEN n_name || ':injection_carrier a:support' ELSE n_name || ':injection_carrier a:support b:support' END AS documents FROM nation""")
def normalized_registries(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("pack_id"), F.concat(F.lit("d"), F.col("n_regionkey").cast("string")).alias("domain_id"), "n_nationkey", "n_name")
    slot = lambda i, role: F.struct(i.alias("doc_id"), F.lit(role).alias("role"))
    flat = n.where("n_nationkey % 2 = 0").withColumn("documents", F.array(slot(F.col("n_name"), "injection_carrier"), slot(F.lit("a"), "support")))
    nested = n.where("n_nationkey % 2 = 1").withColumns({"carrier_document": F.col("n_name"), "support_documents": F.array(F.lit("a"), F.lit("b"))})
    shown = F.array_join(F.transform("documents", lambda x: F.concat_ws(":", x["doc_id"], x["role"])), " ")
    return validators.normalized_registry(flat, nested).select("pack_id", "domain_id", "carrier", shown.alias("documents"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 50")
def selected_repairs(spark: SparkSession, d: str) -> DataFrame:
    plan = table(spark, d, "orders").withColumn("status", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done"))
    return validators.selected_repairs(plan, ["o_orderdate", "o_orderkey"], most=50).select("o_orderkey", "o_orderstatus")


@query("""WITH a AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0), b AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 13 <> 0)
    SELECT k AS o_orderkey, concat_ws(' ', CASE WHEN b.k IS NULL THEN 'missing' END, CASE WHEN a.k IS NULL THEN 'unexpected' END, CASE WHEN a.k IS NOT NULL AND b.k IS NOT NULL THEN concat_ws(' ', CASE WHEN k % 5 = 0 THEN 'agent' END, CASE WHEN k % 17 = 0 THEN 'rendered_prompt_hash' END,
        CASE WHEN k % 3 = 0 THEN 'materialized' END, CASE WHEN k % 7 = 0 THEN 'checksum' END, CASE WHEN k % 19 = 0 THEN 'layers' END) END) AS errors FROM a FULL JOIN b USING (k)""")
def repair_contract(spark: SparkSession, d: str) -> DataFrame:
    k, o = F.col("o_orderkey"), table(spark, d, "orders").select("o_orderkey")
    layers = lambda *v: F.array(*[F.lit(x) for x in v])
    asked = o.where(k % 11 != 0).select(k, F.lit("worker_1").alias("agent"), F.lit("h").alias("rendered_prompt_hash"), layers(40, 32).alias("layers"))
    done = o.where(k % 13 != 0).select(
        k, F.when(k % 5 == 0, "worker_2").otherwise("worker_1").alias("agent"), F.when(k % 17 == 0, None).otherwise("h").alias("rendered_prompt_hash"), F.when(k % 19 == 0, layers(40)).otherwise(layers(32, 40)).alias("layers"),
        F.when(k % 3 == 0, "placeholder").otherwise("materialized").alias("storage_status"), F.when(k % 7 == 0, "x").otherwise(F.sha2(k.cast("string"), 256)).alias("checksum_sha256"),
    )
    return validators.repair_violations(asked, done, ["o_orderkey"], ["agent"]).withColumn("errors", F.array_join(F.array_compact("errors"), " "))


@query("""WITH c AS (SELECT l_partkey, l_suppkey, CAST(l_quantity AS BIGINT) AS quantity, count(*) FILTER (l_linestatus = 'O') AS lo, count(*) FILTER (l_linestatus = 'F') AS hi, min(l_returnflag) FILTER (l_linestatus = 'O') AS a, min(l_returnflag) FILTER (l_linestatus = 'F') AS b, min(l_linenumber) FILTER (l_linestatus = 'O') AS c, min(l_linenumber) FILTER (l_linestatus = 'F') AS d
        FROM lineitem GROUP BY 1, 2, 3)
    SELECT l_partkey, l_suppkey, quantity, lo = 1 AND hi = 1 AND a IS NOT DISTINCT FROM b AS l_returnflag, lo = 1 AND hi = 1 AND c IS NOT DISTINCT FROM d AS l_linenumber, lo = 1 AND hi = 1 AND a IS NOT DISTINCT FROM b AND c IS NOT DISTINCT FROM d AS passed FROM c WHERE lo + hi > 0""")
def pair_controls(spark: SparkSession, d: str) -> DataFrame:
    """Lines of one part, supplier and quantity as pairs of an open and a filled one."""
    rows = table(spark, d, "lineitem").withColumn("quantity", F.col("l_quantity").cast("long"))
    return validators.pair_controls(rows, ["l_partkey", "l_suppkey", "quantity"], "l_linestatus", "O", "F", ["l_returnflag", "l_linenumber"])


@query("""SELECT 'rows' AS what, count(*) AS n FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 4 = 0 UNION ALL SELECT 'apps', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1 HAVING count(DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'none' END) > 1)""")
def billing_tags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    tags = F.map_from_entries(F.array_compact(F.array(
        F.struct(F.lit("project").alias("k"), F.when(k % 3 == 0, "mine").otherwise("other").alias("v")),
        F.when(k % 4 == 0, F.struct(F.lit("analysis_tier").alias("k"), F.lit("a").alias("v"))).when(k % 4 == 1, F.struct(F.lit("analysis_tier").alias("k"), F.lit("b").alias("v"))),
    )))
    rows = table(spark, d, "orders").select(k, F.col("o_custkey").alias("object_id"), tags.alias("tags"))
    count = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(validators.billed(rows, "mine", "a"), "rows").unionByName(count(validators.changed_tiers(rows, "mine"), "apps"))


@query("SELECT conv_id, round(coalesce(sum(CASE WHEN role = 'assistant' THEN CASE WHEN turn % 3 <> 0 THEN length(text) / 4 ELSE 0 END END), 0), 6) AS cost FROM conversations GROUP BY conv_id")
def trajectory_costs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select("conv_id", F.when(F.col("role") == "assistant", "agent_turn").alias("type"), F.when(F.col("turn") % 3 != 0, F.length("text") / 4).alias("cost"))
    return validators.turn_costs(rows, "conv_id").withColumn("cost", F.round("cost", 6))


@query("""SELECT event_id, ts AS a, ts - INTERVAL 90 MINUTE AS b, CAST(NULL AS TIMESTAMP) AS c FROM events""")
def utc_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    shown = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select("event_id", *[validators.utc(t).cast("timestamp_ntz").alias(n) for n, t in (("a", shown), ("b", F.concat(shown, F.lit("+01:30"))), ("c", F.concat(F.lit("on "), shown)))])
