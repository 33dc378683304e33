from __future__ import annotations

import json

from wayline.operators import requests

EVENT = "trajectory_id string, step_index int, agent_id string, agent_role string, hop_index int, system_prompt string, user_message string, retrieved array<struct<doc_id:string,text:string>>, upstream_message string, injection_present boolean, injected_text string"


def test_requests_of_each_agent(spark):
    docs = [("a", "one"), ("b", "two")]
    rows = [(t, i, a, r, i, "sys", "task", docs if a == "worker_1" else None, u, p, "bad") for t, p, u in (("x", True, "said"), ("y", None, "")) for i, (a, r) in enumerate((("planner_1", "planner"), ("worker_1", "worker"), ("worker_2", "worker"), ("executor_1", "executor")))]
    got = {(r.trajectory_id, r.agent_id, r.thinking_mode): r for r in requests.request_plan(spark.createDataFrame(rows, EVENT)).collect()}
    assert len(got) == 16
    user = lambda *k: got[k].messages[1].content
    assert user("x", "planner_1", "on") == "task" and got["x", "planner_1", "on"].messages[0].content == "sys"
    assert user("x", "worker_1", "off") == "Original task:\ntask\n\nPlanner message:\nsaid\n\nRetrieved documents:\nDOCUMENT a:\none\n\nDOCUMENT b:\ntwo"
    assert user("y", "worker_1", "off").split("\n")[4] == "<planner-output-provided-at-runtime>"
    assert user("x", "worker_2", "on") == user("x", "executor_1", "on") == "Original task:\ntask\n\nUpstream agent message:\nsaid"
    assert user("y", "executor_1", "on").endswith("<upstream-output-provided-at-runtime>") and got["x", "worker_2", "on"].agent_role == "worker2"
    assert {k: (r.raw_poison_exposed, r.injection_text, r.tools) for k, r in got.items() if r.raw_poison_exposed or r.tools} == {
        **{("x", "worker_1", m): (True, "bad", []) for m in ("on", "off")}, **{(t, "executor_1", m): (False, None, ["submit_external"]) for t in "xy" for m in ("on", "off")}
    }


def test_files_of_a_logger(spark):
    good = {f: None for f in requests.LOGGED}
    lines = [good | {"step_index": 0}, good | {"step_index": 2}, {k: v for k, v in good.items() if k not in ("role", "model")} | {"step_index": 2}, good | {"step_index": "3"}, good, "not json", [1]]
    texts = [x if isinstance(x, str) else json.dumps(x) for x in lines]
    frame = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "file string, line int, text string")
    got = {r.line: (r.missing, r.step, r.readable) for r in requests.logger_violations(frame, "file", "line", "text").collect()}
    assert got == {1: ([], 2, True), 2: (["model", "role"], 2, True), 4: ([], None, True), 5: ([], None, False), 6: ([], None, False)}


def test_an_index_that_cannot_be_scored(spark):
    base = {f: "x" for f in requests.INDEXED} | {"thinking_mode": "off", "delegation_depth": "2-hop", "treatment": "clean", "match_group_id": "g", "y": 1, "analysis_tier": "a", "k": 0}
    rows = [base, base | {"k": 1, "y": None}, base | {"k": 2, "thinking_mode": "maybe"}, base | {"k": 3, "delegation_depth": None}, base | {"k": 4, "treatment": "other"}, base | {"k": 5, "match_group_id": "h"}, base | {"k": 6, "local_path": None}, base | {"k": 7, "analysis_tier": None}]
    names = list(base)
    frame = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {'int' if n in ('k', 'y') else 'string'}" for n in names))
    designs = spark.createDataFrame([("g",)], "match_group_id string")
    got = sorted((r.rule_id, r.key) for r in requests.index_violations(frame, designs, ["k"], "y").collect())
    assert got == [("allowed:delegation_depth", "3"), ("allowed:thinking_mode", "2"), ("allowed:treatment", "4"), ("allowed:y", "1"), ("design", "h"), ("one_value:analysis_tier", ""), ("required", "3"), ("required", "6")]
    fine = frame.where("k = 0")
    assert requests.index_violations(fine, designs, ["k"], "y").count() == 0
    assert [(r.rule_id, r.key) for r in requests.index_violations(fine.drop("checkpoint"), designs, ["k"], "y").collect()] == [("column", "checkpoint")]
