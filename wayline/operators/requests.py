"""Requests for model turns built of recorded inputs, and the checks before and after: the files of a logger and the index
that scoring reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators import contracts

# Fixed values.
PLANNER, WORKER, SECOND, EXECUTOR = "planner_1", "worker_1", "worker_2", "executor_1"
PLANNER_LATER, UPSTREAM_LATER = "<planner-output-provided-at-runtime>", "<upstream-output-provided-at-runtime>"
LOGGED = (
    "trajectory_id", "step_index", "node_id", "role", "model", "timestamp_start", "timestamp_end", "input_context", "output_message", "inter_agent_msgs", "tool_calls", "call_graph_edges", "injection_point",
    "token_position", "hop_mode", "trust_mode", "status",
)
INDEXED = (
    "trajectory_id", "thinking_mode", "matched_pair_id", "match_group_id", "delegation_depth", "treatment", "agent_id", "agent_role", "checkpoint", "rendered_prompt_hash", "input_token_count", "input_token_ids_sha256",
    "generated_token_count", "generated_token_ids_sha256", "checkpoint_forward_scope", "local_path",
)


def user_content(agent: Column, task: Column, documents: Column, upstream: Column) -> Column:
    """What an agent is told: the planner the task, the first worker also the planner's message and the documents
    (doc_id, text), the others the task and the message before them. What is not known yet is named in its place."""
    shown = F.array_join(F.transform(F.coalesce(documents, F.array().cast("array<struct<doc_id:string,text:string>>")), lambda d: F.concat(F.lit("DOCUMENT "), d["doc_id"], F.lit(":\n"), d["text"])), "\n\n")
    said = F.nullif(upstream, F.lit(""))
    worker = F.concat(F.lit("Original task:\n"), task, F.lit("\n\nPlanner message:\n"), F.coalesce(said, F.lit(PLANNER_LATER)), F.lit("\n\nRetrieved documents:\n"), shown)
    rest = F.concat(F.lit("Original task:\n"), task, F.lit("\n\nUpstream agent message:\n"), F.coalesce(said, F.lit(UPSTREAM_LATER)))
    return F.when(agent == PLANNER, task).when(agent == WORKER, worker).otherwise(rest)


def request_plan(events: DataFrame, modes: Sequence[str] = ("on", "off"), tool: str = "submit_external") -> DataFrame:
    """A request for each agent event and thinking mode: request fields, ``messages`` (system, user), ``tools`` (the executor's
    only), ``raw_poison_exposed`` and ``injection_text`` (the first worker's of an injected run only). ``events`` has
    trajectory_id, step_index, agent_id, agent_role, hop_index, system_prompt, user_message, retrieved (doc_id, text),
    upstream_message, injection_present and injected_text."""
    c = F.col
    poisoned = F.coalesce(c("injection_present"), F.lit(False)) & (c("agent_id") == WORKER)
    content = user_content(c("agent_id"), c("user_message"), c("retrieved"), c("upstream_message"))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return events.withColumn("thinking_mode", F.explode(F.array(*[F.lit(m) for m in modes]))).select(
        "trajectory_id", "step_index", "agent_id", F.when(c("agent_id") == SECOND, "worker2").otherwise(c("agent_role")).alias("agent_role"), "hop_index", "thinking_mode",
        F.array(message("system", c("system_prompt")), message("user", content)).alias("messages"), F.when(c("agent_id") == EXECUTOR, F.array(F.lit(tool))).otherwise(F.array().cast("array<string>")).alias("tools"),
        poisoned.alias("raw_poison_exposed"), F.when(poisoned, c("injected_text")).alias("injection_text"),
    )


def logger_violations(lines: DataFrame, file: str, line: str, text: str, required: Sequence[str] = LOGGED) -> DataFrame:
    """(file, line, missing, step, readable) of the lines of a logger's files, numbered from 0, that are wrong: fields that
    a record lacks (a null is there), a step that is not the line's number (``step`` is what stands there), or no JSON
    object."""
    held = F.json_object_keys(text)
    there = held.isNotNull()
    missing = F.array_sort(F.array_except(F.array(*[F.lit(f) for f in required]), F.coalesce(held, F.array().cast("array<string>"))))
    step = F.expr(f"try_cast(get_json_object(`{text}`, '$.step_index') AS bigint)")
    judged = lines.select(file, line, F.when(there, missing).otherwise(F.array().cast("array<string>")).alias("missing"), step.alias("step"), there.alias("readable"))
    return judged.where(~F.col("readable") | (F.size("missing") > 0) | ~F.col("step").eqNullSafe(F.col(line).cast("long")))


def index_violations(rows: DataFrame, designs: DataFrame, key: Sequence[str], label: str, group: str = "match_group_id", required: Sequence[str] = INDEXED) -> DataFrame:
    """What keeps an activation index from being scored: more than one tier, groups without a design, labels that are not
    binary, unknown modes, depths or treatments, and required fields that are empty."""
    present = [f for f in required if f in rows.columns]
    absent = [f for f in required if f not in rows.columns]
    known = designs.select(F.col(group).alias("_g"), F.lit(True).alias("_known")).distinct()
    grouped = rows.select(group).distinct().join(known, F.col(group).eqNullSafe(F.col("_g")), "left")
    lists = {label: (0, 1), "thinking_mode": ("off", "on"), "delegation_depth": ("2-hop", "3-hop"), "treatment": ("clean", "injected")}
    out = contracts.violations(
        contracts.one_value(rows.withColumn("analysis_tier", F.coalesce("analysis_tier", F.lit("unclassified"))), "analysis_tier"), contracts.holds(grouped, [group], "design", F.col("_known")),
        *[contracts.holds(rows, key, f"allowed:{f}", F.coalesce(F.col(f).isin(*values), F.lit(False)), F.col(f)) for f, values in lists.items()], contracts.required(rows, key, present),
    )
    return out if not absent else out.unionByName(rows.sparkSession.createDataFrame([("column", f, None) for f in absent], out.schema))
