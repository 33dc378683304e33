from __future__ import annotations

from pyspark.sql import functions as F

from wayline.operators import controls, records


def test_filters_take_none_as_a_wildcard(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("b", None)], "x string, y int")
    assert records.where_equal(rows, x=None, y=None).count() == 3 and records.where_equal(rows, x="b", y=1).count() == 1


def test_predicates_on_calls(spark):
    kind = "array<struct<executed:boolean,status:string,tool:string,unsafe:boolean,safety_label:string>>"
    calls = [(1, None), (2, []), (3, [(True, None, None, None, "unsafe")]), (4, [(False, "SUCCEEDED", "injection", True, None), (None, "seen", None, None, None)]), (5, [(None, "injected", "rm", None, "safe")])]
    rows = spark.createDataFrame(calls, f"k int, c {kind}")
    got = {r.k: r for r in rows.select("k", records.is_injection(F.when(F.col("k") == 2, "retrieval").otherwise(""), F.col("c")).alias("i"), F.size(records.executed_calls(F.col("c"))).alias("n"), F.size(records.unsafe_calls(F.col("c"))).alias("u"), F.size(records.unsafe_calls(F.col("c"), "SUCCEEDED")).alias("s")).collect()}
    assert {k: r.i for k, r in got.items()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    assert [(got[k].n, got[k].u, got[k].s) for k in (2, 3, 4, 5)] == [(0, 0, 0), (1, 1, 0), (1, 1, 1), (0, 0, 0)]


def test_unfinished_generation(spark):
    kind = "struct<truncated:boolean,finish_reason:string,status:string>"
    rows = [(None, None, None), (True, "stop", None), (False, "Content_Filter", None), (None, "cancelled", None), (None, "stop", "INCOMPLETE"), (None, "incomplete", "length")]
    got = spark.createDataFrame([(r,) for r in rows], f"o {kind}").select(records.incomplete(F.col("o")).alias("i")).collect()
    assert [r.i for r in got] == [False, True, True, True, True, False]


def test_compromised_steps(spark):
    rows = spark.createDataFrame([("compromised_context", None), ("propagated", None), ("propagated", True), (None, False)], "l string, x boolean")
    assert [r.c for r in rows.select(records.is_compromised(F.col("l"), F.col("x")).alias("c")).collect()] == [True, False, True, False]


def test_known_values_skip_empty_ones(spark):
    r = spark.range(1).select(records.first_known(F.lit(None), F.lit(""), F.lit("x")).alias("a"), records.has_all(F.lit(None).cast("array<string>"), ["p"]).alias("b"), records.has_all(F.array(F.lit("p"), F.lit("q")), ["p"]).alias("c")).first()
    assert (r.a, r.b, r.c) == ("x", False, True)


def test_catalog_finds_dependencies_that_do_not_hold(spark):
    rows = spark.createDataFrame([("f", 1, "b"), ("f", 1, "a"), ("g", 1, "a"), ("g", 2, "a"), ("h", None, "a"), ("h", None, "c")], "path string, sum int, label string")
    got = {r.path: (r.n, r.labels, r.consistent) for r in records.catalog(rows, ["path"], ["sum"], ["label"]).collect()}
    assert got == {"f": (2, "a;b", True), "g": (2, "a", False), "h": (2, "a;c", True)}


def test_lookups_report_several_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    assert {r.k: (r.n, r.v) for r in records.exactly_one(rows, ["k"], ["v"]).collect()} == {1: (1, "a"), 2: (2, None)}


def test_missing_nodes_have_nulls(spark):
    events = spark.createDataFrame([("t", "plan", 2, "x"), ("t", "plan", 1, "y")], "k string, kind string, step int, out string")
    got = [(r.node, r.place, r.out) for r in records.normalized_steps(events, "k", "kind", ["step"], {"plan": "planner", "act": "executor"}, ["step", "out"]).orderBy("place").collect()]
    assert got == [("planner", 0, "y"), ("executor", 1, None)]


def test_shared_items_and_acceptance(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2)], "o string, i int")
    assert [r.i for r in records.shared_items(rows, "o", "i").collect()] == [2]
    got = {r.o: r.errors for r in records.acceptance(rows, "o", {"two": F.count("*") == 2, "unknown": F.max(F.lit(None).cast("boolean"))}).collect()}
    assert got == {"a": ["unknown"], "b": ["two", "unknown"]}


def test_controls(spark):
    rows = spark.createDataFrame([(1, 0.1, 1.0), (1, 0.3, 0.5), (2, None, 0.0)], "g int, relative double, cosine double")
    p = {r.g: r for r in controls.profile(rows, ["g"]).collect()}
    assert round(p[1].median_relative, 9) == 0.2 and p[2].mean_relative is None
    s = {r.g: r.passed for r in controls.strict(rows, ["g"], {"near": F.col("relative") < 1}).collect()}
    assert s == {1: True, 2: False}
    m = spark.createDataFrame([("a", "x", 0.8), ("a", "w", 0.8), ("b", "x", 0.1), ("c", "x", None)], "g string, i string, auroc double")
    assert {r.g: (r.strongest, r.verdict) for r in controls.negative_control(m, ["g"], "i").collect()} == {"a": ("w", "FAIL"), "b": ("x", "PASS"), "c": (None, "NOT AVAILABLE")}


def test_checkpoint_positions(spark):
    from wayline.functions import text

    rows = spark.createDataFrame([([1, 5, 9, 7, 6, 2],), ([5, 6],), ([2, 9],), ([],)], "t array<int>")
    got = [tuple(r.p) for r in rows.select(text.checkpoint_positions(F.col("t"), [1, 2], 9).alias("p")).collect()]
    assert got == [(1, 4), (None, 1), (None, None), (None, None)]
    assert spark.range(1).select(text.checkpoint_scopes(F.array(F.lit("a"), F.lit("b")), ["a"]).alias("m")).first().m == {"a": "prompt", "b": "generation"}


def test_review_forms(spark):
    from wayline.operators import review

    expected = spark.createDataFrame([("p",), ("q",), ("r",)], "pair string")
    forms = spark.createDataFrame([("p", 1, "ann", "yes"), ("p", 2, "bob", "no"), ("q", 1, "ann", "maybe"), ("q", 2, "ann", None), ("z", 1, "ann", "yes")], "pair string, slot int, reviewer string, verdict string")
    found = {(r.rule_id, r.key) for r in review.form_violations(forms, expected, ["pair"], "slot", "reviewer", {"verdict": ["yes", "no"]}).collect()}
    assert found == {
        ("coverage", "r|1"), ("coverage", "r|2"), ("coverage", "z|1"), ("required", "q|2"), ("allowed:verdict", "q|1"), ("distinct_reviewers", "q"), ("distinct_reviewers", "z"),
    }


def test_a_second_worker_takes_the_place_before_the_executor(spark):
    rows = spark.createDataFrame([(k, hop, "task", n, i, f"{n} said", "clean") for k, hop in (("a", "2-hop"), ("b", "3-hop"), ("c", None)) for i, n in enumerate(("planner", "worker", "executor"))], "k string, hop_mode string, user_task string, node string, place int, output_message string, step_label string")
    got = sorted((r.k, r.place, r.node, r.output_message, r.step_label, [m.content for m in r.input_context]) for r in records.with_second_worker(rows).collect())
    assert [g[:3] for g in got if g[0] == "b"] == [("b", 0, "planner"), ("b", 1, "worker"), ("b", 2, "worker2"), ("b", 3, "executor")]
    assert [g for g in got if g[2] == "worker2"] == [("b", 2, "worker2", records.FORWARDED, "indeterminate", ["task", "worker said"])]
    assert [g[:3] for g in got if g[0] in "ac"] == [(k, i, n) for k in "ac" for i, n in enumerate(("planner", "worker", "executor"))]
