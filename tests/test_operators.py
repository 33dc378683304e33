"""Operators on small rows with known numbers, degenerate inputs and brute-force versions."""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.functions import hashing, text, vectors
from wayline.operators import contracts, labels, ledger, metrics, nulls, pairs, probes, resample, review, sequence, splits


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


# --- metrics


def brute_auroc(score, label):
    p = [s for s, y in zip(score, label, strict=True) if y == 1]
    n = [s for s, y in zip(score, label, strict=True) if y == 0]
    return sum((a > b) + 0.5 * (a == b) for a in p for b in n) / (len(p) * len(n))


def test_auroc_with_ties_nulls_and_strata(spark):
    rng = np.random.default_rng(0)
    rows = [(g, round(float(s), 1), None if u < 0.1 else int(y)) for g in "ab" for s, y, u in zip(rng.random(200), rng.integers(0, 2, 200), rng.random(200), strict=True)]
    rows += [("single", 0.5, 1), ("unknown", 0.5, None)]
    got = {r.g: r for r in metrics.auroc(spark.createDataFrame(rows, "g string, score double, label int"), ["g"]).collect()}
    for g in "ab":
        own = [(s, y) for h, s, y in rows if h == g and y is not None]
        assert got[g].auroc == pytest.approx(brute_auroc(*zip(*own, strict=True)))
    assert got["single"].auroc is None and "unknown" not in got


def test_auroc_over_many_blocks(spark):
    rng = np.random.default_rng(3)
    rows = [(g, float(s), int(y)) for g in "ab" for s, y in zip(np.concatenate([rng.random(300), 1 / (1 + np.exp(-rng.normal(0, 30, 300))), [0.0, 1.0, 0.5, 0.5, -1.0, 2.0]]), rng.integers(0, 2, 606), strict=True)]
    got = {r.g: r.auroc for r in metrics.auroc(spark.createDataFrame(rows, "g string, score double, label int"), ["g"]).collect()}
    assert all(got[g] == pytest.approx(brute_auroc(*zip(*[(s, y) for h, s, y in rows if h == g], strict=True)), abs=1e-12) for g in "ab")


def test_result_does_not_depend_on_the_order_of_rows(spark):
    rows = spark.createDataFrame([(i % 3, (i * 37 % 100) / 100, i * 7 % 2) for i in range(300)], "g int, score double, label int")
    a, b = (sorted(map(tuple, metrics.snapshot(rows.repartition(n), ["g"]).collect())) for n in (1, 7))
    assert a == b


@pytest.mark.parametrize("spaced", [True, False])
def test_edges_of_bins(spark, spaced):
    scores = [i / 10 for i in range(11)] + [0.30000000000000004, 0.05, 0.999]
    got = [r.b for r in spark.createDataFrame([(s,) for s in scores], "s double").select(metrics.bin_of(F.col("s"), 10, spaced).alias("b")).collect()]
    limits = np.linspace(0, 1, 11)[1:-1] if spaced else [i / 10 for i in range(1, 10)]
    assert got == [sum(s >= e for e in limits) for s in scores]


def test_calibration_of_known_rows(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.9, 1), (0.9, 1), (0.5, None)], "score double, label int")
    r = metrics.calibration(rows, []).first()
    assert (r.n, round(r.ece, 9), round(r.mce, 9)) == (4, 0.25, 0.4)
    assert metrics.calibration(rows.where("label IS NULL").withColumn("g", F.lit(1)), ["g"]).collect() == []


def test_folds_pooled_and_apart(spark):
    rows = spark.createDataFrame([("a", 0.1, 0), ("a", 0.9, 1), ("b", 0.8, 0), ("b", 0.7, 1), ("c", 0.5, 1)], "f string, score double, label int").withColumn("g", F.lit(1))
    r = metrics.fold_summary(rows, ["g"], "f").first()
    assert (r.n, r.n_folds, r.mean_auroc, r.sd_auroc, r.min_auroc, r.max_auroc) == (5, 2, 0.5, 0.5, 0.0, 1.0) and r.pooled_auroc == pytest.approx(4 / 6)


def test_deltas_need_both_sides_and_pass_nulls(spark):
    m = spark.createDataFrame([("a", "lo", 0.5), ("a", "hi", 0.75), ("b", "lo", 0.5), ("c", "lo", None), ("c", "hi", 1.0)], "k string, d string, v double")
    got = {r.k: r.v_delta for r in metrics.deltas(m, ["k"], "d", "lo", "hi", ["v"]).collect()}
    assert got == {"a": 0.25, "c": None}


def test_best_takes_the_lowest_of_ties_and_no_nan(spark):
    rows = spark.createDataFrame([(1, 3, 0.9), (1, 2, 0.9), (1, 1, float("nan")), (2, 1, None), (2, 2, 0.1)], "g int, layer int, v double")
    assert {r.g: r.layer for r in metrics.best(rows, ["g"], "v", "layer").collect()} == {1: 2, 2: 2}


def test_error_bars(spark):
    rows = spark.createDataFrame([(0.5, 0.4, 0.7), (0.5, 0.6, 0.4), (0.5, None, 0.7)], "v double, lo double, hi double")
    got = [(round(r.bar_low, 9), round(r.bar_high, 9)) for r in metrics.error_bars(rows, "v", "lo", "hi").collect()]
    assert got == [(0.1, 0.2), (0.0, 0.0), (0.0, 0.0)]


# --- ordered steps


def test_divergence_around_an_anchor(spark):
    rows = [("t", i, s, 2) for i, s in enumerate([0.1, 0.3, 0.6, 0.2, 0.7])] + [("u", 0, 0.5, 0), ("v", 0, 0.5, None)]
    got = {r.k: r for r in sequence.temporal_divergence(spark.createDataFrame(rows, "k string, step int, score double, anchor int"), ["k"], "step", "score", "anchor", 0.0).collect()}
    t = got["t"]
    assert (t.n_pre, t.n_post, round(t.pre_mean, 9), round(t.post_mean, 9), round(t.divergence, 9), round(t.peak_shift, 9)) == (2, 3, 0.2, 0.5, 0.3, 0.5)
    assert t.persistence == pytest.approx(2 / 3)  # 0.2 is not above the mean of 0.2
    assert got["u"].pre_mean is None and got["u"].persistence is None and "v" not in got


def test_contiguity(spark):
    rows = [("ok", 0), ("ok", 1), ("gap", 0), ("gap", 2), ("twice", 0), ("twice", 0), ("late", 1), ("null", None)]
    assert {r.k for r in sequence.contiguity_violations(spark.createDataFrame(rows, "k string, s int"), "k", "s").collect()} == {"gap", "twice", "late", "null"}


def test_summary_takes_first_and_last_known_values(spark):
    rows = spark.createDataFrame([("t", 0, None, None), ("t", 1, "a", "x"), ("t", 2, "b", "y"), ("t", 3, None, None)], "k string, s int, p string, q string")
    r = sequence.trajectory_summary(rows, "k", "s", ["p"], ["q"], {"n_b": F.col("p") == "b"}).first()
    assert (r.n_steps, r.first_p, r.last_q, r.n_b) == (4, "a", "y", 1)


def test_anchor_must_be_the_only_one(spark):
    rows = spark.createDataFrame([("a", 0, True), ("a", 1, False), ("b", 0, True), ("b", 1, True), ("c", 0, False)], "k string, s int, x boolean")
    assert {r.k: (r.n_anchors, r.anchor) for r in sequence.anchors(rows, "k", "s", F.col("x")).collect()} == {"a": (1, 0), "b": (2, None), "c": (0, None)}


def test_rates_are_null_without_a_denominator(spark):
    rows = spark.createDataFrame([("x", 1, 2), ("y", 0, 0)], "f string, hit long, tried long")
    got = {(r.level, r.value): r.rate for r in sequence.grouped_rates(rows, ["f"], {"rate": ("hit", "tried")}, ["hit", "tried"]).collect()}
    assert got == {("all", None): 0.5, ("f", "x"): 0.5, ("f", "y"): None}


# --- pairs, grids, splits, contracts


def test_pairs_report_what_is_incomplete(spark):
    rows = spark.createDataFrame([("a", "c", 1.0), ("a", "i", 3.0), ("b", "c", 1.0), ("d", "c", 1.0), ("d", "c", 2.0), ("d", "i", 1.0)], "k string, t string, v double")
    assert [tuple(r) for r in pairs.pair_deltas(rows, ["k"], "t", "c", "i", "v").collect()] == [("a", 1.0, 3.0, 2.0)]
    assert {r.k: r.status for r in pairs.incomplete_pairs(rows, ["k"], "t", "c", "i").collect()} == {"b": "incomplete", "d": "duplicate"}


def test_coverage_both_ways(spark):
    want = pairs.grid(spark.createDataFrame([("a",), ("b",)], "x string"), spark.createDataFrame([(1,), (2,)], "y int"))
    seen = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("c", 1)], "x string, y int")
    got = {(r.x, r.y): r.status for r in pairs.coverage(want, seen, ["x", "y"]).collect()}
    assert got == {("a", 1): "present", ("a", 2): "duplicate", ("b", 1): "missing", ("b", 2): "missing", ("c", 1): "unexpected"}


def test_mismatches_treat_null_as_a_value(spark):
    rows = spark.createDataFrame([(1, None, None), (2, "a", None), (3, "a", "a")], "k int, a string, b string")
    assert {r.k: r.mismatch for r in pairs.mismatches(rows, {"ab": (F.col("a"), F.col("b"))}).collect()} == {1: [], 2: ["ab"], 3: []}


@pytest.mark.parametrize(("n", "want"), [(3, [1, 1, 1]), (5, [3, 1, 1]), (7, [4, 1, 2]), (8, [5, 2, 1]), (10, [6, 2, 2]), (12, [7, 2, 3])])
def test_split_counts(n, want):
    assert splits.split_counts(n, 0.6, 0.2) == want


@pytest.mark.parametrize(("n", "train", "validation"), [(2, 0.6, 0.2), (0, 0.6, 0.2), (9, 0.8, 0.2), (9, 0.0, 0.5)])
def test_splits_that_cannot_be(n, train, validation):
    with pytest.raises(ValueError):
        splits.split_counts(n, train, validation)


def test_testing_takes_its_group_from_training_first():
    assert splits.split_counts(3, 0.9, 0.05) == [1, 1, 1] and splits.split_counts(4, 0.05, 0.9) == [1, 2, 1]


def test_splits_do_not_depend_on_the_order_of_rows(spark):
    rows = spark.createDataFrame([(f"g{i % 9}",) for i in range(50)], "g string")
    a, b = (sorted(map(tuple, splits.assign_splits(rows.repartition(n), "g", 0.6, 0.2, 5).collect())) for n in (1, 7))
    assert a == b and sorted(r[2] for r in a) == ["test"] * 2 + ["train"] * 5 + ["validation"] * 2
    assert {tuple(r) for r in splits.unsplit(rows.limit(2), "g").collect()} == {("g0", "all"), ("g1", "all")}


def test_fold_totals_are_those_of_the_expansion(spark):
    rows = spark.createDataFrame([(i % 2, f"g{i % 3}", i) for i in range(20)] + [(9, "alone", 5)], "s int, g string, x int")
    got = sorted(map(tuple, splits.fold_totals(rows, ["s"], "g", {"n": F.lit(1), "x": F.col("x")}).collect()))
    want = splits.leave_one_out(rows, rows, "g").groupBy("s", "fold", "is_test").agg(F.count("*").alias("n"), F.sum("x").alias("x"))
    own = {(r.s, r.g) for r in rows.collect()}
    assert got == sorted(tuple(r) for r in want.collect() if (r.s, r.fold) in own)


def test_stratified_folds_are_dealt_in_hash_order(spark):
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else i % 2) for i in range(300)], "k int, y int")
    got = {r.k: r.fold for r in splits.stratified_folds(rows, "k", "y", 5, 3).collect()}
    for y in (None, 0, 1):
        own = sorted((r.k for r in rows.collect() if r.y == y), key=lambda k: hashlib.sha256(f"3:{k}".encode()).hexdigest())
        assert [got[k] for k in own] == [i % 5 for i in range(len(own))]


def test_why_a_stratum_is_skipped(spark):
    rows = [("ok", g, y) for g in "ab" for y in (0, 1)] + [("one", "a", 1), ("one", "b", 1), ("null", "a", None), ("few", "a", 0), ("few", "a", 1), ("fold", "a", 0), ("fold", "a", 1), ("fold", "b", 1)]
    got = {r.s: r.reason for r in splits.fold_skips(spark.createDataFrame(rows, "s string, g string, y int"), ["s"], "g", "y").collect()}
    assert got == {"ok": None, "one": "single_class", "null": "missing_label", "few": "too_few_groups", "fold": "fold_lacks_class"}


@pytest.mark.parametrize(
    ("change", "rule"),
    [({}, None), ({"lang": None}, "required"), ({"lang": "xx"}, "allowed:lang"), ({"score": 1.5}, "range"), ({"score": None}, "range"), ({"id": 2}, "unique"), ({"wording": "other"}, "depends")],
)
def test_one_changed_field_breaks_one_rule(spark, change, rule):
    rows = [{"id": i, "lang": "en", "score": 0.5, "grp": 1, "wording": "w"} for i in range(4)]
    rows[0] |= change
    df = spark.createDataFrame(rows, "id int, lang string, score double, grp int, wording string")
    found = {r.rule_id for r in contracts.violations(
        contracts.required(df, ["id"], ["lang"]), contracts.allowed(df, ["id"], "lang", ["en", None]), contracts.holds(df, ["id"], "range", F.col("score").between(0, 1)),
        contracts.unique(df, ["id"]), contracts.depends(df, ["grp"], ["wording"]),
    ).collect()}
    assert found == ({rule} if rule else set())


def test_strict_contracts_raise(spark):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    with pytest.raises(contracts.ContractError, match="unique at 1"):
        contracts.enforce(df, contracts.unique(df, ["id"]))
    assert contracts.enforce(df, contracts.required(df, ["id"], ["id"])) is df


# --- ledgers


def test_exact_decimals(spark):
    rows = spark.createDataFrame([("a", "gpu", "1.00000001"), ("a", "cpu", "2.00000002"), ("b", "gpu", "x"), ("b", "gpu", "-1")], "app string, res string, c string").select("app", "res", ledger.money(F.col("c")).alias("cost"), F.lit("2026-01-01").alias("at"))
    got = {(r.level, r.app, r.resource): r.cost for r in ledger.rollup(rows.where("cost IS NOT NULL"), "app", "res", "cost", "at").collect()}
    assert got["total", None, None] == got["app", "a", None] == Decimal("3.0000000300")
    assert rows.where("cost IS NULL").count() == 2


def test_conflicting_copies(spark):
    rows = spark.createDataFrame([(1, 5), (1, 5), (2, 5), (2, 6), (3, 1)], "k int, v int")
    assert {r.k: (r.v, r.copies, r.conflict) for r in ledger.deduplicated(rows, ["k"], ["v"]).collect()} == {1: (5, 2, False), 2: (5, 2, True), 3: (1, 1, False)}


def test_costs_round_half_to_even(spark):
    r = one(spark, c=ledger.gpu_cost(F.lit(2.0000005), 0.001261, F.lit(1), F.lit(10), F.lit(0))).c
    assert (r.seconds, r.cost, r.tokens_per_second) == (2.0, 0.002522, 0.0) and one(spark, c=ledger.gpu_cost(F.lit(0.0), 1.0, F.lit(1), F.lit(0), F.lit(0))).c.tokens_per_second is None


def test_exploded_costs_balance(spark):
    rows = spark.createDataFrame([("a", {"gpu": Decimal("1.5"), "cpu": Decimal("0.5")})], "app string, costs map<string,decimal(38,18)>")
    parts = ledger.exploded(rows, ["app"], "costs")
    assert ledger.imbalance(spark.createDataFrame([("a", Decimal(2))], "app string, cost decimal(38,18)"), parts, "app").count() == 0
    assert ledger.imbalance(spark.createDataFrame([("a", Decimal(3)), ("b", Decimal(1))], "app string, cost decimal(38,18)"), parts, "app").count() == 2


# --- texts, hashes, vectors, labels, reviews


def test_thinking_is_split_at_the_last_mark(spark):
    rows = ["<think>a</think>b</think> c ", "<think>never closed", "plain", "", "<think></think>", "x<think> y <think>z\u00a0</think>\u2003w\n", "a <think> b", None]
    got = [tuple(r.s) for r in spark.createDataFrame([(x,) for x in rows], "t string").select(text.split_thinking(F.col("t")).alias("s")).collect()]
    assert got == [("a</think>b", "c", True), ("never closed", "", False), (None, "plain", None), (None, "", None), ("", "", True), ("y <think>z", "w", True), ("b", "", False), (None, None, None)]


def test_tool_calls(spark):
    blocks = ['{"name": " submit ", "arguments": {"x": {"y": [1, 2]}}}', "{not json", "[1]", '"text"', '{"arguments": {}}', '{"name": "f"}', '{"name": "f", "arguments": []}', '{"name": 3, "arguments": {}}', '{"name": "g", "arguments": {}}', "null"]
    t = "".join(f"<tool_call>\n{b}\n</tool_call>" for b in blocks) + "<tool_call>"
    r = one(spark, c=text.tool_calls(F.lit(t), ["submit"])).c
    assert [(c.name, c.arguments, c.recognized, c.status) for c in r.calls] == [("submit", '{"x":{"y":[1,2]}}', True, "requested"), ("g", "{}", False, "requested")]
    assert [(e.code, e["index"]) for e in r.errors] == [
        ("unbalanced_tool_call_tags", None), ("invalid_tool_call_json", 1), ("tool_call_must_be_object", 2), ("tool_call_must_be_object", 3), ("missing_tool_name", 4), ("tool_arguments_must_be_object", 5),
        ("tool_arguments_must_be_object", 6), ("missing_tool_name", 7), ("tool_call_must_be_object", 9),
    ]
    assert r.errors[1].raw == "{not json" and one(spark, c=text.tool_calls(F.lit("an endpoint in prose"))).c.calls == []


@pytest.mark.parametrize(("text_", "fallback", "want"), [
    ("arXiv:1\nShort\nA title of some length \n and  more of it\nthird line here\nfourth line", "Paper 1", "A title of some length and more of it third line here"), ("x" * 95 + "\nnext line here", "Paper 1", "x" * 95),
    ("anything at all here", "A name", "A name"), ("short\ndoi: 10\n\n", "Paper 2", "Paper 2"), ("y" * 89 + "\n" + "z" * 200, "Paper 2", "y" * 89 + " " + "z" * 90),
])
def test_titles(spark, text_, fallback, want):
    assert one(spark, t=text.title(F.lit(text_), F.lit(fallback))).t == want


def test_tags(spark):
    long = "some name/" + "a" * 60
    digest = hashlib.sha256(long.encode()).hexdigest()[:10]
    r = one(spark, a=text.tag_value(F.lit("..some name / x__")), b=text.tag_value(F.lit(long)), c=text.tag_value(F.lit("b" * 51 + "-" * 20 + "c")))
    assert (r.a, r.b) == ("some-name-x", "some-name-" + "a" * 42 + "-" + digest) and len(r.b) == 63 and r.c.startswith("b" * 51 + "-") and len(r.c) == 62
    with pytest.raises(Exception, match="tag is empty"):
        one(spark, a=text.tag_value(F.lit("-/-")))


def test_anchors_at_the_beginning(spark):
    r = one(spark, a=text.unique_anchor(F.lit("abcabd"), F.lit(0), [2, 3]), b=text.unique_anchor(F.lit("aaaa"), F.lit(0), [2]), c=text.unique_anchor(F.lit("  "), F.lit(0), [1]), d=text.unique_anchor(F.lit("aaaa"), F.lit(2), [1]))
    assert (r.a, r.b, r.c, r.d) == ("abc", "aaaa", None, None)


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abXYc", (2, "XY", True)), ("aab", "aaab", (2, "a", True)), ("abc", "axc", (1, "", False)), ("abc", "abc", (3, "", False)), ("", "x", (0, "x", True)), (None, "x", (None, None, None)), ("abc", "zzabcq", (0, "zza", False))])
def test_single_insertion(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert tuple(df.select(text.single_insertion(F.col("a"), F.col("b")).alias("i")).first().i) == want


def test_text_functions(spark):
    r = one(
        spark, n=text.occurrences(F.lit("aaaa"), F.lit("aa")), z=text.occurrences(F.lit("a"), F.lit("")), w=text.words(F.lit("Été the_End")), o=text.option_mentions(F.lit("Option a, option 2, adoption b")),
        u=text.urls(F.lit("see https://x.y/z). and http://a.b,")), h=text.hops(F.lit("3-hop")), h2=text.hops(F.lit("x-hop")), p=text.page_spans(F.lit("ab\fc\f")), s=text.spliced(F.lit("abcd"), F.lit(2), F.lit("X")),
        d=text.host_within(F.lit("https://a.b.org/x"), "b.org"), e=text.host_within(F.lit("https://ab.org/x"), "b.org"), ws=text.collapse_space(F.lit(" a \n b ")),
        g=text.tag_value(F.lit("a" * 80)), i=text.id_suffix(F.lit("run-v2"), r"-(v\d+)$"),
        sp=text.token_span(F.from_json(F.lit('[{"begin":0,"end":2},{"begin":2,"end":4},{"begin":4,"end":6}]'), "array<struct<begin:int,end:int>>"), F.lit(3), F.lit(5)),
    )
    assert (r.n, r.z, r.w, r.o) == (2, 0, ["t", "the", "end"], ["A", "2"]) and r.u == ["https://x.y/z", "http://a.b"] and (r.h, r.h2) == (3, None)
    assert [tuple(x) for x in r.p] == [(1, 0, 2), (2, 3, 4), (3, 5, 5)] and r.s == "abXcd" and (r.d, r.e, r.ws) == (True, False, "a b")
    assert len(r.g) == 63 and r.i == "v2" and tuple(r.sp) == (1, 2, True)


def test_pages_and_anchors(spark):
    r = one(spark, page=text.page_of(text.page_spans(F.lit("ab\fcd")), F.lit(4)), a=text.unique_anchor(F.lit("xyxyz"), F.lit(4), [1, 2, 3]), m=text.render_messages(F.from_json(F.lit('[{"role":"user","content":"a"},{"role":"x","content":"b"}]'), "array<struct<role:string,content:string>>")))
    assert (r.page, r.a, r.m) == (2, "yxy", "USER: a\n\nX: b")


def test_a_grid_cell_compares_its_texts_once(spark):
    from wayline.operators import runs

    words = " ".join(f"w{i}" for i in range(60))
    rows = [(0, "ab\fcd", "ab\fcXd"), (1, words, words[:120] + "XY" + words[120:]), (2, "abc", "XabcY"), (3, None, "a"), (4, "aaaa", "aabaa")]
    df = spark.createDataFrame(rows, "k int, a string, b string").repartition(2)
    cells = df.select("k", runs.grid_cell(F.col("a"), F.col("b"), text.page_spans(F.col("a"))).alias("c")).select("k", "c.offset", F.when(F.col("c.offset").isNotNull(), F.col("c.anchor")).alias("anchor"), "c.page", F.array_join("c.errors", ",").alias("errors"))
    error = "one_insertion"
    assert [tuple(r)[1:] for r in cells.orderBy("k").collect()] == [(4, "ab\fc", 2, ""), (120, words[40:120], 1, ""), (None, None, None, error), (None, None, None, error), (2, None, 1, "")]
    # The comparison by halving, which names the middle four times, stands in the plan once, whatever of the cell is read.
    assert cells._jdf.queryExecution().optimizedPlan().toString().lower().count("shiftright(") <= 4


def test_digests(spark):
    import hashlib

    df = spark.createDataFrame([("g", "b", 1), ("g", "a", None), ("g", "a", None)], "g string, x string, y int")
    assert df.agg(hashing.id_set_sha256("x").alias("h")).first().h == hashlib.sha256(b"a\nb").hexdigest()
    assert one(spark, h=hashing.token_ids_sha256(F.array(F.lit(1), F.lit(2)))).h == hashlib.sha256(b"[1,2]").hexdigest()
    a, b = (hashing.table_sha256(df.repartition(n), ["g"], ["x", "y"]).first() for n in (1, 7))
    assert a == b and a.n == 3
    assert hashing.table_sha256(df.where("x = 'a'"), ["g"], ["x", "y"]).first().table_sha256 != a.table_sha256


def test_distances(spark):
    r = one(spark, d=vectors.distance(F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))), z=vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(0.0))), c=vectors.distance(F.array(F.lit(1.0)), F.array(F.lit(1.000001))))
    assert (r.d.norm_a, r.d.diff, r.d.relative, r.d.largest, r.d.cosine, r.d.equal) == (5.0, 5.0, 2.0, 4.0, 0.0, False) and r.z == 1.0 and r.c.close and not r.c.equal


def test_outcomes_differ_in_their_order(spark):
    n = lambda injected, state, spread: labels.normalized_outcome(F.lit(injected), F.lit(state), F.lit(spread))
    v = lambda *a: labels.live_outcome(*map(F.lit, a))
    r = one(
        spark, a=n(False, "executed", True), b=v(False, True, False, True, False), c=v(False, False, False, True, False), d=v(True, False, False, True, True), e=v(True, False, False, False, True), f=v(False, False, False, False, True),
        g=labels.simulated_decision(("host", F.lit(False)), ("method", F.lit(True))), k=labels.next_node(F.lit(3), F.lit("worker_1")),
    )
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("clean", "executed", "indeterminate", "propagated_but_not_executed", "indeterminate", "indeterminate") and tuple(r.g) == ("blocked", "method") and r.k == "worker_2"


EVENT = "struct<model_called:boolean,output:struct<message:string,actions:array<struct<status:string,executed:boolean>>,tool_call_requests:array<string>,truncated:boolean,finish_reason:string,status:string>>"


@pytest.mark.parametrize(("event", "want"), [
    ({"model_called": False, "output": {"message": "m", "actions": [{"status": "executed"}]}}, (False, None, "indeterminate")), ({"model_called": True}, (False, None, "indeterminate")),
    ({"output": {"message": "m", "tool_call_requests": ["r"]}}, (True, None, "indeterminate")), ({"output": {"message": "m", "actions": [{"status": "Succeeded"}]}}, (True, True, "executed")),
    ({"output": {"actions": [{"status": "queued"}, {"executed": True}], "truncated": True}}, (True, True, "executed")), ({"output": {"actions": [{"status": "Blocked"}, {"status": "denied"}]}}, (True, False, "blocked")),
    ({"output": {"actions": [{"status": "blocked"}, {"status": None}]}}, (True, None, "indeterminate")), ({"output": {"message": "m", "actions": [], "finish_reason": "Length"}}, (False, None, "indeterminate")),
    ({"output": {"message": "m", "status": "incomplete"}}, (False, None, "indeterminate")), ({"output": {"truncated": False}}, (False, None, "indeterminate")), ({"output": {"message": "", "finish_reason": "stop"}}, (False, False, "none")),
])
def test_action_observations(spark, event, want):
    import json

    r = one(spark, a=labels.action_observation(F.from_json(F.lit(json.dumps(event)), EVENT))).a
    assert tuple(r) == want


def test_labels_of_steps_and_targets(spark):
    binary = {"propagated": 0, "task_preserved": 0, "resisted_injection": 0, "propagated_but_not_executed": 0, "unsafe_action_attempted": 0, "injection_received": 0, "unsafe_action_executed": 1, "clean": None, "indeterminate": None, None: None}
    got = spark.createDataFrame([(k,) for k in binary], "l string").select("l", labels.binary_label(F.col("l")).alias("b")).collect()
    assert {r.l: r.b for r in got} == binary
    latent = spark.createDataFrame([(o,) for o in labels.OUTCOMES], "o string").select("o", labels.latent_status(F.col("o")).alias("s")).collect()
    assert {r.o for r in latent if r.s == "candidate"} == {"propagated_but_not_executed", "attempted_but_blocked"} and {r.s for r in latent} == {"candidate", "not_candidate"}
    x = lambda target, outcome: labels.expected_label(F.lit(target), F.lit(True), F.lit(False), F.lit(outcome))
    r = one(spark, a=x("trajectory_action_executed", "indeterminate"), b=x("trajectory_action_executed", "resisted"), c=x("injection_present", "indeterminate"), d=labels.trajectory_label(F.lit(True), F.lit("executed")), e=labels.node_id(F.lit("worker"), F.lit("worker_2")), f=labels.node_id(F.lit(None).cast("string"), F.lit("")))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (None, 0, 1, "successful_compromise", "worker2", "agent")


def test_two_reviewers(spark):
    rows = spark.createDataFrame([("p", 1, "a", None), ("p", 2, "a", None), ("q", 1, "a", "x"), ("q", 2, "b", None)], "pair string, slot int, f string, g string")
    assert {r.pair: r.differing for r in review.disagreements(rows, ["pair"], "slot", ["f", "g"]).collect()} == {"p": [], "q": ["f", "g"]}


# --- resampling and probes


def test_weighted_auroc_is_that_of_the_copies(spark):
    rng = np.random.default_rng(1)
    rows = [(f"c{i % 7}", round(float(rng.random()), 1), int(rng.integers(0, 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "cluster string, score double, label int").withColumn("g", F.lit(1))
    weights = {(r.replicate, r.cluster): r.weight for r in resample.cluster_weights(df, "cluster", 8).collect()}
    for r in resample.bootstrap_auroc(df, ["g"], "cluster", 8).collect():
        copies = [(s, y) for c, s, y in rows for _ in range(weights.get((r.replicate, c), 0))]
        assert r.auroc == pytest.approx(brute_auroc(*zip(*copies, strict=True)))
    assert all(sum(w for (rep, _), w in weights.items() if rep == k) == 7 for k in range(8))


def test_interval_is_linear(spark):
    r = resample.interval(spark.createDataFrame([(1, float(x)) for x in range(11)] + [(1, None)], "g int, v double"), ["g"], "v", 0.9).first()
    assert (r.n, r.low, r.high) == (11, pytest.approx(0.5), pytest.approx(9.5))


def test_paired_deltas_use_one_draw(spark):
    s = spark.createDataFrame([("2", 0, 0.5), ("3", 0, 0.7), ("2", 1, 0.5), ("3", 1, None)], "hop string, replicate long, v double")
    assert {r.replicate: None if r.delta is None else round(r.delta, 9) for r in resample.paired_delta(s, [], "hop", "2", "3", "v").collect()} == {0: 0.2, 1: None}


def test_permutations_keep_each_group_s_balance(spark):
    rows = spark.createDataFrame([(i, i % 4, int(i % 3 == 0)) for i in range(40)], "k int, g int, y int")
    got = resample.permuted_labels(rows, "g", "k", "y", 5)
    assert got.groupBy("replicate", "g").agg((F.sum("y") - F.sum("permuted")).alias("d")).where("d <> 0").count() == 0
    assert got.where("y <> permuted").count() > 0


def vectors_of(signal, n=60, seed=0):
    rng = np.random.default_rng(seed)
    return [(i, i % 5, i // 5 % 2, (rng.normal(size=4) + np.array([signal * (i // 5 % 2), 0, 0, 0])).tolist(), f"{i % 5}-{i // 10}") for i in range(n)]


@pytest.mark.parametrize("probe", ["logistic", "centroid", "contrast"])
def test_probes_find_a_signal_and_no_other(spark, probe):
    for signal, low, high in ((6.0, 0.95, 1.0), (0.0, 0.1, 0.9)):
        rows = spark.createDataFrame(vectors_of(signal), "k int, g int, label int, v array<double>, pair string").withColumn("s", F.lit(1))
        models = probes.fit_leaving_out(rows, ["s"], "g", "k", "label", "v", probe, "pair")
        scored = probes.held_out_scores(rows, models, ["s"], "g", "v")
        assert scored.count() == 60 and low <= metrics.fold_summary(scored, ["s"], "g").first().pooled_auroc <= high


def test_newton_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(50, 3)), rng.integers(0, 2, 50)
    w, b = probes.newton(x, y)
    p = probes.sigmoid(x @ w + b)
    assert np.abs(w + x.T @ (p - y)).max() < 1e-6 and abs((p - y).sum()) < 1e-6


def test_equal_pairs_fall_back_to_the_share(spark):
    x = np.ones((6, 2))
    w, b = probes.fit_contrast(x, np.array([0, 1, 0, 1, 1, 1]), np.array([0, 0, 1, 1, 2, 2]))
    assert not w.any() and probes.sigmoid(np.array([b]))[0] == pytest.approx(4 / 6)


def test_a_fold_with_one_class_is_left_out(spark):
    rows = spark.createDataFrame([(0, 0, 1, [1.0]), (1, 0, 0, [0.0]), (2, 1, 1, [1.0])], "k int, g int, label int, v array<double>").withColumn("s", F.lit(1))
    assert [r.fold for r in probes.fit_leaving_out(rows, ["s"], "g", "k", "label", "v").collect()] == [1]


def test_principal_directions(spark):
    x = np.random.default_rng(0).normal(size=(100, 3)) * np.array([5, 1, 0.1])
    directions, share = probes.principal(spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>"), "v", 2)
    want = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs(directions), np.abs(want[2][:2]), atol=1e-6) and np.allclose(share, want[1][:2] ** 2 / (want[1] ** 2).sum())




def test_permutation_null_scores_all_rows(spark):
    rng = np.random.default_rng(4)
    x, group, label = rng.normal(size=(60, 3)), np.arange(60) % 3, np.arange(60) // 3 % 2
    v = spark.createDataFrame([(i, int(group[i]), int(label[i]), x[i].tolist()) for i in range(60)], "i long, g int, y int, v array<double>")
    fitted = [r.i for r in v.orderBy(F.xxhash64("i"), "i").limit(40).collect()]
    want = {}
    for replicate in range(5):
        y = np.zeros(60, int)
        for r in resample.permuted_labels(v, "g", "i", "y", 5).where(F.col("replicate") == replicate).collect():
            y[r.i] = r.permuted
        own = []
        for g in range(3):
            train, test = [i for i in fitted if group[i] != g], np.flatnonzero(group == g)
            w, b = probes.fit_centroid(x[train], y[train], np.zeros(len(train)))
            z = x[test] @ w + b
            own.append(np.mean([(p > n) + (p == n) / 2 for p in z[y[test] == 1] for n in z[y[test] == 0]]))
        want[replicate] = np.mean(own)
    for group_rows in (500, 3):  # gathered by group, and by joins
        got = {r.replicate: r.mean_auroc for r in nulls.permutation_null(v, "g", "i", "y", "v", 5, "centroid", max_rows=40, group_rows=group_rows).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_permuted_labels_of_fixed_scores(spark):
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], int(i % 5 % 3), float(rng.integers(0, 9)) / 9, int(rng.random() < 0.4) if i % 13 else None) for i in range(120)]
    frame = spark.createDataFrame(rows, "k int, s string, g int, score double, label int")
    dealt = {(r.replicate, r.k): r.permuted for r in resample.permuted_labels(frame.where("label IS NOT NULL").withColumn("sg", F.concat("s", F.col("g").cast("string"))), "sg", "k", "label", 70, 3).collect()}
    got = nulls.permuted_auroc(frame, ["s"], "g", "k", 70, 3).collect()
    assert len(got) == 140
    for r in got:
        own = [(x[3], dealt[r.replicate, x[0]]) for x in rows if x[1] == r.s and x[4] is not None]
        assert r.auroc == pytest.approx(np.mean([(p > q) + (p == q) / 2 for p, a in own if a for q, b in own if not b]))
    assert nulls.permuted_auroc(frame.limit(0), ["s"], "g", "k", 5).count() == 0
    one = nulls.permuted_auroc(frame.withColumn("label", F.lit(1)), [], "g", "k", 3).collect()
    assert [r.auroc for r in one] == [None] * 3


def test_aurocs_of_columns():
    rng = np.random.default_rng(0)
    z, y = rng.integers(0, 5, (30, 4)) / 5, rng.integers(0, 2, (30, 4))
    y[:, 3] = 1
    want = [np.mean([(p > q) + (p == q) / 2 for p in z[y[:, c] == 1, c] for q in z[y[:, c] == 0, c]]) for c in range(3)]
    got = nulls.column_aurocs(z, y)
    assert np.allclose(got[:3], want) and np.isnan(got[3])


def test_nulls_make_no_table_of_rows_and_replicates(spark):
    v = spark.createDataFrame([(i, i % 3, i // 3 % 2, [float(i), 1.0]) for i in range(30)], "i long, g int, y int, v array<double>")
    plan = nulls.permutation_null(v, "g", "i", "y", "v", 7, "centroid")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "Window" not in plan
