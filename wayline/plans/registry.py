"""Registered queries. Each entry is a function of (spark, sf_dir) and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.functions import hashing, text, vectors
from wayline.operators import contracts, ledger, metrics, nulls, pairs, probes, resample, review, sequence, splits
from wayline.plans.frames import E, L, P, S, event_steps, ledger_rows, predictions, steps, table
from wayline.plans.frames import vectors as vector_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LEXICON = {"request": ("please", "send", "forward", "the"), "article": ("der", "die", "das", "le", "la", "el"), "negation": ("not", "no", "nicht", "pas")}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def snapped(df: DataFrame, *names: str, places: int = 5) -> DataFrame:
    """As :func:`rounded`, by way of ten exact places: where a quotient lies between two rounded values, the last bits of
    a sum of floats don't decide."""
    return df.withColumns({n: F.round(F.col(n).cast("decimal(18,10)"), places).cast("double") for n in names})


def snapped_sql(value: str, places: int = 5) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(18,10)), {places}) AS DOUBLE)"


def _pairs_sql(by: str) -> str:
    """AUROC by its definition: every positive against every negative."""
    return f"""SELECT {by}, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0.0 END) AS auroc
               FROM p a JOIN p b USING ({by}) WHERE a.label = 1 AND b.label = 0 GROUP BY {by}"""


def _bin_sql(spaced: bool = True) -> str:
    return " + ".join(f"(score >= {e!r}::DOUBLE)::INT" for e in metrics.edges(10, spaced)[1:])


def exact_sql(num: str, den: str) -> str:
    """A quotient of integers, not below 0, rounded half up to six places, in integers."""
    return f"CAST((2 * CAST({num} AS HUGEINT) * 1000000 + ({den})) // (2 * CAST({den} AS HUGEINT)) AS DOUBLE) / 1000000"


# --- metrics


@query(f"WITH {P}, a AS ({_pairs_sql('lang')}) SELECT lang, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, round(max(auroc), 6) AS auroc FROM p LEFT JOIN a USING (lang) GROUP BY lang")
def auroc_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.auroc(predictions(spark, d), ["lang"]), "auroc")


@query(f"""WITH {P}, b AS (SELECT lang, {_bin_sql()} AS bin, count(*) AS n, abs(sum(k) - 1000 * sum(label)) AS gap FROM p GROUP BY 1, 2)
    SELECT lang, CAST(sum(n) AS BIGINT) AS n, {exact_sql('sum(gap)', '1000 * sum(n)')} AS ece, max({exact_sql('gap', '1000 * n')}) AS mce FROM b GROUP BY lang""")
def ece_by_stratum(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.calibration(predictions(spark, d), ["lang"]), "ece", "mce")


@query(f"""WITH {P} SELECT {_bin_sql(False)} AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(CAST(label AS DOUBLE)), 6) AS mean_label,
    round(abs(avg(score) - avg(CAST(label AS DOUBLE))), 6) AS gap FROM p GROUP BY 1""")
def reliability_diagram(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.bins(predictions(spark, d), [], spaced=False), "mean_score", "mean_label", "gap")


@query(f"""WITH {P}, f AS ({_pairs_sql('lang, source')}), g AS ({_pairs_sql('lang')}),
    h AS (SELECT lang, count(*) AS n_folds, avg(auroc) AS m, stddev_pop(auroc) AS s, min(auroc) AS lo, max(auroc) AS hi FROM f GROUP BY lang)
    SELECT lang, count(*) AS n, coalesce(max(n_folds), 0) AS n_folds, round(max(g.auroc), 6) AS pooled_auroc, round(max(m), 6) AS mean_auroc, round(max(s), 6) AS sd_auroc,
           round(max(lo), 6) AS min_auroc, round(max(hi), 6) AS max_auroc FROM p LEFT JOIN g USING (lang) LEFT JOIN h USING (lang) GROUP BY lang""")
def heldout_fold_summary(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.fold_summary(predictions(spark, d), ["lang"], "source")
    return rounded(out, "pooled_auroc", "mean_auroc", "sd_auroc", "min_auroc", "max_auroc")


_SNAPSHOT = f"""SELECT lang, hop, count(*) AS n, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg, sum((k - 1000 * label) * (k - 1000 * label)) / 1000000 / count(*) AS brier,
    {exact_sql('sum((k - 1000 * label) * (k - 1000 * label))', '1000000 * count(*)')} AS brier6, avg(CAST((score >= 0.5)::INT = label AS DOUBLE)) AS accuracy FROM p GROUP BY lang, hop"""
_ECE = f"""SELECT lang, hop, {exact_sql('sum(gap)', '1000 * sum(n)')} AS ece, max({exact_sql('gap', '1000 * n')}) AS mce
    FROM (SELECT lang, hop, {_bin_sql()} AS bin, count(*) AS n, abs(sum(k) - 1000 * sum(label)) AS gap FROM p GROUP BY 1, 2, 3) GROUP BY lang, hop"""


@query(f"""WITH {P}, a AS ({_pairs_sql('lang, hop')}), f AS ({_SNAPSHOT}), c AS ({_ECE})
    SELECT lang, hop, n, n_pos, n_neg, round(auroc, 6) AS auroc, brier6 AS brier, round(accuracy, 6) AS accuracy, ece, mce
    FROM f JOIN c USING (lang, hop) LEFT JOIN a USING (lang, hop)""")
def agent_layer_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.snapshot(predictions(spark, d), ["lang", "hop"]), "auroc", "brier", "accuracy", "ece", "mce")


@query(f"""WITH {P}, a AS ({_pairs_sql('source, lang')}), f AS (SELECT source, lang, count(*) AS n, avg(score) AS mean_score, {exact_sql('sum((k - 1000 * label) * (k - 1000 * label))', '1000000 * count(*)')} AS brier FROM p GROUP BY source, lang)
    SELECT source, lang, n, round(mean_score, 6) AS mean_score, brier, round(auroc, 6) AS auroc FROM f LEFT JOIN a USING (source, lang)""")
def domain_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    flat = p.groupBy("source", "lang").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), metrics.brier(F.col("score"), F.col("label")).alias("brier"))
    return rounded(flat.join(metrics.auroc(p, ["source", "lang"]).select("source", "lang", "auroc"), ["source", "lang"]), "mean_score", "brier", "auroc")


@query(f"""WITH {P}, a AS ({_pairs_sql('lang, hop')}), f AS ({_SNAPSHOT}), m AS (SELECT lang, hop, auroc, brier, brier6 FROM f LEFT JOIN a USING (lang, hop))
    SELECT lang, round(x.auroc, 6) AS auroc_low, round(y.auroc, 6) AS auroc_high, round(y.auroc - x.auroc, 6) AS auroc_delta,
           x.brier6 AS brier_low, y.brier6 AS brier_high, round(y.brier - x.brier, 6) AS brier_delta
    FROM m x JOIN m y USING (lang) WHERE x.hop = '2-hop' AND y.hop = '3-hop'""")
def depth_delta(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.deltas(metrics.snapshot(predictions(spark, d), ["lang", "hop"]), ["lang"], "hop", "2-hop", "3-hop", ["auroc", "brier"])
    return rounded(out, *[f"{m}_{e}" for m in ("auroc", "brier") for e in ("low", "high", "delta")])


@query(f"""WITH {P}, f AS ({_SNAPSHOT}) SELECT 'metric' AS record_type, lang, hop, m AS metric, round(v, 6) AS value
    FROM (SELECT lang, hop, unnest(['brier', 'accuracy', 'n']) AS m, unnest([brier6, accuracy, CAST(n AS DOUBLE)]) AS v FROM f)""")
def tidy_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.tidy(metrics.snapshot(predictions(spark, d), ["lang", "hop"]), ["lang", "hop"], ["brier", "accuracy", "n"], "metric"), "value")


@query(f"""WITH {P}, a AS ({_pairs_sql('lang, source')}), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY auroc DESC, source) AS k FROM a)
    SELECT lang, source, round(auroc, 6) AS auroc FROM r WHERE k = 1""")
def best_layer_rank(spark: SparkSession, d: str) -> DataFrame:
    scored = metrics.auroc(predictions(spark, d), ["lang", "source"]).where("auroc IS NOT NULL").select("lang", "source", "auroc")
    return rounded(metrics.best(scored, ["lang"], "auroc", "source"), "auroc")


@query(f"""WITH {P}, a AS ({_pairs_sql('lang, source')}) SELECT lang, round(avg(auroc), 6) AS mean, round(quantile_cont(auroc, 0.25), 6) AS q25, round(quantile_cont(auroc, 0.75), 6) AS q75 FROM a GROUP BY lang""")
def fold_band(spark: SparkSession, d: str) -> DataFrame:
    folds = metrics.auroc(predictions(spark, d), ["lang", "source"]).where("auroc IS NOT NULL")
    return rounded(metrics.fold_band(folds, ["lang"]), "mean", "q25", "q75")


@query(f"""WITH {P}, c(cohort, source) AS (VALUES ('all', 'src0'), ('all', 'src1'), ('all', 'src2'), ('pair', 'src1'), ('pair', 'src2'), ('one', 'src2'))
    SELECT cohort, count(*) AS n, count(DISTINCT source) AS n_groups, round(avg(score), 6) AS mean_score FROM p JOIN c USING (source) GROUP BY cohort""")
def cohort_membership(spark: SparkSession, d: str) -> DataFrame:
    cohorts = {"all": ["src0", "src1", "src2"], "pair": ["src1", "src2"], "one": ["src2"]}
    out = pairs.membership(predictions(spark, d), cohorts, "source").groupBy("cohort").agg(F.count("*").alias("n"), F.countDistinct("source").alias("n_groups"), F.avg("score").alias("mean_score"))
    return rounded(out, "mean_score")


# --- ordered steps


@query(f"""WITH {S}, a AS (SELECT conv_id, min(turn) AS anchor FROM s WHERE role = 'assistant' GROUP BY conv_id),
    j AS (SELECT * FROM s JOIN a USING (conv_id)), m AS (SELECT conv_id, avg(score) FILTER (turn < anchor) AS pre FROM j GROUP BY conv_id)
    SELECT conv_id, count(*) FILTER (turn < anchor) AS n_pre, count(*) FILTER (turn >= anchor) AS n_post, round(max(pre), 6) AS pre_mean, round(avg(score) FILTER (turn >= anchor), 6) AS post_mean,
           round(avg(score) FILTER (turn >= anchor) - max(pre), 6) AS divergence, round(max(score) FILTER (turn >= anchor) - max(pre), 6) AS peak_shift,
           round(avg(CAST(score > pre + 0.1 AS DOUBLE)) FILTER (turn >= anchor), 6) AS persistence FROM j JOIN m USING (conv_id) GROUP BY conv_id""")
def temporal_divergence(spark: SparkSession, d: str) -> DataFrame:
    s = steps(spark, d)
    anchor = s.groupBy("conv_id").agg(F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("anchor"))
    out = sequence.temporal_divergence(s.join(anchor, "conv_id"), ["conv_id"], "turn", "score", "anchor", 0.1)
    return rounded(out, "pre_mean", "post_mean", "divergence", "peak_shift", "persistence")


@query(f"WITH {S} SELECT conv_id, count(*) FILTER (role = 'system') AS n_anchors, CASE WHEN count(*) FILTER (role = 'system') = 1 THEN min(turn) FILTER (role = 'system') END AS anchor FROM s GROUP BY conv_id")
def anchor_discovery(spark: SparkSession, d: str) -> DataFrame:
    return sequence.anchors(steps(spark, d), "conv_id", "turn", F.col("role") == "system")


@query("""SELECT conv_id, count(*) AS n_steps, min_by(role, turn) AS first_role, max_by(role, turn) AS last_role, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (length(text) > 200) AS n_long
    FROM conversations GROUP BY conv_id""")
def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    counts = {"n_assistant": F.col("role") == "assistant", "n_long": F.length("text") > 200}
    return sequence.trajectory_summary(steps(spark, d), "conv_id", "turn", ["role"], ["role"], counts)


@query("""WITH u AS (SELECT user_id % 5 AS hop, user_id % 3 AS treatment, count(*) AS n_events, count(*) FILTER (event_type = 'purchase') AS fired, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY user_id),
    g AS (SELECT CASE WHEN grouping(hop) = 0 THEN 'hop' WHEN grouping(treatment) = 0 THEN 'treatment' ELSE 'all' END AS level, CAST(coalesce(hop, treatment) AS VARCHAR) AS value, count(*) AS n,
                 sum(fired) AS fired, sum(attempts) AS attempts FROM u GROUP BY GROUPING SETS ((), (hop), (treatment)))
    SELECT level, value, n, CAST(fired AS BIGINT) AS fired, CAST(attempts AS BIGINT) AS attempts, round(fired / nullif(attempts, 0), 6) AS rate FROM g""")
def dataset_rates_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("event_type")
    u = table(spark, d, "events").groupBy("user_id").agg(F.count_if(kind == "purchase").alias("fired"), F.count_if(kind == "error").alias("attempts"))
    u = u.withColumns({"hop": F.col("user_id") % 5, "treatment": F.col("user_id") % 3})
    return rounded(sequence.grouped_rates(u, ["hop", "treatment"], {"rate": ("fired", "attempts")}, ["fired", "attempts"]), "rate")


@query("""WITH c AS (SELECT conv_id, count(*) AS n, min(turn) AS lowest, max(turn) AS highest, count(DISTINCT turn) AS different FROM conversations WHERE role <> 'system' GROUP BY conv_id)
    SELECT * FROM c WHERE NOT (lowest = 0 AND highest = n - 1 AND different = n)""")
def contiguity_violations(spark: SparkSession, d: str) -> DataFrame:
    return sequence.contiguity_violations(steps(spark, d).where("role <> 'system'"), "conv_id", "turn")


@query(f"""WITH {E} SELECT user_id, min(step) FILTER (event_type = 'error') AS injected_at, min(step) FILTER (event_type = 'purchase') AS compromised_at,
    min(step) FILTER (event_type = 'purchase') - min(step) FILTER (event_type = 'error') AS handoffs FROM e GROUP BY user_id""")
def handoff_distance(spark: SparkSession, d: str) -> DataFrame:
    return sequence.handoff_distance(event_steps(spark, d), "user_id", "step", F.col("event_type") == "error", F.col("event_type") == "purchase")


@query("SELECT conv_id, turn, role, lag(role) OVER w AS previous_role, length(lag(text) OVER w) AS previous_chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def lag_context(spark: SparkSession, d: str) -> DataFrame:
    out = sequence.with_previous(steps(spark, d), "conv_id", "turn", {"role": "previous_role", "text": "previous_text"})
    return out.select("conv_id", "turn", "role", "previous_role", F.length("previous_text").cast("long").alias("previous_chars"))


@query("SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id, min_by(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def first_event_by_type(spark: SparkSession, d: str) -> DataFrame:
    return sequence.first_by_type(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], ["event_id", "value"])


@query("""SELECT conv_id, list(role ORDER BY turn) AS path FROM conversations GROUP BY conv_id HAVING list(role ORDER BY turn) <> ['user', 'assistant', 'user', 'assistant']""")
def node_order_mismatches(spark: SparkSession, d: str) -> DataFrame:
    return sequence.order_mismatches(steps(spark, d), "conv_id", "turn", "role", ["user", "assistant"] * 2)


@query(f"WITH {S} SELECT turn, count(*) AS n, round(avg(score), 6) AS mean FROM s GROUP BY turn")
def position_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sequence.position_profile(steps(spark, d), "turn", "score"), "mean")


@query("SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS pair_index FROM conversations")
def running_pair_index(spark: SparkSession, d: str) -> DataFrame:
    return sequence.running_index(steps(spark, d), ["conv_id", "role"], ["turn"]).select("conv_id", "role", "turn", "pair_index")


# --- pairs and grids


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("source", "lang").agg(F.avg("score").alias("score"))


@query(f"""WITH {P}, c AS (SELECT source, lang, avg(score) AS score FROM p GROUP BY source, lang)
    SELECT source, round(a.score, 6) AS low, round(b.score, 6) AS high, round(b.score - a.score, 6) AS delta FROM c a JOIN c b USING (source) WHERE a.lang = 'en' AND b.lang = 'fr'""")
def pair_deltas(spark: SparkSession, d: str) -> DataFrame:
    return rounded(pairs.pair_deltas(_cells(spark, d), ["source"], "lang", "en", "fr", "score"), "low", "high", "delta")


@query(f"""WITH {P}, c AS (SELECT source, lang, count(*) FILTER (toxic = 0) AS n_low, count(*) FILTER (toxic = 1) AS n_high FROM p WHERE toxic IN (0, 1) GROUP BY source, lang)
    SELECT *, CASE WHEN n_low > 1 OR n_high > 1 THEN 'duplicate' ELSE 'incomplete' END AS status FROM c WHERE NOT (n_low = 1 AND n_high = 1)""")
def incomplete_pairs(spark: SparkSession, d: str) -> DataFrame:
    return pairs.incomplete_pairs(predictions(spark, d).withColumn("side", F.col("toxic").cast("string")), ["source", "lang"], "side", "0", "1")


@query(f"""WITH {P}, g AS (SELECT lang, source FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (SELECT DISTINCT source FROM documents)), o AS (SELECT lang, source, count(*) AS n FROM p WHERE toxic = 1 GROUP BY lang, source)
    SELECT lang, source, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'duplicate' ELSE 'present' END AS status FROM g LEFT JOIN o USING (lang, source)""")
def coverage_missing_cells(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    expected = pairs.grid(docs.select("lang").distinct(), docs.select("source").distinct())
    return pairs.coverage(expected, predictions(spark, d).where("toxic = 1"), ["lang", "source"])


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_anti_join(spark: SparkSession, d: str) -> DataFrame:
    return pairs.pending(table(spark, d, "documents").select("doc_id", "lang", "source"), table(spark, d, "labels"), ["doc_id"])


@query("""WITH r(lang, fragment) AS (VALUES ('en', 'src1'), ('de', 'src2'))
    SELECT d.lang, count(*) AS n_input, count(*) FILTER (fragment IS NULL OR contains(source, fragment)) AS n_selected, count(*) FILTER (NOT (fragment IS NULL OR contains(source, fragment))) AS n_excluded
    FROM documents d LEFT JOIN r USING (lang) GROUP BY d.lang""")
def policy_selection_audit(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([("en", "src1"), ("de", "src2")], "lang string, fragment string")
    kept = F.col("fragment").isNull() | F.contains("source", F.col("fragment"))
    rows = table(spark, d, "documents").select("lang", "source").join(F.broadcast(rules), "lang", "left").withColumn("kept", kept)
    return rows.groupBy("lang").agg(F.count("*").alias("n_input"), F.count_if("kept").alias("n_selected"), F.count_if(~F.col("kept")).alias("n_excluded"))


@query(f"""WITH {P}, t(source, split) AS (VALUES ('src0', 'train'), ('src1', 'test'), ('src2', 'train')) SELECT split, split IS NULL AS missing, count(*) AS n FROM p LEFT JOIN t USING (source) GROUP BY 1, 2""")
def lookup_missing(spark: SparkSession, d: str) -> DataFrame:
    t = spark.createDataFrame([("src0", "train"), ("src1", "test"), ("src2", "train")], "source string, split string")
    return pairs.looked_up(predictions(spark, d), t, ["source"]).groupBy("split", "missing").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_returnflag IS DISTINCT FROM l_linestatus THEN 'flag' END, CASE WHEN l_shipdate IS DISTINCT FROM o_orderdate THEN 'date' END,
    CASE WHEN (CASE WHEN l_quantity > 40 THEN NULL ELSE l_linenumber END) IS DISTINCT FROM (CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(l_quantity AS BIGINT) END) THEN 'number' END) AS mismatch
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def request_result_mismatches(spark: SparkSession, d: str) -> DataFrame:
    both = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    number = (F.when(F.col("l_quantity") <= 40, F.col("l_linenumber").cast("long")), F.when(F.col("o_orderstatus") != "F", F.col("l_quantity").cast("long")))
    out = pairs.mismatches(both, {"flag": (F.col("l_returnflag"), F.col("l_linestatus")), "date": (F.col("l_shipdate"), F.col("o_orderdate")), "number": number})
    return out.select("l_orderkey", "l_linenumber", F.array_join("mismatch", ",").alias("mismatch"))


# --- splits


#: Counts of the three splits by number of groups, for 60 % and 20 % (fixed values of the design).
SPLIT_COUNTS = {3: (1, 1, 1), 4: (2, 1, 1), 5: (3, 1, 1), 6: (4, 1, 1), 7: (4, 1, 2), 8: (5, 2, 1), 9: (5, 2, 2), 10: (6, 2, 2), 11: (7, 2, 2), 12: (7, 2, 3)}


@query(f"""WITH d AS (SELECT DISTINCT source FROM documents), m(m) AS (VALUES {', '.join(f'({m})' for m in SPLIT_COUNTS)}), t(m, train, validation) AS (VALUES {', '.join(f'({m}, {c[0]}, {c[1]})' for m, c in SPLIT_COUNTS.items())}),
    g AS (SELECT m, source FROM d CROSS JOIN m WHERE CAST(replace(source, 'src', '') AS INT) < m), r AS (SELECT m, source, row_number() OVER (PARTITION BY m ORDER BY sha256('7:' || source)) AS place FROM g)
    SELECT m AS n_groups, source, place, CASE WHEN place <= train THEN 'train' WHEN place <= train + validation THEN 'validation' ELSE 'test' END AS split FROM r JOIN t USING (m)""")
def hash_split_assignment(spark: SparkSession, d: str) -> DataFrame:
    """The sources below a number, for several numbers of groups."""
    sources = table(spark, d, "documents").select("source").distinct().withColumn("i", F.replace("source", F.lit("src"), F.lit("")).cast("int"))
    made = [splits.assign_splits(sources.where(F.col("i") < m), "source", 0.6, 0.2, 7).withColumn("n_groups", F.lit(m)) for m in SPLIT_COUNTS]
    return reduce(DataFrame.unionByName, made)


@query(f"""WITH {P}, g AS (SELECT lang, source, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic = 0) AS n FROM p GROUP BY lang, source),
    f AS (SELECT lang, p, n, sum(p) OVER (PARTITION BY lang) - p AS lp, sum(n) OVER (PARTITION BY lang) - n AS ln FROM g)
    SELECT lang, CASE WHEN sum(p) = 0 OR sum(n) = 0 THEN 'single_class' WHEN count(*) < 2 THEN 'too_few_groups' WHEN min(least(lp, ln)) = 0 THEN 'fold_lacks_class' END AS reason FROM f GROUP BY lang""")
def stratum_skip_reason(spark: SparkSession, d: str) -> DataFrame:
    return splits.fold_skips(predictions(spark, d), ["lang"], "source", "toxic")


@query(f"""WITH {P}, r AS (SELECT *, (row_number() OVER (PARTITION BY toxic ORDER BY sha256('3:' || doc_id), doc_id) - 1) % 5 AS fold FROM p) SELECT fold, toxic, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM r GROUP BY fold, toxic""")
def stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.stratified_folds(predictions(spark, d), "doc_id", "toxic", 5, 3).groupBy("fold", "toxic").agg(F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@query(f"""WITH {P}, g AS (SELECT DISTINCT source AS fold FROM p) SELECT fold, source = fold AS is_test, count(*) AS n, {exact_sql('sum(k)', '1000 * count(*)')} AS mean_score FROM p CROSS JOIN g GROUP BY 1, 2""")
def leave_one_group_out(spark: SparkSession, d: str) -> DataFrame:
    out = splits.fold_totals(predictions(spark, d), [], "source", {"n": F.lit(1), "total": metrics.exact(F.col("score"))})
    return out.select("fold", "is_test", "n", F.round(metrics.mean(F.col("total"), F.col("n")), 6).alias("mean_score"))


# --- contracts


@query("""SELECT 'depends' AS rule_id, CAST(o_custkey AS VARCHAR) AS key, array_to_string(list_filter([CASE WHEN count(DISTINCT o_orderstatus) > 1 THEN 'o_orderstatus' END, CASE WHEN count(DISTINCT o_orderpriority) > 1 THEN 'o_orderpriority' END], lambda x: x IS NOT NULL), ',') AS detail
    FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1 OR count(DISTINCT o_orderpriority) > 1""")
def fd_violations(spark: SparkSession, d: str) -> DataFrame:
    return contracts.depends(table(spark, d, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@query(f"""WITH {P} SELECT 'allowed:lang' AS rule_id, CAST(doc_id AS VARCHAR) AS key, lang AS detail FROM p WHERE lang NOT IN ('en', 'de', 'fr')
    UNION ALL SELECT 'score_range', CAST(doc_id AS VARCHAR), CAST(CAST(score * 1000 AS BIGINT) AS VARCHAR) FROM p WHERE NOT score <= 0.98
    UNION ALL SELECT 'unique', source, CAST(count(*) AS VARCHAR) FROM p GROUP BY source HAVING count(*) > 1""")
def prediction_contract(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return contracts.violations(
        contracts.required(p, ["doc_id"], ["lang", "source", "score"]), contracts.allowed(p, ["doc_id"], "lang", ["en", "de", "fr"]),
        contracts.holds(p, ["doc_id"], "score_range", F.col("score") <= 0.98, F.round(F.col("score") * 1000).cast("long")), contracts.unique(p, ["source"]),
    )


@query(f"""WITH {P} SELECT 'coverage:lang' AS rule_id, source AS key, count(DISTINCT lang) || '/' || (SELECT count(DISTINCT lang) FROM p) AS detail FROM p GROUP BY source HAVING count(DISTINCT lang) <> (SELECT count(DISTINCT lang) FROM p)
    UNION ALL SELECT 'one_value:hop', '', CAST(count(DISTINCT hop) AS VARCHAR) FROM p HAVING count(DISTINCT hop) <> 1""")
def coverage_contract(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    return contracts.violations(contracts.same_coverage(p, ["source"], "lang"), contracts.one_value(p, "hop"))


# --- ledgers


@query(f"""WITH {L} SELECT CASE WHEN grouping(app) = 1 THEN 'total' WHEN grouping(resource) = 1 THEN 'app' ELSE 'resource' END AS level, app, resource, CAST(sum(cost) AS DOUBLE) AS cost, min(billed) AS first_at, max(billed) AS last_at, count(*) AS n
    FROM l GROUP BY GROUPING SETS ((), (app), (app, resource))""")
def ledger_rollup(spark: SparkSession, d: str) -> DataFrame:
    return ledger.rollup(ledger_rows(spark, d), "app", "resource", "cost", "at").withColumn("cost", F.col("cost").cast("double"))


@query(f"""WITH {L} SELECT app, {', '.join(f"CAST(coalesce(sum(cost) FILTER (resource = '{r}'), 0) AS DOUBLE) AS cost_{r}" for r in 'ANR')} FROM l GROUP BY app""")
def ledger_resource_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = ledger.pivoted(ledger_rows(spark, d), "app", "resource", "cost", ["A", "N", "R"])
    return out.withColumns({f"cost_{r}": F.col(f"cost_{r}").cast("double") for r in "ANR"})


@query("""SELECT l_orderkey, min((l_quantity, l_linenumber))[1] AS l_quantity, min((l_quantity, l_linenumber))[2] AS l_linenumber, count(*) AS copies, min((l_quantity, l_linenumber)) <> max((l_quantity, l_linenumber)) AS conflict FROM lineitem GROUP BY l_orderkey""")
def dedup_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.deduplicated(table(spark, d, "lineitem"), ["l_orderkey"], ["l_quantity", "l_linenumber"])


@query("""SELECT role, count(*) AS n_turns, CAST(sum(length(text)) AS BIGINT) AS tokens, CAST(sum(CAST(length(text) AS DECIMAL(18,2))) AS DOUBLE) AS cost, count(*) FILTER (length(text) > 400) AS n_truncated, max(length(text)) AS largest_tokens,
    max_by(conv_id, (length(text), -conv_id, -turn)) AS largest_conv_id, max_by(turn, (length(text), -conv_id, -turn)) AS largest_turn FROM conversations GROUP BY role""")
def protocol_ledger(spark: SparkSession, d: str) -> DataFrame:
    turns = steps(spark, d).withColumns({"tokens": F.length("text").cast("long"), "cost": F.length("text").cast("decimal(18,2)")})
    return ledger.protocol_ledger(turns, ["role"], "tokens", "cost", F.col("tokens") > 400, ["conv_id", "turn"]).withColumn("cost", F.col("cost").cast("double"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, round_even(l_quantity * 1.25, 6) AS seconds, CAST(l_partkey AS DOUBLE) AS t FROM lineitem)
    SELECT l_orderkey, l_linenumber, seconds, round_even(seconds * 0.001261 * 2, 8) AS cost, round(t / nullif(seconds, 0), 4) AS tokens_per_second FROM c""")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "lineitem")
    c = ledger.gpu_cost(F.col("l_quantity") * 1.25, 0.001261, F.lit(2), F.lit(0), F.col("l_partkey"))
    return items.select("l_orderkey", "l_linenumber", c.alias("c")).select("l_orderkey", "l_linenumber", "c.seconds", "c.cost", F.round("c.tokens_per_second", 4).alias("tokens_per_second"))


# --- texts


_LEX = ", ".join("('{}', [{}])".format(f, ", ".join(f"'{w}'" for w in ws)) for f, ws in LEXICON.items())
_RATES = f"""w AS (SELECT lang, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), x(family, terms) AS (VALUES {_LEX}),
    r AS (SELECT lang, family, sum(len(list_filter(w, lambda y: list_contains(terms, y)))) AS hits, sum(len(w)) AS tokens FROM w CROSS JOIN x GROUP BY lang, family)"""


@query(f"WITH {_RATES} SELECT lang, family, CAST(hits AS BIGINT) AS hits, CAST(tokens AS BIGINT) AS tokens, round(10000.0 * CAST(hits AS DOUBLE) / nullif(tokens, 0), 6) AS rate FROM r")
def lexicon_rates(spark: SparkSession, d: str) -> DataFrame:
    return text.lexicon_rates(table(spark, d, "documents"), ["lang"], "text", LEXICON)


@query(f"""WITH {_RATES}, q AS (SELECT lang, family, round(10000.0 * CAST(hits AS DOUBLE) / nullif(tokens, 0), 6) AS rate FROM r)
    SELECT family, max(rate) FILTER (lang = 'fr') AS low, max(rate) FILTER (lang = 'en') AS high, round(max(rate) FILTER (lang = 'en') - max(rate) FILTER (lang = 'fr'), 6) AS difference,
           round(max(rate) FILTER (lang = 'en') / nullif(max(rate) FILTER (lang = 'fr'), 0), 6) AS ratio, max(rate) FILTER (lang = 'en') > max(rate) FILTER (lang = 'fr') AS higher FROM q GROUP BY family""")
def rate_comparison(spark: SparkSession, d: str) -> DataFrame:
    rates = text.lexicon_rates(table(spark, d, "documents"), ["lang"], "text", LEXICON)
    return rounded(text.rate_comparison(rates, ["family"], "lang", "fr", "en"), "difference", "ratio")


@query("SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT) AS n FROM documents")
def payload_occurrences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.occurrences(F.col("text"), F.lit("th")).alias("n"))


@query("SELECT item_id, list_transform(regexp_extract_all('see option a, OPTION 2 or optional B ' || text, '(?i)\\boption\\s+([AB12])\\b', 1), lambda x: upper(x)) AS options FROM benchmark")
def option_mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", text.option_mentions(F.concat(F.lit("see option a, OPTION 2 or optional B "), "text")).alias("options"))


@query("""SELECT page_id, list_transform(regexp_extract_all('go to ' || url || '. Or (' || url || ')', '(https?://[^\\s<>"'']+)', 1), lambda u: regexp_replace(u, '[.,;:!?)\\]}]+$', '')) AS urls FROM pages""")
def url_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", text.urls(F.concat(F.lit("go to "), "url", F.lit(". Or ("), "url", F.lit(")"))).alias("urls"))


@query("""SELECT conv_id, turn, form, CASE form WHEN 0 THEN 'a ' || text || '</think>b' WHEN 1 THEN ltrim(text, chr(10) || ' ') || ' <think> y' WHEN 3 THEN 'q<think> ' || rtrim(text, chr(10) || ' ') WHEN 4 THEN '' END AS thinking,
           CASE form WHEN 0 THEN role WHEN 2 THEN trim(text, chr(10) || chr(9) || ' ') WHEN 4 THEN role ELSE '' END AS final, CASE WHEN form IN (0, 3, 4) THEN true WHEN form = 1 THEN false END AS complete
    FROM conversations CROSS JOIN range(6) AS f(form)""")
def block_split(spark: SparkSession, d: str) -> DataFrame:
    """Marks in six forms around every text: two closing marks, none, no marks at all, two opening marks, a closing mark
    alone, and nothing."""
    t = F.col("text")
    forms = [
        F.concat(F.lit("<think>a "), t, F.lit("</think>b</think> "), "role", F.lit("\n")), F.concat(F.lit("x <think>\n"), t, F.lit(" <think> y")), F.concat(F.lit("  "), t, F.lit("\t")),
        F.concat(F.lit("p <think>q<think> "), t, F.lit("\n</think>")), F.concat(F.lit("</think>"), "role"), F.lit(""),
    ]
    rows = steps(spark, d).select("conv_id", "turn", F.posexplode(F.array(*forms)).alias("form", "t"))
    return rows.select("conv_id", "turn", F.col("form").cast("long").alias("form"), text.split_thinking(F.col("t")).alias("s")).select("conv_id", "turn", "form", "s.*")


@query("""WITH b(i, block, code) AS (VALUES (0, '{"name": " call ", "arguments": {"step": {"n": 1}}}', NULL), (1, 'no json', 'invalid_tool_call_json'), (2, '[1]', 'tool_call_must_be_object'), (3, '{"name": " ", "arguments": {}}', 'missing_tool_name'),
        (4, '{"name": 7, "arguments": {}}', 'missing_tool_name'), (5, '{"name": "call", "arguments": "x"}', 'tool_arguments_must_be_object'), (6, '{"name": "call"}', 'tool_arguments_must_be_object'), (7, '{"name": "other", "arguments": {}}', NULL)),
    u AS (SELECT conv_id, turn, i, code, block, length(text) % 8 AS first, (length(text) // 8) % 8 AS second, turn % 2 = 0 AS open FROM conversations CROSS JOIN b),
    e AS (SELECT conv_id, turn, code, block, 0 AS place FROM u WHERE i = first UNION ALL SELECT conv_id, turn, code, block, 1 FROM u WHERE i = second)
    SELECT conv_id, turn, coalesce(string_agg(CASE WHEN code IS NULL THEN CASE WHEN block LIKE '%other%' THEN 'other:{}:false' ELSE 'call:{"step":{"n":1}}:true' END END, ' ' ORDER BY place), '') AS calls,
           concat_ws(' ', CASE WHEN turn % 2 = 0 THEN 'unbalanced_tool_call_tags' END, string_agg(code || '@' || place, ' ' ORDER BY place)) AS errors FROM e GROUP BY conv_id, turn""")
def tool_call_parse(spark: SparkSession, d: str) -> DataFrame:
    """Two of eight blocks in each turn's text, and an opening tag too many in every other one."""
    blocks = ['{"name": " call ", "arguments": {"step": {"n": 1}}}', "no json", "[1]", '{"name": " ", "arguments": {}}', '{"name": 7, "arguments": {}}', '{"name": "call", "arguments": "x"}', '{"name": "call"}', '{"name": "other", "arguments": {}}']
    block = lambda i: F.concat(F.lit("<tool_call>\n "), F.element_at(F.array(*[F.lit(b) for b in blocks]), (i + 1).cast("int")), F.lit(" </tool_call>"))
    size = F.length("text")
    made = F.concat(F.lit("a "), block(size % 8), F.lit(" b "), block(F.floor(size / 8) % 8), F.when(F.col("turn") % 2 == 0, " <tool_call> c").otherwise(""))
    c = steps(spark, d).select("conv_id", "turn", text.tool_calls(made, ["call"]).alias("c"))
    calls = F.transform("c.calls", lambda x: F.concat_ws(":", x["name"], x["arguments"], x["recognized"].cast("string")))
    errors = F.transform("c.errors", lambda x: F.concat_ws("@", x["code"], x["index"].cast("string")))
    return c.select("conv_id", "turn", F.array_join(calls, " ").alias("calls"), F.array_join(errors, " ").alias("errors"))


_COLLAPSED = "trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"SELECT doc_id, length({_COLLAPSED}) AS n, sha256(text) AS digest FROM documents")
def collapsed_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(text.collapse_space(F.col("text"))).cast("long").alias("n"), hashing.text_sha256(F.col("text")).alias("digest"))


@query("""SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) AS rendered FROM conversations GROUP BY conv_id""")
def rendered_prompts(spark: SparkSession, d: str) -> DataFrame:
    messages = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return steps(spark, d).groupBy("conv_id").agg(messages.alias("m")).select("conv_id", text.render_messages(F.col("m")).alias("rendered"))


@query("""WITH c AS (SELECT doc_id, text AS t, trim(regexp_replace(text, '[^A-Za-z0-9._-]+', '-', 'g'), '-_.') AS c FROM documents)
    SELECT doc_id, CASE WHEN length(c) <= 63 THEN c ELSE rtrim(left(c, 52), '-_.') || '-' || left(sha256(t), 10) END AS tag FROM c WHERE c <> ''""")
def tag_values(spark: SparkSession, d: str) -> DataFrame:
    """Tags of whole texts that have a letter, digit or another sign that may stand in one."""
    return table(spark, d, "documents").where(F.rlike("text", F.lit("[A-Za-z0-9]"))).select("doc_id", text.tag_value(F.col("text")).alias("tag"))


@query("""WITH c AS (SELECT doc_id, text, left(text, CAST(doc_id % 50 AS INT)) || '[inserted]' || substr(text, CAST(doc_id % 50 AS INT) + 1) AS changed FROM documents),
    p AS (SELECT *, list_max(list_filter(range(0, 80), lambda n: n <= length(text) AND left(text, CAST(n AS INT)) = left(changed, CAST(n AS INT)))) AS position FROM c)
    SELECT doc_id, CAST(position AS INT) AS position, substr(changed, CAST(position + 1 AS INT), 10) AS inserted, left(changed, CAST(position AS INT)) || substr(changed, CAST(position + 11 AS INT)) = text AS single FROM p""")
def insertion_diff(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    changed = text.spliced(F.col("text"), (F.col("doc_id") % 50).cast("int"), F.lit("[inserted]"))
    return docs.select("doc_id", text.single_insertion(F.col("text"), changed).alias("i")).select("doc_id", "i.*")


# --- vectors


@query("""WITH v AS (SELECT vec_id // 2 AS pair, vec_id % 2 AS side, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    j AS (SELECT a.pair, a.e AS a, b.e AS b FROM v a JOIN v b USING (pair) WHERE a.side = 0 AND b.side = 1)
    SELECT pair, round(sqrt(list_dot_product(a, a)), 5) AS norm_a, round(list_distance(a, b), 5) AS diff, round(list_distance(a, b) / ((sqrt(list_dot_product(a, a)) + sqrt(list_dot_product(b, b))) / 2), 5) AS relative,
           round(list_cosine_similarity(a, b), 5) AS cosine FROM j""")
def vector_pair_distance(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).cast("string").alias("side"), "embedding")
    p = pairs.paired(v, ["pair"], "side", "0", "1", ["embedding"]).where("status = 'complete'")
    out = p.select("pair", vectors.distance(F.col("embedding_low"), F.col("embedding_high")).alias("x")).select("pair", "x.norm_a", "x.diff", "x.relative", "x.cosine")
    return rounded(out, "norm_a", "diff", "relative", "cosine", places=5)


@query("""WITH c AS (SELECT vec_id % 9 AS grp, label >= 5 AS p, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings),
    m AS (SELECT grp, i, avg(x) FILTER (p) - avg(x) FILTER (NOT p) AS m FROM c GROUP BY grp, i) SELECT grp, round(sqrt(sum(m * m)), 5) AS norm, count(*) AS n_dims FROM m GROUP BY grp""")
def diff_in_means_norm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(vectors.mean_difference(vector_rows(spark, d), ["grp"], "embedding", F.col("label") == 1), "norm", places=5)


@query("""WITH v AS (SELECT vec_id % 9 AS grp, (label >= 5)::INT AS label, row_number() OVER (PARTITION BY vec_id % 9, label >= 5 ORDER BY vec_id) AS pair_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
    SELECT a.grp, a.pair_id, round(list_distance(a.e, b.e), 5) AS norm FROM v a JOIN v b USING (grp, pair_id) WHERE a.label = 1 AND b.label = 0""")
def contrast_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = pairs.contrast(vector_rows(spark, d), ["grp", "pair_id"], "label", "embedding")
    return rounded(out.select("grp", "pair_id", vectors.norm(F.col("difference")).alias("norm")), "norm", places=5)


def layered(spark: SparkSession, d: str) -> DataFrame:
    """Vectors in two modes, of two agents and at two layers, the second of which carries more of the label."""
    v = vector_rows(spark, d).withColumns({"mode": F.when(F.floor(F.col("vec_id") / 9) % 2 == 0, "off").otherwise("on"), "agent": F.when(F.floor(F.col("vec_id") / 18) % 2 == 0, "worker_1").otherwise("executor_1")})
    layers = F.explode(F.array(F.lit(32), F.lit(40))).alias("layer")
    shifted = F.transform("embedding", lambda x: x.cast("double") + F.when(F.col("layer") == 40, F.col("label") * 0.2).otherwise(0.0))
    rows = v.select("vec_id", "grp", "label", "mode", "agent", "embedding", layers).withColumn("embedding", shifted)
    return rows.withColumn("pair", F.concat_ws("-", F.col("grp").cast("string"), F.row_number().over(Window.partitionBy("mode", "agent", "layer", "grp", "label").orderBy("vec_id")).cast("string")))


@query()
def probe_scores_logo(spark: SparkSession, d: str) -> DataFrame:
    """Held-out scores for every mode, agent, layer and group by two probes."""
    scored = probes.scored_layers(layered(spark, d), ["mode", "agent", "layer"], "grp", "vec_id", "label", "embedding", ["logistic", "contrast"], "pair")
    return rounded(scored.select("vec_id", "mode", "agent", "layer", "grp", "label", "probe_name", "score"), "score")


@query()
def layer_scan_refits(spark: SparkSession, d: str) -> DataFrame:
    """A probe for every mode, agent and layer; the strata of a mode whose labels are all alike are skipped."""
    one_class = layered(spark, d).where("mode = 'on'").withColumns({"mode": F.lit("one_class"), "label": F.lit(1)})
    out = probes.layer_scan(layered(spark, d).unionByName(one_class), ["mode", "agent"], "layer", "grp", "vec_id", "label", "embedding", ["logistic", "contrast"], "pair")
    return rounded(out, "pooled_auroc", "mean_auroc", "sd_auroc", "min_auroc", "max_auroc", places=4)


@query()
def hold_out_probes(spark: SparkSession, d: str) -> DataFrame:
    """Two probes of every mode and layer on the 30 % of the vectors that they did not see."""
    from wayline.operators import runs

    out = runs.hold_out_evaluation(layered(spark, d).drop("pair"), ["mode", "layer"], "vec_id", "label", "embedding")
    return rounded(out, "auroc", "brier", "accuracy", "ece", "mce", places=4)


@query()
def cohort_refits(spark: SparkSession, d: str) -> DataFrame:
    out = probes.cohort_refits(vector_rows(spark, d), {"all": list(range(9)), "seven": list(range(7)), "odd": [1, 3, 5, 7]}, "grp", "vec_id", "label", "embedding")
    return rounded(out, "pooled_auroc", "mean_auroc", "sd_auroc", "min_auroc", "max_auroc", places=4)


@query()
def baseline_probes(spark: SparkSession, d: str) -> DataFrame:
    v = layered(spark, d).withColumn("pair", F.concat_ws("-", "mode", F.col("grp").cast("string"), F.floor(F.col("vec_id") / 36).cast("string")))
    out = probes.baselines(v, ["mode", "layer"], "grp", "pair", "vec_id", "label", "embedding")
    return rounded(out, "pooled_auroc", "mean_auroc", "sd_auroc", "min_auroc", "max_auroc", "accuracy", places=4)


@query()
def contrast_pair_lat(spark: SparkSession, d: str) -> DataFrame:
    v = vector_rows(spark, d).withColumns({"layer": F.lit(0), "pair": F.concat_ws("-", F.col("grp").cast("string"), F.col("pair_id").cast("string"))})
    models = probes.fitted(v, ["layer"], "grp", "vec_id", "label", "embedding", "contrast", "pair")
    scored = probes.held_out_scores(v, models, ["layer"], "grp", "embedding")
    return rounded(metrics.fold_summary(scored, ["layer"], "grp"), "pooled_auroc", "mean_auroc", "sd_auroc", "min_auroc", "max_auroc", places=4)


@query()
def residual_probe(spark: SparkSession, d: str) -> DataFrame:
    v = vector_rows(spark, d).withColumn("layer", F.lit(0))
    models = probes.fitted(v, ["layer"], "grp", "vec_id", "label", "embedding", "centroid", residual=True)
    return rounded(metrics.fold_summary(probes.held_out_scores(v, models, ["layer"], "grp", "embedding"), ["layer"], "grp"), "pooled_auroc", "mean_auroc", "sd_auroc", "min_auroc", "max_auroc", places=4)


#: Rows that each of the refits under permuted labels uses; all rows are permuted and scored.
REFIT_ROWS = 400


@query()
def permutation_null(spark: SparkSession, d: str) -> DataFrame:
    v = vector_rows(spark, d).select("vec_id", "grp", "label", "embedding")
    samples = nulls.permutation_null(v, "grp", "vec_id", "label", "embedding", 999, "logistic", max_rows=REFIT_ROWS)
    one = v.withColumn("layer", F.lit(0))
    models = probes.fit_leaving_out(one, ["layer"], "grp", "vec_id", "label", "embedding", "logistic", max_rows=REFIT_ROWS)
    seen = metrics.fold_summary(probes.held_out_scores(one, models, ["layer"], "grp", "embedding"), ["layer"], "grp").select(F.col("mean_auroc").alias("observed"))
    return rounded(resample.null_summary(samples, seen, [], "mean_auroc", "observed"), "mean", "sd", "q025", "q50", "q975", "p", places=4)


# --- labels and reviews


@query("SELECT doc_id, CASE WHEN quality IS DISTINCT FROM toxic THEN 'score' ELSE '' END AS differing, 2 AS n_slots FROM labels")
def reviewer_disagreement(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "labels").select("doc_id", F.explode(F.array(F.struct(F.lit(1).alias("slot"), F.col("quality").alias("score")), F.struct(F.lit(2).alias("slot"), F.col("toxic").alias("score")))).alias("r"))
    out = review.disagreements(r.select("doc_id", "r.slot", "r.score"), ["doc_id"], "slot", ["score"])
    return out.select("doc_id", F.array_join("differing", ",").alias("differing"), "n_slots")


@query("SELECT conv_id, turn, chr(CAST(64 + row_number() OVER (PARTITION BY conv_id ORDER BY sha256(conv_id || '|' || turn), turn) AS INT)) AS sample FROM conversations")
def blind_order(spark: SparkSession, d: str) -> DataFrame:
    return review.blind_order(steps(spark, d), ["conv_id"], "turn").select("conv_id", "turn", "sample")


@query("SELECT source, lang, unnest([1, 2]) AS reviewer_slot, CAST(NULL AS VARCHAR) AS verdict FROM (SELECT DISTINCT source, lang FROM documents)")
def blank_review_forms(spark: SparkSession, d: str) -> DataFrame:
    return review.blank_forms(table(spark, d, "documents").select("source", "lang").distinct(), ["verdict"])


@query("SELECT lang, count(*) AS n, sha256(string_agg(DISTINCT source, chr(10) ORDER BY source)) AS ids_sha256 FROM documents GROUP BY lang")
def id_set_digest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), hashing.id_set_sha256("source").alias("ids_sha256"))


@query("""WITH r AS (SELECT l_returnflag AS flag, sha256('{"l_comment":' || coalesce('"' || l_returnflag || '"', 'null') || ',"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || '}') AS h FROM lineitem),
    s AS (SELECT flag, count(*) AS n, [sum(('0x' || substr(h, 1, 16))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 17, 16))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 33, 16))::UBIGINT::HUGEINT), sum(('0x' || substr(h, 49, 16))::UBIGINT::HUGEINT)] AS x FROM r GROUP BY flag)
    SELECT flag, n, sha256(n || ':' || array_to_string([(v % 18446744073709551616::HUGEINT)::VARCHAR FOR v IN x], ':')) AS table_sha256 FROM s""")
def table_digest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumns({"flag": F.col("l_returnflag"), "l_comment": F.col("l_returnflag")})
    return hashing.table_sha256(rows, ["flag"], ["l_orderkey", "l_linenumber", "l_comment"])


# --- resampling

REPLICATES = 1000
_WEIGHTS = f"""c AS (SELECT lang, source, row_number() OVER (PARTITION BY lang ORDER BY source) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM (SELECT DISTINCT lang, source FROM p)),
    k AS (SELECT lang, r AS replicate, ('0x' || left(sha256('0:' || r || ':' || q.i), 8))::UBIGINT % n AS i FROM range({REPLICATES}) t(r) CROSS JOIN c q),
    w AS (SELECT lang, replicate, source, count(*) AS weight FROM k JOIN c USING (lang, i) GROUP BY ALL),
    u AS (SELECT lang, x.source AS a, y.source AS b, sum(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END)::DOUBLE AS won, count(*) AS pairs FROM p x JOIN p y USING (lang) WHERE x.label = 1 AND y.label = 0 GROUP BY ALL),
    b AS (SELECT lang, replicate, sum(wx.weight * wy.weight * won) / sum(wx.weight * wy.weight * pairs) AS auroc FROM u JOIN w wx USING (lang) JOIN w wy USING (lang, replicate) WHERE wx.source = u.a AND wy.source = u.b GROUP BY ALL)"""


@query(f"WITH {P}, {_WEIGHTS} SELECT lang, count(auroc) AS n, {snapped_sql('quantile_cont(auroc, 0.025)')} AS low, {snapped_sql('quantile_cont(auroc, 0.975)')} AS high FROM b GROUP BY lang")
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of each language's AUROC, sources being drawn from those of the language."""
    samples = resample.bootstrap_auroc(predictions(spark, d), ["lang"], "source", REPLICATES).where("auroc IS NOT NULL")
    return snapped(resample.interval(samples, ["lang"], "auroc"), "low", "high")


@query(f"""WITH {P}, c AS (SELECT lang, source, count(*) FILTER (label = 1) AS n1 FROM p WHERE label IS NOT NULL GROUP BY ALL),
    x AS (SELECT lang, r AS replicate, score, (row_number() OVER (PARTITION BY lang, source, r ORDER BY sha256('0:' || r || ':' || doc_id), doc_id) <= n1)::INT AS y FROM p JOIN c USING (lang, source) CROSS JOIN range({REPLICATES}) t(r) WHERE label IS NOT NULL),
    k AS (SELECT lang, score, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2 AS place FROM p WHERE label IS NOT NULL),
    b AS (SELECT lang, replicate, (sum(place) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auroc FROM x JOIN (SELECT DISTINCT * FROM k) USING (lang, score) GROUP BY ALL), o AS ({_pairs_sql('lang')})
    SELECT lang, count(b.auroc) AS n, {snapped_sql('avg(b.auroc)')} AS mean, {snapped_sql('stddev_pop(b.auroc)')} AS sd, {snapped_sql('quantile_cont(b.auroc, 0.5)')} AS q50, {snapped_sql('quantile_cont(b.auroc, 0.975)')} AS q975,
    count(*) FILTER (round(b.auroc, 9) >= round(o.auroc, 9)) AS n_reaching, {snapped_sql('(count(*) FILTER (round(b.auroc, 9) >= round(o.auroc, 9)) + 1) / (count(b.auroc) + 1)')} AS p FROM b LEFT JOIN o USING (lang) GROUP BY lang""")
def null_summary(spark: SparkSession, d: str) -> DataFrame:
    """Each language's AUROC against those under labels permuted within its sources."""
    p = predictions(spark, d)
    samples = rounded(nulls.permuted_auroc(p, ["lang"], "source", "doc_id", REPLICATES), "auroc", places=9)
    seen = rounded(metrics.auroc(p, ["lang"]).select("lang", F.col("auroc").alias("seen")), "seen", places=9)
    return snapped(resample.null_summary(samples, seen, ["lang"], "auroc", "seen").drop("q025"), "mean", "sd", "q50", "q975", "p")


@query()
def row_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """Intervals of each language's AUROC when single rows are drawn."""
    samples = resample.row_bootstrap_auroc(predictions(spark, d), ["lang"], REPLICATES)
    return snapped(resample.interval(samples, ["lang"], "auroc"), "low", "high")


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def stream_event_windows(spark: SparkSession, d: str) -> DataFrame:
    from wayline.streaming.ingest import event_stream, windowed, written

    stream = windowed(event_stream(spark, d, "events.parquet"), "1 hour", ["event_type"])
    return rounded(written(stream, "windows"), "total", places=4)
