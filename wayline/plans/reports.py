"""Registered queries on records, catalogues, controls and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions import hashing, text, vectors
from wayline.operators import controls, ledger, metrics, pairs, records, splits
from wayline.plans.frames import L, P, S, ledger_rows, predictions, steps, table
from wayline.plans.registry import _pairs_sql, query, rounded


@query(f"WITH {P} SELECT doc_id, lang, source, label FROM p WHERE lang = 'en' AND label = 1")
def filtered_index(spark: SparkSession, d: str) -> DataFrame:
    return records.where_equal(predictions(spark, d), lang="en", source=None, label=1).select("doc_id", "lang", "source", "label")


@query("SELECT conv_id, list_has_all(list(role), ['user', 'assistant', 'system']) AS complete FROM conversations GROUP BY conv_id")
def format_predicate(spark: SparkSession, d: str) -> DataFrame:
    per = steps(spark, d).groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return per.select("conv_id", records.has_all(F.col("roles"), ["user", "assistant", "system"]).alias("complete"))


@query(f"WITH {P} SELECT lang, source, count(*) AS n, CASE WHEN count(*) = 1 THEN min(doc_id) END AS doc_id FROM p WHERE toxic = 1 GROUP BY lang, source")
def exactly_one_lookup(spark: SparkSession, d: str) -> DataFrame:
    return records.exactly_one(predictions(spark, d).where("toxic = 1"), ["lang", "source"], ["doc_id"])


@query("""SELECT p_brand, count(*) AS n, min(p_size) AS p_size, string_agg(DISTINCT p_type, ';' ORDER BY p_type) AS p_types, min(p_size) = max(p_size) AS consistent FROM part GROUP BY p_brand""")
def artifact_catalog(spark: SparkSession, d: str) -> DataFrame:
    return records.catalog(table(spark, d, "part"), ["p_brand"], ["p_size"], ["p_type"])


@query(f"WITH {P} SELECT lang, count(*) FILTER (toxic = 0) AS n_0, count(*) FILTER (toxic = 1) AS n_1, count(*) FILTER (toxic = 2) AS n_2 FROM p GROUP BY lang")
def outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    return records.enum_counts(predictions(spark, d), ["lang"], "toxic", [0, 1, 2])


@query("SELECT o_custkey, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, min_by(o_orderstatus, (o_orderdate, o_orderkey)) AS o_orderstatus FROM orders GROUP BY o_custkey")
def first_row_dedup(spark: SparkSession, d: str) -> DataFrame:
    return records.first_rows(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus"])


@query("""WITH n AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2)
    SELECT p AS o_orderpriority, '{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}' AS counts FROM n GROUP BY p""")
def frequency_map(spark: SparkSession, d: str) -> DataFrame:
    return records.frequencies(table(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus").withColumn("counts", F.to_json("counts"))


@query(f"WITH {P} SELECT lang FROM p GROUP BY lang HAVING count(DISTINCT source) = (SELECT count(DISTINCT source) FROM p)")
def common_layers(spark: SparkSession, d: str) -> DataFrame:
    return records.shared_items(predictions(spark, d), "source", "lang")


@query(f"""WITH {P} SELECT lang, count(*) AS n_rows, count(DISTINCT source) AS n_groups, count(DISTINCT (source, hop)) AS n_cells, count(*) FILTER (label = 1) AS n_positive, count(*) FILTER (toxic = 1) AS n_toxic FROM p GROUP BY lang""")
def index_summary(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("lang").agg(
        F.count("*").alias("n_rows"), F.countDistinct("source").alias("n_groups"), F.countDistinct(F.struct("source", "hop")).alias("n_cells"), F.count_if(F.col("label") == 1).alias("n_positive"), F.count_if(F.col("toxic") == 1).alias("n_toxic")
    )


@query("""WITH f AS (SELECT user_id, event_type, min_by(event_id, (ts, event_id)) AS event_id, min_by(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
    n(event_type, node, place) AS (VALUES ('signup', 'planner', 0), ('view', 'worker_1', 1), ('purchase', 'executor_1', 2)), u AS (SELECT DISTINCT user_id FROM events)
    SELECT u.user_id, node, place, event_id, value FROM u CROSS JOIN n LEFT JOIN f ON f.user_id = u.user_id AND f.event_type = n.event_type""")
def normalized_events(spark: SparkSession, d: str) -> DataFrame:
    nodes = {"signup": "planner", "view": "worker_1", "purchase": "executor_1"}
    return records.normalized_steps(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"], nodes, ["event_id", "value"])


@query("""WITH c AS (SELECT conv_id, min(turn) = 0 AND max(turn) = count(*) - 1 AND count(DISTINCT turn) = count(*) AS contiguous, bool_or(role = 'assistant') AS answered, bool_and(length(text) > 0) AS filled, count(*) <= 6 AS short FROM conversations GROUP BY conv_id)
    SELECT conv_id, concat_ws(',', CASE WHEN NOT contiguous THEN 'contiguous' END, CASE WHEN NOT answered THEN 'answered' END, CASE WHEN NOT filled THEN 'filled' END, CASE WHEN NOT short THEN 'short' END) AS errors,
           contiguous AND answered AND filled AND short AS accepted FROM c""")
def acceptance_report(spark: SparkSession, d: str) -> DataFrame:
    n, turn = F.count("*"), F.col("turn")
    checks = {"contiguous": (F.min(turn) == 0) & (F.max(turn) == n - 1) & (F.countDistinct(turn) == n), "answered": F.bool_or(F.col("role") == "assistant"), "filled": F.bool_and(F.length("text") > 0), "short": n <= 6}
    return records.acceptance(steps(spark, d), "conv_id", checks).withColumn("errors", F.array_join("errors", ","))


@query("""SELECT n_nationkey, v AS variant, CAST(i AS INT) AS place, 'nation ' || n_nationkey || ' ' || v || ' ' || i AS prompt FROM nation CROSS JOIN (VALUES ('colluder', 0), ('colluder', 1), ('honest', 0), ('honest', 1)) AS t(v, i)""")
def scenario_prompts(spark: SparkSession, d: str) -> DataFrame:
    return records.scenario_prompts(table(spark, d, "nation"), "n_nationkey", {"colluder": 2, "honest": 2}, "nation %s %s %d")


@query("SELECT lang, mode, hop, lang || '/' || mode || '/' || hop AS request_id FROM (SELECT DISTINCT lang FROM documents) CROSS JOIN (VALUES ('off'), ('on')) AS m(mode) CROSS JOIN (VALUES ('2-hop'), ('3-hop')) AS h(hop)")
def request_plan(spark: SparkSession, d: str) -> DataFrame:
    cells = pairs.grid(table(spark, d, "documents").select("lang").distinct(), spark.createDataFrame([("off",), ("on",)], "mode string"), spark.createDataFrame([("2-hop",), ("3-hop",)], "hop string"))
    return cells.withColumn("request_id", F.concat_ws("/", "lang", "mode", "hop"))


@query("SELECT conv_id, turn, sha256(text) AS text_sha256, length(text) AS n_chars, CAST((length(text) - length(replace(text, 'the', ''))) / 3 AS BIGINT) AS n_hits FROM conversations")
def compact_turns(spark: SparkSession, d: str) -> DataFrame:
    return steps(spark, d).select("conv_id", "turn", hashing.text_sha256(F.col("text")).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), text.occurrences(F.col("text"), F.lit("the")).alias("n_hits"))


@query("SELECT conv_id, count(*) AS n_visible, string_agg(role || ':' || turn, ' ' ORDER BY turn) AS path FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def visible_turns(spark: SparkSession, d: str) -> DataFrame:
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda s: F.concat_ws(":", s["role"], s["turn"].cast("string"))), " ")
    return steps(spark, d).where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.count("*").alias("n_visible"), path.alias("path"))


@query(f"WITH {L}, r AS (SELECT app, resource, sum(cost) AS cost FROM l GROUP BY 1, 2), a AS (SELECT app, sum(cost) + (CASE WHEN app LIKE '1%' THEN 1 ELSE 0 END) AS total FROM l GROUP BY 1) SELECT app, round(CAST(total - sum(cost) AS DOUBLE), 6) AS gap FROM a JOIN r USING (app) GROUP BY app, total HAVING abs(total - sum(cost)) > 1e-8")
def ledger_imbalance(spark: SparkSession, d: str) -> DataFrame:
    rows = ledger_rows(spark, d)
    parts = rows.groupBy("app", "resource").agg(F.sum("cost").alias("cost"))
    totals = rows.groupBy("app").agg((F.sum("cost") + F.when(F.startswith("app", F.lit("1")), 1).otherwise(0)).alias("cost"))
    return ledger.imbalance(totals, parts, "app").select("app", F.round((F.col("total") - F.col("resources")).cast("double"), 6).alias("gap"))


_DISTANCES = """d AS (SELECT (a.vec_id // 2) % 9 AS grp, list_distance(a.e, b.e) / ((sqrt(list_dot_product(a.e, a.e)) + sqrt(list_dot_product(b.e, b.e))) / 2) AS relative, list_cosine_similarity(a.e, b.e) AS cosine
    FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0)"""


def _distances(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 2).alias("pair"), (F.col("vec_id") % 2).cast("string").alias("side"), "embedding")
    p = pairs.paired(v, ["pair"], "side", "0", "1", ["embedding"]).where("status = 'complete'")
    return p.select((F.col("pair") % 9).alias("grp"), vectors.distance(F.col("embedding_low"), F.col("embedding_high")).alias("x")).select("grp", "x.*")


@query(f"WITH {_DISTANCES} SELECT grp, count(*) AS n, round(avg(relative), 5) AS mean_relative, round(median(relative), 5) AS median_relative, round(max(relative), 5) AS max_relative, round(avg(cosine), 5) AS mean_cosine FROM d GROUP BY grp")
def propagation_profile(spark: SparkSession, d: str) -> DataFrame:
    return rounded(controls.profile(_distances(spark, d), ["grp"]), "mean_relative", "median_relative", "max_relative", "mean_cosine", places=5)


@query(f"WITH {_DISTANCES} SELECT grp, count(*) AS n, bool_and(relative < 1.6) AS near, bool_and(cosine > -0.5) AS aligned, bool_and(relative < 1.6) AND bool_and(cosine > -0.5) AS passed FROM d GROUP BY grp")
def strict_control(spark: SparkSession, d: str) -> DataFrame:
    return controls.strict(_distances(spark, d), ["grp"], {"near": F.col("relative") < 1.6, "aligned": F.col("cosine") > -0.5})


@query(f"WITH {_DISTANCES} SELECT grp, count(*) AS n, count(*) FILTER (relative < 1.3) AS n_near, count(*) FILTER (cosine > 0) AS n_aligned FROM d GROUP BY grp")
def stochastic_control(spark: SparkSession, d: str) -> DataFrame:
    return controls.counted(_distances(spark, d), ["grp"], {"near": F.col("relative") < 1.3, "aligned": F.col("cosine") > 0})


@query(f"""WITH {P}, a AS ({_pairs_sql('lang, source')}), l AS (SELECT DISTINCT lang FROM p), m AS (SELECT lang, max(auroc) AS largest, first(source ORDER BY auroc DESC, source) AS strongest FROM a GROUP BY lang)
    SELECT lang, strongest, round(largest, 6) AS largest, CASE WHEN largest IS NULL THEN 'NOT AVAILABLE' WHEN largest >= 0.75 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM l LEFT JOIN m USING (lang)""")
def negative_control(spark: SparkSession, d: str) -> DataFrame:
    return rounded(controls.negative_control(metrics.auroc(predictions(spark, d), ["lang", "source"]), ["lang"], "source"), "largest")


@query(f"""WITH {P}, g AS (SELECT lang, hop, source, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM p GROUP BY 1, 2, 3),
    f AS (SELECT lang, hop, p, n, sum(p) OVER w - p AS lp, sum(n) OVER w - n AS ln FROM g WINDOW w AS (PARTITION BY lang, hop)),
    r AS (SELECT lang, hop, CASE WHEN sum(p) = 0 OR sum(n) = 0 THEN 'single_class' WHEN count(*) < 2 THEN 'too_few_groups' WHEN min(least(lp, ln)) = 0 THEN 'fold_lacks_class' END AS reason FROM f GROUP BY lang, hop),
    a AS ({_pairs_sql('lang, hop')}) SELECT lang, hop, reason, CASE WHEN reason IS NULL THEN 'completed' ELSE 'skipped' END AS status, CASE WHEN reason IS NULL THEN round(auroc, 6) END AS auroc FROM r LEFT JOIN a USING (lang, hop)""")
def stratum_readiness(spark: SparkSession, d: str) -> DataFrame:
    p = predictions(spark, d)
    scan = splits.fold_skips(p, ["lang", "hop"], "source", "label").join(metrics.auroc(p, ["lang", "hop"]).select("lang", "hop", "auroc"), ["lang", "hop"], "left")
    done = F.col("reason").isNull()
    return scan.select("lang", "hop", "reason", F.when(done, "completed").otherwise("skipped").alias("status"), F.when(done, F.round("auroc", 6)).alias("auroc"))


@query(f"""WITH {S}, c AS (SELECT conv_id, max(turn) AS last, min(turn) FILTER (role = 'assistant') AS anchor FROM s GROUP BY conv_id)
    SELECT conv_id, anchor, round(anchor / nullif(last, 0), 6) AS position FROM c""")
def normalized_position(spark: SparkSession, d: str) -> DataFrame:
    per = steps(spark, d).groupBy("conv_id").agg(F.max("turn").alias("last"), F.min(F.when(F.col("role") == "assistant", F.col("turn"))).alias("anchor"))
    return per.select("conv_id", "anchor", F.round(F.try_divide("anchor", "last"), 6).alias("position"))


@query(f"""WITH {P}, c(cohort, source) AS (VALUES ('ten', 'src1'), ('ten', 'src10'), ('ten', 'src11'), ('two', 'src2'), ('two', 'src3')), q AS (SELECT cohort, p.* FROM p JOIN c USING (source)),
    a AS (SELECT cohort, avg(CASE WHEN x.score > y.score THEN 1.0 WHEN x.score = y.score THEN 0.5 ELSE 0.0 END) AS auroc FROM q x JOIN q y USING (cohort) WHERE x.label = 1 AND y.label = 0 GROUP BY cohort)
    SELECT cohort, count(*) AS n, round(max(auroc), 6) AS auroc FROM q LEFT JOIN a USING (cohort) GROUP BY cohort""")
def cohort_ablation(spark: SparkSession, d: str) -> DataFrame:
    rows = pairs.membership(predictions(spark, d), {"ten": ["src1", "src10", "src11"], "two": ["src2", "src3"]}, "source")
    return rounded(metrics.auroc(rows, ["cohort"]).select("cohort", (F.col("n_pos") + F.col("n_neg")).alias("n"), "auroc"), "auroc")
