"""Registered queries of rule sets over records that the driver tables' rows make: what is broken, their ids and texts decide,
and the SQL finds it from these again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators import validators
from wayline.plans.frames import table
from wayline.plans.registry import query


def _retrieval(place: Column, ids: Column, documents: Column, status: Column) -> Column:
    """A retrieval whose ids stand in one of eight places, or in its documents under one of three names, or nowhere."""
    none = F.lit(None).cast("array<string>")
    fields = lambda base: [F.when(place == base + i, ids).otherwise(none).alias(n) for i, n in enumerate(validators.ID_FIELDS)]
    text = F.lit(None).cast("string")
    named = F.transform(documents, lambda d: F.struct(F.when(place == 8, d).otherwise(F.lit("")).alias("id"), F.when(place == 9, d).otherwise(text).alias("document_id"), F.when(place == 10, d).otherwise(text).alias("doc_id")))
    output = F.struct(*fields(4), F.when(place.between(8, 11), named).alias("documents"))
    return F.struct(F.lit("retrieve_papers").alias("tool"), F.lit("q").alias("input"), status.alias("status"), text.alias("safety_label"), F.lit(None).cast("boolean").alias("unsafe"), *fields(0), output.alias("output"))


@query("""SELECT conv_id, turn, CASE (conv_id + turn) % 13 WHEN 11 THEN '' WHEN 12 THEN '' ELSE 'd' || conv_id || ',' || 'e' || turn END AS ids, CASE WHEN (conv_id + turn) % 13 < 11 THEN 2 ELSE 0 END AS n FROM conversations""")
def retrieval_places(spark: SparkSession, d: str) -> DataFrame:
    """Ids of retrievals, one for each turn, in all the places where they may stand."""
    c = table(spark, d, "conversations").withColumn("place", ((F.col("conv_id") + F.col("turn")) % 13).cast("int"))
    ids = F.array(F.concat(F.lit("d"), F.col("conv_id").cast("string")), F.concat(F.lit("e"), F.col("turn").cast("string")))
    found = validators.retrieved_ids(_retrieval(F.col("place"), ids, ids, F.lit("executed")))
    return c.select("conv_id", "turn", F.array_join(found, ",").alias("ids"), F.size(found).alias("n"))


def run_records(spark: SparkSession, d: str) -> DataFrame:
    """A run's records for each conversation, whose first and last texts are the planner's and the executor's output. In
    some the first two records are written in the other order, lack an id or a status, or have a label too early."""
    texts = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("a"), F.max(F.struct("turn", "text")).alias("b")).select(F.col("conv_id").alias("c"), F.col("a.text").alias("first"), F.col("b.text").alias("last"))
    c = F.col("c")
    node = lambda names: F.array(*[F.struct(F.lit(i).alias("step_index"), F.lit(n).alias("node_id")) for i, n in enumerate(names)])
    steps = texts.withColumn("hop_mode", F.when(c % 2 == 0, "2-hop").otherwise("3-hop")).withColumn("n", F.explode(F.when(c % 2 == 0, node(validators.NODE_ORDER["2-hop"])).otherwise(node(validators.NODE_ORDER["3-hop"])))).select("*", "n.*")
    step, name = F.col("step_index"), F.col("node_id")
    last = name == "executor"
    ids = F.array(F.concat(F.lit("d"), c.cast("string")))
    call = _retrieval((c % 13).cast("int"), ids, ids, F.when(c % 5 != 1, "executed"))
    fields = {f.split(" ", 1)[0]: f.split(" ", 1)[1] for f in validators_fields()}
    told = {
        "trajectory_id": c.cast("string"), "step_index": step, "node_id": name, "role": name, "hop_mode": F.col("hop_mode"), "scenario_id": F.lit("s"), "condition": F.lit("clean"), "model": F.lit("m"), "token_position": F.when(c % 17 == 5, "mean").otherwise("last"),
        "input_context": F.array(F.struct(F.lit("user").alias("role"), F.lit("c").alias("content"))), "output_message": F.when(step == 0, F.col("first")).when(last, F.col("last")).otherwise("o"),
        "tool_calls": F.when(name == "worker", F.array(call)).otherwise(F.array()), "trajectory_label": F.when(last | ((step == 0) & (c % 11 == 4)), "clean"),
        "behavioral_sanity": F.when(last, F.struct(F.lit(True).alias("original_task_preserved"), F.lit(False).alias("injection_followed"), F.lit(False).alias("unsafe_action_attempted"), F.lit(False).alias("unsafe_action_executed"), F.array().cast("array<int>").alias("evidence_step_indices"))),
    }
    position = F.when((c % 7 == 3) & (step < 2), 1 - step).otherwise(step)
    return steps.select(position.alias("position"), *[told.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in fields.items()])


def validators_fields() -> list[str]:
    """The fields of a record with their types."""
    out, depth, field = [], 0, ""
    for ch in validators.RECORD + ",":
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(field.strip())
            field = ""
        else:
            field += ch
    return out


_HINTED = " OR ".join(f"contains(lower(t.last), '{h}')" for h in validators.HINTS)


@query(f"""WITH t AS (SELECT conv_id AS c, min((turn, text))[2] AS first, max((turn, text))[2] AS last FROM conversations GROUP BY 1),
    s AS (SELECT *, unnest(CASE WHEN c % 2 = 0 THEN ['planner', 'worker', 'executor'] ELSE ['planner', 'worker', 'worker2', 'executor'] END) AS node, unnest(CASE WHEN c % 2 = 0 THEN [0, 1, 2] ELSE [0, 1, 2, 3] END) AS i FROM t),
    e AS (SELECT c, CASE WHEN c % 7 = 3 AND i < 2 THEN 1 - i ELSE i END AS position, i, unnest([1, 2, 3, 4, 5]) AS k, unnest([
            CASE WHEN node = 'planner' AND trim(coalesce(first, '')) = '' OR node = 'executor' AND trim(coalesce(last, '')) = '' THEN 'output_message' END, CASE WHEN node = 'worker' AND c % 5 = 1 THEN 'call_field' END,
            CASE WHEN node = 'worker' AND c % 13 > 10 THEN 'retrieved_ids' END, CASE WHEN c % 17 = 5 THEN 'token_position' END, CASE WHEN node = 'planner' AND c % 11 = 4 THEN 'early_label' END]) AS code FROM s),
    r AS (SELECT c, string_agg(code || '@' || i, ' ' ORDER BY position, k) AS codes FROM e WHERE code IS NOT NULL GROUP BY c)
    SELECT CAST(t.c AS VARCHAR) AS trajectory_id, CASE WHEN t.c % 2 = 0 THEN 3 ELSE 4 END AS n_records, trim(CASE WHEN t.c % 7 = 3 THEN 'contiguous node_order ' ELSE '' END || coalesce(codes, '')) AS errors,
        CASE WHEN {_HINTED} THEN 'text_hint' ELSE '' END AS warnings, t.c % 7 <> 3 AND codes IS NULL AS accepted FROM t LEFT JOIN r USING (c)""")
def run_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """Acceptance of runs made of conversations, judged in the order in which their records are written."""
    out = validators.acceptance(run_records(spark, d), position="position")
    return out.select("trajectory_id", "n_records", F.array_join("errors", " ").alias("errors"), F.array_join("warnings", " ").alias("warnings"), "accepted")


#: Characters of a page, of a chunk, and how many chunks a document selects.
PAGE, CHUNK, CHOSEN = 600, 250, 2


@query(f"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, doc_id % 9 AS b, doc_id % 4 AS r FROM documents),
    k AS (SELECT *, [i * {CHUNK} FOR i IN range(0, CAST(ceil(n / {CHUNK}.0) AS BIGINT))] AS begins, CAST(ceil(n / {PAGE}.0) AS BIGINT) AS n_pages FROM d),
    p AS (SELECT *, [x FOR x IN begins IF (1 + x // {PAGE}) % 4 <> r] AS yes, [x FOR x IN begins IF (1 + x // {PAGE}) % 4 = r] AS no, len([x FOR x IN range(1, n_pages + 1) IF x % 4 = r]) AS n_gone FROM k),
    t AS (SELECT *, list_sum([least({CHUNK}, n - x) // 4 FOR x IN list_concat(yes[1:{CHOSEN}], CASE WHEN b = 2 THEN no[1:1] ELSE [] END)]) AS spent FROM p),
    u AS (SELECT *, greatest(coalesce(spent, 0), 1) - CASE WHEN b = 3 THEN 1 ELSE 0 END AS budget FROM t)
    SELECT doc_id, len(begins) AS n_chunks, len(yes) AS n_eligible, trim(CASE WHEN b = 5 THEN 'evidence_source ' ELSE '' END || CASE WHEN b = 6 AND n_gone > 0 THEN 'evidence_pages ' ELSE '' END || CASE WHEN b = 7 THEN 'evidence_unknown ' ELSE '' END
        || CASE WHEN b = 1 AND n_gone > 0 THEN 'evidence_summary ' WHEN b = 7 AND n_gone > 0 THEN 'evidence_summary ' ELSE '' END || CASE WHEN b = 8 THEN 'evidence_counts ' ELSE '' END || CASE WHEN b = 2 AND len(no) > 0 THEN 'evidence_chunk ' ELSE '' END
        || CASE WHEN b = 4 THEN 'pdf ' ELSE '' END || CASE WHEN budget < 1 THEN 'budgets ' WHEN coalesce(spent, 0) > budget THEN 'budget_each ' ELSE '' END) AS errors FROM u""")
def evidence_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of documents, the pages that they begin on, and a retrieval of the first two of them that lie on pages that may
    be evidence; every ninth document breaks one rule after another."""
    from wayline.operators import alignment

    c = F.col
    t = table(spark, d, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"), (c("doc_id") % 9).alias("b"), (c("doc_id") % 4).cast("int").alias("r"), c("doc_id").cast("string").alias("id"))
    every = lambda step: F.when(c("n") > 0, F.sequence(F.lit(0), c("n") - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    t = t.withColumns({"begins": every(CHUNK), "page_begins": every(PAGE)}).withColumn("page", alignment.pages_of(c("begins"), c("page_begins")))
    chunk = F.transform("begins", lambda x, i: F.struct(F.get("page", i).alias("page_number"), (F.floor(F.least(F.lit(CHUNK), c("n") - x) / 4)).cast("int").alias("token_count"), c("id").alias("doc_id")))
    t = t.withColumn("chunk", chunk).withColumns({"yes": F.filter("chunk", lambda x: x["page_number"] % 4 != c("r")), "no": F.filter("chunk", lambda x: x["page_number"] % 4 == c("r"))})
    numbers = F.transform("page_begins", lambda _, i: i + 1)
    gone = F.filter(numbers, lambda x: x % 4 == c("r"))
    entries = F.transform(gone, lambda x: F.struct(x.alias("page_number"), F.when(c("b") == 6, " ").otherwise("front matter").alias("reason")))
    t = t.withColumns({"gone": gone, "chosen": F.concat(F.slice("yes", 1, CHOSEN), F.when(c("b") == 2, F.slice("no", 1, 1)).otherwise(F.array()))})
    spent = F.aggregate("chosen", F.lit(0), lambda a, x: a + x["token_count"])
    budget = F.greatest(spent, F.lit(1)) - F.when(c("b") == 3, 1).otherwise(0)
    source = F.struct(
        c("id").alias("doc_id"), F.size("chunk").alias("candidate_chunk_count"), F.size("page_begins").alias("page_count"), numbers.alias("indexed_page_numbers"), F.when(c("b") == 1, F.slice("gone", 2, 1 << 20)).when(c("b") == 6, F.array()).otherwise(c("gone")).alias("non_evidence_page_numbers"),
        F.when(c("b") == 6, numbers).otherwise(F.array_except(numbers, "gone")).alias("evidence_eligible_page_numbers"), F.size("yes").alias("eligible_candidate_chunk_count"), F.size("no").alias("excluded_candidate_chunk_count"),
    )
    trace = F.struct(
        c("chosen").alias("selected_chunks"), F.size("chunk").alias("candidate_chunk_count"), (F.size("yes") + F.when(c("b") == 8, 1).otherwise(0)).alias("eligible_candidate_chunk_count"), F.size("no").alias("excluded_candidate_chunk_count"), F.array(source).alias("source_documents"),
        F.struct(F.when(c("b") != 5, "clean_source_section_type").alias("determined_from"), F.lit(True).alias("all_pages_remain_indexed"), F.create_map(F.when(c("b") == 7, "nobody").otherwise(c("id")), entries).alias("non_evidence_pages")).alias("evidence_eligibility"),
        F.create_map(c("id"), budget).alias("document_token_budgets"), F.lit(1 << 30).alias("document_token_budget"), F.lit(True).alias("source_pdf_verification_required"), F.struct(F.when(c("b") == 4, "pending").otherwise("verified").alias("status")).alias("source_pdf_verification"),
    )
    rows = t.select("doc_id", F.size("chunk").alias("n_chunks"), F.size("yes").alias("n_eligible"), trace.alias("trace"), F.array(F.struct(c("id").alias("doc_id"))).alias("documents"))
    errors = validators.broken(alignment.evidence_rules(c("trace"), c("documents")))
    return rows.select("doc_id", "n_chunks", "n_eligible", F.array_join(errors, " ").alias("errors"))


@query("""WITH w AS (SELECT conv_id, turn, coalesce(text, '') AS t, string_split(coalesce(text, ''), ' ') AS w FROM conversations),
    k AS (SELECT *, (conv_id * 3 + turn) % len(w) AS k, (conv_id * 7 + turn) % 8 AS b FROM w),
    i AS (SELECT *, w[k + 1] || coalesce(' ' || w[k + 2], '') AS x, least(k + 2, len(w)) AS last, coalesce(list_sum([length(v) + 1 FOR v IN w[1:k]]), 0) AS pos FROM k),
    o AS (SELECT *, x <> '' AND length(t) - length(replace(t, x, '')) = length(x) AND strpos(t, x) = pos + 1 AND NOT (w[k + 1] = '' OR x LIKE '% ') AS once FROM i)
    SELECT conv_id, turn, once, CASE WHEN once THEN k END AS start_token, CASE WHEN once THEN last END AS end_token, trim(CASE WHEN b = 4 THEN 'presence ' ELSE '' END || CASE WHEN b = 3 THEN 'prompt_hash ' ELSE '' END || CASE WHEN b = 5 THEN 'convention ' ELSE '' END
        || CASE WHEN b = 1 AND once THEN 'char_span ' ELSE '' END || CASE WHEN b = 2 AND once AND last + 1 > len(w) THEN 'token_span ' ELSE '' END || CASE WHEN b = 2 AND once THEN 'token_cover ' ELSE '' END) AS errors FROM o""")
def token_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Two words of each turn as injected text, where they stand there once, aligned with the turn's words as tokens; some
    alignments are then changed in one field."""
    from wayline.operators import alignment

    c = F.col
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("rendered_input")).withColumn("w", F.split("rendered_input", " ", -1))
    begins = F.transform("w", lambda _, i: F.aggregate(F.slice("w", F.lit(1), i), F.lit(0), lambda a, v: a + F.length(v) + 1))
    rows = rows.withColumns({"begins": begins, "k": ((c("conv_id") * 3 + c("turn")) % F.size("w")).cast("int"), "b": (c("conv_id") * 7 + c("turn")) % 8}).withColumn("ends", F.zip_with("begins", "w", lambda a, v: a + F.length(v)))
    first = F.get("w", c("k"))
    text = F.concat(first, F.coalesce(F.concat(F.lit(" "), F.get("w", c("k") + 1)), F.lit("")))
    once = (text != "") & (F.length("rendered_input") - F.length(F.replace("rendered_input", text, F.lit(""))) == F.length(text)) & (F.position(text, c("rendered_input")) == F.get("begins", c("k")) + 1) & (first != "") & ~F.endswith(text, F.lit(" "))
    rows = rows.withColumns({"injection_text": F.when(once, text), "raw_poison_exposed": once, "tokenizer_name": F.lit("words"), "tokenizer_revision": F.lit("1"), "input_token_ids": F.transform("w", lambda _, i: i), "rendered_input_sha256": F.sha2("rendered_input", 256)})
    made = alignment.injection_alignment(c("rendered_input"), c("injection_text"), c("begins"), c("ends"), c("tokenizer_name"), c("tokenizer_revision"))
    rows = rows.withColumn("told", made)
    a = c("told")
    changed = (
        F.when((c("b") == 1) & c("raw_poison_exposed"), a.withField("char_span.start_char", a["char_span"]["start_char"] + 1)).when((c("b") == 2) & c("raw_poison_exposed"), a.withField("injection_token_span.end_token", a["injection_token_span"]["end_token"] + 1))
        .when(c("b") == 3, a.withField("rendered_prompt_hash", F.lit("x"))).when(c("b") == 4, a.withField("injection_present_in_prompt", ~c("raw_poison_exposed"))).when(c("b") == 5, a.withField("span_convention", F.lit("closed"))).otherwise(a)
    )
    judged = rows.withColumn("token_alignment", changed).withColumn("key", F.struct("conv_id", "turn", "raw_poison_exposed", "told"))
    span = c("key.told.injection_token_span")
    return alignment.result_violations(judged, "key").select("key.conv_id", "key.turn", c("key.raw_poison_exposed").alias("once"), span["start_token"].alias("start_token"), span["end_token"].alias("end_token"), F.array_join("errors", " ").alias("errors"))


_RUN = """r AS (SELECT conv_id, conv_id % 9 AS domain, min((turn, coalesce(text, '')))[2] AS t, count(*) AS n_turns FROM conversations GROUP BY 1),
    x AS (SELECT *, regexp_extract(t, '^[^ ]+') AS w FROM r), y AS (SELECT *, w <> '' AND length(t) - length(replace(t, w, '')) = length(w) AS once FROM x)"""


def _domain_runs(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as runs of nine domains, the first word of the first text as what was put into it."""
    from wayline.operators import packet

    texts = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))).alias("a"), F.count("*").alias("n_turns"))
    rows = texts.select("conv_id", (F.col("conv_id") % 9).alias("domain"), F.col("a.t").alias("t"), "n_turns").withColumn("w", F.regexp_extract("t", "^[^ ]+", 0))
    return rows.withColumn("position", packet.injected_position(F.col("t"), F.col("w")))


@query(f"""WITH {_RUN} SELECT conv_id, domain, count(*) OVER v AS place, CAST(coalesce(sum(n_turns) OVER v, 0) AS BIGINT) AS n_turns_before, CASE WHEN once THEN 0 END AS start_char, CASE WHEN once THEN round(length(w) / 2 / length(t), 6) END AS normalized FROM y
    WINDOW v AS (PARTITION BY domain ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def design_positions(spark: SparkSession, d: str) -> DataFrame:
    """Each run's place in its domain, the turns of the runs before it, and where the word stands in its prompt."""
    from wayline.operators import packet

    out = packet.prefix_sums(_domain_runs(spark, d), ["domain"], "conv_id", ["n_turns"], width=16)
    return out.select("conv_id", "domain", "place", "n_turns_before", F.col("position.start_char").alias("start_char"), F.round("position.normalized", 6).alias("normalized"))


@query(f"""WITH {_RUN}, p AS (SELECT *, unnest([1, 2]) AS slot FROM y), l AS (SELECT domain, slot, conv_id, '{{"conv_id":' || conv_id || ',"domain":' || domain || ',"n_turns":' || n_turns || ',"reviewer_slot":' || slot || ',"w_sha256":"' || sha256(w) || '"}}' AS line FROM p)
    SELECT domain, slot AS reviewer_slot, count(*) AS n, sha256('[' || string_agg(line, ',' ORDER BY conv_id) || ']') AS rows_sha256, count(*) FILTER (conv_id % 5 = 1) AS n_broken FROM l GROUP BY 1, 2""")
def review_packet(spark: SparkSession, d: str) -> DataFrame:
    """Digests of both reviewers' rows of each domain, and the seals that are broken where every fifth run's count was changed."""
    from wayline.operators import packet

    runs = _domain_runs(spark, d).withColumn("w_sha256", F.sha2("w", 256))
    made = packet.packet(runs, ["conv_id", "domain"], ["n_turns", "w_sha256"], ["verdict"])
    digests = packet.packet_digest(made, ["conv_id"], ["conv_id", "domain", "n_turns", "reviewer_slot", "w_sha256"], ["domain", "reviewer_slot"])
    changed = made.withColumn("n_turns", F.when(F.col("conv_id") % 5 == 1, F.col("n_turns") + 1).otherwise(F.col("n_turns")))
    broken = packet.broken_seals(changed, ["conv_id", "domain"], ["n_turns", "w_sha256"]).groupBy("domain", "reviewer_slot").agg(F.count("*").alias("n_broken"))
    return digests.join(broken, ["domain", "reviewer_slot"], "left").withColumn("n_broken", F.coalesce("n_broken", F.lit(0).cast("long")))


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 2 + 1 AS slot FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, o_orderkey % 2 + 1 FROM orders WHERE o_orderkey % 33 = 1 AND o_orderkey % 5 <> 0), u AS (SELECT o_orderkey AS k, o_orderkey % 2 + 1 AS slot FROM orders WHERE o_orderkey % 7 <> 0),
    p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 11 <> 0), x AS (SELECT k, slot, count(*) AS nb FROM b GROUP BY ALL)
    SELECT k AS o_orderkey, slot, CASE WHEN coalesce(nb, 0) > 1 THEN 'repeated' WHEN nb IS NULL THEN 'blinded' WHEN uk IS NULL THEN 'unblinded' WHEN pk IS NULL THEN 'protocol' ELSE 'complete' END AS status
    FROM x FULL JOIN (SELECT k, slot, k AS uk FROM u) USING (k, slot) LEFT JOIN (SELECT k, k AS pk FROM p) USING (k)""")
def joined_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Orders as review cells, of which some forms and protocols are missing and some forms are there twice."""
    from wayline.operators import review

    k = F.col("o_orderkey")
    forms = table(spark, d, "orders").select("o_orderkey", (k % 2 + 1).alias("slot"), F.col("o_orderpriority").alias("verdict"))
    blinded = forms.where(k % 5 != 0)
    return review.joined_forms(blinded.unionByName(blinded.where(k % 33 == 1)), forms.where(k % 7 != 0), forms.where(k % 11 != 0).select("o_orderkey", F.col("verdict").alias("protocol")), ["o_orderkey"], "slot").select("o_orderkey", "slot", "status")


@query("""WITH a AS (SELECT p_partkey AS app, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_partkey % 9 <> 0 GROUP BY 1),
    h AS (SELECT l_partkey AS app, list_sort(list(DISTINCT l_returnflag)) AS files FROM lineitem WHERE l_partkey % 4 <> 0 GROUP BY 1)
    SELECT app, cost, coalesce(array_to_string(files, ','), '') AS files, CASE WHEN cost IS NULL THEN 'not billed' WHEN files IS NULL THEN 'unreferenced' ELSE 'referenced' END AS status FROM a FULL JOIN h USING (app)""")
def billing_references(spark: SparkSession, d: str) -> DataFrame:
    """Parts as billed apps, and return flags as the files that name them."""
    from wayline.operators import ledger

    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("app"), "l_returnflag", F.col("l_extendedprice").cast("decimal(18,2)").alias("cost"))
    apps = items.where("app % 9 <> 0").groupBy("app").agg(F.sum("cost").cast("double").alias("cost"))
    harvest = items.where("app % 4 <> 0").groupBy("app").agg(F.array_sort(F.collect_set("l_returnflag")).alias("files"))
    return ledger.referenced(apps, harvest, "app").withColumn("files", F.array_join("files", ","))


@query("""WITH s AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), c AS (SELECT lang, CASE WHEN max(doc_id % 3) > min(doc_id % 3) AND lang = 'de' THEN 'AMBIGUOUS' WHEN lang = 'de' THEN 'S' || max(doc_id % 3) ELSE 'PASS' END AS state FROM documents WHERE lang <> 'fr' GROUP BY lang)
    SELECT source, lang, n, coalesce(state, 'NOT AVAILABLE') AS state FROM s LEFT JOIN c USING (lang)""")
def annotated_strata(spark: SparkSession, d: str) -> DataFrame:
    """Sources of each language with the state of the language's control, which differs in one and lacks in another."""
    from wayline.operators import controls

    docs = table(spark, d, "documents")
    states = docs.where("lang <> 'fr'").select("lang", F.when(F.col("lang") == "de", F.concat(F.lit("S"), (F.col("doc_id") % 3).cast("string"))).otherwise("PASS").alias("state"))
    return controls.annotated(docs.groupBy("source", "lang").agg(F.count("*").alias("n")), states, ["lang"])


@query("""WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS t, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn, text), '') AS before, conv_id % 2 = 1 AS injected, ['planner_1', 'worker_1', 'worker_2', 'executor_1'][CAST(turn % 4 + 1 AS INT)] AS agent FROM conversations),
    u AS (SELECT *, CASE agent WHEN 'planner_1' THEN t WHEN 'worker_1' THEN 'Original task:' || chr(10) || t || chr(10) || chr(10) || 'Planner message:' || chr(10) || CASE WHEN before = '' THEN '<planner-output-provided-at-runtime>' ELSE before END || chr(10) || chr(10) || 'Retrieved documents:' || chr(10) || 'DOCUMENT d' || conv_id || ':' || chr(10) || t
        ELSE 'Original task:' || chr(10) || t || chr(10) || chr(10) || 'Upstream agent message:' || chr(10) || CASE WHEN before = '' THEN '<upstream-output-provided-at-runtime>' ELSE before END END AS content FROM m)
    SELECT conv_id, turn, mode AS thinking_mode, sha256(content) AS content_sha256, injected AND agent = 'worker_1' AS raw_poison_exposed, agent = 'executor_1' AS has_tools FROM u CROSS JOIN (VALUES ('on'), ('off')) v(mode)""")
def turn_requests(spark: SparkSession, d: str) -> DataFrame:
    """A request for every turn and mode: turns take the parts of the agents in order, and are told the turn before them."""
    from pyspark.sql import Window

    from wayline.operators import requests

    t = table(spark, d, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    names = F.array(*[F.lit(a) for a in ("planner_1", "worker_1", "worker_2", "executor_1")])
    turn = F.col("turn")
    rows = t.select(
        F.col("conv_id").cast("string").alias("trajectory_id"), turn.alias("step_index"), F.get(names, (turn % 4).cast("int")).alias("agent_id"), F.lit("worker").alias("agent_role"), turn.alias("hop_index"), F.lit("s").alias("system_prompt"), F.col("text").alias("user_message"),
        F.array(F.struct(F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("doc_id"), "text")).alias("retrieved"), F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn", "text")).alias("upstream_message"),
        (F.col("conv_id") % 2 == 1).alias("injection_present"), F.lit("bad").alias("injected_text"),
    )
    out = requests.request_plan(rows)
    return out.select(F.col("trajectory_id").cast("long").alias("conv_id"), F.col("step_index").alias("turn"), "thinking_mode", F.sha2(F.col("messages")[1]["content"], 256).alias("content_sha256"), "raw_poison_exposed", (F.size("tools") > 0).alias("has_tools"))


@query("""WITH l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) - 1 AS line, turn FROM conversations), v AS (SELECT *, (conv_id + line) % 7 AS b, CASE WHEN (conv_id + line) % 5 = 2 THEN line + 1 ELSE line END AS step FROM l)
    SELECT conv_id, line, CASE WHEN b = 3 THEN 'role,trust_mode' WHEN b = 4 THEN '' ELSE '' END AS missing, CASE WHEN b <> 4 THEN step END AS step, b <> 4 AS readable FROM v WHERE b IN (3, 4) OR step <> line""")
def logger_files(spark: SparkSession, d: str) -> DataFrame:
    """A logger's file for each conversation, a line for each turn; some lines lack fields, tell another step or are cut."""
    from pyspark.sql import Window

    from wayline.operators import requests

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text")) - 1
    rows = table(spark, d, "conversations").withColumn("line", place).withColumn("b", (F.col("conv_id") + F.col("line")) % 7)
    step = F.when((F.col("conv_id") + F.col("line")) % 5 == 2, F.col("line") + 1).otherwise(F.col("line"))
    record = lambda lacking: F.to_json(F.struct(*[(step if f == "step_index" else F.lit("x")).alias(f) for f in requests.LOGGED if f not in lacking]))
    text = F.when(F.col("b") == 3, record(("role", "trust_mode"))).when(F.col("b") == 4, F.lit("{cut")).otherwise(record(()))
    out = requests.logger_violations(rows.withColumn("record", text), "conv_id", "line", "record")
    return out.withColumn("missing", F.array_join("missing", ","))


@query("""WITH r AS (SELECT o_orderkey AS k, o_custkey % 50 AS g FROM orders)
    SELECT rule_id, n FROM (SELECT 'one_value:analysis_tier' AS rule_id, 1 AS n FROM r HAVING count(DISTINCT k % 101 = 0) > 1 UNION ALL SELECT 'design', count(DISTINCT g) FROM r WHERE g % 10 = 3 UNION ALL SELECT 'allowed:label', count(*) FROM r WHERE k % 23 = 0
        UNION ALL SELECT 'allowed:thinking_mode', count(*) FROM r WHERE k % 29 = 1 UNION ALL SELECT 'required', count(*) FROM r WHERE k % 31 = 2) WHERE n > 0""")
def index_design(spark: SparkSession, d: str) -> DataFrame:
    """Orders as rows of an activation index, some of which keep it from being scored."""
    from wayline.operators import requests

    k, g = F.col("o_orderkey"), F.col("o_custkey") % 50
    fixed = {"thinking_mode": F.when(k % 29 == 1, "maybe").when(k % 2 == 0, "on").otherwise("off"), "delegation_depth": F.lit("2-hop"), "treatment": F.lit("clean"), "match_group_id": g.cast("string"), "local_path": F.when(k % 31 != 2, "p")}
    rows = table(spark, d, "orders").select(k, F.when(k % 101 == 0, "other").alias("analysis_tier"), F.when(k % 23 != 0, (k % 2).cast("int")).alias("label"), *[fixed.get(f, F.lit("x")).alias(f) for f in requests.INDEXED])
    designs = table(spark, d, "orders").where(g % 10 != 3).select(g.cast("string").alias("match_group_id")).distinct()
    return requests.index_violations(rows, designs, ["o_orderkey"], "label").groupBy("rule_id").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT conv_id AS k, conv_id % 2 = 0 AS long, min((turn, coalesce(text, '')))[2] AS task, max((turn, coalesce(text, '')))[2] AS out FROM conversations GROUP BY 1),
    s AS (SELECT k, long, task, out, unnest(['planner', 'worker', 'worker2', 'executor']) AS node, unnest([0, 1, 2, 3]) AS i FROM r)
    SELECT k AS conv_id, node, CASE WHEN node = 'executor' AND NOT long THEN 2 ELSE i END AS place, sha256(CASE WHEN node = 'worker2' THEN 'Forwarded retrieved evidence to executor.' ELSE node || ':' || out END) AS said, CASE WHEN node = 'worker2' THEN 'indeterminate' END AS step_label,
        sha256(task || CASE WHEN node = 'worker2' THEN '|worker:' || out ELSE '' END) AS read FROM s WHERE node <> 'worker2' OR long""")
def legacy_steps(spark: SparkSession, d: str) -> DataFrame:
    """Three recorded steps of each conversation, and the place holder of the second worker in every other one."""
    from wayline.operators import records

    t = F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))
    runs = table(spark, d, "conversations").groupBy("conv_id").agg(F.min(t).alias("a"), F.max(t).alias("b"))
    node = F.explode(F.array(*[F.struct(F.lit(n).alias("node"), F.lit(i).alias("place")) for i, n in enumerate(("planner", "worker", "executor"))])).alias("n")
    rows = runs.select("conv_id", F.when(F.col("conv_id") % 2 == 0, "3-hop").otherwise("2-hop").alias("hop_mode"), F.col("a.t").alias("user_task"), F.col("b.t").alias("out"), node).select("*", "n.*")
    rows = rows.select("conv_id", "hop_mode", "user_task", "node", "place", F.concat("node", F.lit(":"), "out").alias("output_message"), F.lit(None).cast("string").alias("step_label"))
    out = records.with_second_worker(rows)
    read = F.array_join(F.transform("input_context", lambda m: m["content"]), "|")
    return out.select("conv_id", "node", "place", F.sha2("output_message", 256).alias("said"), "step_label", F.sha2(read, 256).alias("read"))
