"""The registered queries of this subpackage: each derives the columns of its contract from an operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


#: What the contract asks for of packed pieces.
_PACKED = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; if they are few, on all cores."""
    from wayline.llm.shared import spread

    return spread(table(spark, sf_dir, "documents"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.chat import chat_digests, format_chat

    told = "\\### Assistant: </turn> ok"
    more = spark.range(1).selectExpr("-7L AS conv_id", "posexplode(array('user', 'assistant')) AS (turn, role)").select(
        "conv_id", F.col("turn").cast("long").alias("turn"), "role", F.lit(told).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chat_digests(format_chat(turns))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.toxicity import toxicity

    scored = toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"))
    return scored.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


def op4_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.media import media_copies, pictures

    return media_copies(pictures(table(spark, sf_dir, "embeddings")))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.near_dedup import near_dedup

    return near_dedup(documents(spark, sf_dir), shingle=3, percent=85)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wayline.llm.packing import pack

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json")).select(*_PACKED)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.url_filter import url_filter

    return url_filter(table(spark, sf_dir, "pages")).drop("score")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.substring_dedup import substring_dedup

    return substring_dedup(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wayline.llm.pieces import encode_pieces

    made = encode_pieces(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep=True)
    return made.drop("pieces", "decoded")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from wayline.llm.prefix_bpe import encode_bpe

    made = encode_bpe(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.fill_middle import fill_in_middle, restored

    made = fill_in_middle(documents(spark, sf_dir))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored("output", "form")["text_sha256"].alias("restored_sha256"))


#: The amount column of each shop table that is erased from.
_AMOUNTS = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}


def op13_cascading_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wayline.llm.erasure import Link, erase, file_number, most_referenced, read_back, write_sorted
    from wayline.llm.shared import materialize
    from wayline.session import scratch

    folder = scratch(spark, "erasure")
    tables = {name: table(spark, sf_dir, name) for name in _AMOUNTS}
    owner = materialize(tables["sales"].where("sale_id IS NOT NULL").groupBy("sale_id").agg(F.min("client_id").alias("_client")), "owners")
    paths = {}
    for name, rows in tables.items():
        client, columns = "client_id", rows.columns
        if name == "sale_lines":
            client, rows = "_client", rows.join(owner, "sale_id", "left")
        if write_sorted(rows, F.crc32(F.coalesce(F.col(client).cast("string"), F.lit(""))), columns, f"{folder}/{name}"):
            paths[name] = f"{folder}/{name}"
    clients = tables["clients"]
    masters = clients.select("master_id").where("master_id IS NOT NULL AND crc32(CAST(master_id AS string)) % 200 = 0")
    forgotten = masters.unionByName(most_referenced(tables["clicks"], "client_id", clients, "master_id"))
    links = [Link("clicks", "client_id", "clients", "client_id"), Link("sales", "client_id", "clients", "client_id"), Link("sale_lines", "sale_id", "sales", "sale_id")]
    final = read_back(erase(spark, paths, "clients", forgotten, "master_id", links), _AMOUNTS)
    return final.select(
        file_number(F.col("path")).alias("file_no"), "n_rows", "n_erased", "cents", "rewritten", "table_name", "ids_sha256", "columns", F.regexp_replace("path", "^file:/+", "/").alias("path")
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir).select(*_PACKED)


def queries() -> dict[str, Query]:
    every = (
        pipeline, op1_chat_format, op2_warc, op3_toxicity, op4_media_copies, op5_exact_dedup, op6_near_dedup, op7_packing, op8_url_filter, op9_substring_dedup, op10_sentencepiece,
        op11_bpe, op12_fill_middle, op13_cascading_erasure,
    )
    return {f.__name__: f for f in every}


def _url_sql() -> str:
    from wayline.llm.url_filter import BUCKETS, plain_weights

    return f"""
        WITH w AS (SELECT {plain_weights()!r}::DOUBLE[] AS w),
        a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        b AS (SELECT *, list_transform(range(1, length(host || path) + 1), lambda i: unicode(substr(host || path, CAST(i AS BIGINT), 1))::BIGINT) AS b FROM h),
        g AS (SELECT *, list_transform(range(1, greatest(len(b) - 1, 1)), lambda i: (b[i] * 961 + b[i + 1] * 31 + b[i + 2]) % {BUCKETS} + 1) AS g FROM b),
        r AS (SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS rule_verdict
              FROM h JOIN (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                  ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')) AS v(rule, rh, rp, verdict)
                ON (host = rh OR suffix(host, '.' || rh)) AND prefix(path, rp) GROUP BY page_id)
        SELECT page_id, host, path, rule,
               coalesce(rule_verdict, CASE WHEN w[1] + coalesce(list_sum(list_transform(g, lambda x: w[x + 1])), 0) >= 0 THEN 'block' ELSE 'allow' END) AS verdict
        FROM g CROSS JOIN w LEFT JOIN r USING (page_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "op8_url_filter": _url_sql(),
        "op1_chat_format": """
            WITH t AS (
                SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'),
            f AS (
                SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text), '') AS state, '### ' || CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'Assistant' WHEN 'tool' THEN 'Tool'
                       ELSE '@' || role END || ': ' || replace(replace(replace(text, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\e') || ' </turn>' || chr(10) AS line
                FROM t)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   CAST(sum(length(line)) AS BIGINT) AS formatted_chars,
                   bool_and((state, role) IN (('', 'system'), ('', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user'), ('assistant', 'tool'), ('tool', 'assistant'))) AS valid
            FROM f GROUP BY conv_id""",
        "op2_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages)
            SELECT page_id, strlen(t) AS payload_bytes,
                   list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5))::INT >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), 'string_agg', '') AS payload_digest,
                   CASE WHEN page_id = max(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
                   CASE WHEN page_id < max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
            FROM p WINDOW w AS (PARTITION BY t)""",
        "op6_near_dedup": """
            WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
            s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                                                 ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w),
            n AS (SELECT doc_id, count(s.s) AS n FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id),
            c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
            l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)),
            r AS (SELECT doc_id, doc_id AS to_id FROM documents UNION SELECT l.b, r.to_id FROM r JOIN l ON l.a = r.doc_id)
            SELECT doc_id, n AS n_shingles, min(to_id) AS component_id, doc_id = min(to_id) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id, n""",
        "op9_substring_dedup": """
            WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS w FROM documents),
            i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
            v AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS h FROM i),
            f AS (SELECT h, min(doc_id) AS first_id FROM v GROUP BY h),
            c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM v JOIN f USING (h) WHERE first_id < doc_id),
            t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w),
            k AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS kept FROM t ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
            SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n_kept, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)""",
        "op12_fill_middle": """
            WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
            s AS (SELECT *, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
            c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM s),
            p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
                   sha256(t) AS restored_sha256
            FROM p""",
        "op5_exact_dedup": """
            WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g') AS t FROM documents)
            SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM n WINDOW w AS (PARTITION BY t)""",
    }
