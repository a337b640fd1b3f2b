"""The queries of the training-data operators, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echolake.llm import alignment, chat, decontaminate, filter_audit, langid, lm_scoring, mtree, near_dedup, packing, quality, toxicity, vector_packing, warc
from echolake.llm.base import table

TARGET_SOURCE = "src1"  # the target domain of op3
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op1_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolve(table(spark, sf_dir, "pages")).drop("target_uri")


def op2_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", "predicted")


def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(table(spark, sf_dir, "documents"), F.col("source") == TARGET_SOURCE)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], conversations.schema)
    return chat.write_and_read(conversations.union(control))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", "predicted")


def op7_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op8_mtree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(table(spark, sf_dir, "embeddings"))


def op9_langid_ftrl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op10_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components_of(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_packing.pack_documents(table(spark, sf_dir, "documents"), packing.tokenizer_path())


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), packing.tokenizer_path(), alignment.piece_path())


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(h, {1 + 10 * (i // 8)}, 10))::UBIGINT >> {35 - 5 * (i % 8)}) & 31 AS INTEGER) + 1, 1)" for i in range(32)
)

_LOWER = "translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_SQL = {
    "op1_warc_revisit": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
             f AS (SELECT page_id, h, strlen(html) AS payload_bytes, min(page_id) OVER (PARTITION BY html) AS original FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {_DIGITS} AS payload_digest,
               CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = original THEN NULL ELSE original END AS refers_to
        FROM f""",
    "op4_decontaminate": f"""
        WITH dw AS (SELECT doc_id, {_ALNUM.format(t="coalesce(text, '')")} AS w FROM documents),
             bw AS (SELECT item_id, {_ALNUM.format(t="text")} AS w FROM benchmark WHERE text IS NOT NULL),
             win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS x
                     FROM (SELECT item_id, w, least(13, len(w)) AS n FROM bw WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(i)),
             pos AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS x
                     FROM (SELECT doc_id, w, n FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n), unnest(range(1, len(w) - n + 2)) AS t(i)),
             hit AS (SELECT DISTINCT doc_id, i, n, item_id FROM pos JOIN win USING (n, x)),
             h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
             it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
                    FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM dw LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op5_prefix_targets": f"""
        WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'),
             s AS (SELECT *, 24 + length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&#10;'))
                          + length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS n FROM c),
             r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS reached,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end FROM s)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(reached) FILTER (role = 'assistant' OR from_end = 1) AS BIGINT) AS formatted_chars
        FROM r GROUP BY conv_id""",
    "op10_lsh_forest": f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format(t="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             s AS (SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')))
                                       WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM w),
             u AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
             l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id
                   GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
             e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
             r(id, c) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.id, e.b FROM r JOIN e ON r.c = e.a)
        SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(c) AS component_id, doc_id = min(c) AS kept FROM s JOIN r ON r.id = doc_id GROUP BY doc_id, s""",
    "op11_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
             m AS (SELECT doc_id, part, CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
                          + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) AS INTEGER)
                          + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
                          + 16 * CAST(coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS INTEGER) AS mask FROM d),
             l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
             f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
             o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e
                   WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
             s AS (SELECT filter_order, k AS step, 1 << (ascii(filter_order[k]) - 65) AS bit,
                          coalesce(list_sum(list_transform(range(1, k), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0) AS earlier FROM o, range(1, 6) AS r(k)),
             c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY part, mask),
             e AS (SELECT part, filter_order, step, bit,
                          sum(n) FILTER (mask & (earlier | bit) = 0) AS kept, sum(n) FILTER (mask & earlier = 0 AND mask & bit <> 0) AS removed,
                          sum(n) FILTER (mask & earlier <> 0 AND mask & bit <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
                          sum(good) FILTER (mask & earlier = 0 AND mask & bit <> 0) AS good_lost, sum(toxic) FILTER (mask & earlier = 0 AND mask & bit <> 0) AS toxic_lost
                   FROM c, s GROUP BY part, filter_order, step, bit, earlier)
        SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
               CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
               CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
               CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
        FROM e""",
    "op8_mtree_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings),
             s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
                   FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
             r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
