"""The thin queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casefile.llm import conversation_trie, fill_middle, packing, piece_codec, quality_cnn, quality_rules, secrets, sharding, simhash, suffix_index, url_templates, vector_dedup, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


#: The rules of the URL filter, as (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path: good if of quality and not toxic."""
    pages = _table(spark, sf_dir, "pages")
    number = F.regexp_extract(url_templates.path_of(F.col("url")), r"/([0-9]{1,18})(?:\.html)?/?$", 1).try_cast("long")
    good = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("number"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    labels = pages.select(F.col("page_id").alias("id"), number.alias("number")).join(good, "number").select("id", "good")
    return url_templates.url_verdicts(pages, URL_RULES, labels).withColumnRenamed("id", "page_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharding.sharded(_table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id").withColumn("law", F.lit("key"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = piece_codec.tokenized(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))
    return found.withColumnRenamed("id", "doc_id")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))


def good_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.quality_verdicts(_table(spark, sf_dir, "documents"), good_labels(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_cnn.quality_scores(_table(spark, sf_dir, "documents"), quality_labels(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = secrets.scanned(docs, secrets.chain_of(docs))
    return found.select(F.col("id").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where this machine keeps a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())
    return found.withColumnRenamed("id", "doc_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_middle.transformed(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def op12_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_index.passages_removed(_table(spark, sf_dir, "documents"))
    lost = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", lost.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
            op1_warc, op2_simhash_near_dedup, op3_url_filters, op4_quality_classifier, op5_sharding, op6_secret_scans, op7_sentencepiece, op8_embedding_near_dedup, op9_quality_rules, op10_best_fit_packing, op11_fill_in_middle,
            op12_suffix_array_dedup, op13_conversation_trie,
        )}


#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
        ), f AS (
          SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 AND page_id IS NOT NULL GROUP BY d
        )
        SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
               CASE WHEN f.first_id < p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN f.first_id < p.page_id THEN f.first_id END AS refers_to
        FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
    """,
    "op8_embedding_near_dedup": """
        WITH RECURSIVE v AS (
          SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93
        ), r(a, b) AS (
          SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
        )
        SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.c AS component_id,
               e.vec_id = m.c AS kept
        FROM embeddings e JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) m ON m.a = e.vec_id
    """,
    # CRC-32 bit by bit over the text's bytes; list_reduce folds each text in order
    "op5_sharding": """
        WITH RECURSIVE k(i, c, n) AS (
          SELECT i, i, 0 FROM range(256) t(i)
          UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM k WHERE n < 8
        ), crc AS (SELECT list(c ORDER BY i) AS t FROM k WHERE n = 8),
        h AS (
          SELECT doc_id, strlen(coalesce(text, '')) + 8 AS size, hex(encode(coalesce(text, ''))) AS x,
                 list_transform(range(0, 25), lambda s: ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)) AS bids
          FROM documents
        ), d AS (
          SELECT doc_id, size::BIGINT AS size,
                 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)),
                                 lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32,
                 list_position(list_slice(bids, 1, 24), list_max(list_slice(bids, 1, 24))) - 1 AS shard,
                 list_position(bids, list_max(bids)) - 1 AS grown_shard
          FROM h, crc
        )
        SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
               row_number() OVER (PARTITION BY shard ORDER BY substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 3), doc_id, text_crc32, size) - 1 AS slot,
               grown_shard::INT AS grown_shard
        FROM d
    """,
    "op11_fill_in_middle": r"""
        WITH d AS (
          SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x,
                 regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
          FROM documents
        ), h AS (
          SELECT *, len(u) AS n, [('0x' || substr(x, 1 + 8 * i, 8))::BIGINT for i in range(0, 4)] AS h,
                 contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR t = '' AS bare
          FROM d
        ), c AS (
          SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                 CASE WHEN bare OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
          FROM h
        ), p AS (
          SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM c
        )
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                                WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM p
    """,
    # windows as hexadecimal digits; a removed run starts where no removed window starts in the 50 bytes before
    "op12_suffix_array_dedup": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
        c AS (SELECT doc_id, k, substr(x, 400 * k + 1, 498) AS y FROM (SELECT doc_id, x, unnest(range(0, (n - 50) // 200 + 1)) AS k FROM d WHERE n >= 50)),
        w AS (
          SELECT doc_id, 200 * k + i AS i, md5(substr(y, 2 * i + 1, 100)) AS v FROM (SELECT *, unnest(range(0, least(200, length(y) // 2 - 49))) AS i FROM c)
        ), f AS (SELECT v, min(doc_id) AS first_id FROM w GROUP BY v),
        r AS (SELECT doc_id, i FROM w JOIN f USING (v) WHERE first_id < doc_id),
        g AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -51) > 50 AS fresh FROM r),
        s AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
        p AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS b FROM s GROUP BY doc_id, k),
        q AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM p),
        m AS (SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, list({'a': before, 'b': a} ORDER BY a) AS parts FROM q GROUP BY doc_id)
        SELECT d.doc_id, d.n::BIGINT AS n_bytes, coalesce(m.n_removed, 0)::BIGINT AS n_removed, coalesce(m.n_spans, 0)::BIGINT AS n_spans,
               sha256(unhex(coalesce(array_to_string(list_transform(m.parts, lambda s: substr(d.x, 2 * s.a + 1, 2 * (s.b - s.a))), ''), '')
                            || substr(d.x, 2 * coalesce(m.last, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN m USING (doc_id)
    """,
    # a prefix is spelled out; each node adds to all prefixes of its smallest member
    "op13_conversation_trie": r"""
        WITH RECURSIVE k(i, c, n) AS (
          SELECT i, i, 0 FROM range(256) t(i)
          UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n + 1 FROM k WHERE n < 8
        ), crc AS (SELECT list(c ORDER BY i) AS t FROM k WHERE n = 8),
        o AS (
          SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
          FROM conversations WHERE conv_id IS NOT NULL
        ), v AS (
          SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, [unicode(x)::BIGINT for x in string_split(c::VARCHAR, '')]),
                                    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) % 4 AS h
          FROM (SELECT DISTINCT c FROM o), crc
        ), s AS (
          SELECT v.c, o.pos, o.role, o.text FROM v JOIN o ON o.c = v.c - ((v.c % 20) + 20) % 20 AND o.pos <= v.h
          UNION ALL SELECT v.c, o.pos + 4, o.role, o.text FROM v JOIN o ON o.c = v.c AND o.pos > v.h
        ), q AS (
          SELECT c, row_number() OVER w AS depth, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w AS key,
                 len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
          FROM s WINDOW w AS (PARTITION BY c ORDER BY pos ROWS UNBOUNDED PRECEDING)
          UNION ALL SELECT c, 0, '', 0 FROM v
        ), r AS (
          SELECT *, coalesce(lag(key) OVER (PARTITION BY c ORDER BY depth), '') AS up, depth = max(depth) OVER (PARTITION BY c) AS last FROM q
        ), n AS (
          SELECT key, any_value(depth) AS depth, any_value(up) AS up, min(c) AS c, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS own,
                 sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends_sha256
          FROM r GROUP BY key
        ), kids AS (SELECT up AS key, count(*) AS n FROM n WHERE depth > 0 GROUP BY up),
        below AS (
          SELECT r.key, sum(n.own) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
          FROM n LEFT JOIN kids ON kids.key = n.key JOIN r ON r.c = n.c AND r.depth <= n.depth GROUP BY r.key
        )
        SELECT n.c AS conv_id, n.depth::BIGINT AS depth, p.c AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
               below.leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM n JOIN below ON below.key = n.key LEFT JOIN kids ON kids.key = n.key LEFT JOIN n p ON p.key = n.up AND n.depth > 0
    """,
}
