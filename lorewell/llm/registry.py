"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.llm import decontamination, language_id, lm_scoring, near_dedup, quality, segmentation, sharding, substring_dedup, topk_search, warc
from lorewell.llm.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(_table(spark, sf_dir, "embeddings"))


SHARD_BYTES = 1 << 20


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), limit=SHARD_BYTES)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = segmentation.sample_segmentations(_table(spark, sf_dir, "documents"))
    digests = [F.sha2("pieces", 256).alias("pieces_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]
    return samples.select("doc_id", "sample", "n_pieces", "log_prob", "inclusion", *digests, "exact")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    ids = F.concat_ws(",", F.array_sort(F.transform("items", lambda x: x.cast("string"))))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(_table(spark, sf_dir, "pages"), shared_dir(spark) + "/warc")
    records = warc.read_warc(manifest).where("record_type <> 'damaged'")
    return records.select(warc.page_id("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_id("refers_to_id").alias("refers_to"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_lm_scoring, op2_topk_search, op3_sharding, op4_quality, op5_segmentation, op6_decontamination, op7_warc, op8_near_dedup, op9_substring_dedup, op10_language_id)}

SQL: dict[str, str] = {
    "op2_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0)
        SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score FROM s
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10""",
    "op3_sharding": f"""
        WITH d AS (
            SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
            FROM documents),
        c AS (
            SELECT depth, h >> (60 - depth) AS p, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows, min(h) AS lo, max(h) AS hi
            FROM d, (SELECT unnest(range(0, 61)) AS depth) GROUP BY 1, 2),
        leaf AS (
            SELECT h, min(depth) AS depth FROM (SELECT DISTINCT h FROM d) JOIN c ON h >> (60 - depth) = p
            WHERE shard_bytes <= {SHARD_BYTES} OR lo = hi GROUP BY h)
        SELECT doc_id, n_bytes, substr(format('{{:060b}}', d.h), 1, leaf.depth) AS shard, leaf.depth::INTEGER AS depth, shard_bytes,
            shard_rows::BIGINT AS shard_rows, shard_bytes > {SHARD_BYTES} AS oversized
        FROM d JOIN leaf USING (h) JOIN c ON c.depth = leaf.depth AND c.p = d.h >> (60 - leaf.depth)""",
    "op6_decontamination": r"""
        WITH w AS (
            SELECT doc_id, row_number() OVER () AS r,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        win AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS s
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        dw AS (
            SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
        m AS (SELECT r, i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.s = win.s),
        hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
        it AS (
            SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
            FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM m) GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM w LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""",
    "op9_substring_dedup": r"""
        WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (
            SELECT r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s
            FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50)),
        dup AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS first FROM win) WHERE doc_id > first),
        gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM dup),
        words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w),
        kept AS (SELECT r, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
        n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN n USING (r) LEFT JOIN kept USING (r)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS least FROM p)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                (((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1), 1)), '') AS payload_digest,
            CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN page_id <> least THEN least END AS refers_to
        FROM f""",
}
