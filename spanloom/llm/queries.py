"""The operators' queries over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media, mixing, packing, quality, secret_scan, sharding, simhash, topk, warc


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_read(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(50)) == 0)


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.round_trip(_read(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), vocabulary())


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_exact_topk, op3_media_columns, op4_warc, op5_simhash, op6_mixing, op7_quality, op8_language_id, op9_packing, op10_sharding)}

SQL = {
    "op2_exact_topk": """
        WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
        SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS low FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN low < page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN low < page_id THEN low END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op6_mixing": r"""
        WITH d AS (SELECT doc_id, source,
                     CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
                     ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 15))::BIGINT * 8 AS key
                   FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
        o AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER] AS w FROM s),
        c AS (SELECT *, 3 * source_size AS cap, (3 * source_size)::DOUBLE / w AS ratio FROM o),
        l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER p, 0))::DOUBLE / (sum(w) OVER () - coalesce(sum(w) OVER p, 0))::DOUBLE AS level
              FROM c WINDOW p AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT level AS final FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
        t AS (SELECT source, source_size, least(cap::DOUBLE, w * final) AS target FROM l, f),
        b AS (SELECT d.*, source_size, target, least(round(target)::BIGINT, 3 * source_size) AS budget,
                coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               (CASE WHEN source_size > 0 THEN budget // source_size * size + greatest(0, least(size, budget - budget // source_size * source_size - before)) ELSE 0 END)::BIGINT AS taken
        FROM b""",
    # CRC-32 by its table over the bytes of each text; the map's moves one by one.
    "op10_sharding": r"""
        WITH RECURSIVE poly AS (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) AS c FROM range(256) r(i))),
        d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        rec AS (SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || text), 1, 15))::BIGINT AS key,
            xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
              lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM d, poly),
        vs AS (SELECT *, ((key + row_number() OVER (PARTITION BY key, doc_id, size, text_crc32) - 1) % 4096)::INT AS virtual_slot FROM rec),
        load AS (SELECT list(coalesce(b, 0) ORDER BY s) AS load FROM range(4096) r(s) LEFT JOIN (SELECT virtual_slot, sum(size)::BIGINT AS b FROM vs GROUP BY 1) ON virtual_slot = s),
        m AS (SELECT 0 AS step, list_transform(range(4096), lambda s: s * 8 // 4096) AS place, false AS ended UNION ALL
            SELECT step + 1, CASE WHEN move IS NULL THEN place ELSE list_transform(place, lambda x, i: CASE WHEN i = move.slot THEN bare ELSE x END) END, move IS NULL
            FROM (SELECT *, list_min(list_transform(list_filter(range(1, 4097), lambda i: place[i] = most AND load[i] > 0 AND load[i] < gap), lambda i: struct_pack(d := abs(2 * load[i] - gap), slot := i))) AS move
              FROM (SELECT *, list_position(totals, list_max(totals)) - 1 AS most, list_position(totals, list_min(totals)) - 1 AS bare, list_max(totals) - list_min(totals) AS gap
                FROM (SELECT step, place, load, list_transform(range(8), lambda s: list_sum(list_transform(load, lambda b, i: CASE WHEN place[i] = s THEN b ELSE 0 END))::BIGINT) AS totals FROM m, load WHERE NOT ended)))),
        done AS (SELECT place FROM m WHERE ended),
        out AS (SELECT vs.*, place[virtual_slot + 1]::INT AS shard FROM vs, done)
        SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY virtual_slot, key, doc_id, size, text_crc32) - 1 AS slot, NULL::INT AS grown_shard, virtual_slot, 2 AS map_version FROM out""",
}
