"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottomk, bpe, chat, langid, mixing, sharding, simhash, tiff, training_order, warc
from ._common import table


def word_vocabulary() -> str:
    """Path of the public word-level vocabulary, read by the driver."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.hamming_components(table(spark, sf_dir, "documents"), shingle_words=4, max_bits=4)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: What a user turn asks of the tool that answers it.
REPLY_SCHEMA = {"reply": {"text": ("string", True), "turn": ("integer", True), "words": ("integer", True)}}


def op4_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = chat.calls_from_turns(table(spark, sf_dir, "conversations"))
    linked = chat.link_calls(calls, results, REPLY_SCHEMA)
    return linked.select("conv_id", "call_id", "turn", "result_turn", "position", "tool", "status", F.array_join("errors", "; ").alias("errors"), "record")


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.encode_payloads(table(spark, sf_dir, "documents"))
    stored = stored.withColumns({"media_bytes": F.octet_length("media").cast("long"), "media_sha256": F.sha2("media", 256)})
    pages = tiff.decode_pages(stored, "media")
    tail = F.substring("pixels", -16, 16)
    return pages.select(
        "doc_id", "n_bytes", "payload_bytes", F.sha2("pixels", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", "feature",
        "page", "width", "height", "samples", "bits", "compression", "predictor", "tiled", "error",
    )


def op6_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottomk.edit_pairs(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = langid.identify_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    pages = langid.identify_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = ("language", "confidence", "text_language", "accepted")
    none = F.lit(None).cast("long")
    return documents.select("doc_id", none.alias("page_id"), *found).union(pages.select(none.alias("doc_id"), "page_id", *found))


def op8_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary or word_vocabulary())


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op10_training_order(spark: SparkSession, sf_dir: str, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    import public_tokenizers

    ordered = training_order.training_order(table(spark, sf_dir, "documents"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN, key=20240229)
    tokens = (F.octet_length("ids") / 2).cast("int").alias("n_tokens")
    return ordered.select(F.col("id").alias("doc_id"), "seq_no", "slot", "shard", "byte_offset", tokens, F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_simhash": op2_simhash,
    "op3_sharding": op3_sharding,
    "op4_tool_calls": op4_tool_calls,
    "op5_tiff": op5_tiff,
    "op6_bottomk": op6_bottomk,
    "op7_language_id": op7_language_id,
    "op8_bpe": op8_bpe,
    "op9_mixing": op9_mixing,
    "op10_training_order": op10_training_order,
}

ORACLE_SQL: dict[str, str] = {
    # Targets by filling up to the caps in order; rates by bisection; copies size by size from the largest, what one leaves over going to the next.
    "op9_mixing": """
        WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, ([3.0, 1.0, 2.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight, source_size * 2.0::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM s),
        r AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM w),
        lv AS (SELECT k, cap / weight AS ratio, (total - coalesce(sum(cap) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
        lev AS (SELECT coalesce(min_by(level, k) FILTER (level <= ratio), max(ratio)) AS level FROM lv),
        t AS MATERIALIZED (SELECT source, source_size, least(cap, weight * level) AS target, least(cap, weight * level) >= source_size * 2.0::DOUBLE * (1 - 1e-12) AS capped FROM w, lev),
        c AS MATERIALIZED (SELECT source, size, count(*) AS n FROM d GROUP BY ALL),
        z AS (SELECT source, min(size) FILTER (size > 0) AS least_size FROM c GROUP BY source),
        b(step, source, lo, hi) AS (
            SELECT 0, t.source, least(0, ln(greatest(target, 1e-7) / greatest(source_size, 1))) / coalesce(least_size, 1)::DOUBLE - 1e-9, ln(2) / coalesce(least_size, 1)::DOUBLE + 1e-9 FROM t JOIN z ON z.source IS NOT DISTINCT FROM t.source WHERE NOT t.capped
            UNION ALL
            SELECT step + 1, source, CASE WHEN f > target THEN lo ELSE (lo + hi) / 2 END, CASE WHEN f > target THEN (lo + hi) / 2 ELSE hi END FROM (
                SELECT b.step, b.source, b.lo, b.hi, t.target, sum(c.n * least(2.0::DOUBLE, exp((b.lo + b.hi) / 2 * c.size)) * c.size) AS f
                FROM b JOIN c ON c.source IS NOT DISTINCT FROM b.source JOIN t ON t.source IS NOT DISTINCT FROM b.source WHERE b.step < 120 GROUP BY b.step, b.source, b.lo, b.hi, t.target)),
        p AS MATERIALIZED (SELECT c.source, c.size, c.n, CASE WHEN t.capped THEN 2.0::DOUBLE ELSE least(2.0::DOUBLE, exp((b.lo + b.hi) / 2 * c.size)) END AS rate, row_number() OVER (PARTITION BY c.source ORDER BY c.size DESC) AS i
            FROM c JOIN t ON t.source IS NOT DISTINCT FROM c.source LEFT JOIN b ON b.source IS NOT DISTINCT FROM c.source AND b.step = 120),
        q(i, source, size, n, copies, owed) AS (
            SELECT 0::BIGINT, source, NULL::BIGINT, NULL::BIGINT, 0::DOUBLE, 0::DOUBLE FROM t
            UNION ALL
            SELECT i, source, size, n, copies, CASE WHEN size > 0 THEN due - copies * size ELSE due END FROM (
                SELECT *, CASE WHEN size > 0 THEN least(2.0::DOUBLE * n, greatest(0, floor(due / size + 0.5))) ELSE n END AS copies FROM (
                    SELECT p.i, p.source, p.size, p.n, q.owed + p.n * p.rate * p.size AS due FROM q JOIN p ON p.source IS NOT DISTINCT FROM q.source AND p.i = q.i + 1))),
        x AS (SELECT d.*, row_number() OVER (PARTITION BY source, size ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS place FROM d),
        y AS (SELECT x.*, t.source_size, t.target, (q.copies::BIGINT // q.n) + CASE WHEN x.place < q.copies::BIGINT % q.n THEN 1 ELSE 0 END AS copies
            FROM x JOIN t ON t.source IS NOT DISTINCT FROM x.source JOIN q ON q.source IS NOT DISTINCT FROM x.source AND q.size = x.size)
        SELECT doc_id, size, source_size, round(target, 6) AS target, (size * copies)::BIGINT AS taken, source, copies::BIGINT AS copies FROM y
    """,
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        r AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS last_id FROM p),
        d AS (SELECT *, payload_bytes >= 1000 AND last_id IS NOT NULL AND page_id IS DISTINCT FROM last_id AS again FROM r)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN last_id END AS refers_to
        FROM d
    """,
    # CRC-32 byte by byte, its table worked out from the polynomial.
    "op3_sharding": """
        WITH tab AS (SELECT list(list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END)) ORDER BY i) AS v FROM range(256) r(i)),
        d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
        s AS (SELECT doc_id, octet_length(b) + 16 AS size, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::UBIGINT)), lambda c, y: xor(c >> 8, v[((xor(c, y) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)::BIGINT AS text_crc32 FROM d, tab),
        p AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, size, text_crc32 ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM s),
        c AS (SELECT *, least(39, (2 * before + size) * 40 // (2 * total)) AS shard FROM p)
        SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, NULL::INTEGER AS grown_shard
        FROM c
    """,
    "op4_tool_calls": """
        WITH u AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user' AND turn IS NOT NULL),
        a AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL),
        j AS (SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, u.turn, a.turn AS result_turn, u.t AS asked, a.t AS answer,
                concat(coalesce(u.conv_id, a.conv_id), ':', coalesce(u.turn, a.turn - 1)) AS call_id
              FROM u FULL JOIN a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1),
        s AS (SELECT *, CASE WHEN turn IS NULL THEN 'orphan' WHEN result_turn IS NULL THEN 'unanswered' ELSE 'linked' END AS status FROM j)
        SELECT conv_id, call_id, turn, result_turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, result_turn) - 1 AS position,
            CASE WHEN turn IS NOT NULL THEN 'reply' END AS tool, status, '' AS errors,
            concat('{"arguments":',
                CASE WHEN turn IS NULL THEN 'null' ELSE concat('{"text":', to_json(asked), ',"turn":', turn, ',"words":', len(regexp_extract_all(asked, '[^ \\t-\\r]+')), '}') END,
                ',"content":', coalesce(to_json(answer)::VARCHAR, 'null'), ',"id":"', call_id, '","name":', CASE WHEN turn IS NULL THEN 'null' ELSE '"reply"' END, ',"status":"', status, '"}') AS record
        FROM s
    """,
}
