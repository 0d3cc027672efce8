"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .ann import nearest
from .common import shared_path, ship, table
from .exact_dedup import exact_groups
from .language_id import identify
from .mixing import BLOCK, MOST_SHARDS, SEED, SHARD_WORDS, mix
from .near_dedup import near_groups
from .pii import find_pii
from .sentencepiece_bpe import tokenised
from .toxicity import score_toxicity
from .url_filter import judge
from .warc import read_archives, write_archives

#: The tokenizer that op7 and the pipeline encode with.
MODEL = "piece_bpe_32k.model"


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records and read back; a null html is an empty payload, a null id comes after all others, pages with equal payloads refer to the largest id. No pages, no rows; see write_archives."""
    path = shared_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).drop("url")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among documents; null and empty texts are linked with nothing, repeated rows are equal sets. No documents, no rows; see near_groups."""
    return near_groups(table(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal documents; null texts are empty ones, null ids come after all others. No documents, no rows; see exact_groups."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document; ``und`` for null and letterless texts and where nothing is labelled. No documents, no rows; see identify."""
    return identify(table(spark, sf_dir, "documents"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document; null texts have none, a null source is one of its own. No documents, no rows; see mix."""
    return mix(table(spark, sf_dir, "documents")).drop("key")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document; null and empty texts have none. No documents, no rows; see find_pii."""
    return find_pii(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of each document; null and empty texts have no ids. No documents, no rows; see tokenised."""
    return tokenised(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest neighbours of every fiftieth vector; null, zero and non-finite vectors take no part, ties go to the smaller id. No vectors, no rows; see nearest."""
    return nearest(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on each page; a null url has an empty host and path and is allowed. No pages, no rows; see judge."""
    return judge(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for each document; null and empty texts get the bias alone, all get 0 without labels. No documents, no rows; see score_toxicity."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def shipped(query):
    """The query, with this package sent to the Python workers first."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: shipped(f) for f in (op1_warc, op2_near_dedup, op3_exact_dedup, op4_language_id, op5_mix_sources, op6_pii, op7_sentencepiece, op8_ann, op9_url_filter, op10_toxicity)}

WORDS = r"'[^\x20\x09-\x0D]+'"

ORACLE = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits FROM pages),
        q AS (
            SELECT *, max(page_id) OVER (PARTITION BY html) AS largest,
                   array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * substr(bits, 5 * i + 1, 1)::INT
                       + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
                       + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1) FOR i IN range(32)], '') AS payload_digest
            FROM p)
        SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN largest IS NULL OR page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM largest THEN largest END AS refers_to
        FROM q""",
    "op2_near_dedup": f"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                ELSE [array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)] END) AS v
            FROM d),
        x AS (SELECT doc_id, len(v) AS n, unnest(v) AS v FROM s),
        both_ AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.v = b.v AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM s
            UNION
            SELECT r.a, l.b FROM reach r JOIN both_ l ON r.b = l.a),
        least_ AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, len(v)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN least_ ON doc_id = a""",
    "op3_exact_dedup": """
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op5_mix_sources": f"""
        WITH s AS (
            SELECT doc_id, source, coalesce('=' || source, '') AS key, coalesce(len(regexp_extract_all(text, {WORDS})), 0)::BIGINT AS size,
                   ('0x' || substr(md5('{SEED}s' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS part,
                   ('0x' || substr(md5('{SEED}o' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place
            FROM documents),
        t AS (
            SELECT key, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM s GROUP BY source, key),
        u AS (SELECT *, [5, 2, 1][(n - 1) % 3 + 1] AS weight, 2 * source_size AS most FROM t),
        v AS (
            SELECT *, most / weight AS ratio, (1.5::DOUBLE * sum(source_size) OVER ()
                - coalesce(sum(most) OVER (ORDER BY most / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / sum(weight) OVER (ORDER BY most / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM u),
        level AS (SELECT arg_min(rate, row(ratio, n)) AS rate FROM v WHERE rate * weight <= most),
        targets AS (
            SELECT v.key, v.n, v.source_size, coalesce(least(most::DOUBLE, level.rate * weight), most::DOUBLE) AS target FROM v, level),
        blocks AS (
            SELECT key, count(*) AS blocks FROM (
                SELECT key, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, n, k) AS seat
                FROM targets, unnest(range(0, (target / {BLOCK})::BIGINT + 30)) r(k) WHERE target > 0)
            WHERE seat <= (SELECT round(sum(target) / {BLOCK}) FROM targets) GROUP BY key),
        shards AS (SELECT greatest(1, least({MOST_SHARDS}, (coalesce(sum(size), 0) + {SHARD_WORDS - 1}) // {SHARD_WORDS}))::BIGINT AS shards FROM s),
        placed AS (SELECT s.*, s.part % shards.shards AS shard FROM s, shards),
        pieces AS (
            SELECT key, shard, sum(size)::BIGINT AS words, any_value(coalesce(blocks, 0)) AS blocks, any_value(n) AS n, any_value(source_size) AS source_size,
                   any_value(target) AS target
            FROM placed JOIN targets USING (key) LEFT JOIN blocks USING (key) GROUP BY key, shard),
        won AS (
            SELECT key, shard, count(*) AS seats FROM (
                SELECT key, shard, blocks, row_number() OVER (PARTITION BY key ORDER BY words / (2 * k + 1) DESC, shard, k) AS seat
                FROM pieces, unnest(range(0, 2 * words // {BLOCK} + 30)) r(k) WHERE words > 0)
            WHERE seat <= blocks GROUP BY key, shard),
        quotas AS (
            SELECT p.*, least(coalesce(seats, 0) * {BLOCK}, 2 * words)::BIGINT AS quota,
                   ('0x' || substr(md5(concat_ws(':', '{SEED}', n, shard)), 1, 8))::BIGINT % greatest(1, (words + {BLOCK - 1}) // {BLOCK}) * {BLOCK} AS start
            FROM pieces p LEFT JOIN won USING (key, shard)),
        rooms AS (
            SELECT *, 2 * words - quota AS room, sum(2 * words - quota) OVER (PARTITION BY key) AS rooms,
                   sum(2 * words - quota) OVER (PARTITION BY key ORDER BY shard ROWS UNBOUNDED PRECEDING) AS filled,
                   (blocks * {BLOCK} - sum(quota) OVER (PARTITION BY key)) // {BLOCK} * {BLOCK} AS missing
            FROM quotas),
        dealt AS (
            SELECT * REPLACE ((quota + CASE WHEN least(missing, rooms) > 0 THEN least(missing, rooms) * filled // rooms
                - least(missing, rooms) * (filled - room) // rooms ELSE 0 END)::BIGINT AS quota)
            FROM rooms),
        lines AS (
            SELECT *, sum(size) OVER (PARTITION BY key, shard ORDER BY place, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM placed),
        laid AS (
            SELECT doc_id, size, source_size, target, upto - size AS a, upto AS b, words, start,
                   CASE WHEN words > 0 THEN quota // words ELSE 0 END AS turns, CASE WHEN words > 0 THEN start + quota % words ELSE 0 END AS last
            FROM lines JOIN dealt USING (key, shard))
        SELECT doc_id, size, source_size, target,
               (turns * size + greatest(0, least(b, last) - greatest(a, start)) + greatest(0, least(b, last - words) - a))::BIGINT AS taken
        FROM laid""",
}
