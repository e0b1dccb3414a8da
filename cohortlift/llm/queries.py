"""The registered queries of this subpackage and the SQL that checks them.

Each query applies its operator, with the parameters of production, to the
whole of its table and derives the digest columns from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlift.llm import (
    decontamination, exact_dedup, filter_audit, line_dedup, main_text, packing, quality, simhash, toxicity,
    url_filters, vector_codes, warc, wavelet)
from cohortlift.llm.shared import ship

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), words=4, distance=4)
    return found.select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, folder: str) -> DataFrame:
    index = warc.write_archives(table(spark, folder, "pages"))
    return warc.read_archives(index).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.packed(table(spark, folder, "documents"), tokenizer_path())
    return packing.digest(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.without_repeats(table(spark, folder, "documents"))


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.main_text(table(spark, folder, "pages"))


def op6_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.contaminated(
        table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    index = wavelet.write_shards(table(spark, folder, "documents"), tokenizer_path(), end_id=0)
    return wavelet.read_shards(index)


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, folder, "documents"), hash_all=True)
    return found.withColumnRenamed("full_hash", "text_sha256")


def op11_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    flags = filter_audit.document_flags(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return filter_audit.audit(flags, "ABCDE", losses=("good", "toxic"))


def op12_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.coded(table(spark, folder, "embeddings"))


# host, beginning of the path, verdict
URL_RULES = [
    ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op13_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judged(table(spark, folder, "pages"), rules)


ALL = [op1_simhash, op2_warc, op3_packing, op4_line_dedup, op5_main_text, op6_quality,
       op7_decontamination, op8_token_shards, op9_toxicity, op10_exact_dedup, op11_filter_audit,
       op12_vector_codes, op13_url_filters]


def shipped(build: Callable) -> Callable[[SparkSession, str], DataFrame]:
    """The query, with this package's code sent to the executors first."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return build(spark, folder)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {build.__name__: shipped(build) for build in ALL}


_PUNCTUATION = r"""[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~ \t\n\v\f\r]+"""


def _vector_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part against every entry, round by round."""
    steps = ["""
        kept AS (
            SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
        cut AS (
            SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x
            FROM kept, range({parts}) AS r(p))""", f"""
        c0 AS (
            SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
            FROM cut WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT {entries}))"""]
    for k in range(rounds + 1):
        steps.append(f"""
        a{k} AS MATERIALIZED (
            SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := d, e := e)) AS best FROM (
                SELECT vec_id, p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
                FROM cut JOIN c{k} USING (p))
            GROUP BY vec_id, p)""")
        if k < rounds:
            steps.append(f"""
        m{k} AS (
            SELECT p, e, list(m ORDER BY i) AS c FROM (
                SELECT p, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
                FROM a{k}, range(1, (SELECT max(len(x)) FROM cut) + 1) AS r(i) GROUP BY p, best.e, i) GROUP BY p, e),
        c{k + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (p, e))""")
    return f"""
        WITH {",".join(steps)},
        book AS (
            SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds}),
        r AS (
            SELECT vec_id, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code,
                   CAST(sum(best.d) AS BIGINT) AS error
            FROM a{rounds} GROUP BY vec_id)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
        FROM r JOIN kept USING (vec_id), book
    """


ORACLE = {
    "op11_filter_audit": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
        w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
        l AS (
            SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT part, CAST(len(words) < 200 AS INTEGER)
                   + CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END
                   + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END
                   + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
                   + CASE WHEN min(doc_id) OVER (PARTITION BY text) < doc_id THEN 16 ELSE 0 END AS mask, good, toxic
            FROM w LEFT JOIN l USING (doc_id)),
        cells AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
            FROM f GROUP BY part, mask),
        letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS t(l, bit)),
        orders AS (
            SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        steps AS (
            SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS own,
                   CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS before
            FROM orders, range(1, 6) AS r(s)),
        counted AS (
            SELECT part, filter_order, step, own,
                   coalesce(sum(n) FILTER (mask & (before | own) = 0), 0) AS kept,
                   coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0) AS removed,
                   coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0) AS redundant,
                   coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
                   coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0) AS good_lost,
                   coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0) AS toxic_lost
            FROM cells, steps GROUP BY part, filter_order, step, own)
        SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
               CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
               CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
               CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM counted
    """,
    "op12_vector_codes": _vector_sql(),
    "op13_url_filters": """
        WITH rules AS (
            SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
                ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
            ) AS t(rule_host, rule_path, verdict)),
        p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        u AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM p),
        h AS (
            SELECT page_id, path, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM u),
        m AS (
            SELECT page_id, host, path, rule_host || rule_path AS rule, verdict,
                   row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST) AS place
            FROM h LEFT JOIN rules
            ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE place = 1
    """,
    "op10_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, length(coalesce(text, '')) AS chars,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents),
        h AS (SELECT doc_id, chars, sha256(norm) AS text_sha256 FROM d),
        g AS (
            SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                   first_value(doc_id) OVER (
                       PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id
            FROM h)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
    """,
    "op2_warc": """
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS payload_digest,
                   CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes
            FROM pages),
        f AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> newest THEN newest END AS refers_to
        FROM f
    """,
    "op7_decontamination": f"""
        WITH w AS (
            SELECT 'd' AS kind, doc_id AS id, string_split(trim(regexp_replace(
                lower(coalesce(text, '')), '{_PUNCTUATION}', ' ', 'g')), ' ') AS words FROM documents
            UNION ALL
            SELECT 'b', item_id, string_split(trim(regexp_replace(
                lower(coalesce(text, '')), '{_PUNCTUATION}', ' ', 'g')), ' ') FROM benchmark),
        s AS (
            SELECT DISTINCT kind, id, shingle FROM (
                SELECT kind, id, unnest(CASE
                    WHEN len(words) <= 5 THEN [array_to_string(words, ' ')]
                    ELSE list_transform(range(1, len(words) - 3),
                                        lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
                FROM w WHERE words <> [''])),
        b AS (SELECT id, count(*) AS n FROM s WHERE kind = 'b' GROUP BY id),
        m AS (
            SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n
            FROM s AS d JOIN s AS i ON d.shingle = i.shingle AND d.kind = 'd' AND i.kind = 'b'
            GROUP BY d.id, i.id)
        SELECT m.doc_id, m.item_id, m.n / b.n AS containment
        FROM m JOIN b ON m.item_id = b.id WHERE m.n / b.n >= 0.8
    """,
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
