"""Queries op1 to op13 and their DuckDB text where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.llm import decontamination, fingerprints, jaccard, licenses, lm_scoring, merkle, packing, periodicity, pii, secrets, sharding, suffix_dedup, toxicity
from kerbline.llm.common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scoring.score(docs, lm_scoring.train(docs.where(~lm_scoring.held_out())))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.with_slots(sharding.kd_shards(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), F.col("_kerbline_score").alias("score"), F.col("_kerbline_predicted").alias("predicted"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.report(decontamination.find_items(docs, table(spark, sf_dir, "benchmark")))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(licenses.scan(table(spark, sf_dir, "documents")))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.find_spans(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.report(pii.find(docs, pii.train(pii.labelled_table(docs))))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.report(merkle.prove(table(spark, sf_dir, "documents")))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(suffix_dedup.find(table(spark, sf_dir, "documents")))


def op13_periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodicity.report(periodicity.find(docs, plant=True, keep_text=False))


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_fingerprints": op3_fingerprints,
    "op4_sharding": op4_sharding,
    "op5_packing": op5_packing,
    "op6_toxicity": op6_toxicity,
    "op7_decontamination": op7_decontamination,
    "op8_licenses": op8_licenses,
    "op9_secrets": op9_secrets,
    "op10_pii": op10_pii,
    "op11_merkle": op11_merkle,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodicity": op13_periodicity,
}

_WORDS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op7_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce({_WORDS}, []) AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        p AS (SELECT item, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
        pats AS (SELECT DISTINCT item, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win FROM p),
        lens AS (SELECT DISTINCT m FROM pats),
        dw AS (SELECT rid, m, unnest(range(1, len(w) - m + 2)) AS i, w FROM d, lens WHERE len(w) >= m),
        hits AS (SELECT rid, item, i, dw.m FROM (SELECT rid, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS win FROM dw) dw JOIN pats USING (m, win)),
        pos AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS j FROM hits) GROUP BY rid),
        its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)""",
    "op11_merkle": """
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS rid, doc_id, source, text,
                   list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR), text], lambda v: coalesce(strlen(v) || ':' || v, '-')) AS f,
                   xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(unicode(ch) AS BIGINT))),
                       lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) AS crc
            FROM documents),
        e AS (SELECT rid, doc_id, source, sha256(array_to_string(f, '')) AS leaf,
                     CASE WHEN crc % 2 = 0 AND text IS NOT NULL THEN sha256(array_to_string(f[1:4], '') || strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), ''))
                          ELSE sha256(array_to_string(f, '')) END AS broken FROM d),
        p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS k, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM e),
        trees AS (
            SELECT k, 0 AS level, list(leaf ORDER BY pos) AS h FROM p GROUP BY k
            UNION ALL
            SELECT k, level + 1, list_transform(range((len(h) + 2) // 3), lambda i: sha256(array_to_string(h[3 * i + 1:3 * i + 3], ''))) FROM trees WHERE len(h) > 1),
        subroots AS (SELECT k, h[1] AS subroot FROM trees WHERE len(h) = 1),
        top AS (
            SELECT 0 AS level, list(subroot ORDER BY k) AS h FROM subroots
            UNION ALL
            SELECT level + 1, list_transform(range((len(h) + 2) // 3), lambda i: sha256(array_to_string(h[3 * i + 1:3 * i + 3], ''))) FROM top WHERE len(h) > 1),
        climb AS (
            SELECT rid, k, pos, 0 AS level, broken AS folded, '' AS proof FROM p
            UNION ALL
            SELECT rid, c.k, c.pos // 3, c.level + 1,
                   sha256(array_to_string(h[c.pos - c.pos % 3 + 1:c.pos], '') || folded || array_to_string(h[c.pos + 2:c.pos - c.pos % 3 + 3], '')),
                   proof || array_to_string(h[c.pos - c.pos % 3 + 1:c.pos], '') || array_to_string(h[c.pos + 2:c.pos - c.pos % 3 + 3], '')
            FROM climb c JOIN trees t ON t.k = c.k AND t.level = c.level WHERE len(h) > 1),
        over AS (
            SELECT rid, k AS pos, 0 AS level, folded, proof FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS last FROM climb) WHERE last = 1
            UNION ALL
            SELECT rid, c.pos // 3, c.level + 1,
                   sha256(array_to_string(h[c.pos - c.pos % 3 + 1:c.pos], '') || folded || array_to_string(h[c.pos + 2:c.pos - c.pos % 3 + 3], '')),
                   proof || array_to_string(h[c.pos - c.pos % 3 + 1:c.pos], '') || array_to_string(h[c.pos + 2:c.pos - c.pos % 3 + 3], '')
            FROM over c JOIN top t ON t.level = c.level WHERE len(h) > 1),
        done AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY level DESC) AS last FROM over) WHERE last = 1)
        SELECT doc_id, leaf, subroot, h[1] AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h[1] AS verified
        FROM p JOIN subroots USING (k) JOIN done USING (rid) JOIN top ON len(h) = 1""",
    "op12_suffix_dedup": """
        WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id, -9223372036854775808) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT rid, o, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT rid, o, h, unnest(range(len(h) // 2 - 49)) AS i FROM d WHERE len(h) >= 100)),
        hits AS (SELECT rid, i FROM (SELECT rid, i, o, min(o) OVER (PARTITION BY s) AS first FROM w) WHERE first < o),
        parts AS (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS part
                  FROM (SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hits)),
        spans AS (SELECT rid, part, min(i) AS a, max(i) + 50 AS b FROM parts GROUP BY rid, part),
        cuts AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM spans),
        kept AS (SELECT rid, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS after, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k
                 FROM cuts JOIN d USING (rid) GROUP BY rid)
        SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(after, 0) + 1))) AS kept_sha256
        FROM d LEFT JOIN kept USING (rid)""",
}
