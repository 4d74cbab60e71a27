"""Queries of this subpackage for the driver, with their SQL where SQL can express them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .mixing import mix_sql
from .vector_codes import codes_sql


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op3_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed_documents

    return packed_documents(_documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op1_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import language_predictions

    return language_predictions(_documents(spark, sf_dir))


def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import perspectives

    return perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op4_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import balanced_shards

    return balanced_shards(_documents(spark, sf_dir)).drop("row")


def op7_block_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(_documents(spark, sf_dir)).drop("row", "source_index", "start")


def op8_rule_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_filter

    return quality_filter(_documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(_documents(spark, sf_dir)).drop("row")


def op6_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .planes import read_token_files, write_token_files

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([zlib.crc32(x) for x in b.column(3).to_pylist()], pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = read_token_files(write_token_files(_documents(spark, sf_dir)))
    return found.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan

    return scan(_documents(spark, sf_dir))


def op11_vantage_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))))


def op12_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write_archives

    found = read_records(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import vector_codes

    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_output_codes, op2_perspectives, op3_best_two_fit, op4_label_propagation, op5_dart_minhash, op6_block_naming, op7_block_mixing, op8_rule_cascade, op9_bit_planes, op10_secret_forest, op11_vantage_negatives, op12_seekable_warc, op13_annular_codes)}

ORACLES: dict[str, str] = {
    "op2_perspectives": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
r AS (SELECT t.*, perspective, CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user' END AS role
      FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head FROM r),
s AS (SELECT *, head || body || '<|im_end|>' || chr(10) AS segment FROM h),
w AS (SELECT *, length(segment) AS length, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, body
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM s)
SELECT conv_id, perspective, turn, speaker, role, segment, start, length, role = 'assistant' AS mask,
       start + CASE WHEN role = 'assistant' THEN length(head) ELSE 0 END AS mask_start, start + CASE WHEN role = 'assistant' THEN length - 1 ELSE 0 END AS mask_end FROM w""",
    "op7_block_mixing": mix_sql(),
    "op8_rule_cascade": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
a AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
      list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS c
      FROM (SELECT doc_id, i, list_slice(words, i, i + 7) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM a WHERE len(words) >= 8))),
r AS (SELECT doc_id, sum(least(8, i - p)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS p FROM g WHERE c > 1) GROUP BY doc_id),
b AS (SELECT a.doc_id, text, words, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
      (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
      length(regexp_replace(text, '\P{L}', '', 'g')) AS letters, length(regexp_replace(text, '\P{Lu}', '', 'g')) AS capitals FROM a LEFT JOIN r USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols * 2 > n_words OR n_dup_lines * 10 > n_lines * 3 OR word_chars > n_words * 15 OR word_chars < n_words * 2
            OR letters * 10 < word_chars * 6 OR capitals * 2 > letters OR len(list_distinct(words)) * 20 < n_words) AS kept FROM f""",
    "op6_block_naming": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS n FROM documents),
g AS (SELECT doc_id, sha256(n) AS text_sha256, row_number() OVER w AS k, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY n) AS group_size
      FROM t WINDOW w AS (PARTITION BY n ORDER BY length(x) DESC, doc_id))
SELECT doc_id, keep_id, group_size, k = 1 AS kept, text_sha256 FROM g""",
    "op11_vantage_negatives": r"""
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM a WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
      FROM p JOIN a USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_seekable_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
f AS (SELECT page_id, x, strlen(x) AS payload_bytes, min(page_id) OVER (PARTITION BY x) AS first FROM p)
SELECT page_id, payload_bytes, sha256(x) AS payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to FROM f""",
    "op13_annular_codes": codes_sql(),
}
