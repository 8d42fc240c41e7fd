"""The thin queries over the synthetic tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphspark.llm import decontaminate, deleted_interpolation, exact_dedup, html_text, kneser_ney, mixing, near_dedup, personal_data, sharding, token_counts

#: File name of the tokenizer model of op3; its folder comes from the tokenizer package.
TOKENIZER = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deleted_interpolation.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, public_tokenizers.path(TOKENIZER)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_grace_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decide(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, CAST(count(*) OVER (PARTITION BY h) AS BIGINT) AS group_size,
  row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1 AS kept, h AS text_sha256 FROM d
"""


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop("text")


def op5_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(table(spark, sf_dir, "documents").select("doc_id", "text"), columns=("doc_id",))


OP6_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, k, k + least(len(w), 13) - 1), ' ') AS g FROM iw, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (SELECT r, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') AS g FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM dw, sizes WHERE len(w) >= n)),
found AS (SELECT r, k, n, item FROM grams JOIN win USING (n, g)),
hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT r, k, n FROM found)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hits USING (r) LEFT JOIN its USING (r)
"""


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return kneser_ney.judge(docs, table(spark, sf_dir, "labels"), columns=("doc_id", "lang")).select("doc_id", "lang", F.round("quality_bits", 6).alias("quality_bits"), F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")


def op8_probminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.classes(docs).select("doc_id", "class_id", "class_size", "kept")


def op9_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_template_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jump_sharding": op1_jump_sharding,
        "op2_deleted_interpolation": op2_deleted_interpolation,
        "op3_token_counts": op3_token_counts,
        "op4_grace_dedup": op4_grace_dedup,
        "op5_weak_pii": op5_weak_pii,
        "op6_decontamination": op6_decontamination,
        "op7_kneser_ney": op7_kneser_ney,
        "op8_probminhash": op8_probminhash,
        "op9_cube_mixing": op9_cube_mixing,
        "op10_template_removal": op10_template_removal,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_grace_dedup": OP4_SQL, "op6_decontamination": OP6_SQL}
