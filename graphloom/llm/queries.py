"""The queries of the text operators over whole tables, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.passages import near_passages

    return near_passages(_table(spark, sf_dir, "documents"))


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.kd_shards import kd_shards

    dealt = kd_shards(_table(spark, sf_dir, "documents"), shards=24)
    return dealt.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import classify_quality

    return classify_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents")).drop("row_id")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.bpe import bpe_encode, load_ranks

    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe_encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, digests_only=True)


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.licenses import license_summary

    return license_summary(_table(spark, sf_dir, "documents"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.pii import find_personal_data, sanitise, span_summary

    rows, spans = find_personal_data(_table(spark, sf_dir, "documents"))
    clean = sanitise(rows, spans).select("row_id", F.sha2(F.col("text").cast("binary"), 256).alias("sanitised_sha256"))
    return span_summary(rows, spans).join(clean, "row_id").drop("row_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontaminate import decontaminate

    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.html_wrappers import extract_main_text

    found = extract_main_text(_table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.simhash import simhash_dedup

    return simhash_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_passages, op2_kd_shards, op3_quality, op4_exact_dedup, op5_bpe, op6_licenses, op7_pii, op8_decontaminate, op9_html, op10_simhash)}


#: The words of a text in DuckDB: A-Z lower-cased, then runs of 0-9, a-z and non-ASCII.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": f"""
WITH k AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM k WINDOW w AS (PARTITION BY text_sha256)""",
        "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + 9) AS x
        FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
hit AS (SELECT doc_id, i, lens.n, item_id FROM p CROSS JOIN lens
        JOIN win ON win.n = lens.n AND win.x = list_slice(w, i, i + lens.n - 1) WHERE i + lens.n - 1 <= len(w)),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""",
    }
