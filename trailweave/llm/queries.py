"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailweave.session import ensure_checkpoint_dir, table

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.pii import pii_report

    return pii_report(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.toxicity import fit, fold, toxicity_score

    documents = table(spark, sf_dir, "documents")
    model = fit(documents, table(spark, sf_dir, "labels"), fold(F.col("doc_id")) != 2, threshold=0.3)
    held = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    scored = documents.select("doc_id", held, toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.suffix_dedup import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.packing import packed_documents

    return packed_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.quality import quality_report

    return quality_report(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.decontaminate import contamination, n_hit

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near_items"),
    )


def op8_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.main_text import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.warc import archived

    found = archived(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.simhash import hex16, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.relative_lz import without_repeated_windows

    return without_repeated_windows(table(spark, sf_dir, "documents")).drop("kept", "factors")


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.ball_kmeans import clustered

    return clustered(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from trailweave.llm.manifest import audited

    # tampering: the line breaks of about half the texts are taken out
    cut = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    folder = f"{ensure_checkpoint_dir(spark)}/manifest-{uuid.uuid4().hex}"
    return audited(table(spark, sf_dir, "documents"), folder, ["doc_id", "source", "lang", "n_chars", "text"], {"text": cut})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_pii": op2_pii,
        "op3_toxicity": op3_toxicity,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_quality_rules": op6_quality_rules,
        "op7_decontamination": op7_decontamination,
        "op8_html_main_text": op8_html_main_text,
        "op9_warc": op9_warc,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_substring_dedup": op11_substring_dedup,
        "op12_centroid_clustering": op12_centroid_clustering,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    from trailweave.llm.oracle import SQL

    return dict(SQL)
