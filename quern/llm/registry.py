"""Queries of the training-data operators: name -> callable on (spark, sf_dir), and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import oracles, oracles_more
from quern.llm.common import table
from quern.llm.embedding_dedup import near_vectors
from quern.llm.language_id import identify, learn
from quern.llm.merkle import COLUMNS, audited, lower_ascii, record_digest
from quern.llm.minhash import near_duplicates
from quern.llm.mixing import entropy_mix
from quern.llm.packing import pack_documents, tokenizer_path
from quern.llm.spelling import counted_words, variants
from quern.llm.substring_dedup import substring_dedup
from quern.llm.token_files import token_files
from quern.llm.toxicity import score, train
from quern.llm.url_filters import day_of, entries_from_pages, url_filter
from quern.llm.warc import derive, responses_from_pages
from quern.llm.quality_rules import MEASURES, STOP_WORDS, quality_rules


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", day_of(F.concat(F.lit("fetch"), F.col("page_id").cast("string")), 366))
    out = url_filter(captures, entries_from_pages(pages))
    return out.withColumns({c: F.col(c).cast("string") for c in ("fetched", "listed_on")})


def op4_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses_from_pages(table(spark, sf_dir, "pages")), keep=("page_id",))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *MEASURES, "base_failed", "kept")


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring de-duplication by whole lines alone."""
    cut = substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), whole_lines=True)
    chars = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return cut.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), chars.alias("removed_chars"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def fold(n: int) -> Column:
    """The fold of a document in the splits by CRC-32 of its id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(fold(3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").filter(~held).select("doc_id", "toxic")
    model = train(docs, labels)
    return score(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(fold(4) == 2, F.lit(False))
    profiles = learn(docs.filter(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), profiles).select("doc_id", "held_out", "lang_pred", "score", "distance")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted_words(table(spark, sf_dir, "documents")))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = record_digest(lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in COLUMNS)
    claim = F.when(F.coalesce(fold(5) == 0, F.lit(False)), tampered).otherwise(record_digest(map(F.col, COLUMNS)))
    return audited(docs, claim).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": pipeline,
        "op1_url_filters": op1_url_filters,
        "op4_warc_derivatives": op4_warc_derivatives,
        "op2_quality_rules": op2_quality_rules,
        "op3_substring_dedup": op3_substring_dedup,
        "line_dedup": line_dedup,
        "op5_entropy_mix": op5_entropy_mix,
        "op6_toxicity": op6_toxicity,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_language_id": op9_language_id,
        "op10_bag_minhash": op10_bag_minhash,
        "op11_spelling_variants": op11_spelling_variants,
        "op12_token_files": op12_token_files,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": oracles.URL_FILTER,
        "op4_warc_derivatives": oracles.WARC,
        "op2_quality_rules": oracles.QUALITY.replace("{stop}", ", ".join(f"'{x}'" for x in dict.fromkeys(STOP_WORDS))),
        "line_dedup": oracles.LINES,
        "op11_spelling_variants": oracles_more.SPELLING,
        "op13_merkle_manifest": oracles_more.MERKLE,
    }
