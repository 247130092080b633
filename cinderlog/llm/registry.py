"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The rules that the contract names.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule that fits every page's URL, and the verdict on it."""
    from cinderlog.llm.urls import judge, labelled_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge(pages, URL_RULES, labelled_urls()).select("page_id", "host", "path", "rule", "verdict", "block_probability")


def op2_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every whole document and of the text decoded from them."""
    from cinderlog.llm.bpe import Bpe, n_ids

    full = Bpe(spark, public_tokenizers.path(BYTE_BPE)).round_trip(table(spark, sf_dir, "documents"), ["doc_id"])
    return full.select("doc_id", n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole document."""
    from cinderlog.llm.token_counts import n_bytes, with_token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs, public_tokenizers.path(BYTE_BPE)).select("doc_id", n_bytes("text").alias("n_bytes"), "n_tokens", "over_limit")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 40, its place there, and its shard if there were 41."""
    from cinderlog.llm.sharding import with_shards, with_slots

    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    sharded = with_shards(docs, "doc_id", [1.0] * 40)
    return with_slots(sharded).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix of the sources takes."""
    from cinderlog.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole document and of its edited text, and their likeness."""
    from cinderlog.llm.fingerprints import edited_fingerprints, fingerprint

    full = edited_fingerprints(table(spark, sf_dir, "documents"))
    return full.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), "near_edited", "near_next")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    from cinderlog.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of near-duplicates and number of links."""
    from cinderlog.llm.ngram_join import similarity_join

    return similarity_join(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log importance weight, and whether the resampling keeps it."""
    from cinderlog.llm.quality import fit, resample

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return resample(docs, model)[0].select("doc_id", "log_weight", "sort_key", "keep")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best matches of every vector whose id is divisible by 50, among all vectors."""
    from cinderlog.llm.vectors import search

    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_bpe_encoding": op2_bpe_encoding,
        "op3_sharding": op3_sharding,
        "op4_mixing": op4_mixing,
        "op5_token_counts": op5_token_counts,
        "op6_fingerprints": op6_fingerprints,
        "op7_html_text": op7_html_text,
        "op8_ngram_join": op8_ngram_join,
        "op9_quality": op9_quality,
        "op10_vector_search": op10_vector_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from cinderlog.llm.mixing import ORACLE_SQL as mixing

    return {"op4_mixing": mixing}
