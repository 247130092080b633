"""From raw documents to token ids: quality classifier, near-duplicates, source mix, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return docs' own
columns, whatever their names.

Edge cases, in every stage: a null text counts as the empty one; rows with null keys or sources are documents as any other;
an empty table gives an empty table; very long texts are worked on whole. Stage by stage: texts without words have an
average weight in `quality`; they are one group in `near_duplicates`, as are rows equal in key and text; `source_mix` takes
no text without words, and rows equal in key stay or go together; `token_ids` gives no ids for an empty text, and a row for
each row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderlog.llm.bpe import Bpe, n_ids
from cinderlog.llm.mixing import mixed_documents
from cinderlog.llm.ngram_join import one_of_each
from cinderlog.llm.quality import fit, resampled
from cinderlog.runtime import durable


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that importance resampling towards good labelled text keeps."""
    return resampled(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near-duplicates."""
    return one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources reads them."""
    return mixed_documents(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of each document's token ids, and of the text that they decode to."""
    full = Bpe(spark, public_tokenizers.path("byte_bpe_50k.json")).round_trip(docs, ["doc_id", "source"])
    return full.select("doc_id", "source", n_ids("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("source_mix", source_mix), ("token_ids", token_ids)]

#: The models and sketches of the first two stages, and BPE, are beyond SQL; tests/llm hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
