"""From documents to token ids: select, identify, deduplicate, decontaminate, encode and decode.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of documents, and drop the rows they reject.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from webtables.llm import bagminhash, bpe, decontaminate, langmask, ordinal
from webtables.llm.common import materialise, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are probably of the best grade, neither toxic nor of low quality."""
    return ordinal.select(docs, ordinal.train(docs, table(spark, sf_dir, "labels")))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the documents themselves teach."""
    return langmask.recognised(docs, langmask.learn_from(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of exact and near copies."""
    return bagminhash.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document: doc_id, n_tokens, token_ids, and digests of ids, text and decoded ids."""
    encoded = bpe.encode(docs.select("doc_id", "text"), TOKENIZER).select(
        "doc_id",
        "n_tokens",
        "token_ids",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"),
    )
    decoded = F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    return bpe.decode(encoded, TOKENIZER).select(*encoded.columns, decoded)


STAGES = [
    ("quality classifier", select_quality),
    ("language ID", identify_language),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode_tokens),
]

#: The stages are beyond SQL; the tests hold run() against a version in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
