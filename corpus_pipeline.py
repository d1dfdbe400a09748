"""From raw documents to a training corpus, in stages that each rest on one operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowseg.functions.columns import quoted
from flowseg.functions.tables import materialize
from flowseg.llm import byte_bpe, decontaminate, language_id, secret_scan, simhash
from flowseg.llm.common import fresh, table


def clear_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier is sure of."""
    return language_id.keep_accepted(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of query 9: fingerprints of 3-word shingles, linked at 2 or fewer differing bits."""
    return simhash.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_scan.mask_secrets(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with their number and digests of the ids and of the decoded text."""
    (bpe,) = fresh(docs, "_bpe")
    coded = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, name=bpe, digests=False)
    added = {
        "n_tokens": F.col(f"{bpe}.n_tokens"),
        "token_ids": F.col(f"{bpe}.ids"),
        "ids_sha256": F.sha2(F.col(f"{bpe}.ids"), 256),
        "decoded_sha256": F.sha2(F.col(f"{bpe}.decoded").cast("binary"), 256),
    }
    names = fresh(docs, *added)
    return coded.select(*[quoted(c) for c in docs.columns], *[column.alias(name) for name, column in zip(names, added.values())])


STAGES = [
    ("language", clear_language),
    ("near_duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("tokens", encoded),
]

#: zstandard sizes, XXH64 shingles and token ids have no SQL; tests/llm compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
