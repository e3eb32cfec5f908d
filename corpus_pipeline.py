"""A corpus from raw documents to training sequences; each stage works on all that the one before kept.

The stages in between return the columns of their input. Nulls, repeated rows, empty tables and further columns are
handled as the operators' docstrings say; a null text passes the first, third and fourth stage, counts as the empty text in
the second, and is packed as its end id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import decontaminate, packing, secret_scan, simhash, toxicity
from tidegraph.llm.common import drop_folder, prepare, staged_at, table


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an expected grade of 0 by the ordinal model; it learns from ``labels`` of the documents here."""
    return toxicity.without_toxic(docs, toxicity.learn_from(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity of 0.8 or more.

    Fingerprints that meet in the middle find most candidates; a set join finds what they miss, and shingle sets decide.
    """
    prepare(spark)
    return simhash.without_near_copies(docs, similarity=0.8, width=5)


def unleaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a ten-word window of a benchmark item."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"), window=10)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced."""
    prepare(spark)
    return secret_scan.without_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence and place, as in op7."""
    prepare(spark)
    pieces = packing.encoded_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)
    return packing.packed(pieces, 1024).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", clean), ("near_duplicates", distinct), ("decontamination", unleaked), ("secrets", redacted), ("packing", packed),
]

#: The stages learn models, link by shingle sets and encode with a tokenizer: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next one reads it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = staged_at(spark, stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_folder(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
