"""A corpus from documents: language, exact and near duplicates, the mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm import bpe, exact, language, mixing, simhash
from orrery.llm.common import Scratch, fresh, small_batches

#: A document whose best language has less than this mean probability is rejected.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without a letter or of no clear language go.

    So null and empty texts go. Repeated rows are each judged, very long texts
    are read whole, columns of any name stay as they are; an empty table, or one
    without a label to learn from, gives an empty one.
    """
    small_batches(spark)
    names = fresh(docs, "lang_pred"), fresh(docs, "score")
    found = language.identify(docs, names=names)
    return found.where((F.col(names[0]) != language.NONE) & (F.col(names[1]) >= LEAST_SCORE)).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document of the largest id; nulls, ties, repeats, long texts and empty tables as in :func:`exact.duplicates`."""
    return exact.distinct_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts whose sets of five-word shingles have a similarity of 0.8 or more, one; the rest as in :func:`simhash.similar`."""
    small_batches(spark)
    return simhash.one_of_each(docs, width=5, similarity=0.8)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; nulls, ties, repeats, long texts and empty tables as in :func:`mixing.mix`."""
    return mixing.taken_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the bytes they decode to; a null text has no ids, the rest as in :func:`bpe.encode`."""
    import public_tokenizers

    small_batches(spark)
    narrow = docs.select("doc_id", "source", "text")
    found = bpe.encode(narrow, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=True)
    return found.select("doc_id", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("mixing", mixing_stage),
    ("bpe", encoding_stage),
]

#: SQL cannot express the trained stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
