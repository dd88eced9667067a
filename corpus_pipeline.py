"""A corpus pipeline of five stages over `documents`: language, exact copies, near copies, long repeats, packing.

Each stage takes (spark, docs, sf_dir) and gives what it keeps, with the columns of documents; the last gives the
packed pieces. Between stages, rows are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mosaiq.llm import exact, langid, packing, simhash, suffix
from mosaiq.llm.common import write_table
from mosaiq.llm.queries import tokenizer_file


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents in no known language: null texts and those without a letter."""
    return langid.keep_known(docs, langid.train(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for the case of A-Z, the largest doc_id stays."""
    return exact.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints of 4 differing bits or fewer, the smallest doc_id stays."""
    return simhash.keep_one(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a string of suffix.PASSAGE bytes that starts elsewhere too are cut; wholly cut documents go.

    The length is that of a passage of 50 short words, so that repeated passages of over 50 words go.
    """
    return suffix.cut_repeats(docs, suffix.PASSAGE)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences of 2048 tokens at most."""
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [("language", language), ("exact_dedup", exact_copies), ("simhash", near_copies), ("suffix_dedup", long_repeats), ("packing", sequences)]

#: Language models, fingerprints and tokens are beyond SQL; a brute-force version in the tests takes its place.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
