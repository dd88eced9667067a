"""Exact dedup by skew-safe combining, native: local dedup, salted digest groups, then salt winners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import lower_ascii, salt, salted_left_join, write_table


def normalised(docs: DataFrame) -> DataFrame:
    """(doc_id, norm, text_sha256, size, fold): text with A-Z lower-cased and its digests; null text counts as empty."""
    rows = docs.select("doc_id", lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("norm"))
    return rows.select("doc_id", "norm", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.octet_length("norm").alias("size"), F.xxhash64("norm").alias("fold"))


def winners(docs: DataFrame) -> DataFrame:
    """(text_sha256, size, fold, keep_id, group_size), a row for each distinct normalised text.

    Every stage groups by digest AND the full text, so that equal digests never merge different texts:
    each map task combines its own copies; salted groups merge, at most one row of a text from each map task
    reaching one of SALTS reducers; the winners of the salts combine globally.
    """
    rows = normalised(docs).withColumn("salt", salt(F.col("doc_id")))
    key = ["text_sha256", "size", "fold", "norm"]
    salted = rows.groupBy(*key, "salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return salted.groupBy(*key).agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).drop("norm")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest doc_id stays; a null
    doc_id is smaller than any other (all null: keep_id null, kept true). Rows repeated whole, doc_id included,
    share one fate. Other columns are ignored. Empty table: no rows.
    """
    rows = normalised(docs).drop("norm")
    groups = winners(docs).where("group_size > 1")
    out = salted_left_join(rows, groups, ["text_sha256", "size", "fold"], F.col("doc_id"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, all columns: the row itself where its text is alone, else the winner's.

    Nulls, ids and rows repeated whole are as in exact_dedup: a winner that is there twice stays twice. Columns may have
    any names. Empty table: no rows.
    """
    key = ["text_sha256", "size", "fold"]
    norm = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("row"), norm.alias("norm"))  # a struct, so that no name clashes
    rows = rows.select("row", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), F.octet_length("norm").alias("size"), F.xxhash64("norm").alias("fold"))
    groups = write_table(winners(docs).where("group_size > 1"), "copies").withColumn("hit", F.lit(True))
    out = salted_left_join(rows, groups, key, F.col("row.doc_id"))
    return out.where(F.col("hit").isNull() | F.col("keep_id").eqNullSafe(F.col("row.doc_id"))).select("row.*")
