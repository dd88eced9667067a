"""Rasters derived from ordinary tables, by the same recipe in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.color import idiv

WIDTH, RGB_WIDTH, PALETTE_SIZE = 64, 50, 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def gray8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v, page): embeddings as scanlines of a grey image; the label is a page number."""
    one = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.col("label").cast("bigint").alias("page"), F.posexplode("embedding").alias("x", "e"))
    v = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("e").cast("double") + 1) * 127.5)))
    return one.select("y", F.col("x").cast("bigint").alias("x"), v.cast("bigint").alias("v"), "page")


def rgb8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, r, g, b): orders as the pixels of a colour image."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(idiv(k, RGB_WIDTH).alias("y"), (k % RGB_WIDTH).alias("x"), (F.col("o_custkey") % 256).alias("r"), (F.floor("o_totalprice") % 256).alias("g"), (k * 7 % 256).alias("b"))


def rows_of_rgb(spark: SparkSession, sf_dir: str) -> int:
    return (rgb8(spark, sf_dir).agg(F.max("y")).first()[0] or 0) + 1


def palette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 entries, each gathered from all parts whose key leaves it over."""
    k = F.col("p_partkey") % PALETTE_SIZE
    each = table(spark, sf_dir, "part").groupBy(k.alias("idx")).agg(F.max("p_size").cast("bigint").alias("s"), F.max(F.floor("p_retailprice")).cast("bigint").alias("p"))
    return each.select("idx", (F.col("s") * 5 % 256).alias("r"), (F.col("idx") * 4).alias("g"), (F.col("p") * 7 % 256).alias("b"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rgb8(spark, sf_dir).select("y", "x", (F.col("r") % PALETTE_SIZE).alias("idx"))


def rows_of_gray(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").count()


def bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gray8, one row down, the last row first."""
    n = rows_of_gray(spark, sf_dir)
    return gray8(spark, sf_dir).withColumn("y", (F.col("y") + 1) % n)


GRAY = "gray AS (SELECT y, i - 1 AS x, CAST(greatest(0, least(255, floor((CAST(e AS DOUBLE) + 1) * 127.5))) AS BIGINT) AS v, page FROM (SELECT CAST(vec_id AS BIGINT) AS y, CAST(label AS BIGINT) AS page, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"
RGB = "rgb AS (SELECT o_orderkey // 50 AS y, o_orderkey % 50 AS x, o_custkey % 256 AS r, CAST(floor(o_totalprice) AS BIGINT) % 256 AS g, o_orderkey * 7 % 256 AS b FROM orders)"
PALETTE = "pal AS (SELECT p_partkey % 64 AS idx, CAST(max(p_size) AS BIGINT) * 5 % 256 AS r, p_partkey % 64 * 4 AS g, CAST(max(floor(p_retailprice)) AS BIGINT) * 7 % 256 AS b FROM part GROUP BY p_partkey % 64)"
INDEXED = f"{RGB}, ind AS (SELECT y, x, r % 64 AS idx FROM rgb)"
BIAS = f"{GRAY}, n AS (SELECT count(*) AS n FROM embeddings), bias AS (SELECT (y + 1) % n AS y, x, v FROM gray, n)"
EDGE = "edge AS (SELECT count(*) AS h FROM embeddings)"
