"""Operators that gather pixels: histograms, downsampling, chroma clumps, correlation."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.color import idiv, rgb_to_ycbcr, to_code


Keys = tuple[str, ...]


def rgb_histogram(pixels: DataFrame, low_bits: bool = False, keys: Keys = ()) -> DataFrame:
    """Counts of 32 x 32 x 32 colour buckets: by the high five bits of each sample, or by the low five."""
    key = (lambda c: F.col(c).bitwiseAND(F.lit(31))) if low_bits else (lambda c: F.shiftright(c, 3))
    return pixels.groupBy(*keys, *(key(c).alias(f"{c}5") for c in "rgb")).agg(F.count(F.lit(1)).alias("n"))


def color_range(pixels: DataFrame, keys: Keys = ()) -> DataFrame:
    return pixels.groupBy(*keys).agg(*(f(c).alias(f"{n}_{c}") for c in "rgb" for n, f in (("min", F.min), ("max", F.max))))


def overview(pixels: DataFrame, n: int, how: str = "nearest", keys: Keys = ()) -> DataFrame:
    """A raster of 1/n the size: every n-th pixel, or the mean of n x n, rounded down; keys name the image, as below."""
    if how == "nearest":
        out = pixels.where((F.col("x") % n == 0) & (F.col("y") % n == 0))
        return out.withColumns({"x": idiv(F.col("x"), n), "y": idiv(F.col("y"), n)})
    return pixels.groupBy(*keys, idiv(F.col("y"), n).alias("y"), idiv(F.col("x"), n).alias("x")).agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("c")).select(*keys, "y", "x", idiv(F.col("s"), F.col("c")).alias("v"))


def pyramid(pixels: DataFrame, levels: tuple[int, ...] = (2, 4, 8), how: str = "average", keys: Keys = ()) -> DataFrame:
    """All overviews, with their level."""
    out = None
    for n in levels:
        one = overview(pixels, n, how, keys).select(*keys, F.lit(n).alias("level"), "y", "x", "v")
        out = one if out is None else out.union(one)
    return out


def box_thumbnail(bilevel: DataFrame, bw: int, bh: int, keys: Keys = ()) -> DataFrame:
    """Ink of each box of bw x bh bits, 0..255."""
    return bilevel.groupBy(*keys, idiv(F.col("y"), bh).alias("y"), idiv(F.col("x"), bw).alias("x")).agg(F.sum("bit").alias("s"), F.count(F.lit(1)).alias("c")).select(*keys, "y", "x", idiv(F.col("s") * 255, F.col("c")).alias("v"))


def ycbcr_clumps(pixels: DataFrame, h: int = 2, v: int = 2, keys: Keys = ()) -> DataFrame:
    """Mean chroma of h x v clumps, with the clump's luma samples in row order; double sums are rounded to 9 places."""
    y, cb, cr = rgb_to_ycbcr(F.col("r"), F.col("g"), F.col("b"))
    one = pixels.select(*keys, idiv(F.col("y"), v).alias("cy"), idiv(F.col("x"), h).alias("cx"), (F.col("y") % v * h + F.col("x") % h).alias("at"), y.alias("luma"), cb.alias("cb"), cr.alias("cr"))
    mean = lambda c: to_code(F.round(F.avg(c), 6))
    luma = F.transform(F.array_sort(F.collect_list(F.struct("at", to_code(F.round("luma", 6)).alias("l")))), lambda s: s["l"])  # h x v entries
    return one.groupBy(*keys, "cy", "cx").agg(luma.alias("luma"), mean("cb").alias("cb"), mean("cr").alias("cr"))


def row_correlation(pixels: DataFrame, keys: Keys = ()) -> DataFrame:
    """Pearson correlation of each row with the next of its image."""
    below = pixels.select(*keys, (F.col("y") - 1).alias("y"), "x", F.col("v").alias("next"))
    return pixels.join(below, [*keys, "y", "x"]).groupBy(*keys, "y").agg(F.corr("v", "next").alias("corr"))


def guess_width(samples: DataFrame, total: int, most_ratio: int = 40) -> DataFrame:
    """(width, corr) of the likeliest width of a headerless raster (pos, v): that whose middle rows agree best.

    Candidates are the divisors of the sample count with sides of a ratio up to most_ratio; only the two middle rows
    of each are read.
    """
    low = [w for w in range(1, isqrt(total) + 1) if total % w == 0]
    widths = sorted({w for k in low for w in (k, total // k) if 2 <= w <= total // 2 and max(w * w, total) / min(w * w, total) <= most_ratio})
    spark = samples.sparkSession
    if not widths:
        return spark.createDataFrame([], "width long, corr double")
    table = spark.createDataFrame([(w, (total // w // 2 - 1) * w) for w in widths], "width long, start long")
    own = samples.join(F.broadcast(table), (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("start") + F.col("width")))
    nxt = samples.select(F.col("pos").alias("p2"), F.col("v").alias("v2"))
    found = own.withColumn("p2", F.col("pos") + F.col("width")).join(nxt, "p2").groupBy("width").agg(F.corr("v", "v2").alias("corr"))
    return found.where("not isnan(corr)").orderBy(F.desc("corr"), "width").limit(1)


def predictor_encode(pixels: DataFrame, bits: int = 8, keys: Keys = ()) -> DataFrame:
    """Differences to the left neighbour, modulo 2^bits."""
    by = Window.partitionBy(*keys, "y").orderBy("x")
    return pixels.withColumn("v", F.pmod(F.col("v") - F.coalesce(F.lag("v").over(by), F.lit(0)), F.lit(1 << bits)))


def predictor_decode(pixels: DataFrame, bits: int = 8, keys: Keys = ()) -> DataFrame:
    """Sums from the left, modulo 2^bits: the inverse."""
    by = Window.partitionBy(*keys, "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.withColumn("v", F.pmod(F.sum("v").over(by), F.lit(1 << bits)))


def estimate_bytecounts(striles: DataFrame, file_size: str = "file_size") -> DataFrame:
    """Missing byte counts of chunks: up to the next chunk's offset, or the end of the file."""
    by = Window.partitionBy("file_id").orderBy("offset")
    gap = F.coalesce(F.lead("offset").over(by), F.col(file_size)) - F.col("offset")
    return striles.withColumn("bytecount", F.when(F.coalesce(F.col("bytecount"), F.lit(0)) <= 0, gap).otherwise(F.col("bytecount")))
