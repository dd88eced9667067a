"""Layout changes: chunks, bands, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mosaiq.functions.geometry import tile_index


def rechunk(pixels: DataFrame, w, h, tw: int, th: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*keys, tile, samples): the samples of each tile in row order; edge tiles are as small as the raster makes them.

    keys name the image (and plane) of a pixel; w and h may be columns, as images differ in size. One shuffle, on the
    image and tile; a tile has tw x th samples at most.
    """
    at = F.struct("y", "x", "v")
    one = pixels.select(*keys, tile_index(F.col("x"), F.col("y"), w, h, tw, th).alias("tile"), at.alias("p"))
    return one.groupBy(*keys, "tile").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["v"]).alias("samples"))


def unchunk(tiles: DataFrame, w, tw: int, th: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """The pixels (*keys, y, x, v) of tiles made by rechunk: no shuffle. w may be a column of tiles."""
    w = w if isinstance(w, Column) else F.lit(w)
    across = F.ceil(w / tw)
    tx, ty = (F.col("tile") % across) * tw, F.floor(F.col("tile") / across) * th
    wide = F.least(F.lit(tw), w - tx)
    one = tiles.select(*keys, tx.alias("tx"), ty.alias("ty"), wide.alias("wide"), F.posexplode("samples").alias("i", "v"))
    return one.select(*keys, (F.col("ty") + F.floor(F.col("i") / F.col("wide"))).alias("y"), (F.col("tx") + F.col("i") % F.col("wide")).alias("x"), "v")


def scanlines(pixels: DataFrame, keys: tuple[str, ...] = ("y",)) -> DataFrame:
    """One row per scanline with its samples in order."""
    return pixels.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"]).alias("samples"))


def band_split(pixels: DataFrame, bands: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Interleaved samples to planes: (*keys, plane, y, x, v)."""
    return pixels.select(*keys, "y", "x", F.posexplode(F.array(*bands)).alias("plane", "v"))


def band_merge(planes: DataFrame, bands: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = ()) -> DataFrame:
    """Planes to interleaved samples: a partial aggregation before the shuffle, no pivot scan."""
    return planes.groupBy(*keys, "y", "x").agg(*(F.max(F.when(F.col("plane") == i, F.col("v"))).alias(b) for i, b in enumerate(bands)))


def extract_channel(pixels: DataFrame, band: int, bands: tuple[str, ...] = ("r", "g", "b"), keys: tuple[str, ...] = ()) -> DataFrame:
    """One band, by its number from 0, as a grey raster (*keys, y, x, v): a projection that reads this band alone."""
    return pixels.select(*keys, "y", "x", F.col(bands[band]).alias("v"))


#: Ways to deal regions of images out to files and pages: (a file for each image, for each region; regions apart).
EXPORTS = {"combined": (False, False, False), "divided": (False, False, True), "image": (True, False, False), "multiple": (True, False, True), "separated": (True, True, True)}


def export_groups(regions: DataFrame, how: str = "combined") -> DataFrame:
    """regions (image, region, ...) with `file` and `page`: one file or one for each image or region, and in a file a
    page for each image or for each region.

    Ranks are counted within an image, and images by their distinct keys; a list of regions, not of pixels.
    """
    each, apart, pages = EXPORTS[how]
    image = F.dense_rank().over(Window.orderBy("image")) - 1
    region = F.dense_rank().over(Window.partitionBy("image").orderBy("region")) - 1
    pair = F.dense_rank().over(Window.orderBy("image", "region")) - 1
    file = pair if apart else image if each else F.lit(0)
    page = F.lit(0) if apart or each and not pages else region if each else pair if pages else image
    return regions.withColumns({"file": file.cast("bigint"), "page": page.cast("bigint")})


def select_pages(pages: DataFrame, which: str | list[int]) -> DataFrame:
    """Pages by number, or `odd`, `even` (counted from 1), `last`, or `a-b`; the number is dir_index, from 0."""
    n = F.col("dir_index")
    if isinstance(which, list):
        return pages.where(n.isin(which))
    if which in ("odd", "even"):
        return pages.where(n % 2 == (0 if which == "odd" else 1))
    if which == "last":
        return pages.join(F.broadcast(pages.agg(F.max("dir_index").alias("dir_index"))), "dir_index")  # one row
    first, last = which.split("-")
    return pages.where(n.between(int(first) - 1, int(last) - 1))


def concat_pages(*sets: DataFrame) -> DataFrame:
    """Page sets after each other, renumbered from 0; the page tables are directories, not pixels.

    A page's new number is its rank in its own set, which numbers the pages of one file, plus the sizes before it.
    """
    out, base = None, 0
    for i, one in enumerate(sets):
        ranks = one.select("dir_index").distinct().withColumn("rank", F.row_number().over(Window.orderBy("dir_index")) - 1)
        placed = one.join(F.broadcast(ranks), "dir_index").withColumn("dir_index", (F.col("rank") + base).cast("bigint")).drop("rank").withColumn("source", F.lit(i))
        out = placed if out is None else out.unionByName(placed)
        base += ranks.count() if i + 1 < len(sets) else 0
    return out


def split_name(n) -> F.Column:
    """Three-letter suffix of the n-th file of a split: aaa, aab, ...; 17,576 at most."""
    letter = lambda k: F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), F.floor(n / k).cast("int") % 26 + 1, 1)
    return F.when(n < 17576, F.concat(letter(676), letter(26), letter(1)))
