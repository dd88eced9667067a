"""Operators on two rasters, or a raster and a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.color import gray_from_rgb, scale_palette

#: A palette has an entry per sample value, and samples that index one have 16 bits at most: the broadcast's bound.
PALETTE_LIMIT = 1 << 16
#: Levels of a channel that share a cell in the search for the nearest entry.
SIDE = 16


def small(df: DataFrame, limit: int = PALETTE_LIMIT) -> DataFrame:
    """df, broadcast if it has `limit` rows at most, which is checked; else as it is, for a shuffled join."""
    return F.broadcast(df) if len(df.select(F.lit(1)).take(limit + 1)) <= limit else df


def with_palette(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """r, g, b of each indexed pixel; entries are 16-bit if any of them is 256 or more."""
    wide = palette.agg((F.max(F.greatest("r", "g", "b")) >= 256).alias("wide"))
    table = palette.crossJoin(F.broadcast(wide))  # one row
    table = table.select("idx", *(scale_palette(F.col(c), F.col("wide")).alias(c) for c in "rgb"))
    return indexed.join(small(table), "idx")


def gray_from_palette(indexed: DataFrame, palette: DataFrame) -> DataFrame:
    """Grey levels of indexed pixels, of palettes of 8 or 16 bits (as with_palette tells them apart)."""
    out = with_palette(indexed, palette)
    return out.withColumn("v", gray_from_rgb(F.col("r"), F.col("g"), F.col("b"))).drop("idx", "r", "g", "b")


def bias_subtract(image: DataFrame, bias: DataFrame, keys: tuple[str, ...] = ("y", "x"), value: str = "v") -> DataFrame:
    """image less bias, not below 0, pixel by pixel: an equi-join on the coordinates."""
    b = bias.select(*keys, F.col(value).alias("_bias"))
    return image.join(b, list(keys)).withColumn(value, F.greatest(F.col(value) - F.col("_bias"), F.lit(0))).drop("_bias")


def compare(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("y", "x"), value: str = "v", limit: int | None = None) -> DataFrame:
    """Pixels that differ or that one side lacks, in order of the keys; `limit` of them if asked for."""
    a, b = left.select(*keys, F.col(value).alias("left")), right.select(*keys, F.col(value).alias("right"))
    out = a.join(b, list(keys), "full_outer").where(~F.col("left").eqNullSafe(F.col("right")))
    return out if limit is None else out.orderBy(*keys).limit(limit)


def compare_tags(left: DataFrame, right: DataFrame) -> DataFrame:
    """Tags (tag, value) whose values differ or that one side lacks."""
    return compare(left, right, ("tag",))


def regions_of(pixels: DataFrame, regions: DataFrame) -> DataFrame:
    """Pixels of each listed rectangle (region_id, x1, y1, x2, y2), at coordinates relative to it.

    The list is what a user typed; it is broadcast behind a check, and pixels meet it by range.
    """
    inside = F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    out = pixels.join(small(regions), inside)
    return out.withColumns({"x": F.col("x") - F.col("x1"), "y": F.col("y") - F.col("y1")}).drop("x1", "y1", "x2", "y2")


def composite(pixels: DataFrame, regions: DataFrame, edge: str = "top") -> DataFrame:
    """Regions in order of region_id as one raster: below each other (edge top, bottom) or side by side (left, right)."""
    from pyspark.sql import Window

    axis = {"top": "y", "bottom": "y", "left": "x", "right": "x"}[edge]
    size = F.col(f"{axis}2") - F.col(f"{axis}1") + 1
    placed = regions.withColumn("base", F.sum(size).over(Window.orderBy("region_id")) - size)  # a few typed rows: one partition is enough
    return regions_of(pixels, placed).withColumn(axis, F.col(axis) + F.col("base")).drop("base", "region_id")


def nearest_palette(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """For each different colour (r, g, b), the index of the palette entry at the least squared distance.

    Ties go to the smallest index. Distinct colours come first, so that a pixel is never paired with the palette, and a
    colour is compared with those entries only that can be nearest to a colour of its cell (SIDE levels of each channel;
    4,096 cells): whose least distance to the cell isn't over the largest distance that some entry has at most.
    """
    if len(palette.select(F.lit(1)).take(PALETTE_LIMIT + 1)) > PALETTE_LIMIT:
        raise ValueError(f"a palette has {PALETTE_LIMIT} entries at most")
    kinds = colors.select("r", "g", "b").distinct()
    entries = palette.agg(F.sort_array(F.collect_list(F.struct("idx", "r", "g", "b"))).alias("entries"))  # PALETTE_LIMIT at most
    own = [F.floor(F.col(x) / SIDE).cast("long").alias(f"c{x}") for x in "rgb"]
    gap = lambda e, x: F.greatest(F.col(f"c{x}") * SIDE - e[x], e[x] - F.col(f"c{x}") * SIDE - (SIDE - 1), F.lit(0))
    reach = lambda e, x: F.greatest(e[x] - F.col(f"c{x}") * SIDE, F.col(f"c{x}") * SIDE + (SIDE - 1) - e[x])
    squares = lambda parts: sum((p * p for p in parts[1:]), parts[0] * parts[0])
    cells = kinds.select(*own).distinct().crossJoin(F.broadcast(entries))  # one row
    most = F.array_min(F.transform("entries", lambda e: squares([reach(e, x) for x in "rgb"])))
    # bound to a variable, for as a column it would be worked out for each entry
    near = F.flatten(F.transform(F.array(most), lambda m: F.filter("entries", lambda e: squares([gap(e, x) for x in "rgb"]) <= m)))
    cells = cells.select("cr", "cg", "cb", near.alias("near"))
    met = kinds.select("r", "g", "b", *own).join(cells, ["cr", "cg", "cb"])
    best = F.array_min(F.transform("near", lambda e: F.struct(squares([e[x] - F.col(x) for x in "rgb"]).alias("d"), e["idx"].alias("idx"))))
    return met.select("r", "g", "b", best.alias("best")).select("r", "g", "b", F.col("best.idx").alias("idx"), F.col("best.d").alias("distance"))


def quantise(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """pixels (y, x, r, g, b, ...) with the index of the nearest palette entry."""
    return pixels.join(nearest_palette(pixels, palette).drop("distance"), ["r", "g", "b"])


def matrix(c: Column, rows: tuple[tuple[float, ...], ...]) -> list[Column]:
    """A linear map of an array column."""
    return [sum((F.get(c, F.lit(i)) * k for i, k in enumerate(row)), F.lit(0.0)) for row in rows]
