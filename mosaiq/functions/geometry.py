"""Coordinates and sizes of rasters, strips and tiles, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.functions.color import idiv


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def rotate(x: Column, y: Column, w, h, degrees: int) -> tuple[Column, Column]:
    """Where a pixel goes when the raster is turned clockwise."""
    w, h = _c(w), _c(h)
    turns = {0: (x, y), 90: (h - 1 - y, x), 180: (w - 1 - x, h - 1 - y), 270: (y, w - 1 - x)}
    if degrees % 360 not in turns:
        raise ValueError("degrees must be a multiple of 90")
    return turns[degrees % 360]


def mirror(x: Column, y: Column, w, h, how: str) -> tuple[Column, Column]:
    w, h = _c(w), _c(h)
    return {"horizontal": (w - 1 - x, y), "vertical": (x, h - 1 - y), "both": (w - 1 - x, h - 1 - y)}[how]


def upright(x: Column, y: Column, w, h, orientation) -> tuple[Column, Column]:
    """Where a stored pixel is seen, for orientations 1 to 8 (a number or a column); others count as 1."""
    w, h, o = _c(w), _c(h), _c(orientation)
    right, bottom = w - 1 - x, h - 1 - y
    by = {2: (right, y), 3: (right, bottom), 4: (x, bottom), 5: (y, x), 6: (bottom, x), 7: (bottom, right), 8: (y, right)}
    sx, sy = F.when(o == 1, x), F.when(o == 1, y)
    for k, (a, b) in by.items():
        sx, sy = sx.when(o == k, a), sy.when(o == k, b)
    return sx.otherwise(x), sy.otherwise(y)


def crop(pixels: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Pixels of a rectangle (ends included) at coordinates relative to it; a filter that reaches the scan."""
    return pixels.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1)).withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})


def crop_margins(pixels: DataFrame, w: int, h: int, left: int = 0, top: int = 0, right: int = 0, bottom: int = 0) -> DataFrame:
    return crop(pixels, left, top, w - 1 - right, h - 1 - bottom)


def crop_edge(pixels: DataFrame, w: int, h: int, edge: str, size: int) -> DataFrame:
    """`size` rows or columns that touch an edge."""
    box = {"left": (0, 0, size - 1, h - 1), "right": (w - size, 0, w - 1, h - 1), "top": (0, 0, w - 1, size - 1), "bottom": (0, h - size, w - 1, h - 1)}[edge]
    return crop(pixels, *box)


def zone(pixels: DataFrame, size: int, part: int, of: int, axis: str = "y") -> DataFrame:
    """The part-th (from 1) of `of` equal zones along an axis."""
    lo, hi = size * (part - 1) // of, size * part // of - 1
    return pixels.where(F.col(axis).between(lo, hi)).withColumn(axis, F.col(axis) - lo)


def sections(pixels: DataFrame, w: int, h: int, cols: int, rows: int) -> DataFrame:
    """Pixels with the number of their grid section (row by row) and coordinates in it."""
    sw, sh = -(-w // cols), -(-h // rows)
    sx, sy = idiv(F.col("x"), sw), idiv(F.col("y"), sh)
    return pixels.withColumns({"section": sy * cols + sx, "x": F.col("x") - sx * sw, "y": F.col("y") - sy * sh})


#: Width and length of papers in inches.
PAPERS = {
    "default": (8.5, 14), "pa4": (8.264, 11), "letter": (8.5, 11), "legal": (8.5, 14), "half-letter": (8.5, 5.514), "executive": (7.264, 10.528),
    "tabloid": (11, 17), "11x17": (11, 17), "ledger": (17, 11), "archa": (9, 12), "archb": (12, 18), "archc": (18, 24),
    "archd": (24, 36), "arche": (36, 48), "csheet": (17, 22), "dsheet": (22, 34), "esheet": (34, 44), "superb": (11.708, 17.042),
    "commercial": (4.139, 9.528), "monarch": (3.889, 7.528), "envelope-dl": (4.333, 8.681), "envelope-c5": (6.389, 9.028), "europostcard": (4.139, 5.833), "a0": (33.11, 46.811),
    "a1": (23.386, 33.11), "a2": (16.535, 23.386), "a3": (11.693, 16.535), "a4": (8.268, 11.693), "a5": (5.827, 8.268), "a6": (4.134, 5.827),
    "a7": (2.913, 4.134), "a8": (2.047, 2.913), "a9": (1.457, 2.047), "a10": (1.024, 1.457), "b0": (39.37, 55.669), "b1": (27.835, 39.37),
    "b2": (19.685, 27.835), "b3": (13.898, 19.685), "b4": (9.843, 13.898), "b5": (6.929, 9.843), "b6": (4.921, 6.929), "c0": (36.102, 51.063),
    "c1": (25.512, 36.102), "c2": (18.031, 25.512), "c3": (12.756, 18.031), "c4": (9.016, 12.756), "c5": (6.378, 9.016), "c6": (4.488, 6.378),
}


def page_size(w: int, h: int, paper: str | tuple[float, float], dpi: tuple[float, float], margins: tuple[float, float] = (0, 0), turned: bool | None = False) -> tuple[int, int]:
    """Columns and rows of a raster that one sheet takes: its size less margins (across, down) on either side.

    paper: a name of PAPERS, or width and length in the unit that dpi counts pixels by, as margins are. turned: the sheet lies
    on its side; None: it lies so unless it takes fewer sheets upright.
    """
    size = PAPERS[paper] if isinstance(paper, str) else paper
    edges = [int(m * r) for m, r in zip(margins, dpi, strict=True)]
    if any(2 * e > s * r for e, s, r in zip(edges, size, dpi, strict=True)):
        raise ValueError("margins exceed the sheet")
    pw, ph = (min(int(s * r - 2 * e), n) for e, s, r, n in zip(edges, size, dpi, (w, h), strict=True))
    if pw < 1 or ph < 1:
        raise ValueError("a sheet holds no pixel")
    if turned is None:
        turned = -(-w // pw) * -(-h // ph) >= -(-w // ph) * -(-h // pw)
    return (ph, pw) if turned else (pw, ph)


def page_sections(pixels: DataFrame, w: int, h: int, paper: str | tuple[float, float], dpi: tuple[float, float], margins: tuple[float, float] = (0, 0), turned: bool | None = False) -> DataFrame:
    """Pixels with the number of the sheet that they are printed on (row by row) and coordinates on it; see page_size."""
    pw, ph = page_size(w, h, paper, dpi, margins, turned)
    sx, sy = idiv(F.col("x"), pw), idiv(F.col("y"), ph)
    return pixels.withColumns({"section": sy * -(-w // pw) + sx, "x": F.col("x") - sx * pw, "y": F.col("y") - sy * ph})


def tile_index(x: Column, y: Column, w: int, h: int, tw: int, th: int, plane: Column | int = 0, z: Column | int = 0, depth: int = 1) -> Column:
    """Number of the tile that holds a sample, in a raster of planes of depth layers."""
    across, down = ((idiv(n + (t - 1), t) if isinstance(n, Column) else -(-n // t)) for n, t in ((w, tw), (h, th)))
    return idiv(y, th) * across + idiv(x, tw) + _c(z) * (across * down) + _c(plane) * (across * down * depth)


def strip_index(y: Column, h: int, rows: int, plane: Column | int = 0) -> Column:
    return idiv(y, rows) + _c(plane) * (-(-h // rows))


def scanline_bytes(w, bits, samples, planar: bool = False, subsampling: tuple[int, int] | None = None) -> Column:
    """Bytes of a row; of subsampled YCbCr, of a row of blocks divided by the rows in it."""
    w, bits, samples = _c(w), _c(bits), _c(samples)
    if subsampling and not planar:
        sh, sv = subsampling
        blocks = idiv(w + sh - 1, sh)
        return idiv(idiv(blocks * (sh * sv + 2) * bits + 7, 8), sv)
    return idiv(w * bits * (F.lit(1) if planar else samples) + 7, 8)


def default_rows_per_strip(line_bytes: Column, target: int = 8192) -> Column:
    """Rows that make a strip of about `target` bytes, one at least."""
    return F.greatest(idiv(F.lit(target), F.greatest(line_bytes, F.lit(1))), F.lit(1))


def default_tile(w: Column) -> Column:
    """Tile edges are multiples of 16, 256 where none is asked for."""
    return F.when(w < 1, 256).otherwise(idiv(w + 15, 16) * 16)
