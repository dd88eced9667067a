"""Inherently sequential algorithms: error diffusion by image, median cut over a bounded histogram."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def diffuse(lines: np.ndarray, threshold: int = 128, lag: bool = False) -> np.ndarray:
    """Bilevel image by error diffusion: 7, 3, 5 and 1 sixteenths, divisions truncating towards zero.

    lag: row i is made from input row max(i - 1, 0), a quirk kept for comparisons.
    """
    h, w = lines.shape
    out = np.zeros((h, w), np.uint8)
    this = lines[0].astype(int).tolist() if h else []
    for y in range(h):
        source = max(y, 0) if lag else y + 1
        nxt = lines[min(source, h - 1)].astype(int).tolist()
        for x in range(w):
            v = min(255, max(0, this[x]))
            on = v > threshold
            out[y, x] = on
            e = v - 255 if on else v
            part = lambda k, e=e: int(e * k / 16)
            if x + 1 < w:
                this[x + 1] += part(7)
                nxt[x + 1] += part(1)
            nxt[x] += part(5)
            if x:
                nxt[x - 1] += part(3)
        this = nxt
    return out


def dither(images: DataFrame, threshold: int = 128, lag: bool = False) -> DataFrame:
    """(image_id, y, x, bit) of grey pixels (image_id, y, x, v); images are independent, one image is one task's work."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["y", "x"])
        h, w = rows["y"].nunique(), rows["x"].nunique()
        bits = diffuse(rows["v"].to_numpy().reshape(h, w), threshold, lag)
        return rows[["image_id", "y", "x"]].assign(bit=bits.reshape(-1).astype(np.int64))

    return images.select("image_id", "y", "x", "v").groupBy("image_id").applyInPandas(work, "image_id long, y long, x long, bit long")


def diffuse_palette(image: np.ndarray, palette: np.ndarray) -> np.ndarray:
    """Palette indices (rows, columns) of a colour image by error diffusion: the nearest entry (ties: the first) of the
    clamped colour; what is missing goes on by 7, 3, 5 and 1 sixteenths, truncating towards zero."""
    h, w, _ = image.shape
    out, work, entries = np.zeros((h, w), np.int64), image.astype(np.int64), palette.astype(np.int64)
    known: dict[tuple[int, ...], int] = {}
    for y in range(h):
        for x in range(w):
            color = tuple(np.clip(work[y, x], 0, 255).tolist())
            if (k := known.get(color)) is None:
                k = known[color] = int(((entries - color) ** 2).sum(axis=1).argmin())
            out[y, x] = k
            error = np.array(color) - entries[k]
            part = lambda n, e=error: np.trunc(e * n / 16).astype(np.int64)
            if x + 1 < w:
                work[y, x + 1] += part(7)
            if y + 1 < h:
                work[y + 1, x] += part(5)
                if x:
                    work[y + 1, x - 1] += part(3)
                if x + 1 < w:
                    work[y + 1, x + 1] += part(1)
    return out


def dither_palette(images: DataFrame, entries: list[tuple[int, int, int]]) -> DataFrame:
    """(image_id, y, x, idx) of colour pixels (image_id, y, x, r, g, b); one image is one task's work. entries: 65,536 at most."""
    if len(entries) > 1 << 16:
        raise ValueError("a palette has 65,536 entries at most")
    palette = np.array(entries).reshape(-1, 3)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        h, w = rows["y"].nunique(), rows["x"].nunique()
        rows = rows.sort_values(["y", "x"])
        found = diffuse_palette(rows[["r", "g", "b"]].to_numpy().reshape(h, w, 3), palette)
        return rows[["image_id", "y", "x"]].assign(idx=found.reshape(-1))

    return images.select("image_id", "y", "x", "r", "g", "b").groupBy("image_id").applyInPandas(work, "image_id long, y long, x long, idx long")


def median_cut(histogram: DataFrame, colors: int = 256) -> list[tuple[int, int, int]]:
    """Palette of at most `colors` entries from a histogram (r5, g5, b5, n) of at most 32,768 buckets.

    The most populous box that can be split is cut across its longest axis where half of its pixels lie on either
    side; an entry is the middle of a box's range, in 8 bits.
    """
    rows = histogram.select("r5", "g5", "b5", "n").limit(32769).collect()
    if len(rows) > 32768:
        raise ValueError("a histogram has a row for each of 32,768 buckets at most")
    if not rows:
        return []
    rows = sorted(tuple(r) for r in rows)
    points, counts = np.array([r[:3] for r in rows]), np.array([r[3] for r in rows])
    heap, done, serial = [(-int(counts.sum()), 0, np.arange(len(rows)))], [], 0
    while heap and len(heap) + len(done) < colors:
        _, _, box = heapq.heappop(heap)
        own = points[box]
        spread = own.max(axis=0) - own.min(axis=0)
        if not spread.any():
            done.append(box)
            continue
        axis = int(spread.argmax())
        order = box[np.argsort(own[:, axis], kind="stable")]
        line, run = points[order, axis], np.cumsum(counts[order])
        cut = int(line[int(np.searchsorted(run, run[-1] / 2))])
        cut = min(cut, int(line[-1]) - 1)
        for half in (order[line <= cut], order[line > cut]):
            serial += 1
            heapq.heappush(heap, (-int(counts[half].sum()), serial, half))
    boxes = done + [x[2] for x in heap]
    return sorted(tuple(int(v) for v in ((points[b].min(axis=0) + points[b].max(axis=0) + 1) * 8 // 2)) for b in boxes)


def palette_frame(spark, entries: list[tuple[int, int, int]]) -> DataFrame:
    return spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], "idx int, r int, g int, b int")


def rational(value: float, limit: int = 0xFFFFFFFF) -> tuple[int, int]:
    """Numerator and denominator, neither over `limit`, of the best continued-fraction approximation of value >= 0."""
    if value != value or value < 0:
        raise ValueError("a rational is 0 or more")
    if value > limit:
        return limit, 1
    n0, d0, n1, d1, x = 0, 1, 1, 0, value
    for _ in range(64):
        a = int(x)
        n2, d2 = a * n1 + n0, a * d1 + d0
        if n2 > limit or d2 > limit:
            break
        n0, d0, n1, d1 = n1, d1, n2, d2
        if x == a or abs(n1 / d1 - value) <= 1e-16 * value:
            break
        x = 1 / (x - a)
    return n1, d1


@F.pandas_udf(T.StructType([T.StructField("num", T.LongType()), T.StructField("den", T.LongType())]))
def to_rational(values: pd.Series) -> pd.DataFrame:
    """rational() of whole batches; null, negative and not-a-number values give null."""
    v, limit = values.to_numpy(np.float64, na_value=np.nan), 0xFFFFFFFF
    bad, large = ~(v >= 0), v > limit
    x = np.where(bad | large, 0.0, v)
    target = x.copy()
    n0, d0 = np.zeros(len(v), np.int64), np.ones(len(v), np.int64)
    n1, d1 = d0.copy(), n0.copy()
    live = np.ones(len(v), bool)
    for _ in range(64):
        a = np.floor(np.where(live, x, 0.0))
        # in floats first: beyond the limit, whole numbers could overflow
        live &= (a * n1 + n0 <= limit) & (a * d1 + d0 <= limit)
        if not live.any():
            break
        i = np.where(live, a, 0).astype(np.int64)
        n0, d0, n1, d1 = np.where(live, n1, n0), np.where(live, d1, d0), np.where(live, i * n1 + n0, n1), np.where(live, i * d1 + d0, d1)
        with np.errstate(divide="ignore", invalid="ignore"):
            live &= (x != a) & ~(np.abs(n1 / d1 - target) <= 1e-16 * target)
            x = np.where(live, 1 / (x - a), 0.0)
    n1, d1 = np.where(large, limit, n1), np.where(large, 1, d1)
    return pd.DataFrame({"num": pd.array(n1, "Int64"), "den": pd.array(d1, "Int64")}).mask(pd.Series(bad))
