"""SimHash fingerprints, linked by tiled exact comparison of their bits."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import connected_components, LOWER, salted_left_join, Scratch, trimmed, UPPER, write_table

TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Rows and columns of a tile.
TILE = 1024


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """64 majority bits over the XXH64 of all shingles of `words` words, repeats included; no word: 0."""
    found = (text or "").encode("utf-8", "replace").translate(TO_LOWER).split()
    if not found:
        return 0
    joined, n = b" ".join(found), len(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1)
    k = min(words, n)
    starts = np.concatenate([[0], ends[: n - k]]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), same (a hash of the text) of every row; whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "same"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("same")).mapInArrow(trimmed(work), "doc_id long, fp long, same long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)


class Forest:
    """Union-find over positions; only links between different trees cost anything."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            ra, rb = self.roots(a), self.roots(b)
            apart = ra != rb
            a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
            np.minimum.at(self.up, np.maximum(ra, rb), np.minimum(ra, rb))

    def roots(self, x: np.ndarray) -> np.ndarray:
        x = self.up[x]
        while not np.array_equal(x, up := self.up[x]):
            x = up
        return x


def near_links(left: np.ndarray, right: np.ndarray | None, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, its root's), of the links within radius of left x right, or left x left.

    Sides are sorted by the bit counts of their 16-bit quarters. As a pair's distance is at least the sum of its
    quarters' count differences, tile pairs whose ranges of counts are further apart than radius are skipped; all
    others are compared in full by exclusive-or and bit count.
    """
    sides = []
    for x in (left, left if right is None else right):
        q = _quarters(x)
        order = np.lexsort(q.T)
        x, q = x[order], q[order]
        cuts = np.arange(0, len(x), tile)
        sides.append((x, cuts, np.minimum.reduceat(q, cuts) if len(x) else q, np.maximum.reduceat(q, cuts) if len(x) else q))
    (a, ca, lo_a, hi_a), (b, cb, lo_b, hi_b) = sides
    both, shift = (a, 0) if right is None else (np.concatenate([a, b]), len(a))
    forest = Forest(len(both))
    for i, at in enumerate(ca):
        gap = (np.maximum(lo_a[i] - hi_b, 0) + np.maximum(lo_b - hi_a[i], 0)).sum(axis=1)
        for j in np.flatnonzero(gap <= radius):
            if right is None and j < i:
                continue
            x, y = a[at : at + tile], b[cb[j] : cb[j] + tile]
            u, v = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            if right is None and i == j:
                u, v = u[u < v], v[u < v]
            forest.link(u + at, v + cb[j] + shift)
    roots = forest.roots(np.arange(len(both)))
    moved = np.flatnonzero(roots != np.arange(len(both)))
    return both[moved], both[roots[moved]]


def link_fingerprints(distinct: DataFrame, radius: int, chunk: int | None = None) -> DataFrame:
    """(src, dst): links that join all distinct fingerprints (column fp) which chains of near ones connect.

    Fingerprints are dealt into chunks by population count, large counts into several chunks of about `chunk`;
    a task compares one pair of chunks whose counts are within radius. So no task holds more than two chunks, and
    each fingerprint is sent as often as its chunk has partners, about the square root of what all pairs would need.
    Chunks are numbered in order of their counts, so a chunk's partners are a range that each row works out itself;
    the driver holds 65 sizes.
    """
    counted = distinct.withColumn("p", F.bit_count("fp"))
    sizes = {r["p"]: r["count"] for r in counted.groupBy("p").count().collect()}  # 65 rows at most
    chunk = chunk or max(4096, min(1 << 20, sum(sizes.values()) // 24))
    parts = [math.ceil(sizes.get(p, 0) / chunk) for p in range(65)]
    first = [0, *accumulate(parts)]
    by_count = lambda values: F.get(F.array(*map(F.lit, values)), F.col("p"))
    own = by_count(first[:65]) + F.pmod(F.xxhash64("fp"), by_count([max(1, n) for n in parts]))
    low, high = by_count([first[max(0, p - radius)] for p in range(65)]), by_count([first[min(65, p + radius + 1)] for p in range(65)])
    sent = counted.select("fp", own.cast("int").alias("i"), F.explode(F.sequence(low, high - 1)).alias("j"))
    sent = sent.select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), (F.col("i") <= F.col("j")).alias("one"), "fp")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        fp, one = rows["fp"].to_numpy().view(np.uint64), rows["one"].to_numpy()
        src, dst = near_links(fp[one], None if key[0] == key[1] else fp[~one], radius)
        return pd.DataFrame({"src": src.view(np.int64), "dst": dst.view(np.int64)})

    return sent.groupBy("a", "b").applyInPandas(compare, "src long, dst long")


def _grouped(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id, fp, same, component_id of every row."""
    tables = Scratch(docs.sparkSession)
    marks = write_table(fingerprints(docs), "simhash")
    nodes = tables.write(marks.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "nodes")
    links = tables.write(link_fingerprints(nodes.select("fp"), radius), "links")
    labels = connected_components(links).withColumnRenamed("node", "fp")
    tops = labels.join(nodes, "fp").groupBy("label").agg(F.min("first").alias("component_id"))
    linked = salted_left_join(labels, tops, ["label"], F.col("fp")).select("fp", "component_id", F.lit(True).alias("linked"))
    lookup = nodes.join(linked, "fp", "left").where("n > 1 or linked").select("fp", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first")).alias("component_id"), F.lit(True).alias("known"))
    lookup = write_table(lookup, "lookup")
    tables.clear()
    out = salted_left_join(marks, lookup, ["fp"], F.struct("doc_id", "same"), shuffled=True)
    return out.select("doc_id", "fp", "same", F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def near_groups(docs: DataFrame, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links of radius bits or fewer reach.

    Null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints are one node.
    Rows with a null doc_id take part; they get the component's smallest id, null if it has none. Rows repeated
    whole get one result each. Empty table: no rows.
    """
    return _grouped(docs, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = 4) -> DataFrame:
    """The rows of docs, all columns, that are their component's smallest doc_id.

    A row goes by its doc_id and text, so another row of its doc_id stays unless it is a near copy itself. Rows repeated
    whole share one fate, and rows with a null doc_id stay. Null and empty texts are near copies of each other. Columns
    may have any names. Empty table: no rows.
    """
    gone = _grouped(docs, radius).where("component_id < doc_id").select(F.col("doc_id").alias("_id"), F.col("same").alias("_same")).distinct()
    hit = (docs["doc_id"].cast("long") == F.col("_id")) & (F.xxhash64(docs["text"].cast("string")) == F.col("_same"))
    return docs.join(gone, hit, "left_anti").select(docs.columns)
