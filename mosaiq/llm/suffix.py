"""Suffix-array dedup of long repeats: a logarithmic family of suffix arrays over content-chosen anchors.

A byte goes if a string of `length` bytes that covers it also starts elsewhere in the corpus. Every window of that
length names one anchor in it, the leftmost k-byte string of least hash, so equal windows name equal anchors at equal
places. Suffix arrays therefore hold the anchors only (about one per 170 bytes), and only those whose k bytes occur
again. A window that begins d bytes before its anchor repeats if another anchor shares d bytes to the left and
length - d to the right: both follow from the arrays' neighbouring common prefixes, exactly.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import salted_left_join, Scratch, trimmed

LENGTH, ANCHOR = 400, 64
#: Bytes of a repeated passage: 50 words of three letters and a space.
PASSAGE = 200
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Bytes of text that are hashed at once; contexts in a new batch of an index family.
CHUNK, BATCH = 1 << 20, 8192

#: A row: its doc_id and a hash of its text, so that only texts of one doc_id could be taken for each other.
RID = "rid struct<d:long,h:long>"
ANCHORS = RID + ", key long, ctx long, at int, dmin int, dmax int"


class Roller:
    """Hashes of all k-byte strings of a buffer, by prefix sums modulo 2^64."""

    def __init__(self):
        self.power = self.back = np.ones(1, np.uint64)

    def hashes(self, data: np.ndarray, k: int) -> np.ndarray:
        if len(self.power) < len(data):
            n = 1 << len(data).bit_length()
            self.power, self.back = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n, x)])) for x in (BASE, INVERSE))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        h = (sums[k:] - sums[:-k]) * self.back[: len(data) - k + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def anchors(data: np.ndarray, first: np.ndarray, roller: Roller, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of the anchors of texts laid end to end.

    first: for each byte, where its text begins. Windows across texts name no anchor.
    """
    n, w = len(data), length - k + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none
    h = roller.hashes(data, k)
    size = -(-len(h) // w) * w
    block = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    block[: len(h)] = h
    block = block.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).reshape(-1)
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[w - 1 : w - 1 + windows])
    valid = first[:windows] == first[length - 1 :]
    new = valid.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new)
    last = valid.copy()
    last[:-1] &= new[1:] | ~valid[1:]
    stop = np.flatnonzero(last)
    if not len(start):
        return none.astype(np.uint64), none, none, none
    at = start + np.lib.stride_tricks.sliding_window_view(h, w)[start].argmin(axis=1)
    once = stop <= at
    out = [(h[at[once]], at[once], start[once], stop[once])]
    for s, e in zip(start[~once].tolist(), stop[~once].tolist(), strict=True):  # the least hash comes again
        own = s + np.flatnonzero(h[s : e + w] == least[s])
        begin = np.concatenate([[s], own[:-1] + 1])
        begin = begin[begin <= e]
        own = own[: len(begin)]
        out.append((h[own], own, begin, np.minimum(own, e)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _texts(batches: Iterator[pa.RecordBatch], name: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches of about CHUNK bytes, with their texts in UTF-8; null is empty."""
    for batch in batches:
        column = batch.column(name).cast(pa.binary())
        begin = size = 0
        for i in range(batch.num_rows):
            size += len(column[i].as_buffer() or b"")
            if size >= CHUNK or i == batch.num_rows - 1:
                part = column.slice(begin, i + 1 - begin)
                yield batch.slice(begin, i + 1 - begin), [x or b"" for x in part.to_pylist()]
                begin, size = i + 1, 0


def find_anchors(rows: DataFrame, length: int, k: int) -> DataFrame:
    """All anchors of all whole texts: key (hash of the k bytes), ctx (hash of every byte its windows cover)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for part, texts in _texts(batches):
            sizes = np.array([len(x) for x in texts])
            begins = np.cumsum(sizes) - sizes
            joined = b"".join(texts)
            h, at, lo, hi = anchors(np.frombuffer(joined, np.uint8), np.repeat(begins, sizes), roller, length, k)
            which = np.searchsorted(begins, at, "right") - 1
            dmax, dmin = at - lo, at - hi
            ctx = np.fromiter((xxhash.xxh3_64_intdigest(joined[a : b + length], d) for a, b, d in zip(lo.tolist(), hi.tolist(), dmax.tolist(), strict=True)), np.uint64, len(at))
            cols = [part.column(0).take(pa.array(which)), pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64)), *(pa.array(x.astype(np.int32)) for x in (at - begins[which], dmin, dmax))]
            yield pa.RecordBatch.from_arrays(cols, names=["rid", "key", "ctx", "at", "dmin", "dmax"])

    return rows.select("rid", F.col("text").cast("string").alias("text")).mapInArrow(trimmed(work), ANCHORS)


class Family:
    """Suffix arrays of sizes that double: batches enter, are scanned against each level, and equal levels merge."""

    def __init__(self, length: int, k: int):
        self.length, self.k = length, k
        self.right: list[bytes] = []
        self.left: list[bytes] = []
        self.dmin: list[int] = []
        self.dmax: list[int] = []
        self.levels: list[list[int]] = []
        self.marks = np.zeros((0, length - k + 1), bool)

    def add(self, contexts: list[bytes], dmin: list[int], dmax: list[int]) -> None:
        base = len(self.right)
        for c, d in zip(contexts, dmax, strict=True):
            self.right.append(c[d:])
            self.left.append(c[:d][::-1])
        self.dmin += dmin
        self.dmax += dmax
        self.marks = np.concatenate([self.marks, np.zeros((len(contexts), self.marks.shape[1]), bool)])
        array = sorted(range(base, len(self.right)), key=self.right.__getitem__)
        self.scan(array)
        for level in self.levels:
            self.scan(self.merge(array, level))
        self.levels.append(array)
        while len(self.levels) > 1 and 2 * len(self.levels[-1]) > len(self.levels[-2]):
            one, two = self.levels.pop(), self.levels.pop()
            self.levels.append(self.merge(two, one))

    def merge(self, one: list[int], two: list[int]) -> list[int]:
        return sorted(one + two, key=self.right.__getitem__)  # two sorted runs: a linear merge

    @staticmethod
    def common(strings: list[bytes], most: int) -> np.ndarray:
        """Common prefixes of each string with the one before; 0 for the first."""
        out = np.zeros(len(strings), np.int32)
        for at in range(0, len(strings), 4096):
            part = strings[max(0, at - 1) : at + 4096]
            size = np.array([min(len(x), most) for x in part])
            rows = np.frombuffer(b"".join(x[:most].ljust(most, b"\0") for x in part), np.uint8).reshape(-1, most) if most else np.zeros((len(part), 0), np.uint8)
            differ = np.ones((len(part) - 1, most + 1), bool)
            differ[:, :most] = rows[1:] != rows[:-1]
            same = np.minimum(differ.argmax(axis=1), np.minimum(size[1:], size[:-1]))
            out[at + (at == 0) : at + 4096] = same
        return out

    def scan(self, array: list[int]) -> None:
        """Mark the windows that two suffixes of a sorted array share."""
        length, n = self.length, len(array)
        if n < 2:
            return
        right = self.common([self.right[i] for i in array], length)
        keep = np.flatnonzero(np.maximum(right, np.append(right[1:], 0)) >= self.k)  # the others share no anchor
        # suffixes of one anchor are neighbours, so a suffix that is passed over parts those around it
        array, right = [array[i] for i in keep], np.where(np.diff(keep, prepend=-2) == 1, right[keep], 0)
        n = len(array)
        if n < 2:
            return
        order = sorted(range(n), key=lambda i: self.left[array[i]])
        left = self.common([self.left[array[i]] for i in order], length - self.k)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        ids = np.array(array)
        dmin, dmax = np.array(self.dmin)[ids], np.array(self.dmax)[ids]
        near = np.maximum(left, np.append(left[1:], 0))[place] + np.maximum(right, np.append(right[1:], 0))
        dmax = np.where(near >= length, dmax, -1)  # no pair of a suffix shares more than its neighbours do
        for d in range(length - self.k + 1):
            valid = np.flatnonzero((dmin <= d) & (d <= dmax))
            if len(valid) < 2:
                continue
            to_right, to_left = np.cumsum(right < length - d), np.cumsum(left < d)
            pair = to_right[valid] * np.int64(n + 1) + to_left[place[valid]]
            by = np.argsort(pair, kind="stable")
            same = np.zeros(len(by), bool)
            equal = pair[by][1:] == pair[by][:-1]
            same[1:] |= equal
            same[:-1] |= equal
            self.marks[ids[valid[by[same]]], d] = True

    def runs(self, i: int) -> list[tuple[int, int]]:
        """Runs of marked windows of a context, as ranges of d."""
        edge = np.flatnonzero(np.diff(self.marks[i].astype(np.int8), prepend=0, append=0))
        return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def repeats(rows: DataFrame, length: int = LENGTH, k: int = ANCHOR, cap: int = 20_000, bucket: int = 40_000) -> DataFrame:
    """(rid, spans): for rows (rid, text, ...) with a repeat, the byte ranges that repeated windows cover.

    Anchors of equal contexts are one class: they repeat wholly, and one of them stands for all in the arrays.
    Classes go by the anchor's hash to buckets of about `bucket`, each with an index family of its own. An anchor
    of over `cap` different contexts would make one bucket large; its windows are grouped by their 128-bit hashes
    instead, each window alone, which spreads them over all tasks.
    """
    tables, last = Scratch(rows.sparkSession), Scratch(rows.sparkSession)
    write_table = tables.write
    found = write_table(find_anchors(rows, length, k), "anchors")
    # written, so that the join below has an exchange of its own on either side and a hot key can be split
    again = write_table(found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), (F.min("ctx") != F.max("ctx")).alias("mixed")).where("n > 1").drop("n"), "keys")
    marked = write_table(found.join(again, "key"), "repeated")
    whole = lambda df: df.select("rid", (F.col("at") - F.col("dmax")).alias("s"), (F.col("at") - F.col("dmin") + length).alias("e"))
    mixed = marked.where("mixed").drop("mixed")
    classes = write_table(mixed.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rid", "at", "dmin", "dmax")).alias("one")), "classes")
    copies = classes.where("n > 1").select("key", "ctx", F.lit(True).alias("hit"))
    parts = [whole(marked.where("not mixed")), whole(salted_left_join(mixed, copies, ["key", "ctx"], F.struct("rid", "at")).where("hit"))]
    hot = classes.groupBy("key").count().where(F.col("count") > cap).select("key", F.lit(True).alias("hot"))
    listed = classes.join(hot, "key", "left").select("key", (F.col("n") == 1).alias("alone"), F.coalesce("hot", F.lit(False)).alias("hot"), "one.*")
    listed = listed.groupBy("rid").agg(F.collect_list(F.struct("key", "alone", "hot", "at", "dmin", "dmax")).alias("want"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = ["key", "alone", "hot", "at", "dmin", "dmax", "bytes"], [pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for part, texts in _texts(batches):
            out, of = [], []
            for i, (raw, want) in enumerate(zip(texts, part.column("want").to_pylist(), strict=True)):
                out += [(x["key"], x["alone"], x["hot"], x["at"], x["dmin"], x["dmax"], raw[x["at"] - x["dmax"] : x["at"] - x["dmin"] + length]) for x in want or ()]
                of += [i] * len(want or ())
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("rid").take(pa.array(of)), *cols], names=["rid", *names])

    held = rows.join(listed, "rid", "left").mapInArrow(trimmed(contexts), RID + ", key long, alone boolean, hot boolean, at int, dmin int, dmax int, bytes binary")
    n_classes = classes.count()
    if n_classes:
        held = write_table(held, "contexts")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, own, rids, wait = Family(length, k), [], [], []
        def enter() -> None:
            family.add(*map(list, zip(*wait, strict=True)))
            wait.clear()
        for batch in batches:
            cols = {n: batch.column(n).to_pylist() for n in ("alone", "at", "dmin", "dmax", "bytes")}
            rids.append(batch.column("rid"))
            own += zip(cols["alone"], cols["at"], strict=True)
            wait += zip(cols["bytes"], cols["dmin"], cols["dmax"], strict=True)
            if len(wait) >= BATCH:
                enter()
        if wait:
            enter()
        out = [(i, at - b, at - a + length) for i, (alone, at) in enumerate(own) if alone for a, b in family.runs(i)]
        if out:
            of, s, e = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(rids).take(pa.array(of)), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=["rid", "s", "e"])

    def each_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (at, dmin, dmax, raw) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("at", "dmin", "dmax", "bytes")), strict=True)):
                found = [xxhash.xxh3_128_digest(raw[j : j + length]) for j in range(dmax - dmin + 1)]
                s = np.arange(at - dmax, at - dmin + 1, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("rid").take(pa.array(np.full(len(s), i))), pa.array(s), pa.array(found, pa.binary())], names=["rid", "s", "h"])

    if n_classes:
        buckets = max(1, math.ceil(n_classes / bucket))
        parts.append(held.where("not hot").repartition(buckets, "key").mapInArrow(trimmed(index), RID + ", s int, e int"))
        if not hot.isEmpty():
            windows = write_table(held.where("hot").mapInArrow(trimmed(each_window), RID + ", s int, h binary"), "windows")
            twice = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n").withColumn("hit", F.lit(True))
            parts.append(salted_left_join(windows, twice, ["h"], F.struct("rid", "s")).where("hit").select("rid", "s", (F.col("s") + length).alias("e")))
    spans = parts[0]
    for x in parts[1:]:
        spans = spans.union(x)
    out = last.write(spans.distinct().groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    tables.clear()
    return out


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of ranges."""
    out: list[list[int]] = []
    for s, e in sorted((x["s"], x["e"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _left(raw: bytes, cut: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for c in cut for x in c), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def row_id(doc_id, text):
    """What spans come back to a row by; rows that are equal in both share it. Null ids go by a second hash."""
    d = doc_id.cast("long")
    return F.struct(F.coalesce(d, F.lit(0).cast("long")).alias("d"), F.when(d.isNull(), F.xxhash64(text, F.lit(1))).otherwise(F.xxhash64(text)).alias("h"))


def removals(docs: DataFrame, length: int = LENGTH, passage: int | None = None, **how) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `passage`, n_passage too: the bytes that
    strings of that many bytes cover which also start elsewhere (nothing is cut for them).

    Null texts are empty. Texts under `length` bytes keep all; texts of any length are read whole. Strings that repeat
    inside one text, overlapping or not, count. Rows repeated whole are each other's copies. Other columns are ignored,
    whatever their names. Empty table: no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", row_id(F.col("doc_id"), F.col("text")))
    spans = repeats(rows, length, **how)
    if passage:
        spans = spans.join(repeats(rows, passage, **how).withColumnRenamed("spans", "passages"), "rid", "full")
    joined = rows.join(spans, "rid", "left")
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["n_passage"] * bool(passage)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        covered = lambda cuts: pa.array([sum(e - s for s, e in c) for c in cuts], pa.int64())
        for part, texts in _texts(batches):
            cuts = [merged(x) for x in part.column("spans").to_pylist()]
            sha = [hashlib.sha256(_left(raw, c)).hexdigest() for raw, c in zip(texts, cuts, strict=True)]
            cols = [part.column("doc_id"), pa.array([len(x) for x in texts], pa.int64()), covered(cuts), pa.array([len(c) for c in cuts], pa.int64()), pa.array(sha, pa.string())]
            if passage:
                cols.append(covered([merged(x) for x in part.column("passages").to_pylist()]))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return joined.mapInArrow(trimmed(work), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passage long" * bool(passage))


def cut_repeats(docs: DataFrame, length: int = LENGTH, **how) -> DataFrame:
    """The rows of docs with repeats cut from text (n_chars follows, where it is a column).

    Halves of a character that a cut parts go too. Rows whose whole text went are dropped; rows with null or empty texts
    stay as they are. Rows repeated whole are each other's copies. Columns may have any names. Empty table: no rows.
    """
    names, schema = docs.columns, docs.schema
    count = names.index("n_chars") if "n_chars" in names else None
    own = ["text" if n == "text" else f"_c{i}" for i, n in enumerate(names)]  # no name clashes
    renamed = docs.select(*(F.col(f"`{n}`").cast("string").alias(o) if n == "text" else F.col(f"`{n}`").alias(o) for n, o in zip(names, own, strict=True)))
    rows = renamed.withColumn("rid", row_id(F.col(own[names.index("doc_id")]), F.col("text")))
    joined = rows.join(repeats(rows, length, **how), "rid", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            cols = [part.column(n) for n in own]
            cuts = [merged(x) for x in part.column("spans").to_pylist()]
            was = part.column("text").to_pylist()
            now = [_left(raw, c).decode("utf-8", "ignore") if c else old for raw, c, old in zip(texts, cuts, was, strict=True)]
            cols[names.index("text")] = pa.array(now, part.column("text").type)
            if count is not None:
                cols[count] = pa.array([len(n) if c else o for n, c, o in zip(now, cuts, cols[count].to_pylist(), strict=True)], cols[count].type)
            keep = pa.array([bool(n) or not c for n, c in zip(now, cuts, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(cols, names=names).filter(keep)

    return joined.mapInArrow(trimmed(work), schema)
