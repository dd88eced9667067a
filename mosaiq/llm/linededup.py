"""Line dedup by a log-template tree: fixed depth, token count and leading tokens, generalised variable fields."""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import salted_left_join, Scratch

FIELD = "<*>"


SPACE = r"\x20\x09-\x0D"


def masked(line: Column) -> Column:
    """A line whose words with a digit are variable fields."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, f"[^{SPACE}]*[0-9][^{SPACE}]*", FIELD)).otherwise(line)


class Templates:
    """The templates of a leaf, whose lines all have one token count and come in sorted order.

    A line joins the template that agrees with it in most places, if those are at least `similar` of all (ties: the
    first), and places where they differ become fields, which agree with nothing but fields; else it founds a
    template. A template that agrees in enough places agrees in one of the line's rarest, so only those that were
    seen there are compared; the result is that of comparing all.
    """

    def __init__(self, width: int, similar: float):
        self.number = {FIELD.encode(): 0}
        self.made = np.empty((4, width), np.int32)
        self.n = 0
        self.need = math.ceil(similar * max(1, width))
        self.probes = max(0, width - self.need + 1)
        self.seen: list[dict[int, list[int]]] = [{} for _ in range(width)]

    def add(self, line: list[bytes]) -> int:
        """Template number of the next line."""
        row = np.array([self.number.setdefault(w, len(self.number)) for w in line], np.int32)
        words = row.tolist()
        if self.need > 0:
            near = sorted((self.seen[i].get(w, ()) for i, w in enumerate(words)), key=len)[: self.probes]
            at = np.array(sorted(set().union(*near)), np.int64)
        else:
            at = np.arange(self.n)
        if len(at):
            agree = (self.made[at] == row).sum(axis=1)
            best = int(agree.argmax())
            if agree[best] >= self.need:
                k = int(at[best])
                for i in np.flatnonzero((self.made[k] != row) & (self.made[k] != 0)).tolist():
                    self.made[k, i] = 0
                    self.seen[i].setdefault(0, []).append(k)
                return k
        if self.n == len(self.made):
            self.made = np.concatenate([self.made, np.empty_like(self.made)])
        self.made[self.n] = row
        for i, w in enumerate(words):
            self.seen[i].setdefault(w, []).append(self.n)
        self.n += 1
        return self.n - 1


    def texts(self) -> list[bytes]:
        """The templates, their fields as FIELD."""
        words = list(self.number)
        return [b" ".join([words[i] for i in row]) for row in self.made[: self.n].tolist()]


def generalise(lines: list[list[bytes]], similar: float) -> list[int]:
    """Template number of each line of a leaf; all have one token count and come in sorted order."""
    templates = Templates(len(lines[0]) if lines else 0, similar)
    return [templates.add(x) for x in lines]


def row_id() -> Column:
    """doc_id and a hash of the text: rows that are equal in both are one document."""
    return F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("d"), F.xxhash64(F.col("text"), F.col("doc_id").isNull()).alias("h"))


def all_lines(docs: DataFrame, depth: int) -> DataFrame:
    """(rid, place, same, leaf) of each line with a word, by hashes only. Null texts have no lines.

    A leaf of the tree is a token count with the first `depth` tokens.
    """
    rows = docs.select(row_id().alias("rid"), F.posexplode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")).alias("place", "line"))
    rows = rows.where(F.col("line").rlike(f"[^{SPACE}]")).select("rid", "place", masked(F.col("line")).alias("line"))
    words = rows.withColumn("words", F.array_remove(F.split("line", f"[{SPACE}]+"), ""))
    return words.select("rid", "place", F.xxhash64("line").alias("same"), F.xxhash64(F.size("words"), F.slice("words", 1, depth)).alias("leaf"))


def settled(lines: DataFrame, similar: float) -> DataFrame:
    """(leaf, same, template, made) of lines (leaf, shard, same, masked), each shard generalised by one task that streams it.

    A row for each line that isn't its template's smallest (made: null), and one for each template with its text.
    """

    def settle(rows: Iterator[tuple[int, bytes, int]]) -> Iterator[pa.RecordBatch]:
        templates, leaf, same, of, last = None, 0, array("q"), array("q"), None
        least: dict[int, int] = {}
        for leaf, line, key in rows:
            if (line, key) == last:
                continue  # the same line of a row that is there twice
            last = line, key
            found = line.split()
            templates = templates or Templates(len(found), similar)
            k = templates.add(found)
            same.append(key)
            of.append(k)
            least[k] = min(least.get(k, key), key)
        same, of = np.frombuffer(same, np.int64), np.frombuffer(of, np.int64)
        tops = np.array([least[k] for k in range(len(least))], np.int64)
        made = templates.texts()
        names = ["leaf", "same", "template", "made"]
        for at in range(0, len(tops), 65536):
            part = pa.array(tops[at : at + 65536])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), leaf)), part, part, pa.array(made[at : at + 65536], pa.binary())], names=names)
        for at in range(0, len(same), 65536):
            own, top = same[at : at + 65536], tops[of[at : at + 65536]]
            moved = own != top
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(moved.sum(), leaf)), pa.array(own[moved]), pa.array(top[moved]), pa.nulls(int(moved.sum()), pa.binary())], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                found = batch.column("masked").cast(pa.binary()).to_pylist()
                yield from zip(batch.column("leaf").to_pylist(), batch.column("shard").to_pylist(), batch.column("size").to_pylist(), found, batch.column("same").to_pylist(), strict=True)

        # one size in a leaf, unless two hashes are equal
        for _, own in groupby(rows(), key=lambda x: x[:3]):
            yield from settle((leaf, line, key) for leaf, _, _, line, key in own)

    size = F.size(F.array_remove(F.split("masked", f"[{SPACE}]+"), ""))
    ordered = lines.select("leaf", "shard", "same", "masked").repartition("leaf", "shard").withColumn("size", size).sortWithinPartitions("leaf", "shard", "size", "masked", "same")
    return ordered.mapInArrow(work, "leaf long, same long, template long, made binary")


def assign(docs: DataFrame, depth: int = 3, similar: float = 0.6, shard: int = 20_000, tables: Scratch | None = None) -> DataFrame:
    """(rid, place, same, template) of each line with a word; template: the smallest `same` of its cluster.

    A leaf of over `shard` different lines is generalised in several shards at once; their templates, fields and all,
    are then lines of a smaller leaf, and so on until a round no longer halves them, when one task takes what is left.
    """
    tables = tables or Scratch(docs.sparkSession)
    narrow = tables.write(all_lines(docs, depth), "lines")
    kinds = tables.write(narrow.groupBy("leaf", "same").agg(F.min(F.struct("rid", "place")).alias("at")), "kinds")
    # leaves with one kind of line need no tree
    sizes = kinds.groupBy("leaf").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = salted_left_join(kinds, sizes, ["leaf"], F.col("same")).where("kinds is not null").select("leaf", "same", "kinds", "at.*")
    wanted = wanted.groupBy("rid").agg(F.collect_list(F.struct("leaf", "same", "kinds", "place")).alias("want"))
    texts = docs.select(row_id().alias("rid"), F.col("text").cast("string").alias("text"))
    lines = texts.join(wanted, "rid").select(F.split("text", "\n").alias("lines"), F.explode("want").alias("w"))
    lines = lines.select("w.leaf", "w.same", "w.kinds", masked(F.get("lines", F.col("w.place"))).alias("masked"))
    shards = F.ceil(F.col("kinds") / shard)
    moves, i = None, 0
    lines = lines.withColumn("shard", F.pmod(F.xxhash64("same"), shards))
    while True:
        found = tables.write(settled(lines, similar), f"settled{i}")
        step = found.where("made is null").select("same", "template").groupBy("same").agg(F.min("template").alias("template"))
        if moves is None:
            moves = step
        else:  # what a line was told before is told anew
            over = salted_left_join(moves, step.select(F.col("same").alias("template"), F.col("template").alias("top")), ["template"], F.col("same"))
            moves = tables.write(over.select("same", F.coalesce("top", "template").alias("template")).unionByName(step), f"moves{i}")
        again = sizes.where(shards > 1)
        if again.isEmpty():
            break
        left = found.where("made is not null").select("leaf", "same", F.col("made").cast("string").alias("masked"))
        now = left.join(again.withColumnRenamed("kinds", "was"), "leaf").groupBy("leaf", "was").agg(F.count(F.lit(1)).alias("kinds"))
        # one shard takes the rest of a leaf that no longer shrinks; it is in no further round
        sizes = tables.write(now.select("leaf", F.when(F.col("kinds") * 2 > F.col("was"), F.least("kinds", F.lit(shard))).otherwise(F.col("kinds")).alias("kinds")), f"sizes{i}")
        lines = salted_left_join(left, sizes, ["leaf"], F.col("same")).where("kinds is not null").withColumn("shard", F.pmod(F.xxhash64("same"), shards))
        i += 1
    return salted_left_join(narrow.drop("leaf"), moves, ["same"], F.struct("rid", "place")).withColumn("template", F.coalesce("template", "same"))


def recurring(docs: DataFrame, min_docs: int = 8, **how) -> DataFrame:
    """(rid, n_lines, dropped): the places of lines whose template min_docs different documents or more hold."""
    tables = Scratch(docs.sparkSession)
    lines = Scratch(docs.sparkSession).write(assign(docs, tables=tables, **how).select("rid", "place", "template"), "templates")
    tables.clear()
    common = lines.groupBy("template", "rid").agg(F.lit(1).alias("_")).groupBy("template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("template", F.lit(True).alias("hit"))
    told = salted_left_join(lines, common, ["template"], F.struct("rid", "place"))
    told = told.groupBy("rid", "place").agg(F.max("hit").alias("hit"))  # rows repeated whole
    return told.groupBy("rid").agg(F.count(F.lit(1)).alias("n_lines"), F.array_sort(F.collect_list(F.when(F.col("hit"), F.col("place")))).alias("dropped"))


def dedup_lines(docs: DataFrame, min_docs: int = 8, **how) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept: whole texts without lines of recurring templates.

    Lines are parted by \\n; those without a word stay. Documents are counted by (doc_id, text), so rows repeated
    whole count once and share one result, and rows of one null or repeated id with other texts are documents of their
    own. A line that agrees equally with several templates joins the first. Texts of any length are read whole; their
    lines travel one by one. Other columns are ignored, whatever their names. Null text: no lines, kept null. Empty
    table: no rows.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("rid", row_id())
    out = rows.join(recurring(rows, min_docs, **how), "rid", "left")
    gone = F.coalesce("dropped", F.array().cast("array<int>"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                if text is not None and drop:
                    off = set(drop)
                    text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in off)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_lines"), batch.column("n_dropped"), pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])

    out = out.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"), gone.alias("gone"), "text")
    return out.mapInArrow(work, "doc_id long, n_lines long, n_dropped long, kept string")
