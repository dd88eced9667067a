"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Salts over which a hot key is spread in lookups and merges.
SALTS = 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Where it is unset and Spark is local, a temporary folder that goes with the process.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = tempfile.mkdtemp(prefix="mosaiq-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it again."""
    return Scratch(df.sparkSession).write(df, name)


class Scratch:
    """Tables of one operator in the shared folder. `clear` frees those that no later step reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.paths[name] = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self, *names: str) -> None:
        """Write an empty table over the named ones (all: no name), which any store that Spark writes to can do."""
        for name in names or tuple(self.paths):
            self.spark.range(0).coalesce(1).write.mode("overwrite").parquet(self.paths.pop(name))


def trimmed(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """A map over batches that hands the worker's unused memory back at its end, as workers outlive their tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)

    return run


def fitting(sizes: DataFrame, most: int) -> list:
    """Ids of the rows (h, doc_id, bytes) taken in order of h and doc_id while their bytes fit into `most`; one beyond it is passed over.

    sizes is a bounded sample of ids; texts that share an id count together.
    """
    out, left = [], most
    for r in sizes.groupBy("doc_id").agg(F.min("h").alias("h"), F.sum("bytes").alias("bytes")).orderBy("h", "doc_id").collect():
        if r["bytes"] <= left:
            left -= r["bytes"]
            out.append(r["doc_id"])
    return out


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII strings take the byte-wise path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def salt(*cols: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def salted_left_join(left: DataFrame, right: DataFrame, keys: list[str], spread: Column, shuffled: bool = False) -> DataFrame:
    """Left join of left with right, which has a row per key at most.

    Rows of a hot key are spread over SALTS partitions; each row of right goes to all of them, so right
    should hold the keys that need a lookup only. shuffled: right is never broadcast, which Spark else does by the size
    it estimates before rows go to all parts.
    """
    n = F.lit(SALTS)
    l = left.withColumn("_salt", F.pmod(F.xxhash64(spread), n).cast("int"))
    r = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1)))
    return l.join(r.hint("merge") if shuffled else r, [*keys, "_salt"], "left").drop("_salt")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, label): label is the smallest node that a node can reach; nodes without an edge are absent.

    Minimum labels travel along edges and then jump to the label of the label, so rounds grow with the logarithm
    of a component's diameter. Each round is written to the shared folder; the driver sees counts only.
    """
    spark = edges.sparkSession
    tables = Scratch(spark)
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    both = tables.write(both.union(both.select("b", "a")).where("a <> b").distinct(), "edges")
    old = Scratch(spark)
    labels = old.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    while True:
        now = Scratch(spark)
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        step = now.write(step, "steps")
        # a label that many nodes hold is looked up once and told to salted parts of them
        jump = step.select("label").distinct().join(step.select(F.col("node").alias("label"), F.col("label").alias("top")), "label")
        done = now.write(salted_left_join(step, jump, ["label"], F.col("node")).select("node", "old", F.least("label", "top").alias("label")), "labels")
        labels = done.select("node", "label")
        old.clear()
        now.clear("steps")
        if done.where("label <> old").isEmpty():
            tables.clear()
            return labels
        old = now
