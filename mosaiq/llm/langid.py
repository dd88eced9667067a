"""Language identification by prediction by partial matching (PPM) with frozen byte statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import fitting, trimmed

SCHEMA = "doc_id long, lang_pred string, score double"
UNKNOWN = "und"


@dataclass
class PpmModel:
    """Context trees of all languages, laid out for lookup.

    symbol: byte -> symbol (0: not seen in training); context: three symbols -> number of the longest context that
    any language knows; cost: for each context and next symbol, the bits that each language's escape chain charges.
    """

    langs: list[str]
    symbol: np.ndarray
    base: int
    context: np.ndarray
    cost: np.ndarray


def _chain(counts: list[dict], contexts: list[tuple], n_symbols: int) -> np.ndarray:
    """Bits per context and symbol for one language: escape method C from the longest context to the empty one.

    A symbol seen c times in a context of n symbols, d of them distinct, costs -log2(c / (n + d)); an unseen
    one pays for the escape, -log2(d / (n + d)), and is charged by the next shorter context; below the empty
    context, all symbols are equally likely.
    """
    known: dict[tuple, np.ndarray] = {(): np.full(n_symbols, math.log2(n_symbols))}
    if counts[0].get(()):
        known[()] = _mix(counts[0][()], known[()])
    for order in range(1, len(counts)):
        for ctx, seen in counts[order].items():
            shorter = ctx[1:]
            while shorter not in known:
                shorter = shorter[1:]
            known[ctx] = _mix(seen, known[shorter])
    out = np.empty((len(contexts), n_symbols), np.float32)
    for i, ctx in enumerate(contexts):
        while ctx not in known:
            ctx = ctx[1:]
        out[i] = known[ctx]
    return out


def _mix(seen: dict[int, int], below: np.ndarray) -> np.ndarray:
    n, d = sum(seen.values()), len(seen)
    bits = below - math.log2(d / (n + d))
    for s, c in seen.items():
        bits[s] = -math.log2(c / (n + d))
    return bits


def fit(texts: list[str], langs: list[str], order: int = 3, least: int = 4) -> PpmModel:
    """Count bytes after contexts of up to `order` bytes; longer contexts seen fewer than `least` times are pruned."""
    names = sorted(set(langs))
    by = {x: np.frombuffer(b"\n".join(t.encode() for t, y in zip(texts, langs, strict=True) if y == x), np.uint8) for x in names}
    seen = np.unique(np.concatenate([np.zeros(0, np.uint8), *by.values()]))
    symbol = np.zeros(256, np.int64)
    symbol[seen] = np.arange(1, len(seen) + 1)
    base, per_lang, contexts = len(seen) + 1, [], {()}
    for x in names:
        s, counts = symbol[by[x]], []
        for k in range(order + 1):
            code = np.zeros(max(0, len(s) - k), np.int64)
            for j in range(k + 1):
                code = code * base + s[j : j + len(code)]
            gram, c = np.unique(code, return_counts=True)
            of: dict[tuple, dict[int, int]] = {}
            ctx, nxt = gram // base, gram % base
            total = np.zeros(0, np.int64) if not len(ctx) else np.bincount(np.unique(ctx, return_inverse=True)[1], weights=c)[np.unique(ctx, return_inverse=True)[1]]
            for a, b, n, t in zip(ctx.tolist(), nxt.tolist(), c.tolist(), total.tolist(), strict=True):
                if k == 0 or t >= least:
                    key = tuple(a // base ** (k - 1 - j) % base for j in range(k))
                    of.setdefault(key, {})[b] = n
            counts.append(of)
            contexts |= set(of)
        per_lang.append(counts)
    listed = sorted(contexts, key=lambda c: (len(c), c))
    cost = np.stack([_chain(c, listed, base) for c in per_lang], axis=2) if names else np.zeros((1, base, 0), np.float32)
    number = {c: i for i, c in enumerate(listed)}
    table = np.zeros((base,) * order, np.int32)
    for c in listed:  # shorter contexts first, so that longer ones overwrite
        table[(..., *c)] = number[c]
    return PpmModel(names, symbol.astype(np.int32), base, table.reshape(-1), np.ascontiguousarray(cost.reshape(cost.shape[0] * base, len(names))))


def code_lengths(model: PpmModel, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Bits of each text under each language; data holds the texts end to end, each preceded by three newlines."""
    s = model.symbol[data]
    b = model.base
    ctx = (s[:-3] * b + s[1:-2]) * b + s[2:-1]
    bits = model.cost.take(model.context.take(ctx) * b + s[3:], axis=0)
    total = np.empty((len(ends), bits.shape[1]))
    begin = 0
    for i, end in enumerate(ends.tolist()):  # a text's own bytes start after its three newlines
        total[i] = bits[begin : end - 3].sum(axis=0, dtype=np.float64)
        begin = end
    return total


def predict(model: PpmModel, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of whole texts: the shortest code, and its share of 2^(-bits / sqrt(bytes))."""
    out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
    todo = [i for i, t in enumerate(texts) if t and model.langs and any(map(str.isalpha, t))]
    while todo:
        part, size = [], 0
        while todo and (not part or size < 1 << 20):
            part.append(todo.pop())
            size += len(texts[part[-1]])
        raw = [b"\n\n\n" + texts[i].encode("utf-8", "replace") for i in part]
        sizes = np.array([len(x) for x in raw])
        bits = code_lengths(model, np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes))
        best = bits.argmin(axis=1)
        gap = (bits - bits.min(axis=1, keepdims=True)) / np.sqrt(sizes - 3)[:, None]
        score = 1 / np.exp2(-gap).sum(axis=1)
        for i, k, x in zip(part, best.tolist(), score.tolist(), strict=True):
            out[i] = (model.langs[k], min(1.0, max(0.0, x)))
    return out


def train_row(doc_id) -> F.Column:
    """Rows to learn from: crc32 of doc_id as text, modulo 4, is not 2 (a null doc_id is learned from)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 != 2, F.lit(True))


def train(docs: DataFrame, rows: int = 2400, chars: int = 8000) -> PpmModel:
    """Fit on a bounded sample: the `rows` labelled training rows of smallest hash, whole, of rows * chars bytes at most."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & train_row(F.col("doc_id"))).select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)).alias("h"))
    most = (1 << 30) * 4 * rows // max(1, known.count()) + 1  # about 4 * rows ids are left, however many tasks there are
    picked = known.where(F.col("h") < most).orderBy("h", "doc_id").limit(rows).distinct()  # ids only
    texts = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ids = fitting(texts.join(F.broadcast(picked), "doc_id").select("h", "doc_id", F.octet_length("text").cast("long").alias("bytes")), rows * chars)
    picked = picked.where(F.col("doc_id").isin(ids))
    picked = texts.join(F.broadcast(picked), "doc_id").orderBy("h", "doc_id", "lang", "text").limit(rows).collect()
    return fit([r["text"] for r in picked], [r["lang"] for r in picked])


def identify(docs: DataFrame, model: PpmModel) -> DataFrame:
    """doc_id, lang_pred, score per row. Null texts and texts without a letter are `und` with score 0.

    Only text is read, whole, whatever its length; other columns may have any names. Rows repeated whole, and rows of one
    id, get a result each. Equal code lengths go to the language that sorts first. A model of no languages predicts
    `und`. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                found = predict(shared.value, part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(trimmed(work), SCHEMA)


def keep_known(docs: DataFrame, model: PpmModel) -> DataFrame:
    """The rows of docs, all columns of any names, whose text is in a language that the model knows: null texts and those
    without a letter go. Rows repeated whole share one fate. Empty table: no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield part.filter(pa.array([x[0] != UNKNOWN for x in predict(shared.value, part.column(column).to_pylist())], pa.bool_()))

    return docs.mapInArrow(trimmed(work), docs.schema)
