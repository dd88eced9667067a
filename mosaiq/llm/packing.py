"""Harmonic packing of tokenised documents into sequences, by each worker on its own."""

from __future__ import annotations

import gc
import re
import zlib
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import trimmed

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
END = 1
#: Distinct words whose ids a worker remembers before it starts anew; a bound on memory, not on results.
REMEMBERED, REMEMBERED_PARTS = 200_000, 100_000
#: Words whose parting the tokenizer's own rule fixes and that need no Unicode tables: printable ASCII and the letters
#: of Latin-1. Others, and those that could hold a special token, go through the tokenizer whole.
PLAIN = re.compile(r"[!-~¡¿«»À-ÖØ-öø-ÿ]+")
#: Fixed value: the rule by which the tokenizer file parts lower-cased text, for such words.
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

#: A letter and the signs after it at the end of a word: the tokenizer parts them there, so words are told apart
#: without their signs. Quotation marks may belong to a part of their own kind and stay.
SIGNS = r"([A-Za-zß-öø-ÿ])([!-&(-/:-@\[-`{-~]+)([\x09-\x0D ]|$)"


class Encoder:
    """Ids of whole texts by the tokenizer file, each distinct word of which is encoded once.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its words.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True
        self.reset()

    def ids_of_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part. Parts go in long strings, apart by spaces; a part's last id is one that closes a word."""
        out: list[list[int]] = []
        texts = [" ".join(parts[i : i + 4000]) for i in range(0, len(parts), 4000)]
        for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False):
            ids, begin = found.ids, 0
            for end in (np.flatnonzero(self.closes[ids]) + 1).tolist():
                out.append(ids[begin:end])
                begin = end
        return out

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.parts: dict[str, list[int]] = {}
        self.flat, self.starts, self.used = np.empty(1 << 20, np.uint32), np.zeros(1, np.int32), 0

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new words: of their parts, each of which is encoded once."""
        if not words:
            return
        gc.disable()  # what is remembered holds no cycles; looking for them would cost more than all else here
        plain = [PLAIN.fullmatch(w) is not None and "<|" not in w for w in words]
        split = [PARTS.findall(w.lower()) if ok else [w] for w, ok in zip(words, plain, strict=True)]
        if len(self.parts) > REMEMBERED_PARTS:
            self.parts = {}
        parts = self.parts
        new = list({p for x, ok in zip(split, plain, strict=True) if ok for p in x if p not in parts})
        parts.update(zip(new, self.ids_of_parts(new), strict=True))
        new = list({x[0] for x, ok in zip(split, plain, strict=True) if not ok and x[0] not in parts})
        parts.update((p, e.ids) for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True))
        found = [parts[x[0]] if len(x) == 1 else [i for p in x for i in parts[p]] for x in split]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes)]).astype(np.int32)
        self.used += len(ids)
        gc.freeze()
        gc.enable()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, an END after each text's, and where each text's ids end."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        apart = pc.replace_substring_regex(texts, SIGNS, r"\1 \2\3")
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, apart))
        words = lists.flatten().dictionary_encode()
        if len(self.place) > REMEMBERED:
            self.reset()
        known = words.dictionary.to_pylist()
        place = list(map(self.place.get, known))
        if new := [i for i, x in enumerate(place) if x is None]:
            at = len(self.place)
            self.learn([known[i] for i in new])
            for n, i in enumerate(new):
                place[i] = at + n
        which = np.array(place, np.int32)[words.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int32)
        begin, sizes = self.starts[which], (self.starts[1:] - self.starts[:-1])[which]
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
        before = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
        ends = before[bounds[1:]] + np.arange(1, len(bounds))
        if len(sizes):
            at = np.repeat(begin - before[:-1], sizes) + np.arange(before[-1], dtype=np.int32)
            ids = self.flat[at]
        else:
            ids = np.zeros(0, np.uint32)
        out = np.full(len(ids) + len(texts), END, np.uint32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = ids
        return out, ends


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text, or one row."""
    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        size += n
        if size >= most or i == batch.num_rows - 1:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that words learnt in one serve the next."""
    return Encoder(path)


class HarmonicPacker:
    """A document of a length in (capacity/(j+1), capacity/j] is of class j; a bin of class j takes j whole documents.

    Those of capacity/classes or fewer are of the last class, whose bins take as many as fit. A document of more than
    the capacity fills sequences of its own; what is over goes to the stock. A bin with all its documents misses less
    than one document of its class; pieces cut from the stock close that gap. While the stock can't, bins wait; with
    `waiting` of them, the next document goes to the stock instead of its class. So nearly all documents stay whole,
    and no bin is padded. At the end, open bins' documents go to the stock too; when the waiting bins are closed, the
    rest is laid end to end in whole sequences and, for the last one, powers of two, which need no padding.
    """

    def __init__(self, base: int, capacity: int = 2048, classes: int = 16, waiting: int = 8):
        self.capacity, self.classes, self.waiting, self.next = capacity, classes, waiting, base
        self.bins: dict[int, list[tuple]] = {}
        self.room: dict[int, int] = {}
        self.short: deque[tuple[int, list[tuple]]] = deque()  # (gap, pieces) of waiting bins
        self.stock: deque[tuple] = deque()
        self.held, self.rows = 0, []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        """ids: the whole document. What is kept is copied, so the caller's array isn't held."""
        total, at = len(ids), 0
        if total > self.capacity:
            while total - at >= self.capacity:
                self.emit([(doc, at, ids[at : at + self.capacity], total)])
                at += self.capacity
            if at < total:
                self.put_by((doc, at, ids[at:].copy(), total))
        elif len(self.short) >= self.waiting:
            self.put_by((doc, 0, ids.copy(), total))
        else:
            self.place((doc, 0, ids.copy(), total))
        while self.short and self.held >= self.short[0][0]:
            gap, pieces = self.short.popleft()
            self.emit(pieces + self.take_stock(gap))

    def place(self, piece: tuple) -> None:
        n = len(piece[2])
        j = min(self.capacity // n, self.classes)
        own, room = self.bins.setdefault(j, []), self.room.get(j, self.capacity)
        if n > room:  # the last class only
            self.short.append((room, own))
            own = self.bins[j] = []
            room = self.capacity
        own.append(piece)
        room -= n
        if not room:
            self.emit(own)
        elif j < self.classes and len(own) == j:
            self.short.append((room, own))
        else:
            self.room[j] = room
            return
        self.bins[j], self.room[j] = [], self.capacity

    def put_by(self, piece: tuple) -> None:
        self.stock.append(piece)
        self.held += len(piece[2])

    def take_stock(self, tokens: int) -> list[tuple]:
        """Pieces of the stock of so many tokens in all."""
        out, self.held = [], self.held - tokens
        while tokens:
            doc, at, ids, total = self.stock.popleft()
            if len(ids) > tokens:
                self.stock.appendleft((doc, at + tokens, ids[tokens:], total))
                ids = ids[:tokens]
            out.append((doc, at, ids, total))
            tokens -= len(ids)
        return out

    def emit(self, pieces: list[tuple]) -> None:
        """A finished sequence."""
        offset = 0
        for doc, at, ids, total in pieces:
            self.rows.append((doc, at, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes()), total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def finish(self) -> None:
        for j in sorted(self.bins):
            for piece in self.bins[j]:
                self.put_by(piece)
        self.bins, self.room = {}, {}
        for gap, pieces in sorted(self.short, key=lambda x: x[0]):
            if gap <= self.held:
                self.emit(pieces + self.take_stock(gap))
            else:
                for piece in pieces:
                    self.put_by(piece)
        self.short.clear()
        while self.held:
            self.emit(self.take_stock(min(self.capacity, 1 << (self.held.bit_length() - 1))))

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, classes: int = 16) -> DataFrame:
    """A row per piece (PIECES); capacity is a power of two. No shuffle: each task packs its own input partition.

    Null and empty texts are one END. Sequence numbers are unique: partition number, then a count. Rows are what
    the same partition always gives, so a lost task's sequences come back under the same numbers. Null or repeated
    doc_ids and rows repeated whole are packed row by row. Texts of any length are packed whole. Other columns are
    ignored, whatever their names. Empty table: no rows.
    """
    names = [x.split()[0] for x in PIECES.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, packer = encoder(tokenizer), HarmonicPacker(TaskContext.get().partitionId() << 40, capacity, classes)

        def rows() -> Iterator[pa.RecordBatch]:
            if found := packer.take():
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=names)

        for batch in batches:
            for part in slices(batch):
                ids, ends = own.encode(part.column(1))
                begin = 0
                for doc, end in zip(part.column(0).to_pylist(), ends.tolist(), strict=True):
                    packer.add(doc, ids[begin:end])
                    begin = end
                yield from rows()
        packer.finish()
        yield from rows()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(trimmed(work), PIECES)
