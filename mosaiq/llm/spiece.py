"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass over a trie of distinct marked words.

The public model is of the BPE kind: its scores are merge ranks, so the best path isn't the one of the highest sum.
What makes a path right is that each pair of neighbouring pieces is one that merging would leave apart. Exactly one
path through a word's pieces has only such pairs, for every prefix as well, so a forward pass holds one best last
piece for each prefix, and words with a common prefix share its part of the pass.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.llm.common import trimmed

MARK = "▁"
#: A marked word: its marks, then its letters. Pieces never hold a mark after a letter, so words are encoded alone.
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
REMEMBERED = 1_000_000


class Pieces:
    """The model's vocabulary, and what its merge ranks allow."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = {i for i in range(len(self.names)) if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        byte = {i for i in range(len(self.names)) if sp.is_byte(i)}
        self.byte_id = {int(self.names[i][3:5], 16): i for i in byte}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        self.special = special
        self.unknown = sp.unk_id()
        self.id_of = {x: i for i, x in enumerate(self.names) if i not in special and i not in byte}
        self.score = {x: sp.get_score(i) for x, i in self.id_of.items()}
        ends: dict[str, set[int]] = {}
        for x in self.id_of:
            if len(x) > 1:
                ends.setdefault(x[-2:], set()).add(len(x))
        #: Lengths of the pieces that end in two characters, longest first.
        self.ending = {x: sorted(n, reverse=True) for x, n in ends.items()}
        # the bytes that decoding gives for each id, end to end
        told = [b"" if i in special else bytes([self.byte_of[i]]) if i in byte else x.replace(MARK, " ").encode() for i, x in enumerate(self.names)]
        self.told_size = np.array([len(x) for x in told], np.int32)
        self.told_at = (np.cumsum(self.told_size) - self.told_size).astype(np.int32)
        self.told = np.frombuffer(b"".join(told), np.uint8)
        self.apart = lru_cache(maxsize=500_000)(self._apart)

    def merged(self, text: str) -> list[str]:
        """Plain merging, the definition: the best-scored neighbouring pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], float("-inf")), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _apart(self, left: str, right: str) -> bool:
        return self.merged(left + right) == [left, right]


class SharedPrefixViterbi:
    """Encodes sorted distinct words in one depth-first walk of their trie."""

    def __init__(self, pieces: Pieces):
        self.p = pieces
        self.whole = lru_cache(maxsize=100_000)(lambda x: pieces.merged(x) == [x])

    def encode_sorted(self, words: list[str]) -> dict[str, list[str]]:
        """Pieces of each word. last[i] is the length of the last piece of the best path to depth i of the walk."""
        p, known, out, ending, whole = self.p, self.p.id_of, {}, self.p.ending, self.whole
        last: list[int] = [0]
        before = ""
        for word in words:
            same = 0
            for a, b in zip(before, word):  # noqa: B905  the walk goes back to the branching point
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            for end in range(same + 1, len(word) + 1):
                size = 1
                for k in ending.get(word[end - 2 : end], ()) if end > 1 else ():
                    if k > end or (piece := word[end - k : end]) not in known or not whole(piece):
                        continue
                    at = end - k
                    if at == 0 or p.apart(word[at - last[at] : at], piece):
                        size = k
                        break
                last.append(size)
            path, at = [], len(word)
            while at:
                path.append(word[at - last[at] : at])
                at -= last[at]
            out[word] = path[::-1]
            before = word
        return out


class Encoder:
    """Encodes and decodes whole texts. Ids of distinct words are remembered, up to a bound on memory."""

    def __init__(self, path: str):
        self.pieces = Pieces(path)
        self.viterbi = SharedPrefixViterbi(self.pieces)
        self.reset()

    def reset(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.starts, self.used = np.empty(1 << 20, np.int32), np.zeros(1, np.int32), 0

    def learn(self, words: list[str]) -> None:
        """Remember the ids of new marked words."""
        if not words:
            return
        gc.disable()  # what is remembered holds no cycles
        words = sorted(words)
        found = [self.ids(x) for x in self.viterbi.encode_sorted(words).values()]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        self.starts = np.concatenate([self.starts, self.used + np.cumsum(sizes)]).astype(np.int32)
        self.used += len(ids)
        gc.freeze()
        gc.enable()

    def ids(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for x in parts:
            if (i := self.pieces.id_of.get(x)) is not None:
                out.append(i)
            else:  # a character that the vocabulary lacks: its bytes
                out += [self.pieces.byte_id.get(b, self.pieces.unknown) for b in x.encode("utf-8", "replace")]
        return out

    def encode_flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts end to end, as the model's own processor gives them, and where each text's end."""
        if len(self.place) > REMEMBERED:
            self.reset()
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        # mostly a space stands alone between words: then marked words are what the spaces part
        odd = pc.match_substring_regex(texts, f"  |^ | $|{MARK}").to_numpy(zero_copy_only=False)
        empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        words = lists.flatten().dictionary_encode()
        known = [MARK + x for x in words.dictionary.to_pylist()]
        other = {int(i): UNIT.findall(MARK + texts[int(i)].as_py().replace(" ", MARK)) for i in np.flatnonzero(odd)}
        self.learn(list({u for u in chain(known, *other.values()) if u not in self.place}))
        place = np.fromiter((self.place[u] for u in known), np.int32, len(known))
        which = place[words.indices.to_numpy(zero_copy_only=False)] if known else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        if other or empty.any():  # lay the odd texts' words, and none for empty ones, in their places
            parts = [np.fromiter((self.place[u] for u in other[i]), np.int32) if i in other else which[:0] if empty[i] else which[bounds[i] : bounds[i + 1]] for i in range(len(counts))]
            which, bounds = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        begin, sizes = self.starts[which], (self.starts[1:] - self.starts[:-1])[which]
        before = np.concatenate([np.zeros(1, np.int32), np.cumsum(sizes, dtype=np.int32)])
        return self.flat[np.repeat(begin - before[:-1], sizes) + np.arange(before[-1], dtype=np.int32)], before[bounds[1:]]

    def decode_flat(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all ids end to end, and before each id how many; the encoder's first space is among them."""
        p = self.pieces
        sizes = p.told_size[ids]
        before = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes, dtype=np.int64)])
        return p.told[np.repeat(p.told_at[ids] - before[:-1], sizes) + np.arange(before[-1])], before

    def encode(self, texts: list[str | None]) -> list[list[int] | None]:
        """Ids of whole texts; null stays null, empty is no id."""
        ids, ends = self.encode_flat(pa.array(texts, pa.string()))
        begins = [0, *ends.tolist()]
        return [None if t is None else ids[a:b].tolist() for t, a, b in zip(texts, begins, begins[1:], strict=False)]

    def decode(self, ids: list[int] | None) -> str | None:
        """The text of ids: bytes in a row are one string, marks are spaces, the first of which the encoder set."""
        if ids is None:
            return None
        text = self.decode_flat(np.array(ids, np.int64))[0].tobytes().decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder for all tasks of a worker process."""
    return Encoder(path)


def slices(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `most` bytes of text, or one row."""
    begin = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
        size += n
        if size >= most or i == batch.num_rows - 1:
            yield batch.slice(begin, i + 1 - begin)
            begin, size = i + 1, 0


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids of each row's whole text. Null text: null ids. Empty: none. No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(trimmed(work), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of rows of ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(trimmed(work), "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), n_bytes_decoded, exact: decoding gives the text.

    Encodes and decodes in one pass, so that ids need not leave the worker. Null text: n_ids null, exact true.
    Empty texts have no ids. Texts of any length are encoded whole. Rows repeated whole, and rows of one id, get a result
    each. Other columns are ignored, whatever their names. Empty table: no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model)
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1)
                ids, ends = own.encode_flat(texts)
                back, before = own.decode_flat(ids)
                plain, raw, begin, rows = ids.astype("<u4"), back.tobytes(), 0, []
                for text, end in zip(texts.cast(pa.binary()).to_pylist(), ends.tolist(), strict=True):
                    told = raw[before[begin] : before[end]][1:]  # without the encoder's own space
                    rows.append((None, None, None, True) if text is None else (end - begin, zlib.crc32(plain[begin:end].tobytes()), len(told), told == text))
                    begin = end
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "n_ids", "ids_crc32", "n_bytes_decoded", "exact"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(trimmed(work), "doc_id long, n_ids long, ids_crc32 long, n_bytes_decoded long, exact boolean")
