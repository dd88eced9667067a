"""Growing files: chunks written anew, scanlines and pages appended, sub-directories, files joined. Bytes in, bytes out.

A chunk is copied as it is where its scheme, layout and byte order allow, and is decoded and encoded again where they don't.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from mosaiq.sources import codecs, container, raster
from mosaiq.sources.edits import _main, set_tags, Tags

#: The tag that points to a kind of sub-directory.
POINTERS = {"sub": 330, "exif": 34665, "gps": 34853}
OFFSETS, COUNTS = {True: 324, False: 273}, {True: 325, False: 279}


def _tiled(d: container.Directory) -> bool:
    return container.NUMBER["tile_width"] in d.tags


def encode_chunk(r: container.Raster, d: container.Directory, block: np.ndarray, order: str | None = None) -> bytes:
    """The bytes of (rows, columns, samples) in the scheme, predictor and byte order of a directory."""
    order, bits, per = order or r.order, d.get("bits"), block.shape[2]
    row = (block.shape[1] * per * bits + 7) // 8
    if bits < 8:
        b = (block[..., None] >> np.arange(bits - 1, -1, -1, dtype=block.dtype)) & 1
        raw = np.packbits(b.reshape(block.shape[0], -1).astype(np.uint8), axis=1).tobytes()
    else:
        raw = block.astype(block.dtype.newbyteorder(order)).tobytes()
    if (kind := d.get("predictor")) != 1:
        raw = codecs.apply_predictor(kind, raw, row, bits, per, order)
    raw = codecs.encode(d.get("compression"), raw, row=row, width=block.shape[1], rows=block.shape[0], samples=per, bits=bits, order=order, photometric=d.get("photometric"), options=d.get("g3_options", 0) or 0)
    return codecs.reverse_bits(raw) if d.get("fill_order") == 2 else raw


def write_raw_chunk(data: bytes, page: int, number: int, raw: bytes) -> bytes:
    """The file with the stored bytes of a chunk replaced: in place where they fit, else at the end of the file."""
    r = container.parse(data)
    d = _main(r, page)[page]
    offsets, counts = d.many("tile_offsets" if _tiled(d) else "strip_offsets"), d.many("tile_bytecounts" if _tiled(d) else "strip_bytecounts")
    if not 0 <= number < len(offsets):
        raise container.FormatError(f"no chunk {number}")
    out, offsets, counts = bytearray(data), list(offsets), list(counts)
    if len(raw) > counts[number] or not offsets[number]:
        out += bytes(len(out) % 2)
        offsets[number] = len(out)
        out += raw
    else:
        out[offsets[number] : offsets[number] + len(raw)] = raw
    counts[number] = len(raw)
    kind = 16 if r.big else 4
    return set_tags(bytes(out), page, {OFFSETS[_tiled(d)]: (kind, offsets), COUNTS[_tiled(d)]: (kind, counts)})


def write_chunk(data: bytes, page: int, number: int, block: np.ndarray) -> bytes:
    """The file with the samples of a chunk replaced, encoded as the page says."""
    r = container.parse(data)
    return write_raw_chunk(data, page, number, encode_chunk(r, _main(r, page)[page], block))


def write_scanlines(data: bytes, page: int, y: int, rows: np.ndarray) -> bytes:
    """The file with rows from y on replaced; each strip they touch is decoded, changed and encoded again."""
    r = container.parse(data)
    d = _main(r, page)[page]
    if _tiled(d) or d.get("planar") == 2:
        raise container.FormatError("scanlines are written to interleaved strips")
    for c in container.layout(d):
        if c.y0 < y + len(rows) and y < c.y0 + c.h:
            block = container.decode_chunk(r, d, c).copy()
            top, end = max(y, c.y0), min(y + len(rows), c.y0 + c.h)
            block[top - c.y0 : end - c.y0] = rows[top - y : end - y]
            data = write_chunk(data, page, c.number, block)
    return data


def grow(data: bytes, page: int, rows: np.ndarray) -> bytes:
    """The file with rows appended to a page of interleaved strips; a last strip that isn't full is filled first."""
    r = container.parse(data)
    d = _main(r, page)[page]
    if _tiled(d) or d.get("planar") == 2:
        raise container.FormatError("only interleaved strips grow")
    height, each = d.get("length"), min(d.get("rows_per_strip", d.get("length")) or d.get("length"), 1 << 30)
    parts, out = container.layout(d), bytearray(data)
    offsets, counts = [c.offset for c in parts], [c.bytecount for c in parts]
    if parts and parts[-1].h < each:
        rows = np.concatenate([container.decode_chunk(r, d, parts[-1]), rows])
        offsets, counts = offsets[:-1], counts[:-1]
    for at in range(0, len(rows), each):
        raw = encode_chunk(r, d, rows[at : at + each])
        out += bytes(len(out) % 2)
        offsets.append(len(out))
        counts.append(len(raw))
        out += raw
    total = (len(parts) - (bool(parts) and parts[-1].h < each)) * each + len(rows) if parts else height + len(rows)
    kind = 16 if r.big else 4
    return set_tags(bytes(out), page, {257: (4, [total]), 273: (kind, offsets), 278: (4, [each]), 279: (kind, counts)})


class Joiner:
    """A file that takes pages of others."""

    def __init__(self, order: str = "<", big: bool = False):
        self.order, self.big = order, big
        self.word, self.inline = ("Q", 8) if big else ("I", 4)
        head = struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + "I", 0))
        self.out = bytearray((b"II" if order == "<" else b"MM") + head)
        self.link, self.copied, self.encoded = len(self.out) - self.inline, 0, 0

    @classmethod
    def of(cls, data: bytes) -> Joiner:
        """A joiner that goes on where a file ends."""
        r = container.parse(data)
        own = cls(r.order, r.big)
        own.out, chain = bytearray(data), [d for d in r.directories if d.kind == "main"]
        if chain:
            n = struct.unpack_from(r.order + ("Q" if r.big else "H"), data, chain[-1].offset)[0]
            own.link = chain[-1].offset + (8 if r.big else 2) + n * (20 if r.big else 12)
            own.out += bytes(max(0, own.link + own.inline - len(own.out)))
        return own

    def directory(self, tags: Tags) -> int:
        """Write a directory that nothing follows; where it is."""
        body = []
        for tag, (kind, values) in sorted(tags.items()):
            count, raw = container.packed(self.order, kind, values)
            if len(raw) > self.inline:
                self.out += bytes(len(self.out) % 2)
                at = len(self.out)
                self.out += raw
                raw = struct.pack(self.order + self.word, at)
            body.append(struct.pack(self.order + "HH" + self.word, tag, kind, count) + raw.ljust(self.inline, b"\0"))
        self.out += bytes(len(self.out) % 2)
        at = len(self.out)
        self.out += struct.pack(self.order + ("Q" if self.big else "H"), len(body)) + b"".join(body) + bytes(self.inline)
        return at

    def take(self, r: container.Raster, d: container.Directory) -> None:
        """Append a page of another file, with its chunks and sub-directories."""
        tags = self.tags_of(r, d)
        at = self.directory(tags)
        struct.pack_into(self.order + self.word, self.out, self.link, at)
        self.link = len(self.out) - self.inline

    def tags_of(self, r: container.Raster, d: container.Directory) -> Tags:
        where = 16 if self.big else 4
        tags: Tags = {t: (kind, value) for t, (kind, _, value) in d.tags.items() if t not in (273, 279, 324, 325, *POINTERS.values())}
        same = r.order == self.order or d.get("bits") <= 8 or d.get("compression") in (codecs.JPEG, codecs.SGILOG, codecs.SGILOG24)
        offsets, counts = [], []
        for c in container.layout(d):
            if same and c.bytecount:
                raw = r.data[c.offset : c.offset + c.bytecount]
                self.copied += 1
            else:
                raw = encode_chunk(r, d, container.decode_chunk(r, d, c), self.order)
                self.encoded += 1
            self.out += bytes(len(self.out) % 2)
            offsets.append(len(self.out))
            counts.append(len(raw))
            self.out += raw
        if offsets:
            tags |= {OFFSETS[_tiled(d)]: (where, offsets), COUNTS[_tiled(d)]: (where, counts)}
        for kind, pointer in POINTERS.items():
            subs = [x for x in r.directories if x.kind == kind and x.parent == d.offset]
            if subs:
                tags[pointer] = (18 if self.big and kind == "sub" else where, [self.directory(self.tags_of(r, x)) for x in subs])
        return tags


def append_pages(data: bytes, more: bytes) -> bytes:
    """The file with all pages of another after its own."""
    own, r = Joiner.of(data), container.parse(more)
    for d in r.directories:
        if d.kind == "main":
            own.take(r, d)
    return bytes(own.out)


def write_sub_directory(data: bytes, page: int, kind: str, tags: Tags) -> bytes:
    """The file with a directory of tags (EXIF, GPS or another page's) hung below a page, in place of one of its kind."""
    r = container.parse(data)
    _main(r, page)
    own = Joiner.of(data)
    at = own.directory(tags)
    return set_tags(bytes(own.out), page, {POINTERS[kind]: (16 if r.big else 4, [at])})


def concat_files(files: DataFrame, target: Column, order: str = "<", big: bool = False) -> DataFrame:
    """(path, content): files (path, content) joined into one for each value of target, in order of their paths.

    One shuffle, on the target; a joined file is one task's work, as a file is made in memory. Nothing is decoded
    where chunks can be copied. A file that can't be read fails the job and is named.
    """

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        own = Joiner(order, big)
        for path, content in sorted(zip(rows.column("path").to_pylist(), rows.column("content").to_pylist(), strict=True)):
            try:
                r = container.parse(content)
            except container.FormatError as e:
                raise container.FormatError(f"{path}: {e}") from e
            for d in r.directories:
                if d.kind == "main":
                    own.take(r, d)
        return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "content": pa.array([bytes(own.out)], pa.binary())})

    return files.select(target.cast("string").alias("target"), "path", "content").groupBy("target").applyInArrow(work, raster.FILES)


DUMP = "path string, ifd_offset long, entry_offset long, tag int, type int, count long, value_offset long, bytes binary"


def dump_rows(path: str, content: bytes) -> Iterator[tuple]:
    """The entries of all directories of the main chain as they are stored, unknown types too."""
    r = container.parse(content)
    head, each, code, inline = (8, 20, "HHQ", 8) if r.big else (2, 12, "HHI", 4)
    for d in r.directories:
        n = struct.unpack_from(r.order + ("Q" if r.big else "H"), content, d.offset)[0]
        for i in range(n):
            at = d.offset + head + i * each
            tag, kind, count = struct.unpack_from(r.order + code, content, at)
            size, place = container.TYPES.get(kind, ("", 0, ""))[1] * count, at + each - inline
            if size > inline:
                place = struct.unpack_from(r.order + ("Q" if r.big else "I"), content, place)[0]
            yield path, d.offset, at, tag, kind, count, place, content[place : place + (size or inline)]


def dump(files: DataFrame) -> DataFrame:
    return raster._table(files, DUMP, dump_rows)


def iptc_sets(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(record, number, value) of the data sets of an IPTC block."""
    at = 0
    while at + 5 <= len(data) and data[at] == 0x1C:
        record, number, size = struct.unpack_from(">BBH", data, at + 1)
        at += 5
        if size & 0x8000:  # the size's own size
            wide = size & 0x7FFF
            size, at = int.from_bytes(data[at : at + wide], "big"), at + wide
        yield record, number, data[at : at + size]
        at += size


def resources(data: bytes) -> Iterator[tuple[int, str, bytes]]:
    """(id, name, value) of the resource blocks that image editors store."""
    at = 0
    while data[at : at + 4] == b"8BIM" and at + 7 <= len(data):
        number, n = struct.unpack_from(">HB", data, at + 4)
        name = data[at + 7 : at + 7 + n].decode("latin-1")
        at += 6 + (n + 2) // 2 * 2
        size = struct.unpack_from(">I", data, at)[0] if at + 4 <= len(data) else 0
        yield number, name, data[at + 4 : at + 4 + size]
        at += 4 + size + size % 2


def as_resource(iptc: bytes) -> bytes:
    """An IPTC block as the resource block that holds one (0x0404)."""
    return b"8BIM" + struct.pack(">HBBI", 0x0404, 0, 0, len(iptc)) + iptc + bytes(len(iptc) % 2)


IPTC = "path string, dir_index int, record int, number int, value binary"


def iptc(files: DataFrame) -> DataFrame:
    """The data sets of each page's IPTC block, or of that in its resource blocks."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        r = container.parse(content)
        for d in r.directories:
            block = (d.tags.get(33723) or (0, 0, b""))[2]
            if isinstance(block, list):  # stored as longs by some writers
                block = struct.pack(f"{r.order}{len(block)}I", *block)
            if not block:
                block = next((v for n, _, v in resources((d.tags.get(34377) or (0, 0, b""))[2]) if n == 0x0404), b"")
            for record, number, value in iptc_sets(block):
                yield path, d.index, record, number, value

    return raster._table(files, IPTC, rows)


def sun_raster(content: bytes) -> np.ndarray:
    """Samples of a Sun raster file, (rows, columns, samples): 1, 8, 24 or 32 bits, plain or run-length coded, with or without a map."""
    magic, w, h, depth, _, kind, map_kind, map_size = struct.unpack_from(">8I", content)
    if magic != 0x59A66A95 or depth not in (1, 8, 24, 32):
        raise container.FormatError("not a Sun raster")
    body, row = content[32 + map_size :], (w * depth + 15) // 16 * 2
    if kind == 2:  # 0x80 count value, where 0x80 0 is a lone 0x80
        out, i = bytearray(), 0
        while i < len(body) and len(out) < row * h:
            if body[i] != 0x80:
                out.append(body[i])
                i += 1
            elif body[i + 1 : i + 2] == b"\0":
                out.append(0x80)
                i += 2
            else:
                out += body[i + 2 : i + 3] * (body[i + 1] + 1)
                i += 3
        body = bytes(out)
    x = np.frombuffer(body.ljust(row * h, b"\0")[: row * h], np.uint8).reshape(h, row)
    if depth == 1:
        return 1 - np.unpackbits(x, axis=1)[:, :w, None]  # ink is one
    if depth == 8:
        x = x[:, :w]
        return np.frombuffer(content[32 : 32 + map_size], np.uint8).reshape(3, -1).T[x] if map_kind == 1 and map_size else x[:, :, None]
    n = depth // 8
    x = x[:, : w * n].reshape(h, w, n)[:, :, n - 3 :]
    return np.ascontiguousarray(x if kind == 3 else x[:, :, ::-1])


def bitmap(content: bytes) -> np.ndarray:
    """Samples of an uncompressed BMP file of 8, 24 or 32 bits, (rows, columns, samples)."""
    if content[:2] != b"BM":
        raise container.FormatError("not a bitmap")
    start, size, w, h, _, depth, scheme = struct.unpack_from("<I", content, 10) + struct.unpack_from("<IiiHHI", content, 14)
    if scheme or depth not in (8, 24, 32):
        raise container.FormatError("only uncompressed bitmaps of 8, 24 and 32 bits")
    row = (w * depth + 31) // 32 * 4
    x = np.frombuffer(content, np.uint8, row * abs(h), start).reshape(abs(h), row)
    x = x[::-1] if h > 0 else x
    if depth == 8:
        colors = np.frombuffer(content, np.uint8, (start - 14 - size) // 4 * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        return colors[x[:, :w]]
    return np.ascontiguousarray(x[:, : w * depth // 8].reshape(abs(h), w, depth // 8)[:, :, 2::-1])


def sgi_image(content: bytes) -> np.ndarray:
    """Samples of an SGI image, (rows, columns, samples), plain or run-length coded, of 8 or 16 bits."""
    magic, coded, size, _, w, h, n = struct.unpack_from(">HBBHHHH", content)
    if magic != 474 or size not in (1, 2):
        raise container.FormatError("not an SGI image")
    n = max(n, 1)
    if not coded:
        return np.ascontiguousarray(np.frombuffer(content, f">u{size}", w * h * n, 512).reshape(n, h, w)[:, ::-1].transpose(1, 2, 0)).astype(f"u{size}")
    starts, out = struct.unpack_from(f">{h * n}I", content, 512), np.zeros((n, h, w), f"u{size}")
    for k, at in enumerate(starts):
        line: list[int] = []
        word = lambda i, at=at: int.from_bytes(content[at + i * size : at + i * size + size], "big")
        i = 0
        while (count := word(i) & 127) and len(line) < w:
            line += [word(i + 1 + j) for j in range(count)] if word(i) & 128 else [word(i + 1)] * count
            i += 1 + (count if word(i) & 128 else 1)
        out[k // h, k % h, : len(line[:w])] = line[:w]
    return np.ascontiguousarray(out[:, ::-1].transpose(1, 2, 0))


READERS = {b"\x59\xa6": sun_raster, b"BM": bitmap, b"\x01\xda": sgi_image}


def import_images(files: DataFrame, **how) -> DataFrame:
    """(path, content) of Sun rasters, bitmaps, SGI images and PNM files as tagged files, told apart by their first bytes."""

    def rows(path: str, content: bytes) -> Iterator[tuple]:
        x = READERS.get(content[:2], raster.pnm)(content)
        yield path.rsplit(".", 1)[0] + ".tif", container.encode_pages([np.ascontiguousarray(x)], **how)

    return raster._table(files, raster.FILES, rows)


def fax_postscript(content: bytes) -> bytes:
    """PostScript of the bilevel pages of a file: a stroke for each run of ink, row by row."""
    r = container.parse(content)
    pages = [(d, container.decode_page(r, d)[:, :, 0]) for d in r.directories if d.kind == "main" and d.get("bits") == 1]
    out = [f"%!PS-Adobe-3.0\n%%Pages: {len(pages)}\n%%EndComments\n/s {{ moveto 0 rlineto stroke }} def\n"]
    for i, (d, x) in enumerate(pages, 1):
        ink = (x == 0) if d.get("photometric") == 1 else (x == 1)
        h, w = ink.shape
        out.append(f"%%Page: {i} {i}\ngsave\n612 {w} div 792 {h} div scale\n1 setlinewidth\n")
        for y in range(h):
            edge = np.flatnonzero(np.diff(ink[y].astype(np.int8), prepend=0, append=0))
            out += [f"{b - a} {a} {h - y - 0.5} s\n" for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        out.append("grestore\nshowpage\n")
    return "".join([*out, "%%EOF\n"]).encode()


def to_fax_postscript(files: DataFrame) -> DataFrame:
    return raster._table(files, raster.FILES, lambda path, content: [(path.rsplit(".", 1)[0] + ".ps", fax_postscript(content))])
