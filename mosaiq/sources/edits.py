"""Changes to directories of a file: set and unset tags, drop pages, cut one large strip. Bytes in, new bytes out.

Chunks stay where they are; changed directories are written at the end and linked in place of the old ones.
"""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from mosaiq.sources import container, raster

Tags = dict[int, tuple[int, list | str | bytes]]


def _shape(r: container.Raster) -> tuple[str, int, int, str]:
    """Code of the entry count, bytes of an entry, bytes of a word, code of a word."""
    return ("Q", 20, 8, "Q") if r.big else ("H", 12, 4, "I")


def _main(r: container.Raster, index: int) -> list[container.Directory]:
    chain = [d for d in r.directories if d.kind == "main"]
    if not 0 <= index < len(chain):
        raise container.FormatError(f"no page {index}")
    return chain


def _link(r: container.Raster, chain: list[container.Directory], index: int) -> int:
    """Where the offset of a page's directory is stored."""
    if index == 0:
        return 8 if r.big else 4
    return _next(r, chain[index - 1])


def _next(r: container.Raster, d: container.Directory) -> int:
    count, each, _, _ = _shape(r)
    n = struct.unpack_from(r.order + count, r.data, d.offset)[0]
    return d.offset + struct.calcsize("=" + count) + n * each


def set_tags(data: bytes, index: int, put: Tags, drop: tuple[int, ...] = ()) -> bytes:
    """The file with tags of page `index` set (number -> (type, values)) and others unset; other entries keep their bytes."""
    r = container.parse(data)
    chain = _main(r, index)
    count, each, word, code = _shape(r)
    d = chain[index]
    first, end = d.offset + struct.calcsize("=" + count), _next(r, d)
    entries = {}
    for at in range(first, end, each):
        tag = struct.unpack_from(r.order + "H", data, at)[0]
        if tag not in put and tag not in drop:
            entries.setdefault(tag, data[at : at + each])
    out = bytearray(data)
    for tag, (kind, values) in put.items():
        n, raw = container.packed(r.order, kind, values)
        if len(raw) > word:
            out += bytes(len(out) % 2)
            raw, at = struct.pack(r.order + code, len(out)), raw
            out += at
        entries[tag] = struct.pack(r.order + "HH" + code, tag, kind, n) + raw.ljust(word, b"\0")
    out += bytes(len(out) % 2)
    struct.pack_into(r.order + code, out, _link(r, chain, index), len(out))
    return bytes(out + struct.pack(r.order + count, len(entries)) + b"".join(e for _, e in sorted(entries.items())) + data[end : end + word].ljust(word, b"\0"))


def unlink_page(data: bytes, index: int) -> bytes:
    """The file without page `index` in its chain; the bytes of the page stay unused."""
    r = container.parse(data)
    chain = _main(r, index)
    _, _, word, _ = _shape(r)
    out, at, link = bytearray(data), _next(r, chain[index]), _link(r, chain, index)
    out[link : link + word] = data[at : at + word].ljust(word, b"\0")
    return bytes(out)


def chop_strips(data: bytes, index: int = 0, target: int = 8192) -> bytes:
    """The file with one uncompressed strip of a page cut into strips of about `target` bytes; other pages and layouts stay."""
    r = container.parse(data)
    d = _main(r, index)[index]
    parts = container.layout(d)
    if d.get("compression") != 1 or container.NUMBER["tile_width"] in d.tags or len(parts) != 1:
        return data
    row = (d.get("width") * (1 if d.get("planar") == 2 else d.get("samples")) * d.get("bits") + 7) // 8
    rows, height, at = max(1, target // max(row, 1)), d.get("length"), parts[0].offset
    if rows >= height:
        return data
    starts = range(0, height, rows)
    kind = 16 if r.big else 4
    return set_tags(data, index, {273: (kind, [at + y * row for y in starts]), 278: (4, [rows]), 279: (kind, [min(rows, height - y) * row for y in starts])})


def edit(files: DataFrame, change, broken: str = "raise") -> DataFrame:
    """(path, content) of files changed by a function of bytes, such as the ones above with their settings bound.

    A file that can't be read fails the job by its name, or with broken="keep" stays as it is, or "drop": goes.
    """

    def rows(path: str, content: bytes):
        try:
            return [(path, change(content))]
        except container.FormatError as e:
            if broken == "raise":
                raise container.FormatError(f"{path}: {e}") from e
            return [(path, content)] if broken == "keep" else []

    return raster._table(files, raster.FILES, rows)
