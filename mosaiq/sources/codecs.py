"""Chunk codecs and predictors, on bytes; a registry that users can extend."""

from __future__ import annotations

import lzma
import zlib
from collections.abc import Callable

import numpy as np
import zstandard

from mosaiq.sources import fax, jpeg, logs

#: Compression scheme numbers of the container format.
NONE, CCITT_RLE, CCITT_G3, CCITT_G4, LZW, JPEG_OLD, JPEG, DEFLATE_ADOBE = 1, 2, 3, 4, 5, 6, 7, 8
NEXT, CCITT_RLEW, PACKBITS, THUNDERSCAN, PIXARLOG, DEFLATE, SGILOG, SGILOG24, LZMA, ZSTD = 32766, 32771, 32773, 32809, 32909, 32946, 34676, 34677, 34925, 50000


class CodecError(ValueError):
    pass


#: Codes that are read at once after a clear code; a table is full before.
BURST = 4200


def _widths(n: int, early: int) -> np.ndarray:
    """Bits of the j-th code after a clear: as many as the table's size then needs, which grows by one a code."""
    size = 257 + np.arange(n) + early
    return np.clip(np.ceil(np.log2(size + 1)), 9, 12).astype(np.int64)


def lzw_decode(data: bytes, limit: int | None = None) -> bytes:
    """LZW of 9 to 12 bits, most significant bit first, widening one code early; old streams are least bit first.

    Where codes lie follows from their count since the last clear code, so they are cut out many at once.
    """
    old = len(data) > 1 and data[0] == 0 and data[1] & 1
    raw = np.frombuffer(data + bytes(4), np.uint8).astype(np.int64)
    fresh = [bytes([i]) for i in range(256)] + [b"", b""]
    bits, at, out, size, burst = len(data) * 8, 0, [], 0, BURST
    while at + 9 <= bits and (limit is None or size < limit):
        n = min(burst, (bits - at) // 9 + 1)
        width = _widths(n, 0 if old else 1)
        place = at + np.cumsum(width) - width
        inside = place + width <= bits
        place, width = place[inside], width[inside]
        byte, shift = place >> 3, place & 7
        if old:
            codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> shift
        else:
            codes = (raw[byte] << 16 | raw[byte + 1] << 8 | raw[byte + 2]) >> (24 - shift - width)
        codes &= (1 << width) - 1
        special = np.flatnonzero((codes == 256) | (codes == 257))
        if not len(special) and len(codes) == burst:
            burst = bits  # no clear code comes: all that is left belongs together
            continue
        stop = int(special[0]) if len(special) else len(codes)
        burst, found = BURST, codes[:stop].tolist()
        if found:
            if found[0] > 255:
                raise CodecError("corrupt LZW stream")
            table = fresh.copy()
            prev, add, put = table[found[0]], table.append, out.append
            put(prev)
            size += 1
            for code in found[1:]:
                n = len(table)
                if code < n:
                    entry = table[code]
                elif code == n:
                    entry = prev + prev[:1]
                else:
                    raise CodecError("corrupt LZW stream")
                if n < 4096:
                    add(prev + entry[:1])
                put(entry)
                prev = entry
                size += len(entry)
        if stop == len(codes) or codes[stop] == 257:
            break
        at = int(place[stop] + width[stop])
    whole = b"".join(out)
    return whole if limit is None else whole[:limit]


def lzw_encode(data: bytes) -> bytes:
    codes, widths, n, width = [256], [9], 258, 9
    table: dict[int, int] = {}
    find, put, wide = table.get, codes.append, widths.append
    now = data[0] if data else None
    for byte in data[1:]:
        key = now << 8 | byte
        known = find(key)
        if known is not None:
            now = known
            continue
        put(now)
        wide(width)
        table[key] = n
        n += 1
        now = byte
        if n == 4095:
            put(256)
            wide(width)
            table.clear()
            n, width = 258, 9
        elif n > (1 << width) - 1:
            width += 1
    if now is not None:
        put(now)
        wide(width)
        if n + 1 > (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    wide(width)
    c, w = np.array(codes, np.int64), np.array(widths, np.int64)
    ends = np.cumsum(w)
    back = np.repeat(ends, w) - 1 - np.arange(ends[-1])  # places from the end of each code
    return np.packbits((np.repeat(c, w) >> back & 1).astype(np.uint8)).tobytes()


def packbits_decode(data: bytes, limit: int | None = None) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and (limit is None or len(out) < limit):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out if limit is None else out[:limit])


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more equal bytes are packed, what lies between them is literal; both up to 128 bytes at a time."""
    out, x = bytearray(), np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(x)) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
    long = np.flatnonzero(np.diff(edges) >= 3)
    at = 0
    for begin, end in [*zip(edges[long].tolist(), edges[long + 1].tolist(), strict=True), (len(x), len(x))]:
        for i in range(at, begin, 128):
            part = data[i : min(i + 128, begin)]
            out.append(len(part) - 1)
            out += part
        for i in range(begin, end, 128):
            n = min(128, end - i)
            out += bytes([257 - n if n > 1 else 0, data[i]])
        at = end
    return bytes(out)


def next_decode(data: bytes, limit: int, row: int) -> bytes:
    """Two-bit grey rows: literal rows, literal spans of a row, or runs of a grey on a white row."""
    out, i = bytearray(), 0
    while len(out) < limit and i < len(data):
        kind = data[i]
        i += 1
        line = bytearray(b"\xff" * row)
        if kind == 0x00:
            line[:] = data[i : i + row].ljust(row, b"\xff")
            i += row
        elif kind == 0x40:
            at, n = int.from_bytes(data[i : i + 2], "big"), int.from_bytes(data[i + 2 : i + 4], "big")
            if at + n > row:
                raise CodecError("span beyond the row")
            line[at : at + n] = data[i + 4 : i + 4 + n]
            i += 4 + n
        else:
            grey = []
            i -= 1
            while len(grey) < row * 4 and i < len(data):
                grey += [data[i] >> 6] * (data[i] & 63)
                i += 1
            grey = (grey + [3] * (row * 4))[: row * 4]
            line = bytearray(grey[k] << 6 | grey[k + 1] << 4 | grey[k + 2] << 2 | grey[k + 3] for k in range(0, row * 4, 4))
        out += line
    return bytes(out[:limit])


def thunder_decode(data: bytes, width: int) -> bytes:
    """One row of four-bit samples: raw samples, runs, and deltas of two or three bits."""
    #: What the codes of a delta stand for.
    two, three, last, out = (0, 1, 0, -1), (0, 1, 2, 3, 0, -3, -2, -1), 0, []
    for b in data:
        if len(out) >= width:
            break
        kind, rest = b >> 6, b & 63
        if kind == 0:
            out += [last] * rest
        elif kind == 1:
            for s in (4, 2, 0):
                if (d := rest >> s & 3) != 2:
                    last = last + two[d] & 15
                    out.append(last)
        elif kind == 2:
            for s in (3, 0):
                if (d := rest >> s & 7) != 4:
                    last = last + three[d] & 15
                    out.append(last)
        else:
            last = rest & 15
            out.append(last)
    if len(out) < width:
        raise CodecError("short row")
    out = out[:width] + [0] * (width % 2)
    return bytes(a << 4 | b for a, b in zip(out[::2], out[1::2], strict=True))


Decoder = Callable[[bytes, dict], bytes]
Encoder = Callable[[bytes, dict], bytes]


def _fax(kind: str) -> tuple[Decoder, Encoder]:
    """how: options, the bits of the G3 options tag (1: mixed rows, 4: ends of lines on bytes)."""
    size = lambda d, how: (how["width"] * how.get("samples", 1), how.get("rows") or len(d) // ((how["width"] * how.get("samples", 1) + 7) // 8))
    two = lambda how: kind == "g3" and bool(how.get("options", 0) & 1)
    return (
        lambda d, how: fax.decode(d, *size(d, how), kind, two(how)),
        lambda d, how: fax.encode(d, *size(d, how), kind, two(how), bool(how.get("options", 0) & 4)),
    )


CODECS: dict[int, tuple[str, Decoder | None, Encoder | None]] = {
    NONE: ("none", lambda d, how: d, lambda d, how: d),
    LZW: ("lzw", lambda d, how: lzw_decode(d, how.get("size")), lambda d, how: lzw_encode(d)),
    PACKBITS: ("packbits", lambda d, how: packbits_decode(d, how.get("size")), lambda d, how: b"".join(packbits_encode(d[i : i + (how.get("row") or len(d) or 1)]) for i in range(0, len(d), how.get("row") or len(d) or 1))),
    DEFLATE_ADOBE: ("deflate", lambda d, how: zlib.decompressobj().decompress(d, how.get("size") or 0), lambda d, how: zlib.compress(d, how.get("level", 6))),
    DEFLATE: ("deflate-old", lambda d, how: zlib.decompressobj().decompress(d, how.get("size") or 0), lambda d, how: zlib.compress(d, how.get("level", 6))),
    LZMA: ("lzma", lambda d, how: lzma.decompress(d), lambda d, how: lzma.compress(d, format=lzma.FORMAT_XZ, check=lzma.CHECK_NONE)),
    ZSTD: ("zstd", lambda d, how: zstandard.ZstdDecompressor().decompressobj().decompress(d), lambda d, how: zstandard.ZstdCompressor(level=how.get("level", 9)).compress(d)),
    NEXT: ("next", lambda d, how: next_decode(d, how["size"], how["row"]), None),
    THUNDERSCAN: ("thunderscan", lambda d, how: thunder_decode(d, how["width"]), None),
    CCITT_RLE: ("ccitt-rle", *_fax("rle")),
    CCITT_RLEW: ("ccitt-rlew", *_fax("rlew")),
    CCITT_G3: ("ccitt-g3", *_fax("g3")),
    CCITT_G4: ("ccitt-g4", *_fax("g4")),
    SGILOG: ("sgilog", logs.decode_sgilog, logs.encode_sgilog),
    SGILOG24: ("sgilog24", logs.decode_sgilog24, logs.encode_sgilog24),
    JPEG: ("jpeg", jpeg.decode_chunk, jpeg.encode_chunk),
    JPEG_OLD: ("jpeg-old", jpeg.decode_chunk, None),
    PIXARLOG: ("pixarlog", logs.decode_film, logs.encode_film),
}


def register_codec(scheme: int, name: str, decode: Decoder | None, encode: Encoder | None) -> None:
    """Add or replace a codec; a task learns of it if this runs in a module that the task imports."""
    CODECS[scheme] = (name, decode, encode)


def unregister_codec(scheme: int) -> None:
    CODECS.pop(scheme, None)


def configured() -> list[tuple[int, str, bool, bool]]:
    """(scheme, name, decodes, encodes) of all codecs."""
    return [(k, n, d is not None, e is not None) for k, (n, d, e) in sorted(CODECS.items())]


def _codec(scheme: int, way: int) -> Callable:
    found = CODECS.get(scheme)
    if found is None or found[way] is None:
        raise CodecError(f"compression scheme {scheme} isn't configured for {'decoding' if way == 1 else 'encoding'}")
    return found[way]


def decode(scheme: int, data: bytes, **how) -> bytes:
    """Decode a chunk. how: size, the bytes expected; row, bytes of a row; width, samples of a row."""
    return _codec(scheme, 1)(data, how)


def encode(scheme: int, data: bytes, **how) -> bytes:
    return _codec(scheme, 2)(data, how)


def undo_predictor(kind: int, data: bytes, row: int, bits: int, samples: int, order: str = "<") -> bytes:
    """Undo horizontal differencing (2) or floating-point byte planes (3), row by row."""
    if kind == 1 or not data:
        return data
    n = len(data) // row * row
    if kind == 2:
        x = np.frombuffer(data[:n], f"{order}u{bits // 8}").reshape(-1, row * 8 // bits // samples, samples)
        return np.cumsum(x, axis=1, dtype=x.dtype.newbyteorder("=")).astype(x.dtype).tobytes() + data[n:]
    if kind == 3:
        size = bits // 8
        x = np.frombuffer(data[:n], np.uint8).reshape(-1, row // samples, samples)
        flat = np.cumsum(x, axis=1, dtype=np.uint8).reshape(-1, size, row // size)
        return np.ascontiguousarray(flat.transpose(0, 2, 1)[:, :, ::-1] if order == "<" else flat.transpose(0, 2, 1)).tobytes() + data[n:]
    raise CodecError(f"unknown predictor {kind}")


def apply_predictor(kind: int, data: bytes, row: int, bits: int, samples: int, order: str = "<") -> bytes:
    if kind == 1 or not data:
        return data
    if kind == 2:
        x = np.frombuffer(data, f"{order}u{bits // 8}").reshape(-1, row * 8 // bits // samples, samples)
        y = x.copy()
        y[:, 1:] -= x[:, :-1]
        return y.tobytes()
    if kind == 3:
        size = bits // 8
        x = np.frombuffer(data, np.uint8).reshape(-1, row // size, size)
        planes = (x[:, :, ::-1] if order == "<" else x).transpose(0, 2, 1).reshape(-1, row // samples, samples)
        y = planes.copy()
        y[:, 1:] -= planes[:, :-1]
        return y.tobytes()
    raise CodecError(f"unknown predictor {kind}")


REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def reverse_bits(data: bytes) -> bytes:
    """Swap the bit order of every byte (fill order 2)."""
    return data.translate(REVERSED)
