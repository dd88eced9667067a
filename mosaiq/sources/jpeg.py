"""JPEG (ITU-T T.81): Huffman-coded sequential and progressive scans of 8 or 12 bits, whole or with tables kept apart from the chunks.

Components come out at full resolution, in the colour space they are stored in. Written are sequential scans. Arithmetic,
lossless and hierarchical streams raise an error.
"""

from __future__ import annotations

import functools
import heapq
import re
from collections import Counter

import numpy as np

#: The example quantisation tables of the standard (luminance, chrominance), row by row.
LUMA = """
16 11 10 16 24 40 51 61 12 12 14 19 26 58 60 55 14 13 16 24 40 57 69 56 14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77 24 35 55 64 81 104 113 92 49 64 78 87 103 121 120 101 72 92 95 98 112 100 103 99
"""
CHROMA = """
17 18 24 47 99 99 99 99 18 21 26 66 99 99 99 99 24 26 56 99 99 99 99 99 47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99 99
"""
#: Places (row * 8 + column) in the order of the stream: along the diagonals, their direction alternating.
ORDER = np.array([r * 8 + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
_K = np.arange(8)
#: Rows are the cosine basis: BASIS @ block @ BASIS.T transforms, the transposes invert.
BASIS = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)


class JpegError(ValueError):
    pass


def _lookup(counts: bytes, symbols: bytes) -> list[tuple[int, int] | None]:
    """(symbol, bits) by the next 16 bits."""
    out, code, k = [None] * (1 << 16), 0, 0
    if len(symbols) < sum(counts):
        raise JpegError("short Huffman table")
    for n, many in enumerate(counts, 1):
        if code + many > 1 << n:
            raise JpegError("damaged Huffman table")
        for _ in range(many):
            at = code << (16 - n)
            out[at : at + (1 << (16 - n))] = [(symbols[k], n)] * (1 << (16 - n))
            code, k = code + 1, k + 1
        code <<= 1
    return out[: 1 << 16]


class Tables:
    """Quantisation and Huffman tables by number, and the restart interval."""

    def __init__(self):
        self.quant: dict[int, np.ndarray] = {}
        self.huffman: dict[int, list] = {}
        self.restart = 0

    def take(self, marker: int, body: bytes) -> None:
        i = 0
        if marker == 0xDB:
            while i < len(body):
                wide, n = body[i] >> 4, body[i] & 15
                if len(body) < i + (129 if wide else 65):
                    raise JpegError("short quantisation table")
                self.quant[n] = np.frombuffer(body, ">u2" if wide else "u1", 64, i + 1).astype(np.int64)
                i += 129 if wide else 65
        elif marker == 0xC4:
            while i + 17 <= len(body):
                counts = body[i + 1 : i + 17]
                self.huffman[body[i]] = _lookup(counts, body[i + 17 : i + 17 + sum(counts)])
                i += 17 + sum(counts)
        elif marker == 0xDD:
            self.restart = int.from_bytes(body[:2], "big")


#: The first marker after an entropy-coded part: neither a stuffed byte, a restart nor a fill byte.
_END, _RESTART = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]"), re.compile(rb"\xff[\xd0-\xd7]")


def _segments(data: bytes):
    """(marker, body, entropy-coded part) of the segments of a stream; only scans have such a part."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("not a JPEG stream")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise JpegError("damaged JPEG stream")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            return
        end = at + 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        if end > len(data) or end < at + 4:
            raise JpegError("short JPEG segment")
        body, at, part = data[at + 4 : end], end, b""
        if marker == 0xDA:
            found = _END.search(data, end)
            at = found.start() if found else len(data)
            part = data[end:at]
        yield marker, body, part


class _Scan:
    """Bits of an entropy-coded part between restarts."""

    def __init__(self, part: bytes):
        self.data, self.at, self.end = part.replace(b"\xff\x00", b"\xff") + bytes(8), 0, len(part) * 8

    def symbol(self, table: list) -> int:
        i = self.at >> 3
        found = table[int.from_bytes(self.data[i : i + 3], "big") >> (8 - (self.at & 7)) & 0xFFFF]
        if found is None or self.at > self.end:
            raise JpegError("damaged JPEG scan")
        self.at += found[1]
        return found[0]

    def value(self, n: int) -> int:
        """n bits; a leading zero marks a negative value."""
        if not n:
            return 0
        i = self.at >> 3
        v = int.from_bytes(self.data[i : i + 4], "big") >> (32 - n - (self.at & 7)) & ((1 << n) - 1)
        self.at += n
        return v if v >> (n - 1) else v - (1 << n) + 1


    def bits(self, n: int) -> int:
        """n bits as they are, 16 at most."""
        i = self.at >> 3
        self.at += n
        if self.at > self.end + 7:
            raise JpegError("damaged JPEG scan")
        return int.from_bytes(self.data[i : i + 3], "big") >> (24 - n - (self.at - n & 7)) & ((1 << n) - 1)


def _block(scan: _Scan, dc: list, ac: list, out: np.ndarray, before: int) -> int:
    before += scan.value(scan.symbol(dc))
    out[0] = before
    k = 1
    while k < 64:
        s = scan.symbol(ac)
        run, n = s >> 4, s & 15
        if not n:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise JpegError("damaged JPEG block")
        out[k] = scan.value(n)
        k += 1
    return before


def _first_pass(scan: _Scan, ac: list, out: np.ndarray, band: tuple[int, int], low: int, skip: int) -> int:
    """Coefficients of a band down to bit `low`; skip: blocks without any that are left of a run, and what is left of it then."""
    if skip:
        return skip - 1
    k, last = band
    while k <= last:
        s = scan.symbol(ac)
        run, n = s >> 4, s & 15
        if not n and run != 15:
            return (1 << run) + scan.bits(run) - 1
        k += run
        if n:
            if k > last:
                raise JpegError("damaged JPEG block")
            out[k] = scan.value(n) << low
        k += 1
    return 0


def _next_pass(scan: _Scan, ac: list, out: np.ndarray, band: tuple[int, int], low: int, skip: int) -> int:
    """One more bit, number `low`: of coefficients that are known, and of those that begin with it."""
    k, last = band
    bit = 1 << low

    def refine(at: int) -> None:
        if scan.bits(1):
            out[at] += bit if out[at] > 0 else -bit

    while k <= last and not skip:
        s = scan.symbol(ac)
        run, begins = s >> 4, s & 15
        if not begins and run != 15:
            skip = (1 << run) + scan.bits(run)
            break
        if begins > 1:
            raise JpegError("damaged JPEG block")
        value = (bit if scan.bits(1) else -bit) if begins else 0
        while k <= last:  # run counts coefficients that are still zero
            if out[k]:
                refine(k)
            elif run:
                run -= 1
            else:
                out[k] = value
                k += 1
                break
            k += 1
    if not skip:
        return 0
    for at in range(k, last + 1):
        if out[at]:
            refine(at)
    return skip - 1


def _read_scan(part: bytes, header: bytes, known: Tables, frame: dict, planes: dict, grid: tuple[int, int, int, int], progressive: bool) -> None:
    """Fill the coefficient planes of a scan's components; units go row by row, restarts begin anew."""
    across, down, w, h = grid
    band, high, low = (0, 63), 0, 0
    if not header or not header[0] or len(header) < 4 + 2 * header[0]:
        raise JpegError("damaged JPEG scan header")
    if progressive:
        k = 1 + 2 * header[0]
        band, high, low = (header[k], header[k + 1]), header[k + 2] >> 4, header[k + 2] & 15
        if not band[0] <= band[1] <= 63 or band[0] and header[0] != 1 or low > 13 or not band[0] and band[1]:
            raise JpegError("damaged JPEG scan header")
    own = []
    for i in range(header[0]):
        c, t = header[1 + 2 * i], header[2 + 2 * i]
        dc, ac = known.huffman.get(t >> 4), known.huffman.get(16 + (t & 15))
        if c not in frame or dc is None and not band[0] and not high or ac is None and band[1]:
            raise JpegError("scan without its tables")
        own.append((c, dc, ac))
    if len(own) == 1:  # alone, a component's blocks follow each other
        c, u, v, _ = frame[own[0][0]]
        columns, rows = -(-(-(-w * u // across)) // 8), -(-(-(-h * v // down)) // 8)
        cells = {c: (1, 1)}
    else:
        columns, rows = -(-w // (8 * across)), -(-h // (8 * down))
        cells = {c: frame[c][1:3] for c, _, _ in own}
    units, every = columns * rows, known.restart or columns * rows
    parts = _RESTART.split(part)
    for first, piece in zip(range(0, units, every), parts, strict=False):
        scan, before, skip = _Scan(piece), dict.fromkeys(cells, 0), 0
        for n in range(first, min(first + every, units)):
            y, x = divmod(n, columns)
            for c, dc, ac in own:
                u, v = cells[c]
                for k in range(u * v):
                    out = planes[c][y * v + k // u, x * u + k % u]
                    if not progressive:
                        before[c] = _block(scan, dc, ac, out, before[c])
                    elif band[0]:
                        skip = (_next_pass if high else _first_pass)(scan, ac, out, band, low, skip)
                    elif high:
                        out[0] |= scan.bits(1) << low
                    else:
                        before[c] += scan.value(scan.symbol(dc))
                        out[0] = before[c] << low


def decode(data: bytes, tables: bytes | None = None) -> np.ndarray:
    """(rows, columns, components) of a stream; tables: an abbreviated stream that holds tables only."""
    known, frame, planes, grid, depth, progressive = Tables(), {}, {}, (1, 1, 0, 0), 8, False
    for marker, body, _ in _segments(tables) if tables else ():
        known.take(marker, body)
    for marker, body, part in _segments(data):
        known.take(marker, body)
        if marker in (0xC0, 0xC1, 0xC2):
            if len(body) < 6 or len(body) < 6 + 3 * body[5] or not body[5] or any(not 1 <= n <= 4 for i in range(body[5]) for n in divmod(body[7 + 3 * i], 16)):
                raise JpegError("damaged JPEG frame header")
            depth, progressive = body[0], marker == 0xC2
            if depth not in (8, 12):
                raise JpegError(f"{depth}-bit JPEG isn't supported")
            h, w = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            each = [body[6 + 3 * i : 9 + 3 * i] for i in range(body[5])]
            frame = {c: (c, s >> 4, s & 15, q) for c, s, q in each}
            across, down = max(f[1] for f in frame.values()), max(f[2] for f in frame.values())
            grid = (across, down, w, h)
            planes = {c: np.zeros((-(-h // (8 * down)) * v, -(-w // (8 * across)) * u, 64), np.int32) for c, u, v, _ in frame.values()}
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise JpegError("only sequential and progressive JPEG of Huffman codes is supported")
        elif marker == 0xDA:
            _read_scan(part, body, known, frame, planes, grid, progressive)
    if not frame:
        raise JpegError("no frame")
    across, down, w, h = grid
    kind = np.uint8 if depth == 8 else np.uint16
    out = np.zeros((h, w, len(frame)), kind)
    for i, (c, u, v, q) in enumerate(frame.values()):
        if q not in known.quant:
            raise JpegError("no quantisation table")
        flat = np.zeros(planes[c].shape, float)
        flat[:, :, ORDER] = planes[c] * known.quant[q]
        light = np.clip(np.round(BASIS.T @ flat.reshape(*flat.shape[:2], 8, 8) @ BASIS + (1 << depth - 1)), 0, (1 << depth) - 1).astype(kind)
        image = light.transpose(0, 2, 1, 3).reshape(flat.shape[0] * 8, -1)
        out[:, :, i] = image[np.arange(h)[:, None] * v // down, np.arange(w)[None, :] * u // across]
    return out


def _code_lengths(counts: Counter) -> dict[int, int]:
    """Bits of each symbol, 16 at most; a spare symbol takes the code of ones only, which isn't allowed."""
    weights = {**counts, -1: 0}
    while True:
        heap = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(weights.items()))]
        heapq.heapify(heap)
        bits, serial = dict.fromkeys(weights, 0), len(heap)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for s in a[2] + b[2]:
                bits[s] += 1
            heapq.heappush(heap, (a[0] + b[0], serial, a[2] + b[2]))
            serial += 1
        if max(bits.values()) <= 16:
            return bits
        weights = {s: n // 2 + 1 if s >= 0 else 0 for s, n in weights.items()}


def _huffman(counts: Counter) -> tuple[bytes, dict[int, str]]:
    """The table as stored, and each symbol's code."""
    bits = _code_lengths(counts or Counter({0: 1}))
    last = max(bits.values())
    order = sorted((s for s in bits if s >= 0), key=lambda s: (bits[s], s))
    # canonical codes count up, so the spare symbol's code of ones stays free where it is among the longest
    per = [sum(bits[s] == n for s in order) for n in range(1, 17)]
    assert bits[-1] == last
    codes, code, k = {}, 0, 0
    for n, many in enumerate(per, 1):
        for _ in range(many):
            codes[order[k]] = f"{code:0{n}b}"
            code, k = code + 1, k + 1
        code <<= 1
    return bytes(per) + bytes(order), codes


def _magnitude(v: int) -> tuple[int, str]:
    n = abs(v).bit_length()
    return n, f"{v if v > 0 else v + (1 << n) - 1:0{n}b}" if n else ""


def encode(x: np.ndarray, quality: int = 75, subsampling: tuple[int, int] = (1, 1)) -> bytes:
    """A sequential stream of (rows, columns, components); subsampling (across, down) thins all components but the first.

    Samples of 16 bits are taken as 12-bit ones.
    """
    h, w, n = x.shape
    depth = 8 if x.dtype.itemsize == 1 else 12
    if not h or not w or h > 65535 or w > 65535:
        raise JpegError("JPEG holds 1 to 65535 rows and columns")
    across, down = subsampling if n > 1 else (1, 1)
    scale = 5000 // max(quality, 1) if quality < 50 else 200 - 2 * min(quality, 100)
    quant = [np.clip((np.array(t.split(), int) * scale + 50) // 100, 1, 255)[ORDER] for t in (LUMA, CHROMA)]
    mx, my = -(-w // (8 * across)), -(-h // (8 * down))
    full = np.pad(x, ((0, my * 8 * down - h), (0, mx * 8 * across - w), (0, 0)), mode="edge").astype(float)
    blocks, shape = [], []
    for i in range(n):
        one = full[:, :, i]
        u, v = (across, down) if i == 0 else (1, 1)
        if i:
            one = one.reshape(my * 8, down, mx * 8, across).mean(axis=(1, 3))
        cut = (one - (1 << depth - 1)).reshape(my * v, 8, mx * u, 8).transpose(0, 2, 1, 3)
        done = np.round((BASIS @ cut @ BASIS.T).reshape(my * v, mx * u, 64)[:, :, ORDER] / quant[i > 0]).astype(int)
        blocks.append(done)
        shape.append((u, v))
    tokens, before = [], [0] * n  # (table, symbol, further bits)
    for y in range(my):
        for xx in range(mx):
            for i, (u, v) in enumerate(shape):
                for k in range(u * v):
                    b = blocks[i][y * v + k // u, xx * u + k % u]
                    size, more = _magnitude(int(b[0]) - before[i])
                    before[i] = int(b[0])
                    tokens.append((i > 0, size, more))
                    at = 1
                    for p in (np.flatnonzero(b[1:]) + 1).tolist():
                        while p - at > 15:
                            tokens.append((2 + (i > 0), 0xF0, ""))
                            at += 16
                        size, more = _magnitude(int(b[p]))
                        tokens.append((2 + (i > 0), (p - at) << 4 | size, more))
                        at = p + 1
                    if at < 64:
                        tokens.append((2 + (i > 0), 0, ""))
    counts = [Counter() for _ in range(4)]
    for t, s, _ in tokens:
        counts[t][s] += 1
    made = [_huffman(k) for k in counts]
    text = "".join(made[t][1][s] + more for t, s, more in tokens)
    text += "1" * (-len(text) % 8)
    body = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    segment = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    out = b"\xff\xd8" + b"".join(segment(0xDB, bytes([i]) + q.astype(np.uint8).tobytes()) for i, q in enumerate(quant[: 1 + (n > 1)]))
    out += segment(0xC0 if depth == 8 else 0xC1, bytes([depth]) + h.to_bytes(2, "big") + w.to_bytes(2, "big") + bytes([n]) + b"".join(bytes([i + 1, u << 4 | v, int(i > 0)]) for i, (u, v) in enumerate(shape)))
    for t in (0, 2, 1, 3)[: 2 if n == 1 else 4]:
        out += segment(0xC4, bytes([(t >= 2) << 4 | t % 2]) + made[t][0])
    out += segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, 0x11 * (i > 0)]) for i in range(n)) + bytes([0, 63, 0]))
    return out + body + b"\xff\xd9"


def pack12(x: np.ndarray) -> bytes:
    """Rows of 12-bit samples, the highest bit first; a row ends on a whole byte."""
    bits = (x.reshape(len(x), -1, 1) >> np.arange(11, -1, -1)) & 1
    return np.packbits(bits.reshape(len(x), -1).astype(np.uint8), axis=1).tobytes()


#: A page in one stream is asked for chunk by chunk; the last one stays decoded.
_page = functools.lru_cache(maxsize=1)(decode)


def decode_chunk(data: bytes, how: dict) -> bytes:
    """Samples of a chunk, the part of its stream from `at` (row, column) on; beyond the stream they are zero. 12-bit samples are packed."""
    x = _page(data) if "at" in how else decode(data, how.get("tables"))
    rows, width, per = how["rows"], how["width"], how.get("samples", 1)
    y0, x0 = how.get("at", (0, 0))
    x = x[y0 : y0 + rows, x0 : x0 + width, :per]
    out = np.zeros((rows, width, per), x.dtype)
    out[: x.shape[0], : x.shape[1], : x.shape[2]] = x
    if x.dtype == np.uint8:
        return out.tobytes()
    return pack12(out) if how.get("bits", 12) == 12 else out.astype(how.get("order", "<") + "u2").tobytes()


def encode_chunk(data: bytes, how: dict) -> bytes:
    """A stream of 8-bit samples, or of packed 12-bit ones."""
    bits, width, per = how.get("bits", 8), how["width"], how.get("samples", 1)
    if bits == 12:
        row = (width * per * 12 + 7) // 8
        flat = np.unpackbits(np.frombuffer(data, np.uint8).reshape(-1, row), axis=1)[:, : width * per * 12].reshape(-1, width, per, 12)
        return encode((flat.astype(np.uint16) << np.arange(11, -1, -1, dtype=np.uint16)).sum(axis=3, dtype=np.uint16), how.get("quality", 75))
    if bits != 8:
        raise JpegError("JPEG chunks hold samples of 8 or 12 bits")
    return encode(np.frombuffer(data, np.uint8).reshape(-1, width, per), how.get("quality", 75))
