"""Codecs that store logarithms: log luminance with or without chroma, and 11-bit logarithms of film scans."""

from __future__ import annotations

import zlib

import numpy as np

LN2 = 0.693147180559945309417
#: Photometric interpretations of log data.
LOGL, LOGLUV = 32844, 32845
#: Steps of the film scale: codes up to it are linear, then each code is a factor e^(1/250); code 1250 is white.
STEPS, WHITE, CODES = 250, 1250, 2048

#: Cells of (u', v') that 14 bits number: side, least v', and for each row of cells upwards the least u' and how many.
CELL, LOWEST = np.float32(0.0035), np.float32(0.01694)
ROWS = """
0.247663 4, 0.243779 6, 0.241684 7, 0.237874 9, 0.235906 10, 0.232153 12, 0.228352 14, 0.226259 15, 0.222371 17, 0.220410 18,
0.214710 21, 0.212714 22, 0.210721 23, 0.204976 26, 0.202986 27, 0.199245 29, 0.195525 31, 0.193560 32, 0.189878 34, 0.186216 36,
0.186216 36, 0.182592 38, 0.179003 40, 0.175466 42, 0.172001 44, 0.172001 44, 0.168612 46, 0.168612 46, 0.163575 49, 0.158642 52,
0.158642 52, 0.158642 52, 0.153815 55, 0.153815 55, 0.149097 58, 0.149097 58, 0.142746 62, 0.142746 62, 0.142746 62, 0.138270 65,
0.138270 65, 0.138270 65, 0.132166 69, 0.132166 69, 0.126204 73, 0.126204 73, 0.126204 73, 0.120381 77, 0.120381 77, 0.120381 77,
0.120381 77, 0.112962 82, 0.112962 82, 0.112962 82, 0.107450 86, 0.107450 86, 0.107450 86, 0.107450 86, 0.100343 91, 0.100343 91,
0.100343 91, 0.095126 95, 0.095126 95, 0.095126 95, 0.095126 95, 0.088276 100, 0.088276 100, 0.088276 100, 0.088276 100, 0.081523 105,
0.081523 105, 0.081523 105, 0.081523 105, 0.074861 110, 0.074861 110, 0.074861 110, 0.074861 110, 0.068290 115, 0.068290 115, 0.068290 115,
0.068290 115, 0.063573 119, 0.063573 119, 0.063573 119, 0.063573 119, 0.057219 124, 0.057219 124, 0.057219 124, 0.057219 124, 0.050985 129,
0.050985 129, 0.050985 129, 0.050985 129, 0.050985 129, 0.044859 134, 0.044859 134, 0.044859 134, 0.044859 134, 0.040571 138, 0.040571 138,
0.040571 138, 0.040571 138, 0.036339 142, 0.036339 142, 0.036339 142, 0.036339 142, 0.032139 146, 0.032139 146, 0.032139 146, 0.032139 146,
0.027947 150, 0.027947 150, 0.027947 150, 0.023739 154, 0.023739 154, 0.023739 154, 0.023739 154, 0.019504 158, 0.019504 158, 0.019504 158,
0.016976 161, 0.016976 161, 0.016976 161, 0.016976 161, 0.012639 165, 0.012639 165, 0.012639 165, 0.009991 168, 0.009991 168, 0.009991 168,
0.009016 170, 0.009016 170, 0.009016 170, 0.006217 173, 0.006217 173, 0.005097 175, 0.005097 175, 0.005097 175, 0.003909 177, 0.003909 177,
0.002340 177, 0.002389 170, 0.001068 164, 0.001653 157, 0.000717 150, 0.001614 143, 0.000270 136, 0.000484 129, 0.001103 123, 0.001242 115,
0.001188 109, 0.001011 103, 0.000709 97, 0.000301 89, 0.002416 82, 0.003251 76, 0.003246 69, 0.004141 62, 0.005963 55, 0.008839 47,
0.010490 40, 0.016994 31, 0.023659 21
"""
_ROWS = np.array([r.split() for r in ROWS.split(",")]).T
STARTS, COUNTS = _ROWS[0].astype(np.float32).astype(float), _ROWS[1].astype(int)
FIRST = np.cumsum(COUNTS) - COUNTS
NEUTRAL = 0.210526316, 0.473684211


class LogError(ValueError):
    pass


def decode_planes(data: bytes, width: int, size: int) -> tuple[np.ndarray, int]:
    """A row of words of `size` bytes, each byte plane (the highest first) in runs; and the bytes it took."""
    planes, i = np.zeros((width, size), np.uint8), 0
    for p in range(size):
        at = 0
        while at < width:
            if i >= len(data):
                raise LogError("short row")
            n = data[i]
            if n >= 128:
                if i + 1 >= len(data):
                    raise LogError("short row")
                planes[at : at + n - 126, p] = data[i + 1]
                at, i = at + n - 126, i + 2
            else:
                part = np.frombuffer(data[i + 1 : i + 1 + n], np.uint8)[: width - at]
                planes[at : at + len(part), p] = part
                if len(part) < min(n, width - at):
                    raise LogError("short row")
                at, i = at + n, i + 1 + n
    return planes.view(f">u{size}")[:, 0].astype(f"u{size}"), i


def encode_planes(row: np.ndarray, size: int) -> bytes:
    """The inverse: runs of 4 and more equal bytes are packed, up to 129 at a time; others are literal, up to 127."""
    out = bytearray()
    for b in np.ascontiguousarray(row.astype(f">u{size}")).view(np.uint8).reshape(-1, size).T:
        ends = np.append(np.flatnonzero(np.diff(b)) + 1, len(b)).tolist()
        at, held = 0, bytearray()

        def flush(held=held):
            for k in range(0, len(held), 127):
                out.extend(bytes([len(held[k : k + 127])]) + held[k : k + 127])
            held.clear()

        for end in ends:
            n, value = end - at, int(b[at]) if len(b) else 0
            while n >= 4:
                flush()
                out += bytes([126 + min(n, 129), value])
                n -= min(n, 129)
            held += bytes([value]) * n
            at = end
        flush()
    return bytes(out)


def luminance16(codes: np.ndarray) -> np.ndarray:
    """Y of sign and 15-bit logarithm."""
    e = codes & 0x7FFF
    y = np.exp(LN2 / 256 * (e + 0.5) - LN2 * 64)
    return np.where(e == 0, 0.0, np.where(codes & 0x8000, -y, y))


def codes16(y: np.ndarray) -> np.ndarray:
    """Codes of Y; the inverse of luminance16 up to half a step."""
    size = np.abs(np.asarray(y, float))
    e = np.where(size > 5.4136769e-20, np.clip(np.floor(256 * (np.log2(np.maximum(size, 1e-30)) + 64)), 0, 0x7FFF), 0).astype(np.uint16)
    return np.where((np.asarray(y) < 0) & (e > 0), e | 0x8000, e).astype(np.uint16)


def xyz32(codes: np.ndarray) -> np.ndarray:
    """XYZ of 16 bits of log luminance and 8 bits of each of u' and v', in steps of 1/410."""
    y = luminance16((codes >> 16).astype(np.uint16))
    u, v = ((codes >> 8 & 255) + 0.5) / 410, ((codes & 255) + 0.5) / 410
    s = 1 / (6 * u - 16 * v + 12)
    cx, cy = 9 * u * s, 4 * v * s
    out = np.stack([cx / cy * y, y, (1 - cx - cy) / cy * y], axis=-1)
    return np.where(y[..., None] > 0, out, 0.0)


def codes32(xyz: np.ndarray) -> np.ndarray:
    """Codes of XYZ; colours without light take the neutral chroma."""
    x, y, z = (xyz[..., i].astype(float) for i in range(3))
    s, le = x + 15 * y + 3 * z, codes16(y)
    dark = (le == 0) | (s <= 0)
    s = np.where(dark, 1.0, s)
    u, v = np.where(dark, NEUTRAL[0], 4 * x / s), np.where(dark, NEUTRAL[1], 9 * y / s)
    step = lambda t: np.clip(np.floor(410 * t), 0, 255).astype(np.uint32)
    return le.astype(np.uint32) << 16 | step(u) << 8 | step(v)


def luminance10(codes: np.ndarray) -> np.ndarray:
    """Y of the 10-bit logarithm in the upper bits of packed 24-bit pixels."""
    p = codes >> 14 & 0x3FF
    return np.where(p == 0, 0.0, np.exp(LN2 / 64 * (p + 0.5) - LN2 * 12))


def codes10(y: np.ndarray) -> np.ndarray:
    """10-bit logarithms of Y; the inverse of luminance10 up to half a step."""
    y = np.asarray(y, float)
    return np.where(y <= 0.00024283, 0, np.where(y >= 15.742, 0x3FF, np.floor(64 * (np.log2(np.clip(y, 1e-5, 16)) + 12)))).astype(np.uint32)


def chroma_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """u', v' of the middle of numbered cells; numbers beyond them mean neutral."""
    row = np.clip(np.searchsorted(FIRST, cells, side="right") - 1, 0, len(FIRST) - 1)
    known = cells < FIRST[-1] + COUNTS[-1]
    u, v = STARTS[row] + (cells - FIRST[row] + 0.5) * float(CELL), float(LOWEST) + (row + 0.5) * float(CELL)
    return np.where(known, u, NEUTRAL[0]), np.where(known, v, NEUTRAL[1])


def _border() -> tuple[np.ndarray, np.ndarray]:
    """Cells at the ends of their rows and in the outer rows, by their angle around neutral; and the angles."""
    inner = [c for f, n in zip(FIRST[1:-1], COUNTS[1:-1], strict=True) for c in {f, f + n - 1}]
    cells = np.array(sorted([*range(COUNTS[0]), *inner, *range(FIRST[-1], FIRST[-1] + COUNTS[-1])]))
    u, v = chroma_of(cells)
    angles = np.arctan2(v - NEUTRAL[1], u - NEUTRAL[0])
    order = np.argsort(angles)
    return cells[order], angles[order]


def cells_of(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The number of the cell that holds u', v'; colours outside all cells take the border cell in their direction from neutral."""
    row = np.floor((v - float(LOWEST)) / float(CELL)).astype(int)
    safe = np.clip(row, 0, len(FIRST) - 1)
    column = np.floor((u - STARTS[safe]) / float(CELL)).astype(int)
    inside = (row == safe) & (column >= 0) & (column < COUNTS[safe])
    cells, angles = _border()
    turn = np.arctan2(v - NEUTRAL[1], u - NEUTRAL[0])
    after = np.searchsorted(angles, turn)
    one, two = after % len(angles), after - 1
    apart = lambda i: np.abs((angles[i] - turn + np.pi) % (2 * np.pi) - np.pi)
    return np.where(inside, FIRST[safe] + column, cells[np.where(apart(one) < apart(two), one, two)])


def xyz24(codes: np.ndarray) -> np.ndarray:
    """XYZ of 10 bits of log luminance and the 14-bit number of a cell of chroma."""
    y, (u, v) = luminance10(codes), chroma_of((codes & 0x3FFF).astype(int))
    s = 1 / (6 * u - 16 * v + 12)
    cx, cy = 9 * u * s, 4 * v * s
    out = np.stack([cx / cy * y, y, (1 - cx - cy) / cy * y], axis=-1)
    return np.where(y[..., None] > 0, out, 0.0)


def codes24(xyz: np.ndarray) -> np.ndarray:
    """Codes of XYZ; colours without light take the neutral chroma."""
    x, y, z = (xyz[..., i].astype(float) for i in range(3))
    s, le = x + 15 * y + 3 * z, codes10(y)
    dark = (le == 0) | (s <= 0)
    s = np.where(dark, 1.0, s)
    return le << 14 | cells_of(np.where(dark, NEUTRAL[0], 4 * x / s), np.where(dark, NEUTRAL[1], 9 * y / s)).astype(np.uint32)


def decode_sgilog24(data: bytes, how: dict) -> bytes:
    """X, Y and Z as floats of pixels of three bytes, the highest first."""
    n = how["width"] * how["rows"]
    b = np.frombuffer(data[: 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(-1, 3).astype(np.uint32)
    return xyz24(b[:, 0] << 16 | b[:, 1] << 8 | b[:, 2]).astype(how.get("order", "<") + "f4").tobytes()


def encode_sgilog24(data: bytes, how: dict) -> bytes:
    codes = codes24(np.frombuffer(data, how.get("order", "<") + "f4").reshape(-1, 3))
    return codes.astype(">u4").view(np.uint8).reshape(-1, 4)[:, 1:].tobytes()


def decode_sgilog(data: bytes, how: dict) -> bytes:
    """Float samples of rows: Y for luminance, X, Y and Z for colour (in the byte order of `order`)."""
    width, rows = how["width"], how["rows"]
    colour, out, at = how.get("photometric") == LOGLUV, [], 0
    for _ in range(rows):
        codes, took = decode_planes(data[at:] if len(data) < 1 << 16 else data[at : at + width * 8 + 1024], width, 4 if colour else 2)
        at += took
        out.append(xyz32(codes) if colour else luminance16(codes))
    return np.concatenate(out).astype(how.get("order", "<") + "f4").tobytes() if out else b""


def encode_sgilog(data: bytes, how: dict) -> bytes:
    colour = how.get("photometric") == LOGLUV
    x = np.frombuffer(data, how.get("order", "<") + "f4").reshape(-1, how["width"], 3 if colour else 1)
    return b"".join(encode_planes(codes32(r) if colour else codes16(r[:, 0]), 4 if colour else 2) for r in x)


def film_scale() -> np.ndarray:
    """Linear light of each 11-bit code, 1.0 at white."""
    step = np.exp(1 - WHITE / STEPS) / STEPS
    i = np.arange(CODES)
    return np.where(i < STEPS, i * step, np.exp((i - WHITE) / STEPS))


def film_samples(codes: np.ndarray, kind: str) -> np.ndarray:
    """Codes as u1, u2 or f4 samples."""
    scale = film_scale()
    if kind == "f4":
        return scale.astype(np.float32)[codes]
    top = 255 if kind == "u1" else 65535
    return np.minimum(np.floor(scale * top + 0.5), top).astype(kind)[codes]


def film_codes(samples: np.ndarray) -> np.ndarray:
    """The code nearest to each sample, by ratio."""
    scale = film_scale()
    top = {"u1": 255.0, "u2": 65535.0}.get(f"{samples.dtype.kind}{samples.dtype.itemsize}", 1.0)
    v = np.maximum(samples.astype(float) / top, 0)
    return np.searchsorted(scale[:-1] * scale[1:], v * v).astype(np.uint16)


def _film_kind(how: dict) -> str:
    kind = {8: "u1", 16: "u2", 32: "f4"}.get(how.get("bits", 8))
    if kind is None:
        raise LogError("film logarithms hold samples of 8, 16 or 32 bits")
    return kind


def decode_film(data: bytes, how: dict) -> bytes:
    """Deflated 16-bit words, each a difference modulo 2048 to the sample of the pixel before, by row."""
    order, per = how.get("order", "<"), how.get("samples", 1)
    raw = zlib.decompressobj().decompress(data, how["rows"] * how["width"] * per * 2)
    words = np.frombuffer(raw[: len(raw) // 2 * 2], order + "u2")
    full = np.zeros(how["rows"] * how["width"] * per, np.uint16)
    full[: len(words)] = words
    codes = np.cumsum(full.reshape(how["rows"], how["width"], per), axis=1, dtype=np.uint32) & (CODES - 1)
    kind = _film_kind(how)
    return film_samples(codes, kind).astype(kind if kind == "u1" else order + kind).tobytes()


def encode_film(data: bytes, how: dict) -> bytes:
    order, kind, per = how.get("order", "<"), _film_kind(how), how.get("samples", 1)
    x = film_codes(np.frombuffer(data, kind if kind == "u1" else order + kind)).reshape(-1, how["width"], per).astype(np.int32)
    x[:, 1:] -= x[:, :-1].copy()
    return zlib.compress((x & (CODES - 1)).astype(order + "u2").tobytes(), how.get("level", 6))
