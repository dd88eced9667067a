"""The first form of JPEG chunks: a stream that spans the page, or bare scans whose tables stand elsewhere in the file.

A chunk becomes a stream of its own, so that chunks stay the unit of decoding; only a page in one stream is decoded whole.
"""

from __future__ import annotations

from mosaiq.sources import jpeg

#: Tags of the old form.
STREAM, STREAM_BYTES, RESTART, QUANT, DC, AC, SUBSAMPLING, YCBCR = 513, 514, 515, 519, 520, 521, 530, 6
#: Markers: tables and restart interval, frames, scan.
TABLES, FRAMES, SCAN = (0xDB, 0xC4, 0xDD), (0xC0, 0xC1, 0xC2), 0xDA


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def _numbers(tags: dict, tag: int) -> list[int]:
    v = (tags.get(tag) or (0, 0, []))[2]
    return list(v) if isinstance(v, (list, tuple)) else [v]


def _stated(data: bytes, tags: dict) -> bytes:
    """Segments of the tables that tags point to; component i has table i."""
    out = b""
    for i, at in enumerate(_numbers(tags, QUANT)):
        out += _segment(0xDB, bytes([i]) + data[at : at + 64])
    for kind, tag in enumerate((DC, AC)):
        for i, at in enumerate(_numbers(tags, tag)):
            out += _segment(0xC4, bytes([kind << 4 | i]) + data[at : at + 16 + sum(data[at : at + 16])])
    for every in _numbers(tags, RESTART)[:1]:
        out += _segment(0xDD, every.to_bytes(2, "big"))
    return out


def _found(stream: bytes) -> tuple[bytes, bytes | None, bytes | None, bytes]:
    """Tables, frame segment, scan header and entropy-coded part of a stream; b"" and None for what it lacks."""
    tables, frame, scan, part = b"", None, None, b""
    if stream[:2] == b"\xff\xd8":
        for marker, body, rest in jpeg._segments(stream):
            if marker in TABLES:
                tables += _segment(marker, body)
            elif marker in FRAMES:
                frame = _segment(marker, body)
            elif marker == SCAN and scan is None:
                scan, part = body, rest
    return tables, frame, scan, part


def chunk_stream(data: bytes, tags: dict, raw: bytes, plane: int | None, box: tuple[int, int, int, int], samples: int, whole: tuple[int, int], photometric: int) -> tuple[bytes, tuple[int, int]]:
    """A stream that holds a chunk, and where the chunk begins in it (row, column).

    raw: the chunk's bytes. plane: the component of a chunk that holds one. box: the chunk's row, column, rows and
    columns. whole: rows and columns of the page. A file that lacks tables, or a plane of thinned components, raises an error.
    """
    y0, x0, rows, columns = box
    at, size = (_numbers(tags, t)[:1] for t in (STREAM, STREAM_BYTES))
    head = data[at[0] : at[0] + size[0] if size and size[0] else None] if at else b""
    shared, frame, scan, part = _found(head)
    if frame and part and plane is None and int.from_bytes(frame[5:7], "big") >= whole[0]:
        return head, (y0, x0)
    own, own_frame, own_scan, own_part = _found(raw)
    if own_scan is not None:
        raw = own_part
    scan, frame = own_scan or scan, own_frame or frame
    ids = [frame[10 + 3 * i] for i in range(frame[9])] if frame else list(range(1, samples + 1))
    if frame is None:
        thin = _numbers(tags, SUBSAMPLING) or ([2, 2] if photometric == YCBCR else [1, 1])
        last = len(_numbers(tags, QUANT)) - 1
        parts = b"".join(bytes([c, thin[0] << 4 | thin[1] if not i and samples == 3 else 0x11, min(i, max(last, 0))]) for i, c in enumerate(ids))
        frame = _segment(0xC0, bytes([8, 0, 0, 0, 0, samples]) + parts)
    if scan is None:
        known = jpeg.Tables()
        for marker, body, _ in jpeg._segments(b"\xff\xd8" + _stated(data, tags) + shared + own):
            known.take(marker, body)
        ends = [max((k & 15 for k in known.huffman if k >> 4 == kind), default=0) for kind in (0, 1)]
        scan = bytes([len(ids)]) + b"".join(bytes([c, min(i, ends[0]) << 4 | min(i, ends[1])]) for i, c in enumerate(ids)) + bytes([0, 63, 0])
    if plane is not None:
        entry = frame[10 + 3 * plane : 13 + 3 * plane]
        if any(frame[11 + 3 * i] != frame[11] for i in range(frame[9])):
            raise jpeg.JpegError("planes of thinned components aren't supported")
        named = {scan[1 + 2 * i]: scan[2 + 2 * i] for i in range(scan[0])}
        frame = _segment(frame[1], frame[4:9] + b"\x01" + bytes([entry[0], 0x11, entry[2]]))
        scan = bytes([1, entry[0], named.get(entry[0], plane << 4 | plane), 0, 63, 0])
    frame = frame[:5] + rows.to_bytes(2, "big") + columns.to_bytes(2, "big") + frame[9:]
    end = b"" if raw[-2:] == b"\xff\xd9" else b"\xff\xd9"
    return b"\xff\xd8" + _stated(data, tags) + shared + own + frame + _segment(SCAN, scan) + raw + end, (0, 0)
