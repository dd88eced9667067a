"""Pages as PDF and PostScript, and as text for people; raw facsimile data as pages."""

from __future__ import annotations

import base64
import json
import zlib

import numpy as np
from pyspark.sql import DataFrame

from mosaiq.sources import codecs, container, fax, logs, raster

#: Photometric interpretations.
WHITE_IS_ZERO, BLACK_IS_ZERO, RGB, PALETTE, MASK, SEPARATED, YCBCR, CIELAB = 0, 1, 2, 3, 4, 5, 6, 8


def colors(r: container.Raster, d: container.Directory) -> np.ndarray:
    """A page as 8-bit grey (rows, columns, 1) or RGB (rows, columns, 3), first row on top."""
    x, kind, bits = container.decode_page(r, d), d.get("photometric", BLACK_IS_ZERO), d.get("bits")
    if kind in (logs.LOGL, logs.LOGLUV):
        if kind == logs.LOGL:
            return np.clip(256 * np.sqrt(np.maximum(x[:, :, :1], 0)), 0, 255).astype(np.uint8)
        rows = np.array([(2.690, -1.276, -0.414), (-1.022, 1.978, 0.044), (0.061, -0.224, 1.163)])
        return np.clip(256 * np.sqrt(np.maximum(x @ rows.T, 0)), 0, 255).astype(np.uint8)
    if kind == PALETTE:
        table = np.array(d.many("color_map"), np.int64).reshape(3, -1)
        table = table >> 8 if table.size and table.max() >= 256 else table
        return table[:, np.minimum(x[:, :, 0], table.shape[1] - 1)].transpose(1, 2, 0).astype(np.uint8)
    if x.dtype.kind != "u" or bits > 16:
        raise container.FormatError("samples must be unsigned and of 16 bits at most")
    top = (1 << bits) - 1
    x = (x.astype(np.int64) + 128) // 257 if bits == 16 else x.astype(np.int64) * 255 // top
    if kind == SEPARATED and x.shape[2] >= 4:
        x = (255 - x[:, :, 3:4]) * (255 - x[:, :, :3]) // 255
    elif kind == YCBCR and x.shape[2] >= 3:
        y, cb, cr = (x[:, :, i].astype(float) for i in range(3))
        x = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=-1)
    elif kind in (WHITE_IS_ZERO, BLACK_IS_ZERO, MASK):
        x = 255 - x[:, :, :1] if kind == WHITE_IS_ZERO else x[:, :, :1]
    elif kind != RGB:
        raise container.FormatError(f"photometric interpretation {kind} can't be drawn")
    return np.clip(np.round(x[:, :, :3]), 0, 255).astype(np.uint8)


def alpha(r: container.Raster, d: container.Directory) -> tuple[np.ndarray | None, bool]:
    """A page's 8-bit alpha samples, if it has any, and whether colours aren't multiplied by them yet."""
    kinds, n = d.many("extra_samples"), d.get("samples")
    if not kinds or kinds[0] not in (1, 2) or d.get("photometric") not in (WHITE_IS_ZERO, BLACK_IS_ZERO, RGB):
        return None, False
    x, bits = container.decode_page(r, d)[:, :, n - len(kinds)].astype(np.int64), d.get("bits")
    return (x + 128) // 257 if bits == 16 else x * 255 // ((1 << bits) - 1), kinds[0] == 2


def upright(x: np.ndarray, orientation: int) -> np.ndarray:
    """Rows and columns of a page as it is to be seen: the first row on top, the first column left."""
    if orientation >= 5:
        x = x.swapaxes(0, 1)
    turned = {2: (False, True), 3: (True, True), 4: (True, False), 6: (False, True), 7: (True, True), 8: (True, False)}.get(orientation, (False, False))
    return x[:: -1 if turned[0] else 1, :: -1 if turned[1] else 1]


def rgba_page(r: container.Raster, d: container.Directory, origin: str = "top") -> np.ndarray:
    """Packed pixels of a page, red in the lowest byte, alpha in the highest; colours are multiplied by alpha."""
    x = colors(r, d).astype(np.int64)
    x = np.repeat(x, 3, axis=2) if x.shape[2] == 1 else x
    a, loose = alpha(r, d)
    if a is not None and loose:
        x = (x * a[:, :, None] + 127) // 255
    packed = x[:, :, 0] + (x[:, :, 1] << 8) + (x[:, :, 2] << 16) + ((255 if a is None else a) << 24)
    out = upright(packed, d.get("orientation"))
    return out[::-1] if origin == "bottom" else out


def rgba(files: DataFrame, pages: list[int] | None = None, origin: str = "top") -> DataFrame:
    """(path, dir_index, y, abgr): rows of packed pixels of any photometric kind; what can't be drawn has one row with `error`."""

    def rows(path, content):
        try:
            r = container.parse(content)
        except container.FormatError as e:
            yield path, None, None, None, str(e)
            return
        for d in r.directories:
            if d.kind == "main" and (pages is None or d.index in pages):
                try:
                    image = rgba_page(r, d, origin)
                except ValueError as e:
                    yield path, d.index, None, None, str(e)
                    continue
                for y, line in enumerate(image.tolist()):
                    yield path, d.index, y, line, None

    return raster._table(files, "path string, dir_index int, y long, abgr array<long>, error string", rows)


def page_points(d: container.Directory, w: int, h: int) -> tuple[float, float]:
    """Size in points: by the resolution tags (inches or centimetres), or 72 samples an inch."""
    unit = {2: 72.0, 3: 72 / 2.54}.get(d.get("resolution_unit"), 72.0)
    out = []
    for n, tag in ((w, "x_resolution"), (h, "y_resolution")):
        v = d.get(tag)
        per = v[0] / v[1] if isinstance(v, tuple) and v[1] else 0
        out.append(n * unit / per if per > 0 else float(n))
    return out[0], out[1]


def _pages(content: bytes) -> list[tuple[np.ndarray, float, float]]:
    r, out = container.parse(content), []
    for d in (x for x in r.directories if x.kind == "main"):
        x = colors(r, d)
        out.append((x, *page_points(d, x.shape[1], x.shape[0])))
    return out


def pdf(content: bytes) -> bytes:
    """A PDF 1.4 with a page for each page of the file; samples are deflated."""
    pages = _pages(content)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Count {len(pages)} /Kids [{' '.join(f'{3 + 3 * i} 0 R' for i in range(len(pages)))}] >>".encode()]
    for i, (x, w, h) in enumerate(pages):
        n, packed = 3 + 3 * i, zlib.compress(x.tobytes())
        draw = f"q {w:.3f} 0 0 {h:.3f} 0 0 cm /Im Do Q".encode()
        objects += [
            f"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {w:.3f} {h:.3f}] /Contents {n + 1} 0 R /Resources << /XObject << /Im {n + 2} 0 R >> >> >>".encode(),
            f"<< /Length {len(draw)} >>\nstream\n".encode() + draw + b"\nendstream",
            f"<< /Type /XObject /Subtype /Image /Width {x.shape[1]} /Height {x.shape[0]} /ColorSpace /Device{'RGB' if x.shape[2] == 3 else 'Gray'} /BitsPerComponent 8 /Filter /FlateDecode /Length {len(packed)} >>\nstream\n".encode() + packed + b"\nendstream",
        ]
    out, places = bytearray(b"%PDF-1.4\n%\xe2\xe3\xcf\xd3\n"), []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += f"{i} 0 obj\n".encode() + body + b"\nendobj\n"
    start = len(out)
    out += f"xref\n0 {len(objects) + 1}\n0000000000 65535 f \n".encode() + b"".join(f"{p:010d} 00000 n \n".encode() for p in places)
    return bytes(out + f"trailer\n<< /Size {len(objects) + 1} /Root 1 0 R >>\nstartxref\n{start}\n%%EOF\n".encode())


def postscript(content: bytes, level: int = 2, encapsulated: bool = False) -> bytes:
    """PostScript of all pages, or of the first as EPS. Level 1: hexadecimal samples; 2: ASCII85; 3: deflated too."""
    pages = _pages(content)[: 1 if encapsulated else None]
    w, h = (max((p[i] for p in pages), default=0.0) for i in (1, 2))
    head = f"%!PS-Adobe-3.0{' EPSF-3.0' if encapsulated else ''}\n%%BoundingBox: 0 0 {int(-(-w // 1))} {int(-(-h // 1))}\n%%LanguageLevel: {level}\n%%Pages: {len(pages)}\n%%EndComments\n"
    out = bytearray(head.encode())
    for i, (x, pw, ph) in enumerate(pages, 1):
        rows, cols, n = x.shape
        out += f"%%Page: {i} {i}\ngsave\n{pw:.3f} {ph:.3f} scale\n".encode()
        matrix = f"[{cols} 0 0 {-rows} 0 {rows}]"
        if level == 1:
            out += f"/line {cols * n} string def\n{cols} {rows} 8 {matrix}\n{{currentfile line readhexstring pop}} {'false 3 colorimage' if n == 3 else 'image'}\n".encode()
            digits = x.tobytes().hex()
            out += "\n".join(digits[k : k + 72] for k in range(0, len(digits), 72)).encode() + b"\n"
        else:
            filters = "currentfile /ASCII85Decode filter" + (" /FlateDecode filter" if level > 2 else "")
            out += f"/Device{'RGB' if n == 3 else 'Gray'} setcolorspace\n<< /ImageType 1 /Width {cols} /Height {rows} /BitsPerComponent 8 /Decode [{'0 1 ' * n}] /ImageMatrix {matrix} /DataSource {filters} >> image\n".encode()
            raw = x.tobytes()
            out += base64.a85encode(zlib.compress(raw) if level > 2 else raw, wrapcol=72) + b"~>\n"
        out += b"grestore\nshowpage\n"
    return bytes(out + b"%%EOF\n")


def info(content: bytes) -> str:
    """The directories and their tags as text."""
    r = container.parse(content)
    lines = [f"{'big' if r.big else 'classic'} file, {'little' if r.order == '<' else 'big'}-endian, {len(r.directories)} directories"]
    for d in r.directories:
        lines.append(f"directory {d.index} at {d.offset} ({d.kind})")
        for tag, (typ, count, value) in sorted(d.tags.items()):
            shown = value.hex() if isinstance(value, bytes) else json.dumps(value)
            lines.append(f"  {container.tag_name(tag)} ({tag}) {container.TYPES[typ][0]}[{count}] {shown if len(shown) <= 200 else shown[:200] + '...'}")
    return "\n".join([*lines, *(f"warning: {w}" for w in r.warnings)])


def to_pdf(files: DataFrame) -> DataFrame:
    return raster._table(files, raster.FILES, lambda path, content: [(path.rsplit(".", 1)[0] + ".pdf", pdf(content))])


def to_postscript(files: DataFrame, level: int = 2, encapsulated: bool = False) -> DataFrame:
    ending = ".eps" if encapsulated else ".ps"
    return raster._table(files, raster.FILES, lambda path, content: [(path.rsplit(".", 1)[0] + ending, postscript(content, level, encapsulated))])


def describe(files: DataFrame) -> DataFrame:
    """(path, info): a file that can't be read has the reason."""

    def rows(path, content):
        try:
            yield path, info(content)
        except container.FormatError as e:
            yield path, f"error: {e}"

    return raster._table(files, "path string, info string", rows)


def import_fax(files: DataFrame, width: int = 1728, kind: str = "g3", two: bool = False, to: int = codecs.CCITT_G4) -> DataFrame:
    """Raw facsimile streams as files of one bilevel page with all rows of the stream."""

    def made(path, content):
        raw = fax.decode(content, width, None, kind, two)
        x = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, (width + 7) // 8), axis=1)[:, :width]
        yield path.rsplit(".", 1)[0] + ".tif", container.encode_pages([x], compression=to, bits=1, photometric=WHITE_IS_ZERO)

    return raster._table(files, raster.FILES, made)
