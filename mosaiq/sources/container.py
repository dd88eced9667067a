"""The container: header, chained directories of typed tags, chunk layout. Bytes in, plain values out."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from mosaiq.sources import codecs, logs, oldjpeg

#: On-disk tag types: number -> (name, bytes, struct code).
TYPES = {
    1: ("byte", 1, "B"), 2: ("ascii", 1, "s"), 3: ("short", 2, "H"), 4: ("long", 4, "I"), 5: ("rational", 8, "II"), 6: ("sbyte", 1, "b"),
    7: ("undefined", 1, "s"), 8: ("sshort", 2, "h"), 9: ("slong", 4, "i"), 10: ("srational", 8, "ii"), 11: ("float", 4, "f"), 12: ("double", 8, "d"),
    13: ("ifd", 4, "I"), 16: ("long8", 8, "Q"), 17: ("slong8", 8, "q"), 18: ("ifd8", 8, "Q"),
}

#: Tag numbers of the well-known fields.
TAGS = {
    254: "subfile_type", 255: "old_subfile_type", 256: "width", 257: "length", 258: "bits", 259: "compression", 262: "photometric", 263: "threshholding",
    264: "cell_width", 265: "cell_length", 266: "fill_order", 269: "document_name", 270: "description", 271: "make", 272: "model", 273: "strip_offsets",
    274: "orientation", 277: "samples", 278: "rows_per_strip", 279: "strip_bytecounts", 280: "min_sample", 281: "max_sample", 282: "x_resolution",
    283: "y_resolution", 284: "planar", 285: "page_name", 286: "x_position", 287: "y_position", 290: "gray_unit", 291: "gray_curve", 292: "g3_options",
    293: "g4_options", 296: "resolution_unit", 297: "page_number", 301: "transfer_function", 305: "software", 306: "date_time", 315: "artist",
    316: "host_computer", 317: "predictor", 318: "white_point", 319: "primaries", 320: "color_map", 321: "halftone_hints", 322: "tile_width",
    323: "tile_length", 324: "tile_offsets", 325: "tile_bytecounts", 330: "sub_ifds", 332: "ink_set", 333: "ink_names", 334: "number_of_inks",
    336: "dot_range", 337: "target_printer", 338: "extra_samples", 339: "sample_format", 340: "s_min_sample", 341: "s_max_sample", 347: "jpeg_tables",
    529: "ycbcr_coefficients", 530: "ycbcr_subsampling", 531: "ycbcr_positioning", 532: "reference_black_white", 700: "xml_packet", 32997: "depth",
    32998: "tile_depth", 33432: "copyright", 33723: "iptc", 34377: "photoshop", 34665: "exif_ifd", 34675: "icc_profile", 34853: "gps_ifd",
}
NUMBER = {v: k for k, v in TAGS.items()}
#: What a missing tag means.
DEFAULTS = {"bits": 1, "compression": 1, "samples": 1, "planar": 1, "orientation": 1, "fill_order": 1, "predictor": 1, "sample_format": 1, "subfile_type": 0, "resolution_unit": 2, "threshholding": 1, "depth": 1, "tile_depth": 1}
MAX_DIRECTORIES = 1 << 20
CHILDREN = {330: "sub", 34665: "exif", 34853: "gps"}
_registered: dict[int, str] = {}


def register_tag(number: int, name: str) -> None:
    """Name a private tag."""
    _registered[number] = name


#: Tag numbers of camera and of position directories.
EXIF_TAGS = {
    33434: "exposure_time", 33437: "f_number", 34850: "exposure_program", 34852: "spectral_sensitivity", 34855: "iso_speed_ratings", 34864: "sensitivity_type",
    36864: "exif_version", 36867: "date_time_original", 36868: "date_time_digitized", 36880: "offset_time", 37121: "components_configuration",
    37122: "compressed_bits_per_pixel", 37377: "shutter_speed_value", 37378: "aperture_value", 37379: "brightness_value", 37380: "exposure_bias_value",
    37381: "max_aperture_value", 37382: "subject_distance", 37383: "metering_mode", 37384: "light_source", 37385: "flash", 37386: "focal_length",
    37396: "subject_area", 37500: "maker_note", 37510: "user_comment", 37520: "sub_sec_time", 37521: "sub_sec_time_original", 37522: "sub_sec_time_digitized",
    40960: "flashpix_version", 40961: "color_space", 40962: "pixel_x_dimension", 40963: "pixel_y_dimension", 40964: "related_sound_file", 41483: "flash_energy",
    41486: "focal_plane_x_resolution", 41487: "focal_plane_y_resolution", 41488: "focal_plane_resolution_unit", 41492: "subject_location", 41493: "exposure_index",
    41495: "sensing_method", 41728: "file_source", 41729: "scene_type", 41985: "custom_rendered", 41986: "exposure_mode", 41987: "white_balance",
    41988: "digital_zoom_ratio", 41989: "focal_length_in_35mm_film", 41990: "scene_capture_type", 41991: "gain_control", 41992: "contrast", 41993: "saturation",
    41994: "sharpness", 41996: "subject_distance_range", 42016: "image_unique_id", 42032: "camera_owner_name", 42033: "body_serial_number",
    42034: "lens_specification", 42035: "lens_make", 42036: "lens_model", 42037: "lens_serial_number",
}
GPS_TAGS = {
    0: "gps_version_id", 1: "gps_latitude_ref", 2: "gps_latitude", 3: "gps_longitude_ref", 4: "gps_longitude", 5: "gps_altitude_ref", 6: "gps_altitude",
    7: "gps_time_stamp", 8: "gps_satellites", 9: "gps_status", 10: "gps_measure_mode", 11: "gps_dop", 12: "gps_speed_ref", 13: "gps_speed", 14: "gps_track_ref",
    15: "gps_track", 16: "gps_img_direction_ref", 17: "gps_img_direction", 18: "gps_map_datum", 29: "gps_date_stamp", 30: "gps_differential",
}


def tag_name(number: int, kind: str = "main") -> str:
    """Name of a tag in a directory of a kind: camera and position directories number theirs for themselves."""
    own = {"exif": EXIF_TAGS, "gps": GPS_TAGS}.get(kind, {})
    return own.get(number) or _registered.get(number) or TAGS.get(number) or f"tag_{number}"


class FormatError(ValueError):
    pass


@dataclass
class Directory:
    offset: int
    index: int
    kind: str = "main"
    parent: int | None = None
    tags: dict[int, tuple[int, int, object]] = field(default_factory=dict)

    def get(self, name: str, default=None):
        """Value of a well-known tag, or what it means where it is missing; one value where all are equal scalars."""
        found = self.tags.get(NUMBER[name])
        if found is None:
            return DEFAULTS.get(name, default)
        v = found[2]
        return v[0] if isinstance(v, list) and (len(v) == 1 or name in ("bits", "sample_format")) and v else v

    def many(self, name: str) -> list:
        v = (self.tags.get(NUMBER[name]) or (0, 0, []))[2]
        return v if isinstance(v, (list, Deferred)) else [v]


@dataclass
class Raster:
    data: bytes
    order: str
    big: bool
    first: int
    directories: list[Directory]
    warnings: list[str]


def _take(code: str, data: bytes, at: int) -> tuple:
    """Values at a place; by slice, which a ranged.Ranged knows too."""
    return struct.unpack(code, data[at : at + struct.calcsize(code)])


def _value(data: bytes, order: str, kind: int, count: int, at: int, limit: int):
    name, size, code = TYPES[kind]
    if count * size > limit or at + count * size > len(data):
        raise FormatError("tag data beyond the file or the allocation limit")
    raw = data[at : at + count * size]
    if name == "ascii":
        return raw.rstrip(b"\0").decode("latin-1")
    if name == "undefined":
        return raw
    flat = list(struct.unpack(f"{order}{count * len(code)}{code[0]}", raw))
    return [tuple(flat[i : i + 2]) for i in range(0, len(flat), 2)] if len(code) == 2 else flat


class Deferred:
    """Values of a large array tag, read from the file one by one or by slice when they are asked for."""

    def __init__(self, data: bytes, order: str, kind: int, count: int, at: int):
        if at + count * TYPES[kind][1] > len(data):
            raise FormatError("tag data beyond the file")
        self.data, self.code, self.size, self.count, self.at = data, order + TYPES[kind][2], TYPES[kind][1], count, at

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, i):
        if isinstance(i, slice):
            return [self[k] for k in range(*i.indices(self.count))]
        if not -self.count <= i < self.count:
            raise IndexError(i)
        return _take(self.code, self.data, self.at + i % self.count * self.size)[0]


def parse(data: bytes, max_alloc: int = 1 << 28, strict: bool = False, at: int | None = None, defer: bool = False) -> Raster:
    """Header and all directories: the main chain, then sub-directories. Loops and beyond-limit values end in warnings.

    data: bytes, or a ranged.Ranged. at: begin with the directory at this offset in place of the first. defer: chunk offsets and byte counts stay in the
    file until they are asked for (chunk_at reads those of one chunk).
    """
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise FormatError("not a tagged raster")
    magic = struct.unpack(order + "H", data[2:4])[0]
    if magic not in (42, 43):
        raise FormatError("not a tagged raster")
    big = magic == 43
    first = struct.unpack(order + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0] if at is None else at
    out, warnings, seen = [], [], set()

    def one(at: int, index: int, kind: str, parent: int | None) -> tuple[Directory | None, int]:
        if at in seen or at == 0 or len(seen) >= MAX_DIRECTORIES:
            if at in seen:
                warnings.append(f"directory loop at {at}")
            return None, 0
        seen.add(at)
        head, each, code, inline = (8, 20, "HHQ", 8) if big else (2, 12, "HHI", 4)
        if at + head > len(data):
            warnings.append(f"directory at {at} is beyond the file")
            return None, 0
        n = _take(order + ("Q" if big else "H"), data, at)[0]
        end = at + head + n * each
        if end > len(data):
            warnings.append(f"directory at {at} is cut off")
            return None, 0
        d = Directory(at, index, kind, parent)
        for i in range(n):
            pos = at + head + i * each
            tag, typ, count = _take(order + code, data, pos)
            if typ not in TYPES:
                warnings.append(f"tag {tag}: unknown type {typ}")
                continue
            size, place = TYPES[typ][1] * count, pos + each - inline
            if size > inline:
                place = _take(order + ("Q" if big else "I"), data, place)[0]
            try:
                late = defer and tag in (273, 279, 324, 325) and size > inline and len(TYPES[typ][2]) == 1
                d.tags.setdefault(tag, (typ, count, Deferred(data, order, typ, count, place) if late else _value(data, order, typ, count, place, max_alloc)))
            except FormatError as e:
                if strict:
                    raise
                warnings.append(f"tag {tag}: {e}")
        nxt = _take(order + ("Q" if big else "I"), data, end)[0] if end + inline <= len(data) else 0
        return d, nxt

    at, index = first, 0
    while at:
        d, at = one(at, index, "main", None)
        if d is None:
            break
        out.append(d)
        index += 1
    todo = [(d, t) for d in out for t in CHILDREN]
    while todo:
        d, tag = todo.pop(0)
        for child in (d.tags.get(tag) or (0, 0, []))[2] or []:
            sub, nxt = one(int(child), len(out), CHILDREN[tag], d.offset)
            while sub is not None:
                out.append(sub)
                todo += [(sub, t) for t in CHILDREN]
                sub, nxt = one(nxt, len(out), CHILDREN[tag], d.offset) if nxt and tag == 330 else (None, 0)
    if strict and warnings:
        raise FormatError("; ".join(warnings))
    return Raster(data, order, big, first, out, warnings)


@dataclass
class Chunk:
    plane: int
    number: int
    x0: int
    y0: int
    w: int
    h: int
    offset: int
    bytecount: int


def layout(d: Directory) -> list[Chunk]:
    """The strips or tiles of a directory, edge strips cut to the raster; tiles keep their full size."""
    w, h, samples = d.get("width", 0), d.get("length", 0), d.get("samples")
    planes = samples if d.get("planar") == 2 else 1
    tiled = NUMBER["tile_width"] in d.tags
    offsets, counts = (d.many("tile_offsets"), d.many("tile_bytecounts")) if tiled else (d.many("strip_offsets"), d.many("strip_bytecounts"))
    tw, th = (d.get("tile_width"), d.get("tile_length")) if tiled else (w, min(d.get("rows_per_strip", h) or h, h) or 1)
    if not w or not h or not tw or not th:
        return []
    across, down, out = -(-w // tw), -(-h // th), []
    for i, at in enumerate(offsets[: across * down * planes]):
        plane, k = divmod(i, across * down)
        ty, tx = divmod(k, across)
        size = counts[i] if i < len(counts) else 0
        if not size:  # estimated: up to the next chunk
            later = [o for o in offsets if o > at]
            size = min(later) - at if later else 0
        out.append(Chunk(plane, i, tx * tw, ty * th, tw, th if tiled else min(th, h - ty * th), at, size))
    return out


def _grid(d: Directory) -> tuple[int, int, int, int]:
    """Columns and rows of a chunk, and chunks across and down; zeros where there are none."""
    w, h, tiled = d.get("width", 0), d.get("length", 0), NUMBER["tile_width"] in d.tags
    tw, th = (d.get("tile_width"), d.get("tile_length")) if tiled else (w, min(d.get("rows_per_strip", h) or h, h) or 1)
    return (tw, th, -(-w // tw), -(-h // th)) if w and h and tw and th else (0, 0, 0, 0)


def chunk_count(d: Directory) -> int:
    """As many as layout gives, without reading deferred arrays."""
    _, _, across, down = _grid(d)
    offsets = d.many("tile_offsets") if NUMBER["tile_width"] in d.tags else d.many("strip_offsets")
    return min(len(offsets), across * down * (d.get("samples") if d.get("planar") == 2 else 1))


def chunk_at(d: Directory, number: int) -> Chunk:
    """One chunk of a directory, by its number; of deferred arrays, only its own two values are read, unless the file doesn't tell its size."""
    h, tiled = d.get("length", 0), NUMBER["tile_width"] in d.tags
    offsets, counts = (d.many("tile_offsets"), d.many("tile_bytecounts")) if tiled else (d.many("strip_offsets"), d.many("strip_bytecounts"))
    tw, th, across, down = _grid(d)
    plane, k = divmod(number, across * down)
    ty, tx = divmod(k, across)
    at, size = offsets[number], counts[number] if number < len(counts) else 0
    if not size:
        size = min((o for o in offsets if o > at), default=at) - at
    return Chunk(plane, number, tx * tw, ty * th, tw, th if tiled else min(th, h - ty * th), at, size)


DTYPES = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (1, 64): "u8", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (2, 64): "i8", (3, 16): "f2", (3, 32): "f4", (3, 64): "f8"}


def _thinned(d: Directory) -> tuple[int, int] | None:
    """Columns and rows that share a chroma sample in chunks that are no JPEG; None where each pixel has its own."""
    if d.get("photometric") != 6 or d.get("planar") == 2 or d.get("samples") != 3 or d.get("bits") != 8 or d.get("compression") in (codecs.JPEG, codecs.JPEG_OLD):
        return None
    by = tuple(d.many("ycbcr_subsampling")) or (2, 2)
    if len(by) != 2 or not {*by} <= {1, 2, 4}:
        raise FormatError("chroma is thinned by 1, 2 or 4")
    return None if by == (1, 1) else by


def _spread(units: np.ndarray, h: int, w: int, u: int, v: int) -> np.ndarray:
    """(rows, columns, 3) of units, each pixel with the chroma of its block."""
    blocks = units.reshape(-(-h // v), -(-w // u), u * v + 2)
    light = blocks[:, :, : u * v].reshape(*blocks.shape[:2], v, u).transpose(0, 2, 1, 3).reshape(blocks.shape[0] * v, -1)
    chroma = blocks[:, :, u * v :].repeat(v, axis=0).repeat(u, axis=1)
    return np.dstack([light, chroma])[:h, :w]


def _units(x: np.ndarray, u: int, v: int) -> np.ndarray:
    """The inverse, of rows of units; a block's chroma is the rounded mean, and pixels at the edges are repeated to fill it."""
    h, w = x.shape[:2]
    full = np.pad(x, ((0, -h % v), (0, -w % u), (0, 0)), mode="edge")
    cells = full.reshape(full.shape[0] // v, v, full.shape[1] // u, u, 3).transpose(0, 2, 1, 3, 4)
    mean = np.floor(cells[..., 1:].mean(axis=(2, 3)) + 0.5).astype(np.uint8)
    return np.concatenate([cells[..., 0].reshape(*cells.shape[:2], u * v), mean], axis=2).reshape(cells.shape[0], -1)


def decode_chunk(r: Raster, d: Directory, c: Chunk, max_alloc: int = 1 << 28) -> np.ndarray:
    """Samples of a chunk as (rows, columns, samples); bits under a byte are unpacked."""
    bits, per = d.get("bits"), 1 if d.get("planar") == 2 else d.get("samples")
    row = (c.w * per * bits + 7) // 8
    size = row * c.h
    if size > max_alloc:
        raise FormatError("chunk beyond the allocation limit")
    raw = r.data[c.offset : c.offset + c.bytecount] if c.bytecount else r.data[c.offset : c.offset + size]
    if d.get("fill_order") == 2:
        raw = codecs.reverse_bits(raw)
    scheme = d.get("compression")
    floats = scheme in (codecs.SGILOG, codecs.SGILOG24)
    if floats:  # the samples come out as floats, whatever the tags say
        bits, per = 32, 3 if d.get("photometric") == logs.LOGLUV or scheme == codecs.SGILOG24 else 1
        row = c.w * per * 4
        size = row * c.h
    how = {}
    if scheme == codecs.JPEG_OLD:
        raw, how["at"] = oldjpeg.chunk_stream(r.data, d.tags, raw, c.plane if d.get("planar") == 2 else None, (c.y0, c.x0, c.h, c.w), d.get("samples"), (d.get("length"), d.get("width")), d.get("photometric"))
    thin = _thinned(d)
    if thin:  # units of a block's luminance and its two chroma samples
        if d.get("predictor") != 1:
            raise FormatError("predictors of thinned chroma aren't supported")
        row = -(-c.w // thin[0]) * (thin[0] * thin[1] + 2)
        size = row * -(-c.h // thin[1])
    options = d.get("g3_options", 0) if scheme == codecs.CCITT_G3 else 0
    data = codecs.decode(scheme, raw, size=size, row=row, width=c.w, rows=c.h, samples=per, bits=bits, order=r.order, photometric=d.get("photometric"), options=options, tables=(d.tags.get(347) or (0, 0, None))[2], **how)[:size].ljust(size, b"\0")
    if thin:
        return _spread(np.frombuffer(data, np.uint8), c.h, c.w, *thin)
    if (kind := d.get("predictor")) != 1:
        data = codecs.undo_predictor(kind, data, row, bits, per, r.order)
    if bits < 8 or bits in (10, 12, 14):
        x = np.unpackbits(np.frombuffer(data, np.uint8).reshape(c.h, row), axis=1)[:, : c.w * per * bits].reshape(c.h, c.w, per, bits)
        return (x * (1 << np.arange(bits - 1, -1, -1))).sum(axis=3).astype(np.uint8 if bits < 8 else r.order + "u2")
    if (dt := "f4" if floats else DTYPES.get((d.get("sample_format"), bits)) or DTYPES.get((1, bits))) is None:
        raise FormatError(f"samples of {bits} bits aren't supported")
    return np.frombuffer(data, r.order + dt if bits > 8 else dt).reshape(c.h, c.w, per)


def decode_page(r: Raster, d: Directory) -> np.ndarray:
    """The whole raster of a directory, (length, width, samples)."""
    w, h, out = d.get("width"), d.get("length"), None
    for c in layout(d):
        x = decode_chunk(r, d, c)
        if out is None:
            out = np.zeros((h, w, d.get("samples")), x.dtype.newbyteorder("="))
        hh, ww = min(c.h, h - c.y0), min(c.w, w - c.x0)
        if d.get("planar") == 2:
            out[c.y0 : c.y0 + hh, c.x0 : c.x0 + ww, c.plane] = x[:hh, :ww, 0]
        else:
            out[c.y0 : c.y0 + hh, c.x0 : c.x0 + ww] = x[:hh, :ww]
    return np.zeros((h or 0, w or 0, d.get("samples")), np.uint8) if out is None else out


def packed(order: str, kind: int, values: list | str | bytes) -> tuple[int, bytes]:
    """Count and bytes of a tag's values."""
    if isinstance(values, str):
        return len(values) + 1, values.encode("latin-1") + b"\0"
    if isinstance(values, bytes):
        return len(values), values
    flat = [v for x in values for v in (x if isinstance(x, tuple) else (x,))]
    return len(values), struct.pack(f"{order}{len(flat)}{TYPES[kind][2][0]}", *flat)


def encode_pages(pages: list[np.ndarray], compression: int = 1, predictor: int = 1, tile: tuple[int, int] | None = None, rows: int | None = None, planar: bool = False, order: str = "<", big: bool = False, photometric: int | None = None, bits: int | None = None, extra: dict[int, tuple[int, list | str | bytes]] | None = None, subsampling: tuple[int, int] = (1, 1)) -> bytes:
    """A file of one directory for each page (rows, columns[, samples]). extra: more tags, number -> (type, values).

    bits 1, 2, 4, 10, 12 or 14 packs samples; subsampling (columns, rows) thins the chroma of 8-bit YCbCr
    (photometric 6) in chunks that are no JPEG. Strips of about 8 KiB unless `rows` or `tile` (width, length) say otherwise.
    """
    mark, word, inline = (b"II" if order == "<" else b"MM"), ("Q" if big else "I"), (8 if big else 4)
    out = bytearray(mark + struct.pack(order + "H", 43 if big else 42) + (struct.pack(order + "HHQ", 8, 0, 0) if big else struct.pack(order + "I", 0)))
    link = len(out) - inline
    for page in pages:
        x = page if page.ndim == 3 else page[:, :, None]
        h, w, n = x.shape
        size = bits or x.dtype.itemsize * 8
        fmt = {"u": 1, "i": 2, "f": 3}[x.dtype.kind]
        per = 1 if planar else n
        tw, th = tile or (w, rows or max(1, min(h, 8192 // max(1, (w * per * size + 7) // 8))))
        thin = photometric == 6 and subsampling != (1, 1)
        if thin and not tile and not rows:
            th = -(-th // subsampling[1]) * subsampling[1]
        if thin and (n != 3 or size != 8 or planar or predictor != 1 or compression == codecs.JPEG or th % subsampling[1] and th < h or tile and tw % subsampling[0]):
            raise FormatError("thinned chroma needs interleaved 8-bit YCbCr, no predictor and chunks of whole blocks")
        offsets, counts = [], []
        for plane in range(n if planar else 1):
            part = x[:, :, plane : plane + 1] if planar else x
            for y in range(0, h, th):
                for xx in range(0, w, tw):
                    block = part[y : y + th, xx : xx + tw]
                    if tile:
                        block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1]), (0, 0)), mode="edge")
                    row = (block.shape[1] * per * size + 7) // 8
                    if size < 8 or size in (10, 12, 14):
                        b = (block[..., None] >> np.arange(size - 1, -1, -1, dtype=block.dtype)) & 1
                        data = np.packbits(b.reshape(block.shape[0], -1).astype(np.uint8), axis=1).tobytes()
                    else:
                        data = block.astype(block.dtype.newbyteorder(order)).tobytes()
                    if thin:
                        units = _units(block, *subsampling)
                        data, row = units.tobytes(), units.shape[1]
                    if predictor != 1:
                        data = codecs.apply_predictor(predictor, data, row, size, per, order)
                    data = codecs.encode(compression, data, row=row, width=block.shape[1], rows=block.shape[0], samples=per, bits=size, order=order, photometric=photometric, options=((extra or {}).get(292) or (4, [0]))[1][0])
                    out += b"\0" * (len(out) % 2)
                    offsets.append(len(out))
                    counts.append(len(data))
                    out += data
        tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [size] * n), 259: (3, [compression]), 262: (3, [photometric if photometric is not None else (2 if n >= 3 else 1)]), 277: (3, [n]), 284: (3, [2 if planar else 1]), 339: (3, [fmt] * n)}
        if predictor != 1:
            tags[317] = (3, [predictor])
        if photometric == 6:
            tags[530] = (3, list(subsampling))
        where = 16 if big else 4
        tags |= {322: (4, [tw]), 323: (4, [th]), 324: (where, offsets), 325: (where, counts)} if tile else {273: (where, offsets), 278: (4, [th]), 279: (where, counts)}
        tags |= extra or {}
        body = []
        for tag, (typ, values) in sorted(tags.items()):
            count, raw = packed(order, typ, values)
            if len(raw) > inline:
                out += b"\0" * (len(out) % 2)
                at = len(out)
                out += raw
                raw = struct.pack(order + word, at)
            body.append(struct.pack(order + "HH" + word, tag, typ, count) + raw.ljust(inline, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + ("Q" if big else "H"), len(body)) + b"".join(body)
        link = len(out)
        out += b"\0" * inline
    return bytes(out)
