"""Raster files as tables: files, directories, tags, chunks, scanlines, pixels; and back to files.

Bytes come through Spark's own binary file reader, so any store that Spark reads will do. Each table is a narrow map
over files: metadata tables never decode a chunk, and a filter on directory or chunk number is applied before decoding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.sources import codecs, container

FILES = "path string, content binary"
DIRECTORIES = "path string, dir_index int, ifd_offset long, parent_offset long, kind string, byte_order string, is_big boolean, width long, length long, bits int, samples int, compression int, photometric int, planar int, orientation int, sample_format int, predictor int, rows_per_strip long, tile_width long, tile_length long, n_chunks long, warnings array<string>, error string"
TAGS = "path string, ifd_offset long, dir_index int, kind string, tag int, name string, type string, count long, value string"
CHUNKS = "path string, dir_index int, plane int, chunk int, x0 long, y0 long, w int, h int, offset long, bytecount long, raw binary"
SCANLINES = "path string, dir_index int, plane int, y long, x0 long, samples array<double>"


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path).select("path", "content")


def _table(files: DataFrame, schema: str, rows) -> DataFrame:
    """A map over files; rows(path, content) yields tuples in the order of the schema."""
    target = files.sparkSession.createDataFrame([], schema).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held, size = [], 0
                for row in rows(path, content or b""):
                    held.append(row)
                    size += sum(len(v) for v in row if isinstance(v, (bytes, list)))
                    if size > 4 << 20 or len(held) > 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)], schema=arrow)

    return files.select("path", "content").mapInArrow(work, schema)


def directory_rows(path: str, content: bytes, max_alloc: int = 1 << 28) -> Iterator[tuple]:
    try:
        r = container.parse(content, max_alloc)
    except container.FormatError as e:
        yield (path, *[None] * 21, str(e))
        return
    for d in r.directories:
        first = lambda n: (lambda v: int(v[0] if isinstance(v, (list, tuple)) else v) if v is not None and v != [] else None)(d.get(n))  # noqa: B023, E731
        yield (path, d.index, d.offset, d.parent, d.kind, r.order, r.big, *(first(n) for n in ("width", "length", "bits", "samples", "compression", "photometric", "planar", "orientation", "sample_format", "predictor", "rows_per_strip", "tile_width", "tile_length")), container.chunk_count(d), r.warnings, None)


def tag_rows(path: str, content: bytes, max_alloc: int = 1 << 28) -> Iterator[tuple]:
    try:
        r = container.parse(content, max_alloc)
    except container.FormatError:
        return
    for d in r.directories:
        for tag, (typ, count, value) in sorted(d.tags.items()):
            yield path, d.offset, d.index, d.kind, tag, container.tag_name(tag, d.kind), container.TYPES[typ][0], count, json.dumps(value.hex() if isinstance(value, bytes) else value)


def page_chunks(content: bytes, pages: list[int] | None, part: tuple[int, int]) -> Iterator[tuple[container.Raster, container.Directory, container.Chunk]]:
    """Chunks of a file's pages, in order; of part (k, n), the k-th of n equal ranges. A file that can't be read has none."""
    try:
        r = container.parse(content, defer=part[1] > 1)
    except container.FormatError:
        return
    main = [d for d in r.directories if d.kind == "main" and (pages is None or d.index in pages)]
    counts = [container.chunk_count(d) for d in main]
    low, high = (sum(counts) * (part[0] + i) // part[1] for i in (0, 1))
    for d, n in zip(main, counts, strict=True):
        if part[1] == 1:
            yield from ((r, d, c) for c in container.layout(d))
        else:
            yield from ((r, d, container.chunk_at(d, k)) for k in range(max(low, 0), min(high, n)))
        low, high = low - n, high - n


def chunk_rows(path: str, content: bytes, pages=None, raw: bool = True, part: tuple[int, int] = (0, 1)) -> Iterator[tuple]:
    for r, d, c in page_chunks(content, pages, part):
        yield path, d.index, c.plane, c.number, c.x0, c.y0, c.w, c.h, c.offset, c.bytecount, r.data[c.offset : c.offset + c.bytecount] if raw else None


def scanline_rows(path: str, content: bytes, pages=None, window: tuple[int, int, int, int] | None = None, part: tuple[int, int] = (0, 1)) -> Iterator[tuple]:
    for r, d, c in page_chunks(content, pages, part):
        w, h = d.get("width"), d.get("length")
        if window and (c.x0 > window[2] or c.y0 > window[3] or c.x0 + c.w <= window[0] or c.y0 + c.h <= window[1]):
            continue
        x = container.decode_chunk(r, d, c)
        for k in range(min(c.h, h - c.y0)):
            for s in range(x.shape[2]):
                yield path, d.index, c.plane if d.get("planar") == 2 else s, c.y0 + k, c.x0, x[k, : min(c.w, w - c.x0), s].astype(float).tolist()


def directories(files: DataFrame, max_alloc: int = 1 << 28) -> DataFrame:
    """A row per directory; a file that can't be read has one row with `error`."""
    return _table(files, DIRECTORIES, lambda path, content: directory_rows(path, content, max_alloc))


def tags(files: DataFrame, max_alloc: int = 1 << 28) -> DataFrame:
    """A row per tag; the value as JSON, bytes as hexadecimal digits."""
    return _table(files, TAGS, lambda path, content: tag_rows(path, content, max_alloc))


def chunks(files: DataFrame, pages: list[int] | None = None, raw: bool = True) -> DataFrame:
    """A row per strip or tile, with its encoded bytes unless raw is False."""
    return _table(files, CHUNKS, lambda path, content: chunk_rows(path, content, pages, raw))


def scanlines(files: DataFrame, pages: list[int] | None = None, window: tuple[int, int, int, int] | None = None) -> DataFrame:
    """Decoded rows of each chunk and sample plane. window (x0, y0, x1, y1): chunks outside it aren't decoded."""
    return _table(files, SCANLINES, lambda path, content: scanline_rows(path, content, pages, window))


def pixels(lines: DataFrame) -> DataFrame:
    """path, dir_index, plane, y, x, v of scanlines; native."""
    one = lines.select("path", "dir_index", "plane", "y", "x0", F.posexplode("samples").alias("i", "v"))
    return one.select("path", "dir_index", "plane", "y", (F.col("x0") + F.col("i")).alias("x"), "v")


def decode_buffer(df: DataFrame, column: str, compression: int, size: int) -> DataFrame:
    """df with `decoded`: a binary column decoded by a codec."""

    @F.pandas_udf("binary")
    def decoded(values):
        return values.map(lambda b: None if b is None else codecs.decode(compression, b, size=size, row=size, width=size))

    return df.withColumn("decoded", decoded(column))


def encode_rasters(pixel_rows: DataFrame, dtype: str = "u1", **how) -> DataFrame:
    """(path, content): a file for each path of pixels (path, dir_index, plane, y, x, v); one shuffle, on the path."""
    lines = pixel_rows.groupBy("path", "dir_index", "plane", "y").agg(F.transform(F.array_sort(F.collect_list(F.struct("x", "v"))), lambda p: p["v"].cast("double")).alias("samples"))

    def work(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        t = rows.sort_by([("dir_index", "ascending"), ("y", "ascending"), ("plane", "ascending")])
        pages: dict[int, dict[int, list]] = {}
        for page, y, samples in zip(*(t.column(c).to_pylist() for c in ("dir_index", "y", "samples")), strict=True):
            pages.setdefault(page, {}).setdefault(y, []).append(samples)
        made = [np.array([np.stack(planes, axis=-1) for _, planes in sorted(p.items())]).astype(dtype) for _, p in sorted(pages.items())]
        return pa.table({"path": pa.array([key[0].as_py()], pa.string()), "content": pa.array([container.encode_pages(made, **how)], pa.binary())})

    return lines.groupBy("path").applyInArrow(work, FILES)


def write_files(encoded: DataFrame, folder: str) -> int:
    """Write (path, content) rows as files under a folder, from the executors; the number written.

    Relative paths keep their folders; of absolute ones and of addresses, the last part is the name. A file is written
    under a temporary name and then moved, so a task that runs twice leaves one whole file. The sink `raster_files`
    shows no file before the whole job has succeeded.
    """
    placed = lambda path: path.rsplit("/", 1)[-1] if path.startswith("/") or ":/" in path or ".." in path.split("/") else path

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(base, recursive=True)
        n = 0
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = f"{base}/{placed(path)}"
                store.create_dir(name.rsplit("/", 1)[0], recursive=True)
                with store.open_output_stream(temp := f"{name}.{uuid.uuid4().hex}") as f:
                    f.write(content)
                store.move(temp, name)
                n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    return encoded.select("path", "content").mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def split_pages(files: DataFrame) -> DataFrame:
    """(path, content) of one file per page, named by three letters."""

    def rows(path, content):
        r = container.parse(content)
        for i, d in enumerate(x for x in r.directories if x.kind == "main"):
            name = "".join(chr(97 + i // k % 26) for k in (676, 26, 1))
            yield f"{path.rsplit('.', 1)[0]}-{name}.tif", container.encode_pages([container.decode_page(r, d)], compression=1, photometric=d.get("photometric"))

    return _table(files, FILES, rows)


def recode(files: DataFrame, **how) -> DataFrame:
    """(path, content) of the same pages, encoded anew: compression, chunks, planes, byte order, large offsets."""

    def rows(path, content):
        r = container.parse(content)
        main = [d for d in r.directories if d.kind == "main"]
        yield path, container.encode_pages([container.decode_page(r, d) for d in main], **({"photometric": main[0].get("photometric")} if main else {}) | how)

    return _table(files, FILES, rows)


def pnm(content: bytes) -> np.ndarray:
    """Samples of a P1 to P6 file, (rows, columns, samples)."""
    head, at = [], 0
    while len(head) < (3 if head and head[0] in (b"P1", b"P4") else 4):
        while content[at : at + 1].isspace() or content[at : at + 1] == b"#":
            at = content.index(b"\n", at) if content[at : at + 1] == b"#" else at + 1
        end = at
        while end < len(content) and not content[end : end + 1].isspace():
            end += 1
        head.append(content[at:end])
        at = end
    kind, w, h = head[0], int(head[1]), int(head[2])
    top, n = (int(head[3]) if len(head) > 3 else 1), 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = content[at:].split()
        if kind == b"P1":
            body = [bytes([c]) for x in body for c in x]
        return np.array(body[: w * h * n]).astype(np.uint16 if top > 255 else np.uint8).reshape(h, w, n)
    body = content[at + 1 :]
    if kind == b"P4":
        return np.unpackbits(np.frombuffer(body[: h * ((w + 7) // 8)], np.uint8).reshape(h, -1), axis=1)[:, :w, None]
    return np.frombuffer(body, ">u2" if top > 255 else "u1", w * h * n).reshape(h, w, n)


def import_pnm(files: DataFrame, **how) -> DataFrame:
    return _table(files, FILES, lambda path, content: [(path.rsplit(".", 1)[0] + ".tif", container.encode_pages([pnm(content)], **how))])


def import_raw(files: DataFrame, width: int, length: int, dtype: str = "u1", bands: int = 1, header: int = 0, interleaved: bool = True, **how) -> DataFrame:
    """Headerless rasters: skip `header` bytes, then samples of a numpy dtype (with byte order), by pixel or by band."""

    def rows(path, content):
        x = np.frombuffer(content, dtype, width * length * bands, header)
        x = x.reshape(length, width, bands) if interleaved else x.reshape(bands, length, width).transpose(1, 2, 0)
        yield path + ".tif", container.encode_pages([np.ascontiguousarray(x).astype(x.dtype.newbyteorder("="))], **how)

    return _table(files, FILES, rows)
