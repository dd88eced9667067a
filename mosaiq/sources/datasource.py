"""Spark data sources `raster` (tables of files) and `raster_files` (a sink of file bytes).

    spark.dataSource.register(RasterSource)
    spark.read.format("raster").option("path", folder).option("table", "scanlines").load().where("dir_index = 0")

Filters on path, dir_index and y reach the reader (with spark.sql.python.filterPushdown.enabled): files and pages
that can't match aren't decoded, nor are chunks outside the rows asked for. Files come through pyarrow's file systems;
for a store that only Spark reads, use raster.read_files.

Of a large file, directories and tags are read without the chunks, and chunks and scanlines by several tasks, each of
which reads its own range of chunks only.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from mosaiq.sources import container, ranged, raster

TABLES = {"directories": raster.DIRECTORIES, "tags": raster.TAGS, "chunks": raster.CHUNKS, "scanlines": raster.SCANLINES}
#: Bytes of files that one task reads; larger files are divided by their chunks.
TASK_BYTES = 128 << 20


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


@dataclass
class Files(InputPartition):
    names: list[str]
    part: tuple[int, int]

    def __init__(self, names: list[str], part: tuple[int, int] = (0, 1)):
        super().__init__(0)
        self.names, self.part = names, part


class RasterSource(DataSource):
    """Options: path; table, one of directories (the default), tags, chunks, scanlines; glob; mode, PERMISSIVE or FAILFAST; maxAlloc; taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "raster"

    def schema(self) -> str:
        table = self.options.get("table", "directories")
        if table not in TABLES:
            raise ValueError(f"no table {table}; there are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema: StructType) -> RasterReader:
        return RasterReader(dict(self.options))


class RasterReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.glob = options["path"], options.get("glob", "*")
        self.table, self.strict = options.get("table", "directories"), options.get("mode", "PERMISSIVE").upper() == "FAILFAST"
        self.max_alloc = int(options.get("maxalloc", options.get("maxAlloc", 1 << 28)))
        self.task_bytes = int(options.get("taskbytes", options.get("taskBytes", TASK_BYTES)))
        self.only: dict[str, set] = {}
        self.low: dict[str, int] = {}
        self.high: dict[str, int] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Files and pages are filtered whole here; a bound on y also skips chunks, and is left for Spark to apply to rows."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in ("path", "dir_index") and isinstance(f, (EqualTo, In)):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only[name] = self.only[name] & values if name in self.only else values
                continue
            if name == "y" and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low["y"] = max(self.low.get("y", 0), int(f.value) + isinstance(f, GreaterThan))
            if name == "y" and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high["y"] = min(self.high.get("y", 1 << 62), int(f.value) - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[InputPartition]:
        from fnmatch import fnmatch

        from pyarrow import fs

        store, base = _store(self.folder)
        found = store.get_file_info(fs.FileSelector(base, recursive=True)) if store.get_file_info(base).type == fs.FileType.Directory else [store.get_file_info(base)]
        out, held, size = [], [], 0
        for f in sorted(found, key=lambda x: x.path):
            if f.type != fs.FileType.File or not fnmatch(f.base_name, self.glob) or "path" in self.only and f.path not in self.only["path"]:
                continue
            if f.size > self.task_bytes and self.table in ("chunks", "scanlines"):
                n = -(-f.size // self.task_bytes)
                out += [Files([f.path], (k, n)) for k in range(n)]
                continue
            if held and size + f.size > self.task_bytes:
                out.append(Files(held))
                held, size = [], 0
            held.append(f.path)
            size += f.size
        return [*out, Files(held)] if held else out

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _store(self.folder)
        pages = self.only.get("dir_index")
        window = (0, self.low.get("y", 0), 1 << 62, self.high.get("y", 1 << 62)) if self.low or self.high else None
        for name in partition.names:
            with store.open_input_file(name) as f:
                whole = partition.part[1] == 1 and self.table in ("chunks", "scanlines")
                content = f.read() if whole else ranged.Ranged(f, f.size())
                if self.strict:
                    container.parse(content, self.max_alloc, strict=True)
                if self.table == "directories":
                    rows = raster.directory_rows(name, content, self.max_alloc)
                elif self.table == "tags":
                    rows = raster.tag_rows(name, content, self.max_alloc)
                elif self.table == "chunks":
                    rows = raster.chunk_rows(name, content, pages, part=partition.part)
                else:
                    rows = raster.scanline_rows(name, content, pages, window, partition.part)
                at = {"directories": 1, "tags": 2, "chunks": 1, "scanlines": 1}[self.table]
                yield from (r for r in rows if pages is None or r[at] in pages)


@dataclass
class Written(WriterCommitMessage):
    moves: list[tuple[str, str]]


class RasterFiles(DataSource):
    """Writes (path, content) rows as files into the folder `path`; files appear when the whole job has succeeded."""

    @classmethod
    def name(cls) -> str:
        return "raster_files"

    def schema(self) -> str:
        return raster.FILES

    def writer(self, schema: StructType, overwrite: bool) -> RasterWriter:
        return RasterWriter(self.options["path"])


class RasterWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder, self.job = folder, f".pending-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, base = _store(self.folder)
        store.create_dir(f"{base}/{self.job}", recursive=True)
        moves = []
        for batch in iterator:
            names = batch.schema.names
            for path, content in zip(batch.column(names.index("path")).to_pylist(), batch.column(names.index("content")).to_pylist(), strict=True):
                temp = f"{base}/{self.job}/{uuid.uuid4().hex}"
                with store.open_output_stream(temp) as f:
                    f.write(content or b"")
                moves.append((temp, f"{base}/{path.rsplit('/', 1)[-1]}"))
        return Written(moves)

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.folder)
        for m in messages:
            for temp, name in m.moves if m else ():
                store.move(temp, name)
        store.delete_dir(f"{base}/{self.job}") if messages else None

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = _store(self.folder)
        if store.get_file_info(f"{base}/{self.job}").type == fs.FileType.Directory:
            store.delete_dir(f"{base}/{self.job}")


def register(spark) -> None:
    """Make both known to a session and let filters reach the reader."""
    spark.dataSource.register(RasterSource)
    spark.dataSource.register(RasterFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
