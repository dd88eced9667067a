"""The data source, its filters, and the sink."""

import io

import numpy as np
import pytest

from mosaiq.sources import container, datasource, ranged, raster

RNG = np.random.default_rng(5)


@pytest.fixture
def folder(spark, tmp_path):
    datasource.register(spark)
    pages = {n: [RNG.integers(0, 255, (40, 9)).astype("u1"), RNG.integers(0, 255, (6, 5)).astype("u1")] for n in "ab"}
    for n, p in pages.items():
        (tmp_path / f"{n}.tif").write_bytes(container.encode_pages(p, rows=4))
    return tmp_path, pages


def test_tables_and_filters(spark, folder):
    path, pages = folder
    load = lambda t: spark.read.format("raster").option("path", str(path)).option("table", t).option("glob", "*.tif").load()
    assert sorted((r["path"][-5:], r["dir_index"], r["length"]) for r in load("directories").collect()) == [(f"{n}.tif", i, h) for n in "ab" for i, h in ((0, 40), (1, 6))]
    assert load("tags").where("dir_index = 1 AND name = 'width'").count() == 2
    assert load("chunks").where("dir_index IN (0, 5)").count() == 20
    lines = load("scanlines").where(f"path = '{path}/a.tif' AND dir_index = 0 AND y >= 10 AND y < 13")
    assert {r["y"]: r["samples"] for r in lines.collect()} == {y: pages["a"][0][y].astype(float).tolist() for y in (10, 11, 12)}
    assert load("scanlines").where("y = 5").count() == 4
    assert load("scanlines").where("dir_index = 0 AND dir_index = 1").count() == 0


def test_pushed_filters_skip_work(folder):
    path, _ = folder
    reader = datasource.RasterReader({"path": str(path), "table": "scanlines"})
    left = list(reader.pushFilters([datasource.EqualTo(("path",), f"{path}/b.tif"), datasource.EqualTo(("dir_index",), 0), datasource.GreaterThan(("y",), 37)]))
    assert len(left) == 1  # the bound on rows stays with Spark
    (part,) = reader.partitions()
    assert part.names == [f"{path}/b.tif"] and [r[3] for r in reader.read(part)] == [36, 37, 38, 39]


def test_damage(spark, folder):
    path, _ = folder
    (path / "c.tif").write_bytes(b"broken")
    load = lambda mode: spark.read.format("raster").option("path", str(path)).option("mode", mode).load()
    assert load("PERMISSIVE").where("error IS NOT NULL").count() == 1
    with pytest.raises(Exception, match="not a tagged raster"):
        load("FAILFAST").collect()
    with pytest.raises(Exception, match="no table"):
        spark.read.format("raster").option("path", str(path)).option("table", "x").load().schema


def test_sink(spark, folder, tmp_path):
    path, pages = folder
    out = tmp_path / "out"
    raster.read_files(spark, str(path), "*.tif").repartition(2).write.format("raster_files").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == ["a.tif", "b.tif"]
    assert (out / "a.tif").read_bytes() == (path / "a.tif").read_bytes()


@pytest.mark.parametrize("how", [{"rows": 3}, {"tile": (16, 16)}, {"planar": True, "rows": 7, "big": True, "order": ">"}])
def test_large_files_are_divided(tmp_path, how):
    pages = [RNG.integers(0, 255, (130, 70, 3)).astype("u1"), RNG.integers(0, 255, (41, 33)).astype("u1")]
    (tmp_path / "a.tif").write_bytes(container.encode_pages(pages, **how))
    size = (tmp_path / "a.tif").stat().st_size
    for table in ("chunks", "scanlines", "directories", "tags"):
        whole = datasource.RasterReader({"path": str(tmp_path), "table": table})
        want = [r for p in whole.partitions() for r in whole.read(p)]
        reader = datasource.RasterReader({"path": str(tmp_path), "table": table, "taskBytes": str(size // 9)})
        parts = reader.partitions()
        assert len(parts) == (10 if table in ("chunks", "scanlines") else 1)
        each = [list(reader.read(p)) for p in parts]
        assert [r for rows in each for r in rows] == want
        if len(parts) > 1:
            assert max(map(len, each)) <= 2 * min(map(len, each)) + 64 * 3


def test_ranged_reads():
    data = RNG.integers(0, 255, 3 * ranged.BLOCK + 77).astype("u1").tobytes()

    class Counted(io.BytesIO):
        read_bytes = 0

        def read(self, n=-1):
            Counted.read_bytes += n
            return super().read(n)

    part = ranged.Ranged(Counted(data), len(data))
    b = ranged.BLOCK
    for low, high in ((None, 2), (0, 8), (b - 3, b + 5), (b, 2 * b), (10, 2 * b + 9), (3 * b + 70, 3 * b + 99), (9 * b, 9 * b + 4), (5, 5), (9, 5)):
        assert part[low:high] == data[low:high]
    assert len(part) == len(data)
    # the directories of a large file cost a few blocks, a single chunk little more
    page = RNG.integers(0, 255, (4000, 500)).astype("u1")
    content = container.encode_pages([page], rows=8)
    Counted.read_bytes = 0
    r = container.parse(ranged.Ranged(Counted(content), len(content)), defer=True)
    d = r.directories[0]
    c = container.chunk_at(d, container.chunk_count(d) // 2)
    assert np.array_equal(container.decode_chunk(r, d, c)[:, :, 0], page[c.y0 : c.y0 + c.h])
    assert Counted.read_bytes <= 4 * ranged.BLOCK < len(content)


def test_chunks_of_unknown_size():
    content = container.encode_pages([RNG.integers(0, 255, (40, 9)).astype("u1")], rows=4)
    whole = container.parse(content).directories[0]
    for d in (container.parse(content).directories[0], container.parse(content, defer=True).directories[0]):
        del d.tags[279]
        assert [container.chunk_at(d, k) for k in range(container.chunk_count(d))][:-1] == container.layout(whole)[:-1]
