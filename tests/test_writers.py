"""Writers, importers and dumps, on bytes and by Spark."""

import struct

import numpy as np
import pytest

from mosaiq.sources import codecs, container, edits, raster, writers

RNG = np.random.default_rng(3)


def image(h=21, w=13, n=1, dtype=np.uint8):
    return RNG.integers(0, 200, (h, w, n)).astype(dtype)


def pages(data):
    r = container.parse(data)
    return [container.decode_page(r, d) for d in r.directories if d.kind == "main"]


@pytest.mark.parametrize("how", [{}, {"compression": codecs.LZW, "big": True}, {"compression": codecs.DEFLATE_ADOBE, "predictor": 2, "order": ">"}])
def test_chunks_and_scanlines(how):
    x, y = image(dtype=np.uint16), image(dtype=np.uint16)
    data = container.encode_pages([x, y], rows=5, **how)
    block = image(5, dtype=np.uint16)
    got = pages(writers.write_chunk(data, 1, 2, block))
    y2 = y.copy()
    y2[10:15] = block
    assert np.array_equal(got[0], x) and np.array_equal(got[1], y2)
    rows = image(9, dtype=np.uint16)
    x2 = x.copy()
    x2[3:12] = rows
    assert np.array_equal(pages(writers.write_scanlines(data, 0, 3, rows))[0], x2)
    more = image(17, dtype=np.uint16)
    grown = writers.grow(writers.grow(data, 0, more[:2]), 0, more[2:])
    assert np.array_equal(pages(grown)[0], np.concatenate([x, more])) and np.array_equal(pages(grown)[1], y)
    with pytest.raises(container.FormatError):
        writers.write_raw_chunk(data, 0, 99, b"")


def test_raw_chunk_placement():
    data = container.encode_pages([image()], rows=5)
    r = container.parse(data)
    c = container.layout(r.directories[0])[1]
    small, large = writers.write_raw_chunk(data, 0, 1, b"\1" * c.bytecount), writers.write_raw_chunk(data, 0, 1, b"\2" * (c.bytecount + 9))
    at = lambda x: container.layout(container.parse(x).directories[0])[1]
    assert at(small).offset == c.offset and small[c.offset : c.offset + 3] == b"\1\1\1"
    assert at(large).offset >= len(data) and at(large).bytecount == c.bytecount + 9


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("big", [False, True])
def test_joining(order, big):
    a, b, c = image(), image(8, 40, 3), image(33, 17, 1, np.uint16)
    one = container.encode_pages([a, b], compression=codecs.LZW)
    two = container.encode_pages([c], tile=(16, 16), compression=codecs.DEFLATE_ADOBE, predictor=2, order=">")
    two = writers.write_sub_directory(two, 0, "exif", {33434: (5, [(1, 250)]), 36864: (7, b"0231")})
    two = writers.write_sub_directory(two, 0, "gps", {1: (2, "N"), 2: (5, [(52, 1), (30, 1), (0, 1)])})
    own = writers.Joiner(order, big)
    for data in (one, two):
        r = container.parse(data)
        for d in r.directories:
            if d.kind == "main":
                own.take(r, d)
    for got, want in zip(pages(bytes(own.out)), (a, b, c), strict=True):
        assert np.array_equal(got, want)
    assert own.encoded == (6 if order == "<" else 0) and own.copied > 0
    subs = {d.kind: d for d in container.parse(bytes(own.out)).directories if d.kind != "main"}
    assert subs["exif"].tags[33434][2] == [(1, 250)] and subs["gps"].tags[1][2] == "N"
    assert container.tag_name(2, "gps") == "gps_latitude" and container.tag_name(33434, "exif") == "exposure_time"
    assert [x.shape for x in pages(writers.append_pages(one, two))] == [a.shape, b.shape, c.shape]


def test_seek_and_deferred():
    x, y = image(40, 9), image(6, 5)
    data = container.encode_pages([x, y], rows=1)
    full = container.parse(data)
    second = container.parse(data, at=full.directories[1].offset)
    assert len(second.directories) == 1 and np.array_equal(container.decode_page(second, second.directories[0]), y)
    late = container.parse(data, defer=True)
    d = late.directories[0]
    assert isinstance(d.tags[273][2], container.Deferred) and d.many("strip_offsets")[:] == full.directories[0].many("strip_offsets")
    c = container.chunk_at(d, 17)
    assert c == container.layout(full.directories[0])[17] and np.array_equal(container.decode_chunk(late, d, c)[0], x[17])
    assert np.array_equal(container.decode_page(late, d), x)


def test_importers(spark):
    x = image(5, 7, 3)
    head = lambda depth, kind, maps=b"", size=0: struct.pack(">8I", 0x59A66A95, 7, 5, depth, size, kind, 1 if maps else 0, len(maps)) + maps
    rows = lambda a, pad: b"".join(r.tobytes().ljust(pad, b"\0") for r in a)
    plain = rows(np.ascontiguousarray(x[:, :, ::-1]), 22)
    packed = b"".join(b"\x80\0" if v == 0x80 else bytes([v]) for v in plain)
    assert np.array_equal(writers.sun_raster(head(24, 1) + plain), x) and np.array_equal(writers.sun_raster(head(24, 2) + packed), x)
    assert np.array_equal(writers.sun_raster(head(24, 2) + b"\x80\xff\x07" * 1), np.concatenate([np.full(110, 7), []]).astype(np.uint8).reshape(5, 22)[:, :21].reshape(5, 7, 3))
    index = RNG.integers(0, 4, (5, 7)).astype(np.uint8)
    colors = RNG.integers(0, 255, (4, 3)).astype(np.uint8)
    assert np.array_equal(writers.sun_raster(head(8, 1, colors.T.tobytes()) + rows(index, 8)), colors[index])
    bmp = b"BM" + struct.pack("<IHHI", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 7, 5, 1, 24, 0, 0, 0, 0, 0, 0) + rows(np.ascontiguousarray(x[::-1, :, ::-1]), 24)
    assert np.array_equal(writers.bitmap(bmp), x)
    sgi = struct.pack(">HBBHHHH", 474, 0, 1, 3, 7, 5, 3).ljust(512, b"\0") + np.ascontiguousarray(x[::-1].transpose(2, 0, 1)).tobytes()
    assert np.array_equal(writers.sgi_image(sgi), x)
    lines, starts, body = np.ascontiguousarray(x[::-1].transpose(2, 0, 1)).reshape(15, 7), [], b""
    for line in lines:
        starts.append(512 + 15 * 8 + len(body))
        body += bytes([128 + 4]) + line[:4].tobytes() + b"".join(bytes([1, v]) for v in line[4:].tolist()) + b"\0"
    coded = struct.pack(">HBBHHHH", 474, 1, 1, 3, 7, 5, 3).ljust(512, b"\0") + struct.pack(">15I", *starts) + bytes(60) + body
    assert np.array_equal(writers.sgi_image(coded), x)
    df = spark.createDataFrame([("a.ras", bytearray(head(24, 1) + plain)), ("b.bmp", bytearray(bmp)), ("c.sgi", bytearray(sgi))], raster.FILES)
    assert all(np.array_equal(pages(bytes(r["content"]))[0], x) for r in writers.import_images(df, compression=codecs.LZW).collect())
    with pytest.raises(container.FormatError):
        writers.sun_raster(bytes(40))


def test_iptc_and_dump(spark):
    block = b"\x1c\x02\x78\x00\x05hello" + b"\x1c\x02\x19\x80\x04\0\0\0\x03abc"
    assert list(writers.iptc_sets(block)) == [(2, 0x78, b"hello"), (2, 0x19, b"abc")]
    assert list(writers.resources(writers.as_resource(block) * 2)) == [(0x0404, "", block)] * 2
    base = container.encode_pages([image()])
    df = spark.createDataFrame([("a", bytearray(edits.set_tags(base, 0, {33723: (7, block)}))), ("b", bytearray(edits.set_tags(base, 0, {34377: (7, writers.as_resource(block))})))], raster.FILES)
    got = sorted((r["path"], r["number"], bytes(r["value"])) for r in writers.iptc(df).collect())
    assert got == [(p, n, v) for p in "ab" for n, v in ((0x19, b"abc"), (0x78, b"hello"))]
    rows = {r["tag"]: r for r in writers.dump(df.where("path = 'a'")).collect()}
    assert bytes(rows[33723]["bytes"]) == block and struct.unpack("<I", bytes(rows[256]["bytes"]))[0] == 13
    kept = edits.edit(spark.createDataFrame([("x", bytearray(b"no raster"))], raster.FILES), lambda b: edits.unlink_page(b, 0), broken="keep")
    assert bytes(kept.first()["content"]) == b"no raster"


def test_fax_postscript():
    bits = np.array([[0, 1, 1, 0, 1, 0, 0, 0], [0] * 8], np.uint8)[:, :, None]
    text = writers.fax_postscript(container.encode_pages([bits], bits=1, photometric=0, compression=codecs.CCITT_G4)).decode()
    assert [x for x in text.split("\n") if x.endswith(" s")] == ["2 1 1.5 s", "1 4 1.5 s"] and "%%Pages: 1" in text


def test_files_keep_their_folders(spark, tmp_path):
    df = spark.createDataFrame([("a/x.tif", bytearray(b"1")), ("b/x.tif", bytearray(b"2"))], raster.FILES)
    assert raster.write_files(df, str(tmp_path)) == 2 and (tmp_path / "a/x.tif").read_bytes() == b"1" and (tmp_path / "b/x.tif").read_bytes() == b"2"
