"""Container, codecs and tables of raster files."""

import contextlib

import numpy as np
import pytest

from mosaiq.sources import codecs, container, edits, fax, jpeg, logs, raster
from mosaiq.streaming import arrivals

RNG = np.random.default_rng(7)


@pytest.mark.parametrize("compression", [codecs.NONE, codecs.LZW, codecs.PACKBITS, codecs.DEFLATE_ADOBE, codecs.DEFLATE, codecs.LZMA, codecs.ZSTD])
@pytest.mark.parametrize("how", [{}, {"tile": (16, 32)}, {"planar": True}, {"rows": 5}, {"order": ">"}, {"big": True}])
def test_pages_round_trip(compression, how):
    for predictor, dtype in ((1, "u1"), (2, "u1"), (2, "u2"), (2, "u4"), (3, "f4"), (3, "f8"), (1, "i2")):
        pages = [RNG.integers(0, 40, (37, 23, n)).astype(dtype) for n in (1, 3)]
        r = container.parse(container.encode_pages(pages, compression=compression, predictor=predictor, **how), strict=True)
        assert len(r.directories) == 2
        for page, d in zip(pages, r.directories, strict=True):
            assert np.array_equal(container.decode_page(r, d), page)


@pytest.mark.parametrize("n", [0, 1, 300, 5000, 70000])
def test_byte_codecs(n):
    for data in (bytes(n), RNG.integers(0, 256, n).astype("u1").tobytes(), (b"abcab" * n)[:n]):
        assert codecs.lzw_decode(codecs.lzw_encode(data)) == data
        assert codecs.packbits_decode(codecs.packbits_encode(data)) == data


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_small_samples(bits):
    x = RNG.integers(0, 1 << bits, (9, 23)).astype("u1")
    r = container.parse(container.encode_pages([x], bits=bits))
    assert np.array_equal(container.decode_page(r, r.directories[0])[:, :, 0], x)


@pytest.mark.parametrize("scheme", [codecs.CCITT_RLE, codecs.CCITT_RLEW, codecs.CCITT_G3, codecs.CCITT_G4])
@pytest.mark.parametrize("width", [1, 8, 37, 1728, 6000])
def test_bilevel_codecs(scheme, width):
    for dense in (0, 0.02, 0.5, 1):
        x = np.repeat((RNG.random((3, width)) < dense).astype("u1"), 3, axis=0)
        for options in (0, 1, 4, 5) if scheme == codecs.CCITT_G3 else (0,):
            r = container.parse(container.encode_pages([x], compression=scheme, bits=1, rows=4, photometric=0, extra={292: (4, [options])}))
            assert np.array_equal(container.decode_page(r, r.directories[0])[:, :, 0], x)


def test_bilevel_codes_are_whole():
    for codes in fax.RUNS:
        found = sorted(codes.values())
        assert not any(b.startswith(a) for a, b in zip(found, found[1:], strict=False))
        assert sum(2.0 ** -len(c) for c in found) == 255 / 256  # what is left over begins the end of a line


def test_damaged_bilevel_rows_end():
    for i in range(200):
        data = RNG.integers(0, 256, 60).astype("u1").tobytes()
        assert len(fax.decode(data, 100, 20, ("rle", "g3", "g4")[i % 3], two=i % 2 == 0)) == 20 * 13


def test_log_rows():
    for w in (1, 5, 300):
        for size in (2, 4):
            row = RNG.integers(0, 1 << 8 * size, w).astype(f"u{size}")
            row[: w // 2] = 7
            assert np.array_equal(logs.decode_planes(logs.encode_planes(row, size), w, size)[0], row)


@pytest.mark.parametrize("order", ["<", ">"])
def test_log_luminance_pages(order):
    y, xyz = RNG.random((9, 20, 1)).astype("f4") * 100, RNG.random((9, 20, 3)).astype("f4") + 0.5
    r = container.parse(container.encode_pages([y], compression=codecs.SGILOG, photometric=logs.LOGL, order=order, rows=4))
    assert np.allclose(container.decode_page(r, r.directories[0]), y, rtol=0.003)
    r = container.parse(container.encode_pages([xyz], compression=codecs.SGILOG, photometric=logs.LOGLUV, order=order, rows=4))
    assert np.allclose(container.decode_page(r, r.directories[0]), xyz, rtol=0.06)
    assert np.array_equal(logs.codes16(logs.luminance16(np.arange(1, 0x7FFF, dtype="u2"))), np.arange(1, 0x7FFF))


@pytest.mark.parametrize("order", ["<", ">"])
def test_film_logarithms(order):
    for dtype, near in (("u1", 1), ("u2", 300), ("f4", 0.01)):
        x = (RNG.random((9, 21, 3)) * {"u1": 255, "u2": 65535, "f4": 1}[dtype]).astype(dtype)
        r = container.parse(container.encode_pages([x], compression=codecs.PIXARLOG, order=order, rows=4))
        assert np.abs(container.decode_page(r, r.directories[0]).astype(float) - x).max() <= near
    assert np.array_equal(logs.film_codes(logs.film_samples(np.arange(2048), "f4").astype("f8")), np.arange(2048))


def smooth(h, w, n):
    y, x = np.mgrid[:h, :w]
    return np.clip(np.stack([128 + 90 * np.sin(y / 9 + i) * np.cos(x / (11 + i)) for i in range(n)], -1), 0, 255).astype("u1")


@pytest.mark.parametrize("n", [1, 3, 4])
@pytest.mark.parametrize("subsampling", [(1, 1), (2, 1), (2, 2)])
def test_jpeg_streams(n, subsampling):
    x = smooth(61, 83, n)
    near = [np.abs(jpeg.decode(jpeg.encode(x, q, subsampling)).astype(int) - x) for q in (30, 95)]
    assert near[1].mean() <= near[0].mean() < 6 and near[1].max() < 16
    noise = RNG.integers(0, 256, (17, 30, n)).astype("u1")
    assert np.abs(jpeg.decode(jpeg.encode(noise, 100)).astype(int) - noise).max() <= 2


def test_jpeg_tables_apart_and_damage():
    x = smooth(24, 40, 3)
    whole = jpeg.encode(x, 90)
    kept = [(m, whole[whole.index(b"\xff" + bytes([m]) + (len(b) + 2).to_bytes(2, "big") + b) :][: len(b) + 4]) for m, b, _ in jpeg._segments(whole)]
    tables = b"\xff\xd8" + b"".join(s for m, s in kept if m in (0xDB, 0xC4)) + b"\xff\xd9"
    part = next(p for m, _, p in jpeg._segments(whole) if m == 0xDA)
    rest = b"\xff\xd8" + b"".join(s for m, s in kept if m in (0xC0, 0xDA)) + part + b"\xff\xd9"
    assert np.array_equal(jpeg.decode(rest, tables), jpeg.decode(whole))
    for bad in (b"", b"\xff\xd8\xff\xd9", rest, whole.replace(b"\xff\xc0", b"\xff\xc2")):
        with pytest.raises(jpeg.JpegError):
            jpeg.decode(bad)


@pytest.mark.parametrize("how", [{}, {"tile": (16, 32)}, {"planar": True}])
def test_jpeg_pages(how):
    x = smooth(50, 70, 3)
    r = container.parse(container.encode_pages([x], compression=codecs.JPEG, **how))
    assert np.abs(container.decode_page(r, r.directories[0]).astype(int) - x).mean() < 5


def test_thunder_and_next_rows():
    assert codecs.thunder_decode(bytes([0xC5, 0x03]), 4) == b"\x55\x55"
    assert codecs.next_decode(b"\x00ab", 2, 2) == b"ab"
    assert codecs.next_decode(b"\x40\x00\x01\x00\x01z", 2, 2) == b"\xffz"


def test_loops_and_damage_end():
    data = bytearray(container.encode_pages([np.zeros((2, 2), "u1")] * 2))
    r = container.parse(bytes(data))
    data[-4:] = r.first.to_bytes(4, "little")  # the last directory points to the first
    looped = container.parse(bytes(data))
    assert len(looped.directories) == 2 and "loop" in looped.warnings[0]
    with pytest.raises(container.FormatError):
        container.parse(b"no raster at all")
    assert container.parse(bytes(data[:20])).warnings
    with pytest.raises(codecs.CodecError):
        codecs.decode(34887, b"")


def test_user_codec_and_tag():
    codecs.register_codec(65000, "reversed", lambda d, how: d[::-1], lambda d, how: d[::-1])
    x = RNG.integers(0, 255, (5, 5)).astype("u1")
    r = container.parse(container.encode_pages([x], compression=65000, extra={65001: (2, "note")}))
    container.register_tag(65001, "note")
    assert np.array_equal(container.decode_page(r, r.directories[0])[:, :, 0], x)
    assert container.tag_name(65001) == "note" and r.directories[0].tags[65001][2] == "note"
    codecs.unregister_codec(65000)


@pytest.fixture
def folder(tmp_path):
    pages = [RNG.integers(0, 255, (11, 7, 3)).astype("u1"), RNG.integers(0, 255, (4, 5)).astype("u1")]
    (tmp_path / "a.tif").write_bytes(container.encode_pages(pages, compression=codecs.ZSTD))
    (tmp_path / "b.tif").write_bytes(b"broken")
    return tmp_path, pages


def test_tables(spark, folder):
    path, pages = folder
    files = raster.read_files(spark, str(path), "*.tif")
    dirs = {(r["path"][-5:], r["dir_index"]): r for r in raster.directories(files).collect()}
    assert dirs["a.tif", 0]["width"] == 7 and dirs["a.tif", 1]["length"] == 4 and dirs["b.tif", None]["error"]
    assert raster.tags(files).where("name = 'width'").count() == 2
    assert raster.chunks(files, pages=[0]).count() == 1
    px = raster.pixels(raster.scanlines(files))
    got = {(r["dir_index"], r["plane"], r["y"], r["x"]): r["v"] for r in px.collect()}
    assert len(got) == 11 * 7 * 3 + 20
    assert all(got[0, s, y, x] == pages[0][y, x, s] for y in range(11) for x in range(7) for s in range(3))


def test_write_and_read_back(spark, folder, tmp_path):
    path, pages = folder
    px = raster.pixels(raster.scanlines(raster.read_files(spark, str(path), "a.tif")))
    n = raster.write_files(raster.encode_rasters(px, compression=codecs.LZW, tile=(16, 16)), str(tmp_path / "out"))
    r = container.parse((tmp_path / "out" / "a.tif").read_bytes())
    assert n == 1 and [np.array_equal(container.decode_page(r, d).reshape(p.shape), p) for d, p in zip(r.directories, pages, strict=True)] == [True, True]
    again = raster.recode(raster.read_files(spark, str(path), "a.tif"), compression=codecs.DEFLATE_ADOBE, big=True).first()
    assert container.parse(again["content"]).big
    assert {r["path"][-7:] for r in raster.split_pages(raster.read_files(spark, str(path), "a.tif")).collect()} == {"aaa.tif", "aab.tif"}


def test_imports(spark, tmp_path):
    (tmp_path / "x.pgm").write_bytes(b"P5\n# note\n3 2\n255\n" + bytes(range(6)))
    (tmp_path / "y.raw").write_bytes(b"head" + bytes(range(12)))
    one = raster.import_pnm(raster.read_files(spark, str(tmp_path), "*.pgm")).first()
    r = container.parse(one["content"])
    assert container.decode_page(r, r.directories[0]).reshape(-1).tolist() == list(range(6))
    two = raster.import_raw(raster.read_files(spark, str(tmp_path), "*.raw"), 3, 4, header=4).first()
    r = container.parse(two["content"])
    assert container.decode_page(r, r.directories[0]).reshape(-1).tolist() == list(range(12))
    assert raster.pnm(b"P1\n2 2\n0 1\n1 0\n").reshape(-1).tolist() == [0, 1, 1, 0]


def test_stream(spark, folder, tmp_path):
    path, _ = folder
    seen = []
    arrivals.for_each_batch(arrivals.stream_directories(spark, str(path), "a.tif"), lambda df, n: seen.extend(df.collect()), str(tmp_path / "checkpoint"))
    assert len(seen) == 2


def progressive(x, quality, subsampling=(1, 1), restart=0):
    """The coefficients of jpeg.encode's stream in spectral bands and bit by bit, written from the standard's description of the code."""
    whole = jpeg.encode(x, quality, subsampling)
    known, frame, planes = jpeg.Tables(), {}, {}
    for m, body, part in jpeg._segments(whole):
        known.take(m, body)
        if m in (0xC0, 0xC1):
            sof, h, w = body, int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            frame = {body[6 + 3 * i]: (body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])}
            across, down = max(f[1] for f in frame.values()), max(f[2] for f in frame.values())
            mx, my = -(-w // (8 * across)), -(-h // (8 * down))
            planes = {c: np.zeros((my * v, mx * u, 64), np.int32) for c, u, v, _ in frame.values()}
        elif m == 0xDA:
            jpeg._read_scan(part, body, known, frame, planes, (across, down, w, h), False)
    seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
    # every symbol has a code of 8 bits (but 255, which no scan needs), so that the table itself can't hide an error
    plain = bytes([0] * 7 + [255] + [0] * 8) + bytes(range(255))
    out = b"\xff\xd8" + b"".join(seg(m, b) for m, b, _ in jpeg._segments(whole) if m == 0xDB) + seg(0xC2, sof)
    out += seg(0xC4, b"\x00" + plain) + seg(0xC4, b"\x10" + plain) + (seg(0xDD, restart.to_bytes(2, "big")) if restart else b"")

    def scan(ids, band, high, low, units, write):
        nonlocal out
        out += seg(0xDA, bytes([len(ids)]) + b"".join(bytes([c, 0]) for c in ids) + bytes([*band, high << 4 | low]))
        each = restart or len(units)
        for n, at in enumerate(range(0, len(units), each)):
            text = write(units[at : at + each])
            text += "1" * (-len(text) % 8)
            out += (bytes([0xFF, 0xD0 + (n - 1) % 8]) if n else b"") + int("1" + text, 2).to_bytes(len(text) // 8 + 1, "big")[1:].replace(b"\xff", b"\xff\x00")

    size = lambda v: f"{v if v > 0 else v + (1 << abs(v).bit_length()) - 1:0{abs(v).bit_length()}b}" if v else ""
    sym = lambda s: f"{s:08b}"
    mixed = [[(c, planes[c][y * v + k // u, xx * u + k % u]) for c, u, v, _ in frame.values() for k in range(u * v)] for y in range(my) for xx in range(mx)]
    if len(frame) == 1:
        mixed = [[(c, planes[c][y, xx])] for c in frame for y in range(-(-h // 8)) for xx in range(-(-w // 8))]

    def dc(units):
        text, before = "", dict.fromkeys(frame, 0)
        for unit in units:
            for c, b in unit:
                v = int(b[0]) >> 1
                text += sym(abs(v - before[c]).bit_length()) + size(v - before[c])
                before[c] = v
        return text

    def ended(run):
        n = run.bit_length() - 1
        return sym(n << 4) + (f"{run - (1 << n):0{n}b}" if n else "")

    def first(band, low):
        def write(blocks):
            text, run = "", 0
            for b in blocks:
                at = band[0]
                for k in range(band[0], band[1] + 1):
                    v = int(np.sign(b[k])) * (abs(int(b[k])) >> low)
                    if not v:
                        continue
                    text, run = text + (ended(run) if run else ""), 0
                    while k - at > 15:
                        text, at = text + sym(0xF0), at + 16
                    text, at = text + sym((k - at) << 4 | abs(v).bit_length()) + size(v), k + 1
                run += at <= band[1]
            return text + (ended(run) if run else "")

        return write

    def then(band, low):
        def write(blocks):
            text, run, held = "", 0, ""
            for b in blocks:
                sizes = [abs(int(b[k])) >> low for k in range(band[0], band[1] + 1)]
                last = max((i for i, v in enumerate(sizes) if v == 1), default=-1)
                zeros, bits = 0, ""
                for i, v in enumerate(sizes):
                    if i > last:
                        break
                    if i <= last and run:
                        text, run, held = text + ended(run) + held, 0, ""
                    if zeros == 16:
                        text, zeros, bits = text + sym(0xF0) + bits, 0, ""
                    if v > 1:
                        bits += str(v & 1)
                    elif v == 0:
                        zeros += 1
                    else:
                        text, zeros, bits = text + sym(zeros << 4 | 1) + str(int(b[band[0] + i] > 0)) + bits, 0, ""
                if last < len(sizes) - 1:
                    run, held = run + 1, held + "".join(str(v & 1) for v in sizes[last + 1 :] if v > 1)
            return text + (ended(run) + held if run else "")

        return write

    scan(list(frame), (0, 0), 0, 1, mixed, dc)
    for c, u, v, _ in frame.values():
        rows, cols = -(-(-(-h * v // down)) // 8), -(-(-(-w * u // across)) // 8)
        own = [planes[c][y, xx] for y in range(rows) for xx in range(cols)]
        scan([c], (1, 5), 0, 2, own, first((1, 5), 2))
        scan([c], (6, 63), 0, 2, own, first((6, 63), 2))
        for low in (1, 0):
            scan([c], (1, 63), low + 1, low, own, then((1, 63), low))
    scan(list(frame), (0, 0), 1, 0, mixed, lambda units: "".join(str(int(b[0]) & 1) for unit in units for _, b in unit))
    return out + b"\xff\xd9", whole


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("subsampling", [(1, 1), (2, 1), (2, 2)])
@pytest.mark.parametrize("restart", [0, 3])
def test_progressive_streams(n, subsampling, restart):
    for x, quality in ((smooth(45, 61, n), 80), (RNG.integers(0, 256, (19, 37, n)).astype("u1"), 100), (np.full((40, 300, n), 9, "u1"), 50)):
        scans, whole = progressive(x, quality, subsampling if n > 1 else (1, 1), restart)
        assert np.array_equal(jpeg.decode(scans), jpeg.decode(whole))
    for cut in (0.03, 0.1, 0.3, 0.6, 0.9):  # what has come so far is a coarser image, or an error, and never hangs
        with contextlib.suppress(jpeg.JpegError):
            jpeg.decode(scans[: int(len(scans) * cut)])


def test_twelve_bits():
    y, x = np.mgrid[:37, :53]
    deep = np.stack([(2048 + 1900 * np.sin(y / 7 + i) * np.cos(x / 9)) for i in range(3)], -1).astype("u2")
    back = jpeg.decode(jpeg.encode(deep, 95))
    assert back.dtype == np.uint16 and np.abs(back.astype(int) - deep).max() < 40
    scans, whole = progressive(deep, 95)
    assert np.array_equal(jpeg.decode(scans), jpeg.decode(whole))
    r = container.parse(container.encode_pages([deep], compression=codecs.JPEG, bits=12, rows=16))
    assert np.abs(container.decode_page(r, r.directories[0]).astype(int) - deep).max() < 250


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("bits", [10, 12, 14])
def test_odd_depths(bits, order):
    x = RNG.integers(0, 1 << bits, (9, 23, 3)).astype("u2")
    r = container.parse(container.encode_pages([x], bits=bits, order=order, compression=codecs.DEFLATE_ADOBE))
    assert np.array_equal(container.decode_page(r, r.directories[0]), x)


@pytest.mark.parametrize("by", [(2, 2), (2, 1), (4, 4), (1, 2)])
@pytest.mark.parametrize("how", [{}, {"tile": (16, 32)}, {"rows": 8, "compression": codecs.LZW}])
def test_thinned_chroma(by, how):
    x = RNG.integers(0, 256, (21, 37, 3)).astype("u1")
    r = container.parse(container.encode_pages([x], photometric=6, subsampling=by, **how))
    d = r.directories[0]
    got = container.decode_page(r, d)
    assert np.array_equal(got[:, :, 0], x[:, :, 0])
    if "tile" not in how:  # whole blocks: the rounded mean of what they hold
        for y in range(0, 21 // by[1] * by[1], by[1]):
            for x0 in range(0, 37 // by[0] * by[0], by[0]):
                block = x[y : y + by[1], x0 : x0 + by[0], 1:].reshape(-1, 2)
                assert (got[y : y + by[1], x0 : x0 + by[0], 1:] == np.floor(block.mean(axis=0) + 0.5)).all()
    if not how:  # the layout, unit by unit
        raw = r.data[d.many("strip_offsets")[0] :][: by[0] * by[1] + 2]
        assert raw[: by[0] * by[1]] == x[: by[1], : by[0], 0].tobytes()


def test_thinned_chroma_faults():
    x = RNG.integers(0, 256, (20, 20, 3)).astype("u1")
    for how in ({"rows": 3}, {"planar": True}, {"predictor": 2}, {"compression": codecs.JPEG}):
        with pytest.raises(container.FormatError):
            container.encode_pages([x], photometric=6, subsampling=(2, 2), **how)
    r = container.parse(edits.set_tags(container.encode_pages([x], photometric=6), 0, {530: (3, [3, 1])}))
    with pytest.raises(container.FormatError):
        container.decode_page(r, r.directories[0])


def old_jpeg(x, rows, subsampling, form):
    """A file of the first form: `page` (one stream), `head` (a stream without scans, bare strips) or `tables` (tags point to tables)."""
    streams = [jpeg.encode(x[y : y + rows], 90, subsampling) for y in range(0, len(x), rows)]
    parts = [list(jpeg._segments(s)) for s in streams]
    data = bytearray(container.encode_pages([x], photometric=6 if x.shape[2] == 3 else 1))
    put = {259: (3, [codecs.JPEG_OLD]), 278: (4, [rows]), 530: (3, list(subsampling))}

    def add(b):
        data.extend(bytes(len(data) % 2))
        at = len(data)
        data.extend(b)
        return at

    bare = [next(p for m, _, p in s if m == 0xDA) for s in parts]
    if form == "page":
        put[513], put[514] = (4, [add(streams[0])]), (4, [len(streams[0])])
        put[273], put[279] = (4, [put[513][1][0]]), (4, [len(streams[0])])
    else:
        put[273], put[279] = (4, [add(b) for b in bare]), (4, [len(b) for b in bare])
        seg = lambda m, b: bytes([0xFF, m]) + (len(b) + 2).to_bytes(2, "big") + b
        if form == "head":
            head = b"\xff\xd8" + b"".join(seg(m, b) for m, b, _ in parts[0] if m != 0xDA or subsampling == (1, 1))
            put[513], put[514] = (4, [add(head)]), (4, [len(head)])
        else:
            own = {(m, b[0]): b[1:] for m, b, _ in parts[0] if m in (0xDB, 0xC4)}
            n = min(x.shape[2], 2)
            for tag, m, base in ((519, 0xDB, 0), (520, 0xC4, 0), (521, 0xC4, 16)):
                put[tag] = (4, [add(own[m, base + min(i, n - 1)]) for i in range(x.shape[2])])
    return edits.set_tags(bytes(data), 0, put), streams


@pytest.mark.parametrize("form", ["page", "head", "tables"])
@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("subsampling", [(1, 1), (2, 2)])
def test_old_jpeg(form, n, subsampling):
    by = subsampling if n == 3 else (1, 1)
    half = smooth(32, 45, n)
    x = half if form == "page" else np.vstack([half, half])  # equal strips have equal tables
    content, streams = old_jpeg(x, 32, by, form)
    r = container.parse(content)
    want = np.vstack([jpeg.decode(s) for s in streams])
    assert np.array_equal(container.decode_page(r, r.directories[0]), want)
    if form == "page":  # the page's stream, asked for in strips of 16 rows
        r = container.parse(edits.set_tags(content, 0, {278: (4, [16]), 273: (4, [8, 8]), 279: (4, [9, 9])}))
        assert len(container.layout(r.directories[0])) == 2
        assert np.array_equal(container.decode_page(r, r.directories[0]), want)
    else:
        r = container.parse(edits.set_tags(content, 0, {}, (513, 520)))
        with pytest.raises(jpeg.JpegError):
            container.decode_page(r, r.directories[0])


def test_chroma_cells():
    n = logs.FIRST[-1] + logs.COUNTS[-1]
    assert n == 16289
    cells = np.arange(n)
    u, v = logs.chroma_of(cells)
    assert np.array_equal(logs.cells_of(u, v), cells)
    assert [float(x) for x in logs.chroma_of(np.array([n, 16383]))[0]] == [logs.NEUTRAL[0]] * 2
    # a colour outside goes to the border cell whose direction from neutral is nearest to its own
    edge, at = [], 0
    for i, many in enumerate(logs.COUNTS.tolist()):
        edge += range(at, at + many) if i in (0, len(logs.COUNTS) - 1) else [at, at + many - 1]
        at += many
    eu, ev = logs.chroma_of(np.array(edge))
    way = np.arctan2(ev - logs.NEUTRAL[1], eu - logs.NEUTRAL[0])
    for angle in np.linspace(-3.1, 3.1, 80):
        chosen = int(logs.cells_of(np.array([logs.NEUTRAL[0] + 2 * np.cos(angle)]), np.array([logs.NEUTRAL[1] + 2 * np.sin(angle)]))[0])
        apart = np.abs(np.angle(np.exp(1j * (way - angle))))
        assert abs(apart[edge.index(chosen)] - apart.min()) < 1e-9


@pytest.mark.parametrize("order", ["<", ">"])
def test_short_log_pages(order):
    light = RNG.random((9, 20, 1)).astype("f4") * 8 + 0.01
    xyz = light * np.array([0.8, 1.0, 0.9], "f4") * (1 + 0.2 * RNG.random((9, 20, 3)).astype("f4"))
    content = container.encode_pages([xyz], compression=codecs.SGILOG24, photometric=logs.LOGLUV, order=order, rows=4)
    r = container.parse(content)
    assert r.directories[0].many("strip_bytecounts") == [240, 240, 60]
    got = container.decode_page(r, r.directories[0])
    assert np.allclose(got[:, :, 1], xyz[:, :, 1], rtol=0.006) and np.allclose(got, xyz, rtol=0.06)
    codes = np.arange(1, 1024, dtype="u4")
    want = np.where(codes == 1022, 1023, codes)  # 15.742 is the bound of the brightest code, and 1022 stands for 15.7422
    assert np.array_equal(logs.codes10(logs.luminance10(codes << 14)), want)
    assert not logs.xyz24(np.array([5], "u4")).any()
