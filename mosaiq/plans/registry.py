"""Registered queries of the raster engine, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions import color as C
from mosaiq.functions import geometry as G
from mosaiq.operators import aggregates as A
from mosaiq.operators import joins as J
from mosaiq.operators import reshape as R
from mosaiq.operators import sequential as S
from mosaiq.plans import fixtures as X
from mosaiq.sources import codecs, container, edits, export, raster, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, longs: str = "", others: str = ""):
    """Register f under a name. longs: columns that are bigint in both; others: columns taken as they are."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.select(*(F.col(c).cast("bigint").alias(c) for c in longs.split()), *others.split()) if longs or others else df

        QUERIES[name] = run
        if sql:
            head, _, body = sql.rpartition("==")
            with_ = f"WITH {head.strip()} " if head.strip() else ""
            ORACLE_SQL[name] = f"{with_}SELECT {', '.join([*(f'CAST({c} AS BIGINT) AS {c}' for c in longs.split()), *others.split()])} FROM ({body.strip()})"
        return f

    return put


c = F.col


@query("gray_from_rgb", f"{X.RGB} == SELECT y, sum((r*77 + g*151 + b*28) >> 8) AS total, min((r*77 + g*151 + b*28) >> 8) AS low, max((r*77 + g*151 + b*28) >> 8) AS high, count(*) AS n FROM rgb GROUP BY y", "y total low high n")
def _(s, d):
    v = X.rgb8(s, d).select("y", C.gray_from_rgb(c("r"), c("g"), c("b")).alias("v"))
    return v.groupBy("y").agg(F.sum("v").alias("total"), F.min("v").alias("low"), F.max("v").alias("high"), F.count("*").alias("n"))


@query("gray_pixels", f"{X.RGB} == SELECT y, x, (r*77 + g*151 + b*28) >> 8 AS v FROM rgb", "y x v")
def _(s, d):
    return X.rgb8(s, d).select("y", "x", C.gray_from_rgb(c("r"), c("g"), c("b")).alias("v"))


@query("gray_from_palette", f"{X.INDEXED}, {X.PALETTE} == SELECT y, x, (p.r*77 + p.g*151 + p.b*28) >> 8 AS v FROM ind JOIN pal p USING (idx)", "y x v")
def _(s, d):
    return J.gray_from_palette(X.indexed(s, d), X.palette(s, d))


@query("palette_to_rgb", f"{X.INDEXED}, {X.PALETTE} == SELECT y, x, idx, p.r, p.g, p.b FROM ind JOIN pal p USING (idx)", "y x idx r g b")
def _(s, d):
    return J.with_palette(X.indexed(s, d), X.palette(s, d))


@query("palette16_to_rgb", f"{X.INDEXED}, {X.PALETTE} == SELECT y, x, (p.r*257) >> 8 AS r, (p.g*257) >> 8 AS g, (p.b*257) >> 8 AS b FROM ind JOIN pal p USING (idx)", "y x r g b")
def _(s, d):
    return J.with_palette(X.indexed(s, d), X.palette(s, d).select("idx", *((c(k) * 257).alias(k) for k in "rgb")))


for _name, _flip in (("minisblack", False), ("miniswhite", True)):

    @query(f"gray_map_{_name}", f"{X.GRAY} == SELECT y, x, ({'15 - v // 16' if _flip else 'v // 16'}) * 255 // 15 AS v FROM gray", "y x v")
    def _(s, d, flip=_flip):
        return X.gray8(s, d).select("y", "x", C.gray_level(C.idiv(c("v"), 16), 4, flip).alias("v"))


@query("gray16_to_8", f"{X.GRAY} == SELECT y, x, (v*257 + x) >> 8 AS v FROM gray", "y x v")
def _(s, d):
    return X.gray8(s, d).select("y", "x", C.gray_level(c("v") * 257 + c("x"), 16).alias("v"))


@query("depth16_to_8", f"{X.RGB} == SELECT y, x, (r*257 + 128) // 257 AS r, (g*256 + 128) // 257 AS g, (b*200 + 128) // 257 AS b FROM rgb", "y x r g b")
def _(s, d):
    return X.rgb8(s, d).select("y", "x", *(C.depth16_to_8(c(k) * n).alias(k) for k, n in (("r", 257), ("g", 256), ("b", 200))))


@query("premultiply_alpha", f"{X.RGB} == SELECT y, x, (r*(x*5%256) + 127) // 255 AS r, (g*(x*5%256) + 127) // 255 AS g, (b*(x*5%256) + 127) // 255 AS b FROM rgb", "y x r g b")
def _(s, d):
    return X.rgb8(s, d).select("y", "x", *(C.premultiply(c(k), c("x") * 5 % 256).alias(k) for k in "rgb"))


@query("cmyk_to_rgb", f"{X.RGB} == SELECT y, x, (255-k)*(255-r)//255 AS r, (255-k)*(255-g)//255 AS g, (255-k)*(255-b)//255 AS b FROM (SELECT *, x*5%256 AS k FROM rgb)", "y x r g b")
def _(s, d):
    return X.rgb8(s, d).select("y", "x", *(v.alias(k) for k, v in zip("rgb", C.cmyk_to_rgb(c("r"), c("g"), c("b"), c("x") * 5 % 256), strict=True)))


@query("pack_abgr", f"{X.RGB} == SELECT y, x, r + g*256 + b*65536 + 4278190080 AS abgr FROM rgb", "y x abgr")
def _(s, d):
    return X.rgb8(s, d).select("y", "x", C.rgba("rgb", c("r"), c("g"), c("b")).alias("abgr"))


@query("unpack_abgr", f"{X.RGB} == SELECT y, x, r, g, b, x*5%256 AS a FROM rgb", "y x r g b a")
def _(s, d):
    packed = X.rgb8(s, d).select("y", "x", C.pack_abgr(c("r"), c("g"), c("b"), c("x") * 5 % 256).alias("p"))
    return packed.select("y", "x", *(v.alias(k) for k, v in C.unpack_abgr(c("p")).items()))


@query("invert", f"{X.GRAY} == SELECT y, x, 255 - v AS v FROM gray", "y x v")
def _(s, d):
    return X.gray8(s, d).select("y", "x", C.invert(c("v")).alias("v"))


@query("threshold", f"{X.GRAY} == SELECT y, sum(CASE WHEN v > 128 THEN 1 ELSE 0 END) AS ink FROM gray GROUP BY y", "y ink")
def _(s, d):
    return X.gray8(s, d).groupBy("y").agg(F.sum(C.threshold(c("v"))).alias("ink"))


@query("bit_unpack", f"{X.GRAY} == SELECT y, x*4 + k AS x, (v >> (6 - 2*k)) & 3 AS v FROM gray, (SELECT unnest([0, 1, 2, 3]) AS k)", "y x v")
def _(s, d):
    return X.gray8(s, d).select("y", c("x").alias("x0"), F.posexplode(C.bits_of(c("v"), 2)).alias("k", "v")).select("y", (c("x0") * 4 + c("k")).alias("x"), "v")


@query("popcount", f"{X.GRAY} == SELECT y, sum(bit_count(v)) AS ink FROM gray GROUP BY y", "y ink")
def _(s, d):
    return X.gray8(s, d).groupBy("y").agg(F.sum(F.bit_count("v")).alias("ink"))


@query("ycbcr_to_rgb", f"""{X.RGB} == SELECT y, x, greatest(0, least(255, r + CAST(floor(((b-128)*91881 + 32768)/65536.0) AS BIGINT))) AS r2,
 greatest(0, least(255, r + CAST(floor((-((b-128)*46802) - (g-128)*22553 + 32768)/65536.0) AS BIGINT))) AS g2, greatest(0, least(255, r + CAST(floor(((g-128)*116130 + 32768)/65536.0) AS BIGINT))) AS b2 FROM rgb""", "y x r2 g2 b2")
def _(s, d):
    return X.rgb8(s, d).select("y", "x", *(v.alias(k) for k, v in zip(("r2", "g2", "b2"), C.ycbcr_to_rgb(c("r"), c("g"), c("b")), strict=True)))


@query("logl16_to_y", f"{X.GRAY} == SELECT y, x, CASE WHEN v = 0 THEN 0.0 ELSE round(exp(0.693147180559945309417/256.0*(v*64 + 0.5) - 0.693147180559945309417*64.0), 12) END AS lum FROM gray", "y x", "lum")
def _(s, d):
    return X.gray8(s, d).select("y", "x", F.round(C.logl16_to_y(c("v") * 64), 12).alias("lum"))


# geometry; the height of gray is the number of vectors, its width 64
_H = "(SELECT count(*) FROM embeddings)"


def _placed(name: str, sx: str, sy: str, f: Callable[[Column, Column, int, int], tuple[Column, Column]]) -> None:
    @query(name, f"{X.GRAY} == SELECT {sx} AS x, {sy} AS y, v FROM gray", "y x v")
    def _(s, d):
        nx, ny = f(c("x"), c("y"), X.WIDTH, X.rows_of_gray(s, d))
        return X.gray8(s, d).select(nx.alias("x"), ny.alias("y"), "v")


for _deg, _sx, _sy in ((90, f"{_H} - 1 - y", "x"), (180, "63 - x", f"{_H} - 1 - y"), (270, "y", "63 - x")):
    _placed(f"rotate{_deg}", _sx, _sy, lambda x, y, w, h, a=_deg: G.rotate(x, y, w, h, a))
for _how, _sx, _sy in (("horizontal", "63 - x", "y"), ("vertical", "x", f"{_H} - 1 - y"), ("both", "63 - x", f"{_H} - 1 - y")):
    _placed(f"mirror_{_how}", _sx, _sy, lambda x, y, w, h, a=_how: G.mirror(x, y, w, h, a))
for _o, _sx, _sy in ((1, "x", "y"), (2, "63 - x", "y"), (3, "63 - x", f"{_H} - 1 - y"), (4, "x", f"{_H} - 1 - y"), (5, "y", "x"), (6, f"{_H} - 1 - y", "x"), (7, f"{_H} - 1 - y", "63 - x"), (8, "y", "63 - x")):
    _placed(f"orientation_{_o}", _sx, _sy, lambda x, y, w, h, a=_o: G.upright(x, y, w, h, a))


@query("crop_margins", f"{X.GRAY} == SELECT y - 10 AS y, x - 8 AS x, v FROM gray WHERE x BETWEEN 8 AND 59 AND y BETWEEN 10 AND {_H} - 21", "y x v")
def _(s, d):
    return G.crop_margins(X.gray8(s, d), X.WIDTH, X.rows_of_gray(s, d), 8, 10, 4, 20)


@query("crop_edge", f"{X.GRAY} == SELECT y, x - 48 AS x, v FROM gray WHERE x >= 48", "y x v")
def _(s, d):
    return G.crop_edge(X.gray8(s, d), X.WIDTH, X.rows_of_gray(s, d), "right", 16)


@query("crop_zones", f"{X.GRAY} == SELECT y, x - 21 AS x, v FROM gray WHERE x BETWEEN 21 AND 41", "y x v")
def _(s, d):
    return G.zone(X.gray8(s, d), X.WIDTH, 2, 3, "x")


_REGIONS = [(1, 0, 0, 9, 9), (2, 5, 5, 30, 20), (3, 60, 100, 63, 120)]


def _regions(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_REGIONS, "region_id long, x1 long, y1 long, x2 long, y2 long")


_REG = f"reg(region_id, x1, y1, x2, y2) AS (VALUES {', '.join(map(str, _REGIONS))})"


@query("crop_regions", f"{X.GRAY}, {_REG} == SELECT region_id, y - y1 AS y, x - x1 AS x, v FROM gray JOIN reg ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2", "region_id y x v")
def _(s, d):
    return J.regions_of(X.gray8(s, d), _regions(s))


@query("composite_regions", f"{X.GRAY}, {_REG}, b AS (SELECT *, coalesce(sum(y2 - y1 + 1) OVER (ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM reg) == SELECT y - y1 + base AS y, x - x1 AS x, v FROM gray JOIN b ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2", "y x v")
def _(s, d):
    return J.composite(X.gray8(s, d), _regions(s))


@query("composite_beside", f"{X.GRAY}, {_REG}, b AS (SELECT *, coalesce(sum(x2 - x1 + 1) OVER (ORDER BY region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM reg) == SELECT y - y1 AS y, x - x1 + base AS x, v FROM gray JOIN b ON x BETWEEN x1 AND x2 AND y BETWEEN y1 AND y2", "y x v")
def _(s, d):
    return J.composite(X.gray8(s, d), _regions(s), "left")


# a5 at 4 dots an inch with margins of half an inch: 23 less 2 * 2 by 33 less 2 * 2
@query("page_sections", f"{X.RGB} == SELECT (y // 29)*3 + x // 19 AS section, count(*) AS n, sum(x % 19) AS sx, sum(y % 29) AS sy FROM rgb GROUP BY 1", "section n sx sy")
def _(s, d):
    px = G.page_sections(X.rgb8(s, d), X.RGB_WIDTH, X.rows_of_rgb(s, d), "a5", (4, 4), (0.5, 0.5))
    return px.groupBy("section").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("sections", f"{X.RGB}, h AS (SELECT (max(y) + 3) // 3 AS sh FROM rgb) == SELECT (y // sh)*3 + x // 17 AS section, count(*) AS n, sum(x % 17) AS sx, sum(y % sh) AS sy FROM rgb, h GROUP BY 1", "section n sx sy")
def _(s, d):
    px = G.sections(X.rgb8(s, d), X.RGB_WIDTH, X.rows_of_rgb(s, d), 3, 3)
    return px.groupBy("section").agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


@query("channel_extract", f"{X.RGB} == SELECT y, x, g AS v FROM rgb", "y x v")
def _(s, d):
    return R.extract_channel(X.rgb8(s, d), 1)


@query("tile_address", f"{X.GRAY} == SELECT (y // 16)*3 + x // 24 AS tile, count(*) AS n, sum(v) AS total FROM gray GROUP BY 1", "tile n total")
def _(s, d):
    t = G.tile_index(c("x"), c("y"), X.WIDTH, X.rows_of_gray(s, d), 24, 16)
    return X.gray8(s, d).groupBy(t.alias("tile")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("strip_address", f"{X.GRAY} == SELECT y // 7 AS strip, count(*) AS n, sum(v) AS total FROM gray GROUP BY 1", "strip n total")
def _(s, d):
    return X.gray8(s, d).groupBy(G.strip_index(c("y"), X.rows_of_gray(s, d), 7).alias("strip")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("size_maths", "== SELECT p_partkey AS w, (p_partkey*p_size*3 + 7)//8 AS line, (p_partkey*p_size + 7)//8 AS plane_line, (((p_partkey + 1)//2*6*8 + 7)//8)//2 AS sub_line, greatest(8192 // greatest((p_partkey*p_size*3 + 7)//8, 1), 1) AS strip_rows FROM part", "w line plane_line sub_line strip_rows")
def _(s, d):
    w, bits = c("p_partkey"), c("p_size")
    line = G.scanline_bytes(w, bits, 3)
    return X.table(s, d, "part").select(w.alias("w"), line.alias("line"), G.scanline_bytes(w, bits, 3, planar=True).alias("plane_line"), G.scanline_bytes(w, 8, 3, subsampling=(2, 2)).alias("sub_line"), G.default_rows_per_strip(line).alias("strip_rows"))


# layout
@query("tile_rechunk", f"{X.GRAY} == SELECT (y // 16)*3 + x // 24 AS tile, array_to_string(list(v ORDER BY y, x), ',') AS samples FROM gray GROUP BY 1", "tile", "samples")
def _(s, d):
    return R.rechunk(X.gray8(s, d), X.WIDTH, X.rows_of_gray(s, d), 24, 16).withColumn("samples", F.array_join(F.transform("samples", lambda v: v.cast("string")), ","))


@query("tile_unchunk", f"{X.GRAY} == SELECT y, x, v FROM gray", "y x v")
def _(s, d):
    h = X.rows_of_gray(s, d)
    return R.unchunk(R.rechunk(X.gray8(s, d), X.WIDTH, h, 24, 16), X.WIDTH, 24, 16)


@query("band_split", f"{X.RGB} == SELECT y, x, plane, v FROM (SELECT y, x, unnest([0, 1, 2]) AS plane, unnest([r, g, b]) AS v FROM rgb)", "y x plane v")
def _(s, d):
    return R.band_split(X.rgb8(s, d))


@query("band_merge", f"{X.RGB} == SELECT y, x, r, g, b FROM rgb", "y x r g b")
def _(s, d):
    return R.band_merge(R.band_split(X.rgb8(s, d)))


@query("page_select", f"{X.GRAY} == SELECT page AS dir_index, count(*) AS n, sum(v) AS total FROM gray WHERE page % 2 = 0 OR page = (SELECT max(page) FROM gray) GROUP BY 1", "dir_index n total")
def _(s, d):
    pages = X.gray8(s, d).groupBy(c("page").alias("dir_index")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    return R.select_pages(pages, "odd").union(R.select_pages(pages, "last")).distinct()


@query("page_concat", f"{X.GRAY}, p AS (SELECT page, sum(v) AS total FROM gray GROUP BY page), a AS (SELECT 0 AS source, row_number() OVER (ORDER BY page) - 1 AS dir_index, total FROM p WHERE page >= 3), n AS (SELECT count(*) AS n FROM a) == SELECT * FROM a UNION ALL SELECT 1, n + row_number() OVER (ORDER BY page) - 1, total FROM p, n WHERE page < 3", "source dir_index total")
def _(s, d):
    pages = X.gray8(s, d).groupBy(c("page").alias("dir_index")).agg(F.sum("v").alias("total"))
    return R.concat_pages(pages.where("dir_index >= 3"), pages.where("dir_index < 3"))


@query("split_names", "== SELECT o_orderkey AS n, CASE WHEN o_orderkey < 17576 THEN chr(CAST(97 + o_orderkey // 676 % 26 AS INTEGER)) || chr(CAST(97 + o_orderkey // 26 % 26 AS INTEGER)) || chr(CAST(97 + o_orderkey % 26 AS INTEGER)) END AS suffix FROM orders", "n", "suffix")
def _(s, d):
    return X.table(s, d, "orders").select(c("o_orderkey").alias("n"), R.split_name(c("o_orderkey")).alias("suffix"))


# joins
@query("bias_subtract", f"{X.BIAS} == SELECT g.y, g.x, greatest(g.v - b.v, 0) AS v FROM gray g JOIN bias b ON g.y = b.y AND g.x = b.x", "y x v")
def _(s, d):
    return J.bias_subtract(X.gray8(s, d), X.bias(s, d))


@query("image_diff", f"{X.GRAY}, low AS (SELECT y + 50 AS y, x, v FROM gray) == SELECT coalesce(g.y, b.y) AS y, coalesce(g.x, b.x) AS x, g.v AS lhs, b.v AS rhs FROM gray g FULL JOIN low b ON g.y = b.y AND g.x = b.x WHERE g.v IS DISTINCT FROM b.v", "y x lhs rhs")
def _(s, d):
    gray = X.gray8(s, d)
    return J.compare(gray, gray.select((c("y") + 50).alias("y"), "x", "v")).withColumnsRenamed({"left": "lhs", "right": "rhs"})


@query("image_diff_limit", f"{X.BIAS} == SELECT g.y, g.x, g.v AS lhs, b.v AS rhs FROM gray g JOIN bias b ON g.y = b.y AND g.x = b.x WHERE g.v <> b.v ORDER BY 1, 2 LIMIT 100", "y x lhs rhs")
def _(s, d):
    return J.compare(X.gray8(s, d), X.bias(s, d), limit=100).withColumnsRenamed({"left": "lhs", "right": "rhs"})


@query("tag_diff", "== SELECT coalesce(n_nationkey, r_regionkey) AS tag, n_name AS lhs, r_name AS rhs FROM nation FULL JOIN region ON n_nationkey = r_regionkey WHERE n_name IS DISTINCT FROM r_name", "tag", "lhs rhs")
def _(s, d):
    a = X.table(s, d, "nation").select(c("n_nationkey").alias("tag"), c("n_name").alias("v"))
    b = X.table(s, d, "region").select(c("r_regionkey").alias("tag"), c("r_name").alias("v"))
    return J.compare_tags(a, b).withColumnsRenamed({"left": "lhs", "right": "rhs"})


@query("tag_defaults", "== SELECT c_custkey AS tag, coalesce(nullif(c_nationkey, 3), 1) AS orientation FROM customer", "tag orientation")
def _(s, d):
    return X.table(s, d, "customer").select(c("c_custkey").alias("tag"), F.coalesce(F.nullif(c("c_nationkey"), F.lit(3)), F.lit(1)).alias("orientation"))


_NEAREST = f"{X.RGB}, {X.PALETTE}, k AS (SELECT DISTINCT r, g, b FROM rgb), m AS (SELECT k.r, k.g, k.b, min({{key}}) AS key FROM k, pal p GROUP BY ALL)"
_NEAREST = _NEAREST.replace("{key}", "((p.r-k.r)*(p.r-k.r) + (p.g-k.g)*(p.g-k.g) + (p.b-k.b)*(p.b-k.b))*64 + p.idx")


@query("nearest_palette", f"{_NEAREST} == SELECT r, g, b, key % 64 AS idx, key // 64 AS distance FROM m", "r g b idx distance")
def _(s, d):
    return J.nearest_palette(X.rgb8(s, d), X.palette(s, d))


@query("quantise", f"{_NEAREST} == SELECT y, x, key % 64 AS idx FROM rgb JOIN m USING (r, g, b)", "y x idx")
def _(s, d):
    return J.quantise(X.rgb8(s, d), X.palette(s, d))


# aggregates
@query("rgb_histogram", f"{X.RGB} == SELECT r//8 AS r5, g//8 AS g5, b//8 AS b5, count(*) AS n FROM rgb GROUP BY ALL", "r5 g5 b5 n")
def _(s, d):
    return A.rgb_histogram(X.rgb8(s, d))


@query("rgb_histogram_low_bits", f"{X.RGB} == SELECT r%32 AS r5, g%32 AS g5, b%32 AS b5, count(*) AS n FROM rgb GROUP BY ALL", "r5 g5 b5 n")
def _(s, d):
    return A.rgb_histogram(X.rgb8(s, d), low_bits=True)


@query("color_range", f"{X.RGB} == SELECT min(r) AS min_r, max(r) AS max_r, min(g) AS min_g, max(g) AS max_g, min(b) AS min_b, max(b) AS max_b FROM rgb", "min_r max_r min_g max_g min_b max_b")
def _(s, d):
    return A.color_range(X.rgb8(s, d))


@query("box_thumbnail", f"{X.GRAY} == SELECT y//8 AS y, x//8 AS x, 255*sum(CASE WHEN v > 128 THEN 1 ELSE 0 END)//count(*) AS v FROM gray GROUP BY y//8, x//8", "y x v")
def _(s, d):
    return A.box_thumbnail(X.gray8(s, d).select("y", "x", C.threshold(c("v")).alias("bit")), 8, 8)


@query("overview_nearest", f"{X.GRAY} == SELECT y//4 AS y, x//4 AS x, v FROM gray WHERE y%4 = 0 AND x%4 = 0", "y x v")
def _(s, d):
    return A.overview(X.gray8(s, d), 4)


@query("overview_avg", f"{X.GRAY} == SELECT y//2 AS y, x//2 AS x, sum(v)//count(*) AS v FROM gray GROUP BY y//2, x//2", "y x v")
def _(s, d):
    return A.overview(X.gray8(s, d), 2, "average")


@query("overview_pyramid", f"{X.GRAY} == " + " UNION ALL ".join(f"SELECT {n} AS level, y//{n} AS y, x//{n} AS x, sum(v)//count(*) AS v FROM gray GROUP BY y//{n}, x//{n}" for n in (2, 4, 8)), "level y x v")
def _(s, d):
    return A.pyramid(X.gray8(s, d))


@query("rgb_to_ycbcr_2x2", f"""{X.RGB}, p AS (SELECT y, x, r*0.299e0 + g*0.587e0 + b*0.114e0 AS luma, r, b FROM rgb),
 q AS (SELECT *, (b - luma)/(2 - 2*0.114e0) + 128 AS cb, (r - luma)/(2 - 2*0.299e0) + 128 AS cr FROM p) ==
 SELECT y//2 AS cy, x//2 AS cx, greatest(0, least(255, floor(round(avg(cb), 6) + 0.5))) AS cb, greatest(0, least(255, floor(round(avg(cr), 6) + 0.5))) AS cr,
 array_to_string(list(CAST(greatest(0, least(255, floor(round(luma, 6) + 0.5))) AS BIGINT) ORDER BY y, x), ',') AS luma FROM q GROUP BY y//2, x//2""", "cy cx cb cr", "luma")
def _(s, d):
    return A.ycbcr_clumps(X.rgb8(s, d)).withColumn("luma", F.array_join(F.transform("luma", lambda v: v.cast("bigint").cast("string")), ","))


@query("row_correlation", f"{X.GRAY} == SELECT a.y, round(corr(a.v, b.v), 9) AS corr FROM gray a JOIN gray b ON b.y = a.y + 1 AND b.x = a.x GROUP BY a.y", "y", "corr")
def _(s, d):
    return A.row_correlation(X.gray8(s, d)).withColumn("corr", F.round("corr", 9))


@query("predictor_encode", f"{X.GRAY} == SELECT y, x, (v - coalesce(lag(v) OVER (PARTITION BY y ORDER BY x), 0) + 256) % 256 AS v FROM gray", "y x v")
def _(s, d):
    return A.predictor_encode(X.gray8(s, d))


@query("predictor_decode", f"{X.GRAY} == SELECT y, x, v FROM gray", "y x v")
def _(s, d):
    return A.predictor_decode(A.predictor_encode(X.gray8(s, d)))


@query("bytecount_repair", "f AS (SELECT o_custkey AS file_id, o_orderkey*100 AS \"offset\", CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 80 END AS bytecount FROM orders) == SELECT file_id, \"offset\" AS start, CASE WHEN bytecount = 0 THEN coalesce(lead(\"offset\") OVER (PARTITION BY file_id ORDER BY \"offset\"), 100000000) - \"offset\" ELSE bytecount END AS bytecount FROM f", "file_id start bytecount")
def _(s, d):
    f = X.table(s, d, "orders").select(c("o_custkey").alias("file_id"), (c("o_orderkey") * 100).alias("offset"), F.when(c("o_orderkey") % 3 == 0, 0).otherwise(80).alias("bytecount"), F.lit(100000000).alias("file_size"))
    return A.estimate_bytecounts(f).withColumnRenamed("offset", "start")


# colour spaces with real numbers
_LAB = f"{X.RGB}, lab AS (SELECT y AS row, x AS col, r / 2.55 AS l, CAST(g - 128 AS DOUBLE) AS a, CAST(b - 128 AS DOUBLE) AS bb FROM rgb), f AS (SELECT *, CASE WHEN l < 8.856 THEN 7.787 * (l / 903.3) + 16.0e0/116.0e0 ELSE (l + 16.0e0) / 116.0e0 END AS fy FROM lab), t AS (SELECT *, CASE WHEN l < 8.856 THEN l * 100.0e0 / 903.292e0 ELSE 100.0e0 * fy * fy * fy END AS yy, fy + a / 500.0e0 AS tx, fy - bb / 200.0e0 AS tz FROM f)"
_CUBE = lambda t, w: f"CASE WHEN {t} < 0.2069e0 THEN ({t} - 0.13793e0) * {w}e0 / 7.787e0 ELSE {w}e0 * {t} * {t} * {t} END"


@query("lab_to_xyz", f"{_LAB} == SELECT row, col, round({_CUBE('tx', 96.42)}, 6) AS xx, round(yy, 6) AS yy, round({_CUBE('tz', 82.49)}, 6) AS zz FROM t", "row col", "xx yy zz")
def _(s, d):
    xyz = C.lab_to_xyz(c("r") / 2.55, (c("g") - 128).cast("double"), (c("b") - 128).cast("double"))
    return X.rgb8(s, d).select(c("y").alias("row"), c("x").alias("col"), *(F.round(v, 6).alias(k) for k, v in zip(("xx", "yy", "zz"), xyz, strict=True)))


_LIGHT = ("2.690e0*r/255 + -1.276e0*g/255 + -0.414e0*b/255", "-1.022e0*r/255 + 1.978e0*g/255 + 0.044e0*b/255", "0.061e0*r/255 + -0.224e0*g/255 + 1.163e0*b/255")


@query("xyz_to_rgb24", f"{X.RGB} == SELECT y, x, " + ", ".join(f"CASE WHEN {e} <= 0 THEN 0 WHEN {e} >= 1 THEN 255 ELSE floor(256*sqrt(greatest({e}, 0))) END AS {n}" for e, n in zip(_LIGHT, ("r2", "g2", "b2"), strict=True)) + " FROM (SELECT y, x, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM rgb)", "y x r2 g2 b2")
def _(s, d):
    return X.rgb8(s, d).select("y", "x", *(v.alias(k) for k, v in zip(("r2", "g2", "b2"), C.xyz_to_rgb24(c("r"), c("g"), c("b"), 255), strict=True)))


@query("logl10_to_y", f"{X.GRAY} == SELECT y, x, CASE WHEN v = 0 THEN 0.0 ELSE round(exp(0.693147180559945309417/64.0*(v*4 + 0.5) - 0.693147180559945309417*12.0), 9) END AS lum FROM gray", "y x", "lum")
def _(s, d):
    return X.gray8(s, d).select("y", "x", F.round(C.logl10_to_y(c("v") * 4), 9).alias("lum"))


@query("logl16_from_y", f"{X.GRAY} == SELECT y, x, CASE WHEN v = 0 THEN 0 ELSE floor(256.0e0*(log2(v + 0.3e0) + 64.0e0)) END AS code FROM gray", "y x code")
def _(s, d):
    return X.gray8(s, d).select("y", "x", C.logl16_from_y(F.when(c("v") == 0, 0.0).otherwise(c("v") + 0.3)).alias("code"))


@query("transfer_curve", "== SELECT i, CASE WHEN i = 0 THEN 0 ELSE floor(65535.0e0*pow(i/255.0e0, 2.2e0) + 0.5e0) END AS v FROM range(256) t(i)", "i v")
def _(s, d):
    return s.range(1).select(F.posexplode(C.transfer_curve(8)).alias("i", "v"))


@query("checked_multiply", "== SELECT l_orderkey AS k, l_linenumber AS n, TRY_CAST(CAST(l_orderkey + 1 AS HUGEINT) * 9000000000000000 AS BIGINT) AS product FROM lineitem", "k n product")
def _(s, d):
    product = F.try_multiply((c("l_orderkey") + 1).cast("bigint"), F.lit(9000000000000000))
    return X.table(s, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_linenumber").alias("n"), product.alias("product"))


# files: rasters are encoded, and read back from their bytes
BLOCK = 256


def _files(s: SparkSession, d: str, **how) -> DataFrame:
    """A file for each 256 rows of gray, its pages the labels modulo 3."""
    px = X.gray8(s, d).select(C.idiv(c("y"), BLOCK).cast("string").alias("path"), (c("page") % 3).alias("dir_index"), F.lit(0).alias("plane"), "y", "x", "v")
    return raster.encode_rasters(px, **how)


_FILED = f"{X.GRAY}, p AS (SELECT y // {BLOCK} AS block, page % 3 AS third, y, x, v FROM gray), pages AS (SELECT block, third, row_number() OVER (PARTITION BY block ORDER BY third) - 1 AS dir_index, count(*)//64 AS h FROM p GROUP BY 1, 2), f AS (SELECT block, dir_index, h, dense_rank() OVER (PARTITION BY block, third ORDER BY y) - 1 AS y, x, v FROM p JOIN pages USING (block, third))"
_HOW = {
    "lzw_strips": {"compression": codecs.LZW, "rows": 5}, "zstd_tiles": {"compression": codecs.ZSTD, "tile": (16, 32)}, "deflate_predictor": {"compression": codecs.DEFLATE_ADOBE, "predictor": 2, "order": ">"},
    "packbits_big": {"compression": codecs.PACKBITS, "big": True}, "lzma": {"compression": codecs.LZMA},
}
for _name, _how in _HOW.items():

    @query(f"file_pixels_{_name}", f"{_FILED} == SELECT block, dir_index, y, x, v FROM f", "block dir_index y x v")
    def _(s, d, how=_how):
        return raster.pixels(raster.scanlines(_files(s, d, **how))).withColumnRenamed("path", "block")


@query("file_pixels_12bit", f"{_FILED} == SELECT block, dir_index, y, x, v*16 + x % 16 AS v FROM f", "block dir_index y x v")
def _(s, d):
    px = X.gray8(s, d).select(C.idiv(c("y"), BLOCK).cast("string").alias("path"), (c("page") % 3).alias("dir_index"), F.lit(0).alias("plane"), "y", "x", (c("v") * 16 + c("x") % 16).alias("v"))
    return raster.pixels(raster.scanlines(raster.encode_rasters(px, dtype="u2", bits=12, compression=codecs.LZW))).withColumnRenamed("path", "block")


@query("file_ycbcr_thinned", f"""{X.GRAY} == SELECT y // {BLOCK} AS block, y % {BLOCK} AS y, x, unnest([0, 1, 2]) AS plane,
    unnest([v, x // 2 * 3 % 256, y % {BLOCK} // 2 * 5 % 256]) AS v FROM gray""", "block y x plane v")
def _(s, d):
    chroma = C.idiv(c("x"), 2) * 3 % 256, C.idiv(c("y") % BLOCK, 2) * 5 % 256
    px = X.gray8(s, d).select(C.idiv(c("y"), BLOCK).cast("string").alias("path"), F.lit(0).alias("dir_index"), "y", "x", F.posexplode(F.array("v", *chroma)).alias("plane", "v"))
    files = raster.encode_rasters(px, photometric=6, subsampling=(2, 2), compression=codecs.DEFLATE_ADOBE)
    return raster.pixels(raster.scanlines(files)).withColumnRenamed("path", "block")


@query("file_window", f"{_FILED} == SELECT block, dir_index, y, x, v FROM f WHERE x BETWEEN 20 AND 29 AND y BETWEEN 8 AND 12 AND dir_index = 1", "block dir_index y x v")
def _(s, d):
    lines = raster.scanlines(_files(s, d, tile=(16, 16)), pages=[1], window=(20, 8, 29, 12))
    return raster.pixels(lines).where("x BETWEEN 20 AND 29 AND y BETWEEN 8 AND 12").withColumnRenamed("path", "block")


@query("file_directories", f"{_FILED} == SELECT block, dir_index, 64 AS width, h AS length, 8 AS bits, (h + 15)//16 AS n_chunks FROM pages", "block dir_index width length bits n_chunks")
def _(s, d):
    return raster.directories(_files(s, d, rows=16)).withColumnRenamed("path", "block")


@query("file_tags", f"{_FILED} == SELECT block, dir_index, unnest([256, 257, 259]) AS tag, unnest([64, h, 5]) AS value FROM pages", "block dir_index tag value")
def _(s, d):
    return raster.tags(_files(s, d, compression=codecs.LZW)).where("tag IN (256, 257, 259)").select(c("path").alias("block"), "dir_index", "tag", F.get_json_object("value", "$[0]").alias("value"))


@query("file_chunks", f"{_FILED} == SELECT block, dir_index, k AS chunk, k*16 AS y0, least(16, h - k*16) AS rows, least(16, h - k*16)*64 AS bytecount FROM (SELECT *, unnest(range((h + 15)//16)) AS k FROM pages)", "block dir_index chunk y0 rows bytecount")
def _(s, d):
    return raster.chunks(_files(s, d, rows=16), raw=False).withColumnsRenamed({"path": "block", "h": "rows"})


@query("file_recode", f"{_FILED} == SELECT block, dir_index, count(*) AS n, sum(v) AS total, sum(v*(y*64 + x)) AS placed FROM f GROUP BY 1, 2", "block dir_index n total placed")
def _(s, d):
    px = raster.pixels(raster.scanlines(raster.recode(_files(s, d), compression=codecs.DEFLATE_ADOBE, tile=(32, 16), big=True)))
    return px.groupBy(c("path").alias("block"), "dir_index").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(c("v") * (c("y") * 64 + c("x"))).alias("placed"))


@query("file_split", f"{_FILED} == SELECT block || '-aa' || chr(CAST(97 + dir_index AS INTEGER)) || '.tif' AS path, count(*) AS n, sum(v) AS total FROM f GROUP BY 1", "n total", "path")
def _(s, d):
    px = raster.pixels(raster.scanlines(raster.split_pages(_files(s, d))))
    return px.groupBy("path").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("file_unlink", f"{_FILED} == SELECT block, dir_index - 1 AS dir_index, count(*) AS n, sum(v) AS total FROM f WHERE dir_index > 0 GROUP BY 1, 2", "block dir_index n total")
def _(s, d):
    px = raster.pixels(raster.scanlines(edits.edit(_files(s, d), lambda b: edits.unlink_page(b, 0))))
    return px.groupBy(c("path").alias("block"), "dir_index").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("file_set_tags", f"{_FILED} == SELECT block, dir_index, CASE WHEN dir_index = 0 THEN 6 ELSE 1 END AS orientation FROM pages", "block dir_index orientation")
def _(s, d):
    return raster.directories(edits.edit(_files(s, d), lambda b: edits.set_tags(b, 0, {274: (3, [6])}))).withColumnRenamed("path", "block")


@query("file_chop_strips", f"{_FILED} == SELECT block, dir_index, CASE WHEN dir_index = 0 THEN (h + 15)//16 ELSE 1 END AS n_chunks FROM pages", "block dir_index n_chunks")
def _(s, d):
    return raster.directories(edits.edit(_files(s, d, rows=1 << 20), lambda b: edits.chop_strips(b, 0, 1024))).withColumnRenamed("path", "block")


@query("file_to_pdf", f"{_FILED} == SELECT block, count(*) AS pages FROM pages GROUP BY 1", "block pages")
def _(s, d):
    made = export.to_pdf(_files(s, d))
    return made.select(F.regexp_replace("path", r"\.pdf$", "").alias("block"), F.regexp_extract(c("content").cast("string"), r"/Type /Pages /Count (\d+)", 1).alias("pages"))


@query("file_to_postscript", f"{_FILED} == SELECT block, count(*) AS pages FROM pages GROUP BY 1", "block pages")
def _(s, d):
    made = export.to_postscript(_files(s, d))
    return made.select(F.regexp_replace("path", r"\.ps$", "").alias("block"), F.regexp_extract(c("content").cast("string"), r"%%Pages: (\d+)", 1).alias("pages"))


# sequential algorithms and codecs: beyond SQL
@query("dither_fs")
def _(s, d):
    return S.dither(X.gray8(s, d).withColumn("image_id", C.idiv(c("y"), 50)))


@query("median_cut")
def _(s, d):
    return S.palette_frame(s, S.median_cut(A.rgb_histogram(X.rgb8(s, d)), 64))


@query("quantise_median_cut")
def _(s, d):
    return J.quantise(X.rgb8(s, d), S.palette_frame(s, S.median_cut(A.rgb_histogram(X.rgb8(s, d)), 64))).select("y", "x", "idx")


@query("rational", "== SELECT p_partkey AS part, round(p_retailprice / 7, 6) AS v FROM part", "part", "v")
def _(s, d):
    p = X.table(s, d, "part").select(c("p_partkey").alias("part"), (c("p_retailprice") / 7).alias("v")).withColumn("q", S.to_rational("v"))
    return p.select("part", F.round(c("q.num") / c("q.den"), 6).alias("v"))


STRIP = 16


def _strips(s: SparkSession, d: str) -> DataFrame:
    """(strip, rows): STRIP rows of gray as one chunk, (y, samples) in order."""
    lines = R.scanlines(X.gray8(s, d))
    return lines.groupBy(C.idiv(c("y"), STRIP).alias("strip")).agg(F.array_sort(F.collect_list(F.struct("y", "samples"))).alias("lines"))


def _round_trip(scheme: int) -> Callable[[SparkSession, str], DataFrame]:
    """Whole strips of many rows encoded and decoded: the decoded samples, pixel by pixel. Facsimile codecs take the bytes as bits."""

    def run(s: SparkSession, d: str) -> DataFrame:
        bilevel = scheme in (codecs.CCITT_RLE, codecs.CCITT_RLEW, codecs.CCITT_G3, codecs.CCITT_G4)

        @F.pandas_udf("array<array<int>>")
        def decoded(strips: pd.Series) -> pd.Series:
            out = []
            for lines in strips:
                x = np.stack([np.asarray(line["samples"], np.uint8) for line in lines])
                how = {"size": x.size, "row": x.shape[1], "width": x.shape[1] * (8 if bilevel else 1), "rows": len(x), "samples": 1, "bits": 1 if bilevel else 8, "options": 1}
                back = codecs.decode(scheme, codecs.encode(scheme, x.tobytes(), **how), **how)
                out.append(np.frombuffer(back, np.uint8).reshape(x.shape).astype(np.int32).tolist())
            return pd.Series(out)

        made = _strips(s, d).select(F.arrays_zip(c("lines.y").alias("y"), decoded("lines").alias("samples")).alias("z"))
        return made.select(F.inline("z")).select("y", F.posexplode("samples").alias("x", "v"))

    return run


def _near_trip(scheme: int) -> Callable[[SparkSession, str], DataFrame]:
    """Codecs of logarithms: samples come back within half a step."""

    def run(s: SparkSession, d: str) -> DataFrame:
        @F.pandas_udf("boolean")
        def near(rows: pd.Series) -> pd.Series:
            out = []
            for row in rows:
                x = np.asarray(row, np.float32) / np.float32(255)
                how = {"size": x.nbytes, "row": x.nbytes, "width": len(x), "rows": 1, "samples": 1, "bits": 32}
                back = np.frombuffer(codecs.decode(scheme, codecs.encode(scheme, x.tobytes(), **how), **how), np.float32)
                out.append(bool(np.allclose(back, x, rtol=0.003, atol=1e-4)))
            return pd.Series(out)

        return R.scanlines(X.gray8(s, d)).select("y", F.size("samples").cast("bigint").alias("n"), near("samples").alias("near"))

    return run


for _scheme, (_name, _dec, _enc) in list(codecs.CODECS.items()):
    if _scheme in (codecs.SGILOG, codecs.PIXARLOG):
        query(f"codec_near_{_name}", "== SELECT vec_id AS y, len(embedding) AS n, true AS near FROM embeddings", "y n", "near")(_near_trip(_scheme))
    elif _dec and _enc and _scheme not in (codecs.JPEG, codecs.SGILOG24):
        query(f"codec_roundtrip_{_name.replace('-', '_')}", f"{X.GRAY} == SELECT y, x, v FROM gray", "y x v")(_round_trip(_scheme))


@query("codec_near_jpeg", f"{X.GRAY} == SELECT y, 64 AS n, true AS near FROM gray GROUP BY y", "y n", "near")
def _(s, d):
    @F.pandas_udf("boolean")
    def near(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            x = np.asarray(row, np.uint8)
            how = {"width": len(x), "rows": 1, "samples": 1, "quality": 100}
            back = np.frombuffer(codecs.decode(codecs.JPEG, codecs.encode(codecs.JPEG, x.tobytes(), **how), **how), np.uint8)
            out.append(bool(np.abs(back.astype(int) - x).max() <= 2))
        return pd.Series(out)

    return R.scanlines(X.gray8(s, d)).select("y", F.size("samples").alias("n"), near("samples").alias("near"))


@query("codec_near_sgilog24", f"{X.GRAY} == SELECT y, 64 AS n, true AS near FROM gray GROUP BY y", "y n", "near")
def _(s, d):
    @F.pandas_udf("boolean")
    def near(rows: pd.Series) -> pd.Series:
        out = []
        for row in rows:
            y = np.asarray(row, np.float32) / np.float32(255) + np.float32(0.01)
            x = np.stack([y * np.float32(0.95), y, y * np.float32(1.09)], axis=-1)
            how = {"width": len(row), "rows": 1, "samples": 3, "bits": 32}
            back = np.frombuffer(codecs.decode(codecs.SGILOG24, codecs.encode(codecs.SGILOG24, x.tobytes(), **how), **how), np.float32).reshape(-1, 3)
            out.append(bool(np.allclose(back[:, 1], y, rtol=0.006) and np.allclose(back, x, rtol=0.05)))
        return pd.Series(out)

    return R.scanlines(X.gray8(s, d)).select("y", F.size("samples").alias("n"), near("samples").alias("near"))


@query("file_rgba", f"{_FILED} == SELECT block, dir_index, y, x, v + (255 - v)*256 + (v*7 % 256)*65536 + 4278190080 AS abgr FROM f", "block dir_index y x abgr")
def _(s, d):
    planes = F.posexplode(F.array(c("v"), 255 - c("v"), c("v") * 7 % 256)).alias("plane", "v")
    px = X.gray8(s, d).select(C.idiv(c("y"), BLOCK).cast("string").alias("path"), (c("page") % 3).alias("dir_index"), "y", "x", planes)
    rows = export.rgba(raster.encode_rasters(px, compression=codecs.LZW))
    return rows.select(c("path").alias("block"), "dir_index", "y", F.posexplode("abgr").alias("x", "abgr"))


# two images in one table: operators keep them apart by their key
def _images(s: SparkSession, d: str) -> DataFrame:
    gray = X.gray8(s, d).select("y", "x", "v")
    return gray.select(F.lit(0).alias("image"), "y", "x", "v").union(gray.select(F.lit(1), "y", "x", (255 - c("v")) * c("x") % 256))


def _colors(s: SparkSession, d: str) -> DataFrame:
    rgb = X.rgb8(s, d)
    return rgb.select(F.lit(0).alias("image"), "y", "x", "r", "g", "b").union(rgb.select(F.lit(1), "y", "x", "b", "r", 255 - c("g")))


_IMG = f"{X.GRAY}, img AS (SELECT 0 AS image, y, x, v FROM gray UNION ALL SELECT 1, y, x, (255 - v)*x % 256 FROM gray)"
_COL = f"{X.RGB}, col AS (SELECT 0 AS image, y, x, r, g, b FROM rgb UNION ALL SELECT 1, y, x, b, r, 255 - g FROM rgb)"
_KEY = ("image",)


@query("images_overview", f"{_IMG} == SELECT image, y//2 AS y, x//2 AS x, sum(v)//count(*) AS v FROM img GROUP BY image, y//2, x//2", "image y x v")
def _(s, d):
    return A.overview(_images(s, d), 2, "average", _KEY)


@query("images_pyramid", f"{_IMG} == " + " UNION ALL ".join(f"SELECT image, {n} AS level, y//{n} AS y, x//{n} AS x, sum(v)//count(*) AS v FROM img GROUP BY image, y//{n}, x//{n}" for n in (2, 4, 8)), "image level y x v")
def _(s, d):
    return A.pyramid(_images(s, d), keys=_KEY)


@query("images_box_thumbnail", f"{_IMG} == SELECT image, y//8 AS y, x//8 AS x, 255*sum(CASE WHEN v > 128 THEN 1 ELSE 0 END)//count(*) AS v FROM img GROUP BY image, y//8, x//8", "image y x v")
def _(s, d):
    return A.box_thumbnail(_images(s, d).select("image", "y", "x", C.threshold(c("v")).alias("bit")), 8, 8, _KEY)


@query("images_rechunk", f"{_IMG} == SELECT image, (y // 16)*3 + x // 24 AS tile, array_to_string(list(v ORDER BY y, x), ',') AS samples FROM img GROUP BY 1, 2", "image tile", "samples")
def _(s, d):
    sized = _images(s, d).withColumns({"w": F.lit(X.WIDTH), "h": F.lit(X.rows_of_gray(s, d))})
    return R.rechunk(sized, c("w"), c("h"), 24, 16, _KEY).withColumn("samples", F.array_join(F.transform("samples", lambda v: v.cast("string")), ","))


@query("images_unchunk", f"{_IMG} == SELECT image, y, x, v FROM img", "image y x v")
def _(s, d):
    tiles = R.rechunk(_images(s, d), X.WIDTH, X.rows_of_gray(s, d), 24, 16, _KEY)
    return R.unchunk(tiles.withColumn("w", F.lit(X.WIDTH)), c("w"), 24, 16, _KEY)


@query("images_band_split", f"{_COL} == SELECT image, y, x, plane, v FROM (SELECT image, y, x, unnest([0, 1, 2]) AS plane, unnest([r, g, b]) AS v FROM col)", "image y x plane v")
def _(s, d):
    return R.band_split(_colors(s, d), keys=_KEY)


@query("images_band_merge", f"{_COL} == SELECT image, y, x, r, g, b FROM col", "image y x r g b")
def _(s, d):
    return R.band_merge(R.band_split(_colors(s, d), keys=_KEY), keys=_KEY)


@query("images_histogram", f"{_COL} == SELECT image, r//8 AS r5, g//8 AS g5, b//8 AS b5, count(*) AS n FROM col GROUP BY ALL", "image r5 g5 b5 n")
def _(s, d):
    return A.rgb_histogram(_colors(s, d), keys=_KEY)


@query("images_color_range", f"{_COL} == SELECT image, min(r) AS min_r, max(r) AS max_r, min(g) AS min_g, max(g) AS max_g, min(b) AS min_b, max(b) AS max_b FROM col GROUP BY image", "image min_r max_r min_g max_g min_b max_b")
def _(s, d):
    return A.color_range(_colors(s, d), _KEY)


@query("images_ycbcr_2x2", f"""{_COL}, p AS (SELECT image, y, x, r*0.299e0 + g*0.587e0 + b*0.114e0 AS luma, r, b FROM col),
 q AS (SELECT *, (b - luma)/(2 - 2*0.114e0) + 128 AS cb, (r - luma)/(2 - 2*0.299e0) + 128 AS cr FROM p) ==
 SELECT image, y//2 AS cy, x//2 AS cx, greatest(0, least(255, floor(round(avg(cb), 6) + 0.5))) AS cb, greatest(0, least(255, floor(round(avg(cr), 6) + 0.5))) AS cr,
 array_to_string(list(CAST(greatest(0, least(255, floor(round(luma, 6) + 0.5))) AS BIGINT) ORDER BY y, x), ',') AS luma FROM q GROUP BY image, y//2, x//2""", "image cy cx cb cr", "luma")
def _(s, d):
    return A.ycbcr_clumps(_colors(s, d), keys=_KEY).withColumn("luma", F.array_join(F.transform("luma", lambda v: v.cast("bigint").cast("string")), ","))


@query("images_row_correlation", f"{_IMG} == SELECT a.image, a.y, round(corr(a.v, b.v), 9) AS corr FROM img a JOIN img b ON b.image = a.image AND b.y = a.y + 1 AND b.x = a.x GROUP BY a.image, a.y", "image y", "corr")
def _(s, d):
    return A.row_correlation(_images(s, d), _KEY).withColumn("corr", F.round("corr", 9))


@query("images_predictor", f"{_IMG} == SELECT image, y, x, (v - coalesce(lag(v) OVER (PARTITION BY image, y ORDER BY x), 0) + 256) % 256 AS v FROM img", "image y x v")
def _(s, d):
    return A.predictor_encode(_images(s, d), keys=_KEY)


@query("images_predictor_undone", f"{_IMG} == SELECT image, y, x, v FROM img", "image y x v")
def _(s, d):
    return A.predictor_decode(A.predictor_encode(_images(s, d), keys=_KEY), keys=_KEY)


@query("images_scanlines", f"{_IMG} == SELECT image, y, array_to_string(list(v ORDER BY x), ',') AS samples FROM img GROUP BY 1, 2", "image y", "samples")
def _(s, d):
    return R.scanlines(_images(s, d), ("image", "y")).withColumn("samples", F.array_join(F.transform("samples", lambda v: v.cast("string")), ","))


# regions dealt out to files and pages, by each way of export
_EXPORT = {
    "combined": ("0", "dense_rank() OVER (ORDER BY image) - 1"), "divided": ("0", "dense_rank() OVER (ORDER BY image, region) - 1"), "image": ("dense_rank() OVER (ORDER BY image) - 1", "0"),
    "multiple": ("dense_rank() OVER (ORDER BY image) - 1", "dense_rank() OVER (PARTITION BY image ORDER BY region) - 1"), "separated": ("dense_rank() OVER (ORDER BY image, region) - 1", "0"),
}
for _how, (_file, _page) in _EXPORT.items():

    @query(f"export_{_how}", f"== SELECT n_regionkey AS image, n_nationkey AS region, {_file} AS file, {_page} AS page FROM nation", "image region file page")
    def _(s, d, how=_how):
        return R.export_groups(X.table(s, d, "nation").select(c("n_regionkey").alias("image"), c("n_nationkey").alias("region")), how)


# colour with a reference of black and white, and on a display
_REF = (16.0, 235.0, 128.0, 240.0, 128.0, 240.0)
_SPREAD = "SELECT y, x, CAST(trunc((r - 16)*255e0/219e0) AS BIGINT) AS l, CAST(trunc((g - 128)*127e0/112e0) AS BIGINT) AS cb, CAST(trunc((b - 128)*127e0/112e0) AS BIGINT) AS cr FROM rgb"


@query("ycbcr_reference", f"""{X.RGB}, s AS ({_SPREAD}) == SELECT y, x, greatest(0, least(255, l + CAST(floor((cr*91881 + 32768)/65536.0) AS BIGINT))) AS r2,
 greatest(0, least(255, l + CAST(floor((-(cr*46802) - cb*22553 + 32768)/65536.0) AS BIGINT))) AS g2, greatest(0, least(255, l + CAST(floor((cb*116130 + 32768)/65536.0) AS BIGINT))) AS b2 FROM s""", "y x r2 g2 b2")
def _(s, d):
    return X.rgb8(s, d).select("y", "x", *(v.alias(k) for k, v in zip(("r2", "g2", "b2"), C.ycbcr_to_rgb(c("r"), c("g"), c("b"), reference=_REF), strict=True)))


@query("default_reference", "== SELECT * FROM (VALUES (2, 8, '0,255,0,255,0,255'), (6, 8, '0,255,128,255,128,255'), (2, 4, '0,15,0,15,0,15'), (6, 16, '0,65535,32768,65535,32768,65535')) t(photometric, bits, v)", "photometric bits", "v")
def _(s, d):
    rows = [(p, b, ",".join(str(int(v)) for v in C.default_reference(p, b))) for p, b in ((2, 8), (6, 8), (2, 4), (6, 16))]
    return s.createDataFrame(rows, "photometric int, bits int, v string")


_SHOWN = [f"floor(255*pow(least(floor((greatest(least({e}, 100e0), 1e0) - 1e0)/0.066e0), 1500)/1500e0, 1/2.4e0) + 0.5)" for e in ("u*3.2410e0 + v*(-1.5374e0) + w*(-0.4986e0)", "u*(-0.9692e0) + v*1.8760e0 + w*0.0416e0", "u*0.0556e0 + v*(-0.2040e0) + w*1.0570e0")]


@query("xyz_to_display", f"{X.RGB}, p AS (SELECT y, x, r/2.5e0 AS u, g/2.5e0 AS v, b/2.5e0 AS w FROM rgb) == SELECT y, x, {', '.join(f'{e} AS {n}' for e, n in zip(_SHOWN, ('r2', 'g2', 'b2'), strict=True))} FROM p", "y x r2 g2 b2")
def _(s, d):
    return X.rgb8(s, d).select("y", "x", *(v.alias(k) for k, v in zip(("r2", "g2", "b2"), C.xyz_to_rgb_display(c("r") / 2.5, c("g") / 2.5, c("b") / 2.5), strict=True)))


@query("clamp", f"{X.GRAY} == SELECT y, x, greatest(least(v, 200), 40) AS v FROM gray", "y x v")
def _(s, d):
    return X.gray8(s, d).select("y", "x", C.clamp(c("v"), 40, 200).alias("v"))


@query("contrast_curve", "== SELECT i, 255 - floor(255*(1 - exp(-(i/255e0)/0.5e0))/(1 - exp(-1/0.5e0)) + 0.5) AS v FROM range(256) t(i)", "i v")
def _(s, d):
    return s.range(1).select(F.posexplode(C.contrast_curve(50.0)).alias("i", "v"))


# writers
@query("file_concat", f"{_FILED}, p AS (SELECT block, dir_index, h, row_number() OVER (PARTITION BY block % 2 ORDER BY CAST(block AS VARCHAR), dir_index) - 1 AS page FROM pages) == SELECT block % 2 AS target, page AS dir_index, count(*) AS n, sum(v) AS total, sum(v*(y*64 + x)) AS placed FROM f JOIN p USING (block, dir_index) GROUP BY 1, 2".replace("p AS (SELECT block, dir_index", "q AS (SELECT block, dir_index").replace("JOIN p USING", "JOIN q USING"), "target dir_index n total placed")
def _(s, d):
    joined = writers.concat_files(_files(s, d, compression=codecs.DEFLATE_ADOBE), c("path").cast("int") % 2, order=">", big=True)
    px = raster.pixels(raster.scanlines(joined))
    return px.groupBy(c("path").alias("target"), "dir_index").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(c("v") * (c("y") * 64 + c("x"))).alias("placed"))


@query("file_grow", f"{_FILED} == SELECT block, dir_index, CASE WHEN dir_index = 0 THEN h + 5 ELSE h END AS length, (CASE WHEN dir_index = 0 THEN h + 5 ELSE h END + 15)//16 AS n_chunks FROM pages", "block dir_index length n_chunks")
def _(s, d):
    more = np.arange(5 * X.WIDTH, dtype=np.uint8).reshape(5, X.WIDTH, 1)
    return raster.directories(edits.edit(_files(s, d, rows=16, compression=codecs.ZSTD), lambda b: writers.grow(b, 0, more))).withColumnRenamed("path", "block")


@query("file_write_scanlines", f"{_FILED} == SELECT block, dir_index, y, x, CASE WHEN dir_index = 0 AND y BETWEEN 3 AND 21 THEN (y - 3)*3 + x ELSE v END AS v FROM f", "block dir_index y x v")
def _(s, d):
    rows = (np.arange(19)[:, None] * 3 + np.arange(X.WIDTH)[None, :]).astype(np.uint8)[:, :, None]

    def change(content: bytes) -> bytes:
        height = container.parse(content).directories[0].get("length")
        return writers.write_scanlines(content, 0, 3, rows[: max(0, height - 3)])

    return raster.pixels(raster.scanlines(edits.edit(_files(s, d, rows=16, compression=codecs.LZW), change))).withColumnRenamed("path", "block")


@query("file_custom_directories", f"{_FILED} == SELECT block, unnest(['exposure_time', 'iso_speed_ratings', 'gps_latitude_ref']) AS name, unnest(['[[1, 250]]', '[400]', '\"N\"']) AS value FROM (SELECT DISTINCT block FROM pages)", "block", "name value")
def _(s, d):
    def change(content: bytes) -> bytes:
        content = writers.write_sub_directory(content, 0, "exif", {33434: (5, [(1, 250)]), 34855: (3, [400])})
        return writers.write_sub_directory(content, 0, "gps", {1: (2, "N")})

    return raster.tags(edits.edit(_files(s, d), change)).where("kind IN ('exif', 'gps')").select(c("path").alias("block"), "name", "value")


@query("file_dump", f"{_FILED} == SELECT block, count(*) AS n, 256*count(*) AS widths FROM pages GROUP BY 1", "block n widths")
def _(s, d):
    one = writers.dump(_files(s, d)).where("tag = 256")
    return one.withColumn("w", F.when(F.substring(F.hex("bytes"), 1, 2) == "40", 256)).groupBy(c("path").alias("block")).agg(F.count("*").alias("n"), F.sum("w").alias("widths"))


# sequential algorithms per image
@query("dither_palette")
def _(s, d):
    images = X.rgb8(s, d).withColumn("image_id", C.idiv(c("y"), 50))
    return S.dither_palette(images, S.median_cut(A.rgb_histogram(X.rgb8(s, d)), 16))
