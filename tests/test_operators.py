"""Operators against plain versions, where SQL doesn't reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import color, geometry
from mosaiq.operators import aggregates, joins, sequential


def test_rotations_invert(spark):
    px = spark.range(12).select((F.col("id") % 4).alias("x"), F.floor(F.col("id") / 4).alias("y"))
    x, y = geometry.rotate(F.col("x"), F.col("y"), 4, 3, 90)
    turned = px.select("x", "y", x.alias("u"), y.alias("v"))
    bx, by = geometry.rotate(F.col("u"), F.col("v"), 3, 4, 270)
    assert turned.where((bx != F.col("x")) | (by != F.col("y"))).count() == 0
    with pytest.raises(ValueError):
        geometry.rotate(F.col("x"), F.col("y"), 4, 3, 45)


def test_diffusion_keeps_the_mean():
    image = np.full((64, 64), 100)
    assert abs(sequential.diffuse(image).mean() * 255 - 100) < 3
    assert sequential.diffuse(image, lag=True).shape == (64, 64)
    assert sequential.diffuse(np.zeros((0, 0))).size == 0


def test_median_cut(spark):
    px = spark.createDataFrame([(0, 0, 0)] * 5 + [(255, 255, 255)] * 3 + [(255, 0, 0)], "r int, g int, b int")
    found = sequential.median_cut(aggregates.rgb_histogram(px), 3)
    assert len(found) == 3 and found[0] == (4, 4, 4)
    assert sequential.median_cut(aggregates.rgb_histogram(px.limit(0)), 3) == []


def test_rational():
    assert sequential.rational(0.5) == (1, 2) and sequential.rational(0) == (0, 1) and sequential.rational(3) == (3, 1)
    n, d = sequential.rational(3.14159265358979)
    assert abs(n / d - 3.14159265358979) < 1e-12


def test_rational_batches(spark):
    values = [0.0, 0.5, 3.0, 3.14159265358979, 1e-9, 123456789.125, 4294967295.0, 5e9, 1 / 3, 0.1, 299.99]
    df = spark.createDataFrame([(v,) for v in [*values, -1.0, None]], "v double").select("v", sequential.to_rational("v").alias("q"))
    got = {r["v"]: r["q"] for r in df.collect()}
    assert all(tuple(got[v]) == sequential.rational(v) for v in values)
    assert all(got[v] is None or tuple(got[v]) == (None, None) for v in (-1.0, None))


def test_dithered_quantising(spark):
    rng = np.random.default_rng(0)
    palette = [(0, 0, 0), (255, 255, 255), (255, 0, 0)]
    one = sequential.diffuse_palette(np.full((32, 32, 3), 100), np.array(palette))
    assert abs(np.array(palette)[one].mean() - 100) < 6
    images = rng.integers(0, 256, (2, 5, 7, 3))
    rows = [(i, y, x, *map(int, images[i, y, x])) for i in range(2) for y in range(5) for x in range(7)]
    got = sequential.dither_palette(spark.createDataFrame(rows, "image_id long, y long, x long, r int, g int, b int"), palette).collect()
    for i in range(2):
        want = sequential.diffuse_palette(images[i], np.array(palette))
        assert {(r["y"], r["x"]): r["idx"] for r in got if r["image_id"] == i} == {(y, x): int(want[y, x]) for y in range(5) for x in range(7)}
    assert np.array_equal(sequential.diffuse_palette(np.array([[[255, 0, 0], [0, 0, 0]]]), np.array(palette)), [[2, 0]])


def test_median_cut_refuses_more_buckets_than_there_are(spark):
    with pytest.raises(ValueError):
        sequential.median_cut(spark.range(33000).selectExpr("id AS r5", "0 AS g5", "0 AS b5", "1 AS n"))


def test_palette_ties_go_to_the_first(spark):
    palette = spark.createDataFrame([(0, 0, 0, 0), (1, 2, 0, 0)], "idx int, r int, g int, b int")
    px = spark.createDataFrame([(1, 0, 0)], "r int, g int, b int")
    assert joins.nearest_palette(px, palette).first()["idx"] == 0


def test_large_tables_are_not_broadcast(spark):
    assert "Broadcast" not in spark.range(10).join(joins.small(spark.range(50), 20), "id").hint("merge")._jdf.queryExecution().optimizedPlan().toString()


def test_guess_width(spark):
    rng = np.random.default_rng(1)
    image = (np.add.outer(np.arange(30) * 0.1, np.sin(np.arange(40))) * 50 + rng.random((30, 40))).reshape(-1)
    samples = spark.createDataFrame([(i, float(v)) for i, v in enumerate(image)], "pos long, v double")
    assert aggregates.guess_width(samples, 1200).first()["width"] % 40 == 0


def test_log_luminance(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (-2.5,)], "y double")
    got = df.select("y", color.logl16_to_y(color.logl16_from_y(F.col("y")).cast("int")).alias("back")).collect()
    assert all(abs(r["back"] - r["y"]) <= 0.003 * abs(r["y"]) for r in got)


def test_kernels(spark):
    color.register_kernel("halved", lambda v: (color.idiv(v, 2),) * 3)
    one = spark.range(1).select(color.rgba("halved", F.lit(200)).alias("p"), color.rgba("min_is_white", F.lit(255)).alias("q")).first()
    assert one["p"] == 100 * 65793 + 255 * 16777216 and one["q"] == 255 * 16777216
    with pytest.raises(ValueError):
        color.rgba("none", F.lit(1))


def test_nearest_palette_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    colors, entries = rng.integers(0, 256, (1500, 3)), rng.integers(0, 256, (70, 3))
    entries[7] = entries[3]  # ties go to the smaller index
    entries[20:40] = 128 + rng.integers(0, 5, (20, 3))  # many within one cell
    colors[:9] = [[0, 0, 0], [255, 255, 255], [15, 16, 17], [16, 15, 31], [128, 128, 128], [143, 144, 0], *entries[:3].tolist()]
    px = spark.createDataFrame([tuple(map(int, c)) for c in colors], "r int, g int, b int")
    palette = spark.createDataFrame([(i, *map(int, e)) for i, e in enumerate(entries)], "idx int, r int, g int, b int")
    got = {(r["r"], r["g"], r["b"]): (r["idx"], r["distance"]) for r in joins.nearest_palette(px, palette).collect()}
    for c in colors:
        far = ((entries - c) ** 2).sum(axis=1)
        assert got[tuple(c.tolist())] == (int(far.argmin()), int(far.min()))
    assert joins.nearest_palette(px.limit(0), palette).count() == 0


def test_sheets():
    assert geometry.page_size(50, 5000, "a5", (4, 4), (0.5, 0.5)) == (19, 29)
    assert geometry.page_size(50, 5000, "a5", (4, 4), (0.5, 0.5), True) == (29, 19)
    assert geometry.page_size(100, 100, (30, 60), (1, 1), turned=None) == (60, 30)  # 8 sheets either way
    assert geometry.page_size(90, 100, (30, 60), (1, 1), turned=None) == (30, 60)  # 6 sheets upright, 8 turned
    assert geometry.page_size(20, 10, "letter", (72, 72)) == (20, 10)
    for bad in ({"margins": (5, 0)}, {"margins": (4.25, 0)}):
        with pytest.raises(ValueError):
            geometry.page_size(500, 500, "letter", (72, 72), **bad)
