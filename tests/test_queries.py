"""Every registered query of the raster engine against its SQL, on the small tables."""

import glob
import os

import duckdb
import pytest

from mosaiq.plans import registry


def rows(df):
    cols = sorted(df.columns)
    return sorted(tuple(None if v is None else v for v in r) for r in df.select(*cols).collect()) if not any(t == "string" or t == "double" for _, t in df.dtypes) else sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n in registry.ORACLE_SQL])
def test_matches_sql(spark, sf_dir, db, name):
    got = registry.QUERIES[name](spark, sf_dir)
    found = db.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(got.columns)
    order = sorted(range(len(names)), key=names.__getitem__)
    expected = [tuple(r[i] for i in order) for r in found.fetchall()]
    mine = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    assert sorted(mine, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_sections_whole_tall(spark, tmp_path):
    spark.range(40_000).selectExpr("id AS o_orderkey", "id AS o_custkey", "id * 1.5 AS o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["section"]: r["n"] for r in registry.QUERIES["sections"](spark, str(tmp_path)).collect()}
    assert set(got) == set(range(9)) and sum(got.values()) == 40_000


def test_image_diff_whole_rows(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = registry.QUERIES["image_diff"](spark, sf_dir).selectExpr("y", "lhs IS NULL AS l", "rhs IS NULL AS r").distinct().collect()
    assert {r["y"] for r in got if r["r"]} == set(range(50)) and {r["y"] for r in got if r["l"]} == set(range(n, n + 50))
    assert {r["y"] for r in got if not r["l"] and not r["r"]} == set(range(50, n))


def test_file_rgba_draws_all_pages(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = registry.QUERIES["file_rgba"](spark, sf_dir)
    assert got.count() == 64 * n and {r["dir_index"] for r in got.select("dir_index").distinct().collect()} == {0, 1, 2}


def test_xyz_to_rgb24_borders(spark, tmp_path):
    """Colours with a light of exactly 1/4 in a channel, the border of codes 127 and 128; 183 * 7 is 1 modulo 256."""
    rows_ = ((2690, -1276, -414), (-1022, 1978, 44), (61, -224, 1163))
    db = duckdb.connect()
    db.execute("CREATE TABLE cube AS SELECT i // 65536 AS r, i // 256 % 256 AS g, i % 256 AS b FROM range(16777216) t(i)")
    border = db.execute("SELECT r, g, b FROM cube WHERE " + " OR ".join(f"{p}*r + {q}*g + {s}*b = 63750" for p, q, s in rows_) + " ORDER BY ALL").fetchall()
    orders = [(b * 183 % 256 + 256 * i, r, float(g)) for i, (r, g, b) in enumerate(border)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    db.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    expected = db.execute(f"SELECT y, x, r2, g2, b2 FROM ({registry.ORACLE_SQL['xyz_to_rgb24']}) ORDER BY ALL").fetchall()
    got = registry.QUERIES["xyz_to_rgb24"](spark, str(tmp_path)).select("y", "x", "r2", "g2", "b2").collect()
    assert len(expected) == len(border) > 100
    assert sorted(tuple(r) for r in got) == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
