"""Every registered query over the reference's operators against its SQL in DuckDB."""

import os

import duckdb
import pytest

from pixweft import registry

SF = os.environ.get("PIXWEFT_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in ("embeddings", "lineitem", "part"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}[k] for c, k in got.dtypes} == kinds
    order = lambda rows: sorted(rows, key=repr)
    rows = order(tuple(r) for r in got.select(*names).collect())
    assert rows and rows == order(want.select(*names).fetchall())


def test_whole_tables_are_taken(spark, duck):
    images, rows = duck.sql("select count(*) from embeddings").fetchall()[0][0], duck.sql("select count(*) from lineitem").fetchall()[0][0]
    for name, n in (("palette_unpack", 128 * images), ("iwht4x4", 64 * images), ("idct4x4", 64 * images), ("dc_predict", images), ("dequantize", rows), ("alpha_merge", 64 * images), ("token_partitions", 64 * images)):
        assert registry.QUERIES[name](spark, SF).count() == n, name
    assert registry.QUERIES["run_expansion"](spark, SF).select("tree").distinct().count() == images


def test_blocks_without_edges(spark):
    edges = spark.createDataFrame([(1, 10), (1, 13)], "image_id long, v long")
    got = registry.lossy.dc_prediction(edges, spark.createDataFrame([(1,), (2,)], "image_id long"), ["image_id"])
    assert {r.image_id: r.dc for r in got.collect()} == {1: 12, 2: 128}


def test_products_wrap_to_16_bits(spark):
    levels = spark.createDataFrame([(127, 1, level) for level in (-128, -116, 115, 116, 127)], "q long, n long, level long")
    got = registry.lossy.dequantize(levels, registry.lossy.steps(spark), ["q"])
    assert {r.level: r.value for r in got.collect()} == {-128: 29184, -116: 32592, 115: 32660, 116: -32592, 127: -29468}
