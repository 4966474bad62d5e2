"""Nearest neighbours against brute force: recall, exact scores, order, copies, odd vectors, shards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixweft.llm import ann, queries

SF = "/root/testdata/sf0.001"


def plain(rows, asks, most=10):
    """{query: [(vec_id, score)]} by all distances, in double precision."""
    out = {}
    for i, v in rows:
        if asks(i):
            near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, u, strict=True))), j) for j, u in rows if j != i and len(u) == len(v))
            out[i] = [(j, d) for d, j in near[:most]]
    return out


def lists(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({j for j, _ in got.get(q, [])} & {j for j, _ in near}) for q, near in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("shard", [50, 1 << 14])
def test_recall_and_scores(spark, shard):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in table.collect()]
    vectors = dict(rows)
    want = plain(rows, lambda i: i % 7 == 0)
    got = lists(ann.nearest(table, F.col("vec_id") % 7 == 0, shard=shard))
    assert got.keys() == want.keys() and all(len(got[q]) == 10 for q in got)
    assert recall(got, want) >= 0.95
    for q, near in got.items():
        assert [s for _, s in near] == sorted(s for _, s in near) and q not in {j for j, _ in near}
        for j, s in near:
            assert math.isclose(s, math.dist(vectors[q], vectors[j]), rel_tol=1e-12, abs_tol=1e-12)


def test_query_over_the_whole_table(spark):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    out = queries.op11_approximate_nearest_neighbours(spark, SF)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got, want = lists(out), plain(rows, lambda i: i % 100 == 0)
    assert recall(got, want) >= 0.95


def test_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4)]) for i in range(200)]
    rows = [(i, v if any(v) else [1.0] * 4) for i, v in rows]
    rows += [(1000 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(150)]  # a large group of copies
    odd = [(2000, None), (2010, []), (2020, [0.0] * 4), (2030, [1.0, None, 1.0, 1.0]), (2040, [1.0, math.nan, 1.0, 1.0]), (2050, [math.inf, 1.0, 1.0, 1.0]), (None, [1.0] * 4), (2060, [5.0, 6.0]), (2070, [5.0, 7.0])]
    table = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in [*rows, *odd, rows[0], rows[5]]], "vec_id long, embedding array<double>, query long, node long, shard long")
    got = lists(ann.nearest(table, F.col("vec_id") % 10 == 0, shard=40))
    want = plain([*rows, (2060, [5.0, 6.0]), (2070, [5.0, 7.0])], lambda i: i % 10 == 0)
    assert got.keys() == want.keys()
    for q, near in want.items():  # few nodes: found whole, equal distances in order of id
        assert [j for j, _ in got[q]] == [j for j, _ in near]
        assert np.allclose([s for _, s in got[q]], [s for _, s in near])
    assert [j for j, _ in got[2060]] == [2070]


def test_an_id_with_two_vectors_and_empty_tables(spark):
    rows = [(0, [1.0, 1.0]), (0, [9.0, 9.0]), (1, [1.0, 2.0]), (2, [9.0, 8.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert lists(ann.nearest(table, F.col("vec_id") == 0))[0][0] == (1, 1.0)
    assert ann.nearest(table.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(table, F.col("vec_id") == 7).count() == 0


def test_flat_arrays_hold_the_graph():
    rng = np.random.default_rng(4)
    vectors = rng.standard_normal((3000, 16))
    layer = ann.layers(rng.integers(-(2**63), 2**63 - 1, 3000))
    order = np.argsort(-layer, kind="stable")
    g = ann.Graph.built(vectors[order], layer[order])
    assert g.sizes[0] == 3000 and len(g.sizes) >= 3 and all(len(x) == n for x, n in zip(g.links, g.sizes, strict=True))
    for links, n in zip(g.links, g.sizes, strict=True):
        assert links.max() < n and all(len({x for x in row if x >= 0}) == (row >= 0).sum() for row in links.tolist() for row in [np.array(row)])
    queries_ = rng.standard_normal((100, 16)).astype(np.float32)
    ids = g.search(queries_)
    true = np.argsort(((g.vectors[None] - queries_[:, None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(b)) for a, b in zip(ids.tolist(), true.tolist(), strict=True)]) >= 9.3
