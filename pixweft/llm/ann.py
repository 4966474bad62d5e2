"""Nearest neighbours by hierarchical navigable small-world graphs, one for each shard of the vectors.

Equal vectors are one node, so that a group of copies can't fill a node's list with itself; of its ids the K + 1 least are kept, which is all that K neighbours can ask for.
Nodes are dealt into shards of about SHARD nodes by their hash. A shard is built in one task, into flat arrays: vectors, the ids of their copies, and for each layer a table of neighbours, -1 where there is none.
Nodes are in order of layer, so a layer holds the first so many nodes and node 0 is the way in. Each node has a layer of its own by its hash, LINKS times fewer in each.
Nodes are added in batches: all of a batch go down from the way in side by side, one step greedily in each higher layer and with a beam of BUILD from their own layer on,
and choose among what they met and each other up to LINKS neighbours (twice that in layer 0) that lie nearer to them than to those chosen before; what room is left goes to the nearest others.
Those chosen link back; where that overfills a list, it is chosen anew in the same way.

The index is written to the shared folder, a row for each shard. Queries are distinct vectors; they meet each shard in blocks of at most QUERIES, a beam of SEARCH finds the nearest nodes, and what all shards
give is merged by score and id. Graphs work in single precision, scores are exact distances of the original vectors in double precision. Each query sees all shards, so its work grows with n / SHARD;
larger executors take a larger shard (about 1 KB a node at 64 values).

Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do rows without an id; vectors of another length are no candidates. Repeated rows count once; of an id with several vectors the least one
counts. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import cut

NEIGHBOURS, SHARD, LINKS, BUILD, SEARCH, BATCH, QUERIES = 10, 1 << 14, 16, 64, 128, 256, 1 << 15
INDEX = "dim int, shard int, node_ids binary, vectors binary, sizes binary, links binary"
FOUND = "query long, node long, score double"


def distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances along the last axis."""
    diff = rows - to
    return np.einsum("...k,...k->...", diff, diff)


def chosen(near: np.ndarray, vectors: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Of each row of candidates (ids, -1: none; near: their distances, ascending) up to `most` neighbours, -1 behind them."""
    there = ids >= 0
    own = vectors[np.maximum(ids, 0)]
    square = np.einsum("bck,bck->bc", own, own)
    apart = square[:, :, None] + square[:, None, :] - 2 * np.matmul(own, own.transpose(0, 2, 1))
    picked, blocked = np.zeros(ids.shape, bool), ~there
    count = np.zeros(len(ids), np.int64)
    for c in range(ids.shape[1]):
        take = ~blocked[:, c] & (count < most)
        picked[:, c] = take
        count += take
        blocked |= take[:, None] & (apart[:, c] < near)  # nearer to this one than to the node
    rank = np.where(picked, 0, np.where(there, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
    order = np.argsort(rank, axis=1)[:, :most]
    out = np.full((len(ids), most), -1)
    out[:, : order.shape[1]] = np.take_along_axis(np.where(there, ids, -1), order, axis=1)
    return out


def beam(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, start: np.ndarray, width: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The nodes nearest to each query that a beam of `width` meets from its node `start` on: (nodes, squared distances), ascending; -1 and infinity behind them. `wide` nodes of a beam are expanded at once."""
    n, size = len(queries), min(width, len(links))
    ids, dist = np.full((n, size), -1), np.full((n, size), np.inf, np.float32)
    done = np.ones((n, size), bool)
    ids[:, 0], dist[:, 0], done[:, 0] = start, distances(vectors[start], queries), False
    met = np.full((n, len(links)), -1, np.int16)
    met[np.arange(n), start] = 0
    rows = np.arange(n)
    per = links.shape[1]
    wide = min(wide, size)
    while len(rows):
        open_ = np.where(done[rows], np.inf, dist[rows])
        at = np.argpartition(open_, wide - 1, axis=1)[:, :wide] if wide < size else np.broadcast_to(np.arange(size), (len(rows), size))
        real = np.isfinite(np.take_along_axis(open_, at, axis=1))
        done[rows[:, None], at] = True
        rows, at, real = rows[some := real.any(axis=1)], at[some], real[some]
        if not len(rows):
            break
        next_ = links[np.where(real, ids[rows[:, None], at], 0)]
        next_ = np.where(real[:, :, None], next_, -1).reshape(len(rows), -1)
        r, c = np.nonzero(next_ >= 0)
        node = next_[r, c]
        fresh = met[rows[r], node] < 0
        r, c, node = r[fresh], c[fresh], node[fresh]
        met[rows[r], node] = c
        once = met[rows[r], node] == c  # of one node met twice in this step
        r, c, node = r[once], c[once], node[once]
        new = np.full((len(rows), wide * per), np.inf, np.float32)
        new[r, c] = distances(vectors[node], queries[rows[r]])
        all_ = np.concatenate([dist[rows], new], axis=1)
        keep = np.argpartition(all_, size - 1, axis=1)[:, :size]
        dist[rows] = np.take_along_axis(all_, keep, axis=1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], next_], axis=1), keep, axis=1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], np.isinf(new)], axis=1), keep, axis=1)
    ids[np.isinf(dist)] = -1
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


class Graph:
    """Layers of links over vectors; sizes[l]: how many nodes, the first ones, layer l has."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, links: list[np.ndarray]):
        self.vectors, self.sizes, self.links = vectors.astype(np.float32), sizes, links

    @classmethod
    def built(cls, vectors: np.ndarray, layer: np.ndarray, most: int = LINKS) -> Graph:
        """The graph of vectors in descending order of layer."""
        sizes = np.array([int((layer >= k).sum()) for k in range(int(layer[0]) + 1)])
        g = cls(vectors, sizes, [np.full((n, most * (2 if k == 0 else 1)), -1) for k, n in enumerate(sizes)])
        done = 1
        while done < len(layer):
            end = min(done + min(BATCH, max(8, done)), int(sizes[layer[done]]))
            g._add(np.arange(done, end), int(layer[done]), done)
            done = end
        return g

    def _add(self, new: np.ndarray, layer: int, there: int) -> None:
        queries, start = self.vectors[new], np.zeros(len(new), np.int64)
        for k in range(len(self.sizes) - 1, -1, -1):
            links = self.links[k]
            ids, near = beam(self.vectors, links[: min(there, len(links))], queries, start, BUILD if k <= layer else 1, 4 if k <= layer else 1)
            start = ids[:, 0]
            if k > layer:
                continue
            among = distances(queries[:, None], queries[None])
            np.fill_diagonal(among, np.inf)
            some = np.argsort(among, axis=1)[:, :BUILD // 2]
            near = np.concatenate([near, np.take_along_axis(among, some, axis=1)], axis=1)
            ids = np.concatenate([ids, np.where(np.isinf(np.take_along_axis(among, some, axis=1)), -1, new[some])], axis=1)
            order = np.argsort(near, axis=1, kind="stable")[:, :BUILD]
            near, ids = np.take_along_axis(near, order, axis=1), np.take_along_axis(ids, order, axis=1)
            links[new] = chosen(near, self.vectors, ids, links.shape[1])
            self._link_back(links, new)

    def _link_back(self, links: np.ndarray, new: np.ndarray) -> None:
        """Links from the neighbours of new nodes to them."""
        most = links.shape[1]
        u, c = np.nonzero(links[new] >= 0)
        u, v = new[u], links[new][u, c]
        back = ~(links[v] == u[:, None]).any(axis=1)
        u, v = u[back], v[back]
        near = distances(self.vectors[u], self.vectors[v])
        order = np.lexsort((near, v))
        u, v = u[order], v[order]
        first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.zeros(0, np.int64)
        place = np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v))))
        nodes, row = v[first], np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        more = np.full((len(nodes), most), -1)
        keep = place < most
        more[row[keep], place[keep]] = u[keep]
        for a in range(0, len(nodes), BATCH):
            own = nodes[a : a + BATCH]
            ids = np.concatenate([links[own], more[a : a + BATCH]], axis=1)
            ids = ids[:, (ids >= 0).any(axis=0)]
            near = np.where(ids >= 0, distances(self.vectors[np.maximum(ids, 0)], self.vectors[own][:, None]), np.inf)
            order = np.argsort(near, axis=1, kind="stable")
            near, ids = np.take_along_axis(near, order, axis=1), np.take_along_axis(ids, order, axis=1)
            full = (ids >= 0).sum(axis=1) > most
            out = np.full((len(own), max(most, ids.shape[1])), -1)
            out[:, : ids.shape[1]] = ids
            out = out[:, :most]
            if full.any():
                out[full] = chosen(near[full], self.vectors, ids[full], most)
            links[own] = out

    def search(self, queries: np.ndarray, width: int = SEARCH) -> np.ndarray:
        """The nodes nearest to each query, as far as a beam of `width` finds them; -1 behind them."""
        queries, start = queries.astype(np.float32), np.zeros(len(queries), np.int64)
        for k in range(len(self.sizes) - 1, 0, -1):
            start = beam(self.vectors, self.links[k], queries, start, 1, 1)[0][:, 0]
        return beam(self.vectors, self.links[0], queries, start, width)[0]


def layers(hashes: np.ndarray, most: int = LINKS) -> np.ndarray:
    """A layer for each node: 0, with a chance of 1 / most one more, and so on."""
    share = ((hashes.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 1) / (1 << 53)
    return np.floor(-np.log(share) / np.log(most)).astype(np.int64)


def _built(rows: pa.Table) -> pa.Table:
    """INDEX of the nodes (dim, shard, node, vector, mark) of a shard."""
    dim, shard = rows.column("dim")[0].as_py(), rows.column("shard")[0].as_py()
    node, mark = rows.column("node").to_numpy(), rows.column("mark").to_numpy()
    vectors = rows.column("vector").combine_chunks().flatten().to_numpy().reshape(len(node), dim)
    layer = layers(mark)
    order = np.lexsort((node, -layer))
    g = Graph.built(vectors[order], layer[order])
    flat = np.concatenate([x.ravel() for x in g.links]).astype("<i4")
    one = [pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (node[order].astype("<i8"), vectors[order].astype("<f8"), g.sizes.astype("<i8"), flat))]
    return pa.Table.from_arrays(one, [x.split()[0] for x in INDEX.split(", ")])


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray, Graph]:
    """(ids of the nodes, vectors, graph) of a row of INDEX."""
    vectors = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
    sizes, flat, links = np.frombuffer(row["sizes"], "<i8"), np.frombuffer(row["links"], "<i4").astype(np.int64), []
    for k, n in enumerate(sizes.tolist()):
        per = LINKS * (2 if k == 0 else 1)
        links.append(flat[: n * per].reshape(n, per))
        flat = flat[n * per :]
    return np.frombuffer(row["node_ids"], "<i8"), vectors, Graph(vectors, sizes, links)


def _searched(batches: Iterator[pa.RecordBatch], most: int, width: int) -> Iterator[pa.RecordBatch]:
    """FOUND of rows in order of (dim, shard, part): first the shard's index, then queries."""
    index = None
    for batch in batches:
        has = np.flatnonzero(np.asarray(batch.column("links").is_valid()))
        cuts = [0, *has.tolist(), batch.num_rows]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            if a in has:
                index = _opened(batch.slice(a, 1).to_pylist()[0])
                a += 1
            for b in range(a, z, BATCH):
                rows = batch.slice(b, min(BATCH, z - b))
                node, vectors, g = index
                queries = rows.column("vector").flatten().to_numpy().reshape(rows.num_rows, vectors.shape[1])
                ids = g.search(queries, width)
                score = np.where(ids >= 0, np.sqrt(distances(vectors[np.maximum(ids, 0)], queries[:, None])), np.inf)
                own = np.where(ids >= 0, node[np.maximum(ids, 0)], np.iinfo(np.int64).max)
                order = np.lexsort((own, score), axis=1)[:, :most]
                score, own = np.take_along_axis(score, order, axis=1), np.take_along_axis(own, order, axis=1)
                r, c = np.nonzero(np.isfinite(score))
                yield pa.RecordBatch.from_arrays([rows.column("query").take(pa.array(r)), pa.array(own[r, c]), pa.array(score[r, c])], ["query", "node", "score"])


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _vectors(table: DataFrame) -> DataFrame:
    """(vec_id, vector) of the rows that take part, one for each id."""
    own = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where(F.col("vec_id").isNotNull() & usable("vector"))
    twice = own.groupBy("vec_id").count().where("count > 1").limit(1).count()
    return own.groupBy("vec_id").agg(F.min("vector").alias("vector")) if twice else own


def build(nodes: DataFrame, shard: int = SHARD) -> DataFrame:
    """INDEX of nodes (node, vector), written to the shared folder."""
    sized = nodes.select("node", "vector", F.size("vector").alias("dim"), F.xxhash64("vector").alias("mark"))
    parts = sized.groupBy("dim").agg(F.expr(f"cast(ceil(count(*) / {shard}) as int)").alias("parts"))
    dealt = sized.join(F.broadcast(parts), "dim").withColumn("shard", F.expr("cast(pmod(shiftright(mark, 7), parts) as int)")).drop("parts")
    return cut(dealt.groupBy("dim", "shard").applyInArrow(_built, INDEX), "index")


def search(index: DataFrame, queries: DataFrame, most: int, width: int = SEARCH, block: int = QUERIES) -> DataFrame:
    """FOUND: of queries (query, vector) the `most` nearest nodes of each shard, as far as its graph finds them."""
    queries = queries.select("query", "vector", F.size("vector").alias("dim"))
    blocks = queries.groupBy("dim").agg(F.expr(f"cast(ceil(count(*) / {block}) as int)").alias("parts"))
    shards = index.groupBy("dim").agg(F.collect_list("shard").alias("shards"))
    n = index.count()
    none = lambda kind: F.lit(None).cast(kind)
    names = ["node_ids", "vectors", "sizes", "links"]
    own = index.join(F.broadcast(blocks), "dim").withColumn("part", F.explode(F.expr("sequence(0, parts - 1)")))
    own = own.select("dim", "shard", "part", none("long").alias("query"), none("array<double>").alias("vector"), *names)
    asked = queries.join(F.broadcast(blocks), "dim").join(F.broadcast(shards), "dim").withColumn("part", F.expr("cast(pmod(xxhash64(query), parts) as int)"))
    asked = asked.select("dim", F.explode("shards").alias("shard"), "part", "query", "vector", *(none("binary").alias(c) for c in names))
    both = own.unionByName(asked).repartition(max(n, 1), "dim", "shard", "part").sortWithinPartitions("dim", "shard", "part", F.col("query").asc_nulls_first())
    return both.mapInArrow(partial(_searched, most=most, width=width), FOUND)


def nearest(table: DataFrame, asks: Column, most: int = NEIGHBOURS, shard: int = SHARD, width: int = SEARCH) -> DataFrame:
    """(query_id, rank, vec_id, score): the `most` nearest rows (vec_id, embedding) that the graphs find for each row where `asks`, itself left out; ties go to the smaller id."""
    vectors = cut(_vectors(table), "vectors")
    least = W.partitionBy("vector").orderBy("vec_id")
    copies = vectors.withColumn("place", F.row_number().over(least)).where(F.col("place") <= most + 1)
    nodes = copies.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = cut(nodes.select(F.col("ids")[0].alias("node"), "vector", "ids"), "nodes")
    index = build(nodes.select("node", "vector"), shard)
    asking = vectors.where(asks).join(nodes.select("node", "vector"), "vector").select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    asking = cut(asking, "asking")
    queries = nodes.join(asking.select(F.col("query").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("query"), "vector")
    found = search(index, queries, most + 1, width).join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    merged = found.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy("score", "vec_id"))).where(F.col("rank") <= most + 1)
    lists = merged.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    own = asking.join(lists, "query").select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, most).alias("near"))
    return own.select("query_id", F.posexplode("near").alias("rank", "x")).select("query_id", (F.col("rank") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
