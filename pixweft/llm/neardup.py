"""MinHash near-duplicates by tensored banding.

A document's set holds its distinct 5-word shingles (words are runs of bytes outside ASCII
white space, A-Z lower-cased; with fewer words the whole sequence is the one shingle).
Equal sets form a class; one representative of each goes on. Of each set, two small
collections of SIDE bands of BAND minima are computed; the SIDE * SIDE table keys combine a
left band with a right band, so 2 * SIDE * BAND minima do what SIDE * SIDE * 2 * BAND
would. A pair at the threshold misses every left or every right band with probability of at
most 2 * (1 - 0.85 ** BAND) ** SIDE = 7e-5.

Inside a table key, all members are first compared with the least one, so a large group of
near copies costs one comparison per member and key. What these links leave in different
components is then compared across components: a key's members are dealt into blocks of about
BLOCK members or BLOCK_SHINGLES shingles, pairs of blocks into tasks. Pairs never leave a task: members that may link across components, at the first key that they share,
go on with their full sets, and of a task's links as many are kept as connect its members.

Pairs whose sizes can't reach the threshold are dropped before their sets are read, and so are pairs that
differ in so many of the 2 * SIDE * BAND minima (a byte of each) or, across components, of SHARP further ones, that
a pair at the threshold does so with a probability of at most LOSS. Links are confirmed on full sets. The tables are made for thresholds of 80 % and more:
there a pair misses all of them with a probability of 6e-4.

Null or empty texts, and texts without words, have an empty set: no links, their own
component. A null doc_id has a null component and is not kept. Repeated rows are judged alike. A doc_id that comes with several texts is one document with several sets:
what links to any of them is in its component, and its rows with an empty set are too.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .components import components
from .shared import bitmap, cut, marked, texts

SIDE, BAND, SHINGLE, PERCENT = 8, 2, 5, 85
LOSS, SHARP, BLOCK, BLOCK_SHINGLES, STEP = 1e-5, 256, 2048, 8 << 20, 1 << 19
_HASHES = 2 * SIDE * BAND
_SKETCH = [f"s{k}" for k in range(_HASHES // 8)]
SIGNATURES = "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, " + ", ".join(f"{c} long" for c in _SKETCH)


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted set of n-word shingle hashes of each text."""
    starts, ends, first = K.spans(data, off)
    words = K.span_hashes(data, starts, ends)
    grams, at = K.ngrams(words, first, n)
    for i in range(len(off) - 1):
        if at[i] < at[i + 1]:
            yield np.unique(grams[at[i] : at[i + 1]])
        elif first[i] < first[i + 1]:
            short = np.full(1, first[i + 1] - first[i], np.uint64)
            for k in range(first[i], first[i + 1]):
                short = K.mix(short * np.uint64(0xE7037ED1A0B428DB) ^ words[k : k + 1])
            yield short
        else:
            yield np.zeros(0, np.uint64)


def _bands(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set, which isn't empty, a row of 2 * SIDE band values and a row with a byte of each minimum."""
    every = np.concatenate(sets)
    begins = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=begins[1:])
    out = np.zeros((len(sets), 2 * SIDE), np.uint64)
    sketch = np.zeros((len(sets), _HASHES), np.uint8)
    for h, least in enumerate(_minima(every, begins, _HASHES, 2)):
        out[:, h // BAND] = K.mix(out[:, h // BAND] * np.uint64(0x9FB21C651E98DF25) + least)
        sketch[:, h] = (K.mix(least) & np.uint64(255)).astype(np.uint8)
    return out, sketch


def _signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in K.slices(batch.column(1)):
            sets = list(shingle_sets(data, off, n))
            full = [k for k, s in enumerate(sets) if len(s)]
            digest = np.zeros((len(sets), 2), np.uint64)
            bands = np.zeros((len(sets), 2 * SIDE), np.uint64)
            sketch = np.zeros((len(sets), _HASHES), np.uint8)
            if full:
                for k in full:
                    s = sets[k]
                    digest[k] = s.sum(dtype=np.uint64), K.mix(s ^ np.uint64(0x1D8E4E27C47D124F)).sum(dtype=np.uint64)
                bands[full], sketch[full] = _bands([sets[k] for k in full])
            flat = pa.array(bands.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 2 * SIDE), flat)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)[i:j], pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0].view(np.int64)), pa.array(digest[:, 1].view(np.int64)), lists, *(pa.array(x) for x in sketch.view(np.int64).T)],
                ["doc_id", "n_shingles", "d1", "d2", "bands", *_SKETCH],
            )


def _minima(every: np.ndarray, begins: np.ndarray, n: int, seed: int) -> Iterator[np.ndarray]:
    """n times the least value, under another hash function each time, of the sets that begin at `begins`."""
    for flip, odd in zip(K.seeded(n, seed), K.seeded(n, seed + 1) | np.uint64(1), strict=True):
        x = every ^ flip
        x *= odd
        yield np.minimum.reduceat(x, begins)


def _marked(batches: Iterator[pa.RecordBatch], marks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """The rows whose last column is marked."""
    for batch in batches:
        if marks is None:
            yield batch
            continue
        yield batch.filter(pa.array(marked(batch.column(2).to_numpy(zero_copy_only=False), marks)))


def _sharp_sketches(batches: Iterator[pa.RecordBatch], n: int, marks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in _marked(batches, marks):
        for i, j, data, off in K.slices(batch.column(1)):
            sets = list(shingle_sets(data, off, n))
            if not sum(map(len, sets)):
                continue
            sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]  # rows marked by chance
            begins = np.zeros(len(sets), np.int64)
            np.cumsum([len(s) for s in sets[:-1]], out=begins[1:])
            sketch = np.stack([(K.mix(x) & np.uint64(255)).astype(np.uint8) for x in _minima(np.concatenate(sets), begins, SHARP, 4)], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([x.tobytes() for x in sketch], pa.binary())], ["id", "sharp"])


def _full_sets(batches: Iterator[pa.RecordBatch], n: int, marks: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in _marked(batches, marks):
        for i, j, data, off in K.slices(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], pa.array([s.tobytes() for s in shingle_sets(data, off, n)], pa.binary())], ["id", "full"])


def _similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    both = np.concatenate([one, two])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _confirmed(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("full_a"), batch.column("full_b"), strict=True):
            keep.append(_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _rows_of(docs: DataFrame, ids: DataFrame, sets: Callable, n: int, kinds: str, name: str) -> DataFrame:
    """What `sets` makes of the texts with the given ids (a table with the column id), written to the shared folder.

    Texts are read again and don't move: a bitmap of fixed size tells the tasks which rows to take. If it fills, more rows
    are taken than asked for; the join after it drops those.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(ids.select(F.xxhash64("id").alias("mark")), "mark"))
    plain = texts(docs).where("doc_id is not null").select("doc_id", "text", F.xxhash64("doc_id").alias("mark"))
    return cut(plain.mapInArrow(lambda batches: sets(batches, n, shared.value), kinds), name)


def _links(pairs: DataFrame, docs: DataFrame, percent: int, n: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets are similar enough."""
    ids = pairs.select(F.col("a").alias("id")).unionAll(pairs.select("b"))
    full = _one_each(_rows_of(docs, ids, _full_sets, n, "id long, full binary", "sets"), "id")
    both = pairs.join(full.select(F.col("id").alias("b"), F.col("full").alias("full_b")), "b").join(full.select(F.col("id").alias("a"), F.col("full").alias("full_a")), "a")
    return both.select("a", "b", "full_a", "full_b").mapInArrow(partial(_confirmed, percent=percent), "a long, b long")


def _one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key. Keys that come twice are rare: rows move only if there is one."""
    twice = rows.groupBy(key).count().where("count > 1").limit(1).count()
    return rows.dropDuplicates([key]) if twice else rows


def _differing(a: str, b: str) -> str:
    """SQL: in how many of 8 bytes two longs differ."""
    x = f"({a} ^ {b})"
    y = f"({x} | shiftrightunsigned({x}, 4))"
    y = f"({y} | shiftrightunsigned({y}, 2))"
    return f"bit_count(({y} | shiftrightunsigned({y}, 1)) & 72340172838076673L)"


@lru_cache
def may_differ(percent: int, n: int) -> int:
    """The least number of n minima that a pair at the threshold exceeds in differing with a probability of at most LOSS."""
    p = 1 - percent / 100
    tail, k = 1.0, -1
    while tail > LOSS:
        k += 1
        tail -= comb(n, k) * p**k * (1 - p) ** (n - k)
    return k


def _may_link(percent: int) -> str:
    """SQL condition on the rows `a` and `b`."""
    return f"100 * least(a.n_shingles, b.n_shingles) >= {percent} * greatest(a.n_shingles, b.n_shingles) and {' + '.join(_differing(f'a.{c}', f'b.{c}') for c in _SKETCH)} <= {may_differ(percent, _HASHES)}"


def _table_keys() -> F.Column:
    """Rows (table, key): one for each left band with each right band."""
    left, right = f"slice(bands, 1, {SIDE})", f"slice(bands, {SIDE + 1}, {SIDE})"
    return F.posexplode(F.expr(f"flatten(transform({left}, (l, i) -> transform({right}, (r, j) -> xxhash64(l, r, i, j))))")).alias("table", "key")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _near_pairs(rows: pa.RecordBatch, percent: int) -> np.ndarray:
    """The pairs (a, b) of places of rows with equal (key, p, q), which follow each other, that may link and have no earlier key in common."""
    key, p, q, side, table, _, size, c = (rows.column(k).to_numpy() for k in range(8))
    bands = rows.column(8).flatten().to_numpy().reshape(-1, 2 * SIDE)
    sketch, sharp = _matrix(rows.column(9), _HASHES), _matrix(rows.column(10), SHARP)
    new = np.flatnonzero((np.diff(key) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
    stop = np.repeat(np.append(new, len(key)), np.diff(np.concatenate([[0], new, [len(key)]])))
    later = stop - np.arange(len(key)) - 1
    out, i = [], 0
    total = np.cumsum(later)
    while i < len(key):
        j = max(i + 1, int(np.searchsorted(total, total[i] - later[i] + STEP, "right")))
        n = later[i:j]
        a = np.repeat(np.arange(i, j), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + a + 1
        keep = (c[a] != c[b]) & ((p[a] == q[a]) | (side[a] != side[b])) & (100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b]))
        a, b = a[keep], b[keep]
        keep = (sketch[a] != sketch[b]).sum(axis=1) <= may_differ(percent, _HASHES)
        a, b = a[keep], b[keep]
        same = bands[a] == bands[b]
        keep = same[:, :SIDE].argmax(axis=1) * SIDE + same[:, SIDE:].argmax(axis=1) == table[a]
        a, b = a[keep], b[keep]
        keep = (sharp[a] != sharp[b]).sum(axis=1) <= may_differ(percent, SHARP)
        out.append(np.stack([a[keep], b[keep]]))
        i = j
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)


def _taking_part(rows: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """The rows that are in some pair."""
    return rows.take(pa.array(np.unique(_near_pairs(rows, percent))))


def _linked(rows: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """The links (a, b) of rows, confirmed on the full sets; of what they connect, as many as connect it."""
    ids, c, full = rows.column(5).to_numpy(), rows.column(7).to_numpy(), rows.column(11)
    up = {int(x): int(x) for x in c}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    sets: dict[int, np.ndarray] = {}
    found = []
    for x, y in _near_pairs(rows, percent).T.tolist():
        one, two = root(int(c[x])), root(int(c[y]))
        if one == two:
            continue
        for k in (x, y):
            if k not in sets:
                sets[k] = np.frombuffer(full[k].as_buffer(), np.uint64)
        if _similar(sets[x], sets[y], percent):
            found.append(sorted((int(ids[x]), int(ids[y]))))
            up[max(one, two)] = min(one, two)
    return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])


def _by_group(batches: Iterator[pa.RecordBatch], work: Callable, percent: int) -> Iterator[pa.RecordBatch]:
    """Groups of rows may go on in the next batch: the last one, of at most about two blocks, waits for it."""
    rest = None
    for batch in batches:
        if rest is not None:
            batch = pa.concat_batches([rest, batch])
        same = np.ones(batch.num_rows, bool)
        for k in range(3):
            x = batch.column(k).to_numpy()
            same &= x == x[-1]
        cut_at = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        yield work(batch.slice(0, cut_at), percent)
        rest = batch.slice(cut_at)
    if rest is not None:
        yield work(rest, percent)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")


def _several_texts(docs: DataFrame, percent: int, n: int) -> DataFrame:
    """near_duplicates() of documents whose doc_id may come with several sets: rows are numbered and linked by their numbers, then those of one doc_id are one."""
    numbered = cut(texts(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    named = numbered.where("doc_id is not null")
    found = near_duplicates(named.select(F.col("row").alias("doc_id"), "text"), percent, n).withColumnRenamed("doc_id", "row").drop("kept")
    own = cut(named.select("row", "doc_id").join(found, "row").drop("row"), "rows")
    first = own.groupBy("component_id").agg(F.min("doc_id").alias("b"))
    label = components(own.select("component_id", F.col("doc_id").alias("a")).join(first, "component_id").select("a", "b")).select(F.col("id").alias("doc_id"), "component")
    least = own.where("n_shingles > 0").groupBy("class_id").agg(F.min("doc_id").alias("least"))
    out = own.join(least, "class_id", "left").join(label, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("least", "doc_id").alias("class_id"), F.coalesce("component", "doc_id").alias("component_id"))
    rest = numbered.where("doc_id is null").select("doc_id", "text").mapInArrow(partial(_signatures, n=n), SIGNATURES)
    none = F.lit(None).cast("long")
    out = out.unionByName(rest.select("doc_id", "n_shingles", none.alias("class_id"), none.alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, n: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id, kept): one row for each row of docs. class_id is the least id with the same set."""
    sig = cut(texts(docs).mapInArrow(partial(_signatures, n=n), SIGNATURES), "signatures")
    twice = sig.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), *(F.min(c).alias(f"{c}_low") for c in ("d1", "d2", "n_shingles")), *(F.max(c).alias(f"{c}_high") for c in ("d1", "d2", "n_shingles")))
    if twice.where("rows > 1 and (d1_low <> d1_high or d2_low <> d2_high or n_shingles_low <> n_shingles_high)").limit(1).count():
        return _several_texts(docs, percent, n)
    sets = sig.where("n_shingles > 0 and doc_id is not null")
    least = sets.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    reps = sets.join(least.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "id").drop("d1", "d2")
    reps = _one_each(cut(reps, "representatives"), "id")
    keys = reps.select("id", "n_shingles", _table_keys())
    heads = keys.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1")
    members = cut(keys.join(heads, "key").where("id <> head").select("key", "table", "id", "n_shingles", "head", "size"), "members")
    slim = reps.select("id", "n_shingles", *_SKETCH)
    stars = members.select("head", "id").distinct().join(slim.alias("b"), "id").join(slim.withColumnRenamed("id", "head").alias("a"), "head")
    first = cut(stars.where(F.expr(_may_link(percent))).select(F.col("head").alias("a"), F.col("id").alias("b")), "pairs")
    links = cut(_links(first, docs, percent, n), "links")
    # What is left: members of one key that are still in different components, the heads compared already
    label = components(links)
    named = members.where("size > 2").join(label, "id", "left").select("key", "table", "id", "n_shingles", F.coalesce("component", "id").alias("c"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    split = named.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), blocks.alias("blocks")).where("lo < hi").select("key", "blocks")
    named = cut(named.join(split, "key"), "split")
    sharp = _one_each(_rows_of(docs, named, _sharp_sketches, n, "id long, sharp binary", "sharp"), "id").join(named.select("id").distinct(), "id", "left_semi")
    known = cut(reps.select("id", "bands", F.expr(f"unhex(concat({', '.join(f'lpad(hex({c}), 16, {chr(39)}0{chr(39)})' for c in _SKETCH)}))").alias("sketch")).join(sharp, "id"), "sketches")
    dealt = named.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "table", "id", "n_shingles", "c")
    dealt = dealt.join(known, "id").select("key", "p", "q", "side", "table", "id", "n_shingles", "c", "bands", "sketch", "sharp")
    kinds = "key long, p long, q long, side int, table int, id long, n_shingles long, c long, bands array<long>, sketch binary, sharp binary"
    part = cut(_grouped(dealt).mapInArrow(partial(_by_group, work=_taking_part, percent=percent), kinds), "part")
    full = _one_each(_rows_of(docs, part, _full_sets, n, "id long, full binary", "sets"), "id")
    more = _grouped(part.join(full, "id").select(*part.columns, "full")).mapInArrow(partial(_by_group, work=_linked, percent=percent), "a long, b long")
    label = components(links.unionByName(more))
    klass = least.join(label.select(F.col("id").alias("class_id"), "component"), "class_id", "left").select("d1", "d2", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component"))
    alone = F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))
    return (
        sig.select("doc_id", "n_shingles", "d1", "d2")
        .join(klass, ["d1", "d2", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.when(F.col("n_shingles") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(alone).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )
