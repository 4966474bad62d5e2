"""Benchmark decontamination by greedy string tiling.

Tokens are runs of ASCII letters, digits and bytes of other scripts, A-Z lower-cased. Seeds
are the hashes of MATCH-token windows; an item and a text that share a seed are compared: the
longest run of matching seeds is marked in both, then the next longest outside all marks, until
none of MATCH tokens is left. So passages count in any order. A text leaks an item if the tiles
cover at least COVERAGE of the item's tokens.

Seeds are joined on their hashes (64 bits; a chance hit is one window and can't cover an item). A benchmark of at most BLOCK characters is broadcast for that, and each text is tiled where it is read.
A larger one is not: its seeds and the windows of the texts that a bitmap of 2 ** MARKS bits lets through are shuffled and joined, in one pass over
the texts. An item is looked for by its rarer seeds only, as many as a leak can't do without; the pairs of a text and an item so found are joined with all their hits and tiled, many to a batch. Null texts, empty texts, empty tables and items of under MATCH tokens give no rows;
a repeated document row gives its rows again, a repeated item id counts as another item.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import bitmap, column, cut, free_name, marked, texts

MATCH, COVERAGE, BLOCK, STEP = 5, 0.5, 8 << 20, 4 << 20
SCHEMA = "doc_id long, item_id long, n_tiles int, covered int, item_tokens int, coverage double"


class Seeds:
    """The seeds of a block of items: sorted hashes with item and position."""

    def __init__(self, ids: list[int], items: list[str], n: int = MATCH):
        data, off = K.buffers(pa.array(items, pa.large_string()))
        starts, ends, first = K.spans(data, off, K.NOT_ALNUM)
        grams, at = K.ngrams(K.span_hashes(data, starts, ends), first, n)
        order = np.argsort(grams, kind="stable")
        self.ids, self.n, self.tokens = ids, n, np.diff(first)
        self.hashes = grams[order]
        self.item = np.repeat(np.arange(len(items)), np.diff(at))[order]
        self.pos = (np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at)))[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.hashes & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def hits(self, grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, item, item position) of all windows that are seeds, about STEP at a time (all hits of one window come together)."""
        window = np.flatnonzero(self.bits[(grams & np.uint64(0xFFFFF)).astype(np.int64)])
        lo = np.searchsorted(self.hashes, grams[window], "left")
        size = np.searchsorted(self.hashes, grams[window], "right") - lo
        window, lo, size = window[size > 0], lo[size > 0], size[size > 0]
        total, i = np.cumsum(size), 0
        while i < len(window):
            j = max(i + 1, int(np.searchsorted(total, total[i] - size[i] + STEP, "right")))
            yield np.repeat(window[i:j], size[i:j]), K.ragged(self.item, lo[i:j], size[i:j]), K.ragged(self.pos, lo[i:j], size[i:j])
            i = j


def tiles(doc_pos: np.ndarray, item_pos: np.ndarray, n: int = MATCH) -> list[tuple[int, int, int]]:
    """Greedy tiles (doc position, item position, tokens) from the seed hits of one text and one item, longest first; of equal ones the first in the text, then in the item."""
    order = np.lexsort((doc_pos, item_pos - doc_pos))
    d, p = doc_pos[order], item_pos[order]
    breaks = np.flatnonzero((np.diff(d) != 1) | (np.diff(p) != 1)) + 1
    begin = np.concatenate([[0], breaks])
    length = np.diff(np.concatenate([begin, [len(d)]])) + n - 1
    by_length: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for b, size in zip(begin.tolist(), length.tolist(), strict=True):
        by_length[size].append((int(d[b]), int(p[b])))
    marked_doc, marked_item, out = set(), set(), []
    size = max(by_length, default=0)
    while size >= n:
        for x, y in sorted(by_length.pop(size, ())):
            free = [x + k not in marked_doc and y + k not in marked_item for k in range(size)]
            if all(free):
                out.append((x, y, size))
                marked_doc.update(range(x, x + size))
                marked_item.update(range(y, y + size))
                continue
            k = 0
            while k < size:  # what is left of it, unmarked, waits for its own length
                j = k
                while j < size and free[j]:
                    j += 1
                if j - k >= n:
                    by_length[j - k].append((x + k, y + k))
                k = j + 1
        size = max((s for s in by_length if s <= size and by_length[s]), default=0)
    return out


def _coverage(where: np.ndarray, pos: np.ndarray, need: int, n: int, least: float) -> tuple[int, int] | None:
    """(tiles, covered tokens) of a text and an item of `need` tokens, if they cover enough."""
    if len(np.unique(pos)) + n * len(pos) < least * need:
        return None  # too few seeds to cover enough
    found = tiles(where, pos, n)
    covered = sum(t[2] for t in found)
    return (len(found), covered) if covered >= least * need else None


def _rows(rows: list[tuple]) -> list[pa.Array]:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    return [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]


_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _tiled(batches: Iterator[pa.RecordBatch], seeds: Seeds, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, _, data, off in K.slices(batch.column(1)):
            starts, ends, first = K.spans(data, off, K.NOT_ALNUM)
            grams, at = K.ngrams(K.span_hashes(data, starts, ends), first, seeds.n)
            # Of each text and item first the number of hits: only those with enough are looked at closely, so that a seed of many items costs no memory
            pairs = [np.unique((np.searchsorted(at, window, "right") - 1) * len(seeds.ids) + item, return_counts=True) for window, item, _ in seeds.hits(grams)]
            if not pairs:
                continue
            pair, number = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
            hits = np.bincount(number, weights=np.concatenate([c for _, c in pairs]))
            pair = pair[(seeds.n + 1) * hits >= least * seeds.tokens[pair % len(seeds.ids)]]
            kept = []
            for window, item, pos in seeds.hits(grams):
                own = (np.searchsorted(at, window, "right") - 1) * len(seeds.ids) + item
                k = np.minimum(np.searchsorted(pair, own), max(len(pair) - 1, 0))
                k = np.flatnonzero(pair[k] == own) if len(pair) else k[:0]
                kept.append((own[k], window[k], pos[k]))
            own, window, pos = (np.concatenate([x[k] for x in kept]) for k in range(3))
            order = np.lexsort((window, own))
            own, pos, window = own[order], pos[order], window[order]
            cuts = np.flatnonzero(np.diff(own)) + 1
            rows = []
            for a, b in zip([0, *cuts], [*cuts, len(own)], strict=True) if len(own) else ():
                doc, item = divmod(int(own[a]), len(seeds.ids))
                need = int(seeds.tokens[item])
                if found := _coverage(window[a:b] - at[doc], pos[a:b], need, seeds.n, least):
                    rows.append((batch.column(0)[i + doc].as_py(), seeds.ids[item], *found, need, found[1] / need))
            yield pa.RecordBatch.from_arrays(_rows(rows), _NAMES)


ITEM_SEEDS = "item long, item_id long, item_tokens int, seed long, item_pos int"
DOC_SEEDS = "doc long, doc_id long, seed long, pos int"


def _seeds_of(batches: Iterator[pa.RecordBatch], n: int, marks: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """ITEM_SEEDS of rows (id, text), or DOC_SEEDS where marks tell which seeds to keep; the first column numbers the rows."""
    row = TaskContext.get().partitionId() << 40
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False) if not batch.column(0).null_count else None
        for i, j, data, off in K.slices(batch.column(1)):
            starts, ends, first = K.spans(data, off, K.NOT_ALNUM)
            grams, at = K.ngrams(K.span_hashes(data, starts, ends), first, n)
            doc = np.repeat(np.arange(j - i), np.diff(at))
            pos = np.arange(len(grams)) - at[doc]
            keep = np.arange(len(grams)) if marks is None else np.flatnonzero(marked(grams.view(np.int64), marks))
            doc, grams, pos = doc[keep], grams[keep], pos[keep]
            own = pa.array(ids[i:j][doc], pa.int64()) if ids is not None else batch.column(0).slice(i, j - i).take(pa.array(doc))
            columns = [pa.array(row + i + doc), own, pa.array(np.diff(first)[doc].astype(np.int32)), pa.array(grams.view(np.int64)), pa.array(pos.astype(np.int32))]
            names = [x.split()[0] for x in ITEM_SEEDS.split(", ")]
            if marks is not None:
                del columns[2]
                names = [x.split()[0] for x in DOC_SEEDS.split(", ")]
            yield pa.RecordBatch.from_arrays(columns, names)
        row += batch.num_rows


def _pairs_tiled(batches: Iterator[pa.RecordBatch], n: int, least: float) -> Iterator[pa.RecordBatch]:
    """SCHEMA of hits in order of (doc, item); a pair may go on in the next batch."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pa.concat_batches([rest, batch])
        doc, item = batch.column("doc").to_numpy(), batch.column("item").to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(doc) != 0) | (np.diff(item) != 0)) + 1).tolist()]
        yield _pair_rows(batch, cuts, n, least)
        rest = batch.slice(cuts[-1])
    if rest is not None:
        yield _pair_rows(rest, [0, rest.num_rows], n, least)


def _pair_rows(hits: pa.RecordBatch, cuts: list[int], n: int, least: float) -> pa.RecordBatch:
    """SCHEMA of the pairs between the cuts."""
    pos, item_pos, need = (hits.column(c).to_numpy().astype(np.int64) for c in ("pos", "item_pos", "item_tokens"))
    rows = []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        if found := _coverage(pos[a:z], item_pos[a:z], int(need[a]), n, least):
            rows.append((hits.column("doc_id")[a].as_py(), hits.column("item_id")[a].as_py(), *found, int(need[a]), found[1] / int(need[a])))
    return pa.RecordBatch.from_arrays(_rows(rows), _NAMES)


def _items(benchmark: DataFrame, n: int) -> DataFrame:
    """Rows that can hold n tokens."""
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.length("text") >= 2 * n - 1)


def _small(benchmark: DataFrame, n: int, block: int) -> Broadcast | None:
    """The seeds of a benchmark of at most `block` characters, broadcast; None for a larger one."""
    items = _items(benchmark, n)
    if items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] > block:
        return None
    rows = items.collect()  # at most `block` characters
    return benchmark.sparkSession.sparkContext.broadcast(Seeds([r.item_id for r in rows], [r.text for r in rows], n))


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, n: int = MATCH, block: int = BLOCK) -> DataFrame:
    """SCHEMA: one row for each document row and benchmark item that it leaks."""
    spark, items, seeds = docs.sparkSession, _items(benchmark, n), _small(benchmark, n, block)
    if seeds:
        return texts(docs).mapInArrow(lambda batches: _tiled(batches, seeds.value, least), SCHEMA)
    parts = cut(items.mapInArrow(partial(_seeds_of, n=n), ITEM_SEEDS), "items")
    marks = spark.sparkContext.broadcast(bitmap(parts, "seed"))
    windows = cut(texts(docs).mapInArrow(lambda batches: _seeds_of(batches, n, marks.value), DOC_SEEDS), "windows")
    # A text leaks an item only with hits on need * least / n of the item's places, so it has one among all but so many less one of them: the places with the commonest seeds are left out
    often = windows.groupBy("seed").agg(F.count("*").alias("often"))
    order = W.partitionBy("item").orderBy(F.desc("often"), "item_pos")
    asking = parts.join(often, "seed").withColumn("place", F.row_number().over(order)).where(F.col("place") > F.ceil(F.col("item_tokens") * least / n) - 1)
    pairs = cut(windows.select("doc", "seed").join(asking.select("seed", "item"), "seed").select("doc", "item").distinct(), "pairs")
    hits = pairs.join(parts, "item").join(windows, ["doc", "seed"]).select("doc", "item", "doc_id", "item_id", "pos", "item_pos", "item_tokens")
    sorted_ = hits.repartition("doc", "item").sortWithinPartitions("doc", "item")
    return sorted_.mapInArrow(lambda batches: _pairs_tiled(batches, n, least), SCHEMA)


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = COVERAGE, n: int = MATCH, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose own text leaks no item, with their columns, whatever doc_id they have.

    With a small benchmark each row is judged where it is read; with a larger one the rows are numbered in a table in the shared folder."""
    seeds = _small(benchmark, n, block)
    if seeds:

        @F.arrow_udf("boolean")
        def clean(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for array in arrays:
                out = np.ones(len(array), bool)
                for found in _tiled(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(len(array))), array], ["doc_id", "text"])]), seeds.value, least):
                    out[found.column(0).to_numpy()] = False
                yield pa.array(out)

        return docs.where(clean(column("text").cast("string")))
    key = free_name(docs, "row_number")
    numbered = cut(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    bad = leaks(numbered.select(column(key).alias("doc_id"), "text"), benchmark, least, n, block).select(F.col("doc_id").alias("bad_row")).distinct()
    bad = cut(bad, "leaks").withColumnRenamed("bad_row", free_name(numbered, "bad_row"))
    return numbered.join(bad, numbered[key] == bad[bad.columns[0]], "left_anti").drop(key)
