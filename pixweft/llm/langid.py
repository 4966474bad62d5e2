"""Language ID by cross-parsing entropy.

A suffix automaton of sample text is built for each language. A text is parsed greedily into
the longest phrases that occur in a language's sample; the language that needs the fewest
phrases per symbol wins (of equal ones the first by name). Symbols are lower-cased letters, and one space for each run of
anything else. Texts are parsed whole, in segments of SEGMENT symbols that run side by side;
a phrase ends at the end of its segment, in all languages alike.

The sample is bounded: of each language at most ROWS different whole texts with a letter, of at most CHARS characters together
(the first always counts), in order of a hash of the text, those of at most LONG characters first. They come from rows with a language whose crc32(doc_id) mod FOLDS
isn't HELD_OUT; copies count once. A worker holds about 15 MB for each language.

Null texts and texts without a letter are `und` with score 0. Without any sample, all are.
A null doc_id hashes as an empty string. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import column, judged, texts

ROWS, CHARS, LONG, FOLDS, HELD_OUT, SEGMENT = 40, 40_000, 1_000, 4, 2, 512
#: Phrases per symbol above which no language fits; prose needs about a third of that.
MAX_RATE = 0.6
OUT = "lang_pred string, score double, rate double"


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """(language, text), sorted: for each language at most ROWS texts and, from the second on, CHARS characters."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", F.xxhash64("text").alias("hash"), F.length("text").alias("size"), "text")
    order = W.partitionBy("lang").orderBy(F.col("size") > LONG, "hash", "size")
    ranked = rows.select("lang", "hash", "size").distinct().withColumn("n", F.row_number().over(order)).where(f"n <= {ROWS}")
    chosen = ranked.withColumn("total", F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0))).where(f"n = 1 or total <= {CHARS}")
    # ROWS small rows for each language; their texts are collected here in any case
    found = rows.join(F.broadcast(chosen.select("lang", "hash", "size")), ["lang", "hash", "size"], "left_semi")
    return sorted((r.lang, r.text) for r in found.groupBy("lang", "hash", "size").agg(F.min("text").alias("text")).collect())


class Alphabet:
    """Symbols of characters: 0 for letters that no sample has, 1 for the space between words, then the samples' letters."""

    def __init__(self, text: str):
        letters = sorted({c for c in text.lower() if c.isalpha()})
        self.size = len(letters) + 2
        self.number = {c: i + 2 for i, c in enumerate(letters)}
        self.table = np.full(0x110000, -1, np.int32)

    def symbols(self, points: np.ndarray) -> np.ndarray:
        got = self.table[points]
        if (got < 0).any():
            for p in np.unique(points[got < 0]).tolist():
                c = chr(p)
                low = c.lower()
                self.table[p] = self.number.get(low, self.number.get(low[0], 0)) if c.isalpha() else 1
            got = self.table[points]
        return got


def automaton(symbols: list[int], size: int) -> np.ndarray:
    """The suffix automaton of a sequence as a flat table: entry [state * size + symbol] is twice the next row's start,
    plus 1 where the phrase can't go on and the symbol starts a new one."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for s in symbols:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and s not in moves[p]:
            moves[p][s] = now
            p = link[p]
        if p >= 0:
            q = moves[p][s]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(s) == q:
                    moves[p][s] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    root = np.zeros(size, np.int32)
    for s, to in moves[0].items():
        root[s] = to
    table = np.tile(root * np.int32(size * 2) + np.int32(1), (len(moves), 1))
    for state, row in enumerate(moves):
        for s, to in row.items():
            table[state, s] = to * size * 2
    table[0, :] = root * np.int32(size * 2) + np.int32(1)  # every phrase counts when it starts
    return table.ravel()


_built: dict[tuple[tuple[str, str], ...], tuple[Alphabet, list[str], list[np.ndarray]]] = {}


def models(rows: tuple[tuple[str, str], ...]) -> tuple[Alphabet, list[str], list[np.ndarray]]:
    """The automata of a sample; a worker keeps one sample's, and drops them before it builds others."""
    if rows not in _built:
        _built.clear()
        _built[rows] = _models(rows)
    return _built[rows]


def _models(rows: tuple[tuple[str, str], ...]) -> tuple[Alphabet, list[str], list[np.ndarray]]:
    alphabet = Alphabet("".join(t for _, t in rows))
    names = sorted({name for name, _ in rows})
    out = []
    for name in names:
        points = np.frombuffer(" ".join(t for n, t in rows if n == name).encode("utf-32-le"), np.uint32)
        symbols = alphabet.symbols(points)
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 1) | (symbols[:-1] != 1)
        out.append(automaton(symbols[keep].tolist(), alphabet.size))
    return alphabet, names, out


def phrases(symbols: np.ndarray, first: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Phrases that each text (symbols[first[i]:first[i+1]]) needs in each language."""
    size = np.diff(first)
    pieces = -(-size // SEGMENT)
    doc = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = first[doc] + number * SEGMENT
    length = np.minimum(first[doc + 1] - start, SEGMENT)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    running = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")  # segments longer than k
    state = [np.zeros(len(doc), np.int32) for _ in tables]
    count = [np.zeros(len(doc), np.int32) for _ in tables]
    for k, n in enumerate(running.tolist()):
        now = symbols[start[:n] + k]
        for t, table in enumerate(tables):
            entry = table[state[t][:n] + now]
            count[t][:n] += entry & 1
            state[t][:n] = entry >> 1
    return np.stack([np.bincount(doc[order], weights=c, minlength=len(size)) for c in count], axis=1) if tables else np.zeros((len(size), 0))


def _predicted(batches: Iterator[pa.RecordBatch], rows: tuple[tuple[str, str], ...]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        alphabet, names, tables = models(rows)
        parts = []
        for _, _, data, off in K.slices(batch.column(0), 1 << 19):
            points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            heads = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
            at = heads[off]
            symbols = alphabet.symbols(points)
            letter = np.zeros(len(points) + 1, np.int64)
            np.cumsum(symbols != 1, out=letter[1:])
            has = letter[at[1:]] > letter[at[:-1]]
            keep = np.ones(len(symbols), bool)
            keep[1:] = (symbols[1:] != 1) | (symbols[:-1] != 1)
            keep[at[:-1][at[:-1] < len(symbols)]] = True
            kept = np.zeros(len(points) + 1, np.int64)
            np.cumsum(keep, out=kept[1:])
            first = kept[at]
            rate = phrases(symbols[keep].astype(np.int32), first, tables) / np.maximum(np.diff(first), 1)[:, None]
            if not names:
                parts.append((["und"] * len(has), np.zeros(len(has)), np.ones(len(has))))
                continue
            best = rate.argmin(axis=1)
            low = rate[np.arange(len(rate)), best]
            rate[np.arange(len(rate)), best] = np.inf
            next_ = rate.min(axis=1)
            score = np.where(np.isfinite(next_), 1 - low / np.where(np.isfinite(next_), low + next_, 1), 1.0)
            parts.append(([names[b] if h else "und" for b, h in zip(best, has, strict=True)], np.where(has, score, 0.0), np.where(has, low, 1.0)))
        columns = [pa.array([x for p in parts for x in p[0]], pa.string()), *(pa.array(np.concatenate([np.zeros(0), *(p[k] for p in parts)])) for k in (1, 2))]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "lang_pred", "score", "rate"])


def predict(docs: DataFrame) -> DataFrame:
    """All rows of docs as (doc_id, held_out, lang_pred, score, rate); score is 1 - best rate / (best + next rate)."""
    rows = docs.sparkSession.sparkContext.broadcast(tuple(sample(docs)))
    plain = texts(docs).select("text", "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"))
    return plain.mapInArrow(lambda batches: _predicted(batches, rows.value), f"doc_id long, held_out boolean, {OUT}")


def keep_known(docs: DataFrame) -> DataFrame:
    """The rows of docs that some language fits, with all their columns, which may be of any type and name."""
    rows = docs.sparkSession.sparkContext.broadcast(tuple(sample(docs)))
    fits = lambda out: pc.and_(pc.not_equal(out.column("lang_pred"), "und"), pc.less_equal(out.column("rate"), MAX_RATE)).combine_chunks()
    return docs.where(judged(column("text"), lambda batches: _predicted(batches, rows.value), fits))
