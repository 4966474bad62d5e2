"""Periodic runs of words: stretches in which a few words come round again and again.

A run is a stretch of consecutive words with smallest period q and a length of at least max(LEAST, ROUNDS * q), which no neighbouring word extends keeping period q.

Only stretches whose every three-word window comes three times or more in its text can hold runs; windows are counted first, and the words elsewhere aren't searched. In a stretch, periods
are found scale by scale: at scale b (a power of two) the stretch is cut into blocks of b words at multiples of b. The blocks make up an Aho-Corasick automaton of integer
sequences, by which the whole stretch is searched. A run of period q, b <= q < 2b, holds a whole block and its copy q words on, so an occurrence b to 2b - 1 words behind an equal block is a seed:
from there the words are compared exactly in both directions as long as those q apart agree. What reaches the length and has a root without a smaller period of its own is a run.
Seeds inside a stretch already known for their period, or inside a run whose period divides theirs, are passed by; both would give nothing new.

Words are compared by their bytes: their numbers come from 64-bit hashes, and words that share a hash by chance get numbers of their own. A text is one unit of work, and all of it is searched.
A null text has no words and no runs, its collapsed text is empty; a null doc_id counts as an empty one; repeated rows are judged alike; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textkernel as K
from .shared import texts

LEAST, ROUNDS = 6, 4
RUNS = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _agreeing(w: np.ndarray, at: int, d: int, way: int) -> int:
    """From `at` on to the right (way 1), or from `at` - 1 to the left (-1): how many words in a row equal the one d later."""
    have, chunk = 0, 16
    room = len(w) - d - at if way > 0 else at
    while have < room:
        size = min(chunk, room - have)
        lo = at + have if way > 0 else at - have - size
        apart = np.flatnonzero(w[lo : lo + size] != w[lo + d : lo + d + size])
        if len(apart):
            return have + int(apart[0] if way > 0 else size - 1 - apart[-1])
        have, chunk = have + size, 2 * chunk
    return have


def _is_root(root: np.ndarray) -> bool:
    """Whether the words aren't a shorter stretch several times over."""
    n, left, p = len(root), len(root), 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            q = n // p
            if (root[q:] == root[:-q]).all():
                return False
            while left % p == 0:
                left //= p
        p += 1
    return True


def _seeds(w: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of aligned blocks of b words with an equal stretch b to 2b - 1 words on."""
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    words, number = tuple(w.tolist()), {}
    own = np.array([number.setdefault(words[k : k + b], len(number)) for k in range(0, len(words) - b + 1, b)])
    for block, k in number.items():
        automaton.add_word(block, k)
    automaton.make_automaton()
    found = np.array(list(automaton.iter(words)), np.int64).reshape(-1, 2)
    at = found[:, 0] - b + 1
    late = at >= b
    at, block = at[late], found[late, 1]
    before = at // b - 1
    same = own[before] == block
    return before[same] * b, (at - before * b)[same]


def find(w: np.ndarray, least: int = LEAST, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of integers."""
    out: list[tuple[int, int, int]] = []
    stop, period = np.zeros(len(w), np.int64), np.ones(len(w), np.int64)  # of a run that covers the place
    b = 1
    while rounds * b <= len(w):
        s, d = _seeds(w, b)
        new = (rounds * d <= len(w)) & ((s + d > stop[s]) | (d % period[s] > 0))
        s, d = s[new], d[new]
        order = np.lexsort((s, d))
        known = (0, 0)  # (period, end of what is known for it)
        for at, q in zip(s[order].tolist(), d[order].tolist(), strict=True):
            if known[0] == q and at < known[1]:
                continue
            lo, hi = at - _agreeing(w, at, q, -1), at + _agreeing(w, at, q, 1)
            known = (q, hi)
            size = hi - lo + q
            if size >= max(least, rounds * q) and _is_root(w[lo : lo + q]):
                out.append((lo, size, q))
                further = slice(lo, lo + size)
                wins = stop[further] < lo + size
                stop[further][wins], period[further][wins] = lo + size, q
        b *= 2
    return sorted(out)


def _numbers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal bytes alone."""
    _, one, which = np.unique(hashes, return_index=True, return_inverse=True)
    apart = np.flatnonzero(~K.same_spans(data, starts, ends, data, starts[one[which]], ends[one[which]]))
    more: dict[bytes, int] = {}
    for k in apart.tolist():
        which[k] = len(one) + more.setdefault(data[starts[k] : ends[k]].tobytes(), len(more))
    return which


def _stretches(hashes: np.ndarray, first: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(first word, end) of stretches of `least` words or more whose three-word windows all come three times or more in their text."""
    grams, at = K.ngrams(hashes, first, 3)
    if not len(grams):
        return []
    doc = np.repeat(np.arange(len(first) - 1), np.diff(at))
    order = np.lexsort((grams, doc))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(doc[order]) != 0) | (grams[order][1:] != grams[order][:-1])]))
    size = np.diff(np.append(new, len(grams)))
    often = np.zeros(len(grams) + 2, bool)
    often[1 + order[np.repeat(size >= 3, size)]] = True
    pos = K.window_positions(first, at)
    change = often[1:] != often[:-1]
    change[at] |= often[at] & often[np.minimum(at + 1, len(grams) + 1)]  # a text's end between two marked windows
    cuts = np.flatnonzero(change)
    lo = cuts[often[cuts + 1]]
    hi = cuts[np.searchsorted(cuts, lo, "right")]
    return [(int(pos[a]), int(pos[z - 1]) + 3) for a, z in zip(lo, hi, strict=True) if z - a >= least - 2]


def _with_tails(ids: list, first: np.ndarray) -> np.ndarray:
    """Which word stands at each place after the edit that runs() describes."""
    at = np.arange(first[-1])
    for k, doc in enumerate(ids):
        h, n = zlib.crc32(("" if doc is None else str(doc)).encode()), int(first[k + 1] - first[k])
        if h % 10 == 0 and n > 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            begin = int(first[k]) + a
            at[begin : first[k + 1]] = begin + np.arange(n - a) % p
    return at


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> pa.Array:
    """The words of each text, joined by one space."""
    size = ends - starts + 1
    out = K.ragged(np.append(data, np.uint8(32)), starts, size)
    off = np.concatenate([[0], np.cumsum(size)])
    out[off[1:] - 1] = 32
    last = off[first[1:]][np.diff(first) > 0] - 1  # the space behind the last word of a text
    keep = np.ones(len(out), bool)
    keep[last] = False
    bounds = off[first] - np.concatenate([[0], np.cumsum(np.diff(first) > 0)])
    return pa.Array.from_buffers(pa.large_string(), len(first) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out[keep].tobytes())]).cast(pa.string())


def _found(batches: Iterator[pa.RecordBatch], tails: bool, least: int, rounds: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, off in K.slices(batch.column("text")):
            starts, ends, first = K.spans(data, off)
            hashes = K.span_hashes(data, starts, ends, lower=False)
            ids = batch.column("doc_id").slice(i, j - i)
            if tails:
                at = _with_tails(ids.to_pylist(), first)
                starts, ends, hashes = starts[at], ends[at], hashes[at]
            kept = np.ones(len(starts), bool)
            n_runs, flat = np.zeros(j - i, np.int64), []
            for a, z in _stretches(hashes, first, least):
                doc = int(np.searchsorted(first, a, "right")) - 1
                begin = a - int(first[doc])
                for start, length, period in find(_numbers(data, starts[a:z], ends[a:z], hashes[a:z]), least, rounds):
                    flat.append((begin + start, length, period))
                    n_runs[doc] += 1
                    kept[a + start + period : a + start + length] = False
            columns = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_runs)]).astype(np.int32)), pa.StructArray.from_arrays(columns, ["start", "length", "period"]))
            left = np.concatenate([[0], np.cumsum(kept)])[first]
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first), pa.int64()), runs, _joined(data, starts[kept], ends[kept], left)], ["doc_id", "n_words", "runs", "collapsed"])


def runs(docs: DataFrame, tails: bool = False, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """RUNS for each row of docs: the runs by start, then period, and the text without the words that some run holds after its first period, the others joined by one space.

    tails: texts get repeated ends first. With h = crc32(doc_id), g = h div 10 and n words, where 10 divides h the words from a = g % n on repeat their first 1 + (n - a) div (3 + g % 8) ones.
    rounds is 4 at least: with fewer, a run's windows needn't come three times.
    """
    if rounds < ROUNDS or least < LEAST:
        raise ValueError(f"runs of {rounds} rounds and {least} words aren't found")
    return texts(docs).mapInArrow(partial(_found, tails=tails, least=least, rounds=rounds), RUNS)
