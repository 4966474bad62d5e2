"""Spelling variants: words that differ by one code point, grouped under their most frequent neighbour.

Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, of which A-Z alone is lower-cased. count_words() counts all of them over whole texts: distinct ones of each slice in
tasks, then one aggregate, so a word that fills a third of the corpus moves as one row a slice.

variants() finds every pair of words that differ by exactly one inserted, deleted or replaced code point. Such an error lies in one half of the word; the other half is met exactly.
So a word looks for its first half among the first halves of all words, and for its last half among the last halves (a neighbour may be one shorter or longer, which
shifts its middle: each word is filed under at most two halves in either direction). Words of one half share a bucket; a half of more than LIMIT words is
split over several buckets, and those who look for it go to each of them. In a bucket, the words make up a minimal acyclic automaton, of the reversed words for
the other direction, whose nodes count the words behind them: a word's number is the sum of the counts that its path passes by. The half is read exactly, the rest completed with one error,
and the numbers reached are the neighbours. What both directions find is counted once.

A word's form is its neighbour with the largest count (of equal ones the smallest in code-point order), if that is RATIO times its own or more; its root is the last of the forms in a row. As counts
at least double, a row is as long as their logarithm; it is followed by pointer doubling.

Null texts have no words, a null doc_id counts as an empty one, repeated rows count each time, empty tables give no rows. Words may be of any length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import cut, texts

LEAST_POINTS, LEAST_COUNT, RATIO, LIMIT, SLICE = 5, 3, 2, 1 << 14, 1 << 20
COUNTS = "word string, n long"

_LETTER = ~K.NOT_ALNUM
_LETTER[128:] = False
_LETTER[48:58] = False
_LEAD = 0xC3  # of U+00C0 to U+00FF in UTF-8, and of nothing else

_CRC = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
#: The table of the byte-wise form, from the values of single bytes: crc32(b) = T[b ^ 255] ^ 0x00FFFFFF ^ 0xFFFFFFFF.
_STEP = np.empty(256, np.uint32)
_STEP[np.arange(256) ^ 255] = _CRC ^ np.uint32(0xFF000000)


def letter_runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts, and the first word of each text."""
    other = ~_LETTER[data]
    lead = data == _LEAD
    other[lead] = False
    other[1:][lead[:-1]] = False
    return K.spans(other.view(np.uint8), off, np.arange(256) == 1)


def crc_of_spans(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of what gave `state` followed by each span's bytes, all spans side by side."""
    crc = state.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    crc, at = crc[order], starts[order]
    left = np.searchsorted(-size[order], -np.arange(size.max(initial=0)), "left")
    for k, n in enumerate(left.tolist()):
        crc[:n] = _STEP[(crc[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    out = np.empty_like(crc)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def _of_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The spans' bytes as strings."""
    off = np.concatenate([[0], np.cumsum(ends - starts)])
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(K.ragged(data, starts, ends - starts).tobytes())])


def _counted(batches: Iterator[pa.RecordBatch], least: int, losing: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, raw, off in K.slices(batch.column("text"), SLICE):
            starts, ends, first = letter_runs(raw, off)
            data = K.LOWER[raw]
            marks = np.concatenate([[0], np.cumsum(data == _LEAD)])
            points = ends - starts - (marks[ends] - marks[starts])
            long = np.flatnonzero(points >= least)
            doc = np.searchsorted(first, long, "right") - 1
            starts, ends, points = starts[long], ends[long], points[long]
            lost: list[str] = []
            if losing:
                ids = ["" if d is None else str(d) for d in batch.column("doc_id").slice(i, j - i).to_pylist()]
                begun = np.array([zlib.crc32(f"{d}:".encode()) for d in ids], np.uint32)
                h = crc_of_spans(begun[doc], data, starts, ends)
                gone = h % np.uint32(losing) == 0
                for k in np.flatnonzero(gone).tolist():
                    word = data[starts[k] : ends[k]].tobytes().decode()
                    at = int(h[k]) % len(word)
                    if len(word) > least:
                        lost.append(word[:at] + word[at + 1 :])
                starts, ends = starts[~gone], ends[~gone]
            hashes = K.span_hashes(data, starts, ends, lower=False)
            _, one, which, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            same = K.same_spans(data, starts, ends, data, starts[one[which]], ends[one[which]])
            apart = np.flatnonzero(~same)  # words whose hash is another's by chance
            n -= np.bincount(which[apart], minlength=len(n))
            lost += [data[starts[k] : ends[k]].tobytes().decode() for k in apart.tolist()]
            words = pa.concat_arrays([_of_spans(data, starts[one], ends[one]), pa.array(lost, pa.large_string())])
            yield pa.RecordBatch.from_arrays([words.cast(pa.string()), pa.array(np.concatenate([n, np.ones(len(lost), np.int64)]))], ["word", "n"])


def count_words(docs: DataFrame, least: int = LEAST_POINTS, losing: int = 0) -> DataFrame:
    """COUNTS of the words of at least `least` code points.

    losing, if not 0, is the chance 1 / losing at which a word loses a code point in a text: where it divides h, the crc32 of `doc_id:word`, the word's code point h % length is left out.
    """
    return texts(docs).mapInArrow(partial(_counted, least=least, losing=losing), COUNTS).groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words; each node knows its edges and how many words end at or behind it.

    Words are added in order: nodes off the new word's path can't change any more and are shared with equal ones met before. Edges keep the order of their letters, for each is added after the smaller ones.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, int]] = [{}]
        self.ends: list[bool] = [False]
        known: dict[tuple, int] = {}
        path: list[tuple[int, str, int]] = []

        def settle(depth: int) -> None:
            while len(path) > depth:
                parent, letter, node = path.pop()
                key = (self.ends[node], *self.edges[node].items())
                self.edges[parent][letter] = known.setdefault(key, node)

        before = ""
        for word in words:
            depth = next((k for k, (x, y) in enumerate(zip(before, word, strict=False)) if x != y), min(len(before), len(word)))
            settle(depth)
            node = path[-1][2] if path else 0
            for letter in word[depth:]:
                self.edges.append({})
                self.ends.append(False)
                new = len(self.edges) - 1
                self.edges[node][letter] = new
                path.append((node, letter, new))
                node = new
            self.ends[node] = True
            before = word
        settle(0)
        words_behind = [-1] * len(self.edges)
        #: For each node its edges by letter: (node, how many of the node's words come before those behind the edge).
        self.steps: list[dict[str, tuple[int, int]]] = [{}] * len(self.edges)
        todo = [0]
        while todo:  # a node after those behind it
            node = todo[-1]
            open_ = [x for x in self.edges[node].values() if words_behind[x] < 0]
            if open_:
                todo += open_
                continue
            todo.pop()
            if words_behind[node] < 0:
                count, steps = int(self.ends[node]), {}
                for letter, to in self.edges[node].items():
                    steps[letter] = (to, count)
                    count += words_behind[to]
                words_behind[node], self.steps[node] = count, steps

    def read(self, node: int, number: int, rest: str) -> tuple[int, int] | None:
        """(node, number) behind the letters; number: how many words come before all that lie behind the node."""
        steps = self.steps
        for letter in rest:
            found = steps[node].get(letter)
            if found is None:
                return None
            node, number = found[0], number + found[1]
        return node, number

    def one_error(self, word: str, exact: int) -> set[int]:
        """The numbers of the words that begin with the first `exact` letters and differ from `word` by one insertion, deletion or replacement behind them."""
        out: set[int] = set()
        at = self.read(0, 0, word[:exact])
        for k in range(exact, len(word) + 1):
            if at is None:
                break
            node, number = at
            rest, after = word[k:], word[k + 1 :]
            for letter, (to, more) in self.steps[node].items():
                nexts = self.steps[to]
                # inserted, and replaced: the edge, then what is left of the word
                for tail in (rest, after) if rest and letter != rest[0] else (rest,):
                    if (not tail or tail[0] in nexts) and (end := self.read(to, number + more, tail)) and self.ends[end[0]]:
                        out.add(end[1])
            if rest:
                if (end := self.read(node, number, after)) and self.ends[end[0]]:  # deleted
                    out.add(end[1])
                at = self.read(node, number, rest[0])
        return out


PAIRS = "word string, near string, near_n long"


def _matched(rows: pa.Table) -> pa.Table:
    """PAIRS of a bucket's rows (direction, asks, word, n, exact): those that ask, against those that don't."""
    back = rows.column("direction")[0].as_py() == 1
    asks, exact = rows.column("asks").to_pylist(), rows.column("exact").to_pylist()
    words, counts = rows.column("word").to_pylist(), rows.column("n").to_pylist()
    turned = [w[::-1] for w in words] if back else words
    known = dict(sorted((turned[k], k) for k, ask in enumerate(asks) if not ask))
    numbered, automaton = list(known.values()), Automaton(list(known))
    found = [(words[k], numbered[x]) for k, ask in enumerate(asks) if ask for x in automaton.one_error(turned[k], exact[k])]
    return pa.Table.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([words[k] for _, k in found], pa.string()), pa.array([counts[k] for _, k in found], pa.int64())], ["word", "near", "near_n"])


def _filed(words: DataFrame) -> DataFrame:
    """(direction, half, asks, exact, word, n): each word under the halves where others look for it, and once in each direction under the half that it looks for."""
    size = "length(word)"
    first = [f"({size} - 1) div 2", f"{size} div 2", f"({size} + 1) div 2"]
    last = [f"{size} div 2", f"({size} + 1) div 2", f"({size} + 2) div 2"]
    entries = [f"transform(array_distinct(array({', '.join(k)})), k -> named_struct('direction', {d}, 'half', {half}, 'asks', false, 'exact', cast(k as int)))" for d, k, half in ((0, first, "left(word, k)"), (1, last, "right(word, k)"))]
    asked = [f"named_struct('direction', {d}, 'half', {half}, 'asks', true, 'exact', cast({k} as int))" for d, k, half in ((0, first[1], f"left(word, {first[1]})"), (1, last[1], f"right(word, {last[1]})"))]
    return words.select("word", "n", F.explode(F.expr(f"concat({', '.join(entries)}, array({', '.join(asked)}))")).alias("f")).select("f.*", "word", "n")


def neighbours(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """PAIRS of the words (word, n), each pair in both orders."""
    filed = _filed(words)
    size = filed.where("not asks").groupBy("direction", "half").agg(F.count("*").alias("size"))
    total = size.agg(F.sum("size")).first()[0] or 0
    hot = size.where(F.col("size") > limit).select("direction", "half", F.expr(f"cast(ceil(size / {limit}) as int)").alias("parts"))
    dealt = filed.join(hot, ["direction", "half"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.explode(F.expr("if(asks, sequence(0, parts - 1), array(cast(pmod(xxhash64(word), parts) as int)))"))
    dealt = dealt.withColumn("part", part).withColumn("bucket", F.expr(f"pmod(xxhash64(direction, half, part), {max(1, -(-total // limit))})"))
    found = dealt.select("direction", "bucket", "asks", "word", "n", "exact").groupBy("direction", "bucket").applyInArrow(_matched, PAIRS)
    return found.distinct()


def variants(counts: DataFrame, limit: int = LIMIT, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    words = cut(counts.select("word", "n"), "words")
    near = neighbours(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    own = words.join(near, "word", "left")
    largest = -F.col("best.less")
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(largest >= ratio * F.col("n"), F.struct(F.col("best.near").alias("form"), largest.alias("form_n"))).alias("f"))
    own = cut(own.select("word", "n", "n_near", "f.form", "f.form_n"), "forms")
    up = own.where("form is not null").select("word", F.col("form").alias("to"))
    while True:
        further = up.select(F.col("word").alias("to"), F.col("to").alias("next"))
        stepped = cut(up.join(further, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "roots")
        up = stepped.select("word", "to")
        if not stepped.where("moved").limit(1).count():
            break
    return own.join(up, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame, losing: int = 0) -> DataFrame:
    """variants() of the words that docs hold LEAST_COUNT times or more."""
    return variants(count_words(docs, losing=losing).where(F.col("n") >= LEAST_COUNT))
