"""Byte-level BPE by a pair occurrence index, with the vocabulary file of a public tokenizer.

Per slice of a partition: texts are cut before white space into chunks, chunks into
pre-tokens, and the pre-tokens that the task hasn't met yet are merged together. One index maps
each rank to the positions of its pair; the least active rank is applied at all its
positions at once, the pairs beside them get new ranks, and their positions join the lists of those ranks.

A null text is an empty one: no ids, an empty decoded text. Memory per task: some 30 times
SLICE or the longest text, and CACHE pre-tokens. Repeated rows are encoded alike.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import textkernel as K
from .shared import texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
SLICE, CACHE = 1 << 20, 200_000
_NONE = np.int64(1 << 40)
_SPACE = r"\x09-\x0d\x20\x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Above this character, the library itself splits: its Unicode tables may be of another version.
_PLAIN = "ɏ"


def byte_alphabet() -> list[str]:
    """The printable character for each byte: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Ranks, ids and bytes of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        letters = byte_alphabet()
        back = {c: b for b, c in enumerate(letters)}
        self.byte_id = np.array([vocab[c] for c in letters], np.int64)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.key, self.key_rank = key[order], order.astype(np.int64)
        self.new_id = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.double = left == right
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for s, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.back = back
        self.split = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.known: dict[bytes, bytes] = {}

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.key_rank[at], _NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as bytes of little-endian unsigned 32-bit integers."""
        raw = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words], np.int64)
        end = np.cumsum(size)
        n = len(raw)
        token = self.byte_id[raw]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[end - 1] = -1
        before[end - size] = -1
        alive = np.ones(n, bool)
        rank = np.full(n, _NONE, np.int64)
        open_ = np.flatnonzero(after >= 0)
        rank[open_] = self.ranks(token[open_], token[open_ + 1])
        lists: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enlist(pos: np.ndarray) -> None:
            r = rank[pos]
            pos = pos[r != _NONE]
            if not len(pos):
                return
            r = rank[pos]
            order = np.argsort(r, kind="stable")
            r, pos = r[order], pos[order]
            cut = np.flatnonzero(r[1:] != r[:-1]) + 1
            for k, part in zip(r[np.concatenate([[0], cut])].tolist(), np.split(pos, cut) if len(cut) else [pos], strict=True):
                if k in lists:
                    lists[k].append(part)
                else:
                    lists[k] = [part]
                    heapq.heappush(active, k)

        enlist(open_)
        while active:
            k = heapq.heappop(active)
            parts = lists.pop(k)
            pos = parts[0] if len(parts) == 1 else np.concatenate(parts)
            pos = pos[(rank[pos] == k) & alive[pos]]
            if not len(pos):
                continue
            if len(parts) > 1:
                pos = np.unique(pos)
            if self.double[k]:  # aaa: the left pair goes first, and takes what the next would start with
                taken, first = set(), []
                for p in pos.tolist():
                    if p not in taken:
                        first.append(p)
                        taken.add(int(after[p]))
                pos = np.array(first, np.int64)
            gone = after[pos]
            token[pos] = self.new_id[k]
            alive[gone] = False
            rank[gone] = _NONE
            follow = after[gone]
            after[pos] = follow
            has = follow >= 0
            before[follow[has]] = pos[has]
            rank[pos] = _NONE
            right = pos[has]
            left = before[pos]
            left = left[left >= 0]
            touched = np.concatenate([left, right])
            if len(touched):
                rank[touched] = self.ranks(token[touched], token[after[touched]])
                enlist(touched)
        ids = token[alive].astype("<u4").tobytes()
        count = np.zeros(n + 1, np.int64)
        np.cumsum(alive, out=count[1:])
        return [ids[4 * a : 4 * b] for a, b in zip(count[end - size].tolist(), count[end].tolist(), strict=True)]

    def pretokens(self, chunk: str) -> list[bytes | int]:
        """Bytes of pre-tokens, and the ids of special tokens in the text."""
        if self.split and "<" in chunk and (found := list(self.split.finditer(chunk))):
            out, at = [], 0
            for m in found:
                out += self.pretokens(chunk[at : m.start()]) if at < m.start() else []
                out.append(self.special[m[0]])
                at = m.end()
            return out + (self.pretokens(chunk[at:]) if at < len(chunk) else [])
        if chunk.isascii() or max(chunk) <= _PLAIN:
            return [w.encode() for w in _WORD.findall(chunk)]
        return [bytes(self.back[c] for c in w) for w, _ in self.library.pre_tokenize_str(chunk)]

    def chunk_ids(self, chunks: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        parts = [self.pretokens(c.decode()) for c in chunks]
        new = list({w for p in parts for w in p if isinstance(w, bytes) and w not in self.known})
        if new:
            self.known.update(zip(new, self.merge(new), strict=True))
        known = self.known
        return [b"".join([known[w] if isinstance(w, bytes) else w.to_bytes(4, "little") for w in p]) for p in parts]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


#: Second last and last bytes of Unicode spaces beyond ASCII; a run of white space is never cut inside.
_SPACE_ENDS = [(0xC2, (0x85, 0xA0)), (0x9A, (0x80,)), (0x80, (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0x81, (0x9F,))]


def chunk_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A chunk begins with each text and with each ASCII space after something that is no space."""
    space = K.SPACE[data]
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    if len(data) and int(data.max()) >= 0x80:
        at = np.flatnonzero(begin)
        at = at[at >= 2]
        a, b = data[at - 2], data[at - 1]
        for first, last in _SPACE_ENDS:
            begin[at[(a == first) & np.isin(b, last)]] = False
    begin[off[:-1][np.diff(off) > 0]] = True
    return np.flatnonzero(begin)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """The distinct spans, and for each span the number of its own. A span that shares its hash with another, but not its bytes, is listed alone."""
    _, first, number = np.unique(K.span_hashes(data, starts, ends, lower=False), return_index=True, return_inverse=True)
    like = first[number]
    odd = np.flatnonzero(~K.same_spans(data, starts, ends, data, starts[like], ends[like]))
    number[odd] = len(first) + np.arange(len(odd))
    first = np.append(first, odd)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], number


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    for batch in batches:
        for i, j, data, off in K.slices(batch.column(1), SLICE):
            starts = chunk_starts(data, off)
            own, number = distinct(data, starts, np.append(starts[1:], len(data)))
            coded = vocab.chunk_ids(own)
            size = np.array([len(x) // 4 for x in coded], np.int64)
            begin = np.cumsum(size) - size
            ids = K.ragged(np.frombuffer(b"".join(coded), np.int32), begin[number], size[number])
            total = np.zeros(len(number) + 1, np.int64)
            np.cumsum(size[number], out=total[1:])
            lists = pa.ListArray.from_arrays(pa.array(total[np.searchsorted(starts, off)].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0)[i:j], lists], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids array<int>) of every text; special tokens' strings in a text become their ids."""
    return texts(docs).mapInArrow(partial(_encoded, path=path), "doc_id long, ids array<int>")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    vocab = vocabulary(path)
    size = np.array([len(x) for x in vocab.bytes], np.int64)
    begin, every = np.cumsum(size) - size, np.frombuffer(b"".join(vocab.bytes), np.uint8)
    for batch in batches:
        off = batch.column(1).offsets.to_numpy().astype(np.int64)
        ids, n, i = batch.column(1).values.to_numpy(zero_copy_only=False), len(off) - 1, 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(off, off[i] + SLICE // 4, "right")) - 1)
            own = ids[off[i] : off[j]]
            raw = K.ragged(every, begin[own], size[own]).tobytes()
            total = np.zeros(len(own) + 1, np.int64)
            np.cumsum(size[own], out=total[1:])
            bounds = total[off[i : j + 1] - off[i]].tolist()
            out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            rows = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.string())], ["doc_id", "ids", "text"])
            i = j


def decode(tokens: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids, text) of (doc_id, ids); bytes that aren't UTF-8 become U+FFFD, special tokens are kept."""
    return tokens.select("doc_id", F.coalesce("ids", F.expr("cast(array() as array<int>)")).alias("ids")).mapInArrow(partial(_decoded, path=path), "doc_id long, ids array<int>, text string")
