"""Token ids in a file of Huffman-coded blocks.

A file set is a folder with two Parquet tables. `codes` has the code length of each id, limited to
LIMIT bits (package-merge over the global counts); codes are canonical: ordered by length, then id.
`blocks` has, for each block of whole documents (about BLOCK ids; a longer document has a block of its own):
file and block number, the place of its first id in the file, document ids and lengths, the bit
string, and the bit offset of every CHECK-th id. Files follow ascending doc_id, blocks and
documents too. A block is decoded alone, all its checkpoints side by side, by one table of 2 ** LIMIT entries.

Ids take 16 bits, so a vocabulary of over 65,536 ids is refused. Places of files are summed in one window over a row for each file.

Null texts have the end id alone. Null doc_ids come first. Documents with one doc_id follow each
other in any order. An empty table gives an empty file set.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import textkernel as K
from .shared import cut, note, shared_dir, texts

VOCABULARY, END = public_tokenizers.path("word_bpe_49k.json"), 2
LIMIT, BLOCK, CHECK, CACHE = 20, 1 << 18, 128, 1_000_000
RAW = "file int, block int, first long, doc_ids array<long>, lengths array<int>, ids binary"
BLOCKS = "file int, block int, first long, doc_ids array<long>, lengths array<int>, bits binary, checkpoints array<int>"


#: Between letters, digits and other printable signs (1, 2, 3), and between digits, the tokenizer always splits. 0: space, 4: all other bytes, beside which nothing is cut.
_KIND = np.full(256, 4, np.uint8)
_KIND[0x21:0x7F] = 3
_KIND[[*range(65, 91), *range(97, 123)]] = 1
_KIND[48:58] = 2
_KIND[K.SPACE] = 0
_KIND[39] = 4  # 's and the like are tokens


def kinds(data: np.ndarray) -> np.ndarray:
    """_KIND of each byte, and 1 for both bytes of the letters from U+00C0 to U+00FF."""
    kind = _KIND[data]
    lead = np.flatnonzero(data == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    kind[lead] = kind[lead + 1] = 1
    return kind


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces that the tokenizer encodes independently: starts, ends, the text with A-Z lower-cased but in words with <| (equal pieces of it get equal ids), whether they are of one kind from 1 to 3; and the first piece of each text."""
    starts, ends, _ = K.spans(data, off)
    kind = kinds(data)
    cut = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    cut &= (kind[1:] % 4 > 0) & (kind[:-1] % 4 > 0)
    new = np.zeros(len(data) + 1, bool)
    new[starts] = True
    cut[new[1:-1]] = False
    more = np.flatnonzero(cut) + 1
    signs = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))  # <| may begin a special token: such words stay whole
    if len(signs):
        more = more[~np.isin(np.searchsorted(starts, more, "right"), np.searchsorted(starts, signs, "right"))]
    new[more] = True
    starts = np.flatnonzero(new[:-1])
    ends = np.sort(np.concatenate([ends, more]))
    told = K.LOWER[data]
    odd = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind == 4, out=odd[1:])
    plain = odd[ends] == odd[starts]
    if len(signs):
        for k in np.unique(np.searchsorted(starts, signs, "right") - 1).tolist():
            told[starts[k] : ends[k]] = data[starts[k] : ends[k]]
            plain[k] = False
    return starts, ends, told, plain, np.searchsorted(starts, off)


class PieceEncoder:
    """Encodes pieces by the library and keeps up to about CACHE of them, each with its bytes, found by a hash."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        if max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0) > 0xFFFF:
            raise ValueError("ids are kept in 16 bits: a vocabulary may have 65,536 at most")
        self.last = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that end what the library merges together
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)
        self.raw, self.raw_start, self.raw_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def one_by_one(self, texts_: list[str]) -> list[np.ndarray]:
        return [np.array(c.ids, np.uint16) for c in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]

    def encode(self, new: list[bytes], plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first id and number of ids of each piece). Plain pieces go to the library many at once: each gives at least one closing id, so if a line has as many of them as pieces, they tell the pieces apart."""
        order, size, own = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), np.zeros(len(new), np.int64), [np.zeros(0, np.uint16)]
        chunks = [where[i : i + 256] for where in [np.flatnonzero(plain)] for i in range(0, len(where), 256)]
        for chunk, ids in zip(chunks, self.one_by_one([b" ".join([new[i] for i in c.tolist()]).decode() for c in chunks]), strict=True):
            stop = np.flatnonzero(self.last[np.minimum(ids, len(self.last) - 1)]) + 1
            if len(stop) == len(chunk) and stop[-1] == len(ids):
                size[chunk] = np.diff(stop, prepend=0)
                own.append(ids)
            else:
                told = self.one_by_one([new[i].decode() for i in chunk.tolist()])
                size[chunk] = [len(x) for x in told]
                own += told
        rest = np.flatnonzero(~plain)
        told = self.one_by_one([new[i].decode() for i in rest.tolist()])
        size[rest] = [len(x) for x in told]
        start = np.zeros(len(new), np.int64)
        start[order] = np.cumsum(size[order]) - size[order]
        return np.concatenate([*own, *told]), start, size

    def ids(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, told: np.ndarray, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each). A piece that shares its hash with another, but not its bytes, is encoded alone."""
        if len(self.hashes) > CACHE:
            self.clear()
        own, first, number = np.unique(K.span_hashes(told, starts, ends, lower=False), return_index=True, return_inverse=True)
        like = first[number]
        alone = ~K.same_spans(told, starts, ends, told, starts[like], ends[like])
        at = np.searchsorted(self.hashes, own)
        known = np.zeros(len(own), bool)
        known[at < len(self.hashes)] = self.hashes[at[at < len(self.hashes)]] == own[at < len(self.hashes)]
        k, met = first[known], at[known]
        taken = np.zeros(len(own), bool)
        taken[known] = ~K.same_spans(told, starts[k], ends[k], self.raw, self.raw_start[met], self.raw_start[met] + self.raw_size[met])
        alone |= taken[number]
        raw = data.tobytes()
        if not known.all():
            where = first[~known]
            ids, start, size = self.encode([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], plain[where])
            every = np.concatenate([self.hashes, own[~known]])
            order = np.argsort(every, kind="stable")
            n = ends[where] - starts[where]
            self.hashes = every[order]
            self.start = np.concatenate([self.start, len(self.flat) + start])[order]
            self.size = np.concatenate([self.size, size])[order]
            self.raw_start = np.concatenate([self.raw_start, len(self.raw) + np.cumsum(n) - n])[order]
            self.raw_size = np.concatenate([self.raw_size, n])[order]
            self.flat = np.concatenate([self.flat, ids])
            self.raw = np.concatenate([self.raw, K.ragged(told, starts[where], n)])
            at = np.searchsorted(self.hashes, own)
        flat, start, size = self.flat, self.start[at[number]], self.size[at[number]]
        if alone.any():
            where = np.flatnonzero(alone)
            ids, own_start, own_size = self.encode([raw[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], plain[where])
            start[where], size[where] = len(flat) + own_start, own_size
            flat = np.concatenate([flat, ids])
        return K.ragged(flat, start, size), size


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def _blocks(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    file, block, first, size = TaskContext.get().partitionId(), 0, 0, 0
    docs, lengths, parts = [], [], []
    tail = np.array([end], np.uint16)

    def row() -> pa.RecordBatch:
        ids = np.concatenate(parts).astype("<u2")
        return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([block], pa.int32()), pa.array([first]), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())), pa.array([ids.view(np.uint8).reshape(-1, 2).T.tobytes()], pa.binary())], [x.split()[0] for x in RAW.split(", ")])

    for batch in batches:
        for i, j, data, off in K.slices(batch.column(1), 4 << 20):
            *own, at = pieces(data, off)
            ids, n_ids = encoder(path).ids(data, *own)
            total = np.zeros(len(n_ids) + 1, np.int64)
            np.cumsum(n_ids, out=total[1:])
            bounds = total[at].tolist()
            for doc, a, b in zip(batch.column(0)[i:j].to_pylist(), bounds[:-1], bounds[1:], strict=True):
                n = b - a + 1
                if docs and size + n > BLOCK:
                    yield row()
                    block, first, size, docs, lengths, parts = block + 1, first + size, 0, [], [], []
                docs.append(doc)
                lengths.append(n)
                parts += [ids[a:b], tail]
                size += n
    if docs:
        yield row()


def _unpacked(ids: pa.Scalar) -> np.ndarray:
    """Ids of a raw block, which has their low bytes first and then their high bytes."""
    return np.frombuffer(ids.as_buffer(), np.uint8).reshape(2, -1).T.copy().view("<u2")[:, 0]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for batch in batches:
        for x in batch.column(0):
            total += np.bincount(_unpacked(x), minlength=1 << 16)
    has = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(total[has])], ["id", "n"])


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, by package-merge; 0 for ids without a count."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    assert len(used) <= 1 << limit
    leaf = used[np.argsort(counts[used], kind="stable")]
    weight = counts[leaf].astype(np.float64)
    level, is_leaf = weight, [np.ones(len(leaf), bool)]
    for _ in range(limit - 1):
        even = len(level) // 2 * 2
        both = np.concatenate([weight, level[:even:2] + level[1:even:2]])
        order = np.argsort(both, kind="stable")
        level = both[order]
        is_leaf.append(order < len(leaf))
    take = 2 * len(leaf) - 2
    for own in reversed(is_leaf):
        k = int(own[:take].sum())
        out[leaf[:k]] += 1
        take = 2 * (take - k)
    return out


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order of their codes, code of each id)."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    size = np.uint64(1) << (np.uint64(LIMIT) - lengths[order].astype(np.uint64))
    left = np.cumsum(size) - size  # left-aligned in LIMIT bits
    code = np.zeros(len(lengths), np.uint64)
    code[order] = left >> (np.uint64(LIMIT) - lengths[order].astype(np.uint64))
    return order, code


def pack(ids: np.ndarray, lengths: np.ndarray, code: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit string, bit offset of every CHECK-th id)."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    pos = end - n
    word, inside = pos >> 5, (pos & 31)
    value = code[ids] << (64 - inside - n).astype(np.uint64)
    begin = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
    out = np.zeros(int(end[-1] + 31 >> 5) + 2, np.uint64)
    out[word[begin]] += np.add.reduceat(value >> np.uint64(32), begin)
    out[word[begin] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), begin)
    return out.astype(">u4").tobytes()[: int(end[-1] + 7 >> 3)], pos[::CHECK].astype(np.int32)


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, bits) for each value of the next LIMIT bits."""
    order, _ = canonical(lengths)
    each = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << LIMIT, np.uint16), np.ones(1 << LIMIT, np.uint8)
    ids[: each.sum()] = np.repeat(order, each)
    bits[: each.sum()] = np.repeat(lengths[order], each)
    return ids, bits


def unpack(bits: np.ndarray, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The n ids of a bit string; all checkpoints advance together."""
    padded = np.concatenate([bits, np.zeros(8, np.uint8)]).astype(np.uint32)
    window = padded[:-3] << 24 | padded[1:-2] << 16 | padded[2:-1] << 8 | padded[3:]
    at, last = checkpoints.astype(np.int64), len(window) - 1
    out = np.empty((CHECK, len(at)), np.uint16)
    for k in range(CHECK):
        next_bits = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - LIMIT)
        out[k] = table[0][next_bits]
        at += table[1][next_bits]
    return out.T.ravel()[:n]


def _packed(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    _, code = canonical(lengths)
    for batch in batches:
        for k in range(batch.num_rows):
            bits, checkpoints = pack(_unpacked(batch.column(5)[k]), lengths, code)
            yield pa.RecordBatch.from_arrays([*batch.slice(k, 1).columns[:5], pa.array([bits], pa.binary()), pa.array([checkpoints], pa.list_(pa.int32()))], [x.split()[0] for x in BLOCKS.split(", ")])


def _read(batches: Iterator[pa.RecordBatch], lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
    table = decoding_table(lengths)
    for batch in batches:
        for k in range(batch.num_rows):
            size = batch.column(3)[k].values.to_numpy().astype(np.int64)
            end = np.cumsum(size)
            ids = unpack(np.frombuffer(batch.column(4)[k].as_buffer(), np.uint8), batch.column(5)[k].values.to_numpy(), int(end[-1]), table).astype("<u4")
            off = np.concatenate([[0], end * 4]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column(2)[k].values, pa.array(end - size + batch.column(1)[k].as_py()), pa.array(size), column], ["doc_id", "start", "n_tokens", "ids"])


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Write the ids of all texts, in ascending doc_id order, as a new file set at path."""
    spark = docs.sparkSession
    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    raw = cut(ordered.mapInArrow(partial(_blocks, path=vocabulary, end=end), RAW), "ids")
    # At most one row for each id of the vocabulary reaches the driver
    counts = raw.select("ids").mapInArrow(_counts, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(1 << 16, np.int64)
    for id_, n in counts:
        total[id_] = n
    lengths = code_lengths(total)
    shared = spark.sparkContext.broadcast(lengths)
    raw.mapInArrow(lambda batches: _packed(batches, shared.value), BLOCKS).write.parquet(f"{path}/blocks")
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): ids as little-endian unsigned 32-bit integers, start counted over all files."""
    lengths = np.zeros(1 << 16, np.uint8)
    for id_, n in spark.read.schema("id int, length int").parquet(f"{path}/codes").collect():
        lengths[id_] = n
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # One row for each file
    size = blocks.groupBy("file").agg(F.sum(F.expr("aggregate(lengths, 0L, (a, x) -> a + x)")).alias("n"))
    before = size.select("file", F.coalesce(F.sum("n").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = blocks.join(F.broadcast(before), "file").select("file", (F.col("first") + F.col("before")).alias("start"), "doc_ids", "lengths", "bits", "checkpoints")
    return rows.mapInArrow(lambda batches: _read(batches, shared.value), "doc_id long, start long, n_tokens long, ids binary")


def new_path(spark: SparkSession) -> str:
    return note(spark, f"{shared_dir(spark)}/pixweft/idfile-{uuid.uuid4().hex}")
