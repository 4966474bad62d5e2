"""Scoring by a gated recurrent language model with a class-factored output.

Tokens are words (runs of bytes outside ASCII white space, A-Z lower-cased) and one end per
text. Word counts come from all training texts. The HEAD most frequent tokens lie in classes
of CLASS words with a softmax of their own; all others lie in a class for each power of two of their
count, where a word's share is its count's; unseen words are one more class of one entry.
A gated recurrent unit reads the tokens (the others as their class) and gives the class and the head word.
It is trained in tasks on every token of every training text, once: each of ROUNDS rounds takes the texts whose hash falls to it, deals them by their hash into partitions of about PART tokens, and each partition
goes by truncated backpropagation (windows of WINDOW tokens, state carried on) through its own texts, in order of their hash, from the weights at hand; then the weights of all,
by their tokens, are averaged. So training is the same work for each token at any size of the input, and neither cores nor file splits change what a partition holds.
In scoring, too, the state is carried to the end of each text.

Texts don't move. A task turns slices of about SLICE bytes of whole texts into input ids (two bytes a token) with the counts of the most frequent words, FREQUENT
at most, which it is sent. Of the other words each slice's distinct ones are joined with all counts, and what comes back is filled into the slice's ids.
None of these words is frequent, so no key of that join is hot. The ids are kept for training and scoring.

Training texts are those whose crc32(doc_id) mod FOLDS isn't 0 (a null doc_id counts as empty). Null texts are empty: one end. Repeated rows count
and score each time. Without training texts all tokens are unseen; then and on empty tables nothing fails.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import cut, texts

FOLDS, HEAD, CLASS, POWERS, HIDDEN, FREQUENT = 10, 1600, 40, 24, 16, 1 << 18
WINDOW, LANES, UPDATES, BLOCK, PART, ROUNDS, RATE, SLICE, FAN_IN = 16, 512, 256, 2 << 20, 4 << 20, 4, 0.01, 4 << 20, 16
END, TAIL = np.uint64(0xE4D0F7E87), 0xFFFF
SLICES = "slice long, word long, number int, n_tail int, doc_ids array<long>, held_out array<boolean>, sizes array<long>, n_known array<long>, base array<double>, share array<double>, ids binary, refs binary"
ENCODED = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, share double, ids binary"
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def held_out() -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0, F.lit(False))


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes, first token of each text); the last token of each text is END."""
    starts, ends, first = K.spans(data, off)
    n = np.diff(first)
    at = first + np.arange(len(first))
    out = np.full(int(at[-1]), END, np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(len(n)), n)] = K.span_hashes(data, starts, ends)
    return out, at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, off in K.slices(batch.column(0), SLICE):
            word, n = np.unique(tokens(data, off)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


class Vocabulary(NamedTuple):
    """Frequent words by hash, with their counts and ranks (-1: not in the head), the head's counts, and the mass of each class; classes: the head's, then powers of two, then unseen."""

    hashes: np.ndarray
    counts: np.ndarray
    rank: np.ndarray
    head_counts: np.ndarray
    mass: np.ndarray
    total: int
    distinct: int

    @property
    def head_classes(self) -> int:
        return -(-len(self.head_counts) // CLASS)

    @property
    def classes(self) -> int:
        return self.head_classes + POWERS + 1

    def kind(self, ids: np.ndarray) -> np.ndarray:
        """The class of each input id."""
        return np.where(ids < len(self.head_counts), ids // CLASS, ids - len(self.head_counts) + self.head_classes)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.1) / (self.total + 0.1 * (self.distinct + 1)))

    def place(self, rank: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(input id, log of the share within the class; 0 in head classes) of words with a rank (-1: none) and a count."""
        power = np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), POWERS - 1)
        power = np.where(count > 0, power, POWERS)
        share = np.where((rank < 0) & (count > 0), np.log((count + 0.1) / np.maximum(self.mass[self.head_classes + power], 1e-9)), 0.0)
        return np.where(rank >= 0, rank, len(self.head_counts) + power), share

    def known(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, count) of words; count 0: none of the frequent ones."""
        if not len(self.hashes):
            return np.full(len(word), -1), np.zeros(len(word), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, word), len(self.hashes) - 1)
        same = self.hashes[at] == word
        return np.where(same, self.rank[at], -1), np.where(same, self.counts[at], 0)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Some hundred sums reach the driver, and at most FREQUENT words: those above a count that the sums tell."""
    step = F.floor((F.log2("n") + 1e-12) * 8).cast("int")
    steps = sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words"), F.sum("n").alias("n"), F.sum(F.col("n") + 0.1).alias("mass"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect(), reverse=True)
    least, taken = 1 << 20, 0
    for r in steps:
        if (taken := taken + r.words) > FREQUENT:
            break
        least = r.step
    known = counts.where(step >= least).select("word", "n").toArrow()
    hashes, n = known.column("word").to_numpy().view(np.uint64), known.column("n").to_numpy()
    order = np.lexsort((hashes.view(np.int64), -n))
    hashes, n = hashes[order], n[order]
    head = n[:HEAD].astype(np.float64)
    rank = np.where(np.arange(len(n)) < HEAD, np.arange(len(n)), -1)
    classes = -(-len(head) // CLASS)
    mass = np.zeros(classes + POWERS + 1)
    for k in range(classes):
        mass[k] = head[k * CLASS : (k + 1) * CLASS].sum()
    for r in steps:
        mass[classes + min(r.step // 8, POWERS - 1)] += float(r.mass)
    for x in head:
        mass[classes + min(int(np.log2(x)), POWERS - 1)] -= x + 0.1
    mass[-1] = max(1.0, sum(float(r.once) for r in steps))  # as likely as words met once are
    order = np.argsort(hashes)
    return Vocabulary(hashes[order], n[order], rank[order], head, np.maximum(mass, 0.0), sum(int(r.n) for r in steps), sum(int(r.words) for r in steps))


class Model(NamedTuple):
    """x: input rows (z, r, n gates); u: recurrence; c, cb: classes; w, wb: head words."""

    x: np.ndarray
    u: np.ndarray
    c: np.ndarray
    cb: np.ndarray
    w: np.ndarray
    wb: np.ndarray


def new_model(v: Vocabulary) -> Model:
    """Small fixed random weights, and biases that give the corpus' own frequencies."""
    rng = np.random.default_rng(5)
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    n = len(v.head_counts)
    wb = np.full(v.head_classes * CLASS, -30.0, np.float32)
    wb[:n] = np.log(v.head_counts)
    return Model(small(n + POWERS + 1, 3 * HIDDEN), small(HIDDEN, 3 * HIDDEN), small(HIDDEN, v.classes), np.log(np.maximum(v.mass, 1e-3)).astype(np.float32), small(v.head_classes * CLASS, HIDDEN), wb)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def step(m: Model, rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """One step of the unit for input rows (from m.x): the new state, and what backpropagation needs."""
    k = HIDDEN
    past = h @ m.u
    gates = _sigmoid(rows[:, : 2 * k] + past[:, : 2 * k])
    z, r = gates[:, :k], gates[:, k:]
    fresh = np.tanh(rows[:, 2 * k :] + r * past[:, 2 * k :])
    return fresh + z * (h - fresh), z, r, fresh, past[:, 2 * k :]


def _softmax(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per column (exp, sum of exp) of logits (entry, token), in place; bounded, so that no column overflows."""
    e = np.exp(np.minimum(logits, 80, out=logits), out=logits)
    return e, e.sum(axis=0) + np.float32(1e-30)


def _by_class(v: Vocabulary, kind: np.ndarray) -> tuple[np.ndarray, list[tuple[slice, slice]]]:
    """The tokens of head classes in order of class, and of each such class its words and its part of them."""
    order = np.argsort(kind.astype(np.int16), kind="stable")
    bounds = np.searchsorted(kind[order], np.arange(v.head_classes + 1))
    parts = [(slice(k * CLASS, (k + 1) * CLASS), slice(int(bounds[k]), int(bounds[k + 1]))) for k in np.flatnonzero(np.diff(bounds)).tolist()]
    return order[: bounds[-1]], parts


def _word_logits(m: Model, h: np.ndarray, parts: list[tuple[slice, slice]]) -> np.ndarray:
    """(word of its class, token) for tokens in order of class with their states."""
    out = np.empty((CLASS, len(h)), h.dtype)
    for own, at in parts:
        out[:, at] = m.w[own] @ h[at].T + m.wb[own, None]
    return out


def output(m: Model, v: Vocabulary, h: np.ndarray, kind: np.ndarray, word: np.ndarray, share: np.ndarray | float) -> np.ndarray:
    """The natural log-probability of each token given the state before it."""
    logits = m.c.T @ h.T + m.cb[:, None]
    out = logits[kind, np.arange(len(h))].astype(np.float64)
    out -= np.log(_softmax(logits)[1])
    order, parts = _by_class(v, kind)
    logits = _word_logits(m, h[order], parts)
    out[order] += logits[word[order] % CLASS, np.arange(len(order))]
    out[order] -= np.log(_softmax(logits)[1])
    return out + share


def _gradients(m: Model, v: Vocabulary, inputs: np.ndarray, kinds: np.ndarray, h0: np.ndarray) -> tuple[Model, np.ndarray]:
    """Gradients of the mean log loss over a window (time, lane), and the state after it. inputs[t] is read after kinds[t] is guessed."""
    steps, lanes = inputs.shape
    h, saved = h0, []
    for t in range(steps):
        new, *rest = step(m, m.x[inputs[t]], h)
        saved.append((h, *rest))
        h = new
    states = np.concatenate([s[0] for s in saved])
    kind, word = kinds.ravel(), inputs.ravel()
    scale = states.dtype.type(1 / len(kind))
    p, total = _softmax(m.c.T @ states.T + m.cb[:, None])
    p *= scale / total
    p[kind, np.arange(len(kind))] -= scale
    g = Model(*(np.zeros_like(a) for a in m))
    g.c[:], g.cb[:] = (p @ states).T, p.sum(axis=1)
    back = (m.c @ p).T
    order, parts = _by_class(v, kind)
    near = states[order]
    q, total = _softmax(_word_logits(m, near, parts))
    q *= scale / total
    q[word[order] % CLASS, np.arange(len(order))] -= scale
    more = np.empty_like(near)
    for own, at in parts:
        g.w[own], g.wb[own] = q[:, at] @ near[at], q[:, at].sum(axis=1)
        more[at] = q[:, at].T @ m.w[own]
    back[order] += more
    back = back.reshape(steps, lanes, HIDDEN)
    dh, dx = np.zeros_like(h0), np.empty((steps, lanes, 3 * HIDDEN), h0.dtype)
    for t in range(steps - 1, -1, -1):
        before, z, r, fresh, past = saved[t]
        dn = dh * (1 - z) * (1 - fresh * fresh)
        dz = dh * (before - fresh) * z * (1 - z)
        dr = dn * past * r * (1 - r)
        to_u = np.concatenate([dz, dr, dn * r], axis=1)
        dx[t] = np.concatenate([dz, dr, dn], axis=1)
        g.u[:] += before.T @ to_u
        dh = dh * z + to_u @ m.u.T + back[t]
    order = np.argsort(word.astype(np.uint16), kind="stable")
    rows, at = np.unique(word[order], return_index=True)
    g.x[rows] = np.add.reduceat(dx.reshape(-1, 3 * HIDDEN)[order], at)
    return g, h


class Learner:
    """Adam over windows of streams of input ids, from given weights."""

    def __init__(self, m: Model, v: Vocabulary, rate: float):
        self.m, self.v, self.rate, self.n, self.tokens = Model(*(a.copy() for a in m)), v, rate, 0, 0
        self.first, self.second = [np.zeros_like(a) for a in m], [np.zeros_like(a) for a in m]

    def read(self, ids: np.ndarray) -> None:
        """Learn from all of ids, in as many lanes as leave UPDATES steps. Of words met once, every other is taken as unseen, for they are so in texts to come."""
        self.tokens += len(ids)
        ids = ids.astype(np.int64)
        ids[np.flatnonzero(ids == len(self.v.head_counts))[::2]] += POWERS
        lanes = min(LANES, max(1, len(ids) // (WINDOW * UPDATES)))
        length = -(-len(ids) // lanes)
        inputs = np.resize(ids, lanes * length).reshape(lanes, length).T  # the last lane ends with a few of the first tokens
        kinds = self.v.kind(inputs)
        h = np.zeros((lanes, HIDDEN), np.float32)
        for t in range(0, length, WINDOW):
            grads, h = _gradients(self.m, self.v, inputs[t : t + WINDOW], kinds[t : t + WINDOW], h)
            self._step(grads)

    def _step(self, grads: Model) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n)
        for a, g, p, q in zip(self.m, grads, self.first, self.second, strict=True):
            g = g * np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            p += np.float32(0.1) * (g - p)
            q += np.float32(0.001) * (g * g - q)
            a -= np.float32(rate) * p / (np.sqrt(q) + np.float32(1e-8))


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(input ids, first id of each text) of a column of ENCODED's ids."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]].copy().view("<u2"), (off - off[0]) // 2


WEIGHTS = "tokens long, weights binary"


def _learned(batches: Iterator[pa.RecordBatch], m: Model, v: Vocabulary, rate: float) -> Iterator[pa.RecordBatch]:
    """How many tokens the partition read, and its weights."""
    learner, held, size = Learner(m, v, rate), [], 0
    for batch in batches:
        held.append(_ids(batch.column(0))[0])
        size += len(held[-1])
        if size >= BLOCK:
            learner.read(np.concatenate(held))
            held, size = [], 0
    if size:
        learner.read(np.concatenate(held))
    if learner.tokens:
        flat = np.concatenate([a.ravel() for a in learner.m]).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([learner.tokens], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["tokens", "weights"])


def _mean(rows: list[tuple[int, bytes]]) -> tuple[int, np.ndarray]:
    n = sum(t for t, _ in rows)
    return n, sum(np.frombuffer(w, "<f4") * (t / n) for t, w in rows)


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, bytes]] = []
    for batch in batches:
        for tokens_, weights in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            n, flat = _mean([*held, (tokens_, weights)])
            held = [(n, flat.astype("<f4").tobytes())]
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([held[0][0]], pa.int64()), pa.array([held[0][1]], pa.binary())], ["tokens", "weights"])


def train(v: Vocabulary, encoded: DataFrame, part: int = PART) -> Model:
    """The model after ROUNDS rounds over the training rows of encoded, each row in one of them; in each, weights are averaged by FAN_IN in tasks until at most FAN_IN models are left for the driver."""
    m = new_model(v)
    if not v.total:
        return m
    parts = -(-v.total // (ROUNDS * part))
    training = encoded.where("not held_out").select("ids", "doc_id", F.xxhash64("doc_id", "ids").alias("mark"))
    for k in range(ROUNDS):
        shared, rate = encoded.sparkSession.sparkContext.broadcast((m, v)), RATE / (1 + 0.5 * k)
        own = training.where(F.pmod("mark", F.lit(ROUNDS)) == k).repartition(parts, "mark").sortWithinPartitions("mark", "doc_id")
        learned, left = own.select("ids").mapInArrow(lambda batches, shared=shared, rate=rate: _learned(batches, *shared.value, rate), WEIGHTS), parts
        while left > FAN_IN:
            left = -(-left // FAN_IN)
            learned = learned.repartition(left).mapInArrow(_averaged, WEIGHTS)
        models = [(r.tokens, r.weights) for r in learned.collect()]
        shared.unpersist()
        if models:
            flat = _mean(models)[1].astype(np.float32)
            ends = np.cumsum([a.size for a in m])[:-1]
            m = Model(*(x.reshape(a.shape).copy() for x, a in zip(np.split(flat, ends), m, strict=True)))
    return m


def log_likelihoods(m: Model, v: Vocabulary, inputs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of each text inputs[first[i]:first[i+1]], the natural log-probability without shares; all texts side by side, the state carried on."""
    kind = v.kind(inputs)
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    total = np.zeros(len(size))
    running = np.searchsorted(-size, -np.arange(size[0] if len(size) else 0), "left")
    h = np.zeros((len(size), HIDDEN), np.float32)
    states, at, lane = [], [], []

    def settle() -> None:
        if states:
            where, own = np.concatenate(at), np.concatenate(lane)
            total[:] += np.bincount(own, weights=output(m, v, np.concatenate(states), kind[where], inputs[where], 0.0), minlength=len(total))
            for x in (states, at, lane):
                x.clear()

    held = 0
    for t, n in enumerate(running.tolist()):
        where = start[:n] + t
        states.append(h[:n].copy())
        at.append(where)
        lane.append(np.arange(n))
        held += n
        h[:n] = step(m, m.x[inputs[where]], h[:n])[0]
        if held >= 1 << 16:
            settle()
            held = 0
    settle()
    out = np.zeros(len(size))
    out[order] = total
    return out


def _list(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row with the values as its list."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _sliced(batches: Iterator[pa.RecordBatch], v: Vocabulary) -> Iterator[pa.RecordBatch]:
    """SLICES: for each slice a row of its texts, and a row of each of its words that isn't frequent."""
    slice_ = TaskContext.get().partitionId() << 32
    kinds = pa.schema([("slice", pa.int64()), ("word", pa.int64()), ("number", pa.int32()), ("n_tail", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("sizes", pa.list_(pa.int64())), ("n_known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("share", pa.list_(pa.float64())), ("ids", pa.binary()), ("refs", pa.binary())])
    for batch in batches:
        for i, j, data, off in K.slices(batch.column("text"), SLICE):
            all_, first = tokens(data, off)
            own, number = np.unique(all_, return_inverse=True)
            rank, n = v.known(own)
            tail = n == 0
            ids, share = v.place(rank, n)
            ids[tail] = TAIL
            per = lambda x, tail=tail, number=number, first=first: np.add.reduceat(np.where(tail, 0, x)[number], first[:-1])
            refs = (np.cumsum(tail) - 1)[number[tail[number]]]
            words = own[tail]
            one = [pa.array([slice_]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([len(words)], pa.int32()), _list(batch.column("doc_id").slice(i, j - i), pa.int64()), _list(batch.column("held_out").slice(i, j - i), pa.bool_())]
            one += [_list(np.diff(first), pa.int64()), _list(per(n > 0), pa.int64()), _list(per(v.base(n)), pa.float64()), _list(per(share), pa.float64()), pa.array([ids[number].astype("<u2").tobytes()], pa.binary()), pa.array([refs.astype("<u4").tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(one, schema=kinds)
            if len(words):
                many = [pa.array(np.full(len(words), slice_)), pa.array(words.view(np.int64)), pa.array(np.arange(len(words), dtype=np.int32))]
                yield pa.RecordBatch.from_arrays([*many, *(pa.nulls(len(words), t) for t in kinds.types[3:])], schema=kinds)
            slice_ += 1


def _filled(texts_: pa.Table, words: pa.Table, v: Vocabulary) -> pa.Table:
    """ENCODED of the texts of a slice, with the counts of its other words."""
    row = {c: texts_.column(c)[0] for c in texts_.column_names}
    count = np.zeros(row["n_tail"].as_py(), np.int64)
    count[words.column("number").to_numpy()] = words.column("n").to_numpy()
    size = row["sizes"].values.to_numpy()
    first = np.concatenate([[0], np.cumsum(size)])
    ids, refs = np.frombuffer(row["ids"].as_buffer(), "<u2").copy(), np.frombuffer(row["refs"].as_buffer(), "<u4")
    at = np.flatnonzero(ids == TAIL)
    doc = np.searchsorted(first, at, "right") - 1
    own, share = v.place(np.full(len(count), -1), count)
    ids[at] = own[refs]
    more = lambda x: np.bincount(doc, weights=x[refs], minlength=len(size))
    columns = [row["doc_ids"].values, row["held_out"].values, pa.array(size), pa.array(row["n_known"].values.to_numpy() + more(count > 0).astype(np.int64)), pa.array(row["base"].values.to_numpy() + more(v.base(count)))]
    columns.append(pa.array(row["share"].values.to_numpy() + more(share)))
    columns.append(pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(2 * first), pa.py_buffer(ids.tobytes())]).cast(pa.binary()))
    return pa.Table.from_arrays(columns, [x.split()[0] for x in ENCODED.split(", ")])


def _scored(batches: Iterator[pa.RecordBatch], m: Model, v: Vocabulary) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, first = _ids(batch.column("ids"))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(first, first[i] + BLOCK, "right")) - 1)
            rows = batch.slice(i, j - i)
            score = log_likelihoods(m, v, ids[first[i] : first[j]].astype(np.int64), first[i : j + 1] - first[i]) + rows.column("share").to_numpy()
            columns = [*(rows.column(k) for k in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(j - i, v.total, np.int64)), rows.column("base_score"), pa.array(score / np.log(10))]
            yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in OUT.split(", ")])
            i = j


def encode(docs: DataFrame) -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training texts, and ENCODED for each row of docs."""
    spark, plain = docs.sparkSession, texts(docs)
    counts = plain.where(~held_out()).select("text").mapInArrow(_counted, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts, "counts")
    v = vocabulary(counts)
    shared = spark.sparkContext.broadcast(v)
    slices = cut(plain.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(lambda batches: _sliced(batches, shared.value), SLICES), "slices")
    words = slices.where("word is not null").select(F.col("slice").alias("of"), "word", "number").join(counts, "word").select("of", "number", "n")
    rows = slices.where("word is null").drop("word", "number")
    return v, cut(rows.groupBy("slice").cogroup(words.groupBy("of")).applyInArrow(lambda a, b: _filled(a, b, shared.value), ENCODED), "encoded")


def score(docs: DataFrame) -> DataFrame:
    """OUT for each row of docs."""
    v, encoded = encode(docs)
    model = docs.sparkSession.sparkContext.broadcast((train(v, encoded), v))
    return encoded.mapInArrow(lambda batches: _scored(batches, *model.value), OUT)
