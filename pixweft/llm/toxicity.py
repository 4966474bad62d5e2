"""Toxicity by a weighted finite-state pattern grammar over clauses.

Tokens are runs of ASCII letters and digits and bytes of other scripts, A-Z lower-cased;
clauses end at . ! ? ; : and line ends. The insult lexicon is learned: words and word beginnings of
STEMS bytes that occur in toxic rows far more often than chance (likelihood ratio over documents of at
least EVIDENCE, log-odds over tokens of at least LEAST), weighted by their log-odds; what
occurs beside the same words again and again, as in copies of one text, and beginnings of a few words only don't count (CONTEXTS). Each token becomes a symbol (insult, threat,
target, modal, negation, reported speech, other). A clause's symbols go through one transducer from right to left, which marks insults and threats
with a target ahead, and then from left to right through GRAMMAR, the composition of five: negation and reported speech
shrink what is near, a target before aims it, a modal makes an aimed threat a meant one, and the last gives the values. A threat counts only with a target.
A clause weighs the sum of its tokens' weights (an insult's from the lexicon, a threat's 1) times the factors that the grammar gives out.

The weights of clauses are log-likelihood ratios, so each token also costs the rate of insults in
toxic rows (learned from the same rows): a few chance hits don't make a long text toxic. A text's score is the logistic function of
the log-odds of PRIOR plus the sum over all clauses or, if greater, that over the best run of clauses less
log(1 + tokens / RUN), the price of choosing it: one toxic passage in a long clean text counts.

Learning uses labelled rows whose crc32(doc_id) mod FOLDS isn't HELD_OUT, at most about SAMPLE of each
label, taken by a hash of doc_id; of repeated labels of a document the largest counts. Null and empty texts have no clause and score PRIOR.
Without labels nothing is learned and only threats score. Repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .shared import cut, texts

FOLDS, HELD_OUT, SAMPLE, STEMS, EVIDENCE = 3, 1, 20_000, (4, 5, 6, 7, 8), 30.0
PRIOR, THRESHOLD, LEAST, MOST, CONTEXTS, RUN = 0.1, 0.7, 2.5, 6.0, 0.7, 64
#: Fixed words of the grammar, by symbol.
WORDS = {
    "target": "you your yours youre u he she him her they them those these people du dich dir dein deine ihr euch sie er tu te toi vous votre ils elles usted ustedes tú ti él ella ellos ellas",
    "threat": "kill hurt destroy beat stab shoot burn crush murder töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    "modal": "will ll gonna going shall must should werde werden wird muss vais va allons voy vamos deberían",
    "negation": "not no never isn aren wasn nobody nicht kein keine nie pas jamais ni nunca jamás",
    "reported": "said says say wrote writes claimed claims quoted called calls sagte schrieb behauptet dit disait écrit dijo escribió llamó",
}
SYMBOLS = ("other", "insult", *WORDS, "aimed insult", "aimed threat", "meant threat")
OTHER, INSULT, TARGET, THREAT, MODAL, NEGATION, REPORTED, AIMED_INSULT, AIMED_THREAT, MEANT_THREAT = range(len(SYMBOLS))
_CLAUSE = np.zeros(256, bool)
_CLAUSE[[ord(c) for c in ".!?;:\n"]] = True


class Lexicon(NamedTuple):
    """Sorted feature hashes, their weights, and the insults per token that toxic texts have more than others."""

    hashes: np.ndarray
    weights: np.ndarray
    rate: float = 0.0


def held_out() -> Column:
    return F.coalesce(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of the words, and of their beginnings (0: the word isn't longer)."""
    out = [K.span_hashes(data, starts, ends)]
    for k, n in enumerate(STEMS):
        h = np.zeros(len(starts), np.uint64)
        longer = np.flatnonzero(ends - starts > n)
        h[longer] = K.mix(K.span_hashes(data, starts[longer], starts[longer] + n) ^ np.uint64(k + 1))
        out.append(h)
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, documents with it, toxic documents with it, its times, its times in toxic documents, contexts) of each slice; feature 0 counts all documents and tokens.
    contexts: in toxic documents, a bit for each of 64 classes of a word's neighbours, or of a beginning's words."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, data, off in K.slices(batch.column(0), 1 << 20):
            starts, ends, first = K.spans(data, off, K.NOT_ALNUM)
            doc = np.tile(np.repeat(np.arange(j - i), np.diff(first)), 1 + len(STEMS))
            every = features(data, starts, ends)
            value = np.concatenate(every)
            before, after = np.roll(every[0], 1), np.roll(every[0], -1)
            before[first[:-1][np.diff(first) > 0]] = 0
            after[first[1:][np.diff(first) > 0] - 1] = 0
            place = K.mix(before * np.uint64(3) + after) & np.uint64(63)
            place = np.concatenate([place, np.tile(every[0] & np.uint64(63), len(STEMS))])
            bad = toxic[i:j][doc]
            bit = np.where(bad == 1, np.uint64(1) << place, np.uint64(0))
            order = np.lexsort((doc, value))
            order = order[value[order] != 0]
            doc, value, bit, bad = doc[order], value[order], bit[order], bad[order]
            new = np.ones(len(doc), np.int64)
            new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
            own, at = np.unique(value, return_index=True)
            per = lambda x, at=at: np.add.reduceat(x, at) if len(at) else np.zeros(0, np.int64)
            bits = np.bitwise_or.reduceat(bit, at) if len(at) else bit
            words = np.diff(first)
            columns = [np.append(own, np.uint64(0)).view(np.int64), np.append(per(new), j - i), np.append(per(new * bad), toxic[i:j].sum()), np.append(per(np.ones(len(doc), np.int64)), words.sum()), np.append(per(bad), (words * toxic[i:j]).sum()), np.append(bits, np.uint64(0)).view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["feature", "n", "bad", "times", "bad_times", "contexts"])


def _hits(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    """(toxic, tokens in the lexicon, tokens) of each slice."""
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j, data, off in K.slices(batch.column(0), 2 << 20):
            starts, ends, first = K.spans(data, off, K.NOT_ALNUM)
            hit = insult_weights(lexicon, features(data, starts, ends)) > 0
            own = toxic[i:j][np.repeat(np.arange(j - i), np.diff(first))]
            yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array([int(hit[own == k].sum()) for k in (0, 1)]), pa.array([int((own == k).sum()) for k in (0, 1)])], ["toxic", "hits", "tokens"])


def learn(docs: DataFrame, labels: DataFrame) -> Lexicon:
    """The lexicon reaches the driver; features need some EVIDENCE in a sample of bounded size, which bounds their number."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, SAMPLE / max(1, sizes.get(1, 0)))).otherwise(min(1.0, SAMPLE / max(1, sizes.get(0, 0))))
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    # The broadcast side has about 2 * SAMPLE rows of two numbers at most
    rows = cut(texts(docs).where("text is not null").join(F.broadcast(taken), "doc_id").select("text", "toxic"), "labelled")
    sums = [F.sum(c).alias(c) for c in ("n", "bad", "times", "bad_times")]
    counts = rows.mapInArrow(_counted, "feature long, n long, bad long, times long, bad_times long, contexts long").groupBy("feature").agg(*sums, F.bit_count(F.bit_or("contexts")).alias("contexts"))
    counts = cut(counts.where("feature = 0 or bad > 1"), "features")
    total = counts.where("feature = 0").first()
    if total is None or not 0 < total.bad < total.n:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0))
    base = total.bad / total.n
    bad, n = F.col("bad").cast("double"), F.col("n").cast("double")
    ratio = 2 * (F.when(bad > 0, bad * F.log(bad / (n * base))).otherwise(0.0) + F.when(n > bad, (n - bad) * F.log((n - bad) / (n * (1 - base)))).otherwise(0.0))
    odds = F.log((F.col("bad_times") + 0.5) / (total.bad_times + 1)) - F.log((F.col("times") - F.col("bad_times") + 0.5) / (total.times - total.bad_times + 1))
    strong = counts.where("feature <> 0").withColumn("ratio", ratio).withColumn("weight", odds).where((bad / n > base) & (F.col("ratio") >= EVIDENCE) & (F.col("weight") >= LEAST) & (F.col("contexts") >= CONTEXTS * F.least(bad, F.lit(20.0))))
    best = strong.select("feature", "weight").collect()
    hashes = np.array([r.feature for r in best], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    lexicon = Lexicon(hashes[order], np.minimum(np.array([r.weight for r in best], float), MOST)[order])
    found = {r.toxic: r.hits / max(1, r.tokens) for r in rows.mapInArrow(partial(_hits, lexicon=lexicon), "toxic long, hits long, tokens long").groupBy("toxic").agg(F.sum("hits").alias("hits"), F.sum("tokens").alias("tokens")).collect()}
    return lexicon._replace(rate=max(0.0, found.get(1, 0.0) - found.get(0, 0.0)))


def _fixed() -> tuple[np.ndarray, np.ndarray]:
    words = [(w, SYMBOLS.index(k)) for k, text in WORDS.items() for w in text.split()]
    data, off = K.buffers(pa.array([w for w, _ in words], pa.large_string()))
    h = K.span_hashes(data, off[:-1], off[1:])
    order = np.argsort(h, kind="stable")
    return h[order], np.array([s for _, s in words])[order]


def _lookup(table: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(table):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(table, wanted), len(table) - 1)
    return np.where(table[at] == wanted, values[at], default)


class Transducer(NamedTuple):
    """For each state (0 is the first) and symbol read: the next state, the symbol given out, and the factor of the token's weight."""

    to: np.ndarray
    out: np.ndarray
    factor: np.ndarray


def near(trigger: int, reach: int, changes: dict[int, tuple[int, float]]) -> Transducer:
    """Within `reach` symbols after the trigger, symbols change as told into (symbol, factor); all others pass."""
    states, symbols = np.arange(reach + 1)[:, None], np.arange(len(SYMBOLS))[None, :]
    out = np.repeat(symbols, reach + 1, axis=0)
    factor = np.ones(out.shape)
    for symbol, (new, f) in changes.items():
        out[1:, symbol], factor[1:, symbol] = new, f
    return Transducer(np.where(symbols == trigger, reach, np.maximum(states - 1, 0)), out, factor)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that reads as `first`, whose output `second` reads; its states are the pairs that can be reached."""
    number, pairs, rows = {(0, 0): 0}, [(0, 0)], []
    for p, q in pairs:  # grows on the way
        row = []
        for symbol in range(len(SYMBOLS)):
            middle = int(first.out[p, symbol])
            pair = int(first.to[p, symbol]), int(second.to[q, middle])
            if pair not in number:
                number[pair] = len(pairs)
                pairs.append(pair)
            row.append((number[pair], int(second.out[q, middle]), first.factor[p, symbol] * second.factor[q, middle]))
        rows.append(row)
    return Transducer(*(np.array([[x[k] for x in row] for row in rows]) for k in range(3)))


NEAR = 3
_BOTH = {INSULT: AIMED_INSULT, THREAT: AIMED_THREAT}
AHEAD = near(TARGET, NEAR, {k: (v, 1.0) for k, v in _BOTH.items()})  # read from right to left
NEGATED = near(NEGATION, 2, {k: (k, 0.6 if k in (INSULT, AIMED_INSULT) else 0.5) for pair in _BOTH.items() for k in pair})
QUOTED = near(REPORTED, 12, {k: (k, 0.7) for k in (INSULT, AIMED_INSULT)})
TARGETED = near(TARGET, NEAR, {k: (v, 1.0) for k, v in _BOTH.items()})
MEANT = near(MODAL, NEAR, {AIMED_THREAT: (MEANT_THREAT, 1.0)})
VALUES = {INSULT: 1.0, AIMED_INSULT: 1.25, AIMED_THREAT: 1.5, MEANT_THREAT: 2.5}
VALUED = Transducer(np.zeros((1, len(SYMBOLS)), int), np.arange(len(SYMBOLS))[None, :], np.array([[VALUES.get(k, 0.0) for k in range(len(SYMBOLS))]]))
GRAMMAR = compose(compose(compose(compose(NEGATED, QUOTED), TARGETED), MEANT), VALUED)
_AHEAD, _GRAMMAR = [x.tolist() for x in AHEAD], [x.tolist() for x in GRAMMAR]


def clause_weight(symbols: list[int], weights: list[float]) -> float:
    """The weight of one clause: its tokens' symbols, and their weights as insults."""
    to, out, _ = _AHEAD
    state, marked = 0, []
    for s in reversed(symbols):
        marked.append(out[state][s])
        state = to[state][s]
    to, _, factor = _GRAMMAR
    state, total = 0, 0.0
    for s, was, w in zip(reversed(marked), symbols, weights, strict=True):
        total += factor[state][s] * (1.0 if was == THREAT else w)
        state = to[state][s]
    return total


def insult_weights(lexicon: Lexicon, own: list[np.ndarray]) -> np.ndarray:
    """The greatest weight of each token's features."""
    weight = np.zeros(len(own[0]))
    for h in own:
        np.maximum(weight, _lookup(lexicon.hashes, lexicon.weights, h, 0.0), out=weight)
    return weight


def text_weight(clauses: list[tuple[int, int, float]], tokens: int, rate: float) -> float:
    """Log-likelihood ratio of a text of so many tokens, from the (begin, end, weight) of its clauses that have any."""
    best = run = 0.0
    at = 0
    for a, b, w in clauses:
        run = max(0.0, run - rate * (a - at)) + w - rate * (b - a)
        best, at = max(best, run), b
    return max(sum(w for _, _, w in clauses) - rate * tokens, best - np.log1p(tokens / RUN))


def _scored(batches: Iterator[pa.RecordBatch], lexicon: Lexicon) -> Iterator[pa.RecordBatch]:
    words, kinds = _fixed()
    for batch in batches:
        out = []
        for i, j, data, off in K.slices(batch.column(0), 2 << 20):
            starts, ends, first = K.spans(data, off, K.NOT_ALNUM)
            own = features(data, starts, ends)
            weight = insult_weights(lexicon, own)
            symbol = _lookup(words, kinds, own[0], OTHER).astype(np.int64)
            symbol[weight > 0] = INSULT
            ends_clause = np.zeros(len(data) + 1, np.int64)
            np.cumsum(_CLAUSE[data], out=ends_clause[1:])
            doc = np.repeat(np.arange(j - i), np.diff(first))
            clause = ends_clause[starts]
            change = np.flatnonzero((np.diff(doc) != 0) | (np.diff(clause) != 0)) + 1
            found: list[list[tuple[int, int, float]]] = [[] for _ in range(j - i)]
            if len(starts):
                begin, stop = np.concatenate([[0], change]), np.append(change, len(starts))
                hot = np.add.reduceat(((symbol == INSULT) | (symbol == THREAT)).astype(np.int64), begin) > 0
                for a, b in zip(begin[hot].tolist(), stop[hot].tolist(), strict=True):
                    k = int(doc[a])
                    found[k].append((a - int(first[k]), b - int(first[k]), clause_weight(symbol[a:b].tolist(), weight[a:b].tolist())))
            total = np.array([text_weight(c, n, lexicon.rate) for c, n in zip(found, np.diff(first).tolist(), strict=True)])
            out.append(1 / (1 + (1 - PRIOR) / PRIOR * np.exp(-np.clip(total, -500, 500))))
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate([np.zeros(0), *out]))], [*batch.schema.names[1:], "score"])


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row for each row of docs."""
    lexicon = docs.sparkSession.sparkContext.broadcast(learn(docs, labels))
    plain = texts(docs).select("text", "doc_id", held_out().alias("held_out"))
    return plain.mapInArrow(lambda batches: _scored(batches, lexicon.value), "doc_id long, held_out boolean, score double").withColumn("predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0))
