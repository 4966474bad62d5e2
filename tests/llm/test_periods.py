"""Periodic runs against a plain search over every period."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from pixweft.llm import periods, queries, textkernel

from . import brute
from .tables import clashing, odd_documents, odd_rows


def plain_runs(w, least=6, rounds=4):
    out = []
    for q in range(1, len(w) // rounds + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            size, root = j - i + q, w[i : i + q]
            if j > i and size >= max(least, rounds * q) and all(root != root[:d] * (q // d) for d in range(1, q) if q % d == 0):
                out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out)


def edited(doc_id, text):
    words = brute.words(text)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_row(doc_id, text):
    w = edited(doc_id, text)
    runs = plain_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_by_plain_search(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("length(text) < 12000").collect()
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.op12_periodic_run_detection(spark, sf).collect()}
    for r in rows:
        assert got[r.doc_id] == plain_row(*r)
    assert sum(v[1] > 0 for v in got.values()) > 10


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in odd_rows() if len(r[1] or "") < 50000]
    docs = clashing(odd_documents(spark).where("coalesce(length(text), 0) < 50000"))
    key = lambda r: tuple(map(str, r))
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.periodic_runs(docs).collect()), key=key)
    assert got == sorted((plain_row(*r) for r in rows), key=key)
    assert periods.runs(odd_documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_sequences_of_few_letters(letters):
    rng = random.Random(letters)
    for _ in range(150):
        w = []
        while len(w) < rng.randint(1, 160):
            root = [rng.randrange(letters) for _ in range(rng.randint(1, 9))]
            w += root * rng.randint(1, 7) + root[: rng.randint(0, len(root))]
        assert periods.find(np.array(w)) == plain_runs(w)


def test_powers_of_powers():
    one = [0, 0, 1] * 5 + [2]
    w = (one * 4 + [3]) * 4 + [4, 4, 4, 4, 4, 4, 4]
    assert periods.find(np.array(w)) == plain_runs(w)
    assert periods.find(np.zeros(200_000, np.int64)) == [(0, 200_000, 1)]
    fib = [[0], [0, 1]]
    while len(fib[-1]) < 1500:
        fib.append(fib[-1] + fib[-2])
    assert periods.find(np.array(fib[-1] * 5)) == plain_runs(fib[-1] * 5)


def test_words_that_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(textkernel, "span_hashes", lambda data, starts, ends, lower=True: (np.asarray(ends) - starts).astype(np.uint64) % np.uint64(2))
    import pyarrow as pa

    rng = random.Random(3)
    rows = [(k, " ".join(rng.choice(["a b", "c d", "b", "xx"]) for _ in range(30)) + " p q r" * rng.randint(0, 6)) for k in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["doc_id", "text"])
    got = [r for b in periods._found(iter([batch]), True, 6, 4) for r in b.to_pylist()]
    for r, (k, text) in zip(got, rows, strict=True):
        assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == plain_runs(edited(k, text)) and r["n_words"] == len(edited(k, text))


def test_short_runs_are_refused(spark):
    with pytest.raises(ValueError, match="aren't found"):
        periods.runs(odd_documents(spark), rounds=3)
