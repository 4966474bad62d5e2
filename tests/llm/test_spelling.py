"""Spelling variants against plain counting and deletion patterns; automata against sorted lists."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pixweft.llm import queries, spelling

from .brute import A_TO_Z
from .tables import clashing, odd_documents, odd_rows


def plain_counts(rows, losing=97, least=5):
    out = Counter()
    for i, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            word = run.translate(A_TO_Z)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if losing and h % losing == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= least:
                out[word] += 1
    return out


def plain_variants(n, ratio=2):
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
    for (a, b), words in holes.items():
        for w in words:
            near[w] |= words - {w}
            if a + b in n:
                near[w].add(a + b)
                near[a + b].add(w)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= ratio * n[w]:
            form[w] = best
    rows = set()
    for w, c in n.items():
        root = w
        while root in form:
            root = form[root]
        rows.add((w, form.get(w), root, c, len(near[w]), n[form[w]] if w in form else None))
    return rows


def test_query_by_plain_counting(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op13_spelling_variant_grouping(spark, sf).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = plain_variants({w: c for w, c in plain_counts(rows).items() if c >= 3})
    assert len(got) == len(set(got)) and set(got) == want and any(r[1] != r[2] for r in want if r[1])


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    for losing in (0, 3, 97):
        got = {r.word: r.n for r in spelling.count_words(clashing(odd_documents(spark)), least=1, losing=losing).collect()}
        assert got == {w: c for w, c in plain_counts(rows, losing, 1).items() if w}
    assert spelling.group(odd_documents(spark).limit(0), losing=97).count() == 0


@pytest.mark.parametrize("limit", [3, 50, 1 << 14])
def test_words_over_few_letters(spark, limit):
    """Words over two letters, so that many share a half, some of one and two code points; halves are split where limit is small."""
    rng = random.Random(limit)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(1, 8))): rng.randint(1, 40) for _ in range(600)}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), limit)
    assert {tuple(r) for r in got.collect()} == plain_variants(words)


def test_one_half_for_a_third_of_the_words(spark):
    rng = random.Random(8)
    words = {"stone" + "".join(rng.choice("abcdefgh") for _ in range(5)): rng.randint(1, 9) for _ in range(500)}
    words |= {"".join(rng.choice("abcdefgh") for _ in range(9)): rng.randint(1, 9) for _ in range(900)}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), 64)
    assert {tuple(r) for r in got.collect()} == plain_variants(words)


def test_automaton_numbers_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("xyz") for _ in range(rng.randint(0, 6))) for _ in range(200)})
    a = spelling.Automaton(words)
    for k, w in enumerate(words):
        node, number = a.read(0, 0, w)
        assert a.ends[node] and number == k
    shared, seen, todo = spelling.Automaton(sorted(f"{x}ending" for x in "abcdefgh")), {0}, [0]
    while todo:
        more = set(shared.edges[todo.pop()].values()) - seen
        seen |= more
        todo += more
    assert len(seen) == 1 + len("xending")  # one tail for all words
    assert spelling.Automaton([]).one_error("abc", 1) == set()


def test_checksums_of_spans():
    import numpy as np

    texts = [b"", b"a", b"hello", b"x" * 300, "é".encode()]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([len(t) for t in texts])
    begun = np.array([zlib.crc32(f"{k}:".encode()) for k in range(5)], np.uint32)
    got = spelling.crc_of_spans(begun, data, ends - [len(t) for t in texts], ends)
    assert got.tolist() == [zlib.crc32(f"{k}:".encode() + t) for k, t in enumerate(texts)]
