"""Each query against a plain version, on odd rows and on whole tables (PIXWEFT_SF: the folder of tables)."""

import os
from collections import Counter

import pytest

from pixweft.llm import bpe, chat, idfile, langid, lm, neardup, quality, queries, toxicity, urls

from . import brute
from .tables import clashing, odd_documents, odd_rows, prose

SF = os.environ.get("PIXWEFT_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module", params=["odd", "sf"])
def sf_dir(request, spark, tmp_path_factory):
    """A folder of tables: odd rows with clashing columns, or the given tables."""
    if request.param == "sf":
        return SF
    path = str(tmp_path_factory.mktemp("odd"))
    clashing(odd_documents(spark)).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, k % 2, int((i or 0) % 7 == 0)) for k, i in enumerate([0, 3, 3, 7, 100, 105, None, *range(110, 140)])] + [(7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    urls_ = [None, "", "no scheme", "http://", "HTTP://Sub.Example.ORG/es/x?q#f", "https://example.org/en/12", "http://a.b.com/fr/", "http://com/de/y", "http://xcom/de/", "://org/", "http://org", "http://casino.net/", "http://x.ads-track.io/?a", "http://a.org#/es/", "http://É.ORG/ü", "ftp://u@h.com:80/de/", "http://example.org/es/", "http://ads.foo.net/fr/", "x://y://z.com/de/"]
    clashing(spark.createDataFrame(list(enumerate([*urls_, urls_[4]])) + [(None, urls_[5])], "page_id long, url string")).write.parquet(f"{path}/pages.parquet")
    return path


def docs_of(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


def test_op1(spark, sf_dir):
    got = queries.op1_bpe_encoding_and_decoding(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert order(map(tuple, got.collect())) == order(brute.bpe(*r) for r in docs_of(spark, sf_dir))


def test_op3(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = queries.op3_url_filters(spark, sf_dir).collect()
    assert Counter(r.page_id for r in got) == Counter(r.page_id for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect())
    for r in got:
        host, path, rule, verdict = brute.site(pages[r.page_id])
        low = (pages[r.page_id] or "").translate(brute.A_TO_Z)
        method = "block" if any(brute.re.search(p.regex, low, brute.re.S) for p in urls.PATTERNS) else "allow"
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or method)


def test_op4(spark, sf_dir):
    rows = docs_of(spark, sf_dir)
    got = [tuple(r) for r in queries.op4_token_id_output(spark, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    if len({i for i, _ in rows}) == len(rows):
        assert sorted(got) == brute.id_file(rows)
        return
    # equal ids may come in any order
    want = brute.id_file([(-(10**9) if i is None else i, t) for i, t in rows])
    assert Counter((i, n, c) for i, _, n, c in got) == Counter((None if i == -(10**9) else i, n, c) for i, _, n, c in want)
    at = 0
    for i, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    assert [r[0] for r in sorted(got, key=lambda r: r[1])] == [None if r[0] == -(10**9) else r[0] for r in want]


def test_op5(spark, sf_dir):
    rows = docs_of(spark, sf_dir)
    got = queries.op5_lm_scoring(spark, sf_dir).collect()
    want = order((i, *b[:4], round(b[4], 5)) for (i, _), b in zip(rows, brute.base_scores(rows), strict=True))
    assert order((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    if sf_dir == SF:
        held = [r for r in got if r.held_out]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_op6(spark, sf_dir):
    rows = docs_of(spark, sf_dir)
    want = brute.near_duplicates(rows)
    got = queries.op6_minhash_near_dedup(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        if r.doc_id is None:
            assert (r.component_id, r.kept) == (None, False)
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], r.doc_id == want[r.doc_id][1])


def test_op7(spark, sf_dir):
    rows = docs_of(spark, sf_dir)
    got = queries.op7_toxicity(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, brute.zlib.crc32(("" if i is None else str(i)).encode()) % 3 == 1) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_toxicity_of_rows_held_out(spark):
    """The smallest tables have too few labels to learn from."""
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    told = [(toxic[r.doc_id], r.predicted) for r in queries.op7_toxicity(spark, sf).collect() if r.held_out and r.doc_id in toxic]
    assert sum(a == b for a, b in told) >= 0.95 * len(told)
    assert sum(a * b for a, b in told) >= 0.7 * sum(a for a, _ in told)


def test_toxic_passage_in_a_long_text(spark):
    """A few chance hits don't count in a long text, a run of them does."""
    clean = [prose(900 + i, 200) for i in range(200)]
    bad = [" ".join(w if k % 20 else ["grobian", "scoundrelly"][k % 40 == 0] for k, w in enumerate(prose(i, 200).split())) for i in range(60)]
    long = prose(77, 8000)
    rows = [(i, t) for i, t in enumerate(clean + bad)] + [(1000, long.replace(" stone ", " grobian ", 1)), (1001, f"{long} {bad[0]} {long}"), (1002, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(260)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(docs, labels).collect()}
    assert [got[i] for i in (1000, 1001, 1002)] == [0, 1, 0]


def test_op8(spark, sf_dir):
    rows = docs_of(spark, sf_dir)
    got = queries.op8_language_id(spark, sf_dir).collect()
    text = {}
    for i, t in rows:
        text.setdefault(i, []).append(t)
    assert Counter((r.doc_id, r.held_out) for r in got) == Counter((i, brute.zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) for i, _ in rows)
    for r in got:
        if len(text[r.doc_id]) == 1:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text[r.doc_id][0] or ""))
    if sf_dir == SF:
        lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
        told = [(lang[r.doc_id], r.lang_pred) for r in got if r.held_out and lang[r.doc_id] is not None and r.lang_pred != "und"]
        assert sum(a == b for a, b in told) >= 0.95 * len(told)


def test_op9(spark, sf_dir):
    got = queries.op9_quality_rules(spark, sf_dir).collect()
    want = order(brute.quality(*r) for r in docs_of(spark, sf_dir))
    assert order((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept and (r.base_failed or r.band_failed) for r in got)


def test_empty_tables(spark, tmp_path):
    path = str(tmp_path)
    odd_documents(spark).limit(0).write.parquet(f"{path}/documents.parquet")
    for name, kinds in (("labels", "doc_id long, quality int, toxic int"), ("pages", "page_id long, url string, html string"), ("benchmark", "item_id long, text string"), ("conversations", "conv_id long, turn long, role string, text string"), ("embeddings", "vec_id long, embedding array<float>, label int")):
        spark.createDataFrame([], kinds).write.parquet(f"{path}/{name}.parquet")
    for query in queries.QUERIES.values():
        assert query(spark, path).count() == 0


def test_encoding_is_a_round_trip(spark):
    docs = odd_documents(spark)
    got = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs)).collect()}
    t = brute.tokenizer("byte_bpe_50k.json")
    for r in odd_rows():
        if r[0] is not None and (r[1] or "") == t.decode(t.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False):
            assert got[r[0]] == (r[1] or "")


def test_merges_of_repeated_letters():
    v = bpe.vocabulary(bpe.VOCABULARY)
    t = brute.tokenizer("byte_bpe_50k.json")
    found = [brute.bpe(0, "")[1], *(len(v.merge([("a" * n).encode()])[0]) // 4 for n in range(1, 40))]
    assert found == [0, *(len(t.encode("a" * n, add_special_tokens=False).ids) for n in range(1, 40))]


def test_codes_are_short_and_complete():
    import numpy as np

    rng = np.random.default_rng(1)
    for counts in ([1], [5, 1], [1] * 33, [2**k for k in range(30)], rng.zipf(1.2, 3000).tolist(), []):
        n = np.array(counts, np.int64)
        lengths = idfile.code_lengths(n).astype(int)
        assert lengths.max(initial=0) <= idfile.LIMIT
        if len(n) > 1:
            assert sum(2.0**-x for x in lengths[lengths > 0]) == 1
        if len(n):
            ids = rng.integers(0, len(n), 1000)
            bits, checkpoints = idfile.pack(ids, lengths.astype(np.uint8), idfile.canonical(lengths)[1])
            assert (idfile.unpack(np.frombuffer(bits, np.uint8), checkpoints, 1000, idfile.decoding_table(lengths)) == ids).all()


def test_minhash_keeps_a_large_group_of_near_copies(spark):
    base = brute.words(odd_rows()[-1][1]) * 3
    rows = [(i, " ".join(w if k != i % len(base) else f"w{i}" for k, w in enumerate(base))) for i in range(300)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = brute.near_duplicates(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == want


def test_quality_bands_reject_repetition_and_noise(spark):
    import random

    rng = random.Random(3)
    loop = "\n".join(f"{a} click here to subscribe to our great newsletter {a}" for a in range(300))
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(60)) for _ in range(200))
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame([(1, loop), (2, noise)], "doc_id long, text string")).collect()}
    assert got[1].band_failed and got[2].band_failed


def test_quality_bands_keep_clean_long_texts(spark):
    """1 MB or more of sentences that differ; repeated at a distance, they fail."""
    sentences = {}
    for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang != 'en' and length(text) < 200000").select("doc_id", "text", "lang").orderBy("doc_id").collect():
        sentences.setdefault(r.lang, {}).update(dict.fromkeys(x for x in brute.re.split(r"(?<=[.!?])\s+", r.text) if 40 <= len(x) <= 400))
    clean = [" ".join(s) for s in sentences.values()]
    clean = [t for t in clean if len(t) >= 1 << 20]
    rows = [(i, t) for i, t in enumerate(clean)] + [(100 + i, " ".join([t[: 1 << 18]] * 5)) for i, t in enumerate(clean)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean and [i for i, r in sorted(got.items()) if r.band_failed] == [100 + i for i in range(len(clean))]


def test_language_score_and_whole_text(spark):
    docs = odd_documents(spark)
    one = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs).where("doc_id is not null").dropDuplicates(["doc_id"]).collect()}
    assert all(0 <= s <= 1 for _, s in one.values())
    assert one[102][0] == "fr" and one[101][0] == "de" and one[103][0] == "en"


def test_model_probabilities_sum_to_one():
    import numpy as np

    v = lm.Vocabulary(np.sort(np.arange(1, 101, dtype=np.uint64)), np.arange(200, 100, -1), np.arange(100), np.arange(200, 100, -1).astype(float), np.concatenate([[float(np.arange(200, 100, -1)[k * lm.CLASS : (k + 1) * lm.CLASS].sum()) for k in range(3)], np.ones(lm.POWERS + 1)]), 20000, 500)
    m = lm.new_model(v)
    h = np.random.default_rng(2).standard_normal((1, lm.HIDDEN)).astype(np.float32)
    n = np.arange(100)
    head = np.exp(lm.output(m, v, np.repeat(h, 100, 0), n // lm.CLASS, n, np.zeros(100))).sum()
    classes = np.exp(h @ m.c + m.cb)[0]
    classes /= classes.sum()
    assert abs(head - classes[: v.head_classes].sum()) < 1e-4 and abs(classes.sum() - 1) < 1e-4


def test_gradients_match_differences():
    import numpy as np

    v = lm.Vocabulary(np.arange(1, 61, dtype=np.uint64), np.full(60, 10), np.arange(60), np.full(60, 10.0), np.concatenate([[400.0, 200.0], np.ones(lm.POWERS + 1)]), 1000, 90)
    m = lm.Model(*(a.astype(np.float64) for a in lm.new_model(v)))
    rng = np.random.default_rng(4)
    inputs = rng.integers(0, 60, (6, 3))
    kinds = inputs // lm.CLASS
    h0 = np.zeros((3, lm.HIDDEN))

    def loss():
        h, total = h0, 0.0
        for t in range(6):
            total -= lm.output(m, v, h, kinds[t], inputs[t], np.zeros(3)).sum()
            h = lm.step(m, m.x[inputs[t]], h)[0]
        return total / 18

    grads, _ = lm._gradients(m, v, inputs, kinds, h0)
    for a, g in zip(m, grads, strict=True):
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in a.shape)
            old = a[at]
            a[at] = old + 1e-5
            up = loss()
            a[at] = old - 1e-5
            down = loss()
            a[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-5


def test_model_learns_from_the_ends_of_long_texts(spark):
    """An order of words that comes after character 4,000 alone."""
    loop = "zum zam zim zom " * 150
    rows = [(i, f"{prose(i, 1000)} {loop}") for i in range(60)] + [(100 + i, loop) for i in range(60)]
    rows = [r for r in rows if (brute.zlib.crc32(str(r[0]).encode()) % 10 == 0) == (r[0] >= 100)]
    got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert got and all(r.score > 0.6 * r.base_score for r in got)


URLS = {
    "ad tracker": ["http://ads-track.net/", "http://x.ads-track-y.io/"],
    "ad server": ["http://ads.foo.net/", "http://x.ads.foo.net/"],
    "spam farm": ["http://spam-farm.net/", "http://x-spam-farm-y.net/"],
    "casino": ["http://casino.net/", "http://casino-royal.net/", "http://x.casino-y.net/"],
    "bets": ["http://free-bet.example.net/", "http://free-bets.example.net/", "http://x.free-bet-y.net/"],
    "adult": ["http://adult-x.net/", "http://y.adult-x-z.net/"],
    "adult tubes": ["http://porn.net/", "http://a.net/x-porn-tube/"],
    "pills": ["http://cheap-pills.net/", "http://x.cheap-pills-y.net/"],
    "warez": ["http://a.net/warez/"],
    "phishing": ["http://a.net/verify-your-account/"],
    "link farm": ["http://link-farm.net/", "http://x.link-farm-y.net/"],
    "session page": ["http://a.net/?phpsessid=0a", "http://a.net/?b;phpsessid=f"],
}


def test_patterns_find_their_urls_by_each_token():
    """Whichever token is the rarest, a url with or without the optional parts fetches the rule."""
    assert set(URLS) == {p.name for p in urls.PATTERNS}
    for p in urls.PATTERNS:
        for rarest in p.tokens:
            filed = urls.index((p,), {t: 1 + (t != rarest) for t in p.tokens})
            assert list(filed) == [rarest]
            for url in URLS[p.name]:
                assert brute.re.search(p.regex, url)
                assert rarest in urls._TOKEN.findall(url), (p.name, rarest, url)


def test_verdict_of_a_single_free_bet(spark):
    got = urls.judge(spark.createDataFrame([(1, "http://free-bet.example.net/")], "page_id long, url string")).first()
    assert (got.verdict, got.pattern) == ("block", "bets")


def test_turns_of_other_roles_are_no_calls(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, None, "n"), (1, 4, "User", "x")]
    calls, results, others = chat.from_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert [r.turn for r in calls.collect()] == [1] and [r.turn for r in results.collect()] == [2]
    assert sorted(r.turn for r in others.collect()) == [0, 3, 4]


def test_links_are_kept_whole(spark):
    """A chain of copies, each a little further from the first: only neighbours are linked, all are one component."""
    base = [f"w{k}" for k in range(400)]
    rows = [(i, " ".join(f"x{k}" if k < 12 * i else w for k, w in enumerate(base))) for i in range(12)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.collect()} == {0}


def test_pieces_of_words_give_the_library_s_ids():
    import random

    import numpy as np
    import pyarrow as pa

    from pixweft.llm import textkernel

    rng = random.Random(7)
    signs = [*"abzABZ019.,'<|>-!  \n\t", "é", "Ñ", "ß", "×", "÷", "İ", "ſ", "K", "́", "⃣", "\xa0", "…", "—", "’", "漢", "😀", "\x00", "\x1c", "\x7f", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", "¼", "٣", "ﬁ"]
    for _ in range(60):
        texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(20)]
        data, off = textkernel.buffers(pa.array(texts, pa.large_string()))
        *own, at = idfile.pieces(data, off)
        ids, n = idfile.encoder(idfile.VOCABULARY).ids(data, *own)
        bounds = np.concatenate([[0], np.cumsum(n)])[at]
        for text, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert ids[a:b].tolist() == brute.tokenizer("word_bpe_49k.json").encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("conversations", "pages"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    assert {c: {"bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN"}[k] for c, k in got.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert Counter(map(tuple, got.select(*names).collect())) == Counter(want.select(*names).fetchall())
