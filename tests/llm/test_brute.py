"""Methods that SQL can't express against plain versions: language ID, toxicity, bands; and texts whose hashes collide."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pydoc_data.topics
import pytest
import zstandard

from pixweft.llm import bpe, decontam, idfile, langid, lm, neardup, quality, queries, shared, stages, textkernel, toxicity, urls
from pixweft.llm.components import components

from . import brute
from .tables import clashing, odd_documents, odd_rows, prose

SF = "/root/testdata/sf0.001"


def thue_morse(n):
    """Two words of 2 ** n letters that polynomial hashes modulo 2 ** 64 can't tell apart."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


ONE, TWO = thue_morse(11)


@pytest.fixture(scope="module")
def twins(spark):
    """The pair alone and inside texts, in both orders."""
    rest = prose(4, 60)
    rows = [(0, ONE), (1, TWO), (2, f"{ONE} {TWO} {rest}"), (3, f"{TWO} {ONE} {rest}"), (4, f"{rest} {ONE}"), (5, f"{rest} {TWO}"), (6, f"{ONE}\n{TWO}\n{ONE}\n{rest}")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_a_document_with_several_texts(spark):
    """Links by any text of a doc_id, in either order of rows; empty texts and rows without an id beside them."""
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    rows = [(1, a), (1, b), (3, f"{a} word"), (4, f"{b} word"), (5, c), (6, c), (6, ""), (7, ""), (7, None), (8, f"{c} word"), (2, f"{c} more"), (2, f"{b} more"), (9, prose(9, 60)), (9, prose(9, 60)), (None, c), (None, a)]
    sets = [(i, brute.shingles(t)) for i, t in rows if i is not None]
    links = [(i, j) for i, x in sets for j, y in sets if i < j and x and y and 100 * len(x & y) >= 85 * len(x | y)]
    part = brute.components(links, [i for i, _ in sets])
    assert part == dict.fromkeys(range(1, 9), 1) | {7: 7, 9: 9}
    want = Counter((i, len(brute.shingles(t)), part.get(i), part.get(i) == i and i is not None) for i, t in rows)
    for order in (rows, rows[::-1]):
        got = neardup.near_duplicates(spark.createDataFrame(order, "doc_id long, text string")).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
        assert {r.class_id for r in got if r.doc_id == 6} == {5, 6}
    single = stages.one_of_each_group(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert Counter((r.doc_id, r.text) for r in single.collect()) == Counter([(1, min(a, b)), (7, None), (9, prose(9, 60)), (None, c), (None, a)])


def test_components_of_odd_links(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(-40, 40, (45, 2))] + [(100 + k, 101 + k) for k in range(60)] + [(7, 7), (None, 3), (4, None)] + [(500, 600 + k) for k in range(50)]
    got = components(spark.createDataFrame(pairs + pairs[:9], "a long, b long"))
    linked = [p for p in pairs if None not in p and p[0] != p[1]]
    assert sorted(map(tuple, got.collect())) == sorted(brute.components(linked, {x for p in linked for x in p}).items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_clear_deletes_what_a_session_wrote(spark):
    import os

    shared.clear(spark)
    table = shared.cut(spark.range(3), "three")
    path = idfile.new_path(spark)
    idfile.write(spark.createDataFrame([(1, "a text")], "doc_id long, text string"), path)
    paths = [p.removeprefix("file:") for p in (table.inputFiles()[0].rsplit("/", 1)[0].replace("///", "/"), path)]
    assert all(map(os.path.exists, paths))
    shared.clear(spark)
    assert not any(map(os.path.exists, paths))


def test_twins_in_every_operator(spark, twins):
    rows, docs = twins
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs)).collect()}
    t = brute.tokenizer("byte_bpe_50k.json")
    for i, text in rows:
        assert got[i].ids == t.encode(text, add_special_tokens=False).ids and got[i].text == text
    path = idfile.new_path(spark)
    idfile.write(docs, path)
    ids = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in idfile.read(spark, path).collect()}
    w = brute.tokenizer("word_bpe_49k.json")
    assert ids == {i: [*w.encode(text, add_special_tokens=False).ids, 2] for i, text in rows}
    want = sorted((i, *b[:4], round(b[4], 6)) for (i, _), b in zip(rows, brute.base_scores(rows), strict=True))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score(docs).collect()) == want
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs).collect()} == brute.near_duplicates(rows)
    stats = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    assert stats == sorted(brute.quality(*r) for r in rows)
    items = spark.createDataFrame([(1, f"{ONE} b c d e"), (2, f"{TWO} b c d e")], "item_id long, text string")
    leaked = decontam.leaks(spark.createDataFrame([(1, f"x {ONE} b c d e y")], "doc_id long, text string"), items)
    assert [(r.doc_id, r.item_id) for r in leaked.collect()] == [(1, 1)]


def test_ids_are_right_where_all_hashes_collide(monkeypatch):
    monkeypatch.setattr(textkernel, "span_hashes", lambda data, starts, ends, lower=True: (np.asarray(ends) - starts).astype(np.uint64) % np.uint64(3))
    texts = [t for _, t, *_ in odd_rows()[:26] if t is None or len(t) < 4000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    t = brute.tokenizer("byte_bpe_50k.json")
    got = [x for b in bpe._encoded(iter([batch]), bpe.VOCABULARY) for x in b.column(1).to_pylist()]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    w, encoder = brute.tokenizer("word_bpe_49k.json"), idfile.PieceEncoder(idfile.VOCABULARY)
    for half in (texts[:13], texts[13:]):  # the second meets what the first left in the cache
        data, off = textkernel.buffers(pa.array(half, pa.large_string()))
        *own, at = idfile.pieces(data, off)
        ids, n = encoder.ids(data, *own)
        bounds = np.concatenate([[0], np.cumsum(n)])[at]
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [w.encode(x or "", add_special_tokens=False).ids for x in half]


@pytest.mark.parametrize("kind", ["odd", "sf"])
def test_language_by_plain_parsing(spark, kind):
    docs = odd_documents(spark) if kind == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    docs = clashing(docs) if kind == "odd" else docs
    sample = langid.sample(docs)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if len(r.text or "") < 3000]
    want = Counter((i, *(round(x, 9) if k else x for k, x in enumerate(brute.language(t, sample, langid.SEGMENT)))) for i, t in rows)
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 9), round(r.rate, 9)) for r in langid.predict(docs).collect())
    assert want and not want - got


def test_language_sample_is_bounded_whole_and_without_copies(spark):
    rows = [(i, "ein text der sich wiederholt", "de") for i in range(500)] + [(1000 + i, f"{prose(i, 500)} zuletzt{i}", "en") for i in range(80)] + [(2000 + i, None, "fr") for i in range(60)] + [(3000, "un seul texte", "fr"), (3001, "nur " * 30000, "xx"), (3004, "123", "yy")]
    rows = [(i + (brute.zlib.crc32(str(i).encode()) % 4 == 2) * 10_000_000, t, lang) for i, t, lang in rows]
    rows = [r for r in rows if brute.zlib.crc32(str(r[0]).encode()) % 4 != 2]
    got = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = {(lang, t) for _, t, lang in rows}
    assert len(got) == len(set(got)) and set(got) <= texts
    size = {lang: [len(t) for n, t in got if n == lang] for lang in ("de", "en", "fr", "xx", "yy")}
    assert len(size["de"]) == 1 and not size["yy"] and all(len(s) <= langid.ROWS for s in size.values())
    assert size["en"] and sum(size["en"]) <= langid.CHARS


def _hash(word):
    data, off = textkernel.buffers(pa.array([word.decode()], pa.large_string()))
    return int(textkernel.span_hashes(data, off[:-1], off[1:])[0])


def _place(before, after):
    x = np.array([((_hash(before) if before is not None else 0) * 3 + (_hash(after) if after is not None else 0)) % (1 << 64)], np.uint64)
    return int(textkernel.mix(x)[0] & np.uint64(63))


def _toxic_rows():
    rng = random.Random(8)
    kinds = ["you grobian {}", "not a grobian {}", "he said grobian {} {} {}", "i will kill you {}", "scoundrelly {} thing", "{} never hurt them", "les {} tuer"]
    bad = [" ".join(rng.choice(kinds).replace("{}", rng.choice(prose(i, 9).split())) + rng.choice([".", "!", ";", "\n"]) + " " + prose(i * 7 + k, 6) for k in range(4)) for i in range(70)]
    return [*bad, *(prose(900 + i, 60) for i in range(120)), None, "", "grobian", "You grobian!", "kill kill you kill"]


def test_toxicity_by_plain_rules(spark):
    texts = _toxic_rows()
    label = {i: int(i < 70) for i in range(190)}
    docs = clashing(spark.createDataFrame([*enumerate(texts), (3, texts[3]), (None, texts[4])], "doc_id long, text string"))
    labels = spark.createDataFrame([*label.items(), (5, 0), (None, 1)], "doc_id long, toxic int")
    learned = [(texts[i], t) for i, t in [*label.items(), (3, 1)] if brute.zlib.crc32(str(i).encode()) % 3 != 1]
    features, rate = brute.lexicon(learned, toxicity.STEMS, toxicity.EVIDENCE, toxicity.LEAST, toxicity.MOST, toxicity.CONTEXTS, _hash, _place)
    assert any(f in features for f in (b"grobian", (b"grob", 4)))
    words = {k: set(v.split()) for k, v in toxicity.WORDS.items()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
    for i, text in enumerate(texts):
        parts = [(len(c), brute.clause_weight(c, {w: brute.insult(w.encode(), features, toxicity.STEMS) for w in c}, words)) for c in brute.clauses(text)]
        log_odds = math.log(toxicity.PRIOR / (1 - toxicity.PRIOR)) + brute.text_weight(parts, rate, toxicity.RUN)
        assert abs(got[i] - 1 / (1 + math.exp(-log_odds))) < 1e-6, text


def test_grammar_is_the_composition_and_decides():
    rng = random.Random(2)
    kinds = ["other", "insult", *toxicity.WORDS]
    words = {k: {k} for k in toxicity.WORDS}
    for _ in range(300):
        own = rng.choices(kinds, k=rng.randrange(1, 25))
        symbols = [toxicity.SYMBOLS.index(k) for k in own]
        assert abs(toxicity.clause_weight(symbols, [3.0 * (k == "insult") for k in own]) - brute.clause_weight(own, {"insult": 3.0}, words)) < 1e-9
    verdict = lambda *own: toxicity.clause_weight([toxicity.SYMBOLS.index(k) for k in own], [2.6 * (k == "insult") for k in own]) >= math.log(0.7 / 0.3) - math.log(1 / 9)
    assert verdict("target", "insult") and verdict("insult", "other", "target")
    assert not any((verdict("insult"), verdict("target", "negation", "insult"), verdict("reported", "other", "target", "insult"), verdict("insult", "other", "other", "other", "target")))
    meant, bare = (toxicity.clause_weight([toxicity.SYMBOLS.index(k) for k in own], [0.0] * len(own)) for own in (["modal", "threat", "target"], ["modal", "threat"]))
    assert meant == 2.5 and bare == 0


@pytest.mark.parametrize("kind", ["odd", "sf"])
def test_bands_by_plain_rules(spark, kind):
    docs = odd_documents(spark) if kind == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    press = zstandard.ZstdCompressor(level=quality.LEVEL).compress
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, failed := brute.bands((t or "").encode(), press, quality.limits, quality.CHUNK, quality.CHUNK_BAND, quality.BAD_SHARE, quality.GAINS), not failed and not brute.quality(i, t)[-1]) for i, t in rows)
    assert Counter((r.doc_id, r.band_failed, r.kept) for r in quality.judge(docs).collect()) == want


def test_bands_keep_real_prose(spark):
    """Python's own manual: text with lists and tables, whole and in its long parts."""
    manual = "\n".join(pydoc_data.topics.topics.values())
    rows = [(n, manual[:n]) for n in (1024, 2048, 4096, 6000, 8192, 12_000, 20_000, 60_000, 200_000, 500_000)]
    assert not any(r.band_failed for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_bands_find_labelled_junk_and_keep_labelled_text(spark):
    """Of the texts of sf0.1 that pass the base rules."""
    sf = "/root/testdata/sf0.1"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("not base_failed")
    got = {(r.quality, r.band_failed): r["count"] for r in judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "band_failed").count().collect()}
    assert got.get((1, True), 0) == 0 and got[0, True] >= 230 and got[0, True] >= 0.8 * (got[0, True] + got.get((0, False), 0))


def test_folder_of_a_session_without_one(tmp_path):
    class Context:
        def __init__(self, master, folder=None):
            self.master, self.folder = master, folder

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, folder):
            self.folder = folder + "/app"

    class Session:
        def __init__(self, context, conf=None):
            self.sparkContext, self.conf = context, {"spark.checkpoint.dir": conf} if conf else {}

    assert shared.shared_dir(Session(Context("spark://x"), "hdfs://a/b/")) == "hdfs://a/b"
    assert shared.shared_dir(Session(Context("yarn", "/shared/app"))) == "/shared/app"
    local = Session(Context("local[2]"))
    assert shared.shared_dir(local) == shared.shared_dir(local) == local.sparkContext.folder
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session(Context("spark://x")))


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, prose(1, 200), "en", 5)], "doc_id long, text string, lang string, `a.b` long")
    assert quality.keep_good(docs).columns == langid.keep_known(docs).columns == docs.columns


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 60, 0])
def test_language_model_by_plain_steps(spark, monkeypatch, frequent):
    """Whole texts token by token from the trained weights, however many words the tasks are sent."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "HEAD", 45)
    rows = [(i, f"{prose(i, 80)} rare{i % 17} once{i}") for i in range(40)] + [(50, None), (51, "once3 never seen"), (51, "once3 never seen")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    v, encoded = lm.encode(docs)
    m = lm.train(v, encoded)
    count = Counter(w for i, t in rows if brute.zlib.crc32(str(i).encode()) % 10 for w in [*(x.translate(brute.A_TO_Z) for x in brute.words(t)), None])
    assert len(v.hashes) <= frequent and (v.total, v.distinct) == (sum(count.values()), len(count))
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    log_softmax = lambda x: x - np.log(np.exp(x).sum())
    want = Counter()
    for i, t in rows:
        h, total = np.zeros(lm.HIDDEN), 0.0
        for w in [*(x.translate(brute.A_TO_Z) for x in brute.words(t)), None]:
            n = count[w]
            rank = int(v.known(np.array([lm.END if w is None else _hash(w.encode())], np.uint64))[0][0])
            kind = rank // lm.CLASS if rank >= 0 else v.head_classes + (min(int(math.log2(n)), lm.POWERS - 1) if n else lm.POWERS)
            total += log_softmax(h @ m.c.astype(float) + m.cb)[kind]
            if rank >= 0:
                assert v.head_counts[rank] == n
                own = slice(kind * lm.CLASS, (kind + 1) * lm.CLASS)
                total += log_softmax(m.w[own].astype(float) @ h + m.wb[own])[rank - own.start]
            elif n:
                total += math.log((n + 0.1) / sum(c + 0.1 for x, c in count.items() if min(int(math.log2(c)), lm.POWERS - 1) == kind - v.head_classes and v.known(np.array([lm.END if x is None else _hash(x.encode())], np.uint64))[0][0] < 0))
            row, past, k = m.x[rank if rank >= 0 else len(v.head_counts) + kind - v.head_classes].astype(float), h @ m.u.astype(float), lm.HIDDEN
            z, r = sigmoid(row[:k] + past[:k]), sigmoid(row[k : 2 * k] + past[k : 2 * k])
            fresh = np.tanh(row[2 * k :] + r * past[2 * k :])
            h = (1 - z) * fresh + z * h
        want[i, round(total / math.log(10), 2)] += 1
    got = encoded.mapInArrow(lambda batches: lm._scored(batches, m, v), lm.OUT).collect()
    assert Counter((r.doc_id, round(r.score, 2)) for r in got) == want
    base = sorted((i, *b[:4], round(b[4], 6)) for (i, _), b in zip(rows, brute.base_scores(rows), strict=True))
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base


@pytest.mark.parametrize("part", [1 << 9, 1 << 11, 1 << 22])
def test_every_training_token_is_read_once_at_any_size(spark, monkeypatch, part):
    """Large and small inputs alike: `part` stands for the input's size. What a round reads is told by the models' token counts."""
    rows = [(i, f"{prose(i, 60)} rare{i % 17}") for i in range(150)] + [(400, None), (401, prose(1, 30)), (401, prose(1, 30))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    v, encoded = lm.encode(docs)
    read = []

    def mean(models):
        read.append(sum(t for t, _ in models))
        return real(models)

    real = lm._mean
    monkeypatch.setattr(lm, "_mean", mean)
    lm.train(v, encoded, part)
    assert len(read) == lm.ROUNDS and sum(read) == v.total and min(read) > 0


def test_scores_don_t_depend_on_how_texts_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lm.train, "__defaults__", (1 << 9,))
    rows = [(i, f"{prose(i, 60)} rare{i % 17}") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({r.doc_id: r.score for r in lm.score(d).collect()} for d in (docs.repartition(1), docs.repartition(7, "text")))
    assert one.keys() == two.keys() and all(math.isclose(one[i], two[i], rel_tol=1e-5) for i in one)


def test_models_are_averaged_by_tokens():
    rng = np.random.default_rng(1)
    rows = [(int(n), rng.standard_normal(5).astype("<f4")) for n in (1, 10, 100, 1000)]
    batches = [pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([w.tobytes()], pa.binary())], ["tokens", "weights"]) for n, w in rows]
    (got,) = lm._averaged(iter(batches))
    mean = sum(n * w.astype(float) for n, w in rows) / 1111
    assert got.column(0).to_pylist() == [1111] and np.allclose(np.frombuffer(got.column(1)[0].as_py(), "<f4"), mean, atol=1e-5)


def test_urls_by_sql_on_generated_ones(spark, tmp_path):
    """Hosts, paths and pattern words in all kinds of combinations: the index must not change a verdict."""
    import duckdb

    rng = random.Random(4)
    words = ["ads", "ads-track", "track", "spam-farm", "spam", "farm", "casino", "casino-royal", "free-bet", "free-bets", "bets", "adult-x", "adult", "porn", "porn-tube", "cheap-pills", "pills", "warez", "verify-your-account", "link-farm", "example", "net", "org", "com", "io"]
    made = []
    for _ in range(1500):
        host = rng.choice([".", "-"]).join(rng.choice(words) for _ in range(rng.randrange(1, 4))) + rng.choice([".org", ".com", ".net", "", ".example.org"])
        path = rng.choice(["", "/", "/es/", "/en/1", "/fr/", "/de/x", f"/{rng.choice(words)}/", f"/a_{rng.choice(words)}.html"]) + rng.choice(["", "?q", "?PHPSESSID=0af", "#/de/", ";phpsessid=1"])
        url = rng.choice(["http://", "https://", "HTTP://", "", "://"]) + (host.upper() if rng.random() < 0.1 else host) + path
        made.append((len(made), url))
    spark.createDataFrame(made, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(queries.ORACLE["op3_url_filters"])
    got = queries.op3_url_filters(spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
    hit = Counter(r.pattern for r in urls.judge(spark.read.parquet(f"{tmp_path}/pages.parquet")).collect())
    assert {p.name for p in urls.PATTERNS} <= set(hit)


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_at_other_thresholds(spark, percent):
    assert [neardup.may_differ(85, n) for n in (32, 256)] == [15, 65]
    base = prose(1, 400).split()
    rng = random.Random(percent)
    rows = []
    for i in range(120):
        ws, at = list(base if i < 60 else prose(i % 7, 300).split()), rng.randrange(0, 14)
        for k in rng.sample(range(len(ws)), at):
            ws[k] = f"w{i}x{k}"
        rows.append((i, " ".join(ws)))
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute.near_duplicates(rows, percent)
