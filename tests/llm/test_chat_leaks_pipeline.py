"""Tool calls, benchmark leaks and the pipeline against plain versions."""

import json
import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pixweft.llm import chat, decontam, langid, quality, queries, stages

from . import brute
from .tables import clashing, odd_documents, odd_rows, prose

SF = os.environ.get("PIXWEFT_SF", "/root/testdata/sf0.001")
SCHEMAS = {"add": (("a", "BIGINT", True), ("note", "STRING", False))}


def linked(calls, results, schemas):
    """{call_id: (level, status, valid, errors)} by walking each chain."""
    one, answer, out = {}, {}, {}
    for c in sorted((c for c in calls if c["call_id"] is not None), key=lambda c: [(c[k] is not None, c[k]) for k in ("turn", "arguments", "tool", "after", "conv_id")]):
        one.setdefault(c["call_id"], c)
    for r in results:
        if r["call_id"] is not None:
            answer[r["call_id"]] = r
    kinds = {bool: "BOOLEAN", int: "BIGINT", str: "STRING"}
    for i, c in one.items():
        seen, at, level = set(), i, 0
        while at in one and one[at]["after"] in one and at not in seen:
            seen.add(at)
            at, level = one[at]["after"], level + 1
        cycle = at in seen
        fields = schemas.get(c["tool"])
        try:
            args = json.loads(c["arguments"])
        except (TypeError, ValueError):
            args = None
        if fields is None:
            errors = ["unknown tool"]
        elif not isinstance(args, dict):
            errors = ["not an object"]
        else:
            errors = [f"missing {f}" for f, _, must in fields if must and f not in args]
            errors += [f"{f} is not {k}" for f, k, _ in fields if f in args and kinds.get(type(args[f])) != k]
            errors = sorted(errors + [f"unknown {k}" for k in args if k not in [f for f, _, _ in fields]])
        errors += ["unknown dependency"] * (c["after"] is not None and c["after"] not in one) + ["cycle"] * cycle
        out[i] = (None if cycle else level, "linked" if i in answer else "unanswered", not errors, "; ".join(errors))
    return out | {i: (None, "orphan", None, "") for i in answer if i not in one}


def test_tool_calls(spark):
    rows = [
        ("c1", 1, 0, "add", '{"note":"x","a":1}', None),
        ("c2", 1, 1, "add", '{"a":"1"}', "c1"),
        ("c3", 1, 2, "add", '{"b":2}', "c2"),
        ("c3", 1, 9, "add", '{"a":2}', None),
        ("c4", 1, 3, "mul", '{"a":1}', "gone"),
        ("c5", 2, 0, "add", "[1]", "c6"),
        ("c6", 2, 1, "add", "not json", "c5"),
        ("c7", 2, 2, "add", None, "c6"),
        (None, 3, 0, "add", '{"a":1}', None),
        ("c8", None, None, None, '{"a":1}', "c8"),
        *((f"d{k}", 4, k, "add", '{"a":1}', f"d{k - 1}" if k else None) for k in range(40)),
    ]
    names = ["call_id", "conv_id", "turn", "tool", "arguments", "after"]
    calls = spark.createDataFrame(rows, "call_id string, conv_id long, turn long, tool string, arguments string, after string")
    answers = [("c1", 1, 1, 'a "quoted"\nline'), ("c2", 1, 2, None), ("lost", 1, 5, "x"), (None, 1, 6, "y"), ("c1", 1, 7, "later")]
    results = spark.createDataFrame(answers, "call_id string, conv_id long, turn long, content string")
    got = chat.link_tool_calls(calls, results, SCHEMAS).collect()
    want = linked([dict(zip(names, r, strict=True)) for r in rows], [{"call_id": r[0]} for r in answers], SCHEMAS)
    assert {r.call_id: (r.level, r.status, r.valid, r.errors) for r in got if r.call_id is not None} == want
    assert sum(r.status == "unidentified" for r in got) == 2 and len(got) == len(want) + 2
    for r in got:
        if r.message is not None:
            told = json.loads(r.message)
            assert list(told) == ["arguments", "id", "result", "tool"] and told["id"] == r.call_id
    message = {r.call_id: r.message for r in got}
    assert message["c1"] == '{"arguments":{"a":1,"note":"x"},"id":"c1","result":"a \\"quoted\\"\\nline","tool":"add"}'


def test_op2(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    user = {f"{r.conv_id}-{r.turn}": r for r in turns if r.role == "user"}
    calls = [{"call_id": i, "conv_id": r.conv_id, "turn": r.turn, "tool": "reply", "arguments": json.dumps({k: v for k, v in (("turn", r.turn), ("text", r.text)) if v is not None}), "after": after if (after := f"{r.conv_id}-{r.turn - 2}") in user else None} for i, r in user.items()]
    results = [{"call_id": f"{r.conv_id}-{r.turn - 1}"} for r in turns if r.role == "assistant"]
    every = queries.op2_chat_formatting(spark, SF).collect()
    got = [r for r in every if r.status != "no call"]
    others = [r for r in turns if r.role not in ("user", "assistant")]
    told = Counter((r.conv_id, r.turn, json.dumps({"content": r.text, "role": r.role}, ensure_ascii=False, separators=(",", ":"))) for r in others)
    assert others and Counter((r.conv_id, r.turn, r.message) for r in every if r.status == "no call") == told
    assert {r.call_id: (r.level, r.status, r.valid, r.errors) for r in got} == linked(calls, results, chat.REPLY)
    assert len(got) == len({r.call_id for r in got})


def test_op2_runs_no_python(spark):
    plan = queries.op2_chat_formatting(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(tool" not in plan
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def leaks_of(docs, items, n=decontam.MATCH):
    items = [(i, brute.alnum_tokens(t)) for i, t in items if t is not None]
    grams = lambda ws: {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
    has = defaultdict(set)
    for k, (_, ws) in enumerate(items):
        for g in grams(ws):
            has[g].add(k)
    out = Counter()
    for i, t in docs:
        ws = brute.alnum_tokens(t)
        for k in set().union(*(has.get(g, ()) for g in grams(ws))) if ws else ():
            tiles = brute.tiling(ws, items[k][1], n)
            covered = sum(x[2] for x in tiles)
            if covered >= decontam.COVERAGE * len(items[k][1]):
                out[i, items[k][0], len(tiles), covered, len(items[k][1])] += 1
    return out


def test_tiles_are_greedy():
    rng = random.Random(11)
    for _ in range(150):
        doc, item = [rng.choices("abc", k=rng.randrange(1, 40)) for _ in range(2)]
        at = [(i, j) for i in range(len(doc) - 2) for j in range(len(item) - 2) if doc[i : i + 3] == item[j : j + 3]]
        import numpy as np

        got = decontam.tiles(np.array([x for x, _ in at], int), np.array([y for _, y in at], int), 3) if at else []
        assert got == brute.tiling(doc, item, 3)


@pytest.mark.parametrize("kind", ["odd", "sf"])
def test_op10(spark, tmp_path, kind):
    path = SF
    if kind == "odd":
        path = str(tmp_path)
        items = [prose(500 + k, 40) for k in range(6)]
        halves = items[0].split()
        docs = [*odd_rows(), (900, prose(1, 50) + " " + items[1] + " " + prose(2, 50), "en", "s", 1), (901, " ".join(halves[20:] + prose(3, 9).split() + halves[:20]).upper(), "en", "s", 1), (902, " ".join(items[2].split()[:12]), "en", "s", 1), (903, items[3].replace(" ", "\n") * 2, None, None, None)]
        clashing(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")).write.parquet(f"{path}/documents.parquet")
        clashing(spark.createDataFrame([*enumerate(items), (7, None), (8, ""), (9, "too short"), (None, items[4]), (1, items[1]), (1, items[5])], "item_id long, text string")).write.parquet(f"{path}/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    got = Counter((r.doc_id, r.item_id, r.n_tiles, r.covered, r.item_tokens) for r in queries.op10_benchmark_decontamination(spark, path).collect())
    assert got == leaks_of(docs, items)
    if kind == "odd":
        assert {900, 901, 903} <= {i for i, *_ in got} and 902 not in {i for i, *_ in got}


def test_blocks_of_items_give_the_same(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    assert sorted(decontam.leaks(docs, items, block=900).collect()) == sorted(decontam.leaks(docs, items).collect())


def test_seeds_that_all_texts_and_items_share(spark):
    """Four common passages in every text and item: the join leaves the commonest seeds out and loses no leak."""
    common = [prose(900 + k, 8) for k in range(4)]
    items = [(k, " ".join([*common[: k % 5], prose(600 + k, 12)])) for k in range(30)] + [(99, " ".join(common)), (98, common[0])]
    docs = [(k, " ".join([prose(k, 30), *common[::-1], *([items[k % 30][1]] if k % 4 == 0 else [])])) for k in range(120)] + [(None, items[3][1])]
    table, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = leaks_of(docs, items)
    for block in (0, decontam.BLOCK):
        assert Counter((r.doc_id, r.item_id, r.n_tiles, r.covered, r.item_tokens) for r in decontam.leaks(table, bench, block=block).collect()) == want
        left = Counter((r.doc_id, r.text) for r in decontam.without_leaks(table, bench, block=block).collect())
        assert left == Counter(d for k, d in enumerate(docs) if not leaks_of([(k, d[1])], items))


@pytest.mark.parametrize("kind", ["odd", "sf"])
def test_pipeline(spark, tmp_path, kind):
    path = SF
    if kind == "odd":
        path = str(tmp_path)
        clashing(odd_documents(spark)).write.parquet(f"{path}/documents.parquet")
        spark.createDataFrame([(1, prose(51, 60)), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names, now = docs.columns, docs
    for (_, stage), check in zip(corpus_pipeline.STAGES, (good, known, single, clean, coded), strict=True):
        out = stage(spark, now, path)
        got = Counter((r.doc_id, r.text) for r in out.collect()) if "text" in out.columns else Counter((r.doc_id, r.n_tokens) for r in out.collect())
        assert got == check(spark, now, path)
        assert out.columns == names or stage is stages.encoded
        now = out
    whole = corpus_pipeline.run(spark, path)
    assert Counter((r.doc_id, r.n_tokens) for r in whole.collect()) == got


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def good(spark, docs, path):
    kept = Counter(r.doc_id for r in quality.judge(docs).where("kept").collect())
    out = Counter(r for r in rows(docs) if r[0] in kept)
    base = {brute.quality(*r)[0] for r in rows(docs) if not brute.quality(*r)[-1]}
    assert set(kept) <= base
    return out if sum(out.values()) == sum(kept.values()) else Counter(r for r in rows(docs) if r[0] in kept and not brute.quality(*r)[-1])


def known(spark, docs, path):
    fits = {(r.doc_id, r.lang_pred != "und" and r.rate <= langid.MAX_RATE) for r in langid.predict(docs).collect()}
    return Counter(r for r in rows(docs) if (r[0], True) in fits)


def single(spark, docs, path):
    part = brute.near_duplicates(rows(docs))
    return Counter({r: n for r, n in Counter(rows(docs)).items() if r[0] is None}) + Counter({r: 1 for r in rows(docs) if r[0] is not None and part[r[0]][1] == r[0]})


def clean(spark, docs, path):
    own = rows(docs)
    bad = {k[0] for k in leaks_of(list(enumerate(t for _, t in own)), [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()])}
    return Counter(r for k, r in enumerate(own) if k not in bad)


def test_columns_of_any_type_pass_the_stages(spark, tmp_path):
    """Structs with odd field names, maps, intervals, variants beside the texts of documents."""
    rng = random.Random(6)
    mixed = lambda k: " ".join(f"{w} {''.join(rng.choices('etaoinshrdlu', k=rng.randint(2, 8)))}" for w in prose(k, 60).split())
    docs = spark.createDataFrame([(k, prose(3, 80) if k == 3 else mixed(k)) for k in range(40)], "doc_id long, text string").selectExpr("*", "'en' as lang", "named_struct('a-b', 1, 'c.d', 'x') as s", "map('k', doc_id) as m", "interval 3 days 2 hours as i", "interval 2 years as y", "make_interval(1, 2, 3) as c", "parse_json('[1, {}]') as v", "array(named_struct('`', 1)) as `odd.name`")
    for left in (quality.keep_good(docs), langid.keep_known(docs), decontam.without_leaks(docs, spark.createDataFrame([(1, prose(3, 80))], "item_id long, text string"))):
        assert left.columns == docs.columns and left.dtypes == docs.dtypes
        assert 35 <= left.selectExpr("doc_id", "s.`a-b`", "m['k']", "i", "y", "to_json(v)", "cast(c as string)", "`odd.name`").count() <= 40
    docs.drop("c").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, prose(3, 80))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert 35 <= len(out) < 40 and 3 not in {r.doc_id for r in out}


def test_leaks_without_an_id_go(spark):
    item = prose(500, 40)
    docs = clashing(spark.createDataFrame([(None, f"{prose(1, 9)} {item}"), (None, prose(2, 50)), (1, None), (1, item), (1, prose(3, 50))], "doc_id long, text string")).withColumn("text_key", F.lit(1))
    left = decontam.without_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert left.columns == docs.columns and Counter((r.doc_id, r.text) for r in left.collect()) == Counter([(None, prose(2, 50)), (1, None), (1, prose(3, 50))])


def coded(spark, docs, path):
    return Counter(brute.bpe(*r)[:2] for r in rows(docs))


def test_stages_stand_empty_tables(spark, tmp_path):
    docs = odd_documents(spark).limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
