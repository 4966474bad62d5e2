"""Tables with the cases that every operator must stand."""

import random

from pyspark.sql import DataFrame, SparkSession

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use themselves, as extra columns of a table.
CLASHES = ["id", "key", "word", "n", "a", "b", "bucket", "component", "kept", "c0", "t", "held_out", "score", "rule", "gone_id", "leaked_id", "ids", "n_tokens", "feature", "toxic"]


def prose(seed: int, n: int, lang: str = "en") -> str:
    words = {"en": "the of and river stone mountain house green walk under light morning people water great small garden winter they were with from", "de": "der die das und fluss stein berg haus grün gehen unter licht morgen leute wasser gross klein garten winter sie waren mit von", "fr": "le la les et rivière pierre montagne maison vert marcher sous lumière matin gens eau grand petit jardin hiver ils étaient avec dans"}[lang].split()
    rng = random.Random(seed)
    return " ".join(rng.choice(words) + rng.choice(["", "", "", "s", "er", ",", "."]) for _ in range(n))


def odd_rows() -> list[tuple]:
    base = prose(1, 300)
    edited = base.replace("river", "lake", 1)
    texts = [
        None,
        "",
        " \t\r\n\x0b\x0c ",
        "a",
        "!!! ... ???",
        "one two three four",
        "one two three four five",
        base,
        base,
        base.upper(),
        edited,
        prose(2, 300, "de"),
        prose(3, 300, "fr"),
        "<|endoftext|> mixed <|startoftext|> in<|endoftext|>side",
        "tabs\tand\r\nlines \n\n same line \n same line \n same line\n",
        "aaaaaaaaaaaaaaaa " * 60,
        "don't I'll WE'RE it's 'tis x'd 12345 67.89",
        "naïve café é ﬁ Ⅷ ½  nbsp em　wide ​zero",
        "漢字かな交じり文 한국어 العربية עברית हिन्दी ไทย",
        "😀👩‍👩‍👧 \U0001f1e6\U0001f1e8 \U00010348 \x00 \x01 \x7f",
        "x" * 5000,
        "ab" * 3000 + " " + "  " * 500 + "end",
        base + " " + prose(9, 40),
        "퟿  � ﻿",
        " ".join(str(i) for i in range(400)),
        prose(5, 20000),
    ]
    rows = [(i, t, [None, "en", "de", "fr"][i % 4], None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, prose(50 + i, 120, x), x, "hot", 0) for i in range(45) for x in [["en", "de", "fr"][i % 3]]]
    rows += [rows[7], rows[10], (None, base, "en", "s", 1), (None, None, None, None, None), (-5, prose(70, 90), "en", "s", 1)]
    return rows


def odd_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(odd_rows(), DOCUMENTS)


def clashing(df: DataFrame) -> DataFrame:
    """df with extra columns of clashing names."""
    return df.selectExpr("*", *(f"struct(1 x, 'y' y) {c}" for c in CLASHES if c not in df.columns))
