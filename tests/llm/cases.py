"""Small tables with nulls, empty and long texts, ties, repeated rows and columns named like those of the operators."""

import random

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id bigint, key string, body string, n bigint, score double, size bigint, spans string, base string, taken bigint, n_lines bigint, n_removed bigint, kept string, n_tokens bigint, place bigint, h bigint"


def tricky(spark, more=(), seed=0):
    """(DataFrame, rows as (doc_id, text, lang, source))."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["Été", "ÉTÉ", "naïve", "x,y", "A.B"]
    long = " ".join(rng.choice(words) for _ in range(9000))
    passage = " ".join(rng.choice(words) for _ in range(80))
    rows = [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (4, "one", "en", None), (5, "one two\nthree\x0bfour\r\nfive six", "fr", "b"), (6, long, "en", "a"), (6 + 1, long, "xx", "b"), (8, passage + " tail " + passage, "de", "c"), (9, "Head " + passage, None, "c"), (9, "Head " + passage, None, "c"),
        (10, "".join(rng.choice("abcdefg") for _ in range(20000)), "en", "d"), (11, "same\nline\nsame\n", "en", "a"), (12, "SAME\nother  ", "en", "a"), (None, "no id at all " + passage, "en", "a"), (13, "  é́ 日本語 \U0001f600", "es", "é"),
        *more,
    ]
    full = [(i, t, lang, source, None if t is None else len(t), "r", 7, "k", "b", 3, 0.5, 9, "s", "b", 1, 1, 1, "k", 1, 1, 1) for i, t, lang, source in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
