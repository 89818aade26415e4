"""Quality rules against plain Python, one text at a time."""

import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ridgelens.llm import quality, toxicity
from ridgelens.llm.words import Words, blocks
from tests.llm.cases import DATA, empty, tricky

WORD = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(7)
NOISE = "".join(RNG.choice(string.ascii_letters + string.digits + "+/") for _ in range(6000))
PROSE = " ".join("".join(RNG.choice("etaoinshrdlu") for _ in range(RNG.randint(2, 9))) for _ in range(3000))

MIXED = " ".join(RNG.choice(PROSE.split()[:700]) for _ in range(3000))


def plain(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, verdict)."""
    t = text or ""
    words = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    repeated = {k + i for k, w in enumerate(windows) if often[w] > 1 for i in range(5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    z, raw = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False), t.encode()

    def side(part):
        band = [x for x in quality.LIMITS if x[0] <= len(part)]
        if not band:
            return 0
        ratio = len(z.compress(part)) / len(part)
        return -1 if ratio < band[-1][1] else 1 if ratio > band[-1][2] else 0

    parts = [side(raw[k : k + 1024]) for k in range(0, len(raw) - 1023, 1024)]
    parts = parts if len(parts) > 1 else []
    low, high = parts.count(-1), parts.count(1)
    verdict = {-1: "repetitive", 1: "incompressible"}.get(side(raw)) or ("kept" if low + high <= 0.25 * len(parts) else "repetitive parts" if low >= high else "incompressible parts")
    return len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated), failed, verdict == "kept" and not failed, "base" if failed else verdict


COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "verdict")
MORE = [
    (50, NOISE.replace("A", " "), "en", "a"), (51, MIXED[:10000] + "\n" + NOISE[:4800].replace("b", " "), "en", "a"), (52, PROSE, "en", "a"), (53, PROSE[:600], "en", "a"),
    (54, " ".join(f"abcdefghijklmnopqrstuvwxyz{k}" for k in range(400)), "en", "a"), (55, "one two three four five six seven one two three four five", "en", "a"), (56, "a a a a a a a a a a a a", "en", "a"),
    (57, "x\nx\n y\n\n\nx \nx\n# & <b> 50 % $", "en", "a"), (58, " ".join(str(k) for k in range(0, 40000, 7)), "en", "a"), (59, " ".join(map(str, range(12))), "en", "a"),
]


def test_quality(spark):
    df, rows = tricky(spark, MORE)
    keep = tuple(df.columns)
    got = Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in quality.rate(df, keep=keep).collect())
    assert got == Counter((i, *plain(t)) for i, t, _, _ in rows)
    assert quality.rate(empty(spark)).count() == 0
    verdicts = {r.doc_id: r.verdict for r in quality.rate(df).where("doc_id between 50 and 59").collect()}
    assert verdicts[50] == "incompressible" and verdicts[51] == "incompressible parts" and verdicts[52] == verdicts[53] == "kept" and verdicts[54] == "repetitive" and verdicts[56] == "base"


def test_the_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    out = quality.query(spark, DATA).collect()
    assert len(out) == len(texts) and all(tuple(r[c] for c in COLUMNS) == plain(texts[r.doc_id]) for r in out)


def test_clean_documents_stay(spark):
    """Of documents marked good that pass the base rules, hardly one falls out of its band; of the rest, repetitive ones do."""
    rows = quality.query(spark, DATA.replace("0.001", "0.01")).join(spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/labels.parquet"), "doc_id").where(~F.col("base_failed") & (F.col("quality") == 1))
    assert rows.count() > 100 and rows.where(~F.col("kept")).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=24), max_size=6))
def test_repeated_words(rows):
    texts = [" ".join(r) for r in rows]
    got = []
    for _, _, data, at in blocks(pa.array(texts, pa.string()), 30):
        got += quality.repeated_words(Words(data, at)).tolist()
    assert got == [plain(t)[4] for t in texts]


def test_bands():
    assert quality.outside(np.array([0.1, 0.5, 1.0, 0.1]), np.array([300, 300, 300, 100])).tolist() == [-1, 0, 1, 0]


def test_labels_are_read_once(spark):
    """Every step behind them starts from the distinct ids, not from the table of labels."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(k, f"word{k % 7} {'vile' if k % 3 == 0 else 'fine'} text", "en") for k in range(200)], "doc_id bigint, text string, lang string")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) as toxic").mapInArrow(counted, "doc_id bigint, toxic int")
    model = toxicity.train(docs, labels)
    assert read.value == 200 and 0 < model.threshold < 1
