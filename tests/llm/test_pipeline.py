"""The pipeline's stages, one after the other on the smallest tables, against plain Python on each stage's own input."""

import re
from collections import Counter, defaultdict

import public_tokenizers

from pyspark.sql import functions as F

import corpus_pipeline
from ridgelens.llm import mixing, toxicity
from ridgelens.llm.common import documents, stage
from tests.llm.cases import tricky

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(spark):
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "line_dedup", "ngram_jaccard", "mix_sources", "packing"]
    docs = documents(spark, DATA)
    names = docs.columns

    # toxicity: what the classifier rejects goes, the rest is untouched
    clean = stage(steps["toxicity"](spark, docs, DATA), "t1")
    model = toxicity.train(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    rejected = {r.doc_id for r in toxicity.classify(docs, model).where("rejected").collect()}
    before, after = rows(docs), rows(clean)
    assert clean.columns == names and set(after) == set(before) - rejected and all(after[i] == before[i] for i in after)

    # lines
    lines = stage(steps["line_dedup"](spark, clean, DATA), "t2")
    keys = {i: [low(x.strip(" \t\n\x0b\x0c\r")) for x in r.text.split("\n")] for i, r in after.items()}
    count = Counter(k for ks in keys.values() for k in set(ks) if k)
    got = rows(lines)
    assert lines.columns == names and set(got) == set(after)
    for i, r in got.items():
        text = "\n".join(x for x, k in zip(after[i].text.split("\n"), keys[i]) if count[k] < 10)
        assert r.text == text and r.n_chars == len(text)

    # near copies: the smallest id of each group
    single = stage(steps["ngram_jaccard"](spark, lines, DATA), "t3")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, r in got.items() for w in [WORD.findall(low(r.text))]}
    of = {i: i for i in sets}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                of[max(x, y)] = min(x, y)
    kept = rows(single)
    assert single.columns == names and set(kept) == {i for i in ids if root(i) == i} and all(kept[i] == got[i] for i in kept)

    # mix: copies of whole documents, words of a source within half a document of its target
    mix = stage(steps["mix_sources"](spark, single, DATA), "t4")
    assert mix.columns == names
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in kept.values():
        n = len(WORD.findall(r.text))
        size[r.source] += n
        largest[r.source] = max(largest[r.source], n)
    for r in mix.collect():
        taken[r.source] += len(WORD.findall(r.text))
        assert r == kept[r.doc_id]
    target = {r.source: r.target for r in mixing.mix(single).select("row.source", "target").distinct().collect()}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 and taken[s] <= 2 * size[s] for s in size)

    # packing: every token of every row once
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mix.collect():
        want[r.doc_id] += len(model.encode(r.text, add_special_tokens=False).ids) + 1
    out = Counter()
    for r in steps["packing"](spark, mix, DATA).collect():
        out[r.doc_id] += r.length
    assert out == want


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, no id, and columns named like those of the operators, through the stages that return documents."""
    more = [(40 + k, f"Entry {k} of the list says what nobody else has said about item {k * k}.\nA line that all of them share.", "en", "a") for k in range(12)]
    df, _ = tricky(spark, more)
    names = ("score", "threshold", "rejected", "n_lines", "n_dropped", "n_shingles", "component_id")
    df = df.drop(*names).withColumns({c: F.lit(777) for c in names}).withColumn("quality", F.lit(None).cast("string"))
    spark.read.parquet(f"{DATA}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs = df
    for name, step in corpus_pipeline.STAGES[:-1]:
        docs = stage(step(spark, docs, str(tmp_path)), name)
        assert docs.columns == df.columns and docs.dtypes == df.dtypes
        assert docs.count() > 5 and docs.where(" or ".join(f"{c} is null or {c} <> 777" for c in names)).isEmpty()
        if name == "line_dedup":
            assert docs.where("text is null or text like '%all of them%'").isEmpty() and docs.where("text = ''").count() >= 2
            assert docs.where("doc_id is null").count() == 1 and docs.where("n_chars <> char_length(text)").isEmpty()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert pieces and all(p.length > 0 for p in pieces)
    nothing = docs.limit(0)
    for _, step in corpus_pipeline.STAGES:
        nothing = step(spark, nothing, str(tmp_path))
        assert nothing.count() == 0
