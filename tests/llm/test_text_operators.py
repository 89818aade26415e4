"""Line dedup, mixing, token counts, packing, substring dedup, personal data and toxicity against plain Python."""

import hashlib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import TaskContext
from pyspark.sql import functions as F

from ridgelens.llm import line_dedup, mixing, packing, pii, substrings, tokens, toxicity
from ridgelens.llm.words import Words, blocks
from tests.llm.cases import DATA, empty, tricky

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=30), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    got = []
    for i, j, data, at in blocks(pa.array(texts, pa.string()), 20):
        w = Words(data, at)
        for r in range(j - i):
            got.append([data[a:b].tobytes().decode() for a, b in zip(w.starts[w.row_at[r] : w.row_at[r + 1]], w.ends[w.row_at[r] : w.row_at[r + 1]])])
    assert got == [WORD.findall(t) for t in texts]


def test_line_dedup(spark):
    df, rows = tricky(spark)
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.drop_common_lines(df, min_docs=2).collect())
    lines = [(t or "").split("\n") for _, t, _, _ in rows]
    keys = [[low(x.strip(" \t\n\x0b\x0c\r")) for x in part] for part in lines]
    whose = {(k, n if i is None else ("id", i)) for n, ((i, *_), part) in enumerate(zip(rows, keys, strict=True)) for k in part if k}  # rows of one id are one document
    count = Counter(k for k, _ in whose)
    want = Counter()
    for (i, *_), part, ks in zip(rows, lines, keys):
        kept = [x for x, k in zip(part, ks) if count[k] < 2]
        want[(i, "\n".join(kept), len(part), len(part) - len(kept))] += 1
    assert got == want
    assert line_dedup.drop_common_lines(empty(spark)).count() == 0


def test_mixing(spark):
    more = [(100 + k, "w " * (1 + k * k % 97), "en", f"s{k % 7}") for k in range(300)]
    df, rows = tricky(spark, more)
    mixed = mixing.mix(df).cache()
    size = lambda t: len(WORD.findall(t or ""))
    by = defaultdict(int)
    for _, t, _, s in rows:
        by[s] += size(t)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    left, total, target = dict(weight), 1.5 * sum(by.values()), {}
    while left:  # share by weight, fix the full ones, again
        full = [s for s in left if total * left[s] / sum(left.values()) >= 2 * by[s]]
        if not full:
            target |= {s: total * w / sum(left.values()) for s, w in left.items()}
            break
        for s in full:
            target[s] = 2.0 * by[s]
        total -= sum(2.0 * by[s] for s in full)
        left = {s: w for s, w in left.items() if s not in full}
    taken = defaultdict(int)
    got = mixed.select("row.doc_id", "row.text", "row.source", "size", "source_size", "target", "taken").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t, _, _ in rows)
    for r in got:
        assert r["size"] == size(r.text) and r.source_size == by[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    for s in by:
        assert abs(taken[s] - target[s]) <= 1
    again = mixing.mix(df.repartition(5)).select("row.doc_id", "taken").collect()
    assert Counter((r.doc_id, r.taken) for r in again) == Counter((r.doc_id, r.taken) for r in got)
    out = mixing.take(mixed, df)
    assert out.columns == df.columns
    words = defaultdict(int)
    for r in out.collect():
        words[r.source] += size(r.text)
    assert words == {s: n for s, n in taken.items() if n}
    uncut, most = mixing.mix(df, whole=True).select("row.source", "size", "target", "taken").collect(), defaultdict(int)
    taken = defaultdict(int)
    for r in uncut:
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] / 2 + 1 for s in by)
    assert mixing.mix(empty(spark)).count() == 0


def test_mixing_prefers_long_documents_and_takes_whole_copies_first(spark):
    rows = [(k, "w " * (10 if k % 2 else 1000), "en", "a") for k in range(2000)] + [(5000 + k, "w", "en", "b") for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = mixing.mix(df).where("row.source = 'a'").select("size", "taken").collect()
    assert all(r.taken >= r["size"] for r in got)
    more = lambda n: sum(r.taken > n for r in got if r["size"] == n)
    assert more(1000) > more(10) > 0


def test_documents_are_drawn_as_often_as_their_odds_say(spark):
    """300 sources of the same sizes are 300 draws: how often each size is taken follows the odds at the level that gives the words wanted."""
    draws, sizes, share = 300, np.array([1 + (7 * k) % 40 + 60 * (k % 9 == 0) for k in range(60)]), 0.4
    rows = [(s * 1000 + k, f"s{s}", int(n)) for s in range(draws) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, n int").withColumn("text", F.repeat(F.lit("w "), F.col("n")))
    got = mixing.mix(df, weights=(1,), share=share).select((F.col("row.doc_id") % 1000).alias("k"), "size", "taken", "target").collect()
    assert {(r.size, round(r.target, 6)) for r in got} == {(int(n), round(share * sizes.sum(), 6)) for n in sizes}
    often = np.zeros(len(sizes))
    for r in got:
        often[r.k] += r.taken / r.size / draws
    weight, low, high = np.sqrt(sizes / sizes.mean()), 0.0, 1e6
    for _ in range(100):  # the level, by bisection
        level = (low + high) / 2
        low, high = (level, high) if (sizes * level * weight / (1 + level * weight)).sum() < share * sizes.sum() else (low, level)
    odds = level * weight / (1 + level * weight)
    assert np.abs(often - odds).max() < 0.12 and ((often - odds) ** 2 / (odds * (1 - odds) / draws)).mean() < 1.5
    for third in np.array_split(np.argsort(sizes), 3):
        assert abs((often - odds)[third].mean()) < 0.02


def test_token_counts(spark):
    df, rows = tricky(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for chunk, overlap in ((tokens.CHUNK, tokens.OVERLAP), (500, 20)):
        got = Counter(map(tuple, tokens.count_tokens(df, path, chunk=chunk, overlap=overlap, limit=100).collect()))
        want = Counter((i, len((t or "").encode()), n, n > 100) for i, t, _, _ in rows for n in [len(sp.encode(t or ""))])
        assert got == want
    assert tokens.count_tokens(empty(spark), path).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(st.sampled_from("ab é\n  x▁."), max_size=300), st.integers(2, 60), st.integers(1, 30))
def test_resync_is_whole_encoding(text, chunk, overlap):
    e = tokens.encoder(public_tokenizers.path("piece_bpe_32k.model"))
    text = text.replace("▁", "")
    assert tokens.resync(text, e.tokens, chunk, overlap).tolist() == e.ids(text)


def test_packing(spark):
    df, rows = tricky(spark)
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    want = Counter()
    for i, t, _, _ in rows:
        want[(i, np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4").tobytes())] += 1
    got = packing.pack(df, path).collect()
    sequences, ids = defaultdict(list), {i: raw for i, raw in want}
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
        assert (r.doc_id, r.doc_tokens) in {(i, len(raw) // 4) for i, raw in want}
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)])
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == [sum(n for _, n in s[:k]) for k in range(len(s))]
        total = sum(n for _, n in s)
        assert total <= 2048 and total & (total - 1) == 0  # full, or a power of two
    tokens_of = Counter()
    for r in got:
        tokens_of[r.doc_id] += r.length
    assert tokens_of == Counter({i: sum(n * len(raw) // 4 for (j, raw), n in want.items() if j == i) for i, _ in want})
    assert packing.pack(empty(spark), path).count() == 0


def test_words_that_differ_in_case_or_a_stop_are_encoded_once(monkeypatch):
    enc, seen = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json")), []
    inner = enc._encode
    monkeypatch.setattr(enc, "_encode", lambda words: seen.extend(words) or inner(words))
    texts = ["Quorvil, QUORVIL. quorvil Quorvil", "A, b. ,. c,. É, 'S, it's. x.. 3, a,b. ÉA, e.\u0301 AΣ, aΣA. \u212aa, \u0130x.", "$a, a$. <|endoftext|>, ٣a.", "a,", ".", "", None]
    got = [x.tolist() for ids, ends in enc.rows(pa.array(texts, pa.string()), 1) for x in np.split(ids, ends)[:-1]]
    assert got == [enc.model.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    assert sum(w.lower().startswith("quorvil") for w in seen) == 1


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
        key = packing.hilbert(grid, bits)
        assert sorted(key) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


def test_similar_documents_are_packed_together(spark):
    rng = np.random.default_rng(1)
    topics = [[f"{a}{b}" for b in "bcdfgh"] for a in ("sun", "tree", "car", "fish")]
    rows = [(k, " ".join(rng.choice(topics[k % 4], 60))) for k in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id bigint, text string"), public_tokenizers.path("word_bpe_49k.json"))
    near = [r.doc_id % 4 for r in got.orderBy("sequence_id", "offset").collect()]
    assert np.mean(np.array(near[1:]) == np.array(near[:-1])) > 0.8


def test_substring_dedup(spark):
    window, df_rows = 12, tricky(spark)
    df, rows = df_rows
    for period, cover in ((7, (1, 2, 4)), (3, (0, 1))):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, window=window, period=period, cover=cover).collect())
        first: dict = {}
        for i, t, _, _ in rows:
            w = WORD.findall(t or "")
            for k in range(len(w) - window + 1):
                if i is not None:
                    key = tuple(w[k : k + window])
                    first[key] = min(first.get(key, i), i)
        want = Counter()
        for i, t, _, _ in rows:
            w, gone = WORD.findall(t or ""), set()
            for k in range(len(w) - window + 1):
                if i is not None and first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
            want[(i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
        assert got == want
    digest = substrings.remove_repeats(df, window=window, period=7, cover=(1, 2, 4), digest=True)
    assert {r.kept_sha256 for r in digest.collect()} == {hashlib.sha256(r.kept.encode()).hexdigest() for r in substrings.remove_repeats(df, window=window, period=7, cover=(1, 2, 4)).collect()}
    assert substrings.remove_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        substrings.cover_mask(7, (1, 2))


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = {k: [] for k in PATTERNS}
    for k, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if k == "ip" and any(int(x) > 255 for x in m[0].split(".")) or k == "card" and not (13 <= len(d) <= 19 and pii.luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                continue
            out[k].append(m.span())
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("0123456789.@+-() ab"), max_size=40))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_personal_data(spark):
    parts = ["+1 (269) 555-3296", "4111111111111111", "jo.doe@mail.example.com", "10.20.30.40"]
    cards = [c for c in (f"4{k * 7919 % 10**15:015d}" for k in range(1, 800)) if pii.luhn(c)][:40]
    sure = [(100 + k, f"word {c if k % 4 == 1 else f'{p[:-1]}{k % 10}'} end", "en", "a") for k in range(160) for p, c in [(parts[k % 4], cards[k // 4])]]
    df, rows = tricky(spark, [*sure, (900, "call +1 (269) 555-3296 4111111111111111 now", "en", "a"), (901, "size 12 of 1999, 3.5", "en", "a")])
    field = pii.train(df)
    got = {r.doc_id: r for r in pii.find_personal_data(df, field).collect()}
    for i, t, _, _ in rows:
        base = [(k, a, b) for k, spans in plain_spans(t or "").items() for a, b in spans]
        assert [tuple(s) for s in got[i].base] == base and set(base) <= {tuple(s) for s in got[i].spans}
    assert not got[900].base and [tuple(s) for s in got[900].spans] == [("card", 23, 39), ("phone", 5, 22)]
    assert not got[901].spans
    assert pii.find_personal_data(empty(spark), pii.fit([])).count() == 0
    brackets = pii.added_spans(field, "call (269) 555-3297 on 2024-01-15, (2024) 17", pii.base_spans("call (269) 555-3297 on 2024-01-15, (2024) 17"))
    assert brackets == [(3, 5, 19)]
    assert not pii.added_spans(pii.fit([]), "+1 (269) 555-3296 4111111111111111", {k: [] for k in pii.KINDS})


def test_field_sums_and_paths_are_those_of_all_segmentations():
    rng = np.random.default_rng(4)
    m = pii.Field(np.zeros((pii.LABELS, pii.N_FEATURES)), rng.normal(size=(pii.LABELS, pii.LABELS)))

    def ways(n, before=0):  # (segments, label steps) of each segmentation of n words
        if n == 0:
            yield []
        for k in range(min(pii.LONGEST, n)):
            for y in range(pii.LABELS):
                if not (k and y == 0):
                    for rest in ways(n - k - 1, y):
                        yield [(before, k, y), *rest]

    for n in (1, 2, 4):
        s = rng.normal(size=(n, pii.LONGEST, pii.LABELS))
        s[:, 1:, 0] = -np.inf
        p, steps, total, best = np.zeros_like(s), np.zeros_like(m.steps), 0.0, (-np.inf, None)
        for way in ways(n):
            at, score, path = -1, 0.0, []
            for before, k, y in way:
                at += k + 1
                score += m.steps[before, y] + s[at, k, y]
                path += [(at - k, at, y)] if y else []
            best = max(best, (score, path), key=lambda x: x[0])
            weight, at = np.exp(score), -1
            total += weight
            for before, k, y in way:
                at += k + 1
                p[at, k, y] += weight
                steps[before, y] += weight
        got_p, got_steps = pii._marginals(m, s)
        reach = [(j, k) for j in range(n) for k in range(min(pii.LONGEST, j + 1))]
        assert all(np.allclose(got_p[j, k], p[j, k] / total) for j, k in reach) and np.allclose(got_steps, steps / total)
        assert pii.best_path(m, s) == best[1]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("()[].,a1\"'"), max_size=20))
def test_trim_counts_brackets_at_every_step(t):
    a, b = 0, len(t)
    while b > a and (t[b - 1] in ".,;:!?\"'>]}" or (t[b - 1] == ")" and t.count("(", a, b) < t.count(")", a, b))):
        b -= 1
    while a < b and (t[a] in "\"'<[{" or (t[a] == "(" and t.count(")", a, b) < t.count("(", a, b))):
        a += 1
    assert pii.trim(t, 0, len(t)) == (a, b)


def test_sample_of_stretches_does_not_depend_on_the_tasks(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 7)
    rows = [(k, f"no {k * 7919 % 10007}-{k} then {k % 5} and @{k % 50}x") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    one, nine = ([r.s for r in pii.sample(df.repartition(n)).collect()] for n in (1, 9))
    assert one == nine and len(one) == 7


def planted(rng):
    """A sentence with one to three entities side by side in shapes of their own, and their (kind, start, end)."""

    def digits(n):
        return "".join(map(str, rng.integers(0, 10, n)))

    def card():
        d = "4" + digits(int(rng.choice([13, 14, 14, 17])))
        d += next(c for c in "0123456789" if pii.luhn(d + c))
        mark = rng.choice(["", " ", "-"])
        return mark.join(d[i : i + 4] for i in range(0, len(d), 4))

    def phone():
        groups = [digits(int(n)) for n in rng.integers(2, 5, rng.integers(2, 5))]
        while sum(map(len, groups)) < 8:
            groups.append(digits(3))
        return rng.choice([" ", " ", "-"]).join(["+" + rng.choice(["1", "44", "49", "33", "353"]), *groups])

    make = {"email": lambda: rng.choice(["ann", "bo.li", "x_y"]) + digits(2) + "@" + rng.choice(["mail.org", "uni.co.uk"]), "ip": lambda: ".".join(map(str, rng.integers(0, 256, 4))), "card": card, "phone": phone}
    t, gold = "the", set()
    for kind in rng.choice(pii.KINDS, rng.integers(1, 4)):
        entity = make[kind]()
        gold.add((pii.KINDS.index(kind), len(t) + 1, len(t) + 1 + len(entity)))
        t += " " + entity
    return t + " words " + rng.choice(["on 2024-01-15", "12 apples", "at 10:30", "version 3.11.2", "order 883920", "pages 12-19", "costs 19.99"]) + " end.", gold


def test_field_adds_planted_entities_that_the_patterns_merge(spark):
    """Recall of patterns and field on planted entities, and precision of what the field adds."""
    field = pii.train(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    rng, found, base_found, every, added, right = np.random.default_rng(11), 0, 0, 0, 0, 0
    for _ in range(400):
        t, gold = planted(rng)
        base = pii.base_spans(t)
        own = {(k, a, b) for k, kind in enumerate(pii.KINDS) for a, b in base[kind]}
        more = set(pii.added_spans(field, t, base))
        every, found, base_found = every + len(gold), found + len(gold & (own | more)), base_found + len(gold & own)
        added, right = added + len(more), right + len(gold & more)
    assert base_found < 0.85 * every and found >= 0.92 * every and right >= 0.93 * added, (base_found / every, found / every, right / added)
    t = "a@b.co +44 20 7946 0958 10.1.2.3"
    assert pii.added_spans(field, t, pii.base_spans(t)) == [(3, 7, 23)]


def test_regrouped_numbers_keep_their_digits():
    rng = np.random.default_rng(2)
    for s in ("+1 (269) 555-3296", "+44 20 7946 0958", "+442079460958", "4111111111111111", "4111 1111 1111 1111"):
        for _ in range(30):
            other = pii.regrouped(s, rng)
            assert [c for c in other if c.isdigit()] == [c for c in s if c.isdigit()] and (other[0] == "+") == (s[0] == "+")
            assert sum(map(len, pii.base_spans(other).values())) == 1


def test_many_spans_and_brackets_take_no_square_time():
    m = pii.fit([])
    t = " x ".join(f"10.0.{k % 256}.{k // 256}" for k in range(20000)) + " 1" + ")" * 100000
    began = time.perf_counter()
    assert not pii.added_spans(m, t, pii.base_spans(t)) and time.perf_counter() - began < 10


def test_toxicity_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(docs, labels)
    got = toxicity.classify(docs, model, keep=["doc_id"]).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1).select("toxic", "score", "rejected").collect()
    toxic, clean = [r for r in got if r.toxic], [r for r in got if not r.toxic]
    assert sum(r.score >= 0.7 for r in toxic) > 0.8 * len(toxic) and sum(r.score < 0.7 for r in clean) > 0.97 * len(clean)
    assert sum(r.rejected for r in clean) < 0.03 * len(clean)
    order = sorted(got, key=lambda r: r.score)
    ranks = [k for k, r in enumerate(order, 1) if r.toxic]
    area = (sum(ranks) - len(toxic) * (len(toxic) + 1) / 2) / len(toxic) / len(clean)
    assert area > 0.95


def test_toxicity_cases(spark):
    labels = spark.createDataFrame([(k, 0, k % 2) for k in range(2, 13)], "doc_id bigint, quality int, toxic int")
    df, rows = tricky(spark)
    model = toxicity.train(df, labels)
    out = toxicity.classify(df, model)
    got = out.collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert set(df.columns) | {"score", "threshold", "rejected"} == set(out.columns)
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] == scores[2] == scores[3]  # null, empty, blank
    changed = toxicity.classify(df.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")), model).collect()
    assert {r.doc_id: r.score for r in changed} == scores
    assert toxicity.classify(empty(spark), toxicity.train(empty(spark), labels)).count() == 0


def test_toxicity_cuts_cover_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(900):
        y = int(rng.random() < 0.12)
        odd = rng.random() < (0.6 if y else 0.1)
        words = [f"w{rng.integers(60)}" for _ in range(20)] + [f"bad{rng.integers(4)}" if odd else "w"] * int(rng.integers(1, 3))
        rows.append((k, " ".join(words * (9 if k % 5 == 0 else 1)), ("en", "de", None)[k % 3], y))
    rows += [(2000 + k, "bad1 bad2 w1", "fr", 1 - k % 2) for k in range(20)]  # too few for a cut of their own
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int").repartition(3)
    for name, most in (("TRAIN_TOXIC", 30), ("TRAIN_CLEAN", 30), ("TRAIN_CHARS", 300)):
        monkeypatch.setattr(toxicity, name, most)
    model = toxicity.train(df.drop("toxic"), df.select("doc_id", "toxic"))
    check = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 2]
    p = toxicity.scores(model, pa.array([r[1] for r in check], pa.string()))

    def good(cut, some):  # the F-measure that weighs precision twice
        told, y = [p[k] >= cut for k in some], [check[k][3] for k in some]
        return 1.25 * sum(a and b for a, b in zip(told, y)) / (sum(told) + 0.25 * sum(y))

    assert set(model.thresholds) == {"en", "de"}
    for cut, lang in ((model.threshold, None), *((c, x) for x, c in model.thresholds.items())):
        some = [k for k, r in enumerate(check) if lang in (None, r[2])]
        assert good(cut, some) > max(good(c, some) for c in p[some]) - 0.005


def test_toxicity_sample_is_found_in_parallel(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "_set_cuts", lambda *_: None)
    rows, tasks = [(k, f"w{k % 7} w{k % 3}", k % 2) for k in range(60)], spark.sparkContext.accumulator(0)

    def seen(batches):
        tasks.add(1 if TaskContext.get().partitionId() else 0)
        yield from batches

    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int").repartition(4)
    toxicity.train(df.drop("toxic").mapInArrow(seen, "doc_id bigint, text string"), df.select("doc_id", "toxic"))
    assert tasks.value == 3  # of four tasks, all but the first


def test_line_dedup_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    for name, module in (("line", line_dedup), ("mix", mixing)):
        got = module.query(spark, DATA)
        result = c.execute(module.SQL)
        columns = [d[0] for d in result.description]
        assert sorted(map(tuple, got.select(columns).collect())) == sorted(result.fetchall()), name
