"""The Jaccard join, components, image copies and nearest neighbours against brute force."""

import random
import re
import sys
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgelens.llm import common, images, jaccard, neighbours
from ridgelens.llm.components import components
from ridgelens.llm.filters import build_filter, passes
from ridgelens.llm.words import U64
from tests.llm.cases import empty, tricky

WORD = re.compile(r"[^\x20\x09-\x0D]+")


class Sets:
    def __init__(self, ids):
        self.of = {i: i for i in ids}

    def root(self, x):
        while self.of[x] != x:
            x = self.of[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.of[max(a, b)] = min(a, b)


def brute(rows, k, percent):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    sets = []
    for i, t in rows:
        w = WORD.findall(low(t or ""))
        sets.append((i, {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    s = Sets({i for i, _ in rows if i is not None})
    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= percent * len(x | y):
                s.join(i, j)
    return sorted(((i, len(x), None if i is None else s.root(i)) for i, x in sets), key=str)


def family(rng, base, copies, start):
    """Near copies of a text with up to a quarter of words changed, on both sides of the threshold."""
    words, out = base.split(), []
    for c in range(copies):
        w = list(words)
        for _ in range(rng.randrange(0, max(2, len(w) // 12))):
            w[rng.randrange(len(w))] = f"z{rng.randrange(10**6)}"
        out.append((start + c, " ".join(w).title() if c % 3 == 0 else " ".join(w), "en", "a"))
    return out


@pytest.mark.parametrize(("shingle", "percent"), [(4, 85), (5, 80), (2, 50), (3, 100)])
def test_jaccard(spark, monkeypatch, shingle, percent):
    rng = random.Random(percent)
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 8)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    more = [r for k, n in enumerate((3, 6, 9, 14, 25, 60, 130, 400)) for r in family(rng, text(n), 12, 1000 * (k + 1))]
    df, rows = tricky(spark, more)
    got = sorted((tuple(r) for r in jaccard.near_duplicates(df, shingle=shingle, percent=percent).collect()), key=str)
    assert got == brute([(i, t) for i, t, _, _ in rows], shingle, percent)
    if percent == 85:
        assert jaccard.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_schemes_find_every_link(percent):
    """Pairs at the threshold always share a key that neither leaves out, whatever the sizes."""
    rng, s = np.random.default_rng(percent), jaccard.Scheme(percent)
    for n in [*range(1, 40), 61, 62, 92, 93, 139, 140, 141, 209, 210, 473, 900]:
        for _ in range(6):
            m = int(rng.integers(-(-percent * n // 100), n + 1))
            both = -(-percent * (n + m) // (100 + percent))
            if both > m:
                continue
            pool = rng.integers(0, 2**63, n + m, dtype=np.uint64) * U64(2) + rng.integers(0, 2, n + m, dtype=np.uint64)
            a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], pool[n : n + m - both]]))
            keys = []
            for x in (a, b):
                own = set()
                for k, _, d in s.keys(x, np.array([len(x)])):
                    own |= set(k[int(d[0]) :].tolist())  # with all it may leave out left out
                keys.append(own)
            assert keys[0] & keys[1], (n, m)


def test_bitmaps_leave_out_no_link():
    rng = np.random.default_rng(4)
    pool = rng.integers(0, 2**63, 900, dtype=np.uint64) * U64(2)
    sets = [np.unique(rng.choice(pool, n, replace=False)) for n in (1, 2, 7, 8, 9, 40, 700, 720, 800, 900, 890, 870)] + [np.unique(pool[: 600 + k]) for k in range(0, 300, 40)]
    ids, sizes = np.arange(len(sets)), np.array([len(x) for x in sets])
    for left in (None, ids % 2 == 0):
        s, t = Sets(ids.tolist()), Sets(ids.tolist())
        for a, b in jaccard.forest(ids, sets, 80, left):
            s.join(int(a), int(b))
        for a, b in jaccard.may_link(ids, sizes, [jaccard.bitmap(x) for x in sets], 80, left):
            t.join(int(a), int(b))
        assert all(t.root(k) == t.root(s.root(k)) for k in ids.tolist())
    far = [np.unique(rng.integers(0, 2**63, 300, dtype=np.uint64)) for _ in range(20)]
    assert jaccard.may_link(np.arange(20), np.full(20, 300), [jaccard.bitmap(x) for x in far], 80) == []


@pytest.mark.parametrize("block", [2, 5, 512])
def test_large_and_loose_clusters(spark, monkeypatch, block):
    """A template with very many near copies, and a chain of texts that share passages."""
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", block)
    rng = random.Random(block)
    base = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(40):
        w = list(base)
        w[rng.randrange(120)] = f"z{k}"
        rows.append((k, " ".join(w)))
    for k in range(40):
        rows.append((100 + k, " ".join([f"p{k}_{j}" for j in range(30)] + [f"p{k + 1}_{j}" for j in range(30)])))
    rows += [(200 + k, rows[60][1] + " end" * k) for k in range(3)]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == brute(rows, 5, 80)


def test_clusters_meet_a_row_for_each_document(spark, monkeypatch):
    """Not one for each key that it shares with others: those of loose clusters alone are looked at."""
    rng, calls, inner = random.Random(8), [], jaccard.join_hot
    monkeypatch.setattr(jaccard, "BLOCK_DOCS", 2)

    def counted(many, few, on, *a):
        if on == ["label"]:
            calls.append([r.id for r in many.select("id").collect()])
        return inner(many, few, on, *a)

    monkeypatch.setattr(jaccard, "join_hot", counted)
    rows = [r[:2] for k in range(4) for r in family(rng, " ".join(f"w{rng.randrange(3000)}" for _ in range(150)), 9, 100 * k)]
    got = sorted((tuple(r) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()), key=str)
    assert got == brute(rows, 5, 80)
    assert calls and all(len(ids) == len(set(ids)) for ids in calls)


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7), (500, 900), (900, 500), (None, 3)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    s = Sets({x for p in links for x in p if x is not None and None not in p and p[0] != p[1]})
    for a, b in links:
        if a is not None and b is not None and a != b:
            s.join(a, b)
    assert got == {x: s.root(x) for x in s.of}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(sys.modules["ridgelens.llm.components"], "FEW", 0)
    monkeypatch.setattr(common, "HOT", 8)
    monkeypatch.setattr(common, "SMALL", 10)
    many = spark.range(1000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    few = many.where("k % 2 = 0").groupBy("k").agg(F.min("id").alias("lo"), F.count("*").alias("c"))
    for how in ("inner", "left", "left_semi"):
        got, want = common.join_hot(many, few, ["k"], "c", how), many.join(few.drop("c"), ["k"], how)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    links = [(0, k) for k in range(1, 400)] + [(1000 - k, 900 - k) for k in range(50)]
    got = {r.id: r.label for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert all(got[k] == 0 for k in range(400)) and all(got[1000 - k] == 900 - k for k in range(50))


def test_components_of_few_links_in_one_task(spark):
    rng = np.random.default_rng(3)
    for rows in ([], [(5, 5), (None, 2)], [(k, k + 1) for k in range(-50, 500)], [(int(a), int(b)) for a, b in rng.integers(0, 900, (500, 2))]):
        links = spark.createDataFrame(rows, "a bigint, b bigint")
        want = {x: x for a, b in rows if a is not None and a != b for x in (a, b)}
        for _ in want:
            before = dict(want)
            for a, b in rows:
                if a in want and b in want:
                    want[a] = want[b] = min(want[a], want[b])
            if before == want:
                break
        assert {r.id: r.label for r in components(links).collect()} == want


def test_filter(spark):
    rng = np.random.default_rng(0)
    h = rng.integers(-(2**63), 2**63 - 1, 5000)
    table = build_filter(spark.createDataFrame([(int(x),) for x in h[:2500]] + [(None,)], "h bigint"), "h").value
    ok = passes(table, h.view(U64))
    assert ok[:2500].all() and ok[2500:].mean() < 0.01


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[300:340] = x[7]  # many equal vectors
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x)] + [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None, *[1.0] * 15], 1), (2004, [1.0] * 3, 1), (None, [1.0] * 16, 1), (5, [float(v) for v in x[5]], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score int")
    got = defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    y = x.astype(float)
    n = np.sqrt((y * y).sum(1))
    found = total = 0
    for q in range(0, 900, 50):
        s = (y * y[q]).sum(1) / (n * n[q])
        s[q] = -9
        best = np.lexsort((np.arange(900), -s))[:5]
        assert len(got[q]) == 5 and all(score == pytest.approx(s[i], abs=1e-14) for i, score in got[q])
        assert [i for i, _ in got[q]] == sorted((i for i, _ in got[q]), key=lambda i: (-s[i], i))
        found, total = found + len({i for i, _ in got[q]} & set(best.tolist())), total + 5
    assert set(got) == set(range(0, 900, 50)) and found / total >= 0.9
    assert [i for i, _ in got[300]] == [7, 301, 302, 303, 304]
    few = neighbours.nearest(df.where("vec_id in (0, 1, 2)")).collect()
    assert [r["rank"] for r in few] == [1, 2]
    assert neighbours.nearest(df.where("false")).count() == 0


def test_traverse_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    sums = [a[i] + b[j] for i, j in neighbours.traverse(a, b)]
    assert sums == sorted(sums) and len(sums) == 35


ODD = "media_id bigint, pixels binary, height int, width int"


def test_image_copies(spark):
    """Recall of each kind of edit, and odd images."""
    vectors = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").where("vec_id < 240")
    media = images.rendered(vectors)
    odd = spark.createDataFrame([(10_001, None, 4, 4), (10_002, b"", 0, 0), (10_003, b"abc", 2, 2), (10_004, bytes(64 * 64), 64, 64), (10_005, bytes(64 * 64), 64, 64), (None, bytes(64 * 64), 64, 64), (10_006, b"abcd", -2, -2)], ODD)
    got = images.find_copies(media.unionByName(odd).withColumn("id", F.lit(1)).withColumn("x", F.lit("c"))).collect()
    group = {r.media_id: r.copy_group for r in got}
    assert len(got) == media.count() + 7
    first: dict = {}
    same = {r.vec_id: first.setdefault(tuple(r.embedding), r.vec_id) for r in vectors.orderBy("vec_id").collect()}
    copies = [(m, 2 * same[m // 2]) for m in group if m is not None and m < 10_000]
    for kind in range(1, 6):
        own = [group[m] == want for m, want in copies if m % 2 and m // 2 % 6 == kind]
        assert len(own) > 20 and np.mean(own) >= 0.97
    for half in (0, 1):  # 7/8 and 3/4 of the size
        own = [group[m] == want for m, want in copies if m % 2 and m // 2 % 6 == 5 and m // 2 // 6 % 2 == half]
        assert len(own) > 10 and np.mean(own) >= 0.95
    assert all(group[m] >= want for m, want in copies)  # never with another picture
    assert (group[10_001], group[10_002], group[10_003], group[10_004], group[10_005], group[10_006], group[None]) == (10_001, 10_002, 10_003, 10_004, 10_004, 10_006, None)
    assert images.find_copies(odd.where("false")).count() == 0


def all_pairs(found):
    """Groups of images by comparing all corners of all pairs; found: corners by id."""
    groups = Sets(found)
    for a in found:
        for b in found:
            if a < b and len(found[a]) and len(found[b]):
                wa, wb = found[a]["words"], found[b]["words"]
                near = (np.bitwise_count(wa[:, None] ^ wb[None]).sum(2) <= images.NEAR) & (wa[:, None] == wb[None]).any(2)
                say = defaultdict(set)
                for i, j in zip(*np.nonzero(near), strict=True):
                    p, q = found[a][i], found[b][j]
                    turned, ratio = (int(p["turn"]) - int(q["turn"])) % images.TURNS, int(p["scale"]) / int(q["scale"])
                    t, x, y = turned * 2 * np.pi / images.TURNS, q["x"] / 4, q["y"] / 4
                    dx, dy = p["x"] / 4 - (x * np.cos(t) - y * np.sin(t)) / ratio, p["y"] / 4 - (x * np.sin(t) + y * np.cos(t)) / ratio
                    for u in (0, 1):
                        for v in (0, 1):
                            for w in (0, 1):
                                say[ratio, u, v, w, (turned + 2 * u) // 4 % 8, (dx + 3 * v) // 6, (dy + 3 * w) // 6].add((x, y))
                if any(len(x) >= images.AGREE for x in say.values()):
                    groups.join(a, b)
    return {k: groups.root(k) for k in found}


def smoother(image):
    x = np.pad(image.astype(float), 1, mode="edge")
    x = (x[:-2] + 2 * x[1:-1] + x[2:]) / 4
    return (x[:, :-2] + 2 * x[:, 1:-1] + x[:, 2:]) / 4


@pytest.mark.parametrize("by", ["linear", "smoothed"])
@pytest.mark.parametrize(("side", "kind"), [(80, 1), (80, 2), (80, 3), (80, 4), (80, 5), (80, 11), (160, 5), (160, 11)])
def test_tables_lose_few_of_the_copies_that_all_pairs_of_corners_find(monkeypatch, side, kind, by):
    """Without any condition on words: all corners that differ in NEAR bits at most are votes.

    Of 200 copies smoothed and shrunk from 80 to 60 pixels, a listed edit only without the smoothing, the tables find 0.90
    and all pairs 0.955.
    """
    monkeypatch.setattr(images, "SIDE", side)
    tables, every = 0, 0
    for k in range(30):
        image = images.texture([float(k), 7.0])
        found, copy = (images.describe(x[None])[0] for x in (image, np.ascontiguousarray(images.edited(smoother(image) if by == "smoothed" and kind in (5, 11) else image, kind))))
        near = np.bitwise_count(found["words"][:, None] ^ copy["words"][None]).sum(2) <= images.NEAR
        same = (found["words"][:, None] == copy["words"][None]).any(2)
        votes = []
        for meet in (near & same, near):
            i, j = np.nonzero(meet)
            votes.append(len(images._agree(np.stack([np.zeros(len(i), np.int64), np.ones(len(i), np.int64), images._packed(found)[i], images._packed(copy)[j]], 1))))
        tables, every = tables + votes[0], every + votes[1]
    assert tables >= (0.95 if by == "linear" else 0.85) * 30 and tables >= 0.9 * every, (tables, every)


@pytest.mark.parametrize("crowd", [images.CROWD, 2])
def test_image_groups_are_those_of_all_pairs(spark, monkeypatch, crowd):
    for name, value in (("CROWD", crowd), ("BLOCK", 8), ("LEAST", 6), ("HOT", 10**6)):
        monkeypatch.setattr(images, name, value)
    pictures = {}
    for k in range(16):
        image = images.texture([float(k // 2 * (k % 4 > 0))])  # some pictures many times
        if k % 3 == 0:
            image = image.copy()
            image[20:60, 20:60] = images.texture([99.0])[20:60, 20:60]  # a motif that links unlike pictures
        pictures[2 * k], pictures[2 * k + 1] = image, images.edited(image, k)
    rows = [(k, np.ascontiguousarray(p).tobytes(), *p.shape) for k, p in pictures.items()]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.media_id: r.copy_group for r in images.find_copies(spark.createDataFrame(rows, ODD)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = all_pairs({k: images.describe(p[None])[0] for k, p in pictures.items()})
    assert got == want and 2 < len(set(want.values())) < len(want)


def planted(spark, monkeypatch, corners):
    """The groups of images whose corners are given: rows (x, y, words) of each image's id."""

    def describe(px):
        out = []
        for image in px:
            found = corners[int(image[0, 0])]
            c = np.zeros(len(found), images.CORNER)
            c["x"], c["y"], c["scale"], c["words"] = [round(4 * x) for x, _, _ in found], [round(4 * y) for _, y, _ in found], 8, [w for _, _, w in found]
            out.append(c)
        return out

    monkeypatch.setattr(images, "describe", describe)
    media = spark.createDataFrame([(k, bytes([k] * 4), 2, 2) for k in corners], "media_id bigint, pixels binary, height int, width int").repartition(1)
    return {r.media_id: r.copy_group for r in images.find_copies(media).collect()}


@pytest.mark.parametrize(("crowd", "block", "least"), [(images.CROWD, images.BLOCK, images.LEAST), (5, 4, 6)])
def test_copies_meet_in_crowded_entries(spark, monkeypatch, crowd, block, least):
    for name, value in (("CROWD", crowd), ("BLOCK", block), ("LEAST", least), ("HOT", 10**6)):
        monkeypatch.setattr(images, name, value)
    rng = np.random.default_rng(2)
    word = lambda: int(rng.integers(1 << 32))
    motif = [[word()] + [0] * 3 for _ in range(4)]
    far = lambda w: [w[0], *[word() for _ in range(3)]]
    corners = {k: [(10.0 * rng.integers(9), 10.0 * rng.integers(9), far(w)) for w in motif] for k in range(30)}
    true = [(12.0 * k, 7.0 * k, w) for k, w in enumerate(far(w) for w in motif)]
    # copies that meet only in entries that unrelated images fill and lead
    corners |= {40: true, 50: [(x, y, [w[0], *[v ^ 1 for v in w[1:]]]) for x, y, w in true]}
    assert planted(spark, monkeypatch, corners) == {**{k: k for k in range(30)}, 40: 40, 50: 40}


@pytest.mark.parametrize("block", [images.BLOCK, 7])
def test_chance_matches_in_crowded_entries_are_not_written(spark, monkeypatch, block):
    """One corner that very many unrelated images share gives a match for each pair of them: counted, not returned."""
    monkeypatch.setattr(images, "BLOCK", block)
    frame, made = type(spark.range(0)), []
    inner = frame.mapInArrow

    def counted(self, f, *a, **b):
        out = inner(self, f, *a, **b)
        if f.__name__ == "across":
            made.append({(r.a, r.b) for r in out.select("a", "b").collect()})
        return out

    monkeypatch.setattr(frame, "mapInArrow", counted)
    rng = np.random.default_rng(5)
    word = lambda: int(rng.integers(1 << 32))
    motif, common = [[word()] + [0] * 3 for _ in range(4)], [word() for _ in range(4)]
    far = lambda w: [w[0], *[word() for _ in range(3)]]
    place = lambda: (10.0 * rng.integers(9), 10.0 * rng.integers(9))
    corners = {k: [(*place(), common), *[(*place(), far(w)) for w in motif]] for k in range(60)}
    true = [(12.0 * k, 7.0 * k, w) for k, w in enumerate(far(w) for w in motif)]
    # these link by one corner that all share, two in crowded entries and one in an entry of their own
    alone = [word() for _ in range(4)]
    both = [*true[:2], (80.0, 10.0, common), (10.0, 80.0, alone)]
    corners |= {70: true, 80: [(x, y, [w[0], *[v ^ 1 for v in w[1:]]]) for x, y, w in true], 90: both, 95: [(x, y, w if w in (common, alone) else [w[0], *[v ^ 2 for v in w[1:]]]) for x, y, w in both]}
    got = planted(spark, monkeypatch, corners)
    assert got == {**{k: k for k in range(60)}, 70: 70, 80: 70, 90: 90, 95: 90}
    assert len(made) == 1 and {(70, 80), (90, 95)} <= made[0] and len(made[0]) < 20


def test_pairs_that_match_often_pass():
    rng = np.random.default_rng(6)
    pairs = rng.integers(0, 300, (4000, 2))
    for slots in (1 << 16, 1 << 20):
        parts = [next(images._tallied([pairs[k : k + 500], pairs[k + 500 : k + 1000]], slots)) for k in range(0, 4000, 1000)]
        sums = np.zeros((images.PARTS, slots // images.PARTS), int)
        for b in parts:
            for part, raw in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), strict=True):
                sums[part] += np.frombuffer(zlib.decompress(raw), np.uint8)
        ok = images._often(np.packbits(sums >= images.AGREE, axis=1), pairs)
        _, at, n = np.unique(pairs, axis=0, return_inverse=True, return_counts=True)
        assert ok[n[at] >= images.AGREE].all() and ok.mean() < 0.2


def test_small_crops_of_large_images(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(6):
        grain = rng.normal(size=(1, 320, 320))
        image = np.clip(128 + 40 * (images._box(grain, 1) / 3 + images._box(grain, 3) / 7)[0], 0, 255).astype(np.uint8)
        y, x = rng.integers(0, 240, 2)
        crop = image[y : y + 80, x : x + 80]
        rows += [(10 * k, image.tobytes(), 320, 320), (10 * k + 1, crop.tobytes(), 80, 80)]
    media = spark.createDataFrame(rows, "media_id bigint, pixels binary, height int, width int")
    got = {r.media_id: r for r in images.find_copies(media).collect()}
    assert {k: r.copy_group for k, r in got.items()} == {k: k // 10 * 10 for k in got}
    assert all(got[10 * k].n_corners > 8 * got[10 * k + 1].n_corners for k in range(6))
