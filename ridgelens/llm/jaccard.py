"""N-gram Jaccard join by universe partition: documents whose word shingles overlap, and their components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelens.llm.common import documents, drop_stage, join_hot, stage
from ridgelens.llm.components import components
from ridgelens.llm.filters import build_filter, passes
from ridgelens.llm.words import U64, Words, blocks, mix

SHINGLE, PERCENT = 5, 80
#: Documents, and shingles, of a block that one task compares with another.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 500_000
#: Prices, in keys sent: of a segment with at most one shingle; of a segment in which two sets agree because all their
#: shingles there come from one shared passage of PASSAGE shingles.
WEAK, AGREED, PASSAGE = 40.0, 300.0, 60
#: Keys of more documents than this are the ones that a set leaves out first.
BUSY = 6
#: Bits for each shingle of a document's bitmap.
MAP_BITS = 4


class Scheme:
    """How sets are cut into segments, by size band.

    Two sets of a and b shingles link only if they differ in at most D(a + b) of them (in one but not the other).  In
    the scheme of a band, which all pairs use whose larger set is in the band, shingles are hashed to e exact segments
    and g near ones.  If neither any exact segment is equal nor any near one equal up to one shingle, the sets differ
    by e + 2g at least.  A set may leave out d exact segments of its choice; both sets together 2d.  So
    e + 2g >= D + 1 + 2d finds every link.  And where e is made for pairs of the band's largest sets, a smaller set may leave
    out as many more as its size makes D smaller: D is at most (100 - p) / (100 + p) times a + b, the sum of two such parts.
    """

    def __init__(self, percent: int):
        self.percent, self.share = percent, (100 - percent) / (100 + percent)
        self.lows = [1]
        while self.lows[-1] < 1 << 40:
            self.lows.append(max(self.lows[-1] + 1, math.ceil(1.5 * self.lows[-1])))
        self.least = np.array([-(-percent * x // 100) for x in self.lows])  # the smallest partner of a band's sets
        self.table = np.zeros((len(self.lows), 3), np.int64)
        self.known = 0

    def differ(self, total: int) -> int:
        """How many shingles two linked sets of `total` shingles together may not share."""
        return total - 2 * -(-self.percent * total // (100 + self.percent))

    def allocate(self, band: int) -> tuple[int, int, int]:
        """(e, g, d) of the least cost: keys sent for a set, and segments that tell sets apart badly at their price.

        A near segment of t shingles sends itself and its t one-deletion neighbours.  It pays for small sets, of which a
        shared passage is a large part: half as many segments hold twice the shingles.
        """
        low, high = self.lows[band], self.lows[band + 1] - 1
        most = max(self.differ(2 * high), self.differ(2 * high - 1), 0) + 1
        size = math.sqrt(low * high)
        own = 1 - min(1.0, PASSAGE / size)
        agree = lambda n: AGREED * n * math.exp(-2 * own * size / n)
        weak = lambda n: n * math.exp(-size / n) * (1 + size / n)
        top = math.ceil(self.share * 2 * high) + 1
        d = min(range(max(1, top // 8)), key=lambda d: top + 2 * d + WEAK * max(0.0, weak(top + 2 * d) - d))
        e, g = top + 2 * d, -(-most // 2)
        return (e, 0, d) if e + agree(e) <= g + size + agree(g) else (0, g, 0)

    def bands(self, sizes: np.ndarray) -> np.ndarray:
        band = np.searchsorted(self.lows, sizes, "right") - 1
        top = int(band.max(initial=0)) + 2 + int(math.log(100 / self.percent) / math.log(1.5))  # partners reach so many bands
        while self.known <= top:
            self.table[self.known] = self.allocate(self.known)
            self.known += 1
        return band

    def keys(self, tokens: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, rows, how many a row may leave out besides) of sets laid end to end, for each band of their pairs.

        Exact segments of a row come with those of the fewest shingles first, which most sets share, but for the ones
        that the row leaves out because it is small.
        """
        own = self.bands(sizes)
        row = np.repeat(np.arange(len(sizes)), sizes)
        highs = np.array(self.lows[1 : self.known + 1]) - 1
        for ahead in range(len(self.lows)):
            band = own + ahead
            use = (sizes > 0) & ((sizes >= self.least[band]) if ahead else True)
            if not use.any():
                return
            e, g, d = self.table[band].T
            m = np.where(use, e + g, 0)
            base = np.concatenate([[0], np.cumsum(m)])
            keep = use[row]
            tok, r = tokens[keep], row[keep]
            seg = base[r] + (((tok >> U64(32)) * m[r].astype(U64)) >> U64(32)).astype(np.int64)
            owner = np.repeat(np.arange(len(sizes)), m)
            salt = mix((band[owner].astype(U64) << U64(40)) + (np.arange(base[-1]) - base[owner]).astype(U64))
            sums = np.zeros(base[-1], U64)
            np.add.at(sums, seg, tok)
            spare = np.where(e > 0, np.floor(self.share * (highs[np.minimum(band, len(highs) - 1)] - sizes) - 1e-9), 0).clip(0).astype(np.int64)
            order = np.lexsort((np.bincount(seg, minlength=base[-1]), owner))
            order = order[np.arange(base[-1]) - base[owner] >= spare[owner]]
            yield mix(sums[order] ^ salt[order]), owner[order], d
            near = (g > 0)[r]
            if near.any():
                yield mix((sums[seg[near]] - tok[near]) ^ salt[seg[near]]), r[near], np.zeros_like(d)


@cache
def scheme(percent: int) -> Scheme:
    return Scheme(percent)


def shingle_sets(w: Words, rows: int, k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each row as sorted hashes; of fewer words, all of them as one."""
    h = w.windows(k)
    out = []
    for r in range(rows):
        a, b = w.row_at[r], w.row_at[r + 1]
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            whole = np.array([b - a], U64)
            for x in w.hashes[a:b]:
                whole = mix(whole * U64(0x9E3779B97F4A7C15) + x)
            out.append(whole)
        else:
            out.append(np.zeros(0, U64))
    return out


def forest(ids: np.ndarray, sets: list[np.ndarray], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links enough to connect what links connect: all pairs of a block are compared, exactly.

    left: only pairs between the marked and the others (pairs of two blocks).  Shared shingles are counted by products
    of 0/1 matrices over the shingles that at least two sets hold.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets])
    if m < 2:
        return []
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if ids[0] != ids[1] and 100 * both >= percent * (sizes.sum() - both) else []
    tokens, row = np.concatenate(sets), np.repeat(np.arange(m), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, row = tokens[order], row[order]
    start = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    count = np.diff(np.append(start, len(tokens)))
    col = np.repeat(np.cumsum(count > 1) - 1, count)
    keep = np.repeat(count > 1, count)
    col, row = col[keep], row[keep]
    shared = np.zeros((m, m), np.float32)
    step = 4096
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, step):
        a, b = np.searchsorted(col, [c, c + step])
        part = np.zeros((m, min(step, int(col[-1]) + 1 - c)), np.float32)
        part[row[a:b], col[a:b] - c] = 1
        shared += part @ part.T
    both = shared.astype(np.int64)
    return _tree(ids, 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both), left)


def bitmap(items: np.ndarray) -> bytes:
    """A bit for each shingle in a power of two of at least MAP_BITS a shingle."""
    bits = max(64, 1 << (MAP_BITS * len(items) - 1).bit_length())
    flags = np.zeros(bits, bool)
    flags[(items & U64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def _folded(maps: list[bytes], size: int) -> np.ndarray:
    """Bitmaps brought to `size` bytes: halves of larger ones are laid over each other."""
    out = np.empty((len(maps), size), np.uint8)
    for k, x in enumerate(maps):
        np.bitwise_or.reduce(np.frombuffer(x, np.uint8).reshape(-1, size), axis=0, out=out[k])
    return out


def may_link(ids: np.ndarray, sizes: np.ndarray, maps: list[bytes], percent: int, left: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that connect what pairs of a block connect whose bitmaps allow a link; none that links is left out.

    Shared shingles are at most the shared bits and the shingles of the one set, or the other, that found their bit taken.
    """
    m, length = len(maps), np.array([len(x) for x in maps])
    link = np.zeros((m, m), bool)
    for size in np.unique(length).tolist():
        rows = np.flatnonzero(length >= size)
        own = np.flatnonzero(length[rows] == size)
        flat = _folded([maps[k] for k in rows], size)
        shared = np.zeros((len(own), len(rows)), np.float32)
        for c in range(0, size, 1024):
            part = np.unpackbits(flat[:, c : c + 1024], axis=1).astype(np.float32)
            shared += part[own] @ part.T
        spare = sizes[rows] - np.bitwise_count(flat).sum(1, dtype=np.int64)
        most = shared.astype(np.int64) + np.minimum(spare[own][:, None], spare[None, :])
        ok = (100 + percent) * most >= percent * (sizes[rows][own][:, None] + sizes[rows][None, :])
        link[np.ix_(rows[own], rows)] |= ok
        link[np.ix_(rows, rows[own])] |= ok.T
    return _tree(ids, link, left)


def _tree(ids: np.ndarray, link: np.ndarray, left: np.ndarray | None) -> list[tuple[int, int]]:
    """Links enough to connect what all of a matrix of links connect; left: only those between the marked and the others."""
    m, link = len(ids), np.triu(link, 1)
    if left is not None:
        link &= left[:, None] != left[None, :]
    parent = np.arange(m)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(link), strict=True):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            if ids[x] != ids[y]:
                out.append((ids[x], ids[y]))
    return out


def near_duplicates(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """id_col, n_shingles, component_id: documents link where 100 * shared shingles >= percent * shingles of either.

    1. Every set sends the keys of its segments (Scheme).  Keys of several documents, found with partial minima and
       maxima, go to a filter of fixed size; each document then keeps those of its keys that pass, but for some of
       those that very many documents send.
    2. Documents of equal sets stand for one.  Keys tie the rest to clusters.  A loose cluster, in which comparing the
       documents of each key is less work than comparing all, is first looked at key by key through bitmaps of MAP_BITS
       a shingle, which bound what two sets may share; what these still tie together is a cluster of its own.
    3. Clusters are compared exactly, with sets made anew from the texts.  A cluster of more than a block is first compared with
       its smallest id alone; of those that link with it no two need be compared, so only the others go on, in blocks
       of bounded size, against the whole group.  A template of very many near copies is linear work.
    4. The links found connect what all links connect; their components, by alternating stars, give the smallest id.

    Words end at blanks, A-Z are lower-cased.  A shingle is known by a 64-bit hash.  Fewer words than `shingle`: the
    whole sequence is the one shingle; none, or null text: an empty set, linked with nothing.  Null id: its own row,
    component null, no links.  Rows with equal ids are one document, with the links of either.  Empty table: empty.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))

    def sets_of(batch):
        for i, j, data, at in blocks(batch.column("body")):
            yield i, j, shingle_sets(Words(data, at, lower=True), j - i, shingle)

    def send(batches):
        s = scheme(percent)
        for b in batches:
            ids, known = b.column("id").fill_null(0).to_numpy(), b.column("id").is_valid().to_numpy(zero_copy_only=False)
            for i, j, sets in sets_of(b):
                sizes = np.array([len(x) for x in sets]) * known[i:j]
                tokens = np.concatenate([x for x, n in zip(sets, sizes, strict=True) if n] or [np.zeros(0, U64)])
                for keys, row, _ in s.keys(tokens, sizes):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids[i + row])], names=["h", "id"])

    several = base.mapInArrow(send, "h bigint, id bigint").groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).where(F.col("lo") < F.col("hi"))
    several = stage(several.select("h", (F.col("c") > BUSY).alias("busy")), "keys")
    bits, busy = build_filter(several, "h"), build_filter(several.where("busy"), "h")

    def chosen(s, tokens, sizes):
        """(keys, rows) that other documents send too; of the busy ones, a row leaves out as many as its scheme allows."""
        for k, r, d in s.keys(tokens, sizes):
            ok = passes(bits.value, k)
            k, r = k[ok], r[ok]
            hot = passes(busy.value, k)
            before = np.cumsum(hot) - hot
            first = np.searchsorted(r, r)
            ok = ~hot | (before - before[first] >= d[r])
            yield k[ok], r[ok]

    def keep(batches):
        s = scheme(percent)
        for b in batches:
            known = b.column("id").is_valid().to_numpy(zero_copy_only=False)
            n, s1, s2, keys, maps = [], [], [], [], []
            for i, j, sets in sets_of(b):
                sizes = np.array([len(x) for x in sets])
                tokens = np.concatenate([x for x, ok in zip(sets, known[i:j], strict=True) if ok] or [np.zeros(0, U64)])
                found = list(chosen(s, tokens, sizes * known[i:j]))
                k = np.concatenate([x for x, _ in found] or [np.zeros(0, U64)]).view(np.int64)
                r = np.concatenate([x for _, x in found] or [np.zeros(0, np.int64)])
                order = np.argsort(r, kind="stable")
                per = np.split(k[order], np.searchsorted(r[order], np.arange(1, j - i)))
                n += sizes.tolist()
                s1 += [int(mix(x).sum().view(np.int64)) if len(x) else 0 for x in sets]
                s2 += [int(np.bitwise_xor.reduce(mix(x ^ U64(0xABCDEF))).view(np.int64)) if len(x) else 0 for x in sets]
                keys += per
                maps += [bitmap(x) if len(k) else None for x, k in zip(sets, per, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(maps, pa.binary())],
                names=["id", "n", "s1", "s2", "keys", "map"],
            )

    blocks_of = lambda c, words: F.greatest(F.ceil(c / BLOCK_DOCS), F.ceil(words / BLOCK_SHINGLES)).cast("int")
    mine = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("mine")
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))

    def tightened(placed: DataFrame, sets: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
        """(gid, id, n, parts) of what bitmaps tie together of the documents of each key, and the tables behind it."""
        apart = placed.select("h", "lead", "id", "n", blocks_of(F.col("c"), F.col("words") / 16).alias("parts")).withColumn("mine", mine)  # bitmaps are a sixteenth of their sets
        maps, block = sets.where(F.col("id").isNotNull()).select("id", "n", "map"), ["h", "i", "j"]

        def loosely(batches):
            for _, (sides, ids, n, maps) in _groups(batches, block, ["side", "id", "n", "map"]):
                left = np.array(sides) == 0
                yield _links(may_link(np.array(ids), np.array(n), maps, percent, None if left.all() else left))

        def tied(rows: DataFrame) -> DataFrame:
            rows = rows.select("h", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), F.col("side").cast("int").alias("side"), "id", "n")
            near = rows.join(maps, ["id", "n"]).repartition(*block).sortWithinPartitions(*block)
            return near.select(*block, "side", "id", "n", "map").mapInArrow(loosely, "a bigint, b bigint")

        # documents of one key meet if they fit one block; else each meets the first of them, and those of other components than that one's meet all
        one, many = apart.where("parts = 1"), apart.where("parts > 1")
        first = many.where("id = lead").select("h", "id", "n", every.alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
        rest = many.where("id != lead").select("h", "id", "n", F.col("mine").alias("i"), F.lit(0).alias("j"), F.lit(1).alias("side"))
        ties = stage(tied(one.select("h", "id", "n", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side")).unionByName(first).unionByName(rest)), "ties")
        tight = stage(components(ties), "tight")
        lead_of = tight.select(F.col("id").alias("lead"), F.col("label").alias("lead_label"))
        other = many.join(tight, "id", "left").join(lead_of, "lead", "left").where(F.coalesce("label", "id") != F.coalesce("lead_label", "lead"))
        other = stage(other.select("h", "id", "n", "parts"), "untied")
        if not other.isEmpty():
            counts = other.groupBy("h").agg(blocks_of(F.count("*"), F.sum("n") / 16).alias("rows"))
            over = other.join(counts, "h").select("h", "id", "n", F.pmod(F.xxhash64("id"), F.col("rows")).alias("i"), every.alias("j"), F.lit(0).alias("side"))
            under = many.join(counts, "h").select("h", "id", "n", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("mine").alias("j"), F.lit(1).alias("side"))
            tight = stage(components(ties.unionByName(tied(over.unionByName(under)))), "tight-all")
        found = tight.join(apart.select("id", "n").distinct(), "id")
        sizes = stage(found.groupBy("label").agg(blocks_of(F.count("*"), F.sum("n")).alias("parts"), F.count("*").alias("c")), "tight-sizes")
        return join_hot(found, sizes, ["label"], "c").select((-1 - F.col("label")).alias("gid"), "id", "n", "parts"), [ties, other, tight, sizes]  # gid: apart from other labels

    sets = stage(base.mapInArrow(keep, "id bigint, n bigint, s1 bigint, s2 bigint, keys array<bigint>, map binary"), "sets")
    for done in (bits, busy):
        done.destroy()
    named = sets.where(F.col("id").isNotNull() & (F.col("n") > 0))
    reps = stage(named.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "representatives")
    own = named.where(F.size("keys") > 0).select("id", "n", "keys").join(reps.select(F.col("rep").alias("id"), "n"), ["id", "n"], "left_semi")
    hits = stage(own.select("id", "n", F.explode("keys").alias("h")), "hits")
    groups = hits.groupBy("h").agg(F.min("id").alias("lead"), F.count("*").alias("c"), F.sum("n").alias("words"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("who")).where(F.col("c") > 1)
    # keys of the same documents are one group
    groups = stage(groups.groupBy("who", "c", "words", "lead").agg(F.min("h").alias("h")), "groups")
    members = stage(join_hot(hits, groups.select("h", "lead", F.col("c").alias("size"), "words", "c"), ["h"], "c").withColumnRenamed("size", "c"), "members")
    clusters = stage(components(members.where(F.col("id") != F.col("lead")).select(F.col("lead").alias("a"), F.col("id").alias("b"))), "clusters")
    # compared whole are small clusters, and those that one key or another holds together; loose ones fall apart first
    clustered = stage(members.select("id", "n").distinct().join(clusters, "id"), "clustered")  # a row for each document, not for each of its keys
    whole = clustered.groupBy("label").agg(F.count("*").alias("c"), F.sum("n").alias("words"))
    led = groups.join(clusters, groups["lead"] == clusters["id"]).select("h", "c", "label")
    by_key = led.groupBy("label").agg(F.sum(F.col("c").cast("double") * F.col("c")).alias("pairs"))
    plan = stage(whole.join(by_key, "label").withColumn("at_once", (F.col("c") <= BLOCK_DOCS) | (F.col("c").cast("double") * F.col("c") <= F.col("pairs"))), "plan")
    at_once = join_hot(clustered, plan.where("at_once").select("label", F.col("c").alias("all_c"), "words", "c"), ["label"], "c").select(F.col("label").alias("gid"), "id", "n", blocks_of(F.col("all_c"), F.col("words")).alias("parts"))
    parted, spent = at_once, [several, hits, groups, members, clusters, clustered, plan]
    if not plan.where(~F.col("at_once")).isEmpty():
        keys = stage(led.join(plan.where(~F.col("at_once")).select("label"), "label", "left_semi").select("h", F.col("c").alias("size")), "loose-keys")
        keyed = stage(join_hot(members, keys, ["h"], "size"), "loose-members")
        found, kept = tightened(keyed, sets)
        parted, spent = at_once.unionByName(found), [*spent, keys, keyed, *kept]
    placed = stage(parted.withColumn("mine", mine), "placed")

    def sets_again(placed: DataFrame) -> DataFrame:
        """The sets of the documents that are to be compared, from their texts."""
        wanted = build_filter(placed, "id")

        def fill(batches):
            for b in batches:
                ok = b.column("id").is_valid().to_numpy(zero_copy_only=False) & passes(wanted.value, b.column("id").fill_null(0).to_numpy().view(U64))
                b = b.filter(pa.array(ok))
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([x.tobytes() for _, _, part in sets_of(b) for x in part], pa.binary())], names=["id", "items"])

        return base.mapInArrow(fill, "id bigint, items binary")

    task = ["gid", "i", "j"]

    def compare(batches):
        for _, (sides, ids, items) in _groups(batches, task, ["side", "id", "items"]):
            left = np.array(sides) == 0
            yield _links(forest(np.array(ids), [np.frombuffer(x, U64) for x in items], percent, None if left.all() else left))

    def compared(block: DataFrame, texts: DataFrame) -> DataFrame:
        rows = block.join(texts, "id").repartition(*task).sortWithinPartitions(*task)
        return rows.select(*task, "side", "id", "items").mapInArrow(compare, "a bigint, b bigint")

    side = lambda n: F.lit(n).alias("side")
    links = compared(placed.where("parts = 1").select("gid", "id", F.lit(0).alias("i"), F.lit(0).alias("j"), side(0)), sets_again(placed.where("parts = 1")))
    large, group = placed.where("parts > 1"), ["gid"]
    if not large.isEmpty():  # a task for each part of a large group, first against its leader, then against what does not link with it
        texts = stage(large.select("id").distinct().join(sets_again(large), "id"), "sets-of-large")
        leads = stage(large.groupBy(*group).agg(F.min("id").alias("lead"), F.max("parts").alias("parts"), F.count("*").alias("c")), "leads")
        rest = join_hot(large, leads.drop("parts"), group, "c").where(F.col("id") != F.col("lead"))
        to_lead = leads.select(*group, F.col("lead").alias("id"), every.alias("i"), F.lit(0).alias("j"), side(0)).unionByName(rest.select(*group, "id", F.col("mine").alias("i"), F.lit(0).alias("j"), side(1)))
        joined = stage(compared(to_lead, texts), "links-to-lead")
        loose = stage(rest.join(joined, (F.col("lead") == F.col("a")) & (F.col("id") == F.col("b")), "left_anti").select(*group, "id", "n", "parts"), "loose")
        counts = loose.groupBy(*group).agg(blocks_of(F.count("*"), F.sum("n")).alias("rows"))
        counts = stage(counts.join(leads.select(*group, "c"), group), "counts-of-loose")
        over = join_hot(loose, counts, group, "c").select(*group, "id", F.pmod(F.xxhash64("id"), F.col("rows")).cast("int").alias("i"), every.alias("j"), side(0))
        under = join_hot(large, counts, group, "c").select(*group, "id", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.col("mine").alias("j"), side(1))
        links = links.unionByName(joined).unionByName(compared(over.unionByName(under), texts))
    labels = components(links)
    # empty sets are no class, and a class of very many copies is dealt over many tasks
    classes = stage(reps.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("n", "s1", "s2", F.coalesce("label", "rep").alias("component"), "copies"), "classes")
    for done in (*spent, placed, reps):
        drop_stage(done)
    whole = join_hot(sets.where("n > 0").select("id", "n", "s1", "s2"), classes, ["n", "s1", "s2"], "copies", "left").select("id", "n", "component")
    joined = whole.unionByName(sets.where("n = 0").select("id", "n", F.lit(None).cast("bigint").alias("component")))
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))


def _groups(batches, key: list[str], columns: list[str]):
    """(key, lists of the columns) of each run of rows of one key, in sorted batches; rows hold whole sets, so few are unpacked at a time."""
    at, rows = None, [[] for _ in columns]
    for b in (whole.slice(s, 256) for whole in batches for s in range(0, whole.num_rows, 256)):
        for *now, row in zip(*[b.column(c).to_pylist() for c in key], zip(*[b.column(c).to_pylist() for c in columns], strict=True), strict=True):
            if now != at:
                if at is not None:
                    yield at, rows
                at, rows = now, [[] for _ in columns]
            for own, x in zip(rows, row, strict=True):
                own.append(x)
    if at is not None:
        yield at, rows


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([int(a) for a, _ in pairs], pa.int64()), pa.array([int(b) for _, b in pairs], pa.int64())], names=["a", "b"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), shingle=4, percent=85)


SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents),
g as (select doc_id, list_distinct(case when len(words) >= 4 then list_transform(range(1, len(words) - 2), lambda i: md5_number(array_to_string(words[i:i + 3], ' '))) when len(words) > 0 then [md5_number(array_to_string(words, ' '))] else [] end) as items from w),
n as (select doc_id, len(items) as n from g),
s as (select doc_id, unnest(items) as item from g),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.item = b.item and a.doc_id < b.doc_id group by all),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * common >= 85 * (x.n + y.n - common)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id as id, doc_id as root from n union select e.b, r.root from r join e on e.a = r.id where r.root < e.b)
select doc_id, n::bigint as n_shingles, (select min(root) from r where r.id = doc_id)::bigint as component_id from n
"""
