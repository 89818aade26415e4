"""Local image descriptors: cropped or edited copies of images, found by matching corners and agreeing on geometry."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelens.llm.common import join_hot, stage
from ridgelens.llm.components import components
from ridgelens.llm.words import U64, mix

#: A corner leads its surroundings of this radius; sizes of the scales in eighths; binary tests; radius of a patch.
SPREAD, SCALES, TESTS, RADIUS = 4, (8, 7, 6, 5, 4), 128, 12
#: Images described at a time, and their pixels: corners are many times their row.
MOST_IMAGES, MOST_PIXELS = 500, 1 << 21
#: Table columns of 32 bits; bits in which two matching descriptors differ at most; matches that agree on one geometry.
TABLES, NEAR, AGREE = 4, 20, 4
#: Corners of a table entry that all meet each other at once; of a larger entry, corners of a block.
CROWD, BLOCK = 16, 512
#: An entry of more than one in HOT of all corners, and more than LEAST, is dealt over tasks by LEAST corners.
HOT, LEAST = 1024, 4096
#: Exponents of the least and most slots in which matches of pairs of images are counted, in PARTS parts; slots for a match.
LEAST_SLOTS, MOST_SLOTS, PARTS, ROOM = 16, 25, 256, 8
#: Angles that a patch may have; pixels of a step of the geometry.
TURNS, STEP = 32, 6
#: A corner: place in quarters of a pixel, scale, turn, and the words of its descriptor.
CORNER = np.dtype([("x", "<i4"), ("y", "<i4"), ("scale", "u1"), ("turn", "u1"), ("words", "<u4", TABLES)])


def _pattern() -> np.ndarray:
    """The test pairs (TESTS x 2 points x 2 coordinates) turned to each of TURNS angles, as whole pixels."""
    rng = np.random.default_rng(4)
    points = np.clip(rng.normal(0, RADIUS / 1.6, (TESTS, 2, 2)), -RADIUS + 2, RADIUS - 2)
    angle = 2 * np.pi * np.arange(TURNS) / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], -1), np.stack([np.sin(angle), np.cos(angle)], -1)], -2)
    return np.clip(np.rint(np.einsum("aij,tpj->atpi", turn, points)), -RADIUS, RADIUS).astype(int)


def _box(x: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r+1)-squares, zero outside."""
    for axis in (1, 2):
        pad = [(0, 0)] * 3
        pad[axis] = (r + 1, r)
        c = np.cumsum(np.pad(x, pad), axis)
        n = x.shape[axis]
        low = [slice(None)] * 3
        high = [slice(None)] * 3
        low[axis], high[axis] = slice(0, n), slice(2 * r + 1, n + 2 * r + 1)
        x = c[tuple(high)] - c[tuple(low)]
    return x


def _highest(x: np.ndarray, r: int) -> np.ndarray:
    """Maxima over (2r+1)-squares, as far as they lie inside."""
    for axis in (1, 2):
        n, out = x.shape[axis], x.copy()
        for k in range(1, min(r, n - 1) + 1):
            low, high = [slice(None)] * 3, [slice(None)] * 3
            low[axis], high[axis] = slice(0, n - k), slice(k, n)
            np.maximum(out[tuple(low)], x[tuple(high)], out=out[tuple(low)])
            np.maximum(out[tuple(high)], x[tuple(low)], out=out[tuple(high)])
        x = out
    return x


def _portions(batches):
    """Slices of the batches of MOST_IMAGES rows and MOST_PIXELS bytes of pixels at most, or of one row."""
    for whole in batches:
        start = pixels = 0
        for k, size in enumerate(pc.fill_null(pc.binary_length(whole.column("px")), 0).to_pylist()):
            if k > start and (k - start == MOST_IMAGES or pixels + size > MOST_PIXELS):
                yield whole.slice(start, k - start)
                start, pixels = k, 0
            pixels += size
        yield whole.slice(start)


def _shrink(x: np.ndarray, eighths: int) -> np.ndarray:
    """Images at eighths / 8 of their size, by linear interpolation, then smoothed a little.

    Smoothing comes last, in pixels of the size reached: a copy that was made at that size is smoothed over the same
    stretch of the picture, so corners and tests of both agree.
    """
    h, w = x.shape[1:]
    at = lambda n: (np.arange(max(1, n * eighths // 8)) + 0.5) * 8 / eighths - 0.5
    for axis, n in ((1, h), (2, w)) if eighths < 8 else ():
        p = np.clip(at(n), 0, n - 1)
        i = np.minimum(p.astype(int), max(n - 2, 0))
        f = (p - i).reshape([-1 if a == axis else 1 for a in range(3)])
        x = np.take(x, i, axis) * (1 - f) + np.take(x, np.minimum(i + 1, n - 1), axis) * f
    return _box(x, 1) / 9


def describe(images: np.ndarray) -> list[np.ndarray]:
    """The corners (CORNER) of each of some images (count x height x width) of one size.

    A corner is where the smaller-eigenvalue response (determinant over trace) is highest within SPREAD pixels, apart
    from a margin in which a patch would leave the image: corners grow with the image's area, and a crop keeps its share
    of them.  Its turn is the direction of the patch's centre of brightness; the tests compare smoothed brightness at
    pairs of places turned with it.
    """
    pattern, parts, owner = _pattern(), [], []
    yy, xx = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    disc = (yy**2 + xx**2 <= RADIUS**2).ravel()
    oy, ox = yy.ravel()[disc], xx.ravel()[disc]
    for scale in SCALES:
        x = _shrink(images.astype(np.float32), scale)
        n, h, w = x.shape
        m = RADIUS + 1
        if min(h, w) <= 2 * m:
            continue
        gx, gy = np.zeros_like(x), np.zeros_like(x)
        gx[:, :, 1:-1], gy[:, 1:-1] = x[:, :, 2:] - x[:, :, :-2], x[:, 2:] - x[:, :-2]
        a, b, c = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = (a * b - c * c) / (a + b + 1e-3)
        inner = r[:, m:-m, m:-m]
        image, cy, cx = np.nonzero((inner > 1) & (inner >= _highest(r, SPREAD)[:, m:-m, m:-m]))
        cy, cx = cy + m, cx + m
        soft = _box(x, 1)
        patch = x[image[:, None], cy[:, None] + oy, cx[:, None] + ox]
        turn = np.rint(np.arctan2((patch * oy).sum(1), (patch * ox).sum(1)) / (2 * np.pi) * TURNS).astype(int) % TURNS
        p = pattern[turn]
        one = soft[image[:, None], cy[:, None] + p[:, :, 0, 1], cx[:, None] + p[:, :, 0, 0]]
        two = soft[image[:, None], cy[:, None] + p[:, :, 1, 1], cx[:, None] + p[:, :, 1, 0]]
        found = np.zeros(len(image), CORNER)
        found["x"], found["y"], found["scale"], found["turn"] = np.rint((cx + 0.5) * 32 / scale), np.rint((cy + 0.5) * 32 / scale), scale, turn
        found["words"] = np.packbits(one < two, axis=1).view(">u4")
        parts.append(found)
        owner.append(image)
    if not parts:
        return [np.zeros(0, CORNER)] * len(images)
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.split(np.concatenate(parts)[order], np.searchsorted(owner[order], np.arange(1, len(images))))


def _packed(c: np.ndarray) -> np.ndarray:
    """Place, scale and turn of corners in one number each."""
    return (c["x"].astype(np.int64) << 36) | (c["y"].astype(np.int64) << 9) | (c["scale"].astype(np.int64) << 5) | c["turn"]


def _unpacked(g: np.ndarray) -> tuple[np.ndarray, ...]:
    """x and y in pixels, scale, turn."""
    return (g >> 36) / 4, ((g >> 9) & ((1 << 27) - 1)) / 4, (g >> 5) & 15, g & 31


def _read(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Bigint columns as the columns of a matrix."""
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1).astype(np.int64)


def _starts(rows: np.ndarray) -> np.ndarray:
    """Where rows differ from the one before."""
    return np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))


#: Columns of a table entry's row: the key (table and word, salt), the image, its corner, and the descriptor.
ENTRY = ["entry", "salt", "id", "geo", "b1", "b2"]


def _near(rows: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """(a, b, geometry of a, of b) of the pairs of rows that match, smaller id first; a pair counts in the first table that joins it."""
    left, right = rows[i], rows[j]
    x1, x2 = left[:, 4] ^ right[:, 4], left[:, 5] ^ right[:, 5]
    ok = (left[:, 2] != right[:, 2]) & (np.bitwise_count(x1.view(np.uint64)).astype(int) + np.bitwise_count(x2.view(np.uint64)) <= NEAR)
    for t, word in enumerate(((x1 >> 32) & 0xFFFFFFFF, x1 & 0xFFFFFFFF, (x2 >> 32) & 0xFFFFFFFF)):
        ok &= (word != 0) | ((left[:, 0] & 3) <= t)
    left, right = left[ok], right[ok]
    swap = (left[:, 2] > right[:, 2])[:, None]
    left, right = np.where(swap, right, left), np.where(swap, left, right)
    return np.stack([left[:, 2], right[:, 2], left[:, 3], right[:, 3]], 1)


def _meet(rows: np.ndarray, told: int) -> tuple[np.ndarray, np.ndarray]:
    """Matches of sorted rows, and the rows of crowded entries, in which only the leader meets the others.

    told: so many first rows are the leader of a crowded entry whose other rows came before.
    """
    starts = _starts(rows[:, :2])
    ends = np.append(starts[1:], len(rows))
    crowded = (ends - starts > CROWD) | (rows[starts, 1] >= 0)
    crowded[:1] |= told > 0
    run = np.repeat(np.arange(len(starts)), ends - starts)
    i, j = [], []
    for lag in range(1, CROWD):
        at = np.flatnonzero((run[lag:] == run[:-lag]) & ~crowded[run[lag:]])
        if not len(at):
            break
        i.append(at)
        j.append(at + lag)
    rest = crowded[run]
    rest[:told] = False
    for a, z in zip(starts[crowded].tolist(), ends[crowded].tolist(), strict=True):
        lead = int(np.argmin(np.append(rows[a:z, 2] == rows[a, 2], False)))
        for k in range(lead):
            i.append(np.full(z - a - lead, a + k))
            j.append(np.arange(a + lead, z))
        if rows[a, 1] > 0:
            rest[a : a + lead] = False  # repeated for each salt, told by the first
    pairs = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (i, j)]
    return _near(rows, *pairs), rows[rest]


def _agree(rows: np.ndarray) -> np.ndarray:
    """(a, b) of the pairs of images of which AGREE corners say the same geometry; rows: a, b and the two corners, sorted."""
    starts = _starts(rows[:, :2])
    sizes = np.diff(np.append(starts, len(rows)))
    rows, sizes = rows[np.repeat(sizes >= AGREE, sizes)], sizes[sizes >= AGREE]
    if not len(rows):
        return np.zeros((0, 2), np.int64)
    pair = np.repeat(np.arange(len(sizes)), sizes)
    (xa, ya, sa, ta), (xb, yb, sb, tb) = _unpacked(rows[:, 2]), _unpacked(rows[:, 3])
    turned = (ta - tb) % TURNS
    angle, ratio = turned * (2 * np.pi / TURNS), sa / sb  # how the second lies in the first
    dx = xa - (xb * np.cos(angle) - yb * np.sin(angle)) / ratio
    dy = ya - (xb * np.sin(angle) + yb * np.cos(angle)) / ratio
    found = []
    for k in range(8):  # steps of turn and shift overlap by half
        bins = [(turned + 2 * (k & 1)) // 4 % (TURNS // 4), np.floor(dx / STEP + (k >> 1 & 1) / 2), np.floor(dy / STEP + (k >> 2) / 2)]
        say = np.stack([pair, np.rint(ratio * 1000), *bins], 1).astype(np.int64)
        say = np.unique(np.concatenate([say, rows[:, 3:4] >> 9], 1), axis=0)  # a place of the second image counts once
        first = _starts(say[:, :5])
        found.append(say[first[np.diff(np.append(first, len(say))) >= AGREE], 0])
    at = np.cumsum(sizes) - sizes
    return rows[at[np.unique(np.concatenate(found))], :2]


def _slots(pairs: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each pair of images (a, b)."""
    h = mix(mix(pairs[:, 0].astype(U64)) + pairs[:, 1].astype(U64))
    return (h & U64(slots - 1)).astype(np.int64)


def _tallied(matches, slots: int):
    """How many of a task's matches fall into each slot, AGREE at most: rows of a part's number and its packed counts."""
    counts = np.zeros(slots, np.uint8)
    for pairs in matches:
        at, n = np.unique(_slots(pairs, slots), return_counts=True)
        counts[at] = np.minimum(counts[at] + n, AGREE)
    parts = counts.reshape(PARTS, -1)
    used = np.flatnonzero(parts.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(parts[k].tobytes(), 1) for k in used], pa.binary())], names=["part", "n"])


def _often(table: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Whether each pair's slot holds AGREE matches; table: a bit for each slot."""
    at = _slots(pairs, table.size * 8)
    return (table.ravel()[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _table(rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in rows.T.reshape(len(names), -1)], names=names)


def find_copies(media: DataFrame, *, id_col: str = "media_id", pixels: str = "pixels", height: str = "height", width: str = "width") -> DataFrame:
    """id_col, n_corners, copy_group (smallest id that links reach): grey images (8-bit pixels, row by row) and their copies.

    Images of equal bytes stand for one.  Each corner's descriptor goes to a table for every 32 of its bits; corners in
    one entry that differ in NEAR bits at most match.  A match says how the one image lies in the other: scale, turn and
    shift; two images link if AGREE corners say the same, up to a coarse step.

    1. All corners of an entry of up to CROWD meet; in a larger one, those of its smallest image meet the others.  Entries
       are dealt by key and stream by sorted; of a crowded one only the leader is remembered.  Entries that hold more
       than one in HOT of all corners, found by partial counts, are dealt over tasks, their leader repeated.
    2. The links found so far give components.  In crowded entries with images of several components, all corners of
       different ones meet too, in blocks of bounded size, so no link between components is lost; inside a component
       none is needed.  They meet twice: first the matches of each pair of images are only counted, with those of step 1,
       in a table of fixed size that pairs share by a hash (a bit for each slot reaches the driver, 4 MB at most); then
       matches of pairs with AGREE or more are returned.  No other pair can link, so none is lost, and what chance
       brings together is never written.  A family of very many copies is linear work; only a motif that fewer than
       AGREE corners describe, in very many unrelated images, costs the square of their number, in comparisons.

    Null or broken images (no pixels, sizes that do not fit or are not positive) and images without corners link only
    with equal bytes (null: with nothing).  Null ids: returned with a null group.  Rows with equal ids are one image with
    the corners of both.  Empty table: empty result.
    """
    spark = media.sparkSession
    base = media.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{pixels}`").alias("px"), F.col(f"`{height}`").cast("int").alias("h"), F.col(f"`{width}`").cast("int").alias("w"))
    keyed = base.withColumn("sha", F.when(F.col("px").isNotNull(), F.sha2(F.concat_ws(":", F.hex("px"), "h", "w"), 256)))

    def corners(batches):
        for b in _portions(batches):
            px, hs, ws = b.column("px").to_pylist(), b.column("h").to_pylist(), b.column("w").to_pylist()
            shapes: dict[tuple[int, int], list[int]] = {}
            for k, (p, h, w) in enumerate(zip(px, hs, ws, strict=True)):
                if p is not None and (h or 0) > 0 and (w or 0) > 0 and h * w == len(p):
                    shapes.setdefault((h, w), []).append(k)
            found = [b""] * len(px)
            for (h, w), rows in shapes.items():
                step = max(1, (1 << 20) // (h * w))
                for s in range(0, len(rows), step):
                    part = rows[s : s + step]
                    for k, c in zip(part, describe(np.stack([np.frombuffer(px[k], np.uint8).reshape(h, w) for k in part])), strict=True):
                        found[k] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sha"), pa.array(found, pa.binary())], names=["id", "sha", "corners"])

    described = stage(keyed.mapInArrow(corners, "id bigint, sha string, corners binary"), "corners")
    same = stage(described.where(F.col("id").isNotNull() & F.col("sha").isNotNull()).groupBy("sha").agg(F.min("id").alias("rep")), "equal")
    single = described.join(same.withColumnRenamed("rep", "id"), ["id", "sha"], "left_semi").where(F.length("corners") > 0).select("id", "corners")

    def entries_of(b: pa.RecordBatch) -> np.ndarray:
        """The entry rows of a batch of images."""
        raw = b.column("corners").to_pylist()
        c = np.frombuffer(b"".join(raw), CORNER)
        ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), [len(x) // CORNER.itemsize for x in raw])
        w = c["words"].astype(np.int64)
        one = np.stack([np.zeros(len(c), np.int64), np.full(len(c), -1), ids, _packed(c), (w[:, 0] << 32) | w[:, 1], (w[:, 2] << 32) | w[:, 3]], 1)
        out = np.concatenate([one] * TABLES)
        out[:, 0] = (w.T << 2 | np.arange(TABLES)[:, None]).ravel()
        return out

    def frequent(batches):
        for b in batches:
            if b.num_rows:
                rows = entries_of(b)
                key, first, n = np.unique(rows[np.argsort(rows[:, 2], kind="stable"), 0], return_index=True, return_counts=True)
                lead = np.sort(rows[:, 2], kind="stable")[first]
                ok = n * 4 * HOT > len(rows) // TABLES
                yield _table(np.stack([key, lead, n], 1)[ok & (n > 1)], ["entry", "lead", "n"])

    total = described.agg(F.sum(F.length("corners"))).first()[0] or 0
    seen = single.mapInArrow(frequent, "entry bigint, lead bigint, n bigint").groupBy("entry").agg(F.min("lead").alias("lead"), F.sum("n").alias("n"))
    limit = max(LEAST, total // CORNER.itemsize // HOT)
    hot = np.array(sorted(tuple(r) for r in seen.where(F.col("n") > limit).collect()), np.int64).reshape(-1, 3)  # fewer than TABLES * HOT rows
    sent = spark.sparkContext.broadcast(hot)

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows, hot = entries_of(b), sent.value
            follows = np.ones(len(rows), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot[:, 0], rows[:, 0]), len(hot) - 1)
                is_hot = hot[at, 0] == rows[:, 0]
                parts = -(-hot[at, 2] // LEAST)
                lead = is_hot & (hot[at, 1] == rows[:, 2])
                rows[:, 1] = np.where(is_hot, (rows[:, 2] * 0x9E3779B1 >> 7) % parts, -1)
                again = np.repeat(np.flatnonzero(lead), parts[lead])
                copies = rows[again]
                copies[:, 1] = np.arange(len(again)) - np.repeat(np.cumsum(parts[lead]) - parts[lead], parts[lead])
                rows = np.concatenate([rows[~lead], copies])
                follows = np.concatenate([follows[~lead], np.zeros(len(copies), np.int64)])
            yield _table(np.concatenate([rows, follows[:, None]], 1), [*ENTRY, "follows"])

    def meet(batches):
        held, told = np.zeros((0, len(ENTRY)), np.int64), 0
        out = ["entry", "a", "b", "ga", "gb", "b1", "b2"]

        def answer(rows, told):
            near, rest = _meet(rows, told)
            empty = pa.nulls(len(near), pa.int64()), pa.nulls(len(rest), pa.int64())
            yield pa.RecordBatch.from_arrays([empty[0], *[pa.array(np.ascontiguousarray(near[:, k])) for k in range(4)], empty[0], empty[0]], names=out)
            yield pa.RecordBatch.from_arrays([*[pa.array(np.ascontiguousarray(rest[:, k])) for k in (0, 2)], empty[1], pa.array(np.ascontiguousarray(rest[:, 3])), empty[1], *[pa.array(np.ascontiguousarray(rest[:, k])) for k in (4, 5)]], names=out)

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.concatenate([held, _read(b, ENTRY)])
            last = int(_starts(rows[:, :2])[-1])
            if len(rows) - last <= CROWD and not (told and last == 0):
                held = rows[last:]  # the run may go on
                if last:
                    yield from answer(rows[:last], told)
                told = 0
            else:
                yield from answer(rows, told)
                held = rows[last:][np.cumprod(rows[last:, 2] == rows[last, 2]).astype(bool)]
                told = len(held)
        if len(held) and not told:
            yield from answer(held, 0)

    keys = ["entry", "salt", "follows", "id"]
    dealt = single.mapInArrow(deal, ", ".join(f"{c} bigint" for c in [*ENTRY, "follows"])).repartition("entry", "salt").sortWithinPartitions(*keys)
    met = stage(dealt.select(*ENTRY).mapInArrow(meet, "entry bigint, a bigint, b bigint, ga bigint, gb bigint, b1 bigint, b2 bigint"), "matches")
    votes = met.where(F.col("b").isNotNull()).select("a", "b", "ga", "gb")

    def agree(batches):
        held = np.zeros((0, 4), np.int64)
        for b in batches:
            if b.num_rows:
                rows = np.concatenate([held, _read(b, ["a", "b", "ga", "gb"])])
                last = int(_starts(rows[:, :2])[-1])
                held = rows[last:]
                yield _table(_agree(rows[:last]), ["a", "b"])
        yield _table(_agree(held), ["a", "b"])

    def linked(votes: DataFrame) -> DataFrame:
        return votes.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(agree, "a bigint, b bigint")

    links = stage(linked(votes), "image-links")
    labels = stage(components(links), "image-labels")
    crowd = met.where(F.col("b").isNull()).select("entry", F.col("a").alias("id"), F.col("ga").alias("geo"), "b1", "b2").distinct()
    crowd = crowd.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    several = stage(crowd.groupBy("entry").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("c")).where(F.col("lo") < F.col("hi")).select("entry", F.ceil(F.col("c") / BLOCK).cast("long").alias("parts"), "c"), "crowded")
    if not several.isEmpty():
        rows = join_hot(crowd, several, ["entry"], "c").withColumn("mine", F.pmod(F.xxhash64("id", "geo"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        fields = ["entry", "i", "j", "side", "id", "geo", "b1", "b2", "label"]
        rows = stage(rows.select("entry", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), F.col("mine").alias("side"), "id", "geo", "b1", "b2", "label"), "crowd-blocks")

        def matches(batches):
            """Matches between images of different components, block against block."""
            held = np.zeros((0, len(fields)), np.int64)

            def answer(r):
                if not len(r):
                    return
                for a, z in zip(s := _starts(r[:, :3]).tolist(), [*s[1:], len(r)], strict=True):
                    own = r[a:z]
                    left, right = (np.flatnonzero(own[:, 3] == own[0, k]) for k in (1, 2))
                    i, j = (x.ravel() for x in np.meshgrid(left, right, indexing="ij"))
                    ok = (own[i, 8] != own[j, 8]) & ((i < j) | (own[0, 1] != own[0, 2]))
                    yield _near(own[:, [0, 3, 4, 5, 6, 7]], i[ok], j[ok])

            for b in batches:
                if b.num_rows:
                    r = np.concatenate([held, _read(b, fields)])
                    last = int(_starts(r[:, :3])[-1])
                    held = r[last:]
                    yield from answer(r[:last])
            yield from answer(held)

        dealt = rows.repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j").select(*fields)
        meetings = several.agg(F.sum(F.col("c").cast("double") * F.col("c") / 2)).first()[0]
        slots = 1 << min(MOST_SLOTS, max(LEAST_SLOTS, int(max(meetings, ROOM * votes.count())).bit_length()))  # pairs that link fill slots too

        def tally(batches):
            yield from _tallied(matches(batches), slots)

        def tally_votes(batches):
            yield from _tallied((_read(b, ["a", "b"]) for b in batches), slots)

        def add_up(batches):
            sums: dict[int, np.ndarray] = {}
            for b in batches:
                for part, raw in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), strict=True):
                    n = np.frombuffer(zlib.decompress(raw), np.uint8)
                    sums[part] = np.minimum(sums.get(part, 0) + n, AGREE).astype(np.uint8)  # both AGREE at most
            parts = sorted(sums)
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([np.packbits(sums[k] >= AGREE).tobytes() for k in parts], pa.binary())], names=["part", "n"])

        told = dealt.mapInArrow(tally, "part int, n binary").unionByName(votes.select("a", "b").mapInArrow(tally_votes, "part int, n binary"))
        table = np.zeros((PARTS, slots // PARTS // 8), np.uint8)
        for part, raw in told.repartition("part").mapInArrow(add_up, "part int, n binary").collect():  # a bit for each slot
            table[part] = np.frombuffer(raw, np.uint8)
        often = spark.sparkContext.broadcast(table)

        def across(batches):
            for near in matches(batches):
                near = near[_often(often.value, near)]
                if len(near):
                    yield _table(near, ["a", "b", "ga", "gb"])

        more = dealt.mapInArrow(across, "a bigint, b bigint, ga bigint, gb bigint")
        labels = components(links.unionByName(linked(votes.unionByName(more))))
    groups = same.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("sha", F.coalesce("label", "rep").alias("copy_group"))
    out = described.select("id", "sha", F.floor(F.length("corners") / CORNER.itemsize).cast("long").alias("n_corners")).join(groups, "sha", "left")
    return out.select(F.col("id").alias(id_col), "n_corners", F.when(F.col("id").isNotNull(), F.coalesce("copy_group", "id")).alias("copy_group"))


SIDE = 80


def texture(vector: list) -> np.ndarray:
    grain = np.random.default_rng(zlib.crc32(np.array([np.nan if x is None else x for x in vector], np.float32).tobytes())).normal(size=(1, SIDE + 4, SIDE + 4))
    g = (_box(grain, 1) / 3 + _box(grain, 3) / 7)[0, 2:-2, 2:-2]
    return np.clip(128 + 40 * g, 0, 255).astype(np.uint8)


def edited(image: np.ndarray, i: int) -> np.ndarray:
    """The copy that goes with id i: kinds 1 to 5 by i % 6."""
    kind, k = i % 6, i // 6
    if kind == 4:
        return np.rot90(image, 1 + k % 3)
    if kind == 5:
        share, x = (7 / 8, 3 / 4)[k % 2], image.astype(float)
        p = (np.arange(int(SIDE * share)) + 0.5) / share - 0.5
        at, part = p.astype(int), p % 1
        x = x[at] * (1 - part)[:, None] + x[at + 1] * part[:, None]
        return np.rint(x[:, at] * (1 - part) + x[:, at + 1] * part).astype(np.uint8)
    crop = image[5 + k % 7 : SIDE - 4, 3 + k % 5 : SIDE - 6] if kind != 2 else image
    return crop if kind == 1 else np.clip(crop * 0.8 + 30, 0, 255).astype(np.uint8)


def rendered(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A media column derived from a table of vectors: media_id, pixels, height, width.

    Every vector is drawn as a SIDE x SIDE texture that depends on its values only (equal vectors: equal images), with
    media_id 2 * id.  Of six ids in turn, one stands alone and five give an edited copy too, 2 * id + 1: cropped; with
    other brightness and contrast; both; turned by one to three quarters; at 7/8 or 3/4 of its size.  Null vectors
    give null images, null ids none.
    """

    def draw(batches):
        for b in (whole.slice(s, 500) for whole in batches for s in range(0, whole.num_rows, 500)):
            out: list[list] = [[], [], [], []]
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                parts = [(2 * i, None)] if v is None else [(2 * i, texture(v))]
                if v is not None and i % 6:
                    parts.append((2 * i + 1, edited(parts[0][1], i)))
                for k, p in parts:
                    for column, value in zip(out, (k, None if p is None else np.ascontiguousarray(p).tobytes(), None if p is None else p.shape[0], None if p is None else p.shape[1]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.int32())], names=["media_id", "pixels", "height", "width"])

    return vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v")).where(F.col("id").isNotNull()).mapInArrow(draw, "media_id bigint, pixels binary, height int, width int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_copies(rendered(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
