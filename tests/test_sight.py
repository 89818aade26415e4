"""Rules of lines of sight, thinning and key presses on hand-made cases, and two forms of one operator against each other."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from ridgelens.functions import grid
from ridgelens.operators import labels, raster, sight
from ridgelens.plans import jobs
from ridgelens.plans.fixtures import fixture
from ridgelens.streaming import pose

DATA = "/root/testdata/sf0.001"


def walk(x0, y0, x1, y1):
    """The pixels of a line, one step at a time: each step moves along the axis that lags behind the straight line."""
    dx, dy, sx, sy = abs(x1 - x0), abs(y1 - y0), (x1 > x0) - (x1 < x0), (y1 > y0) - (y1 < y0)
    n, out = max(dx, dy), [(x0, y0)]
    for k in range(1, n + 1):
        # nearest pixel to k / n of the way, halves up
        out.append((x0 + sx * ((2 * k * dx + n) // (2 * n)), y0 + sy * ((2 * k * dy + n) // (2 * n))))
    return out


def see(spark, heights, src, dst):
    """heights: {(ilat, ilon): h}; src, dst: (ilat, ilon)."""
    dem = spark.createDataFrame([(a, b, float(h)) for (a, b), h in heights.items()], "ilat int, ilon int, h double")
    pair = spark.createDataFrame([(1, 1, *src, *dst, heights.get(src), heights.get(dst))], "vp_id bigint, poi_id bigint, vlat int, vlon int, plat int, plon int, vh double, ph double")
    (a,) = sight.line_of_sight(pair, raster.to_blocks(dem)).collect()
    assert a.n_cells == max(abs(src[0] - dst[0]), abs(src[1] - dst[1])) + 1
    assert sight.line_of_sight(pair, raster.to_blocks(dem, 5), 5).collect() == [a]
    return a.visible


def row(n, **extra):
    return {(0, k): 0.0 for k in range(n)} | {(0, int(k[1:])): h for k, h in extra.items()}


def test_cases(spark):
    assert see(spark, row(1), (0, 0), (0, 0)) is False
    assert see(spark, row(2), (0, 0), (0, 1)) is True
    assert see(spark, row(41, _20=50.0), (0, 0), (0, 40)) is False
    assert see(spark, row(41, _39=50.0), (0, 0), (0, 40)) is True  # the last six hundredths never block
    gap = row(41)
    del gap[0, 20]
    assert see(spark, gap, (0, 0), (0, 40)) is None
    assert see(spark, gap | {(0, 10): 50.0}, (0, 0), (0, 40)) is False


def test_lines_follow_the_steps(spark):
    rng = random.Random(1)
    lines = [(k, k, rng.randint(-30, 30), rng.randint(-30, 30), rng.randint(-30, 30), rng.randint(-30, 30)) for k in range(300)]
    df = sight.sight_line_cells(spark.createDataFrame(lines, "vp_id bigint, poi_id bigint, vlat int, vlon int, plat int, plon int"))
    got: dict = {}
    for r in df.collect():
        got.setdefault(r.vp_id, {})[r.k] = (r.ilon, r.ilat)
    for k, _, a, b, c, d in lines:
        assert [got[k][i] for i in range(len(got[k]))] == walk(b, a, d, c)


def test_thinning_counts_only_kept_labels(spark):
    # slots 0, 0.05, 0.1 at a distance of 0.056: the second is hidden by the first, the third is not hidden by the second
    rows = [(1, k, "x", 0.0, -s / labels.SCALE * 2**0.5, 0.0) for k, s in enumerate((0.0, 0.05, 0.1))]
    df = spark.createDataFrame(rows, "vp_id bigint, nth int, name string, v double, u double, inclination double")
    assert [r.shown for r in labels.thin(df).orderBy("nth").collect()] == [True, False, True]


def test_thinning_is_the_plain_fold(spark):
    rng = random.Random(2)
    rows = [(v, k, rng.uniform(-1, 1), rng.uniform(-1, 1), 0.0) for v in range(4) for k in range(80)]
    df = spark.createDataFrame(rows, "vp_id bigint, nth int, v double, u double, inclination double")
    for variant, near in (("web", 0.8 * labels.TEXT_HEIGHT), ("sdl", labels.TEXT_HEIGHT)):
        got = {(r.vp_id, r.nth) for r in labels.thin(df, variant=variant).collect() if r.shown}
        want = set()
        for view in range(4):
            held = []
            for r in df.where(f"vp_id = {view}").withColumn("slot", labels.slot(variant)).orderBy("nth").collect():
                if all(abs(q - r.slot) >= near for q in held):
                    held.append(r.slot)
                    want.add((view, r.nth))
        assert got == want and 0 < len(got) < len(rows)


def test_long_lines(spark):
    """Lines of more than a thousand pixels over a rough raster, against a walk pixel by pixel."""
    rng = random.Random(5)
    heights = {(0, k): 0.0 for k in range(1100)}
    lines = [(k, k, 0, rng.randint(0, 20), 0, rng.randint(1030, 1099)) for k in range(12)]
    for k in range(30, 1000, 97):
        heights[0, k] = rng.uniform(0, 14)
    heights[0, 30] = 7.0  # hides from the lower viewers only
    pair = spark.createDataFrame([(*line, 1.0 * k, 9.0 * k) for k, line in enumerate(lines)], "vp_id bigint, poi_id bigint, vlat int, vlon int, plat int, plon int, vh double, ph double")
    dem = spark.createDataFrame([(a, b, h) for (a, b), h in heights.items()], "ilat int, ilon int, h double")
    got = {r.vp_id: r.visible for r in sight.line_of_sight(pair, raster.to_blocks(dem)).collect()}
    for k, (_, _, _, a, _, b) in enumerate(lines):
        vh, ph, d = 1.0 * k, 9.0 * k, b - a
        clear = [j == 0 or j > d * sight.FREE_FROM or (heights[0, a + j] - ((ph - vh - sight.EYE) * j / d + vh + sight.EYE)) / j < sight.BLOCKING for j in range(d + 1)]
        assert got[k] == all(clear)
    assert set(got.values()) == {True, False}


def fold(slots, near):
    """Of slots in order of rank, the places of those that show."""
    held, out = [], set()
    for k, p in enumerate(slots):
        if not any(abs(q - p) < near for q in held):
            held.append(p)
            out.add(k)
    return out


def test_settled_labels_are_those_of_the_fold():
    rng = np.random.default_rng(3)
    for n, spread in ((1, 1.0), (40, 3.0), (3000, 4.0), (300, 200.0)):
        slots, near = np.round(rng.uniform(0, spread, n), 2), 0.07  # many equal, many a threshold apart
        at = np.argsort(slots, kind="stable")
        got = labels.settle(slots[at], at, near, np.ones(n, bool))
        assert set(at[got == 1]) == fold(slots, near) and (got != 0).all()
        cut = labels.settle(slots[at], at, near, (slots[at] > 1) & (slots[at] < 2))  # what is settled without the rims stays so
        assert ((cut == 0) | (cut == got)).all()


def test_views_are_settled_together():
    """Labels of many views in one call: each as alone, also where rounding puts places off."""
    rng, near = np.random.default_rng(9), 0.07
    each = [np.sort(np.round(rng.uniform(-far, far, n), 2)) for n, far in ((1, 1.0), (60, 1.0), (400, 3.0), (30, 1e5), (60, 1.0))]
    order, view = rng.permutation(sum(map(len, each))), np.repeat(np.arange(len(each)), [len(x) for x in each])
    known = rng.uniform(size=len(order)) < 0.9
    alone = [labels.settle(x, order[view == k], near, known[view == k]) for k, x in enumerate(each)]
    for off in (0.0, 0.5):
        place = np.sort(np.concatenate(each) + view * 1e6 + rng.uniform(-off, off, len(order)))
        assert (labels.settle(np.concatenate(each), order, near, known, view, place) == np.concatenate(alone)).all()


def test_a_view_of_many_labels(spark):
    """Segments in many tasks, chains that leave their surroundings, and labels without a slot."""
    rng = np.random.default_rng(5)
    near, n = 0.8 * labels.TEXT_HEIGHT, 4000
    slots = {1: rng.uniform(-30, 30, n), 2: np.arange(n) * near * 0.9, 3: rng.uniform(0, 0.5, 50)}
    slots[3][7] = np.nan
    rows = [(v, k, -float(x) / labels.SCALE * 2**0.5) for v, each in slots.items() for k, x in enumerate(each)]
    df = spark.createDataFrame(rows, "vp_id bigint, nth int, u double").withColumns({"v": F.lit(0.0), "inclination": F.lit(0.0)})
    out = labels.thin(df).withColumn("task", F.spark_partition_id()).collect()
    assert len(out) == len(rows)
    for v in slots:
        own = sorted((r.nth, r.slot, r.shown) for r in out if r.vp_id == v)
        assert {k for k, _, shown in own if shown} == fold([p for _, p, _ in own], near)
    assert all(r.shown for r in out if r.slot != r.slot)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 11)
    assert sorted((r.vp_id, r.nth, r.shown) for r in labels.thin(df).collect()) == sorted((r.vp_id, r.nth, r.shown) for r in out)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_stretches_are_those_of_the_pixels(spark):
    """Where lines of up to 1025 steps enter and leave blocks, in closed form, against every pixel; also of parts of lines."""
    rng = random.Random(8)
    ends = [(k, k, rng.randint(-700, 700), rng.randint(-700, 700)) for k in range(150)]
    lines = [(*e, e[2] + rng.choice((0, 1, -1)) * rng.randint(0, 1025), e[3] + rng.choice((0, 1, -1)) * rng.randint(0, 1025)) for e in ends]
    df = spark.createDataFrame(lines, "vp_id bigint, poi_id bigint, vlat int, vlon int, plat int, plon int")
    for side, lo, hi in ((16, "0", "__n"), (7, "0", "__n"), (64, "__n div 3", "__n - __n div 4")):
        cut = sight._split(sight._with(sight._with_line(df), __lo=lo, __hi=hi), side).select("vp_id", "__lo", "__hi", "__bi", "__bj").collect()
        got: dict = {}
        for r in cut:
            got.setdefault(r[0], []).append(tuple(r[1:]))
        for k, _, a, b, c, d in lines:
            path = walk(b, a, d, c)
            n = len(path) - 1
            first, last = (0, n) if lo == "0" else (n // 3, n - n // 4)
            want = [[k, k, path[k][1] // side, path[k][0] // side] for k in range(first, last + 1)]
            joined = [want[0]]
            for w in want[1:]:
                if w[2:] == joined[-1][2:]:
                    joined[-1][1] = w[1]
                else:
                    joined.append(w)
            assert sorted(got[k]) == [tuple(w) for w in joined]


def test_squares_decide_what_pixels_say(spark):
    """A rough raster with ridges, holes and missing blocks: lines against a walk pixel by pixel, at several sizes of squares."""
    rng = random.Random(9)
    z = {(i, j): (60.0 if i % 37 == 5 else 0.0) + rng.uniform(0, 3) for i in range(-70, 90) for j in range(-70, 90) if (i // 16, j // 16) != (-2, -3) and ((i * 7 + j * 3) % 211 or j >= 0)}
    dem = spark.createDataFrame([(a, b, h) for (a, b), h in z.items()], "ilat int, ilon int, h double")
    lines = []
    for k in range(400):
        a, b, c, d = (rng.randint(-70, 89) for _ in range(4))
        if k % 5 == 0:
            c, d = a + rng.randint(-1, 1), b + rng.randint(-1, 1)
        lines.append((k, k, a, b, c, d, None if k % 31 == 0 else z.get((a, b), 1.0) + 90.0 * (k % 3), z.get((c, d), 1.0) + 180.0 * (k % 3 == 2)))
    pairs = spark.createDataFrame(lines, "vp_id bigint, poi_id bigint, vlat int, vlon int, plat int, plon int, vh double, ph double")
    want = {}
    for k, _, a, b, c, d, vh, ph in lines:
        path, dist, seen = walk(b, a, d, c), math.hypot(d - b, c - a), []
        for j, (x, y) in enumerate(path):
            own = math.sqrt((x - b) ** 2 + (y - a) ** 2)
            if len(path) == 1:
                seen.append(False)
            elif j == 0 or own > math.sqrt((d - b) ** 2 + (c - a) ** 2) * sight.FREE_FROM:
                seen.append(True)
            elif vh is None or (y, x) not in z:
                seen.append(None)
            else:
                over = (ph - (vh + 2)) * float((d - b) * (x - b) + (c - a) * (y - a)) / dist / dist + vh + 2
                seen.append((z[y, x] - over) / own < sight.BLOCKING)
        want[k] = (len(path), False if False in seen else None if None in seen else True)
    assert {v for _, v in want.values()} == {True, False, None}
    for side, level in ((16, 4), (16, 1), (5, 3)):
        out = sight.with_sight(pairs, raster.to_blocks(dem, side), side, level).collect()
        assert {r.vp_id: (r.n_cells, r.visible) for r in out} == want
        assert any(r.n_open == 0 and r.n_cells > 20 for r in out)  # settled by squares alone


def test_crowded_cells_are_cut(spark):
    """Nine tenths of the landmarks in one cell: the same pairs, and no key with many of them."""
    rng = random.Random(6)
    spot = lambda k: (44.7 + rng.uniform(0, 0.004), 7.1 + rng.uniform(0, 0.004)) if k % 10 else (44.7 + rng.uniform(-1, 1), 7.1 + rng.uniform(-1, 1))
    poi = spark.createDataFrame([(k, *spot(k)) for k in range(3000)] + [(3000 + k, 44.7, 7.1) for k in range(200)], "poi_id bigint, lat double, lon double")
    vp = spark.createDataFrame([(k, *spot(k)) for k in range(60)] + [(60, 44.7, 7.1)], "vp_id bigint, lat double, lon double")
    ids = ["vp_id", "poi_id"]
    d = (256 // 2 - 1) / 3600
    want = vp.select("vp_id", F.col("lat").alias("a"), F.col("lon").alias("b")).join(poi, (F.abs(F.col("lat") - F.col("a")) < d + 1) & (F.col("lat") > F.col("a") - d) & (F.col("lat") < F.col("a") + d) & (F.col("lon") > F.col("b") - d) & (F.col("lon") < F.col("b") + d)).select(ids)
    for leaf in (None, 100, 20):
        got = sight.in_view(vp, poi, 256, leaf=leaf).select(ids)
        assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert want.count() > 100_000


def test_heights_around_points(spark):
    """Heights looked up once for each landmark are those at the pixels that its views ask for."""
    vp, poi, dem = (fixture(spark, DATA, f"fx_{n}") for n in ("vp", "poi", "dem"))
    poi = jobs.clean_landmarks(poi)
    vp = vp.unionByName(vp.selectExpr("vp_id + 100 as vp_id", "lat + 0.4 / 3600 as lat", "lon - 0.3 / 3600 as lon", "heading"))
    blocks = raster.to_blocks(dem)
    for variant in ("web", "sdl", "exact"):
        got = jobs.pairs_in_view(vp, poi, 64, variant, blocks)
        plain = raster.sample_heights(raster.sample_heights(jobs.pairs_in_view(vp, poi, 64, variant), blocks, "vlat", "vlon", "vh"), blocks, "plat", "plon", "ph")
        columns = ["vp_id", "poi_id", "vlat", "vlon", "plat", "plon", "vh", "ph"]
        rows = got.select(columns)
        assert rows.exceptAll(plain.select(columns)).isEmpty() and plain.select(columns).exceptAll(rows).isEmpty() and rows.where("ph is not null").count() > 100


def test_blocks_that_are_not_full(spark):
    rng = random.Random(4)
    px = [(rng.randint(-20, 20), rng.randint(-20, 20), float(k)) for k in range(500)]
    want: dict = {}
    for i, j, h in px:
        want[i, j] = min(h, want.get((i, j), h))
    got = {}
    for b in raster.to_blocks(spark.createDataFrame(px, "ilat int, ilon int, h double")).collect():
        assert len(b.h) == 256
        got |= {(b.bi * 16 + k // 16, b.bj * 16 + k % 16): h for k, h in enumerate(b.h) if h is not None}
    assert got == want


def test_pressed_keys_clamp(spark):
    codes = ["ArrowUp"] * 8 + ["ArrowDown"] * 14 + ["ArrowUp", "ArrowLeft", "Escape", "ArrowRight", "ArrowRight"]
    df = spark.createDataFrame([(k, 7, c) for k, c in enumerate(codes)], "seq bigint, device_id bigint, code string").withColumn("ts", F.timestamp_seconds("seq"))
    got = [(r.alpha, r.beta) for r in pose.from_keys(df).orderBy("seq").collect()]
    rng, pressed = random.Random(3), []
    for _ in range(500):
        pressed.append((rng.randrange(3), rng.choice(["ArrowUp", "ArrowDown", "ArrowLeft", "ArrowRight", "Escape"])))
    many = spark.createDataFrame([(k, d, c) for k, (d, c) in enumerate(pressed)], "seq bigint, device_id bigint, code string").withColumn("ts", F.timestamp_seconds("seq"))
    at, want = {d: (0.0, 90.0) for d in range(3)}, []
    for k, (d, c) in enumerate(pressed):
        a, b = at[d]
        at[d] = a + 5 * ((c == "ArrowLeft") - (c == "ArrowRight")), min(120, b + 5) if c == "ArrowUp" else max(60, b - 5) if c == "ArrowDown" else b
        want.append((d, k, *at[d]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    assert sorted(map(tuple, pose.from_keys(many).collect())) == sorted(want)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got[7] == (0, 120) and got[21] == (0, 60) and got[22] == (0, 65) and got[-1] == (-5, 65)


def test_gradient_is_that_of_neighbours(spark):
    dem = fixture(spark, DATA, "fx_dem").where("(ilat * 7 + ilon * 3) % 23 > 0")
    z = {(r.ilat, r.ilon): r.h for r in dem.collect()}
    want = sorted((i, j, h, z[i, j - 1] - z[i, j + 1], z[i + 1, j] - z[i - 1, j]) for (i, j), h in z.items() if {(i, j - 1), (i, j + 1), (i + 1, j), (i - 1, j)} <= z.keys())
    for side in (16, 7):
        assert sorted(map(tuple, raster.gradient(raster.to_blocks(dem, side), side).collect())) == want and want


def test_mosaic_is_the_filtered_raster(spark):
    dem, vp = fixture(spark, DATA, "fx_dem"), fixture(spark, DATA, "fx_vp")
    got = raster.window_mosaic(vp, raster.to_blocks(dem), 32).select("vp_id", "ilat", "ilon", "h")
    w = grid.window_range(F.col("lat"), F.col("lon"), 32)
    want = vp.join(dem, F.col("ilat").between(w["min_lat"], w["max_lat"]) & F.col("ilon").between(w["min_lon"], w["max_lon"])).select("vp_id", "ilat", "ilon", "h")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_floor_division(spark):
    df = spark.createDataFrame([(-3601,), (-1,), (0,), (3599,), (3600,)], "x int").select(grid.floor_div(F.col("x"), 3600).alias("q"))
    assert [r.q for r in df.collect()] == [-2, -1, 0, 0, 1]


def test_gradient_forms_agree(spark):
    """Both forms give the same rows on blocks with holes, without neighbours, of other types, on both sides of zero, and on none."""
    rng = np.random.default_rng(3)
    rows = []
    for bi, bj in [(-1, -1), (-1, 0), (0, -1), (0, 0), (1, 0), (5, 5), (6, 6)]:
        h = [None if x < 0.02 else float(y) for x, y in zip(rng.random(256), rng.normal(500, 90, 256), strict=True)]
        rows.append((bi, bj, [None] * 256 if bi == 6 else h))
    found = spark.createDataFrame(rows, "bi int, bj int, h array<double>")
    height = {(bi * 16 + k // 16, bj * 16 + k % 16): v for bi, bj, h in rows for k, v in enumerate(h) if v is not None}
    for of in (found, found.withColumn("h", F.col("h").cast("array<smallint>")), found.where("bi > 9")):
        one, two = (sorted(map(tuple, raster.gradient(of, form=f).collect())) for f in ("columns", "arrow"))
        assert one == two and raster.gradient(of).dtypes == raster.gradient(of, form="arrow").dtypes
        if of is found:
            around = lambda i, j: [height.get(x) for x in ((i, j), (i, j - 1), (i, j + 1), (i + 1, j), (i - 1, j))]
            want = [(i, j, a[0], a[1] - a[2], a[3] - a[4]) for i, j in height if None not in (a := around(i, j))]
            assert one == sorted(want) and len(want) > 800
