"""Lines of sight between viewpoints and landmarks over a raster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelens.functions.grid import BLOCK, STEPS, floor_div

#: Metres of the eye over the ground; share of a line after which nothing blocks; slope that blocks, in metres a pixel.
EYE, FREE_FROM, BLOCKING = 2.0, 0.94, 0.1
#: Blocks a side of a square of the coarse pass; metres by which a bound must hold, so that rounding decides nothing.
LEVEL, MARGIN = 4, 0.000001
#: What tells lines apart.
ENDS = ["vp_id", "poi_id", "vlat", "vlon", "plat", "plon", "vh", "ph"]


#: Times a dense cell is cut into 4 x 4, at most.
DEPTH = 4


def in_view(viewpoints: DataFrame, landmarks: DataFrame, size: int, *, leaf: int | None = None) -> DataFrame:
    """Pairs of a viewpoint and the landmarks strictly inside its box of (size / 2 - 1) arc-seconds each way.

    landmarks (poi_id, lat, lon, ...) are joined on a grid of cells as wide as the box: each viewpoint is sent to the
    cells its box touches, so the join is on equal cells, and the exact box is checked behind it.  Columns of
    viewpoints that landmarks have too get the prefix vp_.

    leaf: for landmarks that crowd in places, landmarks a cell may hold before it is cut into 4 x 4, and these again,
    DEPTH times at most; viewpoints go to the parts that their box touches, so a crowded cell is as many keys.  Landmarks
    are counted for that first; which cells are full is known to each row by joins with these, fewer than landmarks / leaf.
    """
    d = (size // 2 - 1) / STEPS
    step = max(2 * d, 1 / STEPS)
    v = viewpoints.select(*[F.col(c).alias(c if c == "vp_id" or c not in landmarks.columns else f"vp_{c}") for c in viewpoints.columns])
    lat, lon = ("vp_lat" if "vp_lat" in v.columns else "lat"), ("vp_lon" if "vp_lon" in v.columns else "lon")
    cell = lambda c, level: f"cast(floor(({c}) / {step / 4**level!r}D) as int)"
    touched = lambda c, level: f"explode(sequence({cell(f'{c} - {d!r}D', level)}, {cell(f'{c} + {d!r}D', level)}))"
    p = _with(landmarks, __i=cell("lat", 0), __j=cell("lon", 0))
    v = v.withColumn("__i", F.expr(touched(lat, 0))).withColumn("__j", F.expr(touched(lon, 0)))
    on = ["__i", "__j"]
    if leaf:
        levels = [f"struct({k} as level, {cell('lat', k)} as i, {cell('lon', k)} as j)" for k in range(DEPTH)]
        full = landmarks.selectExpr(f"inline(array({', '.join(levels)}))").groupBy("level", "i", "j").count().where(F.col("count") > leaf)
        on, p, v = [*on, "__level"], p.withColumn("__level", F.lit(0)), v.withColumn("__level", F.lit(0))
        for k in range(DEPTH):  # rows in full cells of a level go on to the next one
            these = full.where(F.col("level") == k).select(F.col("i").alias("__i"), F.col("j").alias("__j"), F.lit(k).alias("__level"), F.lit(True).alias("__full"))
            p = _with(p.join(these, on, "left"), __i=f"if(__full, {cell('lat', k + 1)}, __i)", __j=f"if(__full, {cell('lon', k + 1)}, __j)", __level=f"if(__full, {k + 1}, __level)").drop("__full")
            cut = lambda own, c: f"filter(if(__full, sequence({cell(f'{c} - {d!r}D', k + 1)}, {cell(f'{c} + {d!r}D', k + 1)}), array({own})), x -> not coalesce(__full, false) or floor(x / 4D) = {own})"  # noqa: B023, E731
            v = _with(v.join(these, on, "left"), __level=f"if(__full, {k + 1}, __level)", __rows=cut("__i", lat), __cols=cut("__j", lon))
            v = v.withColumn("__i", F.explode("__rows")).withColumn("__j", F.explode("__cols")).drop("__rows", "__cols", "__full")
    inside = f"lat > {lat} - {d!r}D and lat < {lat} + {d!r}D and lon > {lon} - {d!r}D and lon < {lon} + {d!r}D"
    return v.join(p, on).where(inside).drop(*on)


def _with(d: DataFrame, **columns: str) -> DataFrame:
    """d with columns given in SQL, which is read in one go where many small expressions are not."""
    return d.withColumns({k: F.expr(v) for k, v in columns.items()})


def _with_line(pairs: DataFrame) -> DataFrame:
    """pairs with what a line's pixels follow from: steps n (and m, one at least, for divisions), extents and directions."""
    d = _with(pairs, __rise="abs(plat - vlat)", __run="abs(plon - vlon)", __up="cast(sign(plat - vlat) as int)", __right="cast(sign(plon - vlon) as int)")
    return _with(d, __n="greatest(__rise, __run)", __m="cast(greatest(__rise, __run, 1) as bigint)")


def _part(k: str, extent: str) -> str:
    """Pixels by which a line's k-th step has moved along an axis, halves away from the viewer."""
    return f"cast((2 * ({k}) * cast({extent} as bigint) + __m) div (2 * __m) as int)"


def sight_line_cells(pairs: DataFrame) -> DataFrame:
    """(vp_id, poi_id, k, n, ilat, ilon) for each pixel of the line from (vlat, vlon) to (plat, plon), both ends in."""
    p = _with_line(pairs.select("vp_id", "poi_id", "vlat", "vlon", "plat", "plon")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("__n"))))
    return p.selectExpr("vp_id", "poi_id", "k", "__n as n", f"vlat + __up * {_part('k', '__rise')} as ilat", f"vlon + __right * {_part('k', '__run')} as ilon")


def _distance(ilat: str, ilon: str) -> str:
    """Pixels from the viewer."""
    return f"sqrt(cast({ilon} - vlon as double) * ({ilon} - vlon) + cast({ilat} - vlat as double) * ({ilat} - vlat))"


#: Length of a line in pixels, one at least: shorter ones are no lines, and only divisions see it.
LENGTH = f"greatest({_distance('plat', 'plon')}, 1D)"


def _over(ilat: str, ilon: str) -> str:
    """Height of the line over a pixel."""
    return f"(ph - (vh + {EYE}D)) * cast((plon - vlon) * ({ilon} - vlon) + (plat - vlat) * ({ilat} - vlat) as double) / __d / __d + (vh + {EYE}D)"


def _split(stretches: DataFrame, side: int) -> DataFrame:
    """Stretches (__lo to __hi, steps of a line) cut where the line enters another block of this side, with the block (__bi, __bj).

    An axis is o pixels from the viewer for the first time at step ceil(n (2 o - 1) / (2 extent)), so the steps at
    which a line enters blocks follow from how many sides of blocks lie between its ends: a row is made for each block,
    none for a pixel.
    """
    passed = lambda o, f: f"cast(case when {o} >= {f} then ({o} - {f}) div {side} + 1 else 0 end as int)"
    enter = lambda t, f, extent: f"cast((__m * (2 * ({f} + {side} * ({t})) - 1) + 2 * {extent} - 1) div (2 * greatest({extent}, 1)) as int)"
    first = lambda way, own, block: f"case when {way} > 0 then ({block} + 1) * {side} - {own} else {own} - {block} * {side} + 1 end"
    leave = lambda t, f, extent: f"case when {extent} > 0 then {enter(t, f, extent)} - 1 end"
    # the viewer's block, and on each axis pixels to the first one in the next block (f) and moved at both ends of the stretch
    d = _with(stretches, __bi0=f"cast(floor(vlat / {side}) as int)", __bj0=f"cast(floor(vlon / {side}) as int)", __o=_part("__lo", "__rise"), __p=_part("__lo", "__run"), __o1=_part("__hi", "__rise"), __p1=_part("__hi", "__run"))
    d = _with(d, __fi=first("__up", "vlat", "__bi0"), __fj=first("__right", "vlon", "__bj0"))
    d = _with(d, __ti=passed("__o", "__fi"), __tj=passed("__p", "__fj"), __ci=f"{passed('__o1', '__fi')} - {passed('__o', '__fi')}", __cj=f"{passed('__p1', '__fj')} - {passed('__p', '__fj')}")
    d = _with(d, __t="explode(sequence(0, __ci + __cj))")
    d = _with(d, __lo=f"case when __t = 0 then __lo when __t <= __ci then {enter('__ti + __t - 1', '__fi', '__rise')} else {enter('__tj + __t - 1 - __ci', '__fj', '__run')} end", __lat="__t <= __ci")
    d = _with(d, __ti=passed(_part("__lo", "__rise"), "__fi"), __tj=passed(_part("__lo", "__run"), "__fj"), __tw=passed(_part("__lo - 1", "__rise"), "__fi"))
    d = d.where("__lat or __tw = __ti")  # where both axes enter, one row
    d = _with(d, __hi=f"least(__hi, {leave('__ti', '__fi', '__rise')}, {leave('__tj', '__fj', '__run')})", __bi="__bi0 + __up * __ti", __bj="__bj0 + __right * __tj")
    return d.drop("__bi0", "__bj0", "__fi", "__fj", "__o", "__p", "__o1", "__p1", "__ti", "__tj", "__ci", "__cj", "__t", "__lat", "__tw")


def _with_bounds(lines: DataFrame) -> DataFrame:
    """lines with what STATE needs: length, eye, rise for a step, pixels for a step, and how far half a pixel off the straight line puts the line's height."""
    return _with(_with(lines, __d=LENGTH), __eye=f"vh + {EYE}D", __rate=f"(ph - vh - {EYE}D) / __m", __u="__d / __m", __off=f"abs(ph - vh - {EYE}D) * 0.5D / __d")


def _state() -> str:
    """Of a stretch, by its block's heights (__top, __bottom, __full) alone: 1 (every pixel is clear), 0 (one blocks), or null (open).

    A line's pixels lie within half a pixel of the straight line, so k steps from the viewer its height is eye + k rate,
    give or take off, and the distance k u, give or take 0.5.  Clear: nothing from FREE_FROM on blocks, nor does the
    viewer's own pixel, nor a block whose top stays under the line's lower end.  Blocked: the bottom stands over the
    line at the stretch's start.
    """
    start = "greatest(__lo, 1)"
    free = f"__hi = 0 or {start} * __u - 0.5D > __d * {FREE_FROM}D"
    under = f"__top + __off + {MARGIN}D < least(__eye + __rate * {start}, __eye + __rate * __hi) + ({start} * __u - 0.5D) * {BLOCKING}D"
    over = f"__bottom - __off - {MARGIN}D >= __eye + __rate * {start} + ({start} * __u + 0.5D) * {BLOCKING}D and {start} * __u + 0.5D < __d * {FREE_FROM}D"
    return f"case when {free} or (__full and {under}) then 1 when __full and {over} then 0 end"


#: Whether a pixel lets the line pass: its height __z, __own pixels from the viewer, the line at __over; null where __z is null.
CLEAR = f"case when __n = 0 then false when __k = 0 then true when __own > __d * {FREE_FROM}D then true else (__z - __over) / __own < {BLOCKING}D end"


def height_pyramid(blocks: DataFrame, level: int = LEVEL, side: int = BLOCK) -> DataFrame:
    """(bi, bj, top, bottom, full) of squares of `level` blocks each way, for the coarse pass of with_sight(); full: no height is missing."""
    own = blocks.selectExpr("bi", "bj", "array_max(h) as top", "array_min(h) as bottom", f"size(array_compact(h)) = {side * side} as full")
    up = own.groupBy(floor_div(F.col("bi"), level).alias("bi"), floor_div(F.col("bj"), level).alias("bj"))
    return up.agg(F.expr("cast(max(top) as double) as top"), F.expr("cast(min(bottom) as double) as bottom"), F.expr(f"bool_and(full) and count(*) = {level * level} as full"))


def coarse_sight(pairs: DataFrame, pyramid: DataFrame, level: int = LEVEL, side: int = BLOCK) -> DataFrame:
    """(ENDS, n, hidden, lo, hi) of each pair: whether a square's bottom hides it, and from where to where squares do not decide, else null.

    Lines are few bytes and much work, so they are first dealt over all of the session's shuffle partitions.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines = _with_bounds(_with_line(pairs.select(*ENDS).repartition(parts, "vp_id", "poi_id")))
    whole = _split(_with(lines, __lo="0", __hi="__n"), side * level)
    p = pyramid.toDF(*[f"__{c}" for c in pyramid.columns])
    met = _with(whole.join(p, ["__bi", "__bj"], "left"), __state=_state())
    return met.groupBy(*ENDS, "__n").agg(F.expr("min(__state) = 0 as hidden"), F.expr("min(case when __state is null then __lo end) as lo"), F.expr("max(case when __state is null then __hi end) as hi")).withColumnRenamed("__n", "n")


def with_sight(pairs: DataFrame, blocks: DataFrame, side: int = BLOCK, level: int = LEVEL) -> DataFrame:
    """(ENDS, n_cells, n_open, visible) of pairs (vlat, vlon, plat, plon and heights vh, ph; vp_id and poi_id tell them apart, and rows equal in all these are one).

    Visible if all pixels are clear; hidden if one blocks; null (unknown) if none blocks but a pixel that could is
    missing, or an end's height is.  A pair on one pixel is not visible.  Lines meet squares of level x level blocks
    first, by their largest and least heights: many are clear or hidden by these and stop there.  Of the others, the
    part between the first and the last undecided square is cut into blocks, n_open of them, and meets these, again by their bounds
    first and then pixel by pixel.  Lines travel as ids and ends, a row for each block, and no pixel is made a row
    before its block is there.
    """
    coarse = coarse_sight(pairs, height_pyramid(blocks, level, side), level, side)
    rest = coarse.selectExpr(*ENDS, "coalesce(hidden, false) as __hidden", "coalesce(hidden, false) or lo is null as __done", "lo", "hi").selectExpr(*ENDS, "__hidden", "__done", "if(__done, 0, lo) as __lo", "if(__done, 0, hi) as __hi")
    own = blocks.selectExpr("bi as __bi", "bj as __bj", "h as __h", "cast(array_max(h) as double) as __top", "cast(array_min(h) as double) as __bottom", f"size(array_compact(h)) = {side * side} as __full")
    met = _with(_split(_with_bounds(_with_line(rest)), side).join(own, ["__bi", "__bj"], "left"), __state=_state())
    each = _with(met, __k="explode(case when __state is null then sequence(__lo, __hi) else array(__lo) end)")
    each = _with(each, __i=f"vlat + __up * {_part('__k', '__rise')}", __j=f"vlon + __right * {_part('__k', '__run')}")
    each = _with(each, __z=f"cast(get(__h, (__i - __bi * {side}) * {side} + __j - __bj * {side}) as double)", __own=_distance("__i", "__j"), __over=_over("__i", "__j"))
    tested = each.selectExpr(*ENDS, "__n", "__hidden", f"case when __state is not null then __state = 1 else {CLEAR} end as __clear", "if(__k = __lo and not __done, 1L, 0L) as __first")
    seen = tested.groupBy(*ENDS, "__n", "__hidden").agg(F.expr("sum(__first) as n_open"), F.expr("bool_and(__clear) as every"), F.expr("bool_or(__clear is null) as unknown"))
    return seen.selectExpr(*ENDS, "cast(__n + 1 as bigint) as n_cells", "n_open", "case when __hidden or __n = 0 or not every then false when not unknown then true end as visible")


def line_of_sight(pairs: DataFrame, blocks: DataFrame, side: int = BLOCK, level: int = LEVEL) -> DataFrame:
    """(vp_id, poi_id, n_cells, visible) of pairs, as with_sight() tells it."""
    return with_sight(pairs, blocks, side, level).select("vp_id", "poi_id", "n_cells", "visible")


def visible_landmarks(pairs: DataFrame, blocks: DataFrame, side: int = BLOCK, level: int = LEVEL) -> DataFrame:
    """pairs that can see each other: what else they hold stays out of the lines' way and meets the visible ones by id."""
    return pairs.join(with_sight(pairs, blocks, side, level).where("visible").select("vp_id", "poi_id"), ["vp_id", "poi_id"], "left_semi").select(*pairs.columns)


def sight_work(pairs: DataFrame, blocks: DataFrame, side: int = BLOCK, level: int = LEVEL) -> DataFrame:
    """(vp_id, poi_id, n_blocks, n_open): the blocks that each line crosses, and those it had to meet."""
    crossed = _split(_with(_with_line(pairs.select(*ENDS)), __lo="0", __hi="__n"), side).groupBy("vp_id", "poi_id").agg(F.count("*").alias("n_blocks"))
    return with_sight(pairs, blocks, side, level).select("vp_id", "poi_id", "n_open").join(crossed, ["vp_id", "poi_id"])
