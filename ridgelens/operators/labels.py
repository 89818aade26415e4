"""Ranking, projection and thinning of landmark labels."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ridgelens.functions.grid import DELTA_Y, REF_LAT, delta_x
from ridgelens.operators.sight import EYE

SCALE, TEXT_HEIGHT = 3.2, 0.07


def label_text(name: Column, elevation: Column) -> Column:
    return F.when(elevation.isNull(), name).otherwise(F.format_string("%s (%dm)", name, elevation))


def prominence() -> Column:
    """Height over distance, the distance mixing pixels and metres; null on the viewer's own pixel and height."""
    dx, dy, dh = F.col("plon") - F.col("vlon"), F.col("plat") - F.col("vlat"), F.col("ph") - F.col("vh")
    dist = F.sqrt(dx.cast("double") * dx + dy.cast("double") * dy + dh * dh)
    return F.when(dist > 0, dh / dist)


def ranked(labels: DataFrame, key: Column | str, keys: tuple[str, ...] = ("vp_id",), name: str = "nth") -> DataFrame:
    """labels with their place in each view, highest key first, ties by ord."""
    order = F.col(key) if isinstance(key, str) else key
    return labels.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc_nulls_last(), "ord")))


def _turn(a: Column, b: Column, angle: Column) -> tuple[Column, Column]:
    """(a cos - b sin, a sin + b cos)."""
    return a * F.cos(angle) - b * F.sin(angle), a * F.sin(angle) + b * F.cos(angle)


def inclination() -> Column:
    """Degrees by which the horizon leans on the screen."""
    beta, gamma = F.radians("beta"), F.radians("gamma")
    return F.col("screen") + F.degrees(F.atan2(F.sin(gamma) * F.cos(beta), F.sin(beta)))


def project(labels: DataFrame, *, ref_lat: float = REF_LAT, nearest: float = 1.0) -> DataFrame:
    """labels in front of the camera with u, v (picture plane), depth and inclination.

    labels have vlat, vlon, vh, plat, plon, ph and alpha, beta, gamma, screen in degrees.  The camera stands EYE metres
    over vh; the world is turned by -alpha about z, -beta about x, -gamma about y and the screen's angle about z.
    """
    x, y, z = (F.col("plon") - F.col("vlon")) * delta_x(ref_lat), (F.col("plat") - F.col("vlat")) * DELTA_Y, F.col("ph") - F.col("vh") - EYE
    d = labels.withColumns({"__x": x, "__y": y, "__z": z})

    def step(d: DataFrame, a: str, b: str, angle: Column) -> DataFrame:
        p, q = _turn(F.col(a), F.col(b), angle)
        return d.withColumns({a: p, b: q})

    for a, b, angle in (("__x", "__y", -F.radians("alpha")), ("__y", "__z", -F.radians("beta")), ("__z", "__x", -F.radians("gamma")), ("__x", "__y", F.radians("screen"))):
        d = step(d, a, b, angle)
    d = d.withColumn("depth", -F.col("__z")).where(F.col("depth") > nearest)
    return d.withColumns({"u": F.col("__x") / F.col("depth"), "v": F.col("__y") / F.col("depth"), "inclination": inclination()}).drop("__x", "__y", "__z")


def project_yaw(labels: DataFrame, *, heading: str = "heading", ref_lat: float = REF_LAT) -> DataFrame:
    """labels in front of a level camera that only turns, with u, v and depth."""
    x, south, a = (F.col("plon") - F.col("vlon")) * delta_x(ref_lat), (F.col("vlat") - F.col("plat")) * DELTA_Y, F.radians(heading)
    side, depth = x * F.cos(a) + south * F.sin(a), -(south * F.cos(a) - x * F.sin(a))
    return labels.withColumns({"depth": depth, "__s": side}).where(F.col("depth") > 0).withColumns({"u": F.col("__s") / F.col("depth"), "v": (F.col("ph") - F.col("vh")) / F.col("depth")}).drop("__s")


def on_screen(labels: DataFrame, aspect: Column) -> DataFrame:
    """labels with sx, sy."""
    return labels.withColumns({"sx": F.col("u") * F.when(aspect < 1, SCALE / aspect).otherwise(SCALE), "sy": F.col("v") * F.when(aspect < 1, SCALE).otherwise(aspect * SCALE)})


def slot(variant: str = "web") -> Column:
    """Where a slanted label stands among the others."""
    if variant == "sdl":
        return SCALE * (F.col("u") - F.col("v")) / math.sqrt(2)
    angle = F.radians("inclination") + math.pi / 4
    return SCALE * (F.col("v") * F.cos(angle) - F.col("u") * F.sin(angle))


#: Thresholds in a segment of a view's slots, and those by which it looks into its neighbours.
SEGMENT, HALO = 32, 8


def _least(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of values[left[i] : right[i] + 1], by minima of runs of 1, 2, 4, ... values."""
    width = right - left + 1
    level = np.frexp(width)[1] - 1
    out, runs = np.empty(len(left), values.dtype), values
    for k in range(int(level.max(initial=0)) + 1):
        own = level == k
        out[own] = np.minimum(runs[left[own]], runs[right[own] - (1 << k) + 1])
        if len(runs) > 1 << k:
            runs = np.minimum(runs[: -(1 << k)], runs[1 << k :])
    return out


def settle(slot: np.ndarray, order: np.ndarray, near: float, known: np.ndarray, view: np.ndarray | None = None, place: np.ndarray | None = None) -> np.ndarray:
    """1 (shown), -1 (left out) or 0 (open) for labels sorted by slot; order: their ranks, no two equal.

    view: labels of many views at once, sorted by view and slot; only those of one view meet.  place: about where a label
    stands in all, ascending, slots of one view as far apart as they are (left out: the slot); it only shortens the search.

    In a round, a label that comes before all open ones nearer than `near` shows, and those near it go; rounds go on
    until nothing changes.  A label's fate is that of one pass in order of rank, since it hangs only on labels of earlier
    rank near it.  known: all labels near it are here; others can only go, so what hangs on labels elsewhere stays open.
    """
    out, at = np.zeros(len(slot), np.int8), np.arange(len(slot))
    view, place = np.zeros(len(slot), np.int8) if view is None else view, slot if place is None else place
    while len(at):
        s, r, v, p, own = slot[at], order[at], view[at], place[at], np.arange(len(at))
        first, last = np.searchsorted(v, v), np.searchsorted(v, v, "right") - 1
        left, right = np.clip(np.searchsorted(p, p - near), first, own), np.clip(np.searchsorted(p, p + near, "right") - 1, own, last)
        while (x := s - s[left] >= near).any():  # the difference itself decides, not rounded bounds
            left[x] += 1
        while (x := (left > first) & (s - s[left - 1] < near)).any():
            left[x] -= 1
        while (x := s[right] - s >= near).any():
            right[x] -= 1
        while (x := (right < last) & (s[np.minimum(right + 1, len(s) - 1)] - s < near)).any():
            right[x] += 1
        leads = known[at] & (_least(r, left, right) == r)
        if not leads.any():
            break
        before = np.concatenate([[0], np.cumsum(leads)])
        goes = ~leads & (before[right + 1] > before[left])
        out[at[leads]], out[at[goes]] = 1, -1
        at = at[~leads & ~goes]
    return out


def _settled(d: DataFrame, keys: tuple[str, ...], nth: str, near: float) -> DataFrame:
    """d with shown, null where a label hangs on labels too far off.

    A view's slots are cut into segments, which go to different tasks; a segment also gets its neighbours' labels within HALO thresholds.
    """
    width, halo = SEGMENT * near, HALO * near
    placed = F.col("slot").isNotNull() & ~F.isnan("slot")
    own = F.when(placed, F.floor(F.col("slot") / width)).otherwise(0).cast("long")
    before, after = F.when(placed & (F.col("slot") < own * width + halo), own - 1), F.when(placed & (F.col("slot") >= (own + 1) * width - halo), own + 1)
    e = d.withColumns({"__own": own, "__seg": F.explode(F.array_compact(F.array(own, before, after)))}).withColumn("__view", F.xxhash64(*keys, "__seg"))
    schema, names = StructType([*d.schema, StructField("shown", BooleanType())]), d.columns

    def decide(t: pa.Table) -> list[pa.RecordBatch]:
        """Whole segments of views, all of them at once."""
        slot, seg, view = t.column("slot").to_numpy(), t.column("__seg").to_numpy(), t.column("__view").to_numpy()
        out, real = np.ones(len(slot), np.int8), np.flatnonzero(slot == slot)
        s, rank, own = slot[real], t.column(nth).to_numpy()[real], seg[real]
        run = np.cumsum(np.concatenate([[0], view[1:] != view[:-1]]))[real]
        place = run * 2 * (width + 2 * halo) + np.clip(s - own * width, -halo, width + halo)
        order = np.empty(len(real), np.int64)
        order[np.argsort(rank, kind="stable")] = np.arange(len(real))
        inner = near * (1 + 1e-6)
        out[real] = settle(s, order, near, (s - (own * width - halo) > inner) & ((own + 1) * width + halo - s > inner), run, place)
        mine = t.column("__own").to_numpy() == seg
        kept = t.filter(pa.array(mine)).select(names).append_column("shown", pa.array(out[mine] == 1, mask=out[mine] == 0))
        return kept.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            view = b.column("__view").to_numpy()
            cut = int(np.searchsorted(view, view[-1]))  # where the last segment begins, which may go on
            if cut or held and held[-1].column("__view")[-1].as_py() != view[0]:
                yield from decide(pa.Table.from_batches([*held, b.slice(0, cut)]))
                held = []
            held.append(b.slice(cut))
        if held:
            yield from decide(pa.Table.from_batches(held))

    return e.repartition(*keys, "__seg").sortWithinPartitions("__view", "slot", nth).mapInArrow(run, schema)


def _folded(d: DataFrame, keys: tuple[str, ...], nth: str, near: float) -> DataFrame:
    """d with shown, by one pass over each view's labels in order, of which only the slots of shown ones are remembered."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        view, at = None, []
        for f in frames:
            shown = []
            for now, p in zip(f[list(keys)].itertuples(index=False, name=None), f["slot"], strict=True):
                if now != view:
                    view, at = now, []
                k = bisect_left(at, p)
                free = not any(abs(q - p) < near for q in at[max(0, k - 1) : k + 1])
                shown.append(free)
                if free:
                    at.insert(k, p)
            yield f.assign(shown=shown)

    return d.repartition(*keys).sortWithinPartitions(*keys, nth).mapInPandas(fold, StructType([*d.schema, StructField("shown", BooleanType())]))


def thin(labels: DataFrame, *, variant: str = "web", keys: tuple[str, ...] = ("vp_id",), nth: str = "nth") -> DataFrame:
    """labels with slot and shown: in order of nth, a label shows if no shown one is nearer than the text's height.

    web marks the others (threshold 0.8 of the height), sdl drops them.  A view's labels are dealt by segments of the
    slots and settled there in rounds, many at a time, so a view of very many labels takes many tasks.  Labels that hang
    on a chain of others longer than a segment's surroundings stay open; only these meet in one pass for each view.  A
    label without a slot shows.  Labels of one view have different nth.
    """
    near = TEXT_HEIGHT if variant == "sdl" else 0.8 * TEXT_HEIGHT
    first = _settled(labels.withColumn("slot", slot(variant)), keys, nth, near)
    out = first.where(F.col("shown").isNotNull()).unionByName(_folded(first.where(F.col("shown").isNull()).drop("shown"), keys, nth, near))
    return out.where("shown") if variant == "sdl" else out
