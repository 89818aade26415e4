"""Device orientation as a table or a stream: the same functions serve both where Spark allows it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ORIENTATION = "event_id bigint, device_id bigint, ts timestamp, alpha double, beta double, gamma double, screen double"
KEYS = "seq bigint, device_id bigint, ts timestamp, code string"
ANGLES = ["alpha", "beta", "gamma", "screen"]
START = (0.0, 90.0, 0.0, 0.0)
STEP, LOWEST, HIGHEST = 5.0, 60.0, 120.0


def read_stream(spark: SparkSession, path: str, schema: str = ORIENTATION, **options: str) -> DataFrame:
    """Event files of a folder as a stream."""
    return spark.readStream.schema(schema).options(**options).parquet(path)


def latest(samples: DataFrame) -> DataFrame:
    """The last sample of each device, by time and id; as a stream, in update or complete mode."""
    last = F.max_by(F.struct("ts", *ANGLES), F.struct("ts", "event_id")).alias("s")
    return samples.groupBy("device_id").agg(last).select("device_id", "s.*")


def frames(samples: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """The last sample of each device in each frame.  late: how long a stream waits for late samples."""
    s = samples.withWatermark("ts", late) if late else samples
    last = F.max_by(F.struct(*ANGLES), F.struct("ts", "event_id")).alias("s")
    return s.groupBy("device_id", F.window("ts", width).alias("w")).agg(last).select("device_id", F.col("w.start").alias("frame_start"), "s.*")


def changes(samples: DataFrame) -> DataFrame:
    """Samples that differ from the one before of their device; the first always."""
    w = Window.partitionBy("device_id").orderBy("ts", "event_id")
    now = F.struct(*ANGLES)
    return samples.withColumns({"__before": F.lag(now).over(w), "__nth": F.row_number().over(w)}).where((F.col("__nth") == 1) | ~now.eqNullSafe(F.col("__before"))).drop("__before", "__nth")


#: Where state of transformWithState is kept.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LAST = "at bigint, event_id bigint, " + ", ".join(f"{a} double" for a in ANGLES)
#: A sample's time goes to a processor in microseconds, as a frame of times is slow to make for each device; a null time as NEVER.
TIMED, NEVER = ORIENTATION.replace("ts timestamp", "at bigint"), -(2**63)


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema: str, idle: int | None, initial: DataFrame | None) -> DataFrame:
    """rows by device through a processor; idle: milliseconds after which the state of a silent device goes."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    first = initial.groupBy("device_id") if initial is not None else None
    return rows.groupBy("device_id").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if idle else "None", first)


class _Changes(StatefulProcessor):
    """Emits samples that differ from the one before; state: time, id and angles of a device's last sample."""

    def __init__(self, idle: int | None):
        self.idle = idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST, self.idle)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        r = initialState.sort_values(["ts", "event_id"]).iloc[-1]
        self.last.update((int(r.ts.value // 1000), int(r.event_id), *(None if pd.isna(r[a]) else float(r[a]) for a in ANGLES)))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        parts = list(rows)
        r = parts[0] if len(parts) == 1 else pd.concat(parts)
        at, ids = r["at"].to_numpy(), r["event_id"].to_numpy()
        order = np.lexsort((ids, at, at == NEVER))
        at, ids = at[order], ids[order]
        before = self.last.get() if self.last.exists() else None
        if before is not None:  # what is not newer than the last sample is late
            new = (at > before[0]) | ((at == before[0]) & (ids > before[1]))
            order, at, ids = order[new], at[new], ids[new]
        if not len(order):
            return
        now = r[ANGLES].to_numpy(float)[order]
        was = np.vstack([np.full((1, len(ANGLES)), np.nan) if before is None else np.array([before[2:]], float), now[:-1]])
        differs = ((now != was) & ~(np.isnan(now) & np.isnan(was))).any(1)
        differs[0] |= before is None
        self.last.update((int(at[-1]), int(ids[-1]), *(None if np.isnan(x) else float(x) for x in now[-1])))
        yield r.iloc[order[differs]]

    def close(self) -> None:
        pass


def changes_stream(samples: DataFrame, *, idle: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """changes() of a stream: each device's last sample is kept as state; samples not newer than it are late and dropped.

    idle: a device that sends nothing for so many milliseconds is forgotten, and its next sample counts as a first one;
    such a stream looks for what is idle in batch after batch, so it does not end by itself when its input does.
    initial: a table of samples (event_id, device_id, ts, ANGLES) to start from, the last of each device counts; these are not emitted.
    """
    at = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), F.lit(NEVER)).alias("at")
    first = initial.select("event_id", "device_id", "ts", *ANGLES) if initial is not None else None
    changed = _stateful(samples.select("event_id", "device_id", at, *ANGLES), _Changes(idle), TIMED, idle, first)
    return changed.select("event_id", "device_id", F.when(F.col("at") != NEVER, F.timestamp_micros("at")).alias("ts"), *ANGLES)


POSES = "device_id bigint, seq bigint, alpha double, beta double"


def _after(codes: np.ndarray, first: np.ndarray, start: tuple[float, float], pose: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, beta) after each press of presses in order; first marks those before which the pose is start, not the last one.

    A press takes x to min(high, max(low, x + step)), and so does one press after another, so runs of presses are
    combined in twice as long ones until each holds all before it.
    """
    out = []
    for axis, (more, less), (low, high) in ((0, ("ArrowLeft", "ArrowRight"), (-np.inf, np.inf)), (1, ("ArrowUp", "ArrowDown"), (LOWEST, HIGHEST))):
        step = STEP * (codes == more) - STEP * (codes == less)
        lows, highs = np.where(codes == less, low, -np.inf), np.where(codes == more, high, np.inf)
        fixed = np.minimum(highs, np.maximum(lows, start[axis] + step))
        lows, highs = np.where(first, fixed, lows), np.where(first, fixed, highs)
        d = 1
        while d < len(codes):
            a, b = np.clip(lows[:-d] + step[d:], lows[d:], highs[d:]), np.clip(highs[:-d] + step[d:], lows[d:], highs[d:])
            step = np.concatenate([step[:d], step[:-d] + step[d:]])
            lows, highs, d = np.concatenate([lows[:d], a]), np.concatenate([highs[:d], b]), 2 * d
        out.append(np.minimum(highs, np.maximum(lows, pose[axis] + step)))
    return out[0], out[1]


def from_keys(keys: DataFrame, start: tuple[float, float] = START[:2]) -> DataFrame:
    """(device_id, seq, alpha, beta) after each key press, by time and seq.

    Devices are dealt by id and their presses streamed in order, so no device's history is held.
    """

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        device, pose = None, start
        for p in parts:
            if len(p):
                ids = p.device_id.to_numpy()
                first = np.concatenate([[device is None or ids[0] != device], ids[1:] != ids[:-1]])
                alpha, beta = _after(p.code.to_numpy(), first, start, pose)
                device, pose = ids[-1], (alpha[-1], beta[-1])
                yield pd.DataFrame({"device_id": ids, "seq": p.seq, "alpha": alpha, "beta": beta})

    ordered = keys.repartition("device_id").sortWithinPartitions("device_id", "ts", "seq")
    return ordered.select("device_id", "seq", "code").mapInPandas(fold, POSES)


class _Pressed(StatefulProcessor):
    """Emits the pose after each key press; state: a device's pose."""

    def __init__(self, start: tuple[float, float], idle: int | None):
        self.start, self.idle = start, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pose = handle.getValueState("pose", "alpha double, beta double", self.idle)

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: object) -> None:
        self.pose.update((float(initialState.alpha.iloc[-1]), float(initialState.beta.iloc[-1])))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        r = pd.concat(list(rows)).sort_values(["ts", "seq"])
        pose = self.pose.get() if self.pose.exists() else self.start
        alpha, beta = _after(r.code.to_numpy(), np.zeros(len(r), bool), self.start, pose)
        self.pose.update((float(alpha[-1]), float(beta[-1])))
        yield pd.DataFrame({"device_id": key[0], "seq": r.seq, "alpha": alpha, "beta": beta})

    def close(self) -> None:
        pass


def from_keys_stream(keys: DataFrame, start: tuple[float, float] = START[:2], *, idle: int | None = None, initial: DataFrame | None = None) -> DataFrame:
    """from_keys() of a stream: the pose of each device is kept as state.

    idle: as in changes_stream(); a forgotten device begins again at start.  initial: a table (device_id, alpha, beta) of
    poses to begin with, one for a device.
    """
    return _stateful(keys.select("device_id", "ts", "seq", "code"), _Pressed(start, idle), POSES, idle, initial.select("device_id", "alpha", "beta") if initial is not None else None)
