"""A membership filter of bounded size for 64-bit hashes, built by Spark and small enough to broadcast at any scale."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgelens.llm.words import U64, mix

#: 256 parts; bits for each hash wanted; exponents of the least and most bits of a part: 64 MB at most, whatever the number
#: of hashes.  A hash sets three bits of its part.
PARTS, ROOM, LEAST, MOST = 256, 14, 12, 21


def _bits(h: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    x = mix(h ^ U64(0x5851F42D4C957F2D))
    low = U64((1 << bits) - 1)
    return (x & U64(PARTS - 1)).astype(np.int64), [((x >> U64(s)) & low).astype(np.int64) for s in (8, 25, 43)]


def build_filter(df: DataFrame, column: str) -> Broadcast:
    """A broadcast boolean table that holds the hashes of a bigint column of df.

    Hashes go to the parts they belong to, so each part is made in one task and only the parts reach the driver: 2 bytes
    for each hash, up to 64 MB.  passes() never misses a hash that is in df; beyond that size it lets others through the
    more often, up to all of them: a filter before an exact step, not a decision.  df is counted first.
    """
    bits = min(MOST, max(LEAST, (ROOM * df.count() // PARTS).bit_length()))

    def parts(batches):
        made: dict[int, np.ndarray] = {}
        for b in batches:
            part, places = _bits(b.column("h").to_numpy(zero_copy_only=False).view(U64), bits)
            for k in np.unique(part):
                own = made.setdefault(int(k), np.zeros(1 << bits, bool))
                for x in places:
                    own[x[part == k]] = True
        keys = sorted(made)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([np.packbits(made[k]).tobytes() for k in keys], pa.binary())], names=["part", "bits"])

    def part_of(batches):
        for b in batches:
            part, _ = _bits(b.column("h").to_numpy(zero_copy_only=False).view(U64), bits)
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array(part, pa.int64())], names=["h", "part"])

    rows = df.select(F.col(column).alias("h")).where(F.col("h").isNotNull()).mapInArrow(part_of, "h bigint, part bigint").repartition("part").mapInArrow(parts, "part int, bits binary").collect()
    table = np.zeros((PARTS, 1 << (bits - 3)), np.uint8)
    for part, raw in rows:
        table[part] = np.frombuffer(raw, np.uint8)
    return df.sparkSession.sparkContext.broadcast(table)


def passes(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the filter."""
    part, places = _bits(h, table.shape[1].bit_length() + 2)
    ok = np.ones(len(h), bool)
    for x in places:
        ok &= (table[part, x >> 3] >> (7 - (x & 7)).astype(np.uint8)) & 1 == 1
    return ok
