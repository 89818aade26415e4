"""Connected components of links between ids, by alternating stars."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ridgelens.llm.common import drop_stage, join_hot, stage

#: Up to so many links (a few MB) one task works out: dealing them out in rounds costs more than it saves.
FEW = 200_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(id, label) of FEW links at most, u > v."""

    def run(batches):
        parts = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
        if not parts:
            return
        ids, at = np.unique(np.concatenate([x for part in zip(*parts, strict=True) for x in part]), return_inverse=True)
        u, v = np.split(at, 2)
        label, before = np.arange(len(ids)), None
        while before is None or (label != before).any():
            before = label.copy()
            low = np.minimum(label[u], label[v])
            for end in (u, v):  # the smaller root takes the larger one
                np.minimum.at(label, before[end], low)
            while (label != label[label]).any():
                label = label[label]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], names=["id", "label"])

    return edges.coalesce(1).mapInArrow(run, "id bigint, label bigint")


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every id in links (a, b: bigint); label is the smallest id that links reach.

    Large and small stars in turn: every id first hands its larger neighbours, then its smaller ones, to the smallest
    of them, until each component is one star.  Every round, and the steps inside it, are written to the shared folder;
    rounds grow with the logarithm of the longest chain, and earlier rounds' tables are deleted.  Minima are combined
    before the shuffle, and the links of an id with very many neighbours are dealt over many tasks (join_hot).  Up to FEW
    links are worked out in one task instead, with the same labels.  Nulls and self-links are left out; no links: empty result.
    """
    edges = stage(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= FEW:
        return _in_one_task(edges)
    before = None
    while True:
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("c")).select("u", F.least("u", "m").alias("m"), "c")
        least = stage(least, "least")
        up = join_hot(both.where(F.col("v") > F.col("u")), least, ["u"], "c")
        large = stage(up.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = stage(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c")), "low")
        met = join_hot(large, low, ["u"], "c")
        small = met.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        told = Observation()
        old, edges = edges, stage(small.observe(told, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "stars")
        for done in (old, large, least, low):
            drop_stage(done)
        now = told.get
        if now == before:
            roots = edges.select(F.col("v").alias("id"), F.col("v").alias("label")).distinct()
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label")).unionByName(roots)
        before = now
