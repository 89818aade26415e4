"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgelens.llm.common import stage

K, EVERY = 5, 50
#: Centroids of a half at the least and most; between them the square root of the rows, so as many cells as rows.
FEWEST, MOST = 16, 512
#: Vectors that fit the centroids, at most, and queries among them that set how far to go.
SAMPLE, PROBES, RECALL = 16_384, 512, 0.95
#: Rows of the index, and queries, that meet in one task; rows that a query meets at the least.
BLOCK, LEAST = 4096, 256


def centroids_for(rows: int) -> int:
    return min(MOST, max(FEWEST, 1 << round(np.log2(max(rows, 1)) / 2)))


@dataclass
class Index:
    """Centroids of either half of a unit vector; the share of all rows to visit; rows in each cell (pair of centroids)."""

    halves: tuple[np.ndarray, np.ndarray]
    share: float
    counts: np.ndarray

    @property
    def dim(self) -> int:
        return self.halves[0].shape[1] + self.halves[1].shape[1]

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = self.halves[0].shape[1]
        return tuple(((p**2).sum(1)[:, None] + (c**2).sum(1)[None, :] - 2 * p @ c.T) for p, c in ((x[:, :a], self.halves[0]), (x[:, a:], self.halves[1])))

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d1, d2 = self.distances(x)
        return d1.argmin(1), d2.argmin(1)


def traverse(d1: np.ndarray, d2: np.ndarray):
    """Pairs (i, j) in order of d1[i] + d2[j], by a heap that holds the frontier of the sorted rows and columns."""
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap = [(s1[0] + s2[0], 0, 0)]
    while heap:
        _, a, b = heapq.heappop(heap)
        yield o1[a], o2[b]
        if a + 1 < len(s1) and b == 0:
            heapq.heappush(heap, (s1[a + 1] + s2[0], a + 1, 0))
        if b + 1 < len(s2):
            heapq.heappush(heap, (s1[a] + s2[b + 1], a, b + 1))


def _centroids(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(9)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = ((c**2).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
        for j in range(len(c)):
            if (own := near == j).any():
                c[j] = x[own].mean(0)
    return c


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # else squares of very large or small numbers leave the range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit(sample: np.ndarray, k: int = K, centroids: int = FEWEST, recall: float = RECALL) -> Index:
    """Centroids by k-means; the share to visit is what finds `recall` of the nearest k of PROBES sample vectors."""
    x = _unit(sample)
    half = x.shape[1] // 2
    index = Index((_centroids(x[:, :half], centroids), _centroids(x[:, half:], centroids)), 1.0, np.zeros((0, 0), np.int64))
    a, b = index.cells(x)
    n = index.halves[1].shape[0]
    counts = np.bincount(a * n + b, minlength=index.halves[0].shape[0] * n)
    q = x[:PROBES]
    near = q @ x.T
    near[np.arange(len(q)), np.arange(len(q))] = -2
    d1, d2 = index.distances(q)
    need = []
    for i in range(len(q)):
        order = np.argsort((d1[i][:, None] + d2[i][None, :]).ravel(), kind="stable")
        seen = np.empty(len(order))
        seen[order] = np.cumsum(counts[order]) / len(x)
        best = np.argsort(-near[i], kind="stable")[: min(k, len(x) - 1)]
        need += seen[a[best] * n + b[best]].tolist()
    index.share = float(np.quantile(need, recall)) if need else 1.0
    return index


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def nearest(vectors: DataFrame, *, id_col: str = "vec_id", vector: str = "embedding", every: int = EVERY, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine found for each row whose id is divisible by `every`.

    Every vector is in the index, in the cell of the nearest centroid of its first half and that of its second.  A query
    goes through cells by summed distance, with a heap, until they hold the share of all rows that found RECALL of the
    nearest in the sample (k + 1 rows and LEAST at the least); it meets the rows of those cells in blocks of bounded size, dealt by first
    centroid: a query goes only to first centroids that it visits, and rows are repeated only for blocks of queries that visit
    theirs.  It is scored against the original vectors in double precision.  Of equal vectors, the k + 1 smallest ids
    are in the index: more cannot be among the k nearest.

    Ties go to the smaller id; rows equal in id and vector count once, and a query's own id is never its answer.  Null
    ids and vectors that are null, zero, hold null or non-finite components, or have another length than the most
    frequent one of the sample take no part.  With fewer candidates, all are returned; empty table: empty result.
    """
    spark = vectors.sparkSession
    v = F.col("v")
    usable = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False)))
    sample = [r.v for r in usable.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    empty = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    if not sample:
        return empty
    dim = int(np.bincount([len(x) for x in sample]).argmax())
    usable = usable.where(F.size("v") == dim)
    index = fit(np.array([x for x in sample if len(x) == dim]), k, centroids_for(usable.count()))
    fitted = spark.sparkContext.broadcast(index)  # centroids only

    def place(batches):
        """The cell of each row; of equal vectors in a batch, only the smallest ids."""
        for b in batches:
            if not b.num_rows:
                continue
            ids, x = b.column("id").to_numpy(), _matrix(b.column("v"))
            raw = np.ascontiguousarray(x + 0.0).view(f"V{8 * dim}").ravel()
            _, same = np.unique(raw, return_inverse=True)
            order = np.lexsort((ids, same))
            ids, same = ids[order], same[order]
            fresh = np.ones(len(ids), bool)
            fresh[1:] = (same[1:] != same[:-1]) | (ids[1:] != ids[:-1])
            order, ids, same = order[fresh], ids[fresh], same[fresh]
            first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
            rank = np.arange(len(same)) - np.repeat(first, np.diff(np.append(first, len(same))))
            keep = order[rank <= k]
            a, c = fitted.value.cells(_unit(x[keep]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rank <= k]), pa.array([x[i].tobytes() for i in keep], pa.binary()), pa.array(a, pa.int32()), pa.array(c, pa.int32())], names=["id", "x", "c1", "c2"])

    placed = usable.mapInArrow(place, "id bigint, x binary, c1 int, c2 int").dropDuplicates(["id", "x"])
    order = Window.partitionBy(F.xxhash64("x"), F.sha2("x", 256)).orderBy("id")
    placed = stage(placed.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1).drop("nth"), "index")
    counts = np.zeros((len(index.halves[0]), len(index.halves[1])), np.int64)
    for a, c, n in placed.groupBy("c1", "c2").count().collect():  # a row for each cell: MOST squared at most
        counts[a, c] = n
    index.counts = counts
    total = int(counts.sum())
    want = max(index.share * total, k + 1, LEAST)
    known = spark.sparkContext.broadcast(index)

    def visit(batches):
        """For each query and first centroid that it meets: the second centroids, as a mask."""
        for b in batches:
            ix = known.value
            out: list[list] = [[], [], [], []]
            for i, raw in zip(b.column("id").to_pylist(), b.column("v").to_pylist(), strict=True):
                x = np.array([raw])
                d1, d2 = ix.distances(_unit(x))
                masks, seen = {}, 0
                for a, c in traverse(d1[0], d2[0]):
                    if n := int(ix.counts[a, c]):
                        masks.setdefault(int(a), np.zeros(ix.counts.shape[1], bool))[c] = True
                        seen += n
                        if seen >= want:
                            break
                for a, m in masks.items():
                    for column, value in zip(out, (i, x.tobytes(), a, np.packbits(m).tobytes()), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.int32()), pa.array(out[3], pa.binary())], names=["q", "x", "c1", "mask"])

    asked = usable.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    # a traversal is some ten thousand steps: few queries to a task
    queries = stage(asked.repartition(max(1, min(-(-total // (every * 64)), 4096)), "id").mapInArrow(visit, "q bigint, x binary, c1 int, mask binary"), "visits")
    # blocks of the rows of a first centroid, and of the queries that visit it: every block of the one meets every one of the other
    visits = {r.c1: r.n for r in queries.groupBy("c1").agg(F.count("*").alias("n")).collect()}  # a row for each first centroid
    blocks = [(a, -(-n // BLOCK) or 1, -(-visits.get(a, 0) // BLOCK)) for a, n in enumerate(counts.sum(1).tolist())]
    blocks = F.broadcast(spark.createDataFrame(blocks, "c1 int, rows int, asks int"))
    share = lambda column, parts: F.pmod(F.xxhash64(column), F.col(parts)).cast("int")
    every_one = lambda parts: F.explode(F.sequence(F.lit(0), F.col(parts) - 1))
    right = placed.join(blocks, "c1").where("asks > 0").withColumn("rb", share("id", "rows")).withColumn("qb", every_one("asks")).drop("rows", "asks")
    left = queries.join(blocks, "c1").withColumn("qb", share("q", "asks")).withColumn("rb", every_one("rows")).drop("rows", "asks")

    def meet(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = {"q": [], "vec_id": [], "score": []}
        if len(queries) and len(rows):
            x = np.stack([np.frombuffer(b) for b in rows["x"]])
            ids, cell = rows["id"].to_numpy(), rows["c2"].to_numpy()
            size = np.sqrt((x * x).sum(1))
            for q, raw, mask in zip(queries["q"], queries["x"], queries["mask"], strict=True):
                y = np.frombuffer(raw)
                at = np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8))[cell].astype(bool) & (ids != q))
                if not len(at):
                    continue
                s = (x[at] @ y) / (size[at] * np.sqrt((y * y).sum()))
                if len(at) > k:
                    close = s >= np.partition(s, len(s) - k)[len(s) - k] - 1e-9
                    at = at[close]
                s = (x[at] * y).sum(1) / (size[at] * np.sqrt((y * y).sum()))  # equal vectors, equal scores
                best = np.lexsort((ids[at], -s))[:k]
                found["q"] += [q] * len(best)
                found["vec_id"] += ids[at][best].tolist()
                found["score"] += s[best].tolist()
        return pd.DataFrame(found).astype({"q": "int64", "vec_id": "int64", "score": "float64"})

    key = ["c1", "rb", "qb"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(meet, "q bigint, vec_id bigint, score double")
    rank = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    return found.dropDuplicates(["q", "vec_id"]).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k).select(F.col("q").alias("query_id"), "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
