"""A convolutional text classifier for toxicity, trained in numpy on a bounded sample, scoring every whole text."""

from __future__ import annotations

import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgelens.llm.common import documents, stage
from ridgelens.llm.filters import build_filter, passes
from ridgelens.llm.words import U64, Words, blocks

#: At most so many labelled rows of each class, with texts up to TRAIN_CHARS, are used to fit the model.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 2000, 3000, 50_000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 17, 8, 8, (1, 2, 3)
EPOCHS, RATE, CUT = 6, 0.02, 0.7
#: Log odds of the scores (-30 to 30) fall into this many bins when cuts are sought; labelled rows that a language needs for a cut of its own.
BINS, ENOUGH = 1 << 16, 30


@dataclass
class Model:
    """Two hashed embeddings a word, filters of several widths, weights of their maxima, thresholds by language."""

    words: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = CUT


def buckets(texts: pa.Array):
    """For each block: first and end row, bucket pairs of all words padded by two empty slots a row, row starts."""
    pad = max(WIDTHS) - 1
    for i, j, data, at in blocks(texts):
        w = Words(data, at, lower=True, bare=True)
        counts = np.diff(w.row_at)
        slots = np.full((len(w.hashes) + (pad + 1) * (j - i), 2), 2 * BUCKETS, np.int32)
        starts = w.row_at[:-1] + (pad + 1) * np.arange(j - i)
        where = np.arange(len(w.hashes)) + np.repeat((pad + 1) * np.arange(j - i), counts)
        slots[where, 0] = (w.hashes & U64(BUCKETS - 1)).astype(np.int64)
        slots[where, 1] = BUCKETS + ((w.hashes >> U64(40)) & U64(BUCKETS - 1)).astype(np.int64)
        yield i, j, slots, starts


def _responses(m: Model, e: np.ndarray) -> np.ndarray:
    """The filters' answers at every slot, after the rectifier; e has two empty slots after each row."""
    parts = []
    for f, width in enumerate(WIDTHS):
        z = e @ m.filters[f][0]
        for k in range(1, width):
            z[:-k] += e[k:] @ m.filters[f][k]
        parts.append(z)
    z = np.concatenate(parts, 1)
    z += m.bias
    return np.maximum(z, 0, out=z)


def scores(m: Model, texts: pa.Array) -> np.ndarray:
    """The score of each text, empty ones included, between 0 and 1."""
    out = np.zeros(len(texts))
    for i, j, slots, starts in buckets(texts):
        e = m.words[slots[:, 0]] + m.words[slots[:, 1]]
        z = _responses(m, e)
        after = np.append(starts[1:], len(slots))
        for k in range(1, max(WIDTHS)):
            z[after - k] = 0  # windows that begin in a row's empty slots reach the next row's words
        top = np.maximum.reduceat(z, starts, axis=0)
        out[i:j] = 1 / (1 + np.exp(-np.clip(top @ m.out + m.out_bias, -30, 30)))
    return out


def fit(texts: pa.Array, labels: np.ndarray, *, epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> Model:
    """Stochastic gradient descent with per-parameter step sizes (Adagrad), a text at a time, classes weighted alike.

    Without both classes the model answers the share of label 1 everywhere (0 without rows).
    """
    rng = np.random.default_rng(seed)
    m = Model(
        np.concatenate([rng.normal(0, 0.1, (2 * BUCKETS, DIM)), np.zeros((1, DIM))]).astype(np.float32),
        [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
        np.full(FILTERS * len(WIDTHS), -0.1, np.float32),
        rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32),
        0.0,
    )
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        m.out[:] = 0
        m.out_bias = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))
        return m
    rows = [slots[a:b] for _, _, slots, starts in buckets(texts) for a, b in zip(starts, [*starts[1:], len(slots)], strict=True)]
    # the first dimension starts as what a bucket's document counts say for sure: the near end of the interval of its log odds
    counts = np.zeros((2, 2 * BUCKETS + 1))
    for s, y in zip(rows, labels, strict=True):
        counts[y, np.unique(s)] += 1
    odds = np.log((counts[1] + 0.5) / (labels.sum() + 1)) - np.log((counts[0] + 0.5) / ((1 - labels).sum() + 1))
    wide = 1.64 * np.sqrt(1 / (counts[1] + 0.5) + 1 / (counts[0] + 0.5))
    m.words[:, 0] = np.clip(np.maximum(odds - wide, 0) + np.minimum(odds + wide, 0), -4, 4) / 2
    m.words[-1] = 0
    for f in range(len(WIDTHS)):
        m.filters[f][:, 0, 0] = 1
        m.bias[f * FILTERS], m.out[f * FILTERS] = -0.5, 1.0
    m.out_bias = -1.5
    seen = {"words": np.full(len(m.words), 1e-3, np.float32), "bias": np.full_like(m.bias, 1e-3), "out": np.full_like(m.out, 1e-3), "out_bias": 1e-3, "filters": [np.full_like(f, 1e-3) for f in m.filters]}
    n = len(WIDTHS) * FILTERS
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            s, y = rows[r], labels[r]
            e = m.words[s[:, 0]] + m.words[s[:, 1]]
            z = _responses(m, e)
            at = z.argmax(0)
            top = z[at, np.arange(n)]
            p = 1 / (1 + np.exp(-np.clip(top @ m.out + m.out_bias, -30, 30)))
            g = np.float32((p - y) * (0.5 / share if y else 0.5 / (1 - share)))
            g_top = g * m.out * (top > 0)
            g_out = g * top
            seen["out"] += g_out**2
            m.out -= rate * g_out / np.sqrt(seen["out"])
            seen["out_bias"] += g * g
            m.out_bias -= float(rate * g / np.sqrt(seen["out_bias"]))
            seen["bias"] += g_top**2
            m.bias -= rate * g_top / np.sqrt(seen["bias"])
            for f, width in enumerate(WIDTHS):
                own = slice(f * FILTERS, (f + 1) * FILTERS)
                live = np.flatnonzero(g_top[own])
                for k in range(width):
                    slot = at[own][live] + k
                    inside = slot < len(s) - 1
                    slot, cols = slot[inside], live[inside]
                    if not len(slot):
                        continue
                    gz = g_top[own][cols]
                    g_e = (m.filters[f][k][:, cols] * gz).T
                    g_f = np.zeros_like(m.filters[f][k])
                    g_f[:, cols] = e[slot].T * gz
                    seen["filters"][f][k] += g_f**2
                    m.filters[f][k] -= rate * g_f / np.sqrt(seen["filters"][f][k])
                    for h in (0, 1):
                        b = s[slot, h]
                        np.add.at(seen["words"], b, (g_e**2).mean(1))
                        np.subtract.at(m.words, b, 0.3 * rate * g_e / np.sqrt(seen["words"][b])[:, None])
            m.words[-1] = 0
    return m


def _best_cut(n: np.ndarray, hits: np.ndarray, low: np.ndarray, high: np.ndarray) -> float | None:
    """The cut of highest F-measure that weighs precision twice, half way to the next lower score: clean rows stay.

    Each bin of scores, highest first, comes as its rows, those of label 1, its lowest and its highest score.  None if
    the rows are not of both labels.
    """
    if not 0 < hits.sum() < n.sum():
        return None
    k = int((1.25 * np.cumsum(hits) / (np.cumsum(n) + 0.25 * hits.sum())).argmax())
    return float((low[k] + (high[k + 1] if k + 1 < len(n) else 0)) / 2)


def _bins(t: pa.Table) -> tuple[np.ndarray, ...]:
    t = t.sort_by([("bin", "descending")])
    return tuple(t[c].to_numpy() for c in ("n", "hits", "low", "high"))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", id_col: str = "doc_id", label: str = "toxic", lang: str = "lang") -> Model:
    """Fit on a bounded sample of labelled rows, set cuts on all of them, never on those whose crc32(id as text) mod 3 is 1.

    Remainder 0 fits: the rows with the smallest hash of the id, TRAIN_TOXIC and TRAIN_CLEAN of each class at most,
    texts up to TRAIN_CHARS.  Every labelled row of remainder 2, whatever its length, is counted in setting the cut of
    each language (ENOUGH labelled rows of it with both labels, else the cut over all languages, else CUT).  Ids with
    conflicting labels count as 1.
    """
    third = F.crc32(F.col("id").cast("binary")) % 3
    known = labels.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    known = stage(known.where(third != 1), "labelled")  # several steps read it, each in a few tasks
    pick = None
    for y, most in ((1, TRAIN_TOXIC), (0, TRAIN_CLEAN)):
        part = known.where((F.col("y") == y) & (third == 0)).orderBy(F.xxhash64("id"), "id").limit(most)
        pick = part if pick is None else pick.unionByName(part)
    body = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text}`").alias("body"), (F.col(f"`{lang}`") if lang in docs.columns else F.lit(None)).cast("string").alias("lang"))
    rows = body.where(F.char_length(F.coalesce("body", F.lit(""))) <= TRAIN_CHARS).join(F.broadcast(pick), "id")  # pick is bounded by the sample

    def learn(batches):
        """The one task that sees the sample."""
        parts = list(batches)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(_learned(pa.Table.from_batches(parts) if parts else None))], pa.binary())], names=["model"])

    found = rows.select("id", "body", "y").repartition(1).mapInArrow(learn, "model binary").collect()
    model = pickle.loads(found[0].model) if found else _learned(None)  # of an empty table there may be no task at all
    _set_cuts(model, body.where(third == 2), known.where(third == 2))
    return model


def _learned(rows: pa.Table | None) -> Model:
    if rows is None or not rows.num_rows:
        return fit(pa.array([], pa.string()), np.zeros(0, int))
    rows = rows.sort_by([("id", "ascending"), ("body", "ascending")]).combine_chunks()
    return fit(rows["body"].combine_chunks(), rows["y"].to_numpy().astype(int))


def _set_cuts(model: Model, body: DataFrame, known: DataFrame) -> None:
    """Sets the model's cuts from all rows of body (id, body, lang) with a label in known (id, y).

    Texts are scored where they lie, those whose id is in a filter of the labelled ids (build_filter: past its largest
    size others are scored in vain); ids, languages and scores meet the labels and are counted by language and bin.
    """
    sent = body.sparkSession.sparkContext.broadcast(model)
    asked = build_filter(known.select(F.xxhash64("id").alias("h")), "h")

    def run(batches):
        for b in (whole.slice(s, 1000) for whole in batches for s in range(0, whole.num_rows, 1000)):  # small parts go back
            b = b.filter(pa.array(passes(asked.value, b.column("h").to_numpy(zero_copy_only=False).view(U64))))
            p = scores(sent.value, b.column("body"))
            at = np.clip((np.log(p / (1 - p)) + 30) / 60 * BINS, 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("lang"), pa.array(p), pa.array(at)], names=["id", "lang", "p", "bin"])

    def own(t: pa.Table) -> pa.Table:
        enough = t.num_rows and sum(t["n"].to_pylist()) >= ENOUGH
        return pa.table({"lang": t["lang"].slice(0, 1), "cut": pa.array([_best_cut(*_bins(t)) if enough else None], pa.float64())})

    scored = body.withColumn("h", F.xxhash64("id")).mapInArrow(run, "id string, lang string, p double, bin int").join(known, "id")
    counts = stage(scored.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("hits"), F.min("p").alias("low"), F.max("p").alias("high")), "scores")
    sent.destroy()
    asked.destroy()
    cut = _best_cut(*_bins(counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("low").alias("low"), F.max("high").alias("high")).toArrow()))
    model.threshold = CUT if cut is None else cut
    found = counts.where(F.col("lang").isNotNull()).groupBy("lang").applyInArrow(own, "lang string, cut double").where(F.col("cut").isNotNull())
    model.thresholds = {r.lang: r.cut for r in found.collect()}


def classify(docs: DataFrame, model: Model, *, text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """The columns of docs (or `keep`) with score (0 to 1), threshold (of the row's language) and rejected.

    The score comes from the text alone.  Null text counts as empty, and an empty text has a score of its own; an
    unknown or null language, or docs without that column, gets the cut over all languages.  A column of docs named
    like one of the new ones is replaced.  Every row is scored by itself: ties, repeats and empty tables need nothing.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "threshold", "rejected")]
    has_lang = lang in docs.columns
    # the text goes to the workers once: as the column that is kept, if it is
    body, own = (text, []) if text in names else ("__text", [F.col(f"`{text}`").alias("__text")])
    narrow = docs.select(*[F.col(f"`{c}`") for c in names], *own, (F.col(f"`{lang}`") if has_lang else F.lit(None)).cast("string").alias("__lang"))
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("score", T.DoubleType()), T.StructField("threshold", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size, whatever was fitted

    def run(batches):
        m = sent.value
        for b in (whole.slice(s, 1000) for whole in batches for s in range(0, whole.num_rows, 1000)):  # small parts go back
            p = scores(m, b.column(body))
            cut = np.array([m.thresholds.get(x, m.threshold) for x in b.column("__lang").to_pylist()], float)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(p), pa.array(cut), pa.array(p >= cut)], names=[*names, "score", "threshold", "rejected"])

    return narrow.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return classify(docs, model, keep=["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), "threshold", "rejected")
