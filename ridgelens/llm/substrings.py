"""Long passages that stand in several documents, found at difference-cover anchors."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelens.llm.common import documents, join_hot, stage
from ridgelens.llm.filters import build_filter, passes
from ridgelens.llm.words import Words, blocks

#: Words of a window.
WINDOW = 50
#: A perfect difference set: every residue modulo 31 is a difference of two of these six.
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31


def cover_mask(period: int, cover: tuple[int, ...]) -> np.ndarray:
    """Which residues are in the cover; fails if some difference modulo the period is missing."""
    if {(a - b) % period for a in cover for b in cover} != set(range(period)):
        raise ValueError("not a difference cover")
    mask = np.zeros(period, bool)
    mask[list(cover)] = True
    return mask


def _runs(flags: np.ndarray, window: int) -> np.ndarray:
    """Marks the words covered by windows that start at flagged words (flags and result: one row's words)."""
    n = len(flags)
    step = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(flags)
    step[at] += 1
    np.subtract.at(step, np.minimum(at + window, n), 1)
    return np.cumsum(step[:-1]) > 0


def remove_repeats(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER, digest: bool = False) -> DataFrame:
    """id_col, n_words, n_removed, kept (the kept words joined by one space; digest: kept_sha256 in its place).

    A word goes if one of the windows of `window` words that cover it also starts in a document with a smaller id.

    1. Of each text, only the windows of window - period + 1 words that start at positions in the difference cover
       modulo the period are hashed (6 of 31).  Two equal windows at positions p and q of their documents have a
       common offset k < period with p + k and q + k both in the cover, so they share an anchor.
    2. Anchors are grouped by hash, with partial groups before the shuffle; those in two documents or more are kept.
    3. Where such an anchor stands, it is extended: the windows of full length that contain it are hashed to 64 bits,
       and the smallest id of each is found in the same way.
    4. Each document reads the smallest ids of its own windows and marks the words of those that stood before.

    Texts without a repeated anchor never move; with digest, not even their words are written.  The smallest id of a
    passage that a third of all documents share comes as a row from each task, and is handed back to its windows dealt
    over many tasks (join_hot).
    Documents with a null id have no place in the order: they are returned as they are and take nothing from others.
    Null and empty texts: no words, "" kept.  Rows with equal ids are one place in the order and do not take from each
    other; each is returned.  Empty table: empty result.
    """
    mask = cover_mask(period, cover)
    short = window - period + 1
    if short < 1:
        raise ValueError("the period must not be longer than the window")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body")).withColumn("k", F.xxhash64("body"))

    def scan(batch):
        """(row, its words' range, hashes of words) for each block."""
        for i, j, data, at in blocks(batch.column("body")):
            yield i, j, Words(data, at)

    def anchors(batches):
        for b in batches:
            ids = b.column("id")
            valid, ids = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for i, j, w in scan(b):
                h = w.windows(short)
                counts = np.diff(w.row_at)
                row = np.repeat(np.arange(j - i), counts)
                place = np.arange(len(w.hashes)) - w.row_at[row]
                use = mask[place % period] & (place + short <= counts[row]) & (counts[row] >= window) & valid[i + row]
                where = np.flatnonzero(use)
                key, own = h[where].view(np.int64), ids[i + row[where]]
                # one row for each hash and document
                order = np.lexsort((own, key))
                key, own = key[order], own[order]
                first = np.ones(len(key), bool)
                first[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(own[first])], names=["h", "id"])

    found = base.mapInArrow(anchors, "h bigint, id bigint").groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where(F.col("lo") < F.col("hi")).select("h")
    bits = build_filter(stage(found, "anchors"), "h")

    def candidates(batches):
        """Of each text: hashes of the windows round anchors that pass the filter, and its words if there are any."""
        for b in batches:
            ids = b.column("id")
            valid = ids.is_valid().to_numpy(zero_copy_only=False)
            out: dict[str, list] = {"n": [], "kept": [], "sha": [], "at": [], "w": []}
            for (i, j, w), (_, _, data, _) in zip(scan(b), blocks(b.column("body")), strict=True):
                h, full, raw = w.windows(short), w.windows(window), data.tobytes()
                for r in range(j - i):
                    a, z = w.row_at[r], w.row_at[r + 1]
                    n, start = z - a, np.zeros(0, np.int64)
                    if n >= window and valid[i + r]:
                        place = np.flatnonzero(mask[np.arange(n - short + 1) % period])
                        hit = place[passes(bits.value, h[a + place])]
                        if len(hit):
                            near = np.zeros(n + 1, np.int64)  # starts of windows that contain a hit
                            np.add.at(near, np.maximum(hit - (window - short), 0), 1)
                            np.subtract.at(near, hit + 1, 1)
                            start = np.flatnonzero(np.cumsum(near)[: n - window + 1] > 0)
                    text_ = b" ".join(raw[w.starts[a] : w.ends[z - 1]].split()) if n else b""
                    out["n"].append(n)
                    out["kept"].append(text_.decode() if len(start) or not digest else None)
                    out["sha"].append(hashlib.sha256(text_).hexdigest() if digest else None)
                    out["at"].append(start.astype(np.int32))
                    out["w"].append(full[a + start].view(np.int64) if len(start) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [ids, b.column("k"), pa.array(out["n"], pa.int64()), pa.array(out["kept"], pa.string()), pa.array(out["sha"], pa.string()), pa.array(out["at"], pa.list_(pa.int32())), pa.array(out["w"], pa.list_(pa.int64()))],
                names=["id", "k", "n", "kept", "sha", "at", "w"],
            )

    near = stage(base.mapInArrow(candidates, "id bigint, k bigint, n bigint, kept string, sha string, at array<int>, w array<bigint>"), "windows")
    touched = F.size("at") > 0
    single = near.where(touched).select("id", "k", F.explode(F.arrays_zip("at", "w")).alias("x")).select("id", "k", F.col("x.at").alias("at"), F.col("x.w").alias("w"))
    lowest = stage(single.groupBy("w").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count("*").alias("c")).where(F.col("lo") < F.col("hi")).select("w", "lo", "c"), "lowest")
    changes = stage(join_hot(single, lowest, ["w"], "c").where(F.col("id") > F.col("lo")).groupBy("id", "k").agg(F.collect_set("at").alias("starts")), "repeats")

    def cut(batches):
        for b in batches:
            removed, kept = [], []
            for t, s in zip(b.column("kept").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = t.encode().split(b" ")
                flags = np.zeros(len(words), bool)
                flags[s or []] = True
                keep = ~_runs(flags, window)
                removed.append(int(len(words) - keep.sum()))
                t = b" ".join([words[k] for k in np.flatnonzero(keep)])
                kept.append(hashlib.sha256(t).hexdigest() if digest else t.decode())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("n"), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=[id_col, "n_words", "n_removed", last])

    last = "kept_sha256" if digest else "kept"
    whole = near.where(~touched).select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.col("sha" if digest else "kept").alias(last))
    rest = near.where(touched).select("id", "k", "n", "kept").join(changes, ["id", "k"], "left")
    return whole.unionByName(rest.select("id", "n", "kept", "starts").mapInArrow(cut, f"`{id_col}` bigint, n_words bigint, n_removed bigint, {last} string"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir), digest=True)


SQL = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
h as (select doc_id, unnest(range(1, len(words) - 48)) as at, unnest(list_transform(range(1, len(words) - 48), lambda i: md5_number(array_to_string(words[i:i + 49], ' ')))) as h from w where len(words) >= 50),
f as (select h, min(doc_id) as first from h group by h having min(doc_id) < max(doc_id)),
s as (select distinct h.doc_id, h.at from h join f on h.h = f.h and h.doc_id > f.first),
p as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as at from w),
k as (select p.doc_id, p.at, word, coalesce(max(s.at) over (partition by p.doc_id order by p.at rows between 49 preceding and current row), -1) > 0 as gone from p left join s on s.doc_id = p.doc_id and s.at = p.at)
select w.doc_id, len(any_value(words))::bigint as n_words, count(*) filter (where gone)::bigint as n_removed, sha256(coalesce(string_agg(word, ' ' order by k.at) filter (where not gone), '')) as kept_sha256
from w left join k on k.doc_id = w.doc_id group by w.doc_id
"""
