"""Quality rules: word and line counts, and bands of zstandard ratios over whole documents and fixed chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgelens.llm.common import documents
from ridgelens.llm.words import _SPACE, U64, Words, blocks

MIN_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20
#: Level of compression, bytes of a chunk, and the share of a document's chunks that may lie outside their band.
LEVEL, CHUNK, BAD_SHARE = 3, 1024, 0.25
#: (bytes from which it holds, least ratio, largest ratio): shorter texts compress less, and below the first length a
#: ratio says nothing.  Prose of the languages at hand lies at least a quarter inside on either side.
LIMITS = ((128, 0.40, 1.05), (256, 0.36, 0.88), (512, 0.33, 0.80), (1024, 0.30, 0.73), (2048, 0.28, 0.66), (4096, 0.26, 0.62), (16384, 0.24, 0.60))
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL, _HEAD = np.zeros(256, bool), np.ones(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_HEAD[0x80:0xC0] = False  # bytes that go on with a code point


def outside(ratio: np.ndarray, length: np.ndarray, limits: tuple = LIMITS) -> np.ndarray:
    """-1 where a ratio is under its length's band (repetitive), 1 where it is over (incompressible), else 0."""
    at = np.searchsorted([x[0] for x in limits], length, "right") - 1
    low, high = np.array([0.0, *[x[1] for x in limits]])[at + 1], np.array([np.inf, *[x[2] for x in limits]])[at + 1]
    return (ratio > high).astype(np.int8) - (ratio < low)


def repeated_words(w: Words, k: int = WINDOW) -> np.ndarray:
    """For each row, how many of its words lie in a window of k words that stands in the row twice or more."""
    n = len(w.hashes)
    rows = np.repeat(np.arange(len(w.row_at) - 1), np.diff(w.row_at))
    h = w.windows(k)
    inside = np.flatnonzero(rows[: len(h)] == rows[k - 1 : k - 1 + len(h)]) if len(h) else np.zeros(0, int)
    order = inside[np.lexsort((h[inside], rows[inside]))]
    same = (h[order[1:]] == h[order[:-1]]) & (rows[order[1:]] == rows[order[:-1]])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    change = np.zeros(n + 1, np.int64)
    change[order[twice]] += 1  # each window once
    np.subtract.at(change, order[twice] + k, 1)
    covered = np.cumsum(change[:n]) > 0
    return np.bincount(rows[covered], minlength=len(w.row_at) - 1)


def _repeated_lines(data: np.ndarray, at: np.ndarray, rows: int) -> np.ndarray:
    """For each row, its lines that hold a word and equal an earlier line of the row."""
    out = np.zeros(rows, np.int64)
    breaks = np.concatenate([[0], np.cumsum(data == 10)])[at]
    for r in np.flatnonzero(np.diff(breaks)):
        seen: set[bytes] = set()
        for line in data[at[r] : at[r + 1]].tobytes().split(b"\n"):
            if line.strip(b" \t\n\x0b\x0c\r"):
                out[r] += line in seen
                seen.add(line)
    return out


def measured(texts: pa.Array, chunk: int = CHUNK, limits: tuple = LIMITS, bad_share: float = BAD_SHARE, level: int = LEVEL) -> Iterator[dict[str, np.ndarray]]:
    """COUNTS, n_bytes, ratio (NaN for empty texts), n_chunks, n_low, n_high (chunks under and over their band) and verdict of each text, a block of texts at a time."""
    import zstandard

    z = zstandard.ZstdCompressor(level=level, write_content_size=False, write_checksum=False)
    for i, j, data, at in blocks(texts):
        w = Words(data, at)
        sums = lambda mark: np.diff(np.concatenate([[0], np.cumsum(mark, dtype=np.int64)])[at])
        size = np.diff(at)
        out = {"n_words": np.diff(w.row_at), "word_chars": sums(_HEAD[data] & ~_SPACE[data]), "n_symbols": sums(_SYMBOL[data]), "n_dup_lines": _repeated_lines(data, at, j - i), "n_repeat_words": repeated_words(w), "n_bytes": size}
        packed = np.array([len(z.compress(data[a:b].data)) if b > a else 0 for a, b in zip(at[:-1], at[1:], strict=True)], float)
        out["ratio"] = np.divide(packed, size, out=np.full(j - i, np.nan), where=size > 0)
        out["n_chunks"] = size // chunk
        low, high = np.zeros(j - i, np.int64), np.zeros(j - i, np.int64)
        for r in np.flatnonzero(out["n_chunks"] > 1):
            own = np.array([len(z.compress(data[a : a + chunk].data)) for a in range(at[r], at[r + 1] - chunk + 1, chunk)]) / chunk
            x = outside(own, np.full(len(own), chunk), limits)
            low[r], high[r] = (x < 0).sum(), (x > 0).sum()
        out |= {"n_low": low, "n_high": high}
        whole = outside(out["ratio"], size, limits)
        spoilt = low + high > bad_share * out["n_chunks"]
        out["verdict"] = np.where(whole < 0, "repetitive", np.where(whole > 0, "incompressible", np.where(spoilt, np.where(low >= high, "repetitive parts", "incompressible parts"), "kept")))
        yield out


def rate(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED, chunk: int = CHUNK, limits: tuple = LIMITS, bad_share: float = BAD_SHARE, level: int = LEVEL) -> DataFrame:
    """The columns `keep`; COUNTS; n_bytes, ratio, n_chunks, n_low, n_high; base_failed, kept and verdict.

    ratio: compressed over raw bytes of the whole text.  Texts of two chunks or more are also compressed chunk by chunk
    (the rest behind the last full chunk counts only in the whole).  A text is rejected if its ratio lies outside the
    band of its length, or if more than bad_share of its chunks lie outside the band of theirs: below it is repetitive,
    above it incompressible.  Texts shorter than the first band are not judged by ratios.  base_failed: fewer than
    min_words words, or more than most_repeated percent of them in repeated windows of WINDOW words; such a text is not
    kept, and its verdict reads "base".

    A row is measured by itself, in one pass without a shuffle, so hot sources and copies weigh nothing.  A very long
    text is held whole by its task, some fifty times its bytes.  Null text: as empty, 0 words, base_failed, ratio null.
    Ties and repeated rows: each row has its own result.  Empty table: empty result.  Kept columns named like a new one are replaced.
    """
    made = [*[(c, T.LongType()) for c in [*COUNTS, "n_bytes"]], ("ratio", T.DoubleType()), *[(c, T.LongType()) for c in ("n_chunks", "n_low", "n_high")], ("base_failed", T.BooleanType()), ("kept", T.BooleanType()), ("verdict", T.StringType())]
    names = [c for c in keep if c not in dict(made)]
    schema = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(c, t) for c, t in made]])
    narrow = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for x in measured(b.column("__text"), chunk, limits, bad_share, level):
                n = len(x["n_words"])
                failed = (x["n_words"] < min_words) | (100 * x["n_repeat_words"] > most_repeated * x["n_words"])
                x |= {"base_failed": failed, "kept": ~failed & (x["verdict"] == "kept"), "verdict": np.where(failed, "base", x["verdict"])}
                own = b.slice(at, n)
                yield pa.RecordBatch.from_arrays([*[own.column(c) for c in names], *[pa.array(x[c], mask=np.isnan(x[c])) if c == "ratio" else pa.array(x[c].astype(np.int64)) if t == T.LongType() else pa.array(x[c]) for c, t in made]], names=[*names, *dict(made)])
                at += n

    return narrow.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate(documents(spark, sf_dir))
