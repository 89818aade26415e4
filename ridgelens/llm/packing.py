"""Packing documents into token sequences along a Hilbert curve through their hashed vectors."""

from __future__ import annotations

import zlib
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ridgelens.llm.common import LOWER, UPPER, documents, stage
from ridgelens.llm.words import WordCache, Words, blocks

LENGTH, END_ID = 2048, 1
DOWN = str.maketrans(UPPER, LOWER)
#: Token ids are hashed to BINS counts, projected to DIMS numbers, each cut to 2**BITS steps of the curve's grid.
BINS, DIMS, BITS = 256, 4, 12
#: Bytes of ids of a partition, up to so many partitions; with more, partitions grow up to MOST_BYTES before their number does.
PART_BYTES, MANY_PARTS, MOST_BYTES = 8 << 20, 4096, 256 << 20


class WordEncoder:
    """Token ids of texts by a tokenizers file that splits at blanks, each word encoded once and remembered.

    The file's pre-tokenizer keeps no blank and its normalizer acts on either side of one separately, so the ids of a
    text are those of its words in turn; this is checked for a probe when the file is loaded, and a file for which it
    does not hold is used on whole texts.  Words that differ only in the case of A-Z, or in a comma or full stop behind
    a letter, share what is remembered, if probes show that the file lower-cases or splits there.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        probe = "It's  a\tB,c. \n\n'll x́ İΣ 9 don't <|endoftext|> a<|startoftext|>b\x0b\x0c\r  q "
        self.ends = np.zeros(max(self.model.get_vocab().values()) + 1, bool)
        self.ends[[i for w, i in self.model.get_vocab().items() if w.endswith("</w>")]] = True
        self.known = WordCache(self.kind)
        self.splits = self.ids(probe) == [i for w in probe.split() for i in self.ids(w)]
        letters = [*UPPER, *LOWER, UPPER, LOWER, "Straße", "abC-Ab", "x2y", "İX", "O'S"]
        self.lower = all(self.ids(w) == self.ids(w.translate(DOWN)) for w in letters)
        self.stops = all(self.ids(w + s) == self.ids(w) + self.ids(s) for w in letters for s in ",.")

    def ids(self, text: str) -> list[int]:
        return self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids  # encode() also places each token in the text

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words end to end, and how many each has; words of letters are encoded together and cut at their ends."""
        plain = np.array([w.isalpha() for w in words], bool)
        ids = np.array(self.ids(" ".join([w for w, p in zip(words, plain.tolist(), strict=True) if p])), self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != plain.sum():  # a letter that the normalizer takes apart
            plain, ids = np.zeros(len(words), bool), ids[:0]
        rest = [x.ids for x in self.model.encode_batch_fast([w for w, p in zip(words, plain.tolist(), strict=True) if not p], add_special_tokens=False)]
        n = np.zeros(len(words), np.int64)
        n[~plain] = [len(x) for x in rest]
        if plain.any():
            n[plain] = np.diff(np.append(ends[:-1], len(ids)), prepend=0)
        out, whole = np.empty(n.sum(), self.kind), np.repeat(plain, n)
        out[whole], out[~whole] = ids, np.fromiter(chain.from_iterable(rest), self.kind)
        return out, n

    def rows(self, texts: pa.Array, end_id: int):
        """The ids of each text with end_id behind, block by block: all of them end to end, and the ends of the rows."""
        for i, j, data, at in blocks(texts):
            if self.splits:
                w = Words(data, at, lower=self.lower, stops=self.stops)
                flat, lengths = self.known(w, data, self._encode)
                sums = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[w.row_at]
            else:
                raw = data.tobytes()
                each = [np.array(self.ids(raw[a:b].decode()), self.kind) for a, b in zip(at[:-1], at[1:], strict=True)]
                flat, sums = np.concatenate(each), np.concatenate([[0], np.cumsum([len(x) for x in each])])
            out = np.full(len(flat) + j - i, end_id, self.kind)
            out[np.arange(len(flat)) + np.repeat(np.arange(j - i), np.diff(sums))] = flat
            yield out, sums[1:] + np.arange(1, j - i + 1)


_loaded: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The encoder of a file, loaded once in each worker process, with the words it remembers."""
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """The place along the Hilbert curve of points (rows of integers below 2**bits), as int64 (bits * dims < 64).

    For every level of the grid, from the largest cubes on, the remaining lower bits are reflected and swapped so that
    the curve enters and leaves each cube at its neighbours; then the bits are Gray-decoded and interleaved.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        low = bit - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        bit = np.int64(1) << level
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def _project(ids: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """A document's hashed vector, damped and of unit length, on a few fixed random directions."""
    counts = np.sqrt(np.bincount((ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(24), minlength=BINS))
    return (counts / np.sqrt((counts**2).sum())) @ planes


def _planes() -> np.ndarray:
    return np.random.default_rng(6).normal(size=(BINS, DIMS))


def encode(docs: DataFrame, path: str, *, text: str = "text", id_col: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """(id, ids binary, n, p array of DIMS projections); ids are little-endian, 2 bytes each if the vocabulary allows."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    schema = f"id {narrow.schema['id'].dataType.simpleString()}, ids binary, n int, width int, p array<double>"

    def run(batches):
        enc, planes = encoder(path), _planes()
        for b in batches:
            raw, n, p = [], [], []
            for ids, ends in enc.rows(b.column("body"), end_id):
                starts = np.concatenate([[0], ends[:-1]])
                n.append(ends - starts)
                raw += [ids[a:z].tobytes() for a, z in zip(starts, ends, strict=True)]
                p += [_project(ids[a:z], planes) for a, z in zip(starts, ends, strict=True)]
            n = np.concatenate(n or [np.zeros(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(raw, pa.binary()), pa.array(n, pa.int32()), pa.array(np.full(len(n), np.dtype(enc.kind).itemsize), pa.int32()), pa.array(p, pa.list_(pa.float64()))],
                names=["id", "ids", "n", "width", "p"],
            )

    return narrow.mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, *, text: str = "text", id_col: str = "doc_id", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of at most `length` tokens, similar documents next to each other.

    A document is its token ids and end_id.  Its hashed vector, projected to DIMS numbers and scaled by their mean and
    spread over all documents, gives a cell of a grid and so a place on the Hilbert curve; the documents are
    range-partitioned and sorted by (place, id), and each partition is cut into sequences as it streams by: every one
    full but the last tokens of a partition, which go to sequences of lengths that are powers of two (the binary digits
    of their number), so that nothing is padded.  A partition's sequences are numbered from its number times 2**40.

    Returns doc_id (id_col), start, length, ids_crc32, doc_tokens, sequence_id, offset.  Null and empty texts are
    documents of one id.  Many documents of one place (copies) are split by id, and by their ids' bytes where ids
    repeat; repeated rows are packed as often as they stand there.  Empty table: empty result.  Only numbers of fixed
    count (means and spreads) pass through the driver.
    """
    rows = stage(encode(docs, path, text=text, id_col=id_col, end_id=end_id), "encoded")
    sums = rows.select(F.sum(F.length("ids")).alias("bytes"), *[f(F.col("p")[d]).alias(f"{n}{d}") for d in range(DIMS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    steps = float(1 << BITS)
    cells = []
    for d in range(DIMS):
        mean, spread = sums[f"m{d}"] or 0.0, sums[f"s{d}"] or 1.0
        # the logistic curve is near the normal distribution's, so cells hold about as many documents each
        cells.append(F.least(F.floor(steps / (1 + F.exp((F.lit(mean) - F.col("p")[d]) * (1.7 / max(spread, 1e-12))))), F.lit(steps - 1)).cast("int"))
    id_type, arrow_id = rows.schema["id"].dataType.simpleString(), to_arrow_type(rows.schema["id"].dataType)

    @F.pandas_udf("bigint")
    def place(cells: pd.Series) -> pd.Series:
        return pd.Series(hilbert(np.stack(cells.to_numpy()), BITS) if len(cells) else np.zeros(0, np.int64))

    placed = rows.select("id", "ids", "width", place(F.array(*cells)).alias("place"))
    size = sums["bytes"] or 0
    parts = max(1, min(-(-size // PART_BYTES), MANY_PARTS), -(-size // MOST_BYTES))
    ordered = placed.repartitionByRange(parts, "place", "id", F.xxhash64("ids")).sortWithinPartitions("place", "id", F.xxhash64("ids"))

    def cut(batches):
        sequence, filled, pieces = TaskContext.get().partitionId() << 40, 0, []
        for b in batches:
            done = []
            for i, raw, width in zip(b.column("id"), b.column("ids").to_pylist(), b.column("width").to_pylist(), strict=True):
                ids = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32).astype("<u4")
                at = 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    pieces.append((i, at, ids[at : at + take], len(ids), sequence, filled))
                    at, filled = at + take, filled + take
                    if filled == length:
                        done += pieces
                        sequence, filled, pieces = sequence + 1, 0, []
            yield _batch(done, arrow_id)
        yield _batch(_tail(pieces, filled, sequence) if pieces else [], arrow_id)

    return ordered.select("id", "ids", "width").mapInArrow(cut, f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")


def _tail(pieces: list, filled: int, sequence: int) -> list:
    """The last, unfilled sequence as sequences whose lengths are the powers of two that make it up."""
    out, room, size = [], 0, 0
    sizes = [1 << k for k in range(filled.bit_length() - 1, -1, -1) if filled >> k & 1]
    for i, start, ids, n, _, _ in pieces:
        at = 0
        while at < len(ids):
            if not room:
                room = size = sizes.pop(0)
                sequence += 1 if out else 0
            take = min(room, len(ids) - at)
            out.append((i, start + at, ids[at : at + take], n, sequence, size - room))
            at, room = at + take, room - take
    return out


def _batch(pieces: list, id_type: pa.DataType) -> pa.RecordBatch:
    big = [pa.array(x, pa.int64()) for x in ([p[1] for p in pieces], [len(p[2]) for p in pieces], [zlib.crc32(p[2].tobytes()) for p in pieces], [p[3] for p in pieces], [p[4] for p in pieces], [p[5] for p in pieces])]
    return pa.RecordBatch.from_arrays([pa.array([p[0].as_py() for p in pieces], id_type), *big], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
