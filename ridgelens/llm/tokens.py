"""Token counts of whole texts by overlap resynchronisation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ridgelens.llm.common import documents
from ridgelens.llm.words import WordCache, Words, blocks

#: Texts longer than CHUNK code points are encoded in chunks that overlap by OVERLAP, widened as need be.
CHUNK, OVERLAP, LIMIT = 32_768, 512, 4096

class PieceEncoder:
    """A sentencepiece model whose pieces never hold a blank after something else.

    That property, and that the model changes no text but for a blank in front, is checked when it is loaded.  From it follows that no merge crosses the place
    between a non-blank and a blank, so such a place is a boundary of tokens in any encoding that contains both, and
    the tokens on either side do not depend on the other: it is a proven stable boundary.
    """

    BLANK = "▁"

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.vocab_size())]
        probe = "x \u00e9e\u0301  \uff21\ufb01\t\n.\u00a0 "
        self.proven = not any(self.BLANK in p.lstrip(self.BLANK) for p in pieces) and self.model.normalize(probe) == self.BLANK + probe.replace(" ", self.BLANK)
        self.length = np.array([1 if self.model.is_byte(i) else len(p.encode()) - 2 * p.count(self.BLANK) for i, p in enumerate(pieces)], np.int64)
        self.opens = np.array([p.startswith(self.BLANK) for p in pieces])
        self.known = WordCache(np.int32)

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words as they are between blanks, end to end, and how many each has: encoded together, each starts with the blank before it."""
        ids = np.array(self.ids(" ".join(words)), np.int32)
        return ids, np.diff(np.concatenate([[0], np.flatnonzero(self.opens[ids])[1:], [len(ids)]]))

    def counts(self, texts: pa.Array, chunk: int, overlap: int) -> np.ndarray:
        """Tokens of each text.  Where all blanks are single and inner, each word is encoded once and remembered."""
        out = np.zeros(len(texts), np.int64)
        for i, j, data, at in blocks(texts):
            w = Words(data, at, blank=True)
            words, blanks = np.diff(w.row_at), np.diff(np.concatenate([[0], np.cumsum(data == 32)])[at])
            long = np.diff(at) > chunk
            easy = ~long & ((blanks == words - 1) | (np.diff(at) == 0))
            if not self.proven or self.BLANK.encode() in data.tobytes():
                easy[:] = False
            else:
                _, lengths = self.known(w, data, self._each)
                out[i:j] = np.diff(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])[w.row_at])
            for r in np.flatnonzero(~easy):
                t = data[at[r] : at[r + 1]].tobytes().decode()
                out[i + r] = len(resync(t, self.tokens, chunk, overlap)) if self.proven and len(t) > chunk and self.BLANK not in t else len(self.ids(t))
        return out

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a chunk, and the byte at which each starts; -1 where a blank added in front starts."""
        ids = np.array(self.ids(text), np.int64)
        ends = np.cumsum(self.length[ids])
        return ids, ends - self.length[ids] - (int(ends[-1]) - len(text.encode()) if len(ids) else 0)


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of a file, loaded once in each worker process, with the words it remembers."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def resync(text: str, encode: Callable[[str], tuple[np.ndarray, np.ndarray]], chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
    """The ids of a text of any length, from chunks that overlap.

    Two neighbouring chunks are spliced in their overlap at the last place where a non-blank meets a single blank and
    both encodings start a token: a stable boundary.  If the overlap has none (one endless word, say), the next chunk
    starts again farther left, with twice the overlap, up to the last splice; if even that has none, the chunk before
    is made longer, up to the whole text.  So the result is always that of encoding the text whole.
    """
    parts: list[np.ndarray] = []
    start, size = 0, chunk
    ids, at = encode(text[:size])
    lead = 0  # tokens of the current chunk that earlier chunks have given
    while start + size < len(text):
        end, wide, found = start + size, max(1, min(overlap, size // 2)), False
        while not found:
            begin = end - wide
            nxt, nxt_at = encode(text[begin : begin + max(chunk, 2 * wide)])
            mine = at - len(text[start:begin].encode())  # bytes relative to the next chunk's start
            shared = np.intersect1d(mine[lead:], nxt_at[1:])
            window = text[begin:end].encode()
            stable = [p for p in shared[(shared > 0) & (shared < len(window))] if window[p] == 32 and window[p - 1] != 32 and p + 1 < len(window) and window[p + 1] != 32]
            if stable:
                p = stable[-1]
                upto = int(np.searchsorted(mine, p))
                parts.append(ids[lead:upto])
                start, size = begin, max(chunk, 2 * wide)
                ids, at, lead = nxt, nxt_at, int(np.searchsorted(nxt_at, p))
                found = True
            elif wide < size:
                wide = min(2 * wide, size)
            else:
                break
        if not found:
            size = min(2 * size, len(text) - start)
            ids, at = encode(text[start : start + size])
    parts.append(ids[lead:])
    return np.concatenate(parts)


def count_tokens(docs: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """The columns `keep`, n_bytes (UTF-8), n_tokens (without added tokens), over_limit (n_tokens > limit).

    path: a sentencepiece model, at the same place on every executor.  Texts up to `chunk` code points are one chunk;
    longer ones go through resync.  A model that does not have the stable boundaries is used on whole texts.  Null and
    empty texts have 0 bytes and 0 tokens.  Rows are independent: ties, repeats and empty tables need nothing.  Kept
    columns named like a new one are replaced.
    """
    names = [c for c in keep if c not in ("n_bytes", "n_tokens", "over_limit")]
    narrow = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    schema = T.StructType([*[docs.schema[c] for c in names], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        enc = encoder(path)
        for b in batches:
            texts = b.column("__text")
            n = enc.counts(texts, chunk, overlap)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)], names=[*names, "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
