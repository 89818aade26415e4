"""A corpus pipeline: toxicity, line dedup, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents;
the last returns the pieces of the packed sequences.  Null texts count as empty and pass as "" from the line stage on; an empty
text is no copy of anything, has no words to mix and so ends at the mix, as does a row whose text is null.  Rows without an id
are documents of their own in every stage; rows of one id and text share each decision.  An empty table gives an empty
result.  More columns, also those named like columns that an operator makes, go through unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelens.llm import jaccard, line_dedup, mixing, packing, toxicity
from ridgelens.llm.common import documents, stage


def _apart(docs: DataFrame, made: tuple[str, ...], step: Callable[[DataFrame], DataFrame], changed: dict[str, Callable[[DataFrame], Column]] | None = None) -> DataFrame:
    """step(docs) with the columns of docs: those named like columns that the step makes stand aside under other names meanwhile."""
    aside = {c: f"__own_{c}" for c in docs.columns if c in made}
    out = step(docs.withColumnsRenamed(aside))
    return out.select(*[(changed or {}).get(c, lambda _, c=c: F.col(f"`{aside.get(c, c)}`"))(docs).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier's cut for their language rejects go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _apart(docs, ("score", "threshold", "rejected"), lambda d: toxicity.classify(d, model).where(~F.col("rejected")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten documents or more share go; n_chars follows the text."""
    length = lambda d: F.char_length("text").cast(d.schema["n_chars"].dataType)
    return _apart(docs, ("n_lines", "n_dropped"), line_dedup.drop_common_lines, {"n_chars": length})


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, 0.8), the document with the smallest id stays; rows without an id stay."""
    near = jaccard.near_duplicates(docs.select("doc_id", "text"))
    gone = near.where(F.col("component_id") != F.col("doc_id")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents that the draw leaves out go, others stand whole, once for each copy."""
    return mixing.take(mixing.mix(docs, whole=True), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents of the mix in sequences of 2048 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_jaccard", drop_copies), ("mix_sources", mix_sources), ("packing", pack)]
ORACLE_SQL = None  # a trained model and a space-filling curve; tests/llm/test_pipeline.py holds the stages against plain Python


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
