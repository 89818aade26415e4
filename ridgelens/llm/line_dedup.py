"""Lines that many documents share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelens.llm.common import ascii_lower, documents, join_hot, row_key, stage

MIN_DOCS, MIN_LENGTH = 10, 1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\u000b\f\r")))


def drop_common_lines(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", min_docs: int = MIN_DOCS, min_length: int = MIN_LENGTH) -> DataFrame:
    """Drop every line whose key stands in at least min_docs documents; kept lines stay in order, joined by \\n.

    Lines are exploded, keyed and hashed to 128 bits, and a key is counted once for each document id.  Partial counts
    are made in the map tasks: of lines, then of the ids of each line, dealt by line and id, so a line of a third of all
    documents is nowhere together.  Its rows meet the list of lines to drop dealt over many tasks (join_hot).  Only
    positions of lines to drop travel back; the text moves once, to meet them.  Returns the columns of docs with `text` replaced, and n_lines, n_dropped (in a clash,
    these replace columns of docs).

    Null or empty text: one empty line, kept, and the text becomes "".  Rows with equal ids count as one
    document, rows without an id as one each; rows equal in id and text all get the same result.  Empty table: empty result.
    """
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"), F.col(f"`{id_col}`").alias("id"))
    base = base.select("row", "body", row_key(F.col("id"), F.col("body")).alias("key"))
    lines = base.select("key", F.posexplode(F.split("body", "\n", -1)).alias("pos", "line")).select("key", "pos", line_key(F.col("line")).alias("line"))
    lines = lines.where(F.char_length("line") >= min_length).select("key", "pos", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    # keys are made distinct inside each row, before anything is shuffled
    who = F.when(F.col("key.id") != "\u0000", F.xxhash64("key.id")).otherwise(F.monotonically_increasing_id())
    each = base.select(who.alias("who"), F.explode(F.array_distinct(F.transform(F.split("body", "\n", -1), line_key))).alias("line")).where(F.char_length("line") >= min_length)
    common = stage(each.groupBy(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2")).agg(F.count_distinct("who").alias("n")).where(F.col("n") >= min_docs), "common-lines")
    drops = join_hot(lines, common, ["h1", "h2"], "n", "left_semi").groupBy("key").agg(F.collect_set("pos").alias("gone"))
    joined = base.join(drops, "key", "left").select("row", F.split("body", "\n", -1).alias("parts"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    left = F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.col("parts")[i]), "\n")
    out = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(
        *[kept.alias(c) if c == text else F.col(f"row.`{c}`") for c in out],
        F.size("parts").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_common_lines(documents(spark, sf_dir)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
with lines as (
  select doc_id, pos, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents))),
common as (select k from lines where length(k) >= 1 group by k having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (where c.k is not null) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where c.k is null), '')) as kept_sha256
from lines l left join common c on l.k = c.k group by doc_id
"""
