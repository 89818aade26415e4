"""Turns of conversations in order, with no conversation in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgelens.llm.common import stage

#: Rows of a partition are numbered from the partition's number times 2 ** PIECE on.
PIECE = 33


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def in_order(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows, written once, with `pos`: it rises with `order` inside each key, by one from row to row within a piece (pos >> PIECE) of the key.

    Rows are dealt by ranges of key and order, so a key of very many rows lies in several partitions, one after another;
    each of them holds a piece of it.
    """
    dealt = rows.repartitionByRange(F.col(key), *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(F.col(key), *[F.col(c).asc_nulls_first() for c in order])
    return stage(dealt.withColumn("pos", F.monotonically_increasing_id()), name)


def piece() -> Column:
    return F.shiftright("pos", PIECE)


def piece_starts(ordered: DataFrame, key: str) -> DataFrame:
    """(key, piece, first, before, total) of in_order(): the pos of a piece's first row, the rows of the key before it and in all.

    A key has a row here for each partition it lies in.
    """
    own = ordered.groupBy(key, piece().alias("piece")).agg(F.min("pos").alias("first"), F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy("piece")
    return own.select(key, "piece", "first", (F.sum("n").over(w) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy(key)).alias("total"))


#: For SQL: the table of the checksum's steps of a byte, and the checksum of an ASCII text.
CRC_TABLE = "crc as (select list(v order by n) as t from (select n, list_reduce(list_prepend(n, range(8)), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from (select unnest(range(256)) as n)))"


def crc_sql(text: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda x: ascii(x)::bigint)), lambda c, b: xor(c >> 8, crc.t[(xor(c, b) & 255) + 1])), 4294967295)"
