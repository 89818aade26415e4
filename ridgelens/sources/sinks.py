"""Tables that jobs leave behind: visible landmarks, labels, and blocks clustered so that joins move no raster."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelens.functions.grid import BLOCK, STEPS, floor_div

#: Buckets of a clustered block table: a power of two, so that tables of fewer buckets still join without a shuffle.
BUCKETS = 256
BATCH = "batch_id"


def write_batch(rows: DataFrame, path: str, batch: int = 0, by: tuple[str, ...] = ()) -> None:
    """Rows of one batch as Parquet below path, partitioned by batch_id and `by`; what an earlier attempt at the batch left is replaced.

    The write commits at once and touches only the batch's own partitions, so a batch that runs twice, whole or in
    part, leaves one copy, and other batches stay.  A batch without rows leaves none of its earlier ones either.
    """
    (
        rows.drop(BATCH).write.mode("overwrite").option("partitionOverwriteMode", "static")
        .partitionBy(*by).parquet(f"{path}/{BATCH}={batch}")
    )


def batch_sink(path: str, by: tuple[str, ...] = ()) -> Callable[[DataFrame, int], None]:
    """write_batch() for foreachBatch: a stream that restarts from its checkpoint repeats its last batch under the same number."""

    def sink(rows: DataFrame, batch: int) -> None:
        write_batch(rows, path, batch, by)

    return sink


def read_batches(spark: SparkSession, path: str, schema: str, batch: int | None = None, *, numbered: bool = False) -> DataFrame:
    """What batches have written; schema: of the rows, so that no file is opened to learn it.

    batch: that one alone; else all.  numbered: with the batch's number.
    """
    rows = spark.read.schema(f"{schema}, {BATCH} bigint").option("basePath", path).parquet(path if batch is None else f"{path}/{BATCH}={batch}")
    return rows if numbered else rows.drop(BATCH)


def write_visible(pairs: DataFrame, path: str, batch: int = 0) -> None:
    """Pairs that see each other (vp_id, poi_id, ...), for views that stay where they are."""
    write_batch(pairs, path, batch)


def write_labels(labels: DataFrame, path: str, batch: int = 0) -> None:
    """Labels of views, partitioned by whether they show, as drawing asks for those that do."""
    write_batch(labels, path, batch, ("shown",))


def write_clustered(blocks: DataFrame, table: str, *, buckets: int = BUCKETS, path: str | None = None, side: int = BLOCK) -> DataFrame:
    """The table of blocks, bucketed and sorted by (bi, bj) and partitioned by band of a degree of latitude; returned as read from the catalogue.

    A join on (bi, bj) then shuffles only the other side, to the table's buckets: the raster stays where it lies, however
    many times it is joined.  A row's cell follows from its block, so filters and joins on `band` leave out partitions.
    """
    cells = blocks.select("bi", "bj", "h").withColumn("band", floor_div(F.col("bi") * side, STEPS))
    writer = cells.repartition(buckets, "bi", "bj").write.mode("overwrite").format("parquet").partitionBy("band").bucketBy(buckets, "bi", "bj").sortBy("bi", "bj")
    (writer.option("path", path) if path else writer).saveAsTable(table)
    return blocks.sparkSession.table(table)
