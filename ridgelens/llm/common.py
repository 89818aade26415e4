"""What the operators of this subpackage share: narrow inputs and tables written to the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and \x09-\x0D, the characters between words.
BLANKS = " \t\n\u000b\f\r"
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it has more than one in HOT of all rows; fewer rows than SMALL are no burden to one task.
HOT, SMALL = 256, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where it is unset and all runs on one machine, as in tests, one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: later plans restart there if an executor is lost.

    The files lie where checkpoints lie and are cleared with them.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stage(df: DataFrame) -> None:
    """Deletes the folders of a staged table that nothing reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def join_hot(many: DataFrame, few: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """many joined with few, which has one row for each key and in `count` how many rows of many have that key.

    Keys with more than one in HOT of these rows, fewer than HOT in number, are dealt over HOT salts by a hash of the
    row; the rows of few that they meet are repeated for each salt.  few is read more than once: it should be staged.
    Its column `count` is left out of the result.
    """
    total, most = few.agg(F.sum(count), F.max(count)).first()
    if (total or 0) < SMALL or most * HOT <= total:
        return many.join(few.drop(count), on, how)
    is_hot = F.col(count) * HOT > total
    hot = few.where(is_hot).select(*on, F.lit(True).alias("__hot"))
    salt = F.when(F.col("__hot"), F.pmod(F.xxhash64(*many.columns), F.lit(HOT))).otherwise(F.lit(0)).cast("int")
    dealt = many.join(F.broadcast(hot), on, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(few.withColumn("__salt", F.explode(salts)).drop(count), [*on, "__salt"], how).drop("__salt")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(id_col: Column, text: Column) -> Column:
    """Tells rows apart by id and text, nulls included; only rows equal in both share a key."""
    return F.struct(F.coalesce(id_col.cast("string"), F.lit("\u0000")).alias("id"), F.xxhash64(text).alias("h"), F.xxhash64(F.lit(7), text).alias("g"))
