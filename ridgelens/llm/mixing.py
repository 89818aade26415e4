"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgelens.llm.common import WORD, documents, stage

WEIGHTS, SHARE, MOST_COPIES, SEED = (5, 2, 1), 1.5, 2, "mix-1"
#: Ranks fall into this many bins, and those of the bin where a source's draw ends into as many again.
BINS = 1024
#: Up to so many sources, what is known of each is broadcast (some 10 MB).
FEW_SOURCES = 100_000


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, n, target) from rows (source, size).

    Sources in order of code points, null last, take `weights` in turn and share `share` of all sizes; no target passes
    `most` times its source's size, and what is over goes to the rest by weight until none is above.  A source is full
    exactly if it comes, by limit over weight, before the first source that can take its share of what is left; so one
    ordered pass over the sources (one row each, however large the table) finds the fixed point.  The pass and the
    numbering are windows over all sources, sorted in one task that spills: meant for some ten million sources at most.
    """
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])
    one = one.withColumn("w", F.element_at(weight, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * float(most))
    by_room = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    every, before = Window.partitionBy(), by_room.rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("rest", F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("rest_w", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    one = one.withColumn("full", F.col("most") * F.col("rest_w") <= F.col("rest") * F.col("w"))
    open_ = ~F.col("full")
    first = F.min_by(F.when(open_, F.struct("rest", "rest_w")), F.when(open_, F.struct((F.col("most") / F.col("w")).alias("room"), F.col("source").isNull().alias("none"), "source"))).over(every)
    return one.withColumn("level", first).select("source", "source_size", "n", F.when(F.col("full"), F.col("most")).otherwise(F.col("w") * F.col("level.rest") / F.col("level.rest_w")).alias("target"))


def _ends(drawn: DataFrame, key: list[str], bin_: str, need: str) -> DataFrame:
    """For each key, the first bin at which the words up to and in it reach `need`, and the words before it."""
    w = Window.partitionBy(*key).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    bins = drawn.groupBy(*key, bin_).agg(F.sum("size").alias("words"), F.first(need).alias("need"))
    bins = bins.withColumn("before", F.coalesce(F.sum("words").over(w), F.lit(0)))
    return bins.where((F.col("before") < F.col("need")) & (F.col("before") + F.col("words") >= F.col("need"))).select(*key, F.col(bin_).alias("last"), F.col("before").alias("done"))


def mix(docs: DataFrame, *, text: str = "text", id_col: str = "doc_id", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED, whole: bool = False) -> DataFrame:
    """One row for each row of docs: row (struct of its columns), size, source_size, target, taken (words).

    Every document gets floor(target / source_size) whole copies for certain.  The rest of its source's target is drawn
    by Pareto order sampling: a document's inclusion odds are a level, one for each source, times the square root of its
    size over the source's mean size (longer documents are likelier); the level is the one at which the words expected are
    those wanted.  Its rank is u / (1 - u) over those odds, with u from md5 of seed and id, and the lowest ranks are taken
    until the source's words reach its target.  The level scales all ranks of a source alike, so their order is known
    without working it out, and how often a document is drawn follows the odds at that level (tested over many draws).  The draw's size is fixed in
    words, so the one document in which it ends gives only its first words: a source misses its target by less than a
    word.  whole: that document is taken whole or not at all, whichever comes nearer to the target (equally near: whole),
    so a source misses its target by half a document at most, and no text is cut.  No document is taken more than floor + 1 <= `most` times.

    The end of a draw is found by adding up words in BINS bins of the rank's transform r / (1 + r), then in BINS bins
    inside the last bin; only a millionth of a source is ever ordered in one place, so a source of a third of all
    rows is no hot spot.  Null text: size 0; null source: a source of its own.  Size 0 is never taken.  Ties of the
    rank go by id, and rows with equal ids are ordered by size.  Empty table: empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return _mixed(_sized(docs, row, text, id_col, source), stage(_sized(docs, F.lit(0), text, id_col, source), "sizes"), weights, share, most, seed, whole)


def _mixed(full: DataFrame, rows: DataFrame, weights: tuple[int, ...], share: float, most: int, seed: str, whole: bool = False) -> DataFrame:
    """full: row, source, id, size; rows: the same without what is in row.  The draw's end is found in rows alone."""
    targets = source_targets(rows, weights=weights, share=share, most=most)
    # one row for each source: as many as there are names of sources, whatever the number of rows
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.when(F.floor(rate) >= most, F.lit(most - 1)).otherwise(F.floor(rate)).cast("long")
    named = targets.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("none"), "source_size", "n", "target", copies.alias("copies"), (F.round("target").cast("long") - copies * F.col("source_size")).alias("need"))
    named = _small(named)
    key = ["s", "none"]
    drawn = _ranked(rows, named, seed).where(F.col("q").isNotNull()).select(*key, "bin", "fine", "size", "need")
    coarse = _ends(drawn, key, "bin", "need")
    inside = drawn.join(_small(coarse).withColumnRenamed("last", "bin"), [*key, "bin"]).withColumn("need", F.col("need") - F.col("done"))
    fine = _ends(inside, key, "fine", "need")
    ends = coarse.join(fine.select(*key, F.col("last").alias("last_fine"), F.col("done").alias("done_fine")), key)
    r = _ranked(full, named, seed).join(_small(ends), key, "left")
    here = F.coalesce((F.col("bin") == F.col("last")) & (F.col("fine") == F.col("last_fine")), F.lit(False))
    before = F.coalesce((F.col("bin") < F.col("last")) | ((F.col("bin") == F.col("last")) & (F.col("fine") < F.col("last_fine"))), F.lit(False))
    cols = ["row", "size", "source_size", "target", "copies", "part"]
    outside = r.where(~here).withColumn("part", F.when(before, F.col("size")).otherwise(F.lit(0)).cast("long")).select(*cols)
    order = Window.partitionBy(*key).orderBy("q", F.col("id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("need") - F.col("done") - F.col("done_fine") - F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.when(2 * left >= F.col("size"), F.col("size")).otherwise(F.lit(0)) if whole else F.least(F.greatest(left, F.lit(0)), F.col("size"))
    last = r.where(here).withColumn("part", part).select(*cols)
    return outside.unionByName(last).select("row", "size", "source_size", "target", (F.col("copies") * F.col("size") + F.col("part")).alias("taken"))


def _ranked(rows: DataFrame, named: DataFrame, seed: str) -> DataFrame:
    """rows with what is known of their source, and the rank and its bins."""
    r = rows.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("none", F.col("source").isNull()).drop("source").join(named, ["s", "none"])
    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("id", F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    # the source's level is the same for all that compete, so the order needs only the document's share of the odds
    odds = F.sqrt(F.col("size").cast("double") * F.col("n") / F.col("source_size"))
    r = r.withColumn("q", F.when(F.col("size") > 0, (u / (1 - u)) / odds))
    v = F.col("q") / (1 + F.col("q")) * BINS
    return r.withColumn("bin", F.least(F.floor(v), F.lit(BINS - 1)).cast("int")).withColumn("fine", F.least(F.floor((v - F.floor(v)) * BINS), F.lit(BINS - 1)).cast("int"))


def _small(df: DataFrame) -> DataFrame:
    """df has a row for each source; broadcast if these are few when counted, joined by shuffle otherwise."""
    df = stage(df, "by-source")
    return F.broadcast(df) if df.count() <= FEW_SOURCES else df


def _sized(docs: DataFrame, row: Column, text: str, id_col: str, source: str) -> DataFrame:
    return docs.select(row.alias("row"), F.col(f"`{source}`").alias("source"), F.col(f"`{id_col}`").cast("string").alias("id"), F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def take(mixed: DataFrame, docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The documents of a mix with the columns of docs: one row for each copy, the last one cut to the words it gives."""
    n, copies = F.col("taken"), F.col("copies")
    rows = mixed.where((F.col("size") > 0) & (n > 0)).withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(n / F.col("size")).cast("long"))))
    part = n - (copies - 1) * F.col("size")
    words = F.regexp_extract_all(F.col(f"row.`{text}`"), F.lit(WORD), F.lit(0))
    body = F.when(part >= F.col("size"), F.col(f"row.`{text}`")).otherwise(F.array_join(F.slice(words, F.lit(1), part.cast("int")), " "))
    return rows.select(*[body.alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = stage(_sized(docs, F.struct("doc_id"), "text", "doc_id", "source"), "sizes")  # the texts are read once, the passes go over sizes
    return _mixed(rows, rows, WEIGHTS, SHARE, MOST_COPIES, SEED).select("row.doc_id", "size", "source_size", "target", "taken")


SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, count(*) as n, row_number() over (order by source nulls last) as i from d group by source),
w as (select source, source_size, n, 2.0::double * source_size as most, [5.0, 2.0, 1.0][((i - 1) % 3) + 1]::double as w from s),
r as (select *, (select sum(source_size) from w)::double * 1.5::double - coalesce(sum(most) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
  (select sum(w) from w) - coalesce(sum(w) over (order by most / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest_w from w),
l as (select rest, rest_w from r where not most * rest_w <= rest * w order by most / w, source nulls last limit 1),
t as (select source, source_size, n, case when most * rest_w <= rest * w then most else w * (select rest from l) / (select rest_w from l) end as target from r),
c as (select *, case when source_size = 0 then 0 else least(floor(target / source_size)::bigint, 1) end as copies from t),
n as (select *, round(target)::bigint - copies * source_size as need from c),
q as (select d.doc_id, d.size, n.*, (('0x' || substr(md5('mix-1:' || d.doc_id), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double as u from d join n on d.source is not distinct from n.source),
k as (select *, case when size > 0 then (u / (1 - u)) / sqrt(size::double * n / source_size) end as rank from q),
o as (select *, coalesce(sum(case when size > 0 then size end) over (partition by source order by rank nulls last, doc_id::varchar, size rows between unbounded preceding and 1 preceding), 0) as before from k)
select doc_id, size, source_size, target, (copies * size + case when size > 0 then least(greatest(need - before, 0), size) else 0 end)::bigint as taken from o
"""
