"""The trie of conversations' prefixes, by ROLLUP over columns of turn ids."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgelens.llm.common import join_hot, stage
from ridgelens.llm.turns import CRC_TABLE, conversations, crc_sql, in_order, piece, piece_starts

#: Turns of a block of columns; rows of a conversation whose sums run in one window, more are added up in two levels.
WIDE, SPAN = 8, 1024
#: The queries' rebuilt conversations: so many share a start, of fewer turns than HEADS.
FAMILY, HEADS = 100, 6
KEY = ["k1", "k2", "depth"]


def turn_paths(turns: DataFrame) -> DataFrame:
    """(conv_id, at, total, h1, h2, n) of turns (conv_id, turn, role, text): place in the conversation, its turns in all, hashes of role and text, code points of the text.

    Turns are ordered by number, null first, then by the hashes; null role or text is empty; rows without conv_id are left out.
    """
    of = lambda c: F.coalesce(c, F.lit(""))
    ids = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.xxhash64(of("role"), of("text")).alias("h1"), F.xxhash64(F.lit(1), of("text"), of("role")).alias("h2"), F.char_length(of("text")).alias("n"))
    ordered = in_order(ids, "conv_id", ["turn", "h1", "h2"], "turns")
    placed = ordered.withColumn("piece", piece()).join(piece_starts(ordered, "conv_id"), ["conv_id", "piece"])
    return placed.select("conv_id", (F.col("before") + F.col("pos") - F.col("first")).alias("at"), "total", "h1", "h2", "n")


def running(df: DataFrame, key: str, at: str, sums: dict[str, Callable]) -> DataFrame:
    """df (staged) with each column of sums turned into that aggregate of the key's rows before, 0 for the first.

    Spans of SPAN places have a window each; those of later spans add what came before their span.
    """
    span = F.floor(F.col(at) / SPAN)
    inner = Window.partitionBy(key, "span").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("span", span)
    own = d.withColumns({c: F.coalesce(f(c).over(inner), F.lit(0)) for c, f in sums.items()})
    late = d.where("span > 0").select(key).distinct()
    outer = Window.partitionBy(key).orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = d.join(late, key, "left_semi").groupBy(key, "span").agg(*[f(c).alias(c) for c, f in sums.items()])
    before = spans.select(key, "span", *[F.coalesce(f(c).over(outer), F.lit(0)).alias(f"__{c}") for c, f in sums.items()])
    both = lambda c, f: F.col(c).bitwiseXOR(F.col(f"__{c}")) if f is F.bit_xor else F.col(c) + F.col(f"__{c}")
    far = own.where("span > 0").join(before, [key, "span"]).withColumns({c: both(c, f) for c, f in sums.items()}).select(*own.columns)
    return own.where("span = 0").unionByName(far).drop("span")


def _hashes(turn: Column, depth: Column) -> tuple[Column, Column]:
    """What a turn at a depth adds to a node's key: two hashes, of which a prefix has the exclusive or."""
    return F.xxhash64(turn["h1"], turn["h2"], depth), F.xxhash64(depth, turn["h2"], turn["h1"])


def _xor(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), parts, F.lit(0).cast("long"))


def _rollup(wide: DataFrame, aggregates: str) -> DataFrame:
    """A row for each prefix that ends in a block of columns: block, p1, p2, t1 to t<WIDE>, level and the aggregates over its conversations.

    Level 0 stays only in the first block: later ones repeat the last level of the block before.
    """
    t = [f"t{i}" for i in range(1, WIDE + 1)]
    sql = f"select block, p1, p2, {', '.join(t)}, {WIDE} - bit_count(grouping_id()) as level, {aggregates} from {{wide}} group by block, p1, p2, rollup({', '.join(t)})"
    real = F.array(*[F.col(c).isNotNull() for c in t])
    return wide.sparkSession.sql(sql, wide=wide).where(((F.col("level") == 0) & (F.col("block") == 0)) | ((F.col("level") > 0) & F.get(real, F.col("level") - 1)))


def _keyed(groups: DataFrame, *more: str) -> DataFrame:
    """Prefixes with their key (k1, k2, depth), their parent's (q1, q2) and code points n of their last text."""
    base = F.col("block") * WIDE
    each = [_hashes(F.col(f"t{i}"), base + i) for i in range(1, WIDE + 1)]
    upto = lambda k, last: F.col(f"p{k + 1}").bitwiseXOR(_xor([F.when(F.col("level") >= i + last, x[k]).otherwise(F.lit(0)) for i, x in enumerate(each, 1)]))
    n = F.coalesce(*[F.when(F.col("level") == i, F.col(f"t{i}.n")) for i in range(1, WIDE + 1)], F.lit(0))
    return groups.select(upto(0, 0).alias("k1"), upto(1, 0).alias("k2"), (base + F.col("level")).alias("depth"), upto(0, 1).alias("q1"), upto(1, 1).alias("q2"), n.alias("n"), *more)


def trie(paths: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes of the trie of paths (conv_id, at from 0 without gaps, h1, h2, n); members (conv_id) has also those without turns.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).  Conversations become
    rows of WIDE turn ids, one row for each block of WIDE turns, keyed by the node that the blocks before lead to;
    one ROLLUP over the columns aggregates the prefixes of all lengths at once, in partial sums inside map tasks, so a
    start that a third of all conversations share is no hot spot.  Node keys are the exclusive or of hashes of turn and
    depth (128 bits), so a block's key needs no pass from block to block.

    Sums over subtrees need no pass over levels either.  A node is counted by its smallest member, which is also the
    smallest of the nodes below on its own path; so what a subtree holds is what all its members count, less what its
    smallest member counts above it.  A second ROLLUP adds up the former, a running sum along that member the latter.
    Ids of the conversations that end at a node stream through a digest in order, and are nowhere collected.
    """
    slots = paths.withColumn("block", F.floor(F.col("at") / WIDE)).groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("at", "h1", "h2", "n"))).alias("a"))
    none = members.join(paths.where("at = 0").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).cast("long").alias("block"), F.array().cast(slots.schema["a"].dataType).alias("a"))
    turn = [F.get("a", i) for i in range(WIDE)]
    parts = [_hashes(t, F.col("block") * WIDE + i + 1) for i, t in enumerate(turn)]
    x = [_xor([F.when(F.size("a") > i, p[k]).otherwise(F.lit(0)) for i, p in enumerate(parts)]).alias(f"p{k + 1}") for k in (0, 1)]
    ids = [F.when(F.size("a") > i, F.struct(t["h1"].alias("h1"), t["h2"].alias("h2"), t["n"].alias("n"))).alias(f"t{i + 1}") for i, t in enumerate(turn)]
    blocks = stage(slots.unionByName(none).select("conv_id", "block", F.size("a").alias("size"), *x, *ids), "blocks")
    wide = stage(running(blocks.drop("size"), "conv_id", "block", {"p1": F.bit_xor, "p2": F.bit_xor}), "wide")
    nodes = stage(_keyed(_rollup(wide, "count(*) as n_convs, min(conv_id) as conv_id"), "n_convs", "conv_id"), "nodes")

    kids = nodes.where("depth > 0").groupBy(F.col("q1").alias("k1"), F.col("q2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    own = nodes.join(kids, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))).withColumn("saves", (F.col("n_convs") - 1) * F.col("n"))
    own = stage(own, "own")
    counted = stage(own.groupBy("conv_id").agg(F.count("*").alias("rows"), F.sum("saves").alias("saves"), F.count_if(F.col("n_children") == 0).alias("leaves")), "counted")
    sums = _keyed(_rollup(join_hot(wide, counted, ["conv_id"], "rows"), "sum(saves) as all_saved, sum(leaves) as n_leaves"), "all_saved", "n_leaves").drop("q1", "q2", "n")
    above = running(own, "conv_id", "depth", {"saves": F.sum})

    parents = stage(own.where("n_children > 0").select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parents")
    named = join_hot(above.withColumnRenamed("n_children", "children"), parents, ["q1", "q2", "depth"], "n_children", "left")
    ends = blocks.groupBy("conv_id").agg(F.bit_xor("p1").alias("k1"), F.bit_xor("p2").alias("k2"), F.sum("size").alias("depth"))
    out = named.join(sums, KEY).join(_digests(ends), KEY, "left")
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id"), "n_convs", F.col("children").alias("n_children"), "n_leaves", (F.col("all_saved") - F.col("saves")).alias("saved_tokens"), F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def _digests(ends: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of the ids of the conversations that end at each node, which stream by in order."""
    ordered = ends.select(*KEY, "conv_id").repartition(*KEY).sortWithinPartitions(*KEY, "conv_id")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None

        def pack(done: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*[pa.array([x[0][k] for x in done], pa.int64()) for k in range(3)], pa.array([x[1] for x in done], pa.string())], names=[*KEY, "ends_sha256"])

        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in KEY])
            cut = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist(), keys.shape[1]]
            ids, done = b.column("conv_id").to_pylist(), []
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i == j:
                    continue
                key = tuple(keys[:, i].tolist())
                if key == last:
                    h.update(b",")
                else:
                    if h:
                        done.append((last, h.hexdigest()))
                    last, h = key, hashlib.sha256()
                h.update(",".join(map(str, ids[i:j])).encode())
            yield pack(done)
        if h:
            yield pack([(last, h.hexdigest())])

    return ordered.mapInArrow(digest, "k1 bigint, k2 bigint, depth bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """trie() of conversations as they stand: turns (conv_id, turn, role, text).

    Turns are ordered by number, null first, equal ones by a hash of role and text; repeated rows are turns one after
    another.  Null role or text: empty.  Rows without conv_id are left out.  Empty table: no nodes.  Other columns are ignored.
    """
    paths = stage(turn_paths(turns), "paths")
    return trie(paths, turns.where(F.col("conv_id").isNotNull()).select("conv_id").distinct())


def rebuild(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, members) with the first h turns of conversation c replaced by those of c - c % FAMILY, h = crc32(c) % HEADS."""
    one = paths.where("at = 0").select("conv_id", "total", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))
    bases = one.where("conv_id = base").select("base", F.col("total").alias("there"))
    plan = stage(one.join(bases, "base", "left").withColumn("given", F.least("h", F.coalesce("there", F.lit(0)))), "plan")
    heads = paths.where((F.col("conv_id") % FAMILY == 0) & (F.col("at") < HEADS)).select(F.col("conv_id").alias("base"), "at", "h1", "h2", "n")
    head = plan.where("given > 0").join(heads, "base").where("at < h").select("conv_id", "at", "h1", "h2", "n")
    own = join_hot(paths.drop("total"), plan.select("conv_id", "total", "h", "given"), ["conv_id"], "total").where("at >= h")
    return head.unionByName(own.select("conv_id", (F.col("given") + F.col("at") - F.col("h")).alias("at"), "h1", "h2", "n")), plan.select("conv_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths, members = rebuild(stage(turn_paths(conversations(spark, sf_dir)), "paths"))
    return trie(stage(paths, "rebuilt"), members)


SQL = f"""
with {CRC_TABLE},
c as (select conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, role, text) as ts from conversations where conv_id is not null group by conv_id),
h as (select *, ({crc_sql('conv_id::varchar')} % 6)::int as h from c, crc),
r as (select h.conv_id, list_concat(case when h.h = 0 or b.ts is null then [] else b.ts[1:h.h] end, h.ts[h.h + 1:]) as ts from h left join c b on b.conv_id = h.conv_id - h.conv_id % 100),
m as (select conv_id, case when d = 0 then [] else ts[1:d] end as p, d, len(ts) = d as over from (select *, unnest(range(len(ts) + 1)) as d from r)),
n as (select p, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where over), '') as ends from m group by p, d),
u as (select *, case when d > 1 then p[1:d - 1] else [] end as q, case when d = 0 then 0 else (n_convs - 1) * length(p[d].t) end as own from n),
kids as (select q as p, d - 1 as d, count(*) as n_children from u where d > 0 group by 1, 2),
w as (select u.*, coalesce(n_children, 0) as n_children from u left join kids using (p, d)),
below as (select case when k = 0 then [] else p[1:k] end as p, k as d, sum(own)::bigint as saved_tokens, count(*) filter (where n_children = 0) as n_leaves from (select *, unnest(range(d + 1)) as k from w) group by 1, 2)
select w.conv_id, w.d as depth, up.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, sha256(w.ends) as ends_sha256
from w join below using (p, d) left join n up on w.d > 0 and up.d = w.d - 1 and up.p = w.q
"""
