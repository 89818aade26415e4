"""Structure repair of conversations by run-length dynamic programming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelens.llm.common import BLANKS, join_hot, stage
from ridgelens.llm.turns import CRC_TABLE, conversations, crc_sql, in_order, piece

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: A row's symbol is a letter from A on: 4 * fault + role.
ROLES, FAULTS = "sua?", ("none", "truncated", "blank", "duplicate")
LETTERS = "ABCDEFGHIJKLMNOP"
#: What may follow what: nothing yet, after a system, a user, an assistant turn.  The only turn that may be made up next, and what it leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FAR = 1 << 60
#: Runs between two remembered vectors, rows of a run unrolled at a time, edits in a row of output.
RUNS, ROWS, EDITS = 4096, 1024, 4096
Matrix = tuple[tuple[int, ...], ...]


def _product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    return tuple(tuple(min(a[i][k] + b[k][j] for k in range(4)) for j in range(4)) for i in range(4))


def _inserts() -> Matrix:
    """The least cost of made-up turns from one state to another."""
    out = [[FAR] * 4 for _ in range(4)]
    for q in range(4):
        at, cost = q, 0
        while out[q][at] > cost:
            out[q][at] = cost
            at, cost = NEXT[at][1], cost + INSERT
    return tuple(map(tuple, out))


CLOSED = _inserts()
#: Costs from each state behind the last row.
AFTER_LAST = tuple(min(CLOSED[q][START], CLOSED[q][ASSISTANT]) for q in range(4))


def _steps(symbol: int) -> dict[str, list[tuple[int, int] | None]]:
    """For each edit that takes a row: (cost, next state) from each state, or None."""
    role, fault = ROLES[symbol % 4], FAULTS[symbol // 4]
    out: dict[str, list[tuple[int, int] | None]] = {"D": [(DELETE, q) for q in range(4)]}
    if fault in ("none", "truncated"):
        more = TRUNCATED if fault == "truncated" else 0
        out["K"] = [(more, KEPT[q, role]) if (q, role) in KEPT else None for q in range(4)]
        out["R"] = [(REROLE + more, NEXT[q][1]) for q in range(4)]
    return out


STEPS = [_steps(k) for k in range(16)]


@lru_cache(maxsize=None)
def power(symbol: int, bit: int) -> Matrix:
    """The transition of 2 ** bit rows of one symbol, made-up turns before each included."""
    if bit:
        return _product(power(symbol, bit - 1), power(symbol, bit - 1))
    own = [[min([cost for x in STEPS[symbol].values() if x[q] and x[q][1] == to for cost in [x[q][0]]], default=FAR) for to in range(4)] for q in range(4)]
    return _product(CLOSED, tuple(map(tuple, own)))


def advance(symbol: int, rows: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Least costs before `rows` rows of a symbol, given those after them."""
    for bit in range(rows.bit_length()):
        if rows >> bit & 1:
            m = power(symbol, bit)
            after = tuple(min(m[q][k] + after[k] for k in range(4)) for q in range(4))
    return after


def _unroll(symbol: int, rows: int, state: int, after: tuple[int, ...]) -> Iterator[tuple[str, int, int]]:
    """(edit, state before, state after) through a run, the ASCII-least of the cheapest; long runs are halved first."""
    if FAULTS[symbol // 4] in ("blank", "duplicate"):  # made-up turns can wait, and D comes before I
        for _ in range(rows):
            yield "D", state, state
        return
    if rows > ROWS:
        half = rows // 2
        middle = advance(symbol, rows - half, after)
        for e in _unroll(symbol, half, state, middle):
            state = e[2]
            yield e
        yield from _unroll(symbol, rows - half, state, after)
        return
    costs = [after]
    for _ in range(rows):
        costs.append(advance(symbol, 1, costs[-1]))
    costs.reverse()
    steps, k = STEPS[symbol], 0
    while k < rows:
        now, then = costs[k], costs[k + 1]
        for edit in "DIKR":
            if edit == "I":
                cost, to = INSERT + now[NEXT[state][1]], NEXT[state][1]
            elif edit in steps and steps[edit][state]:
                cost, to = steps[edit][state]
                cost += then[to]
            else:
                continue
            if cost == now[state]:
                yield edit, state, to
                state, k = to, k + (edit != "I")
                break


def repair(symbols: np.ndarray, counts: np.ndarray) -> tuple[int, Iterator[tuple[str, int, int]]]:
    """(cost, edits) of a conversation given as runs of symbols.

    Going back over the runs, each takes the vector of least costs by state past all its rows at once; one vector in
    RUNS is remembered.  Going forward, those of a stretch of RUNS runs are made again and its edits chosen: at each
    step the first letter that keeps the total least.  A state leaves at most one continuation for each letter, so
    this is the ASCII-least audit, and the audit tells the repaired roles.
    """
    held, costs = [AFTER_LAST], AFTER_LAST
    for end in range(len(symbols), 0, -RUNS):
        for s, n in zip(symbols[max(0, end - RUNS) : end][::-1].tolist(), counts[max(0, end - RUNS) : end][::-1].tolist(), strict=True):
            costs = advance(s, n, costs)
        held.append(costs)

    def walk() -> Iterator[tuple[str, int, int]]:
        state, ends = START, list(range(len(symbols), 0, -RUNS))[::-1]
        for k, end in enumerate(ends):
            begin, after = max(0, end - RUNS), [held[len(ends) - 1 - k]]
            own = list(zip(symbols[begin:end].tolist(), counts[begin:end].tolist(), strict=True))
            for s, n in own[::-1]:
                after.append(advance(s, n, after[-1]))
            for (s, n), behind in zip(own, after[-2::-1], strict=True):
                for e in _unroll(s, n, state, behind):
                    state = e[2]
                    yield e
        while state not in (START, ASSISTANT):
            yield "I", state, NEXT[state][1]
            state = NEXT[state][1]

    return costs[START], walk()


def damage(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with nulls as one space, changed by a checksum; `times`: 2 for a repeated row.

    crc32("conv_id:turn") % 20: 0 drops the row, 1 empties its text, 2 takes `.`, `!` and `?` out, 3 repeats it, 4 makes
    it a user's.
    """
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    t = turns.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), (F.crc32(F.concat_ws(":", of("conv_id"), of("turn")).cast("binary")) % 20).alias("x")).where("x > 0")
    text = F.when(F.col("x") == 1, "").when(F.col("x") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.when(F.col("x") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("x") == 3, 2).otherwise(1).alias("times"))


def _symbols(fault: Column) -> Column:
    """Letter of a row: its fault (an index of FAULTS) and role."""
    role = F.lit(3)
    for k, c in enumerate(ROLES[:3]):
        role = F.when(F.col("role").startswith(c), k).otherwise(role)
    return F.substring(F.lit(LETTERS), 4 * fault + role + 1, F.lit(1))


def repair_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, repaired) of turns (conv_id, turn, role, text, and times: how often a row stands; 1 without that column).

    report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.  repaired: conv_id, at, role, text, in order
    of `at`.

    Rows of a conversation are ordered by turn (nulls first), then by hashes of role and text.  A row's first fault
    counts: blank, duplicate (its role and text stand earlier), truncated (its last non-blank is none of .!?).  Edits: K
    keeps a row if the order of roles allows it, R makes it a user's or assistant's, D deletes it (blank and duplicate
    rows must go), I makes up an empty turn, for the costs above; roles by their first letter then read (s?(ua)+)?.
    The audit has the edits' letters in order, the ASCII-least of the cheapest.  gaps: missing whole numbers between the
    least and largest turn.  Roles that start with none of s, u, a can't be kept.

    Texts stay out of the way: equal rows are counted together first, then narrow rows are put in order by ranges of
    conversation and turn, so one conversation of very many rows is dealt over many tasks, and only its letters, with
    counts of repeats, meet in one row, which is no longer than its audit.  Edits leave in rows of EDITS, and kept texts
    meet them by a hash of the row.  Null role or text: one space.  Null turns count for no gap.  Null conv_id: a
    conversation of its own.  Ties and repeated rows: of equal rows all but the first are duplicates.  Empty table: both
    results empty.  Other columns are left out.
    """
    if "times" not in turns.columns:
        turns = turns.withColumn("times", F.lit(1))
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "turn", of("role").alias("role"), of("text").alias("text"), "times")
    same = [F.xxhash64("key", "role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role", "key").alias("h2")]
    rows = rows.select("*", *same).withColumn("id", F.xxhash64("h1", "h2", F.col("turn").isNull(), "turn"))
    end = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    fault = F.when(end == "", 2).when(end.isin(".", "!", "?"), 0).otherwise(1)
    narrow = rows.select("conv_id", "key", "turn", "h1", "h2", "id", _symbols(fault).alias("letter"), _symbols(F.when(end == "", 2).otherwise(3)).alias("again"), "times")
    entries = stage(narrow.groupBy("conv_id", "key", "turn", "h1", "h2", "id", "letter", "again").agg(F.sum("times").alias("times")), "entries")
    # texts of a conversation that stand in more than one turn: the first one is no duplicate
    early = F.min(F.when(F.col("turn").isNull(), F.lit(True)))
    firsts = stage(entries.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("turn").alias("least"), early.alias("has_null")).where("n > 1"), "first-turns")
    met = join_hot(entries, firsts, ["h1", "h2"], "n", "left")
    first = F.when(F.col("has_null"), F.col("turn").isNull()).when(F.col("least").isNotNull(), F.col("turn") == F.col("least")).otherwise(True)
    more = F.col("times") - 1
    text = F.concat(F.when(first, F.col("letter")).otherwise(F.col("again")), F.when(more > 0, F.concat(F.col("again"), F.when(more > 1, more.cast("string")).otherwise(""))).otherwise(""))
    ordered = in_order(met.select("conv_id", "key", "turn", "id", "h1", "h2", text.alias("run")), "key", ["turn", "h1", "h2"], "turns")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("pos", "run"))), lambda x: x["run"])
    pieces = ordered.groupBy("key", piece().alias("piece")).agg(F.min("pos").alias("first"), F.count("*").alias("n"), F.array_join(listed, ",").alias("runs"))
    whole = pieces.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("piece", "first", "n", "runs"))).alias("pieces"))
    spread = ordered.groupBy("conv_id", "key").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count_distinct("turn").alias("turns"))
    schema = "key string, part int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, kept array<struct<pos:bigint,at:bigint,role:string>>, added array<struct<at:bigint,role:string>>"
    made = stage(whole.mapInArrow(_repaired, schema), "edits")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long")
    report = spread.select("conv_id", "key", gaps.alias("gaps")).join(made.where("part = 0").drop("part", "kept", "added"), "key").drop("key")
    kept = made.select(F.explode("kept").alias("e")).select("e.pos", "e.at", F.col("e.role").alias("new"))
    kept = kept.join(ordered.select("pos", "conv_id", "id"), "pos").select("conv_id", "id", "at", "new")
    texts = rows.select("id", "role", "text").dropDuplicates(["id"]).join(kept, "id").select("conv_id", "at", F.coalesce("new", "role").alias("role"), "text")
    added = made.select("key", F.explode("added").alias("e")).join(spread.select("conv_id", "key"), "key").select("conv_id", "e.at", "e.role", F.lit("").alias("text"))
    return report, texts.unionByName(added)


def _runs(pieces: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols and lengths of runs of a conversation, one after another, and of its entries (rows that are equal count as one) the number of rows."""
    letters, counts, own = [], [], []
    for p in pieces:
        for run in p["runs"].split(","):
            letters.append(run[0])
            counts.append(1)
            if len(run) > 1:
                letters.append(run[1])
                counts.append(int(run[2:] or 1))
            own.append(1 + (counts[-1] if len(run) > 1 else 0))
    s, n = np.frombuffer("".join(letters).encode(), np.uint8).astype(np.int64) - ord("A"), np.array(counts, np.int64)
    begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    return s[begin], np.add.reduceat(n, begin), np.array(own, np.int64)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audits and edits of whole conversations, in rows of EDITS edits."""
    kept_type, added_type = pa.list_(pa.struct([("pos", pa.int64()), ("at", pa.int64()), ("role", pa.string())])), pa.list_(pa.struct([("at", pa.int64()), ("role", pa.string())]))
    types = [("key", pa.string()), ("part", pa.int32()), *[(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string()), ("kept", kept_type), ("added", added_type)]

    def pack(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(types)], names=[n for n, _ in types])

    rows: list[tuple] = []
    for b in batches:
        for key, pieces in zip(b.column("key").to_pylist(), b.column("pieces"), strict=True):
            pieces = pieces.as_py()
            s, n, own = _runs(pieces)
            role, fault = s % 4, s // 4
            faults = [int(n[fault == FAULTS.index(f)].sum()) for f in ("blank", "duplicate", "truncated")]
            pairs = np.zeros((4, 4), bool)
            pairs[[0, 1, 2], [1, 2, 1]] = True
            illegal = int((n - 1).sum() + (~pairs[role[:-1], role[1:]]).sum())
            cost, edits = repair(s, n)
            places = np.concatenate([np.arange(p["first"], p["first"] + p["n"]) for p in pieces])
            audit, kept, added, at, row, entry, part = [], [], [], 0, 0, 0, 1
            ends = np.cumsum(own)
            for edit, state, to in edits:
                audit.append(edit)
                if edit == "I":
                    added.append((at, NEXT[state][0]))
                else:
                    if edit != "D":
                        while row >= ends[entry]:
                            entry += 1
                        kept.append((int(places[entry]), at, NEXT[state][0] if edit == "R" else None))
                    row += 1
                at += edit != "D"
                if len(kept) + len(added) >= EDITS:
                    rows.append((key, part, *[None] * 6, kept, added))
                    kept, added, part = [], [], part + 1
                    if len(rows) >= 64:
                        yield pack(rows)
                        rows = []
            rows.append((key, 0, *faults, illegal, cost, "".join(audit), kept, added))
            if len(rows) >= 1024:
                yield pack(rows)
                rows = []
    if rows:
        yield pack(rows)


def text_digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of the newline-joined role:text of each conversation, whose turns stream by in order."""
    ordered = repaired.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key"), "at", F.concat_ws(":", "role", "text").alias("line"))
    ordered = ordered.repartition("key").sortWithinPartitions("key", "at").select("key", "line")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, h = None, None
        for b in batches:
            done: list[tuple[str, str]] = []
            for key, line in zip(b.column("key").to_pylist(), b.column("line").to_pylist(), strict=True):
                if key == last:
                    h.update(b"\n")
                else:
                    if h:
                        done.append((last, h.hexdigest()))
                    last, h = key, hashlib.sha256()
                h.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in (0, 1)], names=["key", "repaired_sha256"])
        if h:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (last, h.hexdigest())], names=["key", "repaired_sha256"])

    return ordered.mapInArrow(digest, "key string, repaired_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations(spark, sf_dir)
    report, repaired = repair_conversations(damage(turns))
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")
    every = turns.select("conv_id", key).distinct()
    out = every.join(report.select(key, "*").drop("conv_id"), "key", "left").join(text_digests(repaired), "key", "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
SQL = f"""
with recursive {CRC_TABLE},
raw as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as mark from conversations),
x as (select *, {crc_sql('mark')} % 20 as x from raw, crc),
damaged as (select conv_id, turn, case when x = 4 then 'user' else role end as role, case x when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case x when 0 then 0 when 3 then 2 else 1 end)) from x),
o as (select conv_id, turn, role, text, trim(text, {_BLANKS}) as body, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from damaged),
f as (select *, left(role, 1) as r, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else 'none' end as fault from o),
k as (select *, case fault when 'none' then 0 when 'truncated' then 3 else 1000000 end as k, lag(r) over (partition by conv_id order by i) as before from f),
report as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
  count(*) filter (where i > 1 and before || r not in ('su', 'ua', 'au')) as illegal, count(*) as n from k group by conv_id),
-- least costs before row i by state: nothing yet, after a system, a user, an assistant turn
v(conv_id, i, v) as (select conv_id, n + 1, [0, 6, 3, 0] from report union all
  select conv_id, i, [least(w0, 3 + w2, 6 + w3), least(w1, 3 + w2, 6 + w3), least(w2, 3 + w3), least(w3, 3 + w2)] from (
    select k.conv_id, k.i, least(4 + v[1], case r when 's' then k + v[2] when 'u' then k + v[3] end, k + 3 + v[3]) as w0, least(4 + v[2], case r when 'u' then k + v[3] end, k + 3 + v[3]) as w1,
      least(4 + v[3], case r when 'a' then k + v[4] end, k + 3 + v[4]) as w2, least(4 + v[4], case r when 'u' then k + v[3] end, k + 3 + v[3]) as w3
    from v join k on k.conv_id is not distinct from v.conv_id and k.i = v.i - 1)),
steps as (select v.conv_id, v.i, v.v, z.v as z, k.role, k.text, k.r, k.k from v left join v z on z.conv_id is not distinct from v.conv_id and z.i = v.i + 1 left join k on k.conv_id is not distinct from v.conv_id and k.i = v.i),
walk(conv_id, i, q, cost, audit, lines) as (select conv_id, 1::bigint, 1, v[1], '', []::varchar[] from v where i = 1 union all
  select conv_id, case edit when 'I' then i else i + 1 end, case edit when 'D' then q when 'K' then kq else nq end, cost, audit || edit,
    case edit when 'D' then lines when 'K' then list_append(lines, role || ':' || text) else list_append(lines, case nq when 3 then 'user:' else 'assistant:' end || case edit when 'R' then text else '' end) end
  from (select *, case when 4 + z[q] = v[q] then 'D' when 3 + v[nq] = v[q] then 'I' when k + z[kq] = v[q] then 'K' when k + 3 + z[nq] = v[q] then 'R' end as edit from (
    select w.*, s.* exclude (conv_id, i), case w.q when 3 then 4 else 3 end as nq, case when w.q = 1 and r = 's' then 2 when w.q <> 3 and r = 'u' then 3 when w.q = 3 and r = 'a' then 4 end as kq
    from walk w join steps s on s.conv_id is not distinct from w.conv_id and s.i = w.i))
  where edit is not null),
done as (select conv_id, cost, audit, array_to_string(lines, chr(10)) as body from (select *, row_number() over (partition by conv_id order by length(audit) desc) as nth from walk) where nth = 1)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join report p on p.conv_id is not distinct from c.conv_id left join done d on d.conv_id is not distinct from c.conv_id
"""
