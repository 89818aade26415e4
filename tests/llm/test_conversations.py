"""Repair of conversations and the prefix trie against plain Python, one conversation and one prefix at a time."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
from pyspark.sql import functions as F

from ridgelens.llm import repair, trie, turns
from tests.llm.cases import DATA

SCHEMA = "conv_id bigint, turn bigint, role string, text string, key string, id bigint, pos bigint, h1 bigint, n bigint"
BLANK = " \t\n\x0b\x0c\r"


def table(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, 2, 3, 4) for r in rows], SCHEMA).repartition(3)


def damaged(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        x = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if x == 1:
            text = ""
        if x == 2:
            text = re.sub("[.!?]", "", text)
        if x == 4:
            role = "user"
        out[c] += [] if x == 0 else [(t, role, text)] * (2 if x == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0)) for c, v in out.items()}


def faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        body = text.strip(BLANK)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "none")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """(cost, audit, turns): the least by cost and then audit over all edits, by a search of the states behind each row."""
    allowed = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, best = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, out
        if (i, last) in best:
            continue
        best.add((i, last))
        for c in allowed[last].replace("s", ""):
            heapq.heappush(heap, (cost + 3, audit + "I", i, c, (*out, {"u": "user:", "a": "assistant:"}[c])))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, out))
            if found[i] in ("none", "truncated"):
                more = 3 * (found[i] == "truncated")
                if role[:1] and role[0] in allowed[last]:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*out, f"{role}:{text}")))
                for c in allowed[last].replace("s", ""):
                    heapq.heappush(heap, (cost + more + 3, audit + "R", i + 1, c, (*out, {"u": "user:", "a": "assistant:"}[c] + text)))
    raise AssertionError


def reports(rows):
    every, out = damaged(rows), []
    for c in {r[0] for r in rows}:
        own = every.get(c, [])
        found = faults(own)
        cost, audit, text = cheapest(own, found)
        known = {t for t, _, _ in own if t is not None}
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        out.append((c, gaps, *[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(spark, tmp_path, rows):
    table(spark, rows).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    return sorted((tuple(r[c] for c in COLUMNS) for r in repair.query(spark, str(tmp_path)).collect()), key=str)


def test_repair(spark, tmp_path):
    rng = random.Random(1)
    rows = [(None, 3, "user", "Who?"), (None, None, None, None), (8, None, "system", "Be kind."), (9, None, None, ""), (9, 7, "tool", "x."), (9, 7, "tool", "x."), (-3, 5, "user", "Hi. "), (10, 1, "", "No role."), (11, 0, "assistant", " \t")]
    for c in range(20, 220):
        rows += [(c, t * rng.choice((1, 1, 2)) + 10 * t, rng.choice(("system", "user", "assistant", "assistant", "user", "tool")), rng.choice(("Yes.", "No", "", " \n", "Why?", "Fine. ", "one\ntwo!"))) for t in range(rng.randint(1, 9))]
    rows += [(500, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)]
    rows += [(501, 4, "user", "Same.")] * 900 + [(501, t, "user", f"Other {t}") for t in range(5, 900)]
    rng.shuffle(rows)
    assert got(spark, tmp_path, rows) == reports(rows)
    assert got(spark, tmp_path, []) == []


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in turns.conversations(spark, DATA).select("conv_id", "turn", "role", "text").collect()]
    out = repair.query(spark, DATA)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in out.collect()), key=str) == reports(rows)


def test_repaired_turns(spark):
    """The operator's own output: turns in order, roles that alternate, nothing blank but what was made up."""
    rows = [(1, t, r, x) for t, (r, x) in enumerate((("user", "Hi."), ("user", "Hi."), ("user", "And?"), ("system", "Stop."), ("assistant", "Yes")))]
    report, repaired = repair.repair_conversations(table(spark, rows))
    (r,) = report.collect()
    have = [(x.role, x.text) for x in repaired.orderBy("at").collect()]
    cost, audit, text = cheapest([x[1:] for x in rows], faults([x[1:] for x in rows]))
    assert (r.cost, r.audit) == (cost, audit) and tuple(f"{a}:{b}" for a, b in have) == text


def test_long_runs_and_many_runs(monkeypatch):
    """Vectors that are remembered now and then, and halved runs, change nothing."""
    rng = np.random.default_rng(4)
    for runs, longest in ((40, 3), (6, 60)):
        s, n = rng.integers(0, 16, runs), rng.integers(1, longest, runs)
        s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        n = n[: len(s)]
        rows = [(k, {"s": "system", "u": "user", "a": "assistant", "?": "tool"}[repair.ROLES[x % 4]], str(k)) for k, x in enumerate(np.repeat(s, n))]
        want = cheapest(rows, [repair.FAULTS[x // 4] for x in np.repeat(s, n)])[:2]
        for block, part in ((4096, 1024), (3, 2)):
            monkeypatch.setattr(repair, "RUNS", block)
            monkeypatch.setattr(repair, "ROWS", part)
            cost, edits = repair.repair(s, n)
            assert (cost, "".join(e[0] for e in edits)) == want
    cost, edits = repair.repair(np.array([1]), np.array([300_000]))  # users only: each but the last needs an answer
    assert cost == 3 * 150_000 and sum(e[0] == "R" for e in edits) == 150_000


def rebuilt(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t, role or "", text or ""))
    own = {c: [r[1:] for r in sorted(v, key=lambda r: (r[0] is not None, r[0] or 0))] for c, v in own.items()}
    out = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + v[h:]
    return out


def nodes(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children, sums, leaves = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    for node, m in members.items():
        own = (len(m) - 1) * len(node[-1][1]) if node else 0
        for d in range(len(node) + 1):
            sums[node[:d]] += own
            leaves[node[:d]] += not children[node]
    digest = lambda node, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if len(paths[c]) == len(node)).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), children[node], leaves[node], sums[node], digest(node, m)) for node, m in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def test_trie(spark, tmp_path):
    rng = random.Random(2)
    rows = [(None, 0, "user", "nobody"), (7, None, None, None), (7, 2, None, "x"), (301, 0, "user", "é\U0001f600"), (302, 0, "user", "é\U0001f600")]
    for c in [0, 1, 2, 5, *range(100, 190), *range(400, 460)]:
        rows += [(c, t, rng.choice(("user", "assistant")), rng.choice(("a", "bb", "a"))) for t in range(rng.randint(1, 12))]
    for c in range(200, 230):  # copies
        rows += [(c, t, "user", f"same {t % 3}") for t in range(9)]
    rows += [(600, t, "user", f"long {t}") for t in range(70)] + [(600 + k, t, "user", f"long {t}") for k in range(1, 5) for t in range(40 * k)]
    rng.shuffle(rows)
    want = nodes(rebuilt(rows))
    for span in (trie.SPAN, 2):  # prefixes summed in one and in two levels
        table(spark, rows).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
        was, trie.SPAN = trie.SPAN, span
        have = sorted(tuple(r[c] for c in NODE) for r in trie.query(spark, str(tmp_path)).collect())
        trie.SPAN = was
        assert have == want
    table(spark, []).write.mode("overwrite").parquet(str(tmp_path / "conversations.parquet"))
    assert trie.query(spark, str(tmp_path)).count() == 0


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "c")]
    have = {(r.conv_id, r.depth): (r.n_convs, r.n_leaves, r.saved_tokens) for r in trie.prefix_trie(table(spark, rows)).collect()}
    assert have == {(1, 0): (3, 2, 2), (1, 1): (3, 2, 2), (1, 2): (1, 1, 0), (3, 2): (1, 1, 0)}


def test_sql(spark):
    for module, columns in ((repair, COLUMNS), (trie, NODE)):
        c = duckdb.connect()
        c.execute(f"create view conversations as select * from '{DATA}/conversations.parquet'")
        out = c.execute(module.SQL)
        names = [d[0] for d in out.description]
        want = sorted((tuple(r[names.index(x)] for x in columns) for r in out.fetchall()), key=str)
        assert want == sorted((tuple(r[x] for x in columns) for r in module.query(spark, DATA).collect()), key=str) and want
