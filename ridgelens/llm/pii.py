"""Personal data: exact patterns, and spans that a semi-Markov conditional random field adds where the patterns merge matches or miss a bracketed number."""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgelens.llm.common import documents

KINDS = ("email", "ip", "card", "phone")
#: At most so many stretches of text, those of smallest hash, train the field, so many times, in so many steps at least.
SAMPLE, EPOCHS, LEAST_STEPS, SEED = 1500, 8, 3000, 5
#: Words of the longest entity; probability from which a segment of the best path is taken.
LONGEST, SURE = 6, 0.8

# fixed values: the base patterns, written so that no text makes them step back more than once over a character
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TRIGGER = re.compile(r"[0-9@][^\x20\x09-\x0D]*")
_EMAIL_WHOLE = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_PHONE_BARE = re.compile(r"\(?[0-9][\x20().0-9-]+[0-9]")
_BRACKETED = re.compile(r"\([0-9]{2,5}\)[\x20-]?[0-9][0-9\x20-]*[0-9]")
_BLANK = " \t\n\x0b\x0c\r"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d += d * (k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base_spans(t: str) -> dict[str, list[tuple[int, int]]]:
    """Per kind, the leftmost matches that do not overlap and pass the kind's rule; a match that fails is dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    end, at = 0, t.find("@")
    while at >= 0:
        low = at
        while low > end and t[low - 1] in _LOCAL:
            low -= 1
        m = _DOMAIN.match(t, at + 1) if low < at else None
        if m:
            end = m.end()
            out["email"].append((low, end))
        # what lies before a failing @ can not belong to a later match: @ is no part of a name
        at = t.find("@", end if m else at + 1)
        end = end if m else max(end, 0)
    out["ip"] = [m.span() for m in _IP.finditer(t) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out["card"].append(m.span())
    if "+" in t:
        out["phone"] = [m.span() for m in _PHONE.finditer(t) if 9 <= len(_digits(m[0])) <= 15]
    return out


def stretches(t: str) -> list[list[tuple[int, int]]]:
    """Runs of words (start, end) that hold a digit or @, one blank apart."""
    runs: list[list[tuple[int, int]]] = []
    last = 0
    for m in _TRIGGER.finditer(t):
        a = m.start()
        while a > last and t[a - 1] not in _BLANK:
            a -= 1
        last = m.end()
        if runs and runs[-1][-1][1] + 1 == a and t[a - 1] == " ":
            runs[-1].append((a, last))
        else:
            runs.append([(a, last)])
    return runs


def trim(t: str, a: int, b: int) -> tuple[int, int]:
    """A span without the marks of the sentence around it, nor brackets at its ends that have no partner in it."""
    over = t.count(")", a, b) - t.count("(", a, b)
    while b > a and (t[b - 1] in ".,;:!?\"'>]}" or (t[b - 1] == ")" and over > 0)):
        b -= 1
        over -= t[b] == ")"
    while a < b and (t[a] in "\"'<[{" or (t[a] == "(" and over < 0)):
        over += t[a] == "("
        a += 1
    return a, b


def bracketed(s: str) -> bool:
    """A number of 9 to 12 digits that starts with its area in brackets."""
    return s[:1] == "(" and bool(_BRACKETED.fullmatch(s)) and 9 <= len(_digits(s)) <= 12


def features(s: str, words: int) -> list[float]:
    """What a whole span looks like."""
    d = _digits(s)
    n, letters = len(d), any(c.isalpha() for c in s)
    parts = s.split(".")
    four = len(parts) == 4 and all(p and not p.strip("0123456789") for p in parts)
    card = bool(_CARD.fullmatch(s)) and 13 <= n <= 19
    plus = bool(_PHONE.fullmatch(s))
    right = card and luhn(d)
    bare = not plus and bool(_PHONE_BARE.fullmatch(s)) and any(c in "()-" for c in s)
    flags = [
        True, words == 1, words == 2, words == 3, words > 3, letters, "@" in s, bool(_EMAIL_WHOLE.fullmatch(s)), four, four and all(map(_small, parts)), card and not right, right, right and words == 1, right and " " in s,
        plus, plus and 9 <= n <= 15, plus and n > 15, bare, bare and 9 <= n <= 12, bracketed(s), s[:1] == "+", n < 7, 7 <= n <= 8, 9 <= n <= 12, 13 <= n <= 15, n == 16, 17 <= n <= 19, n > 19, n > 0 and n == len(s), words > 1 and "+" in s[1:], words > 1 and "@" in s, words > 1 and four,
    ]
    return [float(x) for x in flags]


N_FEATURES = len(features("", 1))
LABELS = 1 + len(KINDS)  # 0: a word outside all entities


@dataclass
class Field:
    weights: np.ndarray  # labels x features
    steps: np.ndarray  # label to label


def _scores(m: Field, t: str, words: list[tuple[int, int]]) -> tuple[np.ndarray, dict]:
    """[end, words - 1, label] scores of segments, and features by (end, words - 1); words outside are single."""
    out = np.full((len(words), LONGEST, LABELS), -np.inf)
    seen = {}
    for j in range(len(words)):
        for k in range(min(LONGEST, j + 1)):
            a, b = trim(t, words[j - k][0], words[j][1])
            f = np.array(features(t[a:b], k + 1))
            seen[j, k] = f
            out[j, k] = m.weights @ f
            if k:
                out[j, k, 0] = -np.inf
    return out, seen


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _marginals(m: Field, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of segments, and expected label steps, by the forward and backward sums over segmentations."""
    n = len(s)
    fore = np.full((n + 1, LABELS), -np.inf)
    fore[0, 0] = 0
    for j in range(n):
        for k in range(min(LONGEST, j + 1)):
            fore[j + 1] = np.logaddexp(fore[j + 1], _log_sum(fore[j - k][:, None] + m.steps, 0) + s[j, k])
    back = np.full((n + 1, LABELS), -np.inf)
    back[n] = 0
    for i in range(n - 1, -1, -1):
        for k in range(min(LONGEST, n - i)):
            back[i] = np.logaddexp(back[i], _log_sum(m.steps + (s[i + k, k] + back[i + k + 1])[None, :], 1))
    total = _log_sum(fore[n], 0)
    p, steps = np.zeros_like(s), np.zeros((LABELS, LABELS))
    for j in range(n):
        for k in range(min(LONGEST, j + 1)):
            each = np.exp(fore[j - k][:, None] + m.steps + (s[j, k] + back[j + 1])[None, :] - total)
            p[j, k] = each.sum(0)
            steps += each
    return p, steps


def best_path(m: Field, s: np.ndarray) -> list[tuple[int, int, int]]:
    """(first word, last word, label) of the best segmentation's entities."""
    n = len(s)
    top = np.full((n + 1, LABELS), -np.inf)
    top[0, 0] = 0
    came = {}
    for j in range(n):
        for k in range(min(LONGEST, j + 1)):
            way = top[j - k][:, None] + m.steps
            got = way.max(0) + s[j, k]
            for y in np.flatnonzero(got > top[j + 1]):
                top[j + 1, y] = got[y]
                came[j + 1, int(y)] = (j - k, int(way[:, y].argmax()))
    out, at, y = [], n, int(top[n].argmax())
    while at:
        i, before = came[at, y]
        if y:
            out.append((i, at - 1, y))
        at, y = i, before
    return out[::-1]


def _gold(t: str, words: list[tuple[int, int]]) -> list[tuple[int, int, int]] | None:
    """The base matches as segments of words, or None where they do not fit the words or each other."""
    found = base_spans(t)
    gold = []
    for y, kind in enumerate(KINDS, 1):
        for span in found[kind]:
            fits = [(i, j) for i in range(len(words)) for j in range(i, min(len(words), i + LONGEST)) if trim(t, words[i][0], words[j][1]) == span]
            if not fits:
                return None
            gold.append((*fits[0], y))
    gold.sort()
    return None if any(a[1] >= b[0] for a, b in zip(gold, gold[1:], strict=False)) else gold


def regrouped(s: str, rng: np.random.Generator) -> str:
    """A number with its digits in other groups, the country's code and the digits themselves kept."""
    code = re.match(r"\+[0-9]{1,3}(?![0-9])", s)
    head, rest = (code[0], _digits(s[code.end() :])) if code else ("+" if s[:1] == "+" else "", _digits(s))
    groups = [head] if code else []
    while rest:
        n = 4 if not s.startswith("+") else int(rng.integers(2, 5))
        n = len(rest) if len(rest) - n < 2 else n
        groups.append(rest[:n])
        rest = rest[n:]
    mark = " " if len(groups) <= LONGEST and rng.random() < 0.7 else "-"
    return ("" if code else head) + mark.join(groups)


def fit(texts: list[str], *, epochs: int = EPOCHS, seed: int = SEED) -> Field:
    """Likelihood ascent (Adagrad) on stretches labelled by the base patterns.

    A stretch that is one base match is a sure case; so is what follows the country's code in one with its area in
    brackets, which the patterns miss.  Sure numbers stand again with their digits in other groups (regrouped), where
    the patterns take those whole.  Stretches of several sure cases side by side, which the patterns alone would merge, are made
    from all of these and labelled by what they were made from.  A stretch with a bracketed number that no pattern matches is no case: what
    the patterns say of it is not known to be right.  Without texts: nothing is added.
    """
    rng = np.random.default_rng(seed)
    m = Field(np.zeros((LABELS, N_FEATURES)), np.zeros((LABELS, LABELS)))
    m.weights[0, 0] = 3.0 if not texts else 0.0
    sure, cases = [], []
    for t in texts:
        words = [w for run in stretches(t)[:1] for w in run]
        gold = _gold(t, words) if len(words) <= 4 * LONGEST else None
        if gold is None or (not gold and any(bracketed(t[slice(*trim(t, words[i][0], words[j][1]))]) for i in range(len(words)) for j in range(i, min(len(words), i + LONGEST)))):
            continue
        cases.append((t, words, gold))
        if len(gold) == 1 and gold[0][:2] == (0, len(words) - 1):
            sure.append((t, gold[0][2]))
            own = t[max(t.find("("), 0) :]
            if KINDS[gold[0][2] - 1] == "phone" and bracketed(own):
                sure.append((own, gold[0][2]))
                cases.append((own, stretches(own)[0], [(0, len(stretches(own)[0]) - 1, gold[0][2])]))
    several = len(sure)
    for t, y in sure[:several]:
        other = regrouped(t, rng) if KINDS[y - 1] in ("card", "phone") and "(" not in t else t
        words = [w for run in stretches(other) for w in run]
        if other != t and _gold(other, words) == [(0, len(words) - 1, y)]:
            sure.append((other, y))
            cases.append((other, words, [(0, len(words) - 1, y)]))
    by_kind = {y: [t for t, k in sure if k == y] for y in {k for _, k in sure}}
    for _ in range(several):  # each kind alike
        parts = [(by_kind[y][rng.integers(len(by_kind[y]))], y) for y in rng.choice(sorted(by_kind), rng.integers(2, 4))]
        t = " ".join(p for p, _ in parts)
        words, gold, at = [w for run in stretches(t) for w in run], [], 0
        for p, y in parts:
            n = sum(map(len, stretches(p)))
            gold.append((at, at + n - 1, y))
            at += n
        if at == len(words):
            cases.append((t, words, gold))
    seen_w, seen_s = np.full_like(m.weights, 1e-2), np.full_like(m.steps, 1e-2)
    for _ in range(max(epochs, LEAST_STEPS // max(len(cases), 1)) if cases else 0):
        for c in rng.permutation(len(cases)):
            t, words, gold = cases[c]
            s, f = _scores(m, t, words)
            p, expected = _marginals(m, s)
            g = np.zeros_like(m.weights)
            for (j, k), x in f.items():
                g -= p[j, k][:, None] * x[None, :]
            steps, at, before = -expected, 0, 0
            for i, j, y in [*gold, (len(words), len(words), -1)]:
                for w in range(at, i):
                    g[0] += f[w, 0]
                    steps[before, 0] += 1
                    before = 0
                if y > 0:
                    g[y] += f[j, j - i]
                    steps[before, y] += 1
                    before, at = y, j + 1
            g -= 1e-3 * m.weights
            seen_w += g * g
            seen_s += steps * steps
            m.weights += 0.3 * g / np.sqrt(seen_w)
            m.steps += 0.3 * steps / np.sqrt(seen_s)
    return m


def added_spans(m: Field, t: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the field's entities that no base match of their kind overlaps."""
    out = []

    def met(kind: str, a: int, b: int) -> bool:
        """Whether a base match of this kind, which do not overlap each other, overlaps the span."""
        k = bisect_left(base[kind], (b,)) - 1
        return k >= 0 and base[kind][k][1] > a

    for words in stretches(t):
        if len(words) == 1 and (any(met(kind, *words[0]) for kind in base) or not any(c in "+@" for c in t[words[0][0] : words[0][1]]) and sum(c in "0123456789" for c in t[words[0][0] : words[0][1]]) < 4):
            continue  # one word: a base match, or too few digits for any kind
        s, _ = _scores(m, t, words)
        path = best_path(m, s)
        if not path:
            continue
        p, _ = _marginals(m, s)
        for i, j, y in path:
            a, b = trim(t, words[i][0], words[j][1])
            if p[j, j - i, y] >= SURE and not met(KINDS[y - 1], a, b):
                out.append((y - 1, a, b))
    return out


def sample(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """The SAMPLE stretches (s) of smallest hash, of at most 400 characters, over all documents, in one partition.

    A task hands on the SAMPLE smallest it has seen, so what is shuffled grows with the tasks, not with the stretches.
    """

    def rank(s: str) -> tuple[bool, int]:  # as the order below
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        return len(s) < 8, h - (h >> 63 << 64)

    def cut(batches):
        least: dict[str, tuple[bool, int]] = {}
        for b in batches:
            for t in b.column("body").to_pylist():
                for s in {t[r[0][0] : r[-1][1]] for r in stretches(t) if r[-1][1] - r[0][0] <= 400} - least.keys():
                    least[s] = rank(s)
                if len(least) > 4 * SAMPLE:
                    least = dict(sorted(least.items(), key=lambda x: x[1])[:SAMPLE])
        yield pa.RecordBatch.from_arrays([pa.array(sorted(least, key=least.get)[:SAMPLE], pa.string())], names=["s"])

    body = docs.select(F.col(f"`{text}`").alias("body")).where(F.col("body").rlike("[0-9@]"))
    found = body.mapInArrow(cut, "s string").distinct()
    # words of one short number are most of all stretches, and say the least
    rare = F.when(F.length("s") < 8, 1).otherwise(0)
    return found.orderBy(rare, F.xxhash64("s"), "s").limit(SAMPLE)


def train(docs: DataFrame, *, text: str = "text") -> Field:
    """The field fitted on the sample, in the one task that sees it."""

    def learn(batches):
        texts = sorted(t for b in batches for t in b.column("s").to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts))], pa.binary())], names=["field"])

    found = sample(docs, text=text).coalesce(1).mapInArrow(learn, "field binary").collect()
    return pickle.loads(found[0].field) if found else fit([])  # of an empty table there may be no task at all


def find_personal_data(docs: DataFrame, field: Field, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, and base and spans: arrays of (kind, start, end) in code points, end exclusive.

    base: the patterns' matches, kinds in the order of KINDS, then by start.  spans: those and the field's.  For the
    field, words with digits or @ that stand one blank apart form a stretch; all segments of up to LONGEST words are scored
    as a whole, and boundaries and kinds of the stretch are chosen together.  Null and empty texts have no spans.
    Rows are independent: ties, repeats and empty tables need nothing.  Kept columns named base or spans are replaced.
    """
    names = [c for c in keep if c not in ("base", "spans")]
    narrow = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("__text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
    types = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names], *[f"{c} array<struct<kind:string,start:int,end:int>>" for c in ("base", "spans")]])

    def run(batches):
        for b in batches:
            base, spans = [], []
            for t in b.column("__text").to_pylist():
                if not _TRIGGER.search(t):
                    base.append([])
                    spans.append([])
                    continue
                found = base_spans(t)
                own = [(k, *x) for k, kind in enumerate(KINDS) for x in found[kind]]
                base.append([{"kind": KINDS[k], "start": a, "end": e} for k, a, e in own])
                spans.append([{"kind": KINDS[k], "start": a, "end": e} for k, a, e in sorted({*own, *added_spans(field, t, found)})])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(base, pa.list_(span)), pa.array(spans, pa.list_(span))], names=[*names, "base", "spans"])

    return narrow.mapInArrow(run, types)


def _joined(column: str):
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find_personal_data(docs, train(docs))
    counts = [F.size(F.array_remove(F.transform("base", lambda s: F.when(s["kind"] == kind, 1).otherwise(0)), 0)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))
