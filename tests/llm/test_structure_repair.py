"""Repair of conversations against a search over all edits, with pieces of every size."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from offerlens.llm import structure_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, n int, part string, fault int"


def cheapest(rows):
    """(cost, audit, turns) by a best-first search over (row, place), ordered by cost, then by the audit. rows: (role, text, must, cut)."""
    nxt = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if i == len(rows) and q in (0, 3):
            return cost, audit, out
        if (i, q) in done:
            continue
        done.add((i, q))
        for role in ("user", "assistant"):
            if (q, role[0]) in nxt:
                heapq.heappush(heap, (cost + 2, audit + "I", i, nxt[q, role[0]], (*out, (role, ""))))
        if i < len(rows):
            role, text, must, cut = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, out))
            if not must:
                if (q, role[:1]) in nxt:
                    heapq.heappush(heap, (cost + cut, audit + "K", i + 1, nxt[q, role[:1]], (*out, (role, text))))
                for new in ("user", "assistant"):
                    if (q, new[0]) in nxt:
                        heapq.heappush(heap, (cost + 2 + cut, audit + "R", i + 1, nxt[q, new[0]], (*out, (new, text))))


def brute(table):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        role, text = (" " if v is None else v for v in (role, text))
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        kept = convs[conv]
        if d:
            row = (turn, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
            kept += [row] * (2 if d == 3 else 1)
    out = Counter()
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, n, marked = set(), Counter(), []
        for turn, role, text in rows:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            n[fault] += 1
            marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, got = cheapest(marked)
        out[conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got).encode()).hexdigest()] += 1
    return out


def make():
    rng = random.Random(11)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "User", "sys", None]
    texts = ["Yes.", "No!", "so it goes", "", None, " \t", "Well?", "é 漢字.", "end.\n", "x" * 3000 + "."]
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 9)):
            if rng.random() < 0.9:
                regular = ("user", "assistant")[turn % 2]
                rows.append((conv, turn if rng.random() < 0.95 else None, regular if rng.random() < 0.7 else rng.choice(roles), f"turn {turn} of {conv}." if rng.random() < 0.5 else rng.choice(texts)))
    for turn in range(400):  # a long one, with runs of the same, repeated rows and repeated turns
        rows.append((1000, turn // 2 * 3, rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{turn}" + rng.choice((".", ""))))
    rows += [(None, None, None, None), (None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (1000, 30, "user", "same."), (1000, 30, "user", "same."), (1000, 30, "user", "same.")]
    rows += [(2000, None, "assistant", "A."), (2000, None, "user", "B.")]
    rng.shuffle(rows)
    return [(*r, 7, "x", 3) for r in rows]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return Counter(tuple(r) for r in R.summary(R.repaired(R.damaged(df), **how)).collect())


def test_repair_equals_search(spark):
    rows = make()
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, parts=7, piece_rows=5) == want
    assert run(spark, rows, parts=50, piece_rows=1, piece_bytes=1) == want


def test_automaton_equals_search_and_stays_small():
    rng = random.Random(3)
    auto = R.Automaton()
    for _ in range(3000):
        rows = [(rng.choice(("user", "assistant", "system", "tool", "")), f"t{i}", rng.random() < 0.2, int(rng.random() < 0.3)) for i in range(rng.randint(0, 9))]
        symbols = bytes(R.MUST if m else 2 * R.KINDS.get(r[:1], 3) + c for r, _, m, c in rows)
        counts = [1] * len(rows)
        after, costs = auto.scan(symbols, counts)
        audit, turns = auto.walk(symbols, counts, after, [(r, t) for r, t, m, _ in rows if not m], 0, True)
        assert (costs[0], audit, tuple(turns)) == cheapest(rows)
    assert len(auto.vectors) < 60


def test_dropped_and_empty(spark):
    drop = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert run(spark, [(drop, 0, "user", "Hi.", 1, "", 1)]) == Counter({(drop, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()): 1})
    assert run(spark, []) == Counter()


def test_a_hot_row_is_one_row(spark):
    """A row repeated 50,000 times is collapsed before it is dealt out."""
    df = spark.range(50_000).select(F.lit(5).cast("long").alias("conv_id"), F.lit(2).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("Hi.").alias("text"))
    assert R.with_faults(R.collapsed(R.given_rows(df))).count() == 1
    got = R.summary(R.repaired(R.given_rows(df))).first()
    assert (got.duplicate, got.illegal, got.cost, got.audit) == (49_999, 49_999, 3 * 49_999 + 2, "K" + "D" * 49_999 + "I")


def test_turns_of_a_conversation(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Bye.")]
    got = R.repaired(R.given_rows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    turns = R.repaired_turns(got).orderBy("part", "piece", "place").collect()
    assert [(t.role, t.text) for t in turns] == [("user", ""), ("assistant", "Hello."), ("user", "Hi."), ("assistant", "Bye.")]
