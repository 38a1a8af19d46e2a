import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from gaugebook.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        kind = zlib.crc32(f"{shown[0]}:{shown[1]}".encode()) % 20
        role, text = shown[2:]
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        yield from [(conv, turn, role, text)] * (2 if kind == 3 else 1)


def ends(state):
    return state in ("", "a")


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0]]
    for r in damage(rows):
        groups[r[0]].append(r)
    out = []
    for conv, left in groups.items():
        left.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for _, _, role, text in left:
            body = text.rstrip(WHITE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append((role, text, fault))
        turns = [r[1] for r in left if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in left]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit, kept = search(faults)
        out.append((conv, gaps, *[sum(f[2] == k for f in faults) for k in ("blank", "duplicate", "truncated")], illegal, cost,
                    audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def search(faults):
    """Uniform-cost search over (row, last initial), least (cost, audit) first."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, state, out = heapq.heappop(heap)
        if i == len(faults) and ends(state):
            return cost, audit, list(out)
        if (i, state) in done:
            continue
        done.add((i, state))
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[state]
        if i < len(faults):
            role, text, fault = faults[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if fault not in ("blank", "duplicate"):
                extra = 5 if fault == "truncated" else 0
                for letter, new, price in (("K", role, 0), ("R", "user", 1), ("R", "assistant", 1)):
                    if new[:1] and new[:1] in legal:
                        heapq.heappush(heap, (cost + price + extra, audit + letter, i + 1, new[0], out + (f"{new}:{text}",)))
        for new in ("user", "assistant"):
            if new[0] in legal:
                heapq.heappush(heap, (cost + 5, audit + "I", i, new[0], out + (f"{new}:",)))


def conversations(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            if rng.random() < 0.1:
                continue
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", "usher", None])
            text = rng.choice(["Hello there.", "Why?", "No end", "", " \n", "Done! ", "x. ", None, f"text {rng.randint(0, 9)}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn, turn // 2, None]), role, text))
    return rows + rows[:5] + [(None, 1, "user", "a."), (None, None, "user", "a."), (None, 2, "assistant", "b.")]


def run(spark, rows, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS part", "'y' AS cost", "'z' AS edits", "1 AS entry")
        got = C.audit(df)
        assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        return sorted(map(tuple, got.collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_matches_brute_force(spark):
    rows = conversations(1, 150, 9)
    assert run(spark, rows, 4) == brute(rows)


def test_one_conversation_over_many_ranges(spark):
    """Segments of one conversation are solved apart and fit together."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(7, t, r, x) for _, t, r, x in conversations(2, 3, 150)] + [(8, 0, "user", "q.")]
        rows = [(c, None if t is None else t * 3 + k % 3, r, x) for k, (c, t, r, x) in enumerate(rows)]
        df = spark.createDataFrame(rows, SCHEMA)
        turns, _ = C.repaired(C.damaged(df))
        assert turns.where("conv_id = 7").select("part").distinct().count() > 2
        assert run(spark, rows, 4) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_edit_rows(spark):
    rows = [(1, 0, "user", "A?"), (1, 1, "user", "B."), (1, 2, "assistant", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", copies long")
    turns, taken = C.repaired(df)
    got = [(r.edit, r.role, r.text) for r in C.edits(turns, taken).orderBy("part", "step").collect()]
    assert got == [("K", "user", "A?"), ("R", "assistant", "B."), ("D", "assistant", "")]


@pytest.mark.parametrize("n", [1, 2, 7, 64, 400])
def test_checkpoints_change_nothing(n):
    rng = random.Random(n)
    codes = bytes(rng.randrange(12) for _ in range(n))
    vectors = [list(C.ENDING)]
    for code in reversed(codes):
        vectors.append(C.before(code, vectors[-1]))
    m = C.matrix(codes)
    assert vectors[-1] == [min(m[s * 4 + t] + C.ENDING[t] for t in range(4)) for s in range(4)]
    half = n // 2
    for state in range(4):
        whole = C.walk(codes, list(C.ENDING), state, True)[0]
        head, leads = C.walk(codes[:half], vectors[n - half], state, False)
        assert whole == head + C.walk(codes[half:], list(C.ENDING), leads, True)[0]


def test_odd_tables(spark):
    assert C.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    same = [(3, 1, "user", "Same.")] * 500
    assert run(spark, same, 4) == brute(same)
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert run(spark, [(dropped, 0, "user", "x.")], 4) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
