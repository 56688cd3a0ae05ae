"""Conversation repair against a search over all edits, and chunked costs against unchunked."""

import heapq
import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from ordermill.llm import conversation_repair as cr

BLANK = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]  # every conversation is told
        key = ":".join(" " if x is None else str(x) for x in (conv, turn))
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    for part in out.values():
        part.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def cheapest(rows, faults):
    """Dijkstra over (row, initials as a state) by (cost, audit); ties cannot be prefixes."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, made = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(made)
        names = {"u": "user", "a": "assistant"}
        for to in step[last]:
            if to in names:
                heapq.heappush(heap, (cost + 5, audit + "I", i, to, (*made, names[to] + ":")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, made))
        if faults[i] in ("blank", "duplicate"):
            continue
        extra = 5 * (faults[i] == "truncated")
        for to in step[last]:
            if role[:1] == to:
                heapq.heappush(heap, (cost + extra, audit + "K", i + 1, to, (*made, f"{role}:{text}")))
            if to in names:
                row = f"{names[to]}:{text}"
                heapq.heappush(heap, (cost + extra + 1, audit + "R", i + 1, to, (*made, row)))


def brute(rows):
    out = []
    for conv, part in damaged(rows).items():
        faults, seen = [], set()
        for _, role, text in part:
            bare = text.rstrip(BLANK)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else None
            faults.append(fault or ("" if bare[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, _, _ in part if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[:1] for _, r, _ in part]
        illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:]))
        cost, audit, whole = cheapest(part, faults)
        counts = (faults.count(f) for f in ("blank", "duplicate", "truncated"))
        digest = sha256(whole.encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def found(df, **options):
    return sorted(map(tuple, cr.repair(df, **options).collect()), key=str)


def conversation(conv, n, seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "User", "", None, "umpire"]
    texts = ["Yes.", "No!", "Why? ", "cut", "", " \n", "same words.", None, "é.", "end.\x0b"]
    return [
        (conv, rng.choice([t, t, t, t + 3, None]), roles[min(int(rng.expovariate(0.8)), 7)], rng.choice(texts) or None)
        if rng.random() < 0.4
        else (conv, t, ("user", "assistant")[t % 2], f"Turn {t} of {conv}.")
        for t in range(n)
    ]


@pytest.mark.parametrize("size", [7, 16_384])
def test_equals_a_search_over_all_edits(spark, size):
    rows = [r for c in range(60) for r in conversation(c, c % 23, c)]
    rows += conversation(None, 30, 99) + conversation(-7, 60, 5)
    assert found(frame(spark, rows).repartition(3), size=size) == brute(rows)


def test_given_conversations(spark, given):
    table = given("conversations")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    result = found(table, size=3)
    assert result == brute(rows)
    assert any(r[6] for r in result)


def test_odd_tables(spark):
    assert found(frame(spark, [])) == []
    rows = [(1, 0, "user", "x" * 2_000_000 + "."), (1, 1, "assistant", "ok."), (None, None, None, None)]
    rows += [(2, 5, "system", "s.")] * 40
    extra = frame(spark, rows).selectExpr("*", "'a' AS key", "1 AS pos", "2 AS chunk", "'b' AS info", "3 AS kind", "4 AS copy")
    assert found(extra, size=4) == brute(rows)


def test_conversation_lost_as_a_whole(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    empty = sha256(b"").hexdigest()
    assert found(frame(spark, [(conv, 0, "user", "Hi.")])) == [(conv, 0, 0, 0, 0, 0, 0, "", empty)]


def test_fix_up_equals_a_whole_run_and_stops_where_vectors_meet():
    rng, steps = random.Random(3), cr.Steps()
    ends = [cr.FINAL, cr.GUESS, (0, 5, 5, 1), (3, 2, 0, 4)]
    for _ in range(300):
        codes = bytes(rng.choice([0, 1, 2, 3, 5, 6, 8, 9, 10]) for _ in range(rng.randrange(40)))
        old, new = rng.choice(ends), rng.choice(ends)
        known = cr.run_back(steps, codes, old)
        assert cr.fix_up(steps, codes, old, new, *known) == cr.run_back(steps, codes, new)

    class Counted(cr.Steps):
        asked = 0

        def before(self, after, code):
            self.asked += 1
            return super().before(after, code)

    steps, codes = Counted(), bytes([1, 2] * 5_000)
    known = cr.run_back(steps, codes, cr.GUESS)
    steps.asked = 0
    cr.fix_up(steps, codes, cr.GUESS, cr.FINAL, *known)
    assert steps.asked < 100
