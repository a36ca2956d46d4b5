"""Conversation repair against a search over all edits."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from runledger.llm import repair, turns

OPS = re.compile("(s?(ua)+)?")


def damaged(rows):
    """(conv_id, turn, role, text) after damage, in the order of the repair."""
    out = []
    for conv, turn, role, text in rows:
        spaced = [" " if v is None else str(v) for v in (conv, turn, role, text)]
        fate, role, text = zlib.crc32(f"{spaced[0]}:{spaced[1]}".encode()) % 20, spaced[2], spaced[3]
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return sorted(out, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else
                   "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Dijkstra over (cost, audit): the first finished path is the cheapest and ASCII-least."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, last, lines = heapq.heappop(heap)
        if at == len(rows) and last in ("", "a"):
            return cost, audit, "\n".join(lines)
        if (at, last) in done:
            continue
        done.add((at, last))
        for who, role in (("u", "user"), ("a", "assistant")):
            if who in after[last]:
                heapq.heappush(heap, (cost + 5, audit + "I", at, who, (*lines, f"{role}:")))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(heap, (cost + 2, audit + "D", at + 1, last, lines))
            if found[at] in ("", "truncated"):
                extra = 5 * (found[at] == "truncated")
                if role and role[0] in after[last]:
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, role[0], (*lines, f"{role}:{text}")))
                for who, new in (("u", "user"), ("a", "assistant")):
                    if who in after[last]:
                        heapq.heappush(heap, (cost + 1 + extra, audit + "R", at + 1, who, (*lines, f"{new}:{text}")))


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        mine = damaged([r for r in rows if r[0] == conv])
        found = faults(mine)
        numbers = [t for _, t, _, _ in mine if t is not None]
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit, text = cheapest(mine, found)
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(found.count(k) for k in repair.COUNTS[:3]),
                    illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, rows, tasks=3):
    table = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, copies int")
    found = repair.report(repair.repair(repair.damage(table.repartition(tasks))))
    return sorted((tuple(r) for r in found.select("conv_id", "gaps", *repair.COUNTS, "cost", "audit", "repaired_sha256").collect()), key=str)


def conversations(n, seed=0, longest=9):
    rng = random.Random(seed)
    texts = ["Yes.", "No", " ", "", "Why?", "é!", "x\n", "Stop. ", ".", "a b", None, "Well!\n\t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "User", "", None, "agent"]
    return [(c, rng.choice([t, t, t, t * 3, None]), rng.choice(roles), rng.choice(texts) if rng.random() < .5 else f"text {rng.random()}.")
            for c in range(n) for t in range(rng.randint(1, longest))]


def test_small_conversations(spark):
    rows = conversations(300) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Ho."), (-1, -(1 << 40), "user", "a."), (-1, 1 << 40, "assistant", "b.")]
    rows += [(7777, t, r, "word " * 30_000 + ".") for t, r in ((1, "system"), (2, "user"), (3, "assistant"))]
    assert run(spark, rows) == brute(rows)


def test_long_conversations_in_many_segments(spark, monkeypatch):
    """A third of all rows in one conversation, cut in segments of 7 rows over several tasks; equal rows folded."""
    monkeypatch.setattr(repair, "SEGMENT_ROWS", 7)
    rng = random.Random(4)
    rows = [(1, t // 2, *rng.choice([("user", "Same."), ("assistant", f"t{t}."), ("user", f"u{t}"), ("user", f"v{t}."), ("system", "s.")])) for t in range(400)]
    rows += [(2, None, "user", "Copy.")] * 300 + [(2, 5, "assistant", "End.")] + conversations(60, 3)
    assert run(spark, rows, 5) == brute(rows)


def test_repaired_rows_are_regular(spark):
    rows = conversations(80, 9)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = repair.repaired_turns(repair.repair(repair.damage(table))).orderBy("conv_id", "task", "number", "at").collect()
    initials = {}
    for r in found:
        initials[r.conv_id] = initials.get(r.conv_id, "") + r.role[0]
    assert all(OPS.fullmatch(i) for i in initials.values()) and len(initials) > 40


def test_empty_table(spark):
    assert run(spark, []) == []


@pytest.mark.parametrize("seed", range(3))
def test_tables_against_single_rows(seed):
    """A block's entry is what its rows do one by one, and the passage what all paths cost."""
    rng, table = random.Random(seed), turns.tables()
    kinds = [rng.randrange(turns.KINDS - 1) for _ in range(rng.randint(1, 40))]
    _, first, total = table.behind(turns.blocks_of(kinds), 0)
    now = turns.END
    for kind in reversed(kinds):
        now = turns.before_row(kind, now)
    assert tuple(c + total for c in table.vectors[first]) == tuple(now)
    passage = table.passage(turns.blocks_of(kinds))
    assert turns.before(passage, list(turns.END)) == list(now)
