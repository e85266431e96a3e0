"""Conversation repair against the plain recursion over rows and states."""

import hashlib
import random
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, at string, edit int, part string"


def plain(rows):
    """Rows of one conversation in order: its digest."""
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(repair.BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}

    @lru_cache(None)
    def best(i, state):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []
        for x in "ua":
            if (state, x) in step and (i, state, x) not in busy:
                busy.add((i, state, x))
                if len([b for b in busy if b[0] == i]) <= 3:
                    c, a, t = raw(i, x)
                    ways.append((c + 5, "I" + a, (names[x] + ":",) + t))
                busy.discard((i, state, x))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = raw(i + 1, state)
            ways.append((c + repair.DELETE, "D" + a, t))
            if faults[i] not in ("blank", "duplicate"):
                late = 5 if faults[i] else 0
                if role[:1] and (state, role[:1]) in step:
                    c, a, t = raw(i + 1, role[0])
                    ways.append((c + late, "K" + a, (f"{role}:{text}",) + t))
                for x in "ua":
                    if (state, x) in step:
                        c, a, t = raw(i + 1, x)
                        ways.append((c + 1 + late, "R" + a, (f"{names[x]}:{text}",) + t))
        return min(ways, default=(10**9, "", ()))

    busy = set()
    table = {}

    def raw(i, state):
        if busy and any(b[0] == i for b in busy):  # within inserted rows: not stored, as what may follow is limited
            return best.__wrapped__(i, state)
        if (i, state) not in table:
            table[i, state] = best(i, state)
        return table[i, state]

    for i in range(len(rows), -1, -1):
        for state in ("", "s", "u", "a"):
            raw(i, state)
    cost, audit, lines = raw(0, "")
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def ordered(rows):
    named = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(named, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def run(spark, conversations):
    rows = [(c, t, r, x, "at", 1, "p") for c, turns in conversations.items() for t, r, x in turns]
    table = spark.createDataFrame(rows, SCHEMA)
    return {r["conv_id"]: tuple(r)[1:] for r in repair.repair_digest(repair.repair_conversations(table), table).collect()}


def made(rng, n, roles="user user assistant assistant system tool".split()):
    texts = ["", " \t", "Yes.", "No!", "cut off", "Why?"] + [f"number {k}{rng.choice(['.', '.', '', '! '])}" for k in range(n)]
    return [(rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def test_repairs_equal_the_plain_recursion(spark):
    rng = random.Random(8)
    conversations = {c: made(rng, rng.randrange(1, 12)) for c in range(300)}
    conversations[None] = [(0, None, "No id."), (None, "user", None), (1, "", "x.")]
    conversations[-5] = [(None, "assistant", "A."), (None, "assistant", "A.")]
    got = run(spark, conversations)
    assert got == {c: plain(ordered(t)) for c, t in conversations.items()}


@pytest.mark.parametrize("roles", [["user"], ["user", "assistant"], ["system", "user", "assistant", "tool"]])
def test_a_conversation_over_many_tasks(spark, roles):
    """Chunks of one role never forget the vector they start from, so borders and fix-up passes carry it all the way."""
    sys.setrecursionlimit(100_000)
    rng = random.Random(9)
    long = [(k, rng.choice(roles), f"row {k}" + rng.choice([".", ".", ""])) for k in range(1501)] + [(None, "user", "same.")] * 300
    conversations = {7: long, 6: made(rng, 5), 8: made(rng, 5)}
    got = run(spark, conversations)
    assert got == {c: plain(ordered(t)) for c, t in conversations.items()}


def test_chunks_of_any_length_give_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    letter, late = rng.integers(0, 4, 500), rng.random(500) < 0.3
    letter[200:300] = 1
    steps = repair.Steps.of(letter, late)
    begin, end = np.array([0, 40, 41]), np.array([40, 41, 500])
    results = []
    for size in (1000, 64, 7, 1):
        monkeypatch.setattr(repair, "CHUNK", size)
        chunks = repair.Chunks(steps, begin, end, np.tile(repair.END, (3, 1)))
        inserted, edit, to = chunks.choices()
        reached, left = chunks.trace(to, np.zeros(3, int))
        results.append((chunks.before.tolist(), chunks.fell.tolist(), edit.tolist(), reached.tolist(), left.tolist()))
        assert chunks.passes == 1 or size < 1000
    assert results[0] == results[1] == results[2] == results[3]


def test_rows_are_inserted_where_deletion_is_dear(monkeypatch):
    monkeypatch.setattr(repair, "DELETE", 9)
    rng, inserted = random.Random(4), 0
    for _ in range(200):
        rows = [(k, rng.choice(["user", "assistant", "system", "tool"]), f"row {k}" + rng.choice([".", ""])) for k in range(rng.randrange(1, 9))]
        table = pa.table({
            "conv_id": [1] * len(rows), "at": list(range(len(rows))), "letter": [max(-1, repair.LETTERS.find(r[1][0])) % 4 for r in rows],
            "forced": [False] * len(rows), "truncated": [r[2][-1] != "." for r in rows],
        })
        edits = repair.Part(table).edits({"after": repair.END, "enter": 0, "letter_before": -1, "goes_on": False}).to_pylist()
        audit = "".join("I" * len(e["inserted"]) + e["edit"] + "I" * len(e["appended"]) for e in edits)
        assert audit == plain(rows)[6]
        inserted += audit.count("I")
    assert inserted >= 20


def test_damage_and_empty_tables(spark):
    assert run(spark, {}) == {}
    rows = spark.createDataFrame([(c, t, "assistant", "Fine. Really?", "x", 1, "p") for c in range(40) for t in range(5)] + [(None, None, None, None, None, None, None)], SCHEMA)
    got = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in repair.damaged(rows.where("conv_id is not null")).collect())
    import zlib

    wanted = []
    for c in range(40):
        for t in range(5):
            kind = zlib.crc32(f"{c}:{t}".encode()) % 20
            row = (c, t, "user" if kind == 4 else "assistant", "" if kind == 1 else "Fine Really" if kind == 2 else "Fine. Really?")
            wanted += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert got == sorted(wanted)
    assert repair.repair_digest(repair.repair_conversations(repair.damaged(rows).where("false")), rows).where("audit = '' and cost = 0").count() == 41
