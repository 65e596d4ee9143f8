from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from tablewright.llm.repair import Repair, damaged, extended, joined, letters_of

SCHEMA = "conv_id long, turn long, role string, text string"
FULL = re.compile(r"(s?(ua)+)?\Z")
BLANK = " \t\n\x0b\x0c\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(BLANK)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """All edits with at most two insertions in a row, kept short by cost alone."""
    marks, ends = faults(rows), []

    def go(at, roles, cost, audit, out, inserted):
        if cost > bound:
            return
        if at == len(rows):
            if FULL.match("".join(roles)):
                ends.append((cost, audit, "\n".join(out)))
        else:
            role, text = rows[at]
            go(at + 1, roles, cost + 3, audit + "D", out, 0)
            if marks[at] not in ("blank", "duplicate"):
                more = marks[at] == "truncated"
                go(at + 1, roles + [role[:1]], cost + more, audit + "K", out + [f"{role}:{text}"], 0)
                for new in ("user", "assistant"):
                    go(at + 1, roles + [new[0]], cost + 2 + more, audit + "R", out + [f"{new}:{text}"], 0)
        if inserted < 2:
            for new in ("user", "assistant"):
                go(at, roles + [new[0]], cost + 2, audit + "I", out + [f"{new}:"], inserted + 1)

    bound = 3 * len(rows)
    go(0, [], 0, "", [], 0)
    return min(ends)


def expected(conv, rows):
    """rows: turn, role, text in any order."""
    rows = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for t, r, x in rows))
    turns = {t for known, t, _, _ in rows if known}
    plain = [(r, x) for _, _, r, x in rows]
    marks, initials = faults(plain), [r[:1] for r, _ in plain]
    cost, audit, text = cheapest(plain)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (conv, gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def random_rows(n):
    return [
        (random.choice([None, 0, 1, 2, 5, 9]), random.choice(["system", "user", "assistant", "user", "assistant", "tool", "sage", None]),
         random.choice(["Yes.", "No", " ", "", None, "a?", "b! \n", "Why?!", "x"]))
        for _ in range(n)
    ]


@pytest.mark.parametrize("block", [1, 2, 256])
def test_against_all_edits(spark, block):
    random.seed(block)
    own = {c: random_rows(random.randint(1, 5)) for c in range(60)} | {None: random_rows(3)}
    rows = [(c, *r) for c, rs in own.items() for r in rs]
    random.shuffle(rows)
    repair = Repair(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS at", "'x' AS fault"), block=block)
    got = sorted((tuple(r) for r in repair.digests().collect()), key=repr)
    assert got == sorted((expected(c, rs) for c, rs in own.items()), key=repr)


def test_a_conversation_in_many_blocks(spark):
    """Blocks must not change the result, nor the number of rows that share a turn."""
    random.seed(5)
    rows = [(1, *r) for r in random_rows(700)] + [(2, i, "user" if i % 2 else "assistant", f"t{i}.") for i in range(600)]
    df = spark.createDataFrame(rows, SCHEMA)
    small, large = (sorted(tuple(r) for r in Repair(df, block=b).digests().collect()) for b in (7, 5_000))
    assert small == large
    audit = small[1][7]  # an assistant turn first and a user turn last
    assert small[1][6] == 4 and audit == "I" + "K" * 600 + "I"


def test_turns_are_the_repaired_conversation(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "assistant", "a."), (1, 2, "assistant", "b"), (1, 3, "user", ""), (2, 0, "user", " "), (3, 0, "tool", "t.")]
    repair = Repair(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(9,), (None,), (9,)], "conv_id long"))
    turns = [tuple(r) for r in repair.turns().orderBy("conv_id", "place").collect()]
    assert turns == [(1, 0, "K", "system", "s."), (1, 1, "R", "user", "a."), (1, 2, "K", "assistant", "b")]
    plans = {r.conv_id: (r.cost, r.audit) for r in repair.plans.collect()}
    assert plans == {1: (6, "KRKD"), 2: (3, "D"), 3: (3, "D"), 9: (0, ""), None: (0, "")}
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.conv_id for r in repair.digests().collect() if r.repaired_sha256 == empty} == {2, 3, 9, None}


def test_damage(spark):
    rows = [(c, t, "assistant", "a. b! c?") for c in (None, 1, 2) for t in (None, *range(30))] + [(4, 1, None, None)]
    got = {}
    for r in damaged(spark.createDataFrame(rows, SCHEMA)).collect():
        got.setdefault((r.conv_id, r.turn), []).append((r.role, r.text))
    for c, t, role, text in rows:
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        want = {0: [], 1: [(role, "")], 2: [(role, text.translate({ord(x): None for x in ".!?"}))], 3: [(role, text)] * 2, 4: [("user", text)]}
        assert got.get((c, t), []) == want.get(fault, [(role, text)])


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert Repair(empty).digests().count() == 0 and Repair(empty).turns().count() == 0
    assert Repair(damaged(empty), empty).digests().count() == 0


def test_weights_order_like_cost_and_letters():
    paths = [(c, "".join(a)) for n in range(4) for a in product("DIKR", repeat=n) for c in (0, 1)]

    def weight(cost, audit):
        w = cost << 3 * 6
        for letter in audit.encode():
            w = extended(w, 6, letter, 0)
        return w

    assert sorted(paths) == sorted(paths, key=lambda p: weight(*p))
    for cost, audit in paths[:60]:
        assert letters_of(weight(cost, audit), 6) == audit
        whole = joined(weight(cost, audit), 6, weight(1, "RD"), 6)
        assert whole >> 3 * 12 == cost + 1 and letters_of(whole, 12) == audit + "RD"
