"""Repair of conversation structure by cheapest edits, decided by one integer per path.

A repaired conversation is empty, or an optional system turn followed by pairs of user and
assistant turns. A path's weight is one integer: its high digits are the cost; below them every
edit's letter has a digit of ``BITS`` bits at its own place from the left, and unused places are
zero. The least integer is therefore the cheapest path and, among those, the one whose letters
come first. The letters and the rows determine the path: in every state only one role may
follow that is not a system turn.

Conversations are cut into blocks of rows. A block's result is the least weight from each state
it may start in to each state it may end in, so a long conversation is worked on by many tasks,
and its blocks' weights are then joined in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import mapped
from tablewright.operators.tables import dense_ids
from tablewright.session import written

BLOCK = 256  # rows that are worked on together
BITS = 3
DELETE, INSERT, KEEP, REROLE = b"DIKR"
_DIGIT = {DELETE: 1, INSERT: 2, KEEP: 3, REROLE: 4}  # in the order of the letters
_LETTER = {digit: letter for letter, digit in _DIGIT.items()}
START, SYSTEM, USER, ASSISTANT = range(4)  # the state says which role came last
ENDS = (START, ASSISTANT)
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # by a user or assistant turn
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_COST = {DELETE: 3, INSERT: 2, KEEP: 0, REROLE: 2}
PAIRS = ("su", "ua", "au")
Best = dict[int, int]  # state: least weight


def longest(rows: int) -> int:
    """Most letters of a cheapest path over so many rows: two insertions at most before each, and after all."""
    return 3 * rows + 2


def extended(weight: int, width: int, letter: int, cost: int) -> int:
    """The weight with one more edit; ``width`` is the number of places for letters."""
    letters = weight & ((1 << BITS * width) - 1)
    free = ((letters & -letters).bit_length() - 1) // BITS if letters else width
    return weight + (cost << BITS * width) + (_DIGIT[letter] << BITS * (free - 1))


def joined(left: int, left_width: int, right: int, right_width: int) -> int:
    """The weight of one path followed by another, with ``left_width + right_width`` places."""
    low_left, low_right = left & ((1 << BITS * left_width) - 1), right & ((1 << BITS * right_width) - 1)
    free = ((low_left & -low_left).bit_length() - 1) // BITS if low_left else left_width
    cost = (left >> BITS * left_width) + (right >> BITS * right_width)
    return (cost << BITS * (left_width + right_width)) | (low_left << BITS * right_width) | (low_right << BITS * free)


def letters_of(weight: int, width: int) -> str:
    """The audit: the letters in order."""
    out = bytearray()
    for place in range(width - 1, -1, -1):
        digit = (weight >> BITS * place) & ((1 << BITS) - 1)
        if not digit:
            break
        out.append(_LETTER[digit])
    return out.decode()


def _least(best: Best, state: int, weight: int) -> None:
    if state not in best or weight < best[state]:
        best[state] = weight


def inserted(best: Best, width: int) -> Best:
    """Also the states that insertions reach; a third one would only come back to a state, at a cost."""
    out = dict(best)
    for target, sources in ((USER, (START, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,)), (USER, (ASSISTANT,))):
        for source in sources:
            if source in out:
                _least(out, target, extended(out[source], width, INSERT, _COST[INSERT]))
    return out


def after_row(best: Best, width: int, initial: str, must_go: bool, truncated: bool) -> Best:
    """One row: deleted, kept where its initial may follow, or given the role that may."""
    out: Best = {}
    for state, weight in inserted(best, width).items():
        _least(out, state, extended(weight, width, DELETE, _COST[DELETE]))
        if must_go:
            continue
        if initial == "s" and state == START:
            _least(out, SYSTEM, extended(weight, width, KEEP, _COST[KEEP] + truncated))
        elif initial == _ROLE[_NEXT[state]][0]:
            _least(out, _NEXT[state], extended(weight, width, KEEP, _COST[KEEP] + truncated))
        _least(out, _NEXT[state], extended(weight, width, REROLE, _COST[REROLE] + truncated))
    return out


def turns_of(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """Letter, role and text of each turn that the edits of ``audit`` leave."""
    state, rows = START, iter(rows)
    for letter in audit:
        role, text = (None, "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K" and role.startswith("s"):
            state = SYSTEM
        else:
            state = _NEXT[state]
            role = role if letter == "K" else _ROLE[state]
        yield letter, role, text


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with faults by crc32(``conv_id:turn``) % 20: conv_id, turn, role, text, copy.

    0 drops the row, 1 empties its text, 2 removes ``.!?`` from it, 3 repeats the row (copy 1),
    4 makes its role user. Null conv_id and turn are one space in the hash and stay null; null
    role and text become one space first.
    """
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(key[0], F.lit(":"), key[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    hurt = F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = conversations.filter(fault != 0)
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), hurt.alias("text"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _faulty(rows: DataFrame) -> DataFrame:
    """conv_id, at, turn, initial and the fault (blank, duplicate, truncated or null) of numbered rows, without their texts."""
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    light = rows.select(
        "conv_id", "at", "turn", F.substring("role", 1, 1).alias("initial"), (last == "").alias("blank"),
        (~last.isin(".", "!", "?")).alias("open"),
    )
    firsts = rows.groupBy("conv_id", "role", F.sha2("text", 256).alias("text")).agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("open"), "truncated")
    return light.join(firsts, "at", "left").select("conv_id", "at", "turn", "initial", fault.alias("fault"))


_COUNTS = ("blank", "duplicate", "truncated")


class _Segment:
    """What the rows of one conversation in one block add up to."""

    def __init__(self, conv, at: int, width: int, fresh: bool):
        self.conv, self.at, self.width = conv, at, width
        # Where a conversation begins, it can only be in its first state.
        self.best: dict[int, Best] = {s: {s: 0} for s in ((START,) if fresh else range(4))}
        self.counts, self.illegal = dict.fromkeys(_COUNTS, 0), 0
        self.first = self.last = None
        self.turns: list = [None, None, 0]  # first, last, distinct

    def add(self, turn, initial: str, fault: str | None) -> None:
        if self.first is None:
            self.first = initial
        elif self.last + initial not in PAIRS:
            self.illegal += 1
        self.last = initial
        if fault:
            self.counts[fault] += 1
        if turn is not None:
            if self.turns[0] is None:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns[1:] = [turn, self.turns[2] + 1]
        must_go, cut = fault in ("blank", "duplicate"), fault == "truncated"
        self.best = {s: after_row(b, self.width, initial, must_go, cut) for s, b in self.best.items()}

    def row(self) -> tuple:
        paths = [(s, e, w) for s, b in self.best.items() for e, w in b.items()]
        return (self.conv, self.at, self.width, [p[0] for p in paths], [p[1] for p in paths],
                [p[2].to_bytes(p[2].bit_length() // 8 + 1, "big") for p in paths],
                self.first, self.last, self.illegal, *self.counts.values(), *self.turns)


_SEGMENT = """at long, width int, entries array<int>, exits array<int>, weights array<binary>, first string, last string,
 illegal long, blank long, duplicate long, truncated long, first_turn long, last_turn long, turns long"""


def _segments(faulty: DataFrame, kind: str, block: int) -> DataFrame:
    """One row per conversation and block of ``block`` consecutive rows."""

    def run(batches):
        open_, last_block = None, None
        for b in batches:
            for conv, at, turn, initial, fault in zip(*(b[c] for c in ("conv_id", "at", "turn", "initial", "fault"))):
                if open_ is None or conv != open_.conv or at // block != last_block:
                    if open_ is not None:
                        yield open_.row()
                    # Only the first row of a block may continue a conversation.
                    open_, last_block = _Segment(conv, at, longest(block), at % block > 0), at // block
                open_.add(turn, initial, fault)
        if open_ is not None:
            yield open_.row()

    cut = faulty.withColumn("block", F.call_function("div", F.col("at"), F.lit(block).cast("long")))
    return mapped(cut.repartition("block").sortWithinPartitions("at").drop("block"), run, f"conv_id {kind}, {_SEGMENT}")


def _plans(segments: DataFrame, originals: DataFrame, kind: str) -> DataFrame:
    """Per conversation of ``originals``: counts, cost and audit, from its segments in order."""

    def closed(conv, state) -> tuple:
        if state is None:
            return conv, 0, 0, 0, 0, 0, 0, ""
        best, width, _, illegal, counts, turns = state
        ended = inserted({s: joined(w, width, 0, 2) for s, w in best.items()}, width + 2)
        weight = min(ended[s] for s in ENDS if s in ended)
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[0] is not None else 0
        return conv, gaps, *counts, illegal, weight >> BITS * (width + 2), letters_of(weight, width + 2)

    def run(batches):
        conv, state, begun = None, None, False
        for b in batches:
            for record in zip(*b.values()):
                own = dict(zip(b, record))
                if own["at"] is None:  # the conversation itself, before its segments
                    if begun:
                        yield closed(conv, state)
                    conv, state, begun = own["conv_id"], None, True
                    continue
                if state is None:
                    state = ({START: 0}, 0, own["first"], 0, [0, 0, 0], [None, None, 0])
                    illegal = 0
                else:
                    illegal = state[2] + own["first"] not in PAIRS
                best, width, _, before, counts, turns = state
                after: Best = {}
                for entry, exit_, weight in zip(own["entries"], own["exits"], own["weights"]):
                    if entry in best:
                        _least(after, exit_, joined(best[entry], width, int.from_bytes(weight, "big"), own["width"]))
                if own["first_turn"] is not None:
                    same = turns[1] is not None and turns[1] == own["first_turn"]
                    turns = [own["first_turn"] if turns[0] is None else turns[0], own["last_turn"], turns[2] + own["turns"] - same]
                counts = [a + own[c] for a, c in zip(counts, _COUNTS)]
                state = (after, width + own["width"], own["last"], before + own["illegal"] + illegal, counts, turns)
        if begun:
            yield closed(conv, state)

    heads = originals.select("conv_id").distinct()
    both = segments.unionByName(heads, allowMissingColumns=True)
    return mapped(
        both.repartition("conv_id").sortWithinPartitions("conv_id", "at"), run,
        f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string",
    )


class Repair:
    """Cheapest repair of conversations: rows of conv_id, turn, role, text.

    ``rows`` are the conversations as they are; a row's columns may be null and count as one
    space (role, text) or stay null (conv_id: a conversation of its own; turn: first). Rows
    stand in order of turn, then role, then text; rows that are alike stand next to each other.
    A row is blank without a character outside ``[\\x20\\x09-\\x0D]``, a duplicate where role and
    text occurred before, truncated where its last such character is none of ``.!?``; the first
    of these counts. Blank rows and duplicates must be deleted (3). Others may be kept (0) where
    the initial of their role fits, so a role that begins with none of s, u, a never is; given
    the role user or assistant (2); or deleted (3). Empty turns may be inserted (2). A truncated
    row that is not deleted costs 1 more. ``conversations``, if given, names more conv_ids, which
    have no rows; other columns are left out. Empty tables give no rows.

    ``plans`` has one row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit. ``turns()`` are the repaired turns, ``digests()`` the hash of each conversation.
    A conversation's audit is one value, so it has to fit a cell; nothing else grows with a
    conversation: its rows and texts are read as a stream.
    """

    def __init__(self, rows: DataFrame, conversations: DataFrame | None = None, block: int = BLOCK):
        self.kind = rows.schema["conv_id"].dataType.simpleString()
        filled = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
        copy = [F.col("copy")] if "copy" in rows.columns else []
        held = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled, *copy)
        self.rows = dense_ids(held, ["conv_id", "turn", "role", "text"], "at", 0).drop("copy")
        faulty = written(_faulty(self.rows), "repair-faults")
        segments = written(_segments(faulty, self.kind, block), "repair-segments")
        originals = rows.select("conv_id") if conversations is None else conversations.select("conv_id").unionByName(rows.select("conv_id"))
        self.plans = written(_plans(segments, originals, self.kind), "repair-plans")

    def turns(self) -> DataFrame:
        """conv_id, place (from 0), edit (K, R or I), role and text of the repaired turns.

        A conversation's audit comes before its rows in one sorted stream, whatever its length.
        """

        def run(batches):
            stream = (r for b in batches for r in zip(*(b[c] for c in ("conv_id", "at", "role", "text"))))
            conv, audit, ahead = None, None, next(stream, None)
            while ahead is not None:
                conv, _, _, audit = ahead
                ahead = next(stream, None)

                def own():
                    nonlocal ahead
                    while ahead is not None and ahead[1] >= 0:
                        row, ahead = ahead, next(stream, None)
                        yield row[2], row[3]

                rest = own()
                for place, (letter, role, text) in enumerate(turns_of(audit, rest)):
                    yield conv, place, letter, role, text
                for _ in rest:
                    raise ValueError("an audit is shorter than its conversation")

        heads = self.plans.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
        both = heads.unionByName(self.rows.select("conv_id", "at", "role", "text"))
        return mapped(
            both.repartition("conv_id").sortWithinPartitions("conv_id", "at"), run,
            f"conv_id {self.kind}, place long, edit string, role string, text string",
        )

    def digests(self) -> DataFrame:
        """``plans`` with repaired_sha256: the hash of ``role:text`` of the repaired turns, joined by line breaks."""

        def run(batches):
            stream = (r for b in batches for r in zip(*(b[c] for c in ("conv_id", "place", "role", "text"))))
            conv, digest = None, None
            for own, place, role, text in stream:
                if place == 0:
                    if digest is not None:
                        yield conv, digest.hexdigest()
                    conv, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode())
            if digest is not None:
                yield conv, digest.hexdigest()

        ordered = self.turns().repartition("conv_id").sortWithinPartitions("conv_id", "place")
        hashed = mapped(ordered, run, f"_conv {self.kind}, repaired_sha256 string")
        empty = F.lit(hashlib.sha256(b"").hexdigest())
        return self.plans.join(hashed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv").withColumn(
            "repaired_sha256", F.coalesce("repaired_sha256", empty))
