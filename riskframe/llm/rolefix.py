"""Repair of conversation structure: generalised LR parsing over the role grammar ``(s? (u a)+)?``.

The parser's states are how far a conversation has come: nothing yet, after the system turn, after a user turn, after an
assistant turn. All ways to keep, rerole, delete or insert turns are followed at once; stacks with the same top state are merged
into the one of least (cost, audit), so four tops are alive after each turn. Two audits of one cost at one state differ in a
letter before either ends, so the smaller one stays smaller whatever follows: merging loses no repair.

A conversation of any length is cut into blocks of ``BLOCK`` turns. A block's stacks are followed from each state it may be
entered in, within a task; a pass over the blocks' small tables then joins them. Turns themselves move only for the repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written
from riskframe.llm.ranks import ranked

BLOCK_BITS = 10
STEP_BITS = BLOCK_BITS + 2
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"

# Costs of the edits, and of a truncated turn that is not deleted.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 1, 2, 5, 5

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a role's initial, per state it may follow.
SHIFT = {
    "s": {START: SYSTEM},
    "u": {START: USER, SYSTEM: USER, ASSISTANT: USER},
    "a": {USER: ASSISTANT},
}
ACCEPTED = (START, ASSISTANT)
ORDERED_PAIRS = ("su", "ua", "au")
NAMES = {USER: "user", ASSISTANT: "assistant"}

BLOCK_SCHEMA = (
    "conv_id long, block long, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, "
    "first_role string, last_role string, stacks array<struct<enter: int, leave: int, cost: long, audit: string>>"
)
CHOSEN_SCHEMA = (
    "conv_id long, block long, enter int, audit string, "
    "whole struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long, audit: string>"
)
EDIT_SCHEMA = "conv_id long, place long, turn_uid long, op string, new_role string"

Stacks = dict[int, tuple[int, str]]


def _offer(stacks: Stacks, state: int, cost: int, audit: str) -> None:
    held = stacks.get(state)
    if held is None or (cost, audit) < held:
        stacks[state] = (cost, audit)


def _with_inserts(stacks: Stacks) -> Stacks:
    """The stacks after any inserts: a user turn where one may follow, then an assistant turn."""
    for role, state in (("u", USER), ("a", ASSISTANT)):
        for before in SHIFT[role]:
            if before in stacks:
                cost, audit = stacks[before]
                _offer(stacks, state, cost + INSERT_COST, audit + INSERT)
    return stacks


def step(stacks: Stacks, initial: str, fault: str | None) -> Stacks:
    """The stacks after one turn and the inserts that may follow it."""
    after: Stacks = {}
    must_go = fault in ("blank", "duplicate")
    own = TRUNCATED_COST if fault == "truncated" else 0
    for state, (cost, audit) in stacks.items():
        _offer(after, state, cost + DELETE_COST, audit + DELETE)
        if must_go:
            continue
        kept = SHIFT.get(initial, {}).get(state)
        if kept is not None:
            _offer(after, kept, cost + own, audit + KEEP)
        for role in "ua":
            moved = SHIFT[role].get(state)
            if moved is not None:
                _offer(after, moved, cost + own + REROLE_COST, audit + REROLE)
    return _with_inserts(after)


def walk(enter: int, initials: list[str], audit: str, first: bool) -> Iterator[tuple[int | None, str, int]]:
    """(index of the turn, or None; edit; state after it) along an audit of a block."""
    state, at = enter, 0
    for op in audit:
        if op == INSERT:
            state = USER if state in SHIFT["u"] else ASSISTANT
            yield None, op, state
            continue
        if op == KEEP:
            state = SHIFT[initials[at]][state]
        elif op == REROLE:
            state = USER if state in SHIFT["u"] else ASSISTANT
        yield at, op, state
        at += 1


def _grouped(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Consecutive rows of equal keys of a sorted partition."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in keys)
            if held and key != now:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def _batched(rows: Iterator[dict], schema: pa.Schema, size: int = 2048) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


_STACK = pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_COUNTS = ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")
_BLOCK_ARROW = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("block", pa.int64()),
        *[(x, pa.int64()) for x in _COUNTS],
        ("first_role", pa.string()),
        ("last_role", pa.string()),
        ("stacks", pa.list_(_STACK)),
    ]
)
_WHOLE = pa.struct([*[(x, pa.int64()) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
_CHOSEN_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("enter", pa.int32()), ("audit", pa.string()), ("whole", _WHOLE)]
)
_EDIT_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("place", pa.int64()), ("turn_uid", pa.int64()), ("op", pa.string()), ("new_role", pa.string())]
)


def _block_tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv_id, block), held in _grouped(batches, ("conv_id", "block")):
            initials = [r["initial"] for r in held]
            turns = [r["turn"] for r in held if r["turn"] is not None]
            faults = [r["fault"] for r in held]
            stacks = []
            for enter in (START,) if block == 0 else range(4):
                alive = {enter: (0, "")}
                if block == 0:
                    alive = _with_inserts(alive)
                for initial, fault in zip(initials, faults, strict=True):
                    alive = step(alive, initial, fault)
                stacks += [{"enter": enter, "leave": s, "cost": c, "audit": a} for s, (c, a) in alive.items()]
            yield {
                "conv_id": conv_id,
                "block": block,
                "first_turn": turns[0] if turns else None,
                "last_turn": turns[-1] if turns else None,
                "turns": len(set(turns)),
                **{name: faults.count(name) for name in ("blank", "duplicate", "truncated")},
                "illegal": sum(a + b not in ORDERED_PAIRS for a, b in zip(initials, initials[1:])),
                "first_role": initials[0],
                "last_role": initials[-1],
                "stacks": stacks,
            }

    return _batched(rows(), _BLOCK_ARROW, 256)


class _Link:
    """One block's part of an audit, after those of the blocks before."""

    __slots__ = ("before", "enter", "audit", "cost")

    def __init__(self, before: _Link | None, enter: int, audit: str, cost: int):
        self.before, self.enter, self.audit, self.cost = before, enter, audit, cost

    def parts(self) -> list[_Link]:
        found, link = [], self
        while link is not None:
            found.append(link)
            link = link.before
        return found[::-1]


def _less(a: _Link, b: _Link) -> bool:
    """Whether the chain ``a`` is better: by cost, then by the audits after the last part they share."""
    if a.cost != b.cost:
        return a.cost < b.cost
    left, right, x, y = [], [], a, b
    while x is not y:
        left.append(x.audit)
        right.append(y.audit)
        x, y = x.before, y.before
    return "".join(left[::-1]) < "".join(right[::-1])


def _choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def results(conv_id, total: dict, ends: dict[int, _Link]):
        best = None
        for state in ACCEPTED:
            if state in ends and (best is None or _less(ends[state], best)):
                best = ends[state]
        parts = best.parts()
        gaps = 0 if total["low"] is None else total["high"] - total["low"] + 1 - total["turns"]
        whole = {k: total[k] for k in ("blank", "duplicate", "truncated", "illegal")}
        whole |= {"gaps": gaps, "cost": best.cost, "audit": "".join(p.audit for p in parts)}
        for block, part in enumerate(parts):
            yield {"conv_id": conv_id, "block": block, "enter": part.enter, "audit": part.audit, "whole": whole if block == 0 else None}

    def rows():
        conv, total, ends = None, None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] == 0:
                    if total is not None:
                        yield from results(conv, total, ends)
                    conv, ends = r["conv_id"], {}
                    total = dict.fromkeys(("turns", "blank", "duplicate", "truncated", "illegal"), 0) | {"low": None, "high": None, "role": None}
                for name in ("turns", "blank", "duplicate", "truncated", "illegal"):
                    total[name] += r[name]
                if r["first_turn"] is not None:
                    total["turns"] -= total["high"] == r["first_turn"]
                    total["low"] = r["first_turn"] if total["low"] is None else total["low"]
                    total["high"] = r["last_turn"]
                if r["block"]:
                    total["illegal"] += total["role"] + r["first_role"] not in ORDERED_PAIRS
                total["role"] = r["last_role"]
                after: dict[int, _Link] = {}
                for s in r["stacks"]:
                    before = ends.get(s["enter"])
                    if r["block"] and before is None:
                        continue
                    link = _Link(before, s["enter"], s["audit"], s["cost"] + (before.cost if before else 0))
                    if s["leave"] not in after or _less(link, after[s["leave"]]):
                        after[s["leave"]] = link
                ends = after
        if total is not None:
            yield from results(conv, total, ends)

    return _batched(rows(), _CHOSEN_ARROW, 256)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for (conv_id, block), held in _grouped(batches, ("conv_id", "block")):
            initials = [r["initial"] for r in held]
            for at, (i, op, state) in enumerate(walk(held[0]["enter"], initials, held[0]["audit"], block == 0)):
                yield {
                    "conv_id": conv_id,
                    "place": (block << STEP_BITS) + at,
                    "turn_uid": None if i is None else held[i]["turn_uid"],
                    "op": op,
                    "new_role": NAMES[state] if op in (INSERT, REROLE) else None,
                }

    return _batched(rows(), _EDIT_ARROW)


def _text_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each conversation's turns of a partition sorted by place: one state, whatever the length."""
    ids, found = [], []
    now, hasher = None, None
    for batch in batches:
        for conv_id, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
            if hasher is None or conv_id != now:
                if hasher is not None:
                    ids.append(now)
                    found.append(hasher.hexdigest())
                now, hasher = conv_id, hashlib.sha256()
            else:
                hasher.update(b"\n")
            hasher.update(f"{role}:{text}".encode())
        if len(ids) > 4096:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["conv_id", "text_sha256"])
            ids, found = [], []
    if hasher is not None:
        ids.append(now)
        found.append(hasher.hexdigest())
    if ids:
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.string())], ["conv_id", "text_sha256"])


class Repair:
    """The repair of a table of turns ``(conv_id, turn, role, text)``, an optional ``copy`` telling repeats of a turn apart.

    ``summary``: one row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.
    ``edits``: one row per edit in order: conv_id, place, op (K, R, D, I), role, text; role and text are null for deleted turns.
    ``digests``: conv_id, text_sha256 of the repaired ``role:text`` lines, for conversations that keep a turn.

    Turns are taken by turn (null first); equal turns by role, the text's MD5 and ``copy``. A null role or text is one space. A
    turn's first fault counts: blank, duplicate (role and text seen earlier in the conversation) or truncated (the last
    character that is not blank is none of ``.!?``). A null conv_id is a conversation of its own, an empty table has none. Other
    columns are not read.
    """

    def __init__(self, turns: DataFrame):
        role, text = (F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("role", "text"))
        copy = F.col("copy") if "copy" in turns.columns else F.lit(0)
        self.turns = written(
            turns.select(
                F.monotonically_increasing_id().alias("turn_uid"),
                F.col("conv_id").cast("long").alias("conv_id"),
                F.col("turn").cast("long").alias("turn"),
                role.alias("role"),
                text.alias("text"),
                copy.cast("int").alias("copy"),
            )
        )
        placed = self._placed()
        blocks = written(
            placed.repartition("conv_id", "block")
            .sortWithinPartitions("conv_id", "block", "rank")
            .select("conv_id", "block", "turn", "initial", "fault")
            .mapInArrow(_block_tables, BLOCK_SCHEMA)
        )
        self.chosen = written(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_choose, CHOSEN_SCHEMA))
        self.summary = self.chosen.where("block = 0").select("conv_id", "whole.*")
        chosen = self.chosen.select(F.col("conv_id").alias("_conv"), F.col("block").alias("_block"), "enter", "audit")
        found = (
            placed.join(chosen, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("block") == F.col("_block")))
            .repartition("conv_id", "block")
            .sortWithinPartitions("conv_id", "block", "rank")
            .select("conv_id", "block", "turn_uid", "initial", "enter", "audit")
            .mapInArrow(_edits, EDIT_SCHEMA)
        )
        own = self.turns.select("turn_uid", F.col("role").alias("_role"), "text")
        kept = F.col("op") != DELETE
        self.edits = found.join(own, "turn_uid", "left").select(
            "conv_id",
            "place",
            "op",
            F.when(kept, F.coalesce("new_role", "_role")).alias("role"),
            F.when(kept, F.coalesce("text", F.lit(""))).alias("text"),
        )

    def _placed(self) -> DataFrame:
        """Turns without their texts: conv_id, block, rank, turn, initial, fault, turn_uid."""
        bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
        narrow = written(
            self.turns.select(
                "conv_id",
                "turn",
                "role",
                F.md5(F.col("text").cast("binary")).alias("digest"),
                "copy",
                "turn_uid",
                F.when(bare == "", "blank").alias("blank"),
                F.when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").alias("truncated"),
            )
        )
        rows = written(ranked(narrow, "conv_id", ["turn", "role", "digest", "copy", "turn_uid"]))
        again = (
            rows.groupBy("conv_id", "role", "digest")
            .agg(F.min("rank").alias("_first"), F.count(F.lit(1)).alias("_n"))
            .where("_n > 1")
            .select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "_first")
        )
        same = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
        fault = F.coalesce("blank", F.when(F.col("rank") > F.col("_first"), "duplicate"), "truncated")
        return written(
            rows.join(again, same, "left").select(
                "conv_id",
                F.shiftright("rank", BLOCK_BITS).alias("block"),
                "rank",
                "turn",
                F.substring("role", 1, 1).alias("initial"),
                fault.alias("fault"),
                "turn_uid",
            )
        )

    @property
    def digests(self) -> DataFrame:
        kept = self.edits.where(F.col("op") != DELETE).repartition("conv_id").sortWithinPartitions("conv_id", "place")
        return kept.select("conv_id", "role", "text").mapInArrow(_text_digests, "conv_id long, text_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Turns as damaged by the CRC-32 of ``conv_id:turn`` modulo 20: 0 drops a turn, 1 empties its text, 2 takes its ``.!?``,
    3 repeats it, 4 gives it to the user. Nulls count as one space, also within the key; a null turn stays null."""
    held = {x: F.coalesce(F.col(x).cast("string"), F.lit(" ")) for x in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(held["conv_id"], F.lit(":"), held["turn"]).cast("binary")) % 20
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(held["text"], "[.!?]", "")).otherwise(held["text"])
    return turns.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(held["role"]).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    )


def repaired_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id of ``turns``, damaged and repaired: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256. A conversation without turns after the damage has zeros, an empty audit and the hash of nothing."""
    repair = Repair(damaged(turns))
    ids = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    summary = repair.summary.withColumnRenamed("conv_id", "_conv")
    digests = repair.digests.withColumnRenamed("conv_id", "_own")
    counts = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (
        ids.join(summary, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
        .join(digests, F.col("conv_id").eqNullSafe(F.col("_own")), "left")
        .select(
            "conv_id",
            *counts,
            F.coalesce("audit", F.lit("")).alias("audit"),
            F.coalesce("text_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
        )
    )
