import hashlib
import itertools
import random
import re
import zlib

import riskframe.llm.rolefix as rolefix
from riskframe.llm.rolefix import Repair, damaged, repaired_conversations

SCHEMA = "conv_id long, turn long, role string, text string, rank string, block string, digest string, fault string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["x"] * 4) for r in rows], SCHEMA).repartition(3)


def faults(rows):
    """First fault of each (turn, role, text) in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def applied(rows, found, audit):
    """(cost, repaired lines) of an audit, or None if it isn't one."""
    lines, roles, cost, at = [], [], 0, 0
    for op in audit:
        expect = "assistant" if roles and roles[-1] == "u" else "user"
        if op == "I":
            lines.append(f"{expect}:")
            roles.append(expect[0])
            cost += 5
            continue
        _, role, text = rows[at]
        fault = found[at]
        at += 1
        if op == "D":
            cost += 2
            continue
        if fault in ("blank", "duplicate"):
            return None
        cost += (fault == "truncated") * 5 + (op == "R")
        role = expect if op == "R" else role
        roles.append(role[:1] or "?")  # an empty role is no symbol of the grammar
        lines.append(f"{role}:{text}")
    return (cost, lines) if re.fullmatch("(s?(ua)+)?", "".join(roles)) else None


def brute(rows):
    found = faults(rows)
    best = (2 * len(rows), "D" * len(rows), [])
    for ops in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            if sum(gaps) * 5 > best[0]:
                continue
            audit = "I" * gaps[0] + "".join(op + "I" * g for op, g in zip(ops, gaps[1:]))
            made = applied(rows, found, audit)
            if made is not None:
                best = min(best, (made[0], audit, made[1]))
    return best


def tied(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))


def test_least_repairs_by_enumeration(spark):
    rng = random.Random(3)
    roles = ["system", "user", "assistant", "tool", ""]
    texts = ["Yes.", "No", "", " \t", "Why?", "Well!\n", "x" * 50_000, " "]
    convs = {c: [(rng.choice([None, 0, 1, 2, 5]), rng.choices(roles, (3, 6, 6, 1, 1))[0], rng.choice(texts)) for _ in range(1 + c % 4)] for c in range(60)}
    repair = Repair(frame(spark, [(c, *r) for c, rows in convs.items() for r in rows]))
    got = {r.conv_id: r for r in repair.summary.collect()}
    digests = {r.conv_id: r.text_sha256 for r in repair.digests.collect()}
    for c, rows in convs.items():
        rows = tied(rows)
        cost, audit, lines = brute(rows)
        found = faults(rows)
        assert (got[c].cost, got[c].audit) == (cost, audit), rows
        assert [got[c].blank, got[c].duplicate, got[c].truncated] == [found.count(x) for x in ("blank", "duplicate", "truncated")]
        initials = [r[1][:1] for r in rows]
        assert got[c].illegal == sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        turns = [r[0] for r in rows if r[0] is not None]
        assert got[c].gaps == (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
        if lines:
            assert digests[c] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        else:
            assert c not in digests


def test_long_conversations_in_blocks(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(c, i + i // 7, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["A.", "b", f"Turn {i}.", ""])) for c in (1, None) for i in range(500)]
    rows += [(2, None, "user", "same.")] * 30
    whole = Repair(frame(spark, rows))
    want = sorted(map(repr, whole.summary.collect())), sorted(map(repr, whole.digests.collect()))
    monkeypatch.setattr(rolefix, "BLOCK_BITS", 3)
    cut = Repair(frame(spark, rows))
    assert (sorted(map(repr, cut.summary.collect())), sorted(map(repr, cut.digests.collect()))) == want
    [same] = [r for r in cut.summary.collect() if r.conv_id == 2]
    assert (same.duplicate, same.audit) == (29, "D" * 30)
    edits = [r for r in cut.edits.where("conv_id = 1").orderBy("place").collect()]
    assert "".join(r.op for r in edits) == [r.audit for r in cut.summary.collect() if r.conv_id == 1][0]


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b! c?") for c in (1, 2, None) for t in (*range(40), None)] + [(3, 1, None, None)]
    got = damaged(frame(spark, rows)).collect()
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, want))


def test_conversations_without_turns(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    [row] = repaired_conversations(frame(spark, [(dropped, 0, "user", "A.")])).collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert repaired_conversations(frame(spark, [(1, 0, "user", "A.")]).where("false")).count() == 0
