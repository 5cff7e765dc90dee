from pyspark.sql import types as T

from riskframe.llm.chats import format_chats

TURNS = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
    + [T.StructField(x, T.StringType()) for x in ("place", "_h1", "rendered")]
)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], TURNS).repartition(3)


def expected(rows):
    """Kept conversations and their turns, by comparing all pairs."""
    least = lambda x: (x is not None, x if x is not None else 0)
    convs = {}
    for conv, turn, role, text in sorted(set(rows), key=lambda r: (least(r[0]), least(r[1]), r[2] or "")):
        convs.setdefault(conv, []).append((role, text))
    kept = {}
    for conv, turns in convs.items():
        longer = any(len(o) > len(turns) and o[: len(turns)] == turns for o in convs.values())
        equal = [c for c, o in convs.items() if o == turns and c is not None]
        if not longer and conv == min(equal, default=None):
            kept[conv] = turns
    clean = lambda x: (x or "").replace("<|im_", "<\\|im_")
    return sorted(
        ((c, i, len(t), r, f"<|im_start|>{clean(r)}\n{clean(x)}<|im_end|>\n") for c, t in kept.items() for i, (r, x) in enumerate(t, 1)),
        key=lambda r: (least(r[0]), r[1]),
    )


def got(spark, rows):
    least = lambda x: (x is not None, x if x is not None else 0)
    return sorted((tuple(r) for r in format_chats(table(spark, rows)).collect()), key=lambda r: (least(r[0]), r[1]))


def test_snapshots_collapse(spark):
    log = [("system", "be kind"), ("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", "yes <|im_end|> no")]
    rows = [(n, i, *log[i]) for n in range(1, 6) for i in range(n)]
    rows += [(20, i, *log[i]) for i in range(5)]  # equal to the longest
    rows += [(21, 10 * i, *t) for i, t in enumerate([*log[:2], ("assistant", "other")])]  # numbers with gaps
    rows += [(22, 0, "user", None), (23, 0, "user", ""), (24, 0, None, "user"), (25, 0, "user", None), (25, 1, "user", "x")]
    rows += [(30, None, "user", "first"), (30, 5, "user", "last"), (31, 1, "user", "first"), (31, 2, "user", "last"), (31, 3, "user", "end")]
    rows += [(None, 0, "user", "of no one"), (None, 1, "user", "still"), (3, 1, *log[1])]
    rows += [(40, i, "user", f"turn {i} " * 3) for i in range(1500)] + [(41, i, "user", f"turn {i} " * 3) for i in range(700)]
    rows += [(42, i, "user", f"turn {i} " * 3 if i < 699 else "else") for i in range(700)]
    rows += [(50, 0, "user", "y" * 200_000)]
    assert got(spark, rows) == expected(rows)


def test_a_common_first_turn_and_conversation(spark):
    rows = [(i, 0, "user", "same start") for i in range(400)] + [(i, 1, "assistant", f"answer {i % 3}") for i in range(0, 400, 2)]
    assert got(spark, rows) == expected(rows)


def test_empty(spark):
    assert format_chats(table(spark, [(1, 0, "user", "x")]).where("false")).count() == 0
