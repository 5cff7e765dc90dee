import random

from pyspark.sql import types as T

from riskframe.llm.decontam import contaminated_pairs, longest_run, without_contaminated

ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("key", T.StringType())])

QUESTION = "Tom walks 3.5 km to the old market and buys 12 red apples there, then Tom gives Anna 4 of the apples. How many are left?"
ASKED_ANEW = "Maria walks 2,5 miles to the old market and buys 30 red apples there, then Maria gives Peter 7 of the apples. How many are left?"
MIXED_UP = "Maria walks 2,5 miles to the old market and buys 30 red apples there, then Peter gives Peter 7 of the apples. How many are left?"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnrs')}{rng.randrange(10**4)}x" .replace("0", "o").translate(str.maketrans("123456789", "abcdefghi")) for _ in range(n))


def test_leaks(spark, documents):
    long_item, short_item = words(1, 40), "seven little words make this up"
    items = spark.createDataFrame(
        [(1, QUESTION, "x"), (2, long_item, "x"), (3, short_item, "x"), (4, None, "x"), (5, "", "x"), (6, "too short", "x"), (9, long_item, "x"), (None, words(8, 20), "x")],
        ITEMS,
    )
    rows = [
        (10, f"{words(2, 60)} {QUESTION} {words(3, 60)}"),
        (11, f"Then. {ASKED_ANEW}"),
        (12, MIXED_UP),
        (13, f"{words(4, 30)}\n{long_item.upper()} {words(5, 30)}"),
        (14, " ".join(long_item.split()[5:20])),
        (15, " ".join(long_item.split()[5:15])),
        (16, f"so {short_item}, indeed"),
        (17, words(6, 3000)),
        (18, None),
        (19, ""),
        (20, "too short"),
        (21, words(8, 20)),
        (10, f"{words(2, 60)} {QUESTION} {words(3, 60)}"),
    ]
    got = {(r.doc_id, r.item_id): r for r in contaminated_pairs(documents(rows), items).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2), (14, 2), (16, 3), (21, None)}
    assert got[10, 1].exact and not got[11, 1].exact
    assert (got[13, 2].matched_tokens, got[14, 2].matched_tokens, got[16, 3].matched_tokens) == (40, 15, 6)
    kept = without_contaminated(documents(rows), items)
    assert sorted(r.doc_id for r in kept.collect()) == [12, 15, 17, 18, 19, 20]
    assert contaminated_pairs(documents(rows), items.where("false")).count() == 0
    assert contaminated_pairs(documents(rows).where("false"), items).count() == 0


def test_windows_by_brute_force(spark, documents):
    """Every run of 13 equal tokens of an item is found, and nothing else."""
    rng = random.Random(4)
    vocabulary = words(9, 6).split()
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(30))) for i in range(6)]
    docs = []
    for d in range(80):
        item = rng.choice(items)[1].split()
        at, n = rng.randrange(15), rng.randrange(9, 16)
        docs.append((d, " ".join([rng.choice(vocabulary) for _ in range(20)] + item[at : at + n] + [rng.choice(vocabulary) for _ in range(20)])))
    want = set()
    for d, text in docs:
        x = text.split()
        for i, item in items:
            y = item.split()
            if any(x[a : a + 13] == y[b : b + 13] for a in range(len(x) - 12) for b in range(len(y) - 12)):
                want.add((d, i))
    table = spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS)
    got = {(r.doc_id, r.item_id): r.matched_tokens for r in contaminated_pairs(documents(docs), table).collect()}
    assert want <= set(got) and all(n >= 13 for n in got.values())


def test_items_of_one_template_are_judged_each_by_its_own_values(spark, documents):
    other = QUESTION.replace("3.5", "5").replace("12", "6").replace("4 of", "5 of")
    items = spark.createDataFrame([(1, QUESTION, "x"), (2, other, "x"), (3, other, "x")], ITEMS)
    got = {(r.doc_id, r.item_id): r.exact for r in contaminated_pairs(documents([(10, other), (11, QUESTION)]), items).collect()}
    assert got[10, 2] and got[11, 1] and not {(10, 3), (11, 3)} & set(got)
    assert without_contaminated(documents([(10, other), (11, QUESTION)]), items).count() == 0


def test_a_clash_of_slots_does_not_hide_the_rest(spark, documents):
    long_item = f"{QUESTION} {words(11, 30)}"
    items = spark.createDataFrame([(1, QUESTION, "x"), (2, long_item, "x")], ITEMS)
    rows = [
        (10, f"{words(2, 20)} {QUESTION.replace('then Tom', 'then Ben')}"),  # one occurrence changed in a copy
        (11, ASKED_ANEW.replace("30", "7")),  # two values of the item became one
        (12, MIXED_UP),  # a clash in a short question with other values throughout
        (13, f"{MIXED_UP} {words(11, 30)}"),
    ]
    got = {(r.doc_id, r.item_id): r for r in contaminated_pairs(documents(rows), items).collect()}
    assert {(10, 1), (11, 1), (13, 2)} <= set(got) and not any(d == 12 for d, _ in got)
    assert 13 <= got[10, 1].matched_tokens < 26 and not got[10, 1].exact and got[13, 2].matched_tokens >= 26


def test_longest_run_by_brute_force():
    rng = random.Random(2)
    for _ in range(300):
        covered = sorted(rng.sample(range(30), rng.randrange(1, 25)))
        pairs = [(p, rng.randrange(4), rng.randrange(2)) for p in covered if rng.random() < 0.4]
        want = 0
        for a in range(31):
            for b in range(a + 1, 31):
                held = {(i, d) for p, i, d in pairs if a <= p < b}
                if len(held) == len({i for i, _ in held}):
                    want = max(want, sum(a <= p < b for p in covered))
        assert longest_run(covered, pairs)[0] == want


def test_copies_in_another_letter_case(spark, documents):
    named = "Zoë Éva Tom Anna Ben Maria Peter met Carl Dora Emil Fritz Gerda in Rome Paris Oslo Bonn Kiel"
    items = spark.createDataFrame([(1, QUESTION, "x"), (2, named, "x")], ITEMS)
    rows = [(i, f"{words(i, 20)} {text}") for i, text in enumerate([QUESTION.lower(), QUESTION.upper(), named.lower(), named.upper(), named, named.title()], 10)]
    got = {(r.doc_id, r.item_id): (r.matched_tokens == r.item_tokens, r.exact) for r in contaminated_pairs(documents(rows), items).collect()}
    assert got == {(d, 1 if d < 12 else 2): (True, True) for d, _ in rows}
