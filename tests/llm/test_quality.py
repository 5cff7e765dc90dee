import random
import re
from collections import Counter

from pyspark.sql import types as T

from riskframe.llm.quality import fit, quality_verdicts

LABELS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())])


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def prose(rng, junk):
    words = [rng.choice(["alpha", "beta", "gamma", "delta", "omega", "sigma", "kappa", "theta"]) + rng.choice(["s", "ed", "ing", ""]) for _ in range(70)]
    return " ".join(w.upper() + "!!" if junk else w for w in words)


def test_base_and_verdict(spark, documents):
    rng = random.Random(2)
    rows = [(i, prose(rng, i % 3 == 0)) for i in range(240)]
    rows += [(500, None), (501, ""), (502, "a\n\n \na\nb a\x0bé <|> " * 40), (503, "x " * 50_000), (504, "a b c a b c d\x00 \x01"), (7, rows[7][1]), (None, rows[9][1])]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(200)] + [(5, None, None), (None, 1, 0), (3, 1, 0), (9999, 0, 1)], LABELS)
    frame = documents(rows)
    model = fit(frame, labels)
    got = quality_verdicts(frame, model).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        if r.doc_id is not None:
            n, chars, symbols, dup, repeat = want = base(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert 0 <= r.score <= 1 and (not r.kept or not r.base_failed)
    held_out = [r for r in got if r.doc_id is not None and 200 <= r.doc_id < 240 and not r.base_failed]
    assert sum(r.kept == (r.doc_id % 3 > 0) for r in held_out) >= 0.95 * len(held_out) > 0
    assert quality_verdicts(frame.where("false"), model).count() == 0


def test_without_labels_the_base_decides(spark, documents):
    rng = random.Random(2)
    frame = documents([(1, prose(rng, False)), (2, "few words")])
    model = fit(frame, spark.createDataFrame([], LABELS))
    assert model is None
    assert {r.doc_id: (r.kept, r.score) for r in quality_verdicts(frame, model).collect()} == {1: (True, None), 2: (False, None)}
