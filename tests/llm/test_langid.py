import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from riskframe.llm.langid import ORDER, Counts, Model, grams, identify_languages, symbols_of, without_rejected
from riskframe.llm.textvec import text_bytes

EN = "the cat and the dog went to the market in the morning with three of their friends and then home again "
DE = "der hund und die katze gingen am morgen mit drei ihrer freunde auf den markt und danach wieder nach hause über die brücke "


def slow_grams(text):
    out, word = [], []
    for c in [*text, " "]:
        s = int(symbols_of(np.array([ord(c)]))[0])
        if s or word:
            context = ([0] * ORDER + word)[-(ORDER - 1) :]
            out.append((*context, s))
        word = [*word, s] if s else []
    return out


def test_grams_by_plain_scanning():
    texts = ["Hello, World! ab", "", "éa  -- \n x", "日本 a", "12 3", "a", "🙂 mid𝒳dle"]
    data, offsets = text_bytes(pa.array(texts))
    key, bounds = grams(data, offsets)
    for i, text in enumerate(texts):
        own = [tuple(int(k) >> (6 * j) & 63 for j in range(ORDER - 1, -1, -1)) for k in key[bounds[i] : bounds[i + 1]]]
        assert own == slow_grams(text), text


def kneser_ney(counts, gram):
    """Interpolated Kneser-Ney by the definition, on a counter of n-grams of the highest order."""
    level = len(gram)
    if level == 0:
        return 1 / 64
    ones, twos = sum(n == 1 for n in counts[level].values()), sum(n == 2 for n in counts[level].values())
    d = ones / (ones + 2 * twos) if ones and twos else 0.5
    own = {g: n for g, n in counts[level].items() if g[:-1] == gram[:-1]}
    lower = kneser_ney(counts, gram[1:])
    if not own:
        return lower
    total = sum(own.values())
    return max(own.get(gram, 0) - d, 0) / total + d * len(own) / total * lower


def test_probabilities_are_kneser_ney():
    texts = {"en": EN * 2 + "x", "de": DE}
    models, plain = {}, {}
    for lang, text in texts.items():
        top = Counter(slow_grams(text))
        keys = np.array([sum(s << (6 * (ORDER - 1 - i)) for i, s in enumerate(g)) for g in top], np.int64)
        order = np.argsort(keys)
        models[lang] = Counts(keys[order], np.array([*top.values()])[order])
        levels = {ORDER: top}
        for level in range(ORDER - 1, 0, -1):
            levels[level] = Counter(g[1:] for g in levels[level + 1])
        plain[lang] = levels
    model = Model.of(models)
    asked = sorted(set(slow_grams("the brücke wenth zzq dog katz")))
    keys = np.array([sum(s << (6 * (ORDER - 1 - i)) for i, s in enumerate(g)) for g in asked], np.int32)
    logs = model.log_probabilities(keys)
    for row, lang in enumerate(model.langs):
        for column, g in enumerate(asked):
            assert math.isclose(logs[row, column], math.log(kneser_ney(plain[lang], g)), rel_tol=1e-4), (lang, g)


def test_predictions(documents):
    rows = [(i, (EN if i % 2 else DE)[: 40 + i], "en" if i % 2 else "de") for i in range(90)]
    rows += [(100, None, "en"), (101, "", "de"), (102, "12 .. 3", "en"), (None, DE, "de"), (103, EN, None), (104, DE * 400, None), (1, rows[1][1], "en")]
    rows += [(105, "qzxj vkqw xzzq jjkv qqxw zvkj wxqz kqjv " * 30, None)]
    got = identify_languages(documents(rows)).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    for i in range(90):
        assert by_id[i][0].lang_pred == ("en" if i % 2 else "de") and not by_id[i][0].rejected
    assert len(by_id[1]) == 2 and by_id[None][0].lang_pred == "de" and by_id[103][0].lang_pred == "en" and by_id[104][0].lang_pred == "de"
    for i in (100, 101, 102):
        assert (by_id[i][0].lang_pred, by_id[i][0].score, by_id[i][0].rejected) == ("und", 0.0, True)
    assert by_id[105][0].rejected
    kept = without_rejected(documents(rows))
    assert kept.columns == documents(rows).columns and kept.count() == len(rows) - 4


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = identify_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() > 0


def test_nothing_to_learn_from(documents):
    [row] = identify_languages(documents([(0, EN, None)])).collect()
    assert (row.lang_pred, row.score, row.rejected) == ("und", 0.0, True)
    assert identify_languages(documents([(0, EN)]).where("false")).count() == 0
