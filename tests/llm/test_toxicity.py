import math
import random
import zlib

import pytest

from riskframe.llm.toxicity import _automaton, choose_terms, density, fit, fold_words, terms_of, toxicity_scores

SF = "/root/testdata/sf0.1"


def test_folding():
    assert fold_words("You 1D10T, idi0t! ІDІОТ ｉｄｉｏｔ id\u200biot m0r0n5 tr@$h") == ["you", "idiot", "idiot", "idiot", "idiot", "idiot", "morons", "trash"]
    assert fold_words("In 2024 we paid $500, a@b.c and 3 x") == ["in", "we", "paid", "aab", "c", "and", "x"]
    assert fold_words(None) == fold_words("") == fold_words(" 12 ... ") == []
    assert fold_words("Größe éA") == ["größe", "éa"]


def slow_density(weights, harmless, words):
    text = " " + " ".join(words) + " "
    at = [i for i, c in enumerate(text) if c == " "]
    spans = [(i, i + len(t.rstrip()), w) for i in at for t, w in weights.items() if text.startswith(t, i)]
    safe = [(i, i + len(p) + 1) for i in at for p in harmless if text.startswith(f" {p} ", i)]
    spans = [s for s in spans if not any(a <= s[0] and s[1] <= b for a, b in safe)]
    return math.fsum(w for _, _, w in spans), len(spans)


def test_matching_against_plain_scanning():
    from riskframe.llm.toxicity import HARMLESS

    rng = random.Random(4)
    weights = {" trash ": 3.0, " clown": 2.5, " fis": 1.5, " pathetic ": 3.5, " can ": 1.0}
    automaton = _automaton(weights)
    for _ in range(300):
        words = rng.choices(["trash", "can", "clown", "clowns", "fish", "pathetic", "fallacy", "the", "take", "out", "bin"], k=rng.randrange(40))
        got, want = density(automaton, words), slow_density(weights, HARMLESS, words)
        assert got[1] == want[1] and got[0] == pytest.approx(want[0])
    assert density(automaton, ["trash", "trash"])[1] == 2 and density(automaton, "take out the trash".split())[1] == 0


def test_lexicon_terms():
    assert terms_of("idiots") == [" idi", " idio", " idiot", " idiots", " idiots "] and terms_of("ab") == [" ab "]
    toxic = {t: (50, 50 * 20_000) for t in terms_of("zorgle")} | {t: (90, 90 * 50_000) for t in terms_of("the")} | {" worthless ": (1, 9)}
    other = {t: (900, 900 * 50_000) for t in terms_of("the")} | {" worthless ": (900, 900 * 9000)}
    kept = choose_terms(toxic, other, 100, 1000)
    assert " zorgle" in kept and " zorg" not in kept and " the" not in kept
    assert " worthless " not in kept and kept[" moron "] == pytest.approx(3.0)


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity_scores(docs, fit(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= 0.92 * len(toxic) and sum(clean) <= 0.005 * len(clean)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - toxic, toxic) as toxic")
    assert fit(docs, labels) == fit(docs.selectExpr("text", "doc_id", "'x' as source", "'x' as score"), turned)


def test_odd_inputs(spark, documents):
    rows = [(1, None), (2, ""), (3, "..."), (None, "You idiot, you worthless moron."), (5, "word " * 100_000), (6, "1d10t " * 500), (6, "1d10t " * 500)]
    frame = documents(rows)
    for labelled in ([], [(1, 1, 0), (2, 1, 0)]):
        model = fit(frame, spark.createDataFrame(labelled, "doc_id long, quality int, toxic int"))
        got = {(r.doc_id, r.n_words): r for r in toxicity_scores(frame, model).collect()}
        assert got[1, 0].score == got[2, 0].score == got[3, 0].score < 0.2
        assert got[None, 5].predicted == 1 and not got[None, 5].held_out and got[5, 100_000].predicted == 0
        assert got[6, 500].n_hits == 500 and got[6, 500].predicted == 1
        assert toxicity_scores(frame, model).count() == 7 and toxicity_scores(frame.where("false"), model).count() == 0


def test_more_hits_never_lower_a_score(spark, documents):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels)
    rows = [(i, "idiot " * i + "word " * (200 - i)) for i in range(0, 201, 10)]
    scores = [r.score for r in toxicity_scores(documents(rows), model).orderBy("doc_id").collect()]
    assert scores == sorted(scores) and scores[0] < 0.3 and scores[-1] > 0.9
