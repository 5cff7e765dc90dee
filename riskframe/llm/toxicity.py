"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text.

Text is folded: compatibility forms and case, letters of other scripts that look like Latin ones, and digits or signs that
stand for letters within a word. What is left is words between single blanks, so a term begins at a word's start.

The lexicon joins a short list of fixed insults with terms learned from labels: word beginnings of 3 to 10 letters and whole words whose
mean share of a document's words is higher in toxic documents. A term's weight is the logarithm of the ratio of these
shares. Labels are learned from ``MAX_TRAIN_ROWS`` ids at most (a documented bound on training only), over whole texts; of
nested terms with the same counts only the longest is looked at, and no kept term begins with another. Terms of a fixed list of harmless phrases don't count where the phrase stands.

A document's hits, by weight, are divided by its length; a logistic regression on this density turns it into a probability.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written

PREDICT_AT = 0.7
SHORTEST, LONGEST = 3, 10
#: A learned term stands in this share of toxic documents at least (and in three), with this log-likelihood ratio and weight.
SUPPORT, LEAST_DOCS, EVIDENCE, LEAST_WEIGHT = 0.005, 3, 12.0, 1.0
#: Labelled ids that lexicon and calibration are fitted on: those that hash lowest.
MAX_TRAIN_ROWS = 50_000
PPM = 1_000_000
SHORT_TEXT = 20
SMOOTH_PPM = 40.0
FIXED_WEIGHT = 3.0

# Insults that count without labels, and phrases in which they or learned terms are harmless.
INSULTS = (
    "asshole bastard bitch brainless bullshit clown creep cretin degenerate disgusting dumbass filth fool freak garbage idiot imbecile "
    "jackass jerk liar loser lunatic moron pathetic pervert pig scum scumbag shut slut stupid subhuman trash twat vermin wanker worthless"
).split()
HARMLESS = (
    "trash can",
    "trash bin",
    "trash bag",
    "trash collection",
    "take out the trash",
    "garbage collection",
    "garbage collector",
    "garbage can",
    "garbage truck",
    "clown fish",
    "clown nose",
    "circus clown",
    "pathetic fallacy",
    "guinea pig",
    "pig iron",
    "shut down",
    "shut off",
    "shut the door",
    "april fool",
    "control freak of nature",
    "jerk chicken",
    "sore loser board",
    "worthless check",
    "pond scum",
)

# Letters that look like Latin ones, and signs that stand for letters within words.
LOOKALIKES = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "ԁ": "d", "ԛ": "q", "ԝ": "w", "һ": "h", "ӏ": "l", "ё": "e", "ї": "i",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ɩ": "i", "ո": "n", "ս": "u", "օ": "o", "ց": "g", "հ": "h",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}

_LOOKS = str.maketrans(LOOKALIKES)
_SIGNED = str.maketrans(SIGNS)
_HIDDEN = re.compile("[­​-‏⁠﻿]")
#: A run of letters, digits and the signs, taken as a word if it has a letter; outer digits and signs are not part of it.
_WORD = re.compile(r"[^\W_](?:[@$]*[^\W_]+)*")
_SIGN = re.compile(r"[0-9@$]")
_LETTERS = re.compile(r"[^\W\d_]")


def fold_words(text: str | None) -> list[str]:
    """The folded words of a text; numbers are none."""
    text = unicodedata.normalize("NFKC", text or "").lower()
    if not text.isascii():
        text = _HIDDEN.sub("", text).translate(_LOOKS)
    words = _WORD.findall(text)
    if _SIGN.search(text):
        words = [w if w.isalpha() else w.translate(_SIGNED) for w in words if w.isalpha() or _LETTERS.search(w)]
    return words


def terms_of(word: str) -> list[str]:
    """The word's beginnings and, closed by a blank, the word itself."""
    return [" " + word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1)] + [f" {word} "]


@dataclass(frozen=True)
class Model:
    """Weights of the lexicon's terms; slopes on (log density, density, log length) and shift."""

    weights: dict[str, float]
    slopes: tuple[float, float, float]
    shift: float


def _automaton(weights: dict[str, float]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in weights.items():
        found.add_word(term, (len(term.rstrip()), len(term) - len(term.rstrip()), weight))
    for phrase in HARMLESS:
        found.add_word(f" {phrase} ", (len(phrase) + 1, 1, None))
    found.make_automaton()
    return found


def density(automaton: ahocorasick.Automaton, words: list[str]) -> tuple[float, int]:
    """(weight of the hits, their number) of a folded text."""
    # A blank closes each word, and another opens the next: neighbouring whole words both match.
    spans, harmless = [], []
    for end, (length, closed, weight) in automaton.iter(" " + " ".join(words) + " "):
        last = end - closed
        (harmless if weight is None else spans).append((last - length + 1, last, weight))
    if harmless:
        spans = [s for s in spans if not any(a <= s[0] and s[1] <= b for a, b, _ in harmless)]
    return math.fsum(s[2] for s in spans), len(spans)


def features(automaton: ahocorasick.Automaton, words: list[str]) -> tuple[float, float, float, int]:
    """(log density, density, log length, hits)."""
    total, hits = density(automaton, words)
    share = total / (len(words) + SHORT_TEXT)
    return math.log(share + 0.003), share, math.log(len(words) + 1), hits


def _counted(candidates: frozenset[str] | None):
    """Per term: documents, and millionths of a document's words summed over documents; of candidates only, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[str]] = {}
        for batch in batches:
            docs, shares = Counter(), Counter()
            for text in batch.column("_text").to_pylist():
                words = fold_words(text)
                held: Counter[str] = Counter()
                for word, n in Counter(words).items():
                    terms = known.get(word)
                    if terms is None:
                        terms = terms_of(word)
                        if candidates is not None:
                            terms = [t for t in terms if t in candidates]
                        if len(known) > 200_000:
                            known.clear()
                        known[word] = terms
                    for term in terms:
                        held[term] += n
                docs.update(held.keys())
                total = max(len(words), SHORT_TEXT)
                for term, n in held.items():
                    shares[term] += PPM * n // total
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(docs), pa.string()), pa.array(list(docs.values()), pa.int64()), pa.array([shares[t] for t in docs], pa.int64())],
                ["term", "docs", "share"],
            )

    return run


def _term_counts(texts: DataFrame, candidates: frozenset[str] | None = None) -> DataFrame:
    rows = texts.select("_text").mapInArrow(_counted(candidates), "term string, docs long, share long")
    return rows.groupBy("term").agg(F.sum("docs").alias("docs"), F.sum("share").alias("share"))


def likelihood_ratio(a: int, b: int, n_a: int, n_b: int) -> float:
    """The G statistic of a term in ``a`` of ``n_a`` toxic and ``b`` of ``n_b`` other documents."""
    total = n_a + n_b
    cells = ((a, n_a * (a + b)), (b, n_b * (a + b)), (n_a - a, n_a * (total - a - b)), (n_b - b, n_b * (total - a - b)))
    return 2 * sum(x * math.log(x * total / e) for x, e in cells if x > 0)


def choose_terms(toxic: dict[str, tuple[int, int]], other: dict[str, tuple[int, int]], n_toxic: int, n_other: int) -> dict[str, float]:
    """The lexicon from (documents, summed share) per term of both classes.

    Terms come by the share of toxic text they explain; of those within 2 % of each other the longest beginning first. None is
    kept that a kept one begins, or that begins a kept one. Fixed insults stay, unless the labels speak against them.
    """

    def weight(term: str, prior: float = 0.0) -> float:
        a, b = toxic.get(term, (0, 0))[1] / max(n_toxic, 1) + prior, other.get(term, (0, 0))[1] / max(n_other, 1)
        return math.log((a + SMOOTH_PPM) / (b + SMOOTH_PPM))

    ranked = []
    for term, (docs, share) in toxic.items():
        against = other.get(term, (0, 0))[0]
        if docs * n_other <= against * n_toxic or likelihood_ratio(docs, against, n_toxic, n_other) < EVIDENCE:
            continue
        own = weight(term)
        if own >= LEAST_WEIGHT:
            ranked.append((own * share, term, own))
    ranked.sort(key=lambda x: (-round(math.log(x[0] + 1) / math.log(1.02)), x[1].endswith(" "), -len(x[1]), x[1]))
    kept: dict[str, float] = {}
    begun: set[str] = set()
    prior = SMOOTH_PPM * (math.exp(FIXED_WEIGHT) - 1)
    fixed = [(t, weight(t, prior)) for t in (f" {w} " for w in INSULTS)]
    for term, own in [(t, w) for _, t, w in ranked] + [(t, w) for t, w in fixed if w >= LEAST_WEIGHT]:
        if term in begun or any(term[:n] in kept for n in range(1, len(term) + 1)):
            continue
        kept[term] = own
        begun.update(term[:n] for n in range(1, len(term) + 1))
    return kept


def _with_features(model_weights: dict[str, float], columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(model_weights)
        for batch in batches:
            rows, n_words = [], []
            for text in batch.column("_text").to_pylist():
                words = fold_words(text)
                n_words.append(len(words))
                rows.append(features(automaton, words))
            log_density, share, log_length, hits = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in columns),
                    pa.array(n_words, pa.int64()),
                    pa.array(hits, pa.int64()),
                    *(pa.array(x, pa.float64()) for x in (log_density, share, log_length)),
                ],
                [*columns, "n_words", "n_hits", "log_density", "density", "log_length"],
            )

    return run


_FEATURES = "n_words long, n_hits long, log_density double, density double, log_length double"


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _calibrated(x: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float, float], float]:
    """Slopes and shift on (log density, density, log length). A slope on density below zero is set to zero and the rest
    fitted anew, so that more hits never lower a score."""
    free = [0, 1, 2]
    while True:
        slopes, shift = _newton(x[:, free], y)
        low = [f for f, s in zip(free, slopes, strict=True) if f < 2 and s < 0]
        if not low:
            return tuple(dict(zip(free, slopes, strict=True)).get(f, 0.0) for f in range(3)), shift
        free = [f for f in free if f not in low[-1:]]


def _newton(x: np.ndarray, y: np.ndarray) -> tuple[list[float], float]:
    """Slopes and shift of a ridge-penalised logistic regression, by Newton steps on standardised features."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    ridge = np.array([0.1] * x.shape[1] + [1e-3])
    for _ in range(40):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z.T * (p * (1 - p))) @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    slopes = w[:-1] / spread
    return slopes.tolist(), float(w[-1] - slopes @ mean)


#: Without labels of both kinds: a density of 0.06 (one fixed insult in fifty words) is even.
UNLABELLED = ((2.5, 0.0, 0.0), -2.5 * math.log(0.063))


def learnable(doc_id) -> F.Column:
    """Rows that labels may be learned from: the id's CRC-32 modulo 3 is not 1. A null id is none of them."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model:
    """The lexicon and its calibration from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)`` of learnable ids.

    Of several labels of one id the mean counts (a half is toxic); each text of the id is a document. Candidates for the lexicon come from
    toxic documents; as each stands in ``SUPPORT`` of them at least, there are at most the mean number of a document's terms
    divided by ``SUPPORT``, however many documents there are. Of more than ``max_rows`` labelled ids those that hash lowest are
    taken, which bounds the broadcast side of the join.
    """
    judged = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg((F.avg("toxic") >= 0.5).alias("_toxic"))
        .where(learnable(F.col("_id")))
    )
    # A cut by hash leaves little more than is wanted, and the exact limit then works on that.
    share = min(1.0, 1.2 * max_rows / max(judged.count(), 1) + 1e-6)
    low = F.xxhash64("_id") <= F.lit(int((1 << 63) * (2 * share - 1)) - 1)
    chosen = judged.where(low).orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    named = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"))
    train = written(named.join(F.broadcast(chosen), "_id"))
    counts = {r["_toxic"]: r["count"] for r in train.groupBy("_toxic").count().collect()}
    n_toxic, n_other = counts.get(True, 0), counts.get(False, 0)
    if not n_toxic or not n_other:
        return Model(choose_terms({}, {}, 0, 0), *UNLABELLED)
    least = max(LEAST_DOCS, math.ceil(SUPPORT * n_toxic))
    fixed = [f" {w} " for w in INSULTS]
    found = _term_counts(train.where("_toxic")).where((F.col("docs") >= least) | F.col("term").isin(fixed)).toArrow()
    toxic = {t: (d, s) for t, d, s in zip(*(found.column(c).to_pylist() for c in ("term", "docs", "share")), strict=True)}
    against = _term_counts(train.where("not _toxic"), frozenset(toxic) | frozenset(fixed)).toArrow()
    other = {t: (d, s) for t, d, s in zip(*(against.column(c).to_pylist() for c in ("term", "docs", "share")), strict=True)}
    weights = choose_terms(toxic, other, n_toxic, n_other)

    rows = train.mapInArrow(_with_features(weights, ["_toxic"]), f"_toxic boolean, {_FEATURES}").toArrow()
    y = rows.column("_toxic").to_numpy().astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return Model(weights, *UNLABELLED)
    x = np.column_stack([rows.column(c).to_numpy() for c in ("log_density", "density", "log_length")])
    return Model(weights, *_calibrated(x, y))


def toxicity_scores(docs: DataFrame, model: Model, predict_at: float = PREDICT_AT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, n_words, n_hits, density.

    Null, empty and wordless texts have no hits and take the score of a density of zero. Repeated rows are scored each on its
    own, null ids too (not held out); an empty table gives no rows. Other columns are not read.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("_text"))
    rows = named.mapInArrow(_with_features(model.weights, ["doc_id"]), f"doc_id long, {_FEATURES}")
    a, b, c = model.slopes
    margin = F.col("log_density") * a + F.col("density") * b + F.col("log_length") * c + model.shift
    score = F.round(1 / (1 + F.exp(-F.greatest(F.least(margin, F.lit(40.0)), F.lit(-40.0)))), 9)
    scored = rows.withColumn("score", score)
    return scored.select(
        "doc_id",
        F.coalesce(~learnable(F.col("doc_id")), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= predict_at).cast("int").alias("predicted"),
        "n_words",
        "n_hits",
        "density",
    )
