"""Quality rules: countable base rules and a hashed n-gram logistic regression with calibrated probabilities.

The model's features are hashed word 1- and 2-grams (A-Z in lower case) and byte 3- and 4-grams (case kept), each family
as shares of its own total, in one space of 2 ** BITS weights. It is fitted on at most ``max_rows`` labelled documents, the
ones whose ids hash lowest (a documented bound on training only); Platt scaling on every fourth of them turns the margin
into a probability. Every document is then scored over its whole text, in Arrow batches, against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.textvec import BLANK, Words, blocks, byte_table, find_words, mix, sums_between

BITS = 18
MAX_TRAIN_ROWS = 2000
KEEP_AT = 0.5
MIN_WORDS = 50
REPEAT_PERCENT = 50
SCALE = 40.0
FAMILIES = 4

_WORDS = byte_table(BLANK)
_EXACT = byte_table(BLANK, lower=False)
_LINES = byte_table(b"\n", lower=False)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_STEP = np.uint64(0x9FB21C651E98DF25)

RESULT_SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def feature_slots(data: np.ndarray, offsets: np.ndarray, words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per family the weight slot of every n-gram of the block in order, and the texts' bounds among them."""
    cut = np.uint64(64 - BITS)
    yield (words.hash >> cut).astype(np.int64), words.bounds
    counts = np.maximum(np.diff(words.bounds) - 1, 0)
    if len(words.hash) > 1:
        text = words.text
        pair = mix(words.hash[:-1] * _STEP + words.hash[1:])[text[:-1] == text[1:]]
    else:
        pair = words.hash[:0]
    yield (pair >> cut).astype(np.int64), np.concatenate([[0], np.cumsum(counts)])
    for n in (3, 4):
        gram = np.zeros(max(len(data) - n + 1, 0), np.uint32)
        for i in range(n):
            gram |= data[i : len(data) - n + 1 + i].astype(np.uint32) << np.uint32(8 * i)
        gram = (gram ^ np.uint32(n * 0x01000193)) * np.uint32(2654435761)
        slots = (gram >> np.uint32(32 - BITS)).astype(np.int64)
        lengths = np.maximum(np.diff(offsets) - n + 1, 0)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        keep = np.repeat(offsets[:-1] - bounds[:-1], lengths) + np.arange(bounds[-1])
        yield slots[keep] if len(keep) != len(slots) else slots, bounds


def margins(model: Model, data: np.ndarray, offsets: np.ndarray, words: Words) -> np.ndarray:
    total = np.full(len(offsets) - 1, model.bias)
    for slots, bounds in feature_slots(data, offsets, words):
        total += SCALE * sums_between(model.weights[slots], bounds) / np.maximum(np.diff(bounds), 1)
    return total


def base_counts(data: np.ndarray, offsets: np.ndarray, exact: Words) -> dict[str, np.ndarray]:
    """The countable rules' values per text."""
    blank = _EXACT[data] == 0
    in_word = ~blank
    leads = (data & 0xC0) != 0x80
    lines = find_words(data, offsets, _LINES)
    solid = np.concatenate([[0], np.cumsum(in_word)])
    filled = solid[lines.end] > solid[lines.start]
    text_of_line = lines.text
    key = mix(lines.hash ^ mix(text_of_line.astype(np.uint64)))[filled]
    _, first = np.unique(key, return_index=True)
    rows = len(offsets) - 1
    held = np.bincount(text_of_line[filled], minlength=rows)
    distinct = np.bincount(text_of_line[filled][first], minlength=rows)

    n = len(exact.hash)
    covered = np.zeros(n, bool)
    if n >= 3:
        text = exact.text
        key = mix(mix(exact.hash[:-2] * _STEP + exact.hash[1:-1]) * _STEP + exact.hash[2:]) ^ mix(text[:-2].astype(np.uint64))
        inside = np.flatnonzero(text[:-2] == text[2:])
        _, group, counts = np.unique(key[inside], return_inverse=True, return_counts=True)
        again = inside[counts[group] >= 2]
        for step in range(3):
            covered[again + step] = True
    return {
        "n_words": np.diff(exact.bounds),
        "word_chars": sums_between(in_word & leads, offsets),
        "n_symbols": sums_between(_SYMBOL[data], offsets),
        "n_dup_lines": held - distinct,
        "n_repeat_words": exact.per_text(covered),
    }


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("_text")):
                counts = base_counts(data, offsets, find_words(data, offsets, _EXACT))
                if model is None:
                    score = pa.nulls(hi - lo, pa.float64())
                else:
                    margin = margins(model, data, offsets, find_words(data, offsets, _WORDS))
                    score = pa.array(np.round(_sigmoid(model.slope * margin + model.shift), 9))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(lo, hi - lo), *(pa.array(x.astype(np.int64)) for x in counts.values()), score],
                    ["doc_id", *counts, "score"],
                )

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse feature rows of the training sample."""
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch.column("_text")):
            parts = list(feature_slots(data, offsets, find_words(data, offsets, _WORDS)))
            slots, values = [], []
            for row in range(hi - lo):
                index, weight = [], []
                for s, bounds in parts:
                    own = s[bounds[row] : bounds[row + 1]]
                    if len(own):
                        at, n = np.unique(own, return_counts=True)
                        index.append(at)
                        weight.append(n / len(own))
                slots.append(np.concatenate(index).astype(np.int32) if index else np.zeros(0, np.int32))
                values.append(np.concatenate(weight).astype(np.float32) if weight else np.zeros(0, np.float32))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(lo, hi - lo),
                    batch.column("good").slice(lo, hi - lo),
                    pa.array(slots, pa.list_(pa.int32())),
                    pa.array(values, pa.list_(pa.float32())),
                ],
                ["doc_id", "good", "slots", "values"],
            )


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> Model | None:
    """The model from labelled documents: ``docs(doc_id, text)``, ``labels(doc_id, quality)``; None if the labels have
    fewer than two classes. Of several labels of one id the mean counts (a half is good), of several texts the least."""
    judged = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).alias("good"))
    )
    chosen = judged.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = (
        docs.select("doc_id", F.col("text").alias("_text"))
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "good")
        .agg(F.min("_text").alias("_text"))
    )
    table = texts.mapInArrow(_features, "doc_id long, good boolean, slots array<int>, values array<float>").toArrow()
    table = table.sort_by("doc_id").combine_chunks()
    good = table.column("good").to_numpy().astype(np.float64)
    if len(good) < 8 or good.min() == good.max():
        return None
    lists = table.column("slots").combine_chunks()
    index = lists.flatten().to_numpy()
    value = table.column("values").combine_chunks().flatten().to_numpy().astype(np.float64) * SCALE
    row = np.repeat(np.arange(len(good)), np.diff(lists.offsets.to_numpy()))
    return _fitted(index, value, row, good)


def _fitted(index: np.ndarray, value: np.ndarray, row: np.ndarray, good: np.ndarray, rounds: int = 80) -> Model:
    """Ridge-penalised logistic regression by full-batch Adam, classes weighted alike, then Platt scaling on the rows set aside."""
    aside = np.arange(len(good)) % 4 == 3
    if min(np.bincount(good[aside].astype(int), minlength=2)) == 0 or min(np.bincount(good[~aside].astype(int), minlength=2)) == 0:
        aside = np.zeros(len(good), bool)
    size = 1 << BITS
    share = np.where(good > 0, 0.5 / max(good[~aside].sum(), 1), 0.5 / max((1 - good[~aside]).sum(), 1)) * ~aside
    weights, bias = np.zeros(size), 0.0
    first, second, fb, sb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        margin = np.bincount(row, weights[index] * value, len(good)) + bias
        pull = (_sigmoid(margin) - good) * share
        slope = np.bincount(index, pull[row] * value, size) + 1e-5 * weights
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        fb, sb = 0.9 * fb + 0.1 * pull.sum(), 0.99 * sb + 0.01 * pull.sum() ** 2
        rate = 0.05 / (1 - 0.9**t)
        weights -= rate * first / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        bias -= rate * fb / (np.sqrt(sb / (1 - 0.99**t)) + 1e-8)
    margin = np.bincount(row, weights[index] * value, len(good)) + bias
    held = aside if aside.any() else np.ones(len(good), bool)
    slope, shift = _platt(margin[held], good[held])
    return Model(weights.astype(np.float32), float(bias), slope, shift)


def _platt(margin: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the calibrated probability, by Newton steps on smoothed targets."""
    hit, miss = good.sum(), len(good) - good.sum()
    target = np.where(good > 0, (hit + 1) / (hit + 2), 1 / (miss + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = _sigmoid(a * margin + b)
        w = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()
        haa, hab, hbb = (w * margin**2).sum() + 1e-3, (w * margin).sum(), w.sum() + 1e-9
        det = haa * hbb - hab**2
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 2.0 / (abs(da) + abs(db) + 1e-12))
        a, b = a - step * da, b - step * db
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def quality_verdicts(
    docs: DataFrame, model: Model | None, keep_at: float = KEEP_AT, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    ``kept`` is false where a base rule fails, else whether the calibrated probability of good quality is at least
    ``keep_at``; without a model, base rules alone decide and the score is null. Null and empty texts have no words and
    fail. Repeated rows are judged each on its own, null ids too; other columns are not read; an empty table gives no rows.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("_text"))
    rows = named.mapInArrow(_scored(model), RESULT_SCHEMA)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & F.coalesce(F.col("score") >= keep_at, F.lit(True))).alias("kept"),
        "score",
    )
