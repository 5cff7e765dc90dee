"""Language identification by interpolated Kneser-Ney character models.

A text is read as words of letters: each letter (lower case) is one of 63 symbols, everything else a word boundary. a-z have
symbols of their own, other letters share 37 by their code point. A model predicts each letter and each word's end from the
up to ``ORDER - 1`` symbols before it in the word. Per language, n-grams of all training texts are counted; the counts, the
discounts and the continuation counts of lower orders give interpolated Kneser-Ney probabilities, kept as sorted arrays of
packed n-grams with one row of logarithms per language.

Size bound of what is collected and broadcast: ``2 ** (6 * ORDER)`` n-grams a language, whatever the corpus; the counts
themselves cover every training text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import rows_by_key, text_hash, written
from riskframe.llm.textvec import blocks

ORDER = 4
SYMBOL_BITS = 6
SYMBOLS = 1 << SYMBOL_BITS
REJECT_SIGMAS = 12.0
UNKNOWN = "und"

_MERGE_AT = 1 << 22
_table: np.ndarray | None = None


def _symbol(code: int) -> int:
    char = chr(code)
    if unicodedata.category(char)[0] != "L":
        return 0
    low = ord(char.lower()[0])
    return low - 96 if 97 <= low <= 122 else 27 + low * 40503 % 37


def symbols_of(codes: np.ndarray) -> np.ndarray:
    """The symbol of each code point, 0 for what is no letter."""
    global _table
    if _table is None:
        _table = np.array([_symbol(c) for c in range(1 << 16)], np.int32)
    out = _table[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        distinct, at = np.unique(codes[high], return_inverse=True)
        out[high] = np.array([_symbol(int(c)) for c in distinct], np.int32)[at]
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of the block's predicted symbols in order, and the texts' bounds among them."""
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    rows = len(offsets) - 1
    begin = chars + np.arange(rows + 1)  # a boundary before each text and after the last
    s = np.zeros(len(codes) + rows + 1, np.int32)
    inside = np.ones(len(s), bool)
    inside[begin] = False
    s[inside] = symbols_of(codes)
    key = s.copy()
    before = s
    open_ = np.ones(len(s), bool)
    for k in range(1, ORDER):
        before = np.concatenate([[0], before[:-1]]).astype(np.int32)
        open_ &= before > 0
        key |= np.where(open_, before, 0) << (SYMBOL_BITS * k)
    told = s > 0
    told[1:] |= s[:-1] > 0
    counted = np.concatenate([[0], np.cumsum(told)])
    return key[told], counted[begin + 1]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the partition's training texts."""
    names: dict[str, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0

    def merged() -> list[tuple[np.ndarray, np.ndarray]]:
        keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        return [(keys, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64))]

    for batch in batches:
        langs = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], np.int64)
        for lo, hi, data, offsets in blocks(batch.column("_text")):
            key, bounds = grams(data, offsets)
            wide = key.astype(np.int64) | (np.repeat(langs[lo:hi], np.diff(bounds)) << (SYMBOL_BITS * ORDER))
            found = np.unique(wide, return_counts=True)
            held.append(found)
            pending += len(found[0])
            if pending > _MERGE_AT:
                held = merged()
                pending = 0
    if held:
        [(keys, n)] = merged()
        lang = pa.array(list(names), pa.string()).take(pa.array(keys >> (SYMBOL_BITS * ORDER)))
        for at in range(0, len(keys), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays(
                [lang[part], pa.array((keys[part] & ((1 << (SYMBOL_BITS * ORDER)) - 1)).astype(np.int32)), pa.array(n[part])],
                ["lang", "gram", "n"],
            )


def _find(ordered: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and which of them are hits."""
    if not len(ordered):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)
    return at, ordered[at] == asked


class Counts:
    """One language's counts by level: raw at the highest, continuation counts below."""

    def __init__(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.levels = {}
        for level in range(ORDER, 0, -1):
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            contexts, at = np.unique(keys >> SYMBOL_BITS, return_inverse=True)
            total, kinds = np.bincount(at, n), np.bincount(at)
            self.levels[level] = (keys, n, float(discount), contexts, total, discount * kinds / total)
            keys, n = np.unique(keys & ((1 << (SYMBOL_BITS * (level - 1))) - 1), return_counts=True)

    def probability(self, level: int, asked: np.ndarray) -> np.ndarray:
        if level == 0:
            return np.full(len(asked), 1.0 / SYMBOLS)
        keys, n, discount, contexts, total, weight = self.levels[level]
        lower = self.probability(level - 1, asked & ((1 << (SYMBOL_BITS * (level - 1))) - 1))
        at, known = _find(contexts, asked >> SYMBOL_BITS)
        own, seen = _find(keys, asked)
        count = np.where(seen, n[own], 0)
        return np.where(known, np.maximum(count - discount, 0) / total[at] + weight[at] * lower, lower)


@dataclass(frozen=True)
class Model:
    """Per level: sorted n-grams of all languages with log probabilities, sorted contexts with log back-off weights; one row
    of each matrix is one language."""

    langs: list[str]
    levels: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, counts: dict[str, Counts]) -> Model:
        langs = sorted(counts)
        levels = {}
        for level in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([counts[x].levels[level][0] for x in langs])).astype(np.int32)
            contexts = np.unique(np.concatenate([counts[x].levels[level][3] for x in langs])).astype(np.int32)
            logs = np.stack([np.log(counts[x].probability(level, keys)) for x in langs]).astype(np.float32)
            weights = []
            for x in langs:
                _, _, _, own, _, weight = counts[x].levels[level]
                at, known = _find(own, contexts)
                weights.append(np.log(np.where(known, weight[at], 1.0)))
            levels[level] = (keys, logs, contexts, np.stack(weights).astype(np.float32))
        return cls(langs, levels)

    def log_probabilities(self, asked: np.ndarray, level: int = ORDER) -> np.ndarray:
        """One row per language, one column per n-gram."""
        if level == 0:
            return np.full((len(self.langs), len(asked)), -np.log(SYMBOLS), np.float32)
        keys, logs, contexts, weights = self.levels[level]
        at, hit = _find(keys, asked)
        out = logs[:, at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            rest = asked[miss]
            found, known = _find(contexts, rest >> SYMBOL_BITS)
            lower = self.log_probabilities(rest & ((1 << (SYMBOL_BITS * (level - 1))) - 1), level - 1)
            out[:, miss] = lower + np.where(known, weights[:, found], 0)
        return out


def fit(docs: DataFrame) -> Model | None:
    """The model of ``docs(lang, _text)``, both not null, from all of them; None if there are none."""
    counts = docs.mapInArrow(_counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    lang = counts.column("lang").to_numpy()
    gram, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
    by_lang = {}
    for x in np.unique(lang.astype(str)).tolist():
        own = np.flatnonzero(lang == x)
        own = own[np.argsort(gram[own])]
        by_lang[x] = Counts(gram[own], n[own])
    return Model.of(by_lang)


def _scores(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        langs = pa.array([*model.langs, UNKNOWN], pa.string())
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("_text"), 1 << 19):
                key, bounds = grams(data, offsets)
                size = np.diff(bounds)
                logs = model.log_probabilities(key)
                entropy = np.empty((len(model.langs), hi - lo))
                for row in range(len(model.langs)):
                    total = np.concatenate([[0.0], np.cumsum(logs[row], dtype=np.float64)])
                    entropy[row] = -(total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(size, 1)
                entropy = np.round(entropy, 9)
                best = entropy.argmin(axis=0)
                least = entropy.min(axis=0)
                share = 1.0 / np.exp(-(entropy - least) * np.minimum(size, 64)).sum(axis=0)
                some = size > 0
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(x).slice(lo, hi - lo) for x in ("doc_id", "_th", "_known", "_lang")),
                        langs.take(pa.array(np.where(some, best, len(model.langs)))),
                        pa.array(np.where(some, np.round(share, 9), 0.0)),
                        pa.array(least, mask=~some),
                        pa.array(size.astype(np.int64)),
                    ],
                    ["doc_id", "_th", "_known", "_lang", "lang_pred", "score", "cross_entropy", "n_symbols"],
                )

    return run


def identify_languages(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """One row per document: doc_id, _th, held_out, lang_pred, score, cross_entropy, n_symbols, rejected.

    Models learn from texts with a language whose id's CRC-32 (of its decimal form) leaves another remainder than 1 by 3;
    ``held_out`` marks the others. The prediction is the language of the lowest cross-entropy per symbol (the first by name
    of equals); ``score`` is its share among all languages, weighing at most 64 symbols.

    A text is rejected if it has no letter, or if its cross-entropy is above the mean of the training texts rightly
    predicted as its language by more than ``REJECT_SIGMAS`` standard deviations; both are taken on the excess times the
    square root of the text's symbols (up to 4096), as short texts vary more.

    Null, empty and letterless texts are ``und`` with score 0, rejected. A null id is neither held out nor trained on; a null
    language is not trained on. With no training text at all everything is ``und``. Repeated rows count and are judged each
    on its own. An empty table gives no rows. Other columns are not read.
    """
    left = F.crc32(F.col(id_column).cast("string").cast("binary")) % 3
    named = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), text_hash(text_column).alias("_th"), (left != 1).alias("_known"),
        F.col(lang_column).alias("_lang"), F.col(text_column).alias("_text"),
    )
    training = F.col("_known") & F.col("_lang").isNotNull() & F.col("_text").isNotNull()
    model = fit(named.where(training).select(F.col("_lang").alias("lang"), "_text"))
    held_out = F.coalesce(~F.col("_known"), F.lit(False)).alias("held_out")
    if model is None:
        return named.select(
            "doc_id", "_th", held_out, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"),
            F.lit(None).cast("double").alias("cross_entropy"), F.lit(0).cast("long").alias("n_symbols"), F.lit(True).alias("rejected"),
        )
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, _th long, _known boolean, _lang string, lang_pred string, score double, cross_entropy double, n_symbols long"
    rows = written(named.mapInArrow(_scores(shared), schema))
    spread = F.sqrt(F.least(F.col("n_symbols"), F.lit(4096)))
    right = rows.where(F.col("_known") & (F.col("lang_pred") == F.col("_lang")))
    means = right.groupBy("lang_pred").agg(F.avg("cross_entropy").alias("_mean"))
    limits = (
        right.join(F.broadcast(means), "lang_pred")
        .groupBy("lang_pred", "_mean")
        .agg(F.sqrt(F.avg(((F.col("cross_entropy") - F.col("_mean")) * spread) ** 2)).alias("_sigma"))
    )
    over = (F.col("cross_entropy") - F.col("_mean")) * spread > REJECT_SIGMAS * F.col("_sigma") + 1e-6
    return rows.join(F.broadcast(limits), "lang_pred", "left").select(
        "doc_id", "_th", held_out, "lang_pred", "score", "cross_entropy", "n_symbols",
        ((F.col("lang_pred") == UNKNOWN) | F.coalesce(over, F.lit(False))).alias("rejected"),
    )


def without_rejected(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> DataFrame:
    """The documents whose language is not rejected, all columns kept."""
    found = identify_languages(docs, id_column, text_column, lang_column)
    return rows_by_key(docs, found.where("rejected"), "left_anti", id_column, text_column)
