"""Substring dedup by hashing normalised lines and sentences.

A unit is a line, or a sentence of a line of several: sentences end at ``.``, ``!`` or ``?`` before a blank, and begin at a
capitalised word, so that a passage set into running text still gives whole units. With ``runs``, each sentence that is too
short is joined to those after it, and to those before it, until the run has enough words; runs are units as well, so that
a repeated passage of short sentences, or with many capitalised words, is cut from end to end. With ``across_lines`` runs go
on over line ends and a text too short for a run is one unit: a short line or sentence then counts only where its neighbours
repeat beside it, so that a heading or a turn of phrase that two texts share by chance stays. A unit's digest (128 bits) is that of
its words (letters and digits, A-Z in lower case), which leaves out case, marks and blanks. Of all units with one digest,
the occurrence in the smallest id (then the smallest text hash, then the smallest offset) stays and the others are cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import text_hash, unused, written
from riskframe.llm.textvec import MARKS, Words, blocks, byte_table, find_words, mix

MIN_WORDS = 6
#: Least words of a repeated passage, as the query and the pipeline ask for: any lines or sentences that make so many together.
PASSAGE_WORDS = 20

_TABLE = byte_table(MARKS)
_BASES = np.array([0xC2B2AE3D27D4EB4F, 0x9FB21C651E98DF25], np.uint64)
UNIT_SCHEMA = "doc_id long, _th long, start int, end int, n_words int, d1 long, d2 long"


def _digest(hashes: np.ndarray, lengths: np.ndarray, base: np.uint64) -> np.ndarray:
    """64 bits of each run of word hashes."""
    begin = np.cumsum(lengths) - lengths
    place = np.arange(len(hashes)) - np.repeat(begin, lengths)
    steps = np.full(int(lengths.max()), base, np.uint64)
    steps[0] = 1
    weights = np.multiply.accumulate(steps)
    return mix(np.add.reduceat(mix(hashes ^ base) * weights[place], begin) + lengths.astype(np.uint64))


def find_units(
    data: np.ndarray, offsets: np.ndarray, min_words: int, min_line_words: int, runs: bool = False, across_lines: bool = False
) -> tuple[np.ndarray, ...]:
    """(text, start, end, words, d1, d2) of the block's units; offsets count characters of the text. A unit reaches to where
    the next one of its kind begins, the last of a text to its end."""
    words = find_words(data, offsets, _TABLE)
    n = len(words.start)
    if not n:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    text = words.text
    follows = np.zeros(n, bool)
    follows[1:] = text[1:] == text[:-1]

    def in_gap(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        found = np.zeros(n, bool)
        found[1:] = total[words.start[1:]] > total[words.end[:-1]]
        return found

    lead = data[words.start]
    after = data[np.minimum(words.start + 1, len(data) - 1)]
    small = ((after >= 97) & (after <= 122)) | (after >= 0x80)
    capital = (((lead >= 65) & (lead <= 90)) & small & (words.end - words.start > 1)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E))
    line = ~follows | in_gap(data == 10)
    stop = in_gap((data == 46) | (data == 33) | (data == 63)) & in_gap((data == 32) | (data == 9) | (data == 13))
    sentence = line | stop | capital

    char = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    parts = []
    lines, sentences = np.flatnonzero(line), np.flatnonzero(sentence)
    per_line = np.diff(np.concatenate([np.searchsorted(sentences, lines), [len(sentences)]]))
    whole = np.repeat(per_line == 1, per_line)  # the only sentence of its line
    for first, keep, least in ((sentences, ~whole, min_words), (lines, per_line > 0, min_line_words)):
        last = np.concatenate([first[1:], [n]])
        lengths = last - first
        own = text[first]
        ends = np.where((last < n) & (text[np.minimum(last, n - 1)] == own), words.start[np.minimum(last, n - 1)], offsets[own + 1])
        d1, d2 = (_digest(words.hash, lengths, base) for base in _BASES)
        keep = keep & (lengths >= least)
        base = char[offsets[own]]
        parts.append(tuple(x[keep] for x in (own, char[words.start[first]] - base, char[ends] - base, lengths, d1, d2)))
    if runs:
        reach = per_line
        if across_lines:
            reach = np.diff(np.concatenate([np.searchsorted(sentences, np.flatnonzero(~follows)), [len(sentences)]]))
        spans = _short_runs(sentences, n, reach, min_words, across_lines)
        held_line = np.repeat(np.arange(len(lines)), per_line)
        begin_of_line = np.cumsum(per_line) - per_line
        own = held_line[spans[:, 0]]
        is_line = (spans[:, 0] == begin_of_line[own]) & (spans[:, 1] == begin_of_line[own] + per_line[own] - 1)
        if across_lines:
            is_line &= np.diff(np.append(lines, n))[own] >= min_line_words
        spans = spans[~is_line]  # those are units already
        if len(spans):
            parts.append(_run_units(words, text, sentences, spans, char, offsets))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _short_runs(first: np.ndarray, n: int, reach: np.ndarray, min_words: int, wholes: bool) -> np.ndarray:
    """(first sentence, last sentence) of the runs of each short sentence with the next ones, and with those before, as few as
    make ``min_words`` words. ``reach`` counts the sentences of each line or text, whose ends no run crosses; with ``wholes``
    one of fewer words is a run itself."""
    last = np.concatenate([first[1:], [n]])
    end = np.repeat(np.cumsum(reach), reach)
    begin = end - np.repeat(reach, reach)
    short = np.flatnonzero(last - first < min_words)
    to = np.searchsorted(last, first[short] + min_words)
    since = np.searchsorted(first, last[short] - min_words, "right") - 1
    ahead, back = to < end[short], since >= begin[short]
    spans = [np.stack([short[ahead], to[ahead]], 1), np.stack([since[back], short[back]], 1)]
    if wholes:
        opens = np.flatnonzero(np.arange(len(first)) == begin)
        opens = opens[last[end[opens] - 1] - first[opens] < min_words]
        spans.append(np.stack([opens, end[opens] - 1], 1))
    return np.unique(np.concatenate(spans), axis=0)


def _run_units(
    words: Words, text: np.ndarray, first: np.ndarray, spans: np.ndarray, char: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, ...]:
    """The units of the spans of sentences."""
    n = len(words.start)
    last = np.concatenate([first[1:], [n]])
    start, stop = first[spans[:, 0]], last[spans[:, 1]]
    lengths = stop - start
    held = np.arange(lengths.sum()) + np.repeat(start - (np.cumsum(lengths) - lengths), lengths)
    d1, d2 = (_digest(words.hash[held], lengths, base) for base in _BASES)
    own = text[start]
    after = np.minimum(stop, n - 1)
    ends = np.where((stop < n) & (text[after] == own), words.start[after], offsets[own + 1])
    base = char[offsets[own]]
    return own, char[words.start[start]] - base, char[ends] - base, lengths, d1, d2


def _units(min_words: int, min_line_words: int, runs: bool, across_lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in blocks(batch.column("_text")):
                text, start, end, n, d1, d2 = find_units(data, offsets, min_words, min_line_words, runs, across_lines)
                rows = pa.array(text + lo)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(rows),
                        batch.column("_th").take(rows),
                        *(pa.array(x.astype(np.int32)) for x in (start, end, n)),
                        pa.array(d1.view(np.int64)),
                        pa.array(d2.view(np.int64)),
                    ],
                    ["doc_id", "_th", "start", "end", "n_words", "d1", "d2"],
                )

    return run


def repeated_units(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_line_words: int | None = None,
    runs: bool = False,
    across_lines: bool = False,
) -> DataFrame:
    """One row per unit to cut: doc_id, _th, start, end (characters of the original text), n_words, kept_doc_id, kept_start.

    Sentences of fewer than ``min_words`` words and lines of fewer than ``min_line_words`` (``min_words`` if None) stay, but with
    ``runs`` the shorter sentences of a repeated passage go with it: cuts may then overlap. ``across_lines`` counts runs over
    line ends, and texts of fewer than ``min_words`` words as wholes. Null, empty and wordless texts have no units. A null id ranks behind all
    ids. Rows equal in id and text are one document: its units are no repeats of themselves, and each row lists the same
    cuts. An empty table gives no rows. Other columns are not read.
    """
    named = docs.select(F.col(id_column).cast("long").alias("doc_id"), text_hash(text_column).alias("_th"), F.col(text_column).alias("_text"))
    units = written(named.mapInArrow(_units(min_words, min_words if min_line_words is None else min_line_words, runs, across_lines), UNIT_SCHEMA))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th", "start")
    firsts = written(
        units.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("_n"), F.min(rank).alias("_first")).where("_n > 1").drop("_n")
    )
    return (
        units.join(firsts.hint("merge"), ["d1", "d2"])
        .where(rank != F.col("_first"))
        .select("doc_id", "_th", "start", "end", "n_words", F.col("_first.doc_id").alias("kept_doc_id"), F.col("_first.start").alias("kept_start"))
    )


def _cut(text_column: str, cuts_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [x for x in batch.schema.names if x != cuts_name]
            cuts = batch.column(cuts_name)
            texts = batch.column(text_column)
            if cuts.null_count < len(cuts):
                changed = texts.to_pylist()
                for row in np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False)).tolist():
                    text, kept, at = changed[row], [], 0
                    for span in sorted((s["start"], s["end"]) for s in cuts[row].as_py()):
                        if span[0] > at:
                            kept.append(text[at : span[0]])
                        at = max(at, span[1])
                    changed[row] = "".join([*kept, text[at:]])
                texts = pa.array(changed, texts.type)
            yield pa.RecordBatch.from_arrays([texts if x == text_column else batch.column(x) for x in names], names)

    return run


def without_repeats(
    docs: DataFrame,
    min_words: int = MIN_WORDS,
    id_column: str = "doc_id",
    text_column: str = "text",
    min_line_words: int | None = None,
    runs: bool = False,
    across_lines: bool = False,
) -> DataFrame:
    """The documents, all columns kept, with the repeated units cut from their texts. A text of repeats only becomes empty."""
    id_name, hash_name, cuts_name = (unused(docs, x) for x in ("_cut_id", "_cut_th", "_cuts"))
    cuts = (
        repeated_units(docs, min_words, id_column, text_column, min_line_words, runs, across_lines)
        .groupBy("doc_id", "_th")
        .agg(F.collect_set(F.struct("start", "end")).alias(cuts_name))
        .select(F.col("doc_id").alias(id_name), F.col("_th").alias(hash_name), cuts_name)
    )
    same = F.col(id_column).cast("long").eqNullSafe(F.col(id_name)) & (text_hash(text_column) == F.col(hash_name))
    marked = docs.join(cuts, same, "left").drop(id_name, hash_name)
    return marked.mapInArrow(_cut(text_column, cuts_name), docs.schema)
