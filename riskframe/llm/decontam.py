"""Benchmark decontamination by template canonicalisation.

Texts become sequences of tokens (letters and digits, A-Z and the capitals of Latin-1 in lower case) in which numbers, names and units are replaced by
typed placeholders, so a question asked with other numbers and names has the same template. Windows of template tokens are
hash-joined with those of the benchmark items. Along each alignment of a document with an item the slots are then checked:
each value of the item must stand for one value of the document (two values of the item may become one). Where one stands for
several, a long run of the alignment without such a clash still counts. Beside these windows, windows of the plain tokens,
without placeholders, are joined in the same way: they do not depend on letter case and hold for any part copied word for word.

* number: a token that starts with a digit; digits joined by one point or comma are one number.
* unit: a token of ``UNITS`` right after a number.
* name: a capitalised token that is not one of ``OPENERS``. Words all in capitals are ordinary words.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import rows_by_key, small_side, text_hash, written
from riskframe.llm.textvec import MARKS, blocks, byte_table, find_words, mix

WINDOW = 8
MATCHED_TOKENS = 13
RUN_TOKENS = 2 * MATCHED_TOKENS
PLAIN_SEED = 1 << 20  # keys of plain windows differ from those of template windows
MIN_ITEM_TOKENS = 5
FILTER_LIMIT = 2_000_000

UNITS = (
    "mm cm dm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonnes ounce ounces "
    "pound pounds ml l liter liters litre litres gallon gallons meter meters metre metres kilometer kilometers kilometre kilometres "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros usd eur "
    "percent degree degrees celsius fahrenheit kelvin watt watts kw volt volts joule joules hz khz mhz ghz kb mb gb tb byte bytes "
    "mph kmh kph acre acres hectare hectares"
).split()
OPENERS = (
    "a after all an and are as at before but by can did do does each every find for from given had has have he her his how i if in is it "
    "its let many my no not of on one or our she so some suppose that the their then there these they this those to two was we were what "
    "when where which who whose why will with would you your el la los las un una de que y en der die das ein eine und ist le les une et du"
).split()

_TABLE = byte_table(MARKS)
_STEP = np.uint64(0x9FB21C651E98DF25)
_NUMBER, _NAME, _UNIT = (np.uint64(x) for x in (0x6E756D, 0x6E616D65, 0x756E6974))


def _word_hashes(words: list[str]) -> np.ndarray:
    joined = " ".join(words).encode()
    return np.sort(find_words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), _TABLE).hash)


_UNIT_HASHES, _OPENER_HASHES = _word_hashes(UNITS), _word_hashes(OPENERS)


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def _folded(data: np.ndarray) -> np.ndarray:
    """The bytes with the capitals of Latin-1 (two bytes each) in lower case."""
    low = data.copy()
    capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[1:][capital] += 0x20
    return low


def template(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, value, is_slot, bounds) of the block's template tokens: what windows compare, what stands in a slot."""
    words = find_words(_folded(data), offsets, _TABLE)
    n = len(words.start)
    if not n:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, bool), words.bounds
    lead = data[words.start]
    after = data[np.minimum(words.start + 1, len(data) - 1)]
    long_ = words.end - words.start > 1
    number = (lead >= 48) & (lead <= 57)
    text = words.text
    follows = np.zeros(n, bool)
    follows[1:] = text[1:] == text[:-1]
    joint = np.zeros(n, bool)
    between = data[np.minimum(words.end[:-1], len(data) - 1)]
    joint[1:] = follows[1:] & number[1:] & number[:-1] & (words.start[1:] - words.end[:-1] == 1) & ((between == 46) | (between == 44))
    latin = (lead == 0xC3) & (after >= 0x80) & (after <= 0x9E)
    small = ((after >= 97) & (after <= 122)) | (after >= 0x80)
    name = (((lead >= 65) & (lead <= 90) & long_ & small) | latin) & ~among(words.hash, _OPENER_HASHES)
    unit = np.zeros(n, bool)
    unit[1:] = follows[1:] & number[:-1]
    unit &= among(words.hash, _UNIT_HASHES) & ~number
    code = np.where(number, _NUMBER, np.where(unit, _UNIT, np.where(name, _NAME, words.hash)))
    value = words.hash.copy()
    for at in np.flatnonzero(joint).tolist():  # a number in parts: its value is that of all parts, held by the first
        first = at
        while joint[first]:
            first -= 1
        value[first] = mix(value[first : first + 1] * _STEP + words.hash[at])[0]
    keep = ~joint
    bounds = np.concatenate([[0], np.cumsum(keep)])[words.bounds]
    return code[keep], value[keep], (number | unit | name)[keep], bounds


def _windows(size: int, code: np.ndarray, slot: np.ndarray, bounds: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the block's windows of ``size`` tokens of one text, at least half of them words."""
    n = len(code) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    slots = np.concatenate([[0], np.cumsum(slot)])
    start = np.flatnonzero((text[:n] == text[size - 1 :]) & (2 * (slots[size:] - slots[:n]) <= size))
    key = np.full(n, seed + size, np.uint64)
    for i in range(size):
        key = mix(key * _STEP + code[i : i + n])
    return start, key[start]


HIT_SCHEMA = "doc_id long, _th long, n_tokens int, place int, key long, size int, plain boolean, slots array<long>, at array<int>"


def _hits(sizes: list[int] | None, wanted: np.ndarray | None):
    """Windows of each text. ``sizes`` None: of the one size that fits the text; ``wanted``: only those keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column("_text")):
                code, value, slot, bounds = template(data, offsets)
                counts = np.diff(bounds)
                used = sizes or sorted({min(WINDOW, c) for c in counts.tolist() if c >= MIN_ITEM_TOKENS})
                forms = ((False, code, slot), (True, value, np.zeros(len(slot), bool)))
                for size, (plain, code, slot) in product(used, forms):
                    start, key = _windows(size, code, slot, bounds, PLAIN_SEED if plain else 0)
                    row = np.searchsorted(bounds, start, "right") - 1
                    if sizes is None:
                        fit = np.minimum(counts[row], WINDOW) == size
                        start, key, row = start[fit], key[fit], row[fit]
                    if wanted is not None:
                        found = among(key, wanted)
                        start, key, row = start[found], key[found], row[found]
                    for cut in range(0, len(start), 20_000):
                        s, k, r = (x[cut : cut + 20_000] for x in (start, key, row))
                        inside = s[:, None] + np.arange(size)
                        held = slot[inside]
                        ends = np.concatenate([[0], np.cumsum(held.sum(axis=1))]).astype(np.int32)
                        rows = pa.array(r + lo)
                        yield pa.RecordBatch.from_arrays(
                            [
                                batch.column("doc_id").take(rows),
                                batch.column("_th").take(rows),
                                pa.array(counts[r].astype(np.int32)),
                                pa.array((s - bounds[r]).astype(np.int32)),
                                pa.array(k.view(np.int64)),
                                pa.array(np.full(len(s), size, np.int32)),
                                pa.array(np.full(len(s), plain)),
                                pa.ListArray.from_arrays(pa.array(ends), pa.array(value[inside][held].view(np.int64))),
                                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.broadcast_to(np.arange(size, dtype=np.int32), held.shape)[held])),
                            ],
                            ["doc_id", "_th", "n_tokens", "place", "key", "size", "plain", "slots", "at"],
                        )

    return run


def longest_run(covered: list[int], pairs: list[tuple[int, int, int]]) -> tuple[int, int]:
    """(tokens, first of them) of the longest run in which each item value stands for one document value. ``covered`` are the
    item's matched places in order, ``pairs`` the slots among them: place, item value, document value."""
    seen: dict[int, tuple[int, int]] = {}
    low, best = 0, (0, 0)

    def close(end: int) -> None:
        nonlocal best
        first = bisect_left(covered, low)
        best = max(best, (bisect_left(covered, end) - first, -first))

    for place, item, doc in sorted(pairs):
        if item in seen and seen[item][0] != doc and seen[item][1] >= low:
            close(place)
            low = seen[item][1] + 1
        seen[item] = (doc, place)
    close(covered[-1] + 1)
    return best[0], covered[-best[1]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Alignments with a clash (those with ``_pairs``) get the tokens and the first token of their longest run."""
    for batch in batches:
        names = batch.schema.names
        tokens, first = (batch.column(x).to_pylist() for x in ("matched_tokens", "first_token"))
        for row in np.flatnonzero(batch.column("_pairs").is_valid().to_numpy(zero_copy_only=False)).tolist():
            places, pairs, size, line = (batch.column(x)[row].as_py() for x in ("_places", "_pairs", "_size", "_line"))
            covered = sorted({p + i for p in places for i in range(size)})
            tokens[row], at = longest_run(covered, [(z["p"], z["i"], z["d"]) for z in pairs])
            first[row] = line + at
        changed = {"matched_tokens": pa.array(tokens, pa.int32()), "first_token": pa.array(first, pa.int32())}
        yield pa.RecordBatch.from_arrays([changed.get(x, batch.column(x)) for x in names if x not in INNER], [x for x in names if x not in INNER])


INNER = ("_places", "_pairs", "_size", "_line")
JUDGED = "doc_id long, _th long, item_id long, item_tokens int, first_token int, matched_tokens int, exact boolean, _consistent boolean"


def _named(rows: DataFrame, id_column: str, text_column: str) -> DataFrame:
    return rows.select(
        F.col(id_column).cast("long").alias("doc_id"), text_hash(text_column).alias("_th"), F.col(text_column).alias("_text")
    )


def contaminated_pairs(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
) -> DataFrame:
    """One row per document and item that it holds: doc_id, _th, item_id, matched_tokens, item_tokens, first_token, exact.

    A pair is reported if along one alignment windows with consistent slots cover ``MATCHED_TOKENS`` tokens of the item, or
    all tokens of a shorter one; ``exact`` says that all slots hold the item's own values, or that all tokens are the item's
    apart from letter case. An alignment with a clash of slots counts by its longest run without one, from ``RUN_TOKENS``
    tokens. Windows of plain tokens count like those with placeholders, each kind for itself. Items of one template and
    equal slots are one item, with the smallest id; with other slots each is judged by its own. Windows have ``WINDOW`` tokens (or all of a shorter item's), those with placeholders at least half
    of them words.

    Null and empty texts have no tokens and match nothing, on either side; items of fewer than ``MIN_ITEM_TOKENS`` tokens
    match nothing. Null ids are kept as ids. Rows equal in id and text are one document.
    Empty tables give no rows. Other columns are not read.

    Windows of documents are looked up in the benchmark's keys before they leave their task while there are at most
    ``FILTER_LIMIT`` of these (counted); beyond it all windows go into the same join.
    """
    bench = written(_named(items, item_id_column, item_text_column).mapInArrow(_hits(None, None), HIT_SCHEMA))
    whole = (
        bench.groupBy("doc_id", "_th", "n_tokens")
        .agg(F.xxhash64(F.array_sort(F.collect_list(F.struct("place", "key", "slots")))).alias("_h"), F.sum(F.col("key") % (1 << 40)).alias("_s"))
    )
    leads = whole.groupBy("_h", "_s", "n_tokens").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_th")).alias("_l"))
    leads = leads.select(F.col("_l.doc_id").alias("_i"), F.col("_l._th").alias("_t")).distinct()
    chosen = written(
        bench.join(leads, F.col("doc_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")))
        .select(
            F.col("doc_id").alias("item_id"), F.col("_th").alias("_ith"), F.col("n_tokens").alias("item_tokens"), F.col("place").alias("_ip"),
            "key", "size", "plain", F.col("slots").alias("_is"),
        )
        .distinct()
    )
    keys = chosen.select("key", "size").distinct()
    n_keys = keys.count()
    sizes = sorted(r[0] for r in keys.select("size").distinct().collect())  # at most WINDOW of them
    wanted = None
    if n_keys <= FILTER_LIMIT:
        wanted = np.sort(keys.select("key").toArrow().column("key").to_numpy().view(np.uint64))
    if not sizes:
        sizes = [WINDOW]
    hits = _named(docs, id_column, text_column).mapInArrow(_hits(sizes, wanted), HIT_SCHEMA).drop("n_tokens", "plain")
    met = hits.join(small_side(chosen), ["key", "size"])
    slots = F.transform(
        F.arrays_zip("at", "_is", "slots"), lambda z: F.struct((z["at"] + F.col("_ip")).alias("p"), z["_is"].alias("i"), z["slots"].alias("d"))
    )
    lined = met.groupBy("doc_id", "_th", "item_id", "_ith", "item_tokens", "plain", (F.col("place") - F.col("_ip")).alias("_line")).agg(
        F.array_sort(F.collect_set("_ip")).alias("_places"),
        F.array_distinct(F.flatten(F.collect_set(slots))).alias("_pairs"),
        F.max("size").alias("_size"),
        F.min("place").alias("first_token"),
    )

    covered = F.aggregate(
        "_places",
        F.struct(F.lit(0).alias("covered"), F.lit(-1).alias("end")),
        lambda s, p: F.struct(
            (s["covered"] + p + F.col("_size") - F.greatest(s["end"], p)).alias("covered"), (p + F.col("_size")).alias("end")
        ),
        lambda s: s["covered"],
    )
    values = F.array_distinct(F.transform("_pairs", lambda z: F.struct(z["i"], z["d"])))
    one = F.size(values) == F.size(F.array_distinct(F.transform("_pairs", lambda z: z["i"])))
    own = F.when(F.col("plain"), F.col("matched_tokens") == F.col("item_tokens")).otherwise(F.forall("_pairs", lambda z: z["i"] == z["d"]))
    least = F.least(F.col("item_tokens"), F.lit(MATCHED_TOKENS))
    judged = (
        lined.withColumns({"_consistent": one, "matched_tokens": covered})
        .withColumn("exact", own)
        .where(F.col("matched_tokens") >= F.when(F.col("_consistent"), least).otherwise(RUN_TOKENS))
        .select(
            "doc_id", "_th", "item_id", "item_tokens", "first_token", "matched_tokens", "exact", "_consistent", "_line", "_size",
            F.when(~F.col("_consistent"), F.col("_places")).alias("_places"), F.when(~F.col("_consistent"), F.col("_pairs")).alias("_pairs"),
        )
        .mapInArrow(_runs, JUDGED)
        .where(F.col("_consistent") | (F.col("matched_tokens") >= RUN_TOKENS))
    )
    best = F.max(F.struct("exact", "matched_tokens", -F.col("first_token"))).alias("_b")
    return (
        judged.groupBy("doc_id", "_th", "item_id", "item_tokens")
        .agg(best)
        .select(
            "doc_id", "_th", "item_id", F.col("_b.matched_tokens").cast("long").alias("matched_tokens"), F.col("item_tokens").cast("long").alias("item_tokens"),
            (-F.col("_b.col3")).cast("long").alias("first_token"), F.col("_b.exact").alias("exact"),
        )
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents, all columns kept, that hold no benchmark item."""
    return rows_by_key(docs, contaminated_pairs(docs, items, id_column, text_column), "left_anti", id_column, text_column)
