"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``HALVES`` half keys are taken from a document's shingle set, each half key from ``ROWS`` minhashes.
Every pair (one half key of each collection) is the key of one table: HALVES ** 2 tables from 2 * HALVES * ROWS minhashes,
where plain banding would compute HALVES ** 2 * 2 * ROWS. With the defaults, two sets of similarity 0.8 meet in at least
one of the 144 tables with probability 0.9996, and in 38 on average.

Documents of equal sets are one class. Classes that share a key are candidates; links are confirmed on the full sets:

1. In each bucket every member is compared with the bucket's first member: first the pair with the first of all these
   leads, then those pairs that are not connected yet. This is linear in the bucket's size.
2. Members of buckets that then still hold several components are compared across components, block by block within
   tasks that return links only. Such buckets arise where sets are nearly similar enough, so they are few.

No pair within a component is looked at twice, so a large group of near copies costs about a pair for each copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import small_side, text_hash, written
from riskframe.llm.textvec import BLANK, blocks, byte_table, find_words, mix
from riskframe.operators.graph import connected_groups

HALVES = 12
ROWS = 3
SIMILARITY_PERCENT = 80
BLOCK = 512

_TABLE = byte_table(BLANK)
_GEN = np.random.Generator(np.random.PCG64(20240607))
_FACTORS = _GEN.integers(0, 1 << 63, 2 * HALVES * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _GEN.integers(0, 1 << 63, 2 * HALVES * ROWS, dtype=np.uint64)
_CUT = 2048

SKETCH_SCHEMA = "doc_id long, _th long, n_shingles long, set_id binary, first array<long>, second array<long>"


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than ``width`` is one shingle."""
    for _, _, data, offsets in blocks(column):
        words = find_words(data, offsets, _TABLE)
        rolled = words.hash
        for step in range(1, width):
            shifted = np.zeros_like(words.hash)
            shifted[: len(words.hash) - step] = words.hash[step:] if step < len(words.hash) else words.hash[:0]
            rolled = mix(rolled * np.uint64(0x9FB21C651E98DF25) + shifted)
        for lo, hi in zip(words.bounds[:-1], words.bounds[1:], strict=True):
            n = hi - lo
            if n >= width:
                yield np.unique(rolled[lo : hi - width + 1])
            elif n:
                whole = hashlib.blake2b(words.hash[lo:hi].tobytes(), digest_size=8).digest()
                yield np.frombuffer(whole, np.uint64).copy()
            else:
                yield np.zeros(0, np.uint64)


def half_keys(shingles: np.ndarray) -> np.ndarray:
    """The 2 * HALVES half keys of a set."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CUT):
        part = shingles[at : at + _CUT]
        np.minimum(least, (_FACTORS[:, None] * part + _SHIFTS[:, None]).min(axis=1), out=least)
    rows = least.reshape(2 * HALVES, ROWS)
    key = np.arange(2 * HALVES, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9FB21C651E98DF25) + rows[:, r])
    return key.view(np.int64)


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, first, second = [], [], [], []
            for shingles in shingle_sets(batch.column("_text"), width):
                sizes.append(len(shingles))
                if len(shingles):
                    keys = half_keys(shingles).tolist()
                    ids.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                    first.append(keys[:HALVES])
                    second.append(keys[HALVES:])
                else:
                    ids.append(None)
                    first.append(None)
                    second.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("_th"),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(first, pa.list_(pa.int64())),
                    pa.array(second, pa.list_(pa.int64())),
                ],
                ["doc_id", "_th", "n_shingles", "set_id", "first", "second"],
            )

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, at = batch.column("node"), 0
            held: list[np.ndarray] = []
            for shingles in shingle_sets(batch.column("_text"), width):
                held.append(shingles.view(np.int64))
                if sum(map(len, held[-64:])) > 1 << 18 or len(held) == 256:
                    yield _set_rows(node.slice(at, len(held)), held)
                    at, held = at + len(held), []
            if held:
                yield _set_rows(node.slice(at, len(held)), held)

    return run


def _set_rows(node: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [node, pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held)))], ["node", "shingles"]
    )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_sb"))
    common = F.size(F.array_intersect("_sa", "_sb")).cast("long")
    union = F.size("_sa") + F.size("_sb") - common
    return pairs.join(left, "a").join(right, "b").where(100 * common >= percent * union).select("a", "b")


def _grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components ``(node, component)`` after more links."""
    edges = links.select("a", "b")
    if labels is not None:
        edges = edges.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b")))
    return written(connected_groups(edges))


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs whose nodes are in different components so far."""
    la = labels.select(F.col("node").alias("a"), F.col("component").alias("_ca"))
    lb = labels.select(F.col("node").alias("b"), F.col("component").alias("_cb"))
    ca, cb = F.coalesce("_ca", "a"), F.coalesce("_cb", "b")
    return pairs.join(la, "a", "left").join(lb, "b", "left").where(ca != cb).drop("_ca", "_cb")


def _shared_halves(classes: DataFrame) -> DataFrame:
    """``(node, first, second)``: a class's half keys that another class has as well, of classes with such in both collections.

    Two classes share a table's key only if they share both of its halves, so no key that anybody shares is lost, and only
    kept halves are multiplied. A half key's number is mixed into it; its side keeps the collections apart."""
    sided = F.transform(F.flatten(F.array("first", "second")), lambda half, i: F.struct((i >= HALVES).alias("side"), half.alias("half")))
    held = classes.select("node", F.inline(sided))
    shared = held.groupBy("side", "half").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("side", "half")
    kept = held.join(shared, ["side", "half"], "left_semi").groupBy("node")
    both = kept.agg(*[F.collect_list(F.when(F.col("side") == side, F.col("half"))).alias(name) for name, side in (("first", False), ("second", True))])
    return written(both.where((F.size("first") > 0) & (F.size("second") > 0)))


def _near_sizes(n_a: str, n_b: str, percent: int):
    """Sets so different in size can't be similar enough."""
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = SIMILARITY_PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, _th (the text's hash), n_shingles, component_id, kept, keeper.

    Documents are linked if ``100 * |A & B| >= percent * |A | B|`` for their sets of distinct ``width``-word shingles
    (words between blanks, A-Z in lower case). ``component_id`` is the smallest id reachable, ``kept`` says whether it is
    the row's own; ``keeper`` marks one (id, text) of each component.

    A text with fewer words is one shingle. Null, empty and blank texts have no shingle and are linked with nothing. A null
    id is larger than all ids: its row is never kept unless its component has no id at all, when component_id is null and
    kept true. Rows equal in id and text share their row of results. An empty table gives no rows. Other columns are not read.
    """
    named = docs.select(F.col(id_column).alias("doc_id"), text_hash(text_column).alias("_th"), F.col(text_column).alias("_text"))
    rows = written(named.mapInArrow(_sketches(width), SKETCH_SCHEMA))

    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")
    classes = written(
        rows.where(F.col("set_id").isNotNull())
        .groupBy("set_id")
        .agg(
            F.min(order).alias("lead"),
            F.first("n_shingles").alias("n"),
            F.first("first").alias("first"),
            F.first("second").alias("second"),
        )
        .select(F.monotonically_increasing_id().alias("node"), "*")
    )
    halves = _shared_halves(classes)
    keys = (
        halves.select("node", F.explode("first").alias("_a"), "second")
        .select("node", "_a", F.explode("second").alias("_b"))
        .select("node", F.xxhash64("_a", "_b").alias("key"))
    )
    buckets = written(
        keys.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("_last")).where("b <> _last").select("key", "b")
    )
    members = written(keys.join(small_side(buckets), "key").select("key", F.col("node").alias("a"), "b"))
    sizes = classes.select("node", "n")
    pairs = written(
        members.where("a <> b")
        .select("a", "b")
        .distinct()
        .join(sizes.select(F.col("node").alias("a"), F.col("n").alias("_na")), "a")
        .join(sizes.select(F.col("node").alias("b"), F.col("n").alias("_nb")), "b")
        .where(_near_sizes("_na", "_nb", percent))
        .select("a", "b")
    )

    # The sets of the classes in question, from the whole text of one document of each.
    asked = members.select(F.col("a").alias("node")).distinct()
    wanted = written(
        classes.join(asked, "node").select("node", F.col("lead.doc_id").alias("_id"), F.col("lead._th").alias("_hash"))
    )
    at_lead = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_th") == F.col("_hash"))
    sets = written(
        named.join(small_side(wanted), at_lead)
        .select("node", "_text")
        .mapInArrow(_sets(width), "node long, shingles array<long>")
        .groupBy("node")
        .agg(F.first("shingles").alias("shingles"))
    )

    nearest = pairs.groupBy("a").agg(F.min("b").alias("b"))
    labels = _grown(None, written(_confirmed(nearest, sets, percent)))
    rest = _apart(pairs.join(nearest, ["a", "b"], "left_anti"), labels)
    links = written(_confirmed(rest, sets, percent))
    if not links.isEmpty():
        labels = _grown(labels, links)

    links = written(_across(members, classes, labels, sets, percent))
    if not links.isEmpty():
        labels = _grown(labels, links)

    grouped = classes.join(labels, "node", "left").select(
        "set_id", "lead", F.coalesce("component", "node").alias("_component")
    )
    leads = grouped.groupBy("_component").agg(F.min("lead").alias("_lead"))
    named_sets = grouped.join(leads, "_component").select("set_id", "_lead")
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")
    joined = rows.select("doc_id", "_th", "n_shingles", "set_id").join(named_sets, "set_id", "left")
    lead = F.coalesce("_lead", own)
    return joined.select(
        "doc_id",
        "_th",
        "n_shingles",
        lead["doc_id"].alias("component_id"),
        F.col("doc_id").eqNullSafe(lead["doc_id"]).alias("kept"),
        (F.col("doc_id").eqNullSafe(lead["doc_id"]) & (F.col("_th") == lead["_th"])).alias("keeper"),
    )


def _across(members: DataFrame, classes: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``(a, b)`` between components that meet in a bucket of three members or more (pairs with the first member are
    known). Members of such buckets are grouped by the half keys of the first collection, which any two of one bucket have
    in common; a group is cut into blocks of ``BLOCK`` members, and two blocks at a time are compared within a task, which
    returns links only."""
    marked = members.join(labels.select(F.col("node").alias("a"), "component"), "a", "left").select(
        "key", "a", F.coalesce("component", "a").alias("_c")
    )
    mixed = (
        marked.groupBy("key")
        .agg(F.min("_c").alias("_low"), F.max("_c").alias("_high"), F.count(F.lit(1)).alias("_n"))
        .where("_low <> _high and _n > 2")
    )
    open_ = written(
        marked.join(mixed.select("key"), "key", "left_semi")
        .select(F.col("a").alias("node"), "_c")
        .distinct()
        .join(classes.select("node", "first"), "node")
        .select("node", "_c", F.explode("first").alias("half"))
    )
    groups = written(
        open_.groupBy("half")
        .agg(F.min("_c").alias("_low"), F.max("_c").alias("_high"), F.count(F.lit(1)).alias("_n"))
        .where("_low <> _high")
        .select("half", F.ceil(F.col("_n") / BLOCK).cast("int").alias("blocks"))
    )
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = (
        open_.join(small_side(groups), "half")
        .select("half", "node", "_c", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select("half", "node", "_c", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )
    return dealt.join(sets, "node").groupBy("half", "low", "high").applyInArrow(_block_links(percent), "a long, b long").distinct()


def _block_links(percent: int):
    def run(table: pa.Table) -> pa.Table:
        node, comp, own = (table.column(x).to_numpy() for x in ("node", "_c", "own"))
        low, high = table.column("low")[0].as_py(), table.column("high")[0].as_py()
        names, comp_at = np.unique(comp, return_inverse=True)
        links: list[tuple[int, int]] = []
        if len(names) > 1:
            lists = table.column("shingles").combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            _, token, seen = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
            shared = seen > 1
            column = (np.cumsum(shared) - 1)[token]
            row = np.repeat(np.arange(len(node)), sizes)
            kept = shared[token]
            row, column = row[kept], column[kept]
            top = np.bincount(comp_at).argmax()
            left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
            for x, y in ((left[comp_at[left] != top], right), (left[comp_at[left] == top], right[comp_at[right] != top])):
                if not len(x) or not len(y):
                    continue
                common = _common(row, column, x, y, len(node))
                union = sizes[x][:, None] + sizes[y][None, :] - common
                near = (100 * common >= percent * union) & (comp_at[x][:, None] != comp_at[y][None, :])
                at = np.argwhere(near)
                # One link to each other component is enough: components are connected in themselves.
                _, first = np.unique(at[:, 0] * len(names) + comp_at[y][at[:, 1]], return_index=True)
                links += [(int(node[x[i]]), int(node[y[j]])) for i, j in at[first]]
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return run


def _common(row: np.ndarray, column: np.ndarray, x: np.ndarray, y: np.ndarray, rows: int, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of sets x with sets y."""
    total = np.zeros((len(x), len(y)), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    place_x, place_y = np.full(rows, -1), np.full(rows, -1)
    place_x[x], place_y[y] = np.arange(len(x)), np.arange(len(y))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        r, c = row[lo:hi], column[lo:hi] - at
        held = []
        for place, n in ((place_x, len(x)), (place_y, len(y))):
            own = place[r] >= 0
            held.append(np.zeros((n, width), np.float32))
            held[-1][place[r[own]], c[own]] = 1
        total += (held[0] @ held[1].T).astype(np.int64)
    return total
