"""A Merkle manifest of a dataset, rolled up in nested structs.

Leaves are ranked within their key (the language). A rank's binary digits are columns; they are grouped away one after the
other, lowest first, and each grouping nests the (at most two) child structs of a node under its hash. All groupings of a
block of ``2 ** DIGITS`` ranks run on one partitioning by (key, block), so a block is the largest thing ever nested. Block roots are
nodes of the next round, until each key has one block; the roots of the keys are rolled up in the same way.

Proofs come back down the same trees: a block's row takes the siblings above it (a union grouped by block brings them, one
row for each block), and its children are exploded level by level, each with its sibling put before those above.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.llm.common import written
from riskframe.llm.ranks import ranked

DIGITS = 8
STEP = "array<struct<left: string, right: string>>"


def field(value: Column | str) -> Column:
    """A value as hashed: ``-`` for null, else its UTF-8 byte count, a colon and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def _levels(n: Column) -> Column:
    """How often runs of two are hashed until one of n nodes remains."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0)


def _trees(nodes: DataFrame) -> DataFrame:
    """``nodes(key, rank, n, hash, item)`` as one row per block: key, n, block, hash, kids."""
    digits = [f"d{level}" for level in range(DIGITS)]
    df = nodes.select(
        "key",
        "n",
        F.shiftright("rank", DIGITS).alias("block"),
        *[F.shiftright("rank", level).bitwiseAND(F.lit(1)).cast("int").alias(d) for level, d in enumerate(digits)],
        "hash",
        F.col("item").alias("kids"),
    ).repartition("key", "block")
    for level, digit in enumerate(digits):
        nested = F.array_sort(F.collect_list(F.struct(F.col(digit).alias("digit"), "hash", "kids")))
        hashes = F.col("kids.hash")
        df = (
            df.groupBy("key", "n", "block", *digits[level + 1 :])
            .agg(nested.alias("kids"))
            .withColumn("hash", F.when(_levels(F.col("n")) > level, F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0]))
        )
    return df.select("key", "n", "block", "hash", "kids")


def _down(blocks: DataFrame) -> DataFrame:
    """``blocks(key, n, kids, path, tops)`` as one row per node: key, hash, item, path, tops."""

    def with_sibling(kids: Column) -> Column:
        def beside(kid: Column, i: Column) -> Column:
            left = F.when(i == 1, kids[0]["hash"]).otherwise("")
            right = F.when((i == 0) & (F.size(kids) == 2), F.get(kids, F.lit(1))["hash"]).otherwise("")
            return F.struct(kid.alias("kid"), F.struct(left.alias("left"), right.alias("right")).alias("step"))

        return F.transform(kids, beside)

    df = blocks.select("key", "n", "kids", "path", "tops")
    for level in reversed(range(DIGITS)):
        longer = F.when(_levels(F.col("n")) > level, F.concat(F.array("_node.step"), "path")).otherwise(F.col("path"))
        df = df.select("key", "n", "path", "tops", F.explode(with_sibling(F.col("kids"))).alias("_node")).select(
            "key", "n", longer.alias("path"), "tops", F.col("_node.kid.hash").alias("hash"), F.col("_node.kid.kids").alias("kids")
        )
    return df.select("key", "hash", F.col("kids").alias("item"), "path", "tops")


def with_paths(nodes: DataFrame, above_roots: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Every node with its siblings up to the top: key, hash, item, path, tops.

    ``nodes(key, rank, n, hash, item)`` are ranked within their key. ``above_roots`` takes the roots ``(key, hash)`` and returns
    ``(key, path, tops)``: the siblings above each and the hashes it is part of, itself first. Path entries go from the node
    upwards and hold the siblings on the left and on the right, empty where a run has no other.
    """
    trees = written(_trees(nodes))
    roots = trees.select("key", "n", "block", "hash")
    if roots.where(F.col("n") > 1 << DIGITS).isEmpty():
        above = above_roots(roots.select("key", "hash")).withColumn("block", F.lit(0).cast("long"))
    else:
        blocks = F.shiftright(F.col("n") - 1, DIGITS) + 1
        upper = roots.select("key", F.col("block").alias("rank"), blocks.alias("n"), "hash", F.struct("block").alias("item"))
        above = with_paths(upper, above_roots).withColumn("block", F.col("item.block"))
    both = trees.select("key", "block", "n", "kids").unionByName(above.select("key", "block", "path", "tops"), allowMissingColumns=True)
    merged = both.groupBy("key", "block").agg(*[F.first(x, ignorenulls=True).alias(x) for x in ("n", "kids", "path", "tops")])
    return _down(merged)


def _top(roots: DataFrame) -> DataFrame:
    return roots.select("key", F.array().cast(STEP).alias("path"), F.array("hash").alias("tops"))


def _over_keys(roots: DataFrame) -> DataFrame:
    """The roots of all keys, in the order of the keys (null first, by bytes), under one root."""
    rows = written(roots.select(F.lit(0).alias("group"), F.struct(F.col("key")).alias("item"), "hash", "key"))
    nodes = ranked(rows, "group", ["key"]).select(F.col("group").alias("key"), "rank", "n", "hash", "item")
    found = with_paths(nodes, _top)
    return found.select(F.col("item.key").alias("key"), "path", F.concat(F.array("hash"), "tops").alias("tops"))


def dataset_proofs(leaves: DataFrame) -> DataFrame:
    """One row per leaf of ``leaves(key, id, leaf, extra)``: key, id, leaf, extra, subroot, root, path (see ``with_paths``).

    Leaves of a key ascend by id (null first), then by hash. Repeated rows are leaves of their own. An empty table gives no rows.
    """
    rows = written(leaves.withColumn("_copy", F.monotonically_increasing_id()))
    nodes = ranked(rows, "key", ["id", "leaf", "_copy"]).select(
        "key", "rank", "n", F.col("leaf").alias("hash"), F.struct("id", "extra").alias("item")
    )
    found = with_paths(nodes, _over_keys)
    return found.select(
        "key",
        F.col("item.id").alias("id"),
        F.col("hash").alias("leaf"),
        F.col("item.extra").alias("extra"),
        F.col("tops")[0].alias("subroot"),
        F.col("tops")[1].alias("root"),
        "path",
    )


def folded(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and its siblings give."""
    start = F.col(leaf) if isinstance(leaf, str) else leaf
    return F.aggregate(path, start, lambda acc, step: F.sha2(F.concat(step["left"], acc, step["right"]), 256))


def siblings(path: Column | str) -> Column:
    """All siblings, level by level from the leaf, left to right."""
    return F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), "")


def document_manifest(docs: DataFrame, every: int = 7) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    A leaf is the hash of doc_id, source, lang, n_chars and text (see ``field``). ``folded_root`` is recomputed from the
    original siblings and the leaf as it is read again: documents whose id's CRC-32 ``every`` divides are then tampered
    with, by one more in n_chars. ``verified`` says whether it is the root.

    Nulls are ``-`` in leaves; a null id ranks first and is not tampered with, nor is a null n_chars. Empty texts are ``0:``.
    Equal ids are ordered by leaf; repeated rows are leaves of their own. An empty table gives no rows. Other columns are not read.
    """
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    struck = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % every == 0) & F.col("n_chars").isNotNull()
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    leaf = digest(*[field(x) for x in fields])
    tampered = digest(*[field(more if x == "n_chars" else x) for x in fields])
    leaves = docs.select(
        F.col("lang").cast("string").alias("key"), F.col("doc_id").alias("id"), leaf.alias("leaf"), F.when(struck, tampered).alias("extra")
    )
    rows = dataset_proofs(leaves).withColumn("folded_root", folded(F.coalesce("extra", "leaf"), "path"))
    return rows.select(
        F.col("id").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        F.sha2(siblings("path"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
