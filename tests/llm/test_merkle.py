import hashlib
import zlib

import pytest

from riskframe.llm.merkle import dataset_proofs, document_manifest, folded, siblings
from riskframe.llm.ranks import ranked
from riskframe.llm.common import written


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h(*last[i : i + 2]) for i in range(0, len(last), 2)])
    return out


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def expected(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by plain trees."""
    groups = {}
    for doc_id, text, lang, source, n in rows:
        leaf = h(*map(field, (doc_id, source, lang, n, text)))
        struck = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        again = h(*map(field, (doc_id, source, lang, n + 1, text))) if struck else leaf
        groups.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, doc_id, again))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {lang: levels([leaf for _, _, leaf, *_ in sorted(groups[lang])]) for lang in order}
    top = levels([trees[lang][-1][0] for lang in order])
    out = []
    for at, lang in enumerate(order):
        for i, (_, _, leaf, doc_id, again) in enumerate(sorted(groups[lang])):
            proof, now = [], again
            for place, tree in ((i, trees[lang]), (at, top)):
                for row in tree[:-1]:
                    other = row[place ^ 1] if place ^ 1 < len(row) else ""
                    proof.append(other)
                    now = h(other, now) if place & 1 else h(now, other)
                    place >>= 1
            out.append((doc_id, leaf, trees[lang][-1][0], top[-1][0], h(*proof), now, now == top[-1][0]))
    return sorted(out, key=repr)


def manifest(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string, key string, item string, path string"
    frame = spark.createDataFrame([(*r, *["x"] * 4) for r in rows], schema)
    return sorted((tuple(r) for r in document_manifest(frame).collect()), key=repr)


@pytest.mark.parametrize("n", [1, 2, 3, 255, 257, 600])
def test_trees_of_many_sizes(spark, n):
    rows = [(i * 3, f"text {i} é", "en", "s", i) for i in range(n)]
    assert manifest(spark, rows) == expected(rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(i, f"t{i}", ("en", "de", None, "", "é", "zz")[i % 6], None if i % 4 else "a", None if i % 5 == 0 else i) for i in range(40)]
    rows += [rows[3]] * 5 + [(None, None, "en", None, None), (None, "", None, "", 0), (7, "other", "de", "b", 2**63 - 1), (3, "x" * 100_000, "en", "s", 1)]
    got = manifest(spark, rows)
    assert got == expected(rows)
    assert {r[-1] for r in got} == {True, False}


def test_empty_and_one_root(spark):
    assert manifest(spark, [(1, "a", "en", None, 1)][:0]) == []
    [row] = manifest(spark, [(1, "a", None, None, None)])
    assert row[1] == row[2] == row[3] == row[5] and row[4] == h() and row[6]


def test_proofs_fold_to_the_root(spark):
    leaves = spark.range(700).selectExpr("cast(id % 3 as string) as key", "id", "sha2(cast(id as string), 256) as leaf", "cast(null as string) as extra")
    proofs = dataset_proofs(leaves).select(folded("leaf", "path").alias("folded"), "root", siblings("path").alias("s")).collect()
    assert len(proofs) == 700 and all(r.folded == r.root for r in proofs) and len({r.root for r in proofs}) == 1


def test_ranks_across_ranges(spark, monkeypatch):
    import riskframe.llm.ranks as ranks

    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 50)
    rows = written(spark.range(1000).selectExpr("if(id % 3 = 0, null, id % 2) as key", "nullif(hash(id) % 100, 0) as v", "id as copy"))
    got = ranked(rows, "key", ["v", "copy"]).collect()
    groups = {}
    for r in got:
        groups.setdefault(r.key, []).append(r)
    for held in groups.values():
        held.sort(key=lambda r: (r.v is not None, r.v or 0, r.copy))
        assert [r["rank"] for r in held] == list(range(len(held))) and {r.n for r in held} == {len(held)}
