import random
import re

import numpy as np
import pyarrow as pa

from riskframe.llm.keepone import one_of_each_group
from riskframe.llm.neardup import _block_links, near_duplicates

from .conftest import LOW


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


def components(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= percent * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    return [min(rows[j][0] for j in range(len(rows)) if root(j) == root(i)) for i in range(len(rows))], [len(s) for s in sets]


def family(n, edits, seed=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(80)]
    out = []
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(80)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_against_all_pairs(documents):
    texts = family(120, 14) + family(3, 2, 9) + ["One word", "one  WORD", "word", "Word", "", "   ", None, "Ä b", "ä b", "x " * 3000]
    rows = list(enumerate(texts))
    random.Random(1).shuffle(rows)
    want, sizes = components(rows, 2, 80)
    got = {r.doc_id: r for r in near_duplicates(documents(rows), 2).collect()}
    assert len(got) == len(rows)
    for (doc_id, _), component, size in zip(rows, want, sizes, strict=True):
        assert (got[doc_id].n_shingles, got[doc_id].component_id, got[doc_id].kept) == (size, component, component == doc_id)


def test_one_stays_of_each_group(documents):
    copy = family(1, 2)[0]
    rows = [(5, copy), (3, copy + " end"), (3, copy + " end"), (None, copy), (9, None), (10, ""), (11, "")]
    got = one_of_each_group(documents(rows), 5)
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(3, copy + " end"), (9, None), (10, ""), (11, "")]
    assert got.columns == documents(rows).columns
    assert near_duplicates(documents(rows).where("false")).count() == 0


def test_null_ids_only(documents):
    got = near_duplicates(documents([(None, "a b c"), (None, "a b c")]), 2).collect()
    assert [(r.component_id, r.kept) for r in got] == [(None, True)] * 2


def test_blocks_find_all_links_between_components():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.choice(60, 40)) for _ in range(90)]
    comp = rng.integers(0, 4, 90)
    own = rng.integers(0, 2, 90)
    for low, high in ((0, 0), (0, 1)):
        pick = [i for i in range(90) if own[i] in (low, high)]
        table = pa.table(
            {
                "node": pa.array(pick), "_c": pa.array(comp[pick]), "own": pa.array(own[pick].astype(np.int32)),
                "low": pa.array([low] * len(pick)), "high": pa.array([high] * len(pick)), "shingles": pa.array([sets[i] for i in pick]),
            }
        )
        found = _block_links(60)(table).to_pylist()
        want = {
            (comp[i], comp[j])
            for i in pick for j in pick
            if comp[i] != comp[j] and own[i] == low and own[j] == high
            and 100 * len(np.intersect1d(sets[i], sets[j])) >= 60 * len(np.union1d(sets[i], sets[j]))
        }
        got = {(comp[r["a"]], comp[r["b"]]) for r in found}
        assert {frozenset(x) for x in got} == {frozenset(x) for x in want}
