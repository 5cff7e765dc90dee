import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskframe.llm.pieces import BLANK_MARK, Block, Vocabulary, decode_ids, encode_samples
from riskframe.llm.q_pieces import MODEL
from riskframe.llm.textvec import text_bytes


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary.load(MODEL)


def all_segmentations(vocabulary, text):
    """Log probability of every segmentation, by enumeration."""
    known = {}
    for i in np.flatnonzero(np.isfinite(vocabulary.log_p)).tolist():
        known.setdefault(vocabulary.bytes[i].decode(), i)
    line = " " + text

    def rest(at):
        if at == len(line):
            return [((), 0.0)]
        out = []
        for end in range(at + 1, min(len(line), at + vocabulary.longest) + 1):
            if " " in line[at + 1 : end]:
                break
            i = known.get(line[at:end])
            if i is not None:
                out += [((i, *ids), vocabulary.log_p[i] + p) for ids, p in rest(end)]
            elif end == at + 1:
                raw = line[at:end].encode()
                out += [((*vocabulary.byte_ids[list(raw)].tolist(), *ids), len(raw) * vocabulary.log_byte + p) for ids, p in rest(end)]
        return out

    found = rest(0)
    total = np.logaddexp.reduce([p for _, p in found])
    return {ids: p - total for ids, p in found}


def sampled(vocabulary, texts, samples):
    data, offsets = text_bytes(pa.array(texts))
    block = Block(vocabulary, data, offsets, np.arange(1, len(texts) + 1, dtype=np.uint64))
    return [
        [(tuple(block.ids(vocabulary, edges)[0].tolist()), p, g) for edges, p, g in found[:-1]] + [found[-1][2]] for found in block.sampled(samples)
    ]


@pytest.mark.parametrize("text", ["the cats", "a ñ😀x"])
def test_distribution_without_replacement(vocabulary, text):
    exact = all_segmentations(vocabulary, text)
    n = 8000
    got = sampled(vocabulary, [text] * n, 3)
    first, second = Counter(x[0][0] for x in got), Counter(x[1][0] for x in got)
    p = {s: math.exp(v) for s, v in exact.items()}
    for s in p:
        twice = sum(p[o] * p[s] / (1 - p[o]) for o in p if o != s)
        assert abs(first[s] / n - p[s]) < 4 * math.sqrt(p[s] / n) + 1e-3
        assert abs(second[s] / n - twice) < 4 * math.sqrt(twice / n) + 1e-3
    for x in got:
        samples, threshold = x[:-1], x[-1]
        assert len({s for s, _, _ in samples}) == len(samples)
        assert all(abs(v - exact[s]) < 1e-6 for s, v, _ in samples)
        values = [g for _, _, g in samples] + [threshold]
        assert values == sorted(values, reverse=True)
    # Each segmentation, weighted by one over its inclusion probability, counts once on average.
    best = max(p, key=p.get)
    weight = np.mean([sum(1 / -math.expm1(-math.exp(v - x[-1])) for s, v, _ in x[:-1] if s == best) for x in got])
    assert abs(weight - 1) < 0.1


def test_all_segmentations_of_a_short_text(vocabulary):
    exact = all_segmentations(vocabulary, "ab")
    [found] = sampled(vocabulary, ["ab"], 50)
    assert {s for s, _, _ in found[:-1]} == set(exact) and found[-1] == -math.inf


def test_every_row_round_trips(documents, vocabulary):
    long = "thndthin and ou " * 20_000
    rows = [(1, "plain words"), (2, f"mark {chr(BLANK_MARK)} in text"), (3, "  two\n\n\tblanks  \r\n"), (4, "x" * 3000), (5, long), (6, "\x00😀ñ日本 the end"), (7, ""), (8, None), (None, "plain words"), (1, "plain words")]
    got = encode_samples(documents(rows), MODEL, samples=2).collect()
    assert all(r.round_trip for r in got)
    assert Counter((r.doc_id, r.sample) for r in got) == Counter({(i, s): 1 + (i == 1) for i in (1, 2, 3, 4, 5, 6, None) for s in (1, 2)} | {(7, 1): 1, (8, 1): 1})
    same = [tuple(r.ids) for r in got if r.doc_id == 1 and r.sample == 1]
    assert same[0] == same[1]
    texts = dict(rows)
    for r in got:
        assert vocabulary.decode(r.ids) == (texts[r.doc_id] or "") and r.n_pieces == len(r.ids)
        assert r.log_prob <= 0 and r.log_inclusion <= 0
    assert encode_samples(documents(rows).where("false"), MODEL).count() == 0


def test_samples_do_not_depend_on_blocks(vocabulary):
    texts = ["some words here", "other words there", "", "third text"]
    whole = sampled(vocabulary, texts, 3)
    for i, text in enumerate(texts):
        data, offsets = text_bytes(pa.array([text]))
        block = Block(vocabulary, data, offsets, np.array([i + 1], np.uint64))
        [alone] = block.sampled(3)
        assert [tuple(block.ids(vocabulary, e)[0].tolist()) for e, _, _ in alone[:-1]] == [x[0] for x in whole[i][:-1]]


def test_decoding(spark):
    rows = spark.createDataFrame([(1, [260, 5]), (2, None), (3, [])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in decode_ids(rows, MODEL).collect()}.keys() == {1, 2, 3}
    assert {r.k: r.decoded for r in decode_ids(rows, MODEL).collect()}[2] is None
