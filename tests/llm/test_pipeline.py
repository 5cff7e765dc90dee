import corpus_pipeline
from riskframe.llm.common import written
from riskframe.llm.decontam import contaminated_pairs
from riskframe.llm.linededup import PASSAGE_WORDS
from riskframe.llm.pieces import decode_ids
from riskframe.llm.q_pieces import MODEL

from .test_linededup import expected
from .test_neardup import components

SF = "/root/testdata/sf0.001"


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "repeated lines", "benchmark", "pieces"]
    tables = []
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF))
        tables.append(docs)
    language, near, lines, benchmark, pieces = tables
    for table in tables[:-1]:
        assert table.columns == columns

    rows = [(r.doc_id, r.text) for r in language.collect()]
    assert 0.97 * 200 <= len(rows) <= 200
    smallest, _ = components(rows, 5, 80)
    assert sorted(r.doc_id for r in near.collect()) == sorted({doc_id for (doc_id, _), c in zip(rows, smallest, strict=True) if doc_id == c})

    rows = [(r.doc_id, r.text) for r in near.collect()]
    cut = {}
    for doc_id, start, end, *_ in expected(rows, PASSAGE_WORDS, runs=True, across=True):
        cut.setdefault(doc_id, set()).update(range(start, end))
    left = {doc_id: "".join(c for i, c in enumerate(text) if i not in cut.get(doc_id, ())) for doc_id, text in rows}
    assert {r.doc_id: r.text for r in lines.collect()} == left and cut
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    gone = {r.doc_id for r in contaminated_pairs(lines, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = {r.doc_id: r.text for r in benchmark.collect()}
    assert gone and kept == {k: v for k, v in left.items() if k not in gone}

    for r in decode_ids(pieces.where("sample = 1"), MODEL).collect():
        assert r.decoded == kept.pop(r.doc_id) and r.round_trip
    assert not kept
