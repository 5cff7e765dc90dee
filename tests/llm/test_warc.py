import base64
import gzip
import hashlib

import pytest
from pyspark.sql import types as T

from riskframe.llm.warc import archive_pages, arc_record, http_message, parse_arc, parse_warc, record_of, version_block, warc_record

PAGES = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("record_id", T.StringType()), T.StructField("value", T.StringType())]
)


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES).repartition(3)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.mark.parametrize("least", [0, 5])
def test_pages_through_both_formats(spark, least):
    tricky = "<p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nfiledesc://x 1 2 3 4\n\nHTTP/1.1 é 🙂"
    rows = [(i, f"http://a/{i} b", tricky if i % 4 == 0 else f"<p>{i}</p>\n") for i in range(30)]
    rows += [(100, None, None), (101, "", ""), (None, "http://n/", tricky), (102, "u", "x" * 300_000), (28, "again", tricky), (103, "u", "tiny"), (104, "u", "tiny")]
    got = archive_pages(pages(spark, rows), least).collect()
    assert len(got) == len(rows)
    leads = {}
    for page_id, _, html in rows:
        if page_id is not None:
            leads[html or ""] = max(leads.get(html or "", -1), page_id)
    want = []
    for page_id, _, html in rows:
        lead = leads[html or ""]
        revisit = page_id != lead and len((html or "").encode()) >= least
        want.append((page_id, len((html or "").encode()), digest(html), "revisit" if revisit else "response", lead if revisit else None))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_empty_table(spark):
    assert archive_pages(pages(spark, [(1, "u", "x")]).where("false")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_headers_and_lengths(version):
    first = version_block("old.arc", version)
    messages = [http_message(1, b"a\n\nb"), b"\n1.2.3.4\n", http_message(None, b"")]
    data = first + b"\n"
    offsets = []
    for message, url in zip(messages, ("http://a/", "dns:a", "http://b/"), strict=True):
        offsets.append(len(data))
        data += arc_record(version, url, message, "old.arc", len(data)) + b"\n"
    for form in (data, gzip.compress(data)):
        found = list(parse_arc(form))
        assert [(n, o, c) for n, o, _, c in found] == [("old.arc", o, m) for o, m in zip(offsets, messages, strict=True)]
    records = [record_of(*x) for x in found]
    assert [r[1] for r in records] == [1, None, None] and records[0][4] == "2024-01-01T00:00:00Z" and records[0][7] == 4
    assert len({r[0] for r in records}) == 3
    with pytest.raises(ValueError):
        list(parse_arc(data[:-5]))


def test_warc_must_end_where_it_says():
    record = warc_record([("WARC-Type", "resource")], b"abc")
    assert [b for _, b in parse_warc(record + b"\r\n\r\n" + record + b"\r\n\r\n")] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(parse_warc(record + b"x\r\n\r\n"))
