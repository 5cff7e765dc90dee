import zlib

from pyspark.sql import functions as F

from riskframe.llm.sharding import assign_shards, jump_path, write_shards


def jump(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_path_is_the_published_one(spark):
    keys = [*range(300), -1, -(2**63), 2**63 - 1, 123456789123456789]
    rows = spark.createDataFrame([(k,) for k in keys], "k long").select("k", jump_path(F.col("k"), 40).alias("p")).collect()
    for r in rows:
        assert (r.p.shard, r.p.grown) == (jump(r.k % 2**64, 40), jump(r.k % 2**64, 41))


def test_shards_and_slots(spark, documents):
    rows = [(i, f"text {i % 5} é") for i in range(500)] + [(7, "text 2 é")] * 3 + [(None, None), (None, ""), (1000, "x" * 200_000)]
    got = assign_shards(documents(rows), 8).collect()
    assert len(got) == len(rows)
    for r in got:
        text = dict((k, t) for k, t in rows if k is not None).get(r.doc_id, "") or ""
        if r.doc_id is not None:
            assert (r.size, r.text_crc32) == (len(text.encode()) + 16, zlib.crc32(text.encode()))
            assert (r.shard, r.grown_shard) == (jump(r.doc_id, 8), jump(r.doc_id, 9))
        else:
            assert (r.size, r.text_crc32, r.shard) == (16, 0, jump(0, 8))
        assert r.grown_shard in (r.shard, 8) and r.law == "key"
    for shard in range(8):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_empty_and_files(spark, documents, tmp_path):
    assert assign_shards(documents([(1, "a")]).where("false"), 4).count() == 0
    write_shards(documents([(i, "a") for i in range(50)]), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.select("shard").distinct().count() == 4
