import struct
import zlib

import pytest
import xxhash

from cinderlog.llm.sharding import with_shards, with_slots


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, shard string, x string")


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")
    got = with_shards(ids, "doc_id", [1.0] * 40).collect()
    again = {r.doc_id: r.shard for r in with_shards(ids, "doc_id", [1.0] * 41).collect()}
    assert all(r.grown_shard in (r.shard, 40) and r.grown_shard == again[r.doc_id] for r in got)
    moved = sum(r.grown_shard == 40 for r in got)
    assert 20_000 / 41 * 0.8 < moved < 20_000 / 41 * 1.2


def test_weights(spark):
    ids = spark.range(30_000).withColumnRenamed("id", "doc_id")
    got = {r.shard: r["count"] for r in with_shards(ids, "doc_id", [1.0, 2.0, 3.0]).groupBy("shard").count().collect()}
    assert all(abs(got[s] / 30_000 - (s + 1) / 6) < 0.02 for s in range(3))
    weighed = with_shards(ids, "doc_id", [1.0, 2.0, 3.0], more=2.0).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in weighed)
    for bad in ([], [1.0, 0.0]):
        with pytest.raises(ValueError):
            with_shards(ids, "doc_id", bad)


def test_slots_are_gapless_with_nulls_and_repeated_rows(spark):
    rows = [(i % 50 if i % 7 else None, None, "x" * (i % 3)) for i in range(600)] + [(1, "z", "same")] * 300
    got = with_slots(with_shards(frame(spark, rows), "doc_id", [1.0] * 4)).collect()
    assert len(got) == 900 and sorted((r.doc_id or -1, r.x) for r in got) == sorted((i or -1, x) for i, _, x in rows)
    for s in range(4):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert with_slots(with_shards(frame(spark, []), "doc_id", [1.0] * 4)).count() == 0


def score(key, shard):
    """The hash that shards compete by: of the key's 8 bytes, then of the shard's 4."""
    first = xxhash.xxh64_intdigest(struct.pack("<q", key), seed=42)
    return xxhash.xxh64_intdigest(struct.pack("<i", shard), seed=first) >> 11


def test_clashing_names_and_long_keys(spark):
    schema = "key string, slot int, Shard int, best string, _best string, extra int, n long, b int, _n long, start int, at int, i int, s int, c int, grown_shard string"
    rows = [("k" * 300_000, 9, 9, "b", "b", 1, 2, 3, 4, 5, 6, 7, 8, 9, "g")] * 3 + [(None,) * 15, ("k2", *[None] * 14)]
    sharded = with_shards(spark.createDataFrame(rows, schema), "key", [1.0, 2.0])
    assert sorted(c.lower() for c in sharded.columns) == sorted(c.lower() for c in schema.replace(",", "").split()[::2])
    got = with_slots(sharded, shard="Shard")
    assert sorted(c.lower() for c in got.columns) == sorted(c.lower() for c in sharded.columns)
    out = got.collect()
    assert len(out) == 5 and {r.best for r in out} == {"b", None}
    for s in (0, 1):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))


def test_query_digests(spark):
    from conftest import SF

    from cinderlog.llm.registry import op3_sharding

    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_sharding(spark, SF).collect()
    for r in rows:
        scores = [score(r.doc_id, s) for s in range(41)]
        assert r.shard == scores.index(max(scores[:40])) and r.grown_shard == scores.index(max(scores))
    for s in range(40):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    for r in rows:
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 16, zlib.crc32(texts[r.doc_id])) and 0 <= r.shard < 40
