"""Shards: every row once, the key law, slots without gaps, the same on every run."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parchmill.llm import queries
from parchmill.llm.sharding import with_slots, write_shards


@pytest.fixture
def shard(tmp_path):
    made = iter(range(99))

    def run(docs, **options):
        return write_shards(docs, str(tmp_path / f"s{next(made)}"), **options)

    return run


def test_query(spark, sf_dir, documents):
    rows = queries.QUERIES["op2_sharding"](spark, sf_dir).collect()
    found = {r["doc_id"]: r for r in rows}
    assert len(rows) == len(found) == len(documents)
    for d in documents:
        r, raw = found[d["doc_id"]], (d["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 24)
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) <= set(range(24)) and max(counts.values()) < 4 * len(rows) / 24
    moved = sum(r["grown_shard"] == 24 for r in rows)
    assert 0 < moved < 4 * len(rows) / 25
    for s, n in counts.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    by_slot = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    in_order = sum(a < b for a, b in zip(by_slot[:-1], by_slot[1:], strict=True))
    assert 0.3 < in_order / len(rows) < 0.7  # shuffled


def test_the_same_however_the_input_is_split(spark, sf_dir, shard):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    runs = [
        with_slots(shard(d, shards=3), F.col("row.doc_id").alias("doc_id")).collect()
        for d in (docs, docs.repartition(5, "source"))
    ]
    assert sorted(runs[0]) == sorted(runs[1])
    other = with_slots(shard(docs, shards=3, seed=5), F.col("row.doc_id").alias("doc_id")).collect()
    assert sorted(other) != sorted(runs[0])


def test_files_hold_rows_in_order(spark, sf_dir, shard, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = shard(docs, shards=2)
    assert sorted(r["row"] for r in written.collect()) == sorted(docs.collect())
    rows = written.select("*", F.col("_metadata.file_path").alias("f")).collect()
    for file in {r["f"] for r in rows}:
        places = [(r["bucket"], r["place"]) for r in rows if r["f"] == file]
        assert places == sorted(places)
    assert sorted(p.name for p in (tmp_path / "s0").glob("shard=*")) == ["shard=0", "shard=1"]


def test_edges(make, shard):
    rows = [(None, "a"), (None, None), (1, None), (1, None), (2, ""), (3, "x" * 500_000)]
    rows += [(9, "same")] * 3000  # an id repeated beyond what a bucket should hold
    docs = make(rows, shard="a", bucket="b", place="c", row="d")
    written = shard(docs, shards=4)
    assert written.columns == ["bucket", "place", "row", "shard"] or "shard" in written.columns
    out = with_slots(written, F.col("row.doc_id").alias("doc_id")).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(i for i, _ in rows)
    same = written.where("row.doc_id = 9").select("shard").distinct().collect()
    assert len(same) == 1
    for s in {r["shard"] for r in out}:
        slots = sorted(r["slot"] for r in out if r["shard"] == s)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("wide", ["text", "other"])
def test_equal_rows_do_not_fill_a_bucket(spark, shard, wide):
    """Half of all rows are one row, whatever column is the wide one."""
    rows = [(9, "same" if wide == "other" else "x" * 1000, "y" * 1000 if wide == "other" else "")] * 300
    rows += [(k, f"text {k}", "z" * 1000) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, other string")
    written = shard(docs, shards=2, bucket_bytes=20_000)
    sizes = written.groupBy("shard", "bucket").agg(F.sum(F.length("row.text") + F.length("row.other")).alias("b"))
    assert max(r["b"] for r in sizes.collect()) < 60_000
    assert sorted(r["row"] for r in written.collect()) == sorted(docs.collect())
    assert written.where("row.doc_id = 9").select("shard").distinct().count() == 1


def test_no_rows(make, shard):
    assert with_slots(shard(make([]), shards=2)).collect() == []
