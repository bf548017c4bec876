"""Archives: round trips, predicates, skipping, damage, and pages with copies."""

import base64
import gzip
import hashlib
import io
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from parchmill.llm import queries
from parchmill.llm.warc import SCHEMA, WarcDataSource, base32, gzip_member, read_pages, records, write_pages


def expected(rows, least=0):
    def digest(html):
        return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()

    largest = {}
    for page, html in rows:
        if page is not None:
            largest[digest(html)] = max(page, largest.get(digest(html), page))
    out = []
    for page, html in rows:
        size, d = len((html or "").encode()), digest(html)
        keeper = largest.get(d) if size >= least else None
        again = keeper is not None and page != keeper
        out.append((page, size, d, "revisit" if again else "response", keeper if again else None))
    return sorted(out, key=str)


def pages(spark, rows):
    kinds = "page_id long, url string, html string, payload string, sha1 string"
    return spark.createDataFrame([(p, f"http://x.example/{p}", h, "a", "b") for p, h in rows], kinds)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query(spark, sf_dir):
    rows = [(r["page_id"], r["html"]) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert got(queries.QUERIES["op4_warc"](spark, sf_dir)) == expected(rows)


ROWS = [(1, "a" * 10), (2, "a" * 10), (3, None), (4, ""), (5, "é\r\n\r\nWARC/1.1\r\n"), (6, "b" * 300_000)]
ROWS += [(7, "a" * 10), (7, "a" * 10), (None, "a" * 10), (None, "only here"), (8, "tiny")]


@pytest.mark.parametrize("least", [0, 8])
def test_copies_nulls_and_repeats(spark, tmp_path, least):
    path = str(tmp_path / "w")
    write_pages(pages(spark, ROWS), path, min_bytes=least)
    assert got(read_pages(spark, path)) == expected(ROWS, least)
    write_pages(pages(spark, [(100, "later")]), path)  # archives are added to
    assert len(got(read_pages(spark, path))) == len(ROWS) + 1


def test_no_pages(spark, tmp_path):
    write_pages(pages(spark, []), str(tmp_path / "w"))
    assert read_pages(spark, str(tmp_path / "w")).collect() == []


@pytest.fixture
def archive(spark, tmp_path):
    path = tmp_path / "w"
    write_pages(pages(spark, ROWS).coalesce(1), str(path))
    return path


def load(spark, path, schema=SCHEMA, **options):
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).schema(schema).load(str(path))


def test_payloads_and_headers(spark, archive):
    rows = {r["record_id"]: r for r in load(spark, archive).collect()}
    assert rows["<urn:page:6>"]["payload"] == b"b" * 300_000
    assert rows["<urn:page:5>"]["payload"] == "é\r\n\r\nWARC/1.1\r\n".encode()
    assert rows["<urn:page:1>"]["payload"] == b"" and rows["<urn:page:1>"]["warc_type"] == "revisit"
    assert rows["<urn:page:1>"]["http_headers"]["content-length"] == "10"
    assert rows["<urn:page:2>"]["target_uri"] == "http://x.example/2"


def test_predicates_reach_the_source(spark, archive, capfd):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = load(spark, archive, "warc_type string, record_id string, target_uri string")
    some = df.where((F.col("warc_type") == "response") & F.col("target_uri").endswith("/6"))
    assert [r["record_id"] for r in some.collect()] == ["<urn:page:6>"]
    some.explain()
    plan = capfd.readouterr().out
    assert not re.search(r"^\W*Filter", plan, re.M)
    both = df.where(F.col("warc_type").isin("revisit", "x") & F.col("record_id").contains(":1"))
    assert [r["record_id"] for r in both.collect()] == ["<urn:page:1>"]


def member(headers, block):
    said = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return f"WARC/1.0\r\n{said}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.bytes = 0

    def read(self, n=-1):
        data = super().read(n)
        self.bytes += len(data)
        return data


@pytest.mark.parametrize("kind", ["plain", "gzip", "gzip with lengths", "one member"])
def test_foreign_files(kind):
    import random

    noise = random.Random(1).randbytes(400_000)
    made = [member({"WARC-Type": t, "X": k}, noise if t == "response" else b"q") for k, t in enumerate(
        ["warcinfo", "response", "response", "request"])]
    if kind == "plain":
        raw = b"".join(made)
    elif kind == "gzip":
        raw = b"".join(map(gzip.compress, made))
    elif kind == "gzip with lengths":
        raw = b"".join(gzip_member(m, 1) for m in made)
    else:
        raw = gzip.compress(b"".join(made))
    if kind == "one member":  # the standard asks for a member a record; others are read whole
        made = made[:1]
        raw = gzip.compress(made[0])
    file = Counted(raw)
    found = [(h["warc-type"], b) for h, b in records(file, lambda h: h["warc-type"] != "response", True)]
    assert found == [(t, b"q") for t in ["warcinfo", "request"][: len(made)]]
    if kind in ("plain", "gzip with lengths"):
        assert file.bytes < len(raw) / 2  # the payloads passed over were not even read
    both = [b for _, b in records(io.BytesIO(raw), lambda h: True, True)]
    assert both == ([b"q", noise, noise, b"q"] if len(made) > 1 else [b"q"])
    for cut in (len(raw) * 2 // 3, len(raw) // 4):
        with pytest.raises((EOFError, ValueError)):
            list(records(io.BytesIO(raw[:cut]), lambda h: True, True))


def test_a_changed_payload_is_found(spark, archive):
    for file in archive.glob("*.warc.gz"):
        parts = []
        for m in gzip.decompress(file.read_bytes()).replace(b"tiny", b"tinz").split(b"WARC/1.1\r\nWARC-Type")[1:]:
            parts.append(gzip_member(b"WARC/1.1\r\nWARC-Type" + m, 1))
        file.write_bytes(b"".join(parts))
    with pytest.raises(PySparkException, match="not the one written"):
        load(spark, archive, verify="true").collect()


def test_files_are_dealt_out_by_size(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = [(k, f"page {k} " * 50) for k in range(40)]
    for k in range(5):  # each adds a file at least
        write_pages(pages(spark, rows[8 * k : 8 * k + 8]), path)
    assert load(spark, path, partition_bytes="1").rdd.getNumPartitions() >= 4
    assert load(spark, path).rdd.getNumPartitions() == 1
    left = [p.name for p in (tmp_path / "w").iterdir() if p.name.startswith("_")]
    assert left == []


def test_base32(spark):
    raw = [hashlib.sha1(str(k).encode()).digest() for k in range(20)]
    df = spark.createDataFrame([(r.hex(),) for r in raw], "h string")
    assert [r[0] for r in df.select(base32(F.col("h"))).collect()] == [base64.b32encode(r).decode() for r in raw]
