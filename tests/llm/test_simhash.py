"""Fingerprints against a plain restatement, and the search against all pairs."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchmill.llm import queries
from parchmill.llm.simhash import compare_with_edits, fingerprint, fingerprints, near_fingerprints


def expected_edits(rows):
    """(doc_id, n_chars, sha256) by the contract; ids are unique."""
    ordered = sorted(rows, key=lambda r: -r[0])
    out = []
    for k, (i, text) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, following))
    return sorted(out)


def bits(mark):
    return int(mark, 16)


def check(rows, found):
    expected = expected_edits(rows)
    found = sorted(found, key=lambda r: r["doc_id"])
    assert [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in found] == [e[:3] for e in expected]
    text = dict(rows)
    for columns, texts in (
        ("fingerprint", [text[e[0]] or "" for e in expected]),
        ("edited_fingerprint", [e[3] for e in expected]),
    ):
        # One text at a time: a fingerprint doesn't depend on its neighbours.
        alone = [f"{int(fingerprints(pa.array([t]))[0]):016x}" for t in texts]
        assert [r[columns] for r in found] == alone
    for r, e in zip(found, expected, strict=True):
        following = int(fingerprints(pa.array([e[4]]))[0])
        a, b = bits(r["fingerprint"]), bits(r["edited_fingerprint"])
        assert r["near_edited"] == 1 - (a ^ b).bit_count() / 64
        assert r["near_next"] == 1 - (a ^ following).bit_count() / 64


def test_query(spark, sf_dir, documents):
    found = queries.QUERIES["op10_simhash"](spark, sf_dir).collect()
    check([(r["doc_id"], r["text"]) for r in documents], found)
    long = [r for r in found if r["n_chars"] > 300]
    edited, other = (np.mean([r[c] for r in long]) for c in ("near_edited", "near_next"))
    assert edited > 0.65 and other < 0.6


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_edges(spark, make, partitions):
    rows = [(k, t) for k, t in enumerate(["", None, "a", "é" * 7, "one two three " * 9000, "x y z", "x y z"])]
    rows += [(k + 100, f"word {k} and {k * k} more") for k in range(30)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = compare_with_edits(make(rows, part="p", kind="k", fingerprint="f"))
        check(rows, df.collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    check(rows[4:5], compare_with_edits(make(rows[4:5])).collect())
    assert compare_with_edits(make([])).collect() == []


def test_rows_repeated_exactly_are_dealt_to_several_ranges(spark, make, monkeypatch):
    rows = [(7, "the same text again")] * 300 + [(k, f"text {k} of others") for k in range(20)]
    df = compare_with_edits(make(rows).repartition(3))
    found = df.collect()
    assert len(found) == len(rows)
    ordered = sorted(rows, key=lambda r: -r[0])
    hashes = []
    for k, (_, text) in enumerate(ordered):
        following = ordered[(k + 1) % len(ordered)][1]
        cut = len(text) // 3
        hashes.append(hashlib.sha256((text[: len(text) - cut] + following[:cut]).encode()).hexdigest())
    # Id 7 has another text, too, which comes before or after the equal ones.
    assert sum(r["edited_sha256"] in set(hashes) for r in found) >= len(rows) - 3


def test_repeated_and_missing_ids(make):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "g h i j k l"), (2, "m n o")]
    found = compare_with_edits(make(rows)).collect()
    assert len(found) == 4
    last = next(r for r in found if r["doc_id"] is None)  # followed by the largest id
    assert last["edited_sha256"] == hashlib.sha256(b"g h i j m n").hexdigest()


def test_equal_texts_and_slices(spark, make):
    texts = ["lorem ipsum dolor", "LOREM, ipsum; dolor!", "other words here", None, ""]
    found = fingerprint(make(list(enumerate(texts)), fingerprint="f")).orderBy("doc_id").collect()
    marks = [r["fingerprint"] for r in found]
    assert marks[0] == marks[1] != marks[2] and marks[3] == marks[4] == "0" * 16
    column = pa.array(["pad", *texts]).slice(1)
    assert [f"{int(x):016x}" for x in fingerprints(column)] == marks


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_search_equals_all_pairs(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(40)]
    marks = list(base)
    for b in base:
        for _ in range(4):
            for k in rng.sample(range(64), rng.randrange(9)):
                b ^= 1 << k
            marks.append(b)
    rows = [(f"{m:016x}", k % 5 == 0) for k, m in enumerate([*marks, *base])] + [(None, True)]
    df = spark.createDataFrame(rows, "fingerprint string, asked boolean")
    distinct = sorted(set(marks))
    signed = {m: m - (1 << 64) if m >> 63 else m for m in distinct}

    def near(a, b):
        return (a ^ b).bit_count() <= radius

    pairs = {(a, b) for a in distinct for b in distinct if signed[a] < signed[b] and near(a, b)}
    found = near_fingerprints(df, radius).collect()
    assert {(bits(r["x"]), bits(r["y"])) for r in found} == pairs and len(found) == len(pairs)
    assert all(r["distance"] == (bits(r["x"]) ^ bits(r["y"])).bit_count() for r in found)

    asked = {int(m, 16) for m, a in rows if m and a}
    pairs = {(a, b) for a in asked for b in distinct if a != b and near(a, b)}
    found = near_fingerprints(df, radius, queries=F.col("asked")).collect()
    assert {(bits(r["x"]), bits(r["y"])) for r in found} == pairs and len(found) == len(pairs)


def test_search_query(spark, sf_dir, documents):
    marks = {d["doc_id"]: int(fingerprints(pa.array([d["text"]], pa.large_string()))[0]) for d in documents}
    least, many = {}, {}
    for i, m in sorted(marks.items()):
        least.setdefault(m, i)
        many[m] = many.get(m, 0) + 1
    asked = {m for i, m in marks.items() if i % 50 == 0}
    expected = [
        (least[a], least[b], many[b], (a ^ b).bit_count())
        for a in asked
        for b in many
        if a != b and (a ^ b).bit_count() <= 3
    ]
    rows = queries.QUERIES["simhash_search"](spark, sf_dir).collect()
    found = [(r["query_id"], r["doc_id"], r["n_documents"], r["distance"]) for r in rows]
    assert sorted(found) == sorted(expected)


def test_search_finds_copies_for_every_query_id(spark, tmp_path):
    texts = {0: "one two three four", 1: "other words are here", 2: "alone in this table", 3: None}
    rows = [(k, texts[k % 2]) for k in range(40, 170, 3)] + [(50, texts[0]), (100, texts[1]), (100, texts[1])]
    rows += [(200, texts[2]), (None, texts[0]), (250, None), (None, ""), (300, texts[0] + " five")]
    rows += [(k, f"{'many words in a long text ' * 40} and {k}") for k in range(400, 420)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    marks = [int(fingerprints(pa.array([t], pa.large_string()))[0]) for _, t in rows]
    expected = []
    for q, (i, _) in enumerate(rows):
        if i is None or i % 50:
            continue
        near = {}
        for k, (j, _) in enumerate(rows):
            if k != q and (marks[q] ^ marks[k]).bit_count() <= 3:
                near.setdefault(marks[k], []).append(j)
        for m, js in near.items():
            least = min((j for j in js if j is not None), default=None)
            expected.append((i, least, f"{m:016x}", len(js), (m ^ marks[q]).bit_count()))
    found = queries.QUERIES["simhash_search"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))
    assert {r["distance"] for r in found} > {0} and {r["query_id"] for r in found} >= {50, 100, 250, 400}
    members = queries.QUERIES["simhash_members"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, members))) == sorted(
        str((i, f"{m:016x}")) for (i, _), m in zip(rows, marks, strict=True)
    )
