"""The mix against its SQL and the properties of the sample."""

import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from parchmill.llm import mixing, queries
from parchmill.llm.mixing import mix, source_targets, word_count


def filled(sizes, weights, cap):
    """Targets by passing on the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, open_sources, left = {}, set(names), sum(sizes.values())
    while open_sources:
        total = sum(weight[s] for s in open_sources)
        over = [s for s in open_sources if left * weight[s] / total > cap * sizes[s]]
        if not over:
            return target | {s: left * weight[s] / total for s in open_sources}
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(cap * sizes[s] for s in over)
        open_sources -= set(over)
    return target


def test_query(spark, sf_dir, documents):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op3_mixing"](spark, sf_dir).collect()}
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for d in documents:
        n = len(re.findall(r"[^ \t-\r]+", d["text"] or ""))
        assert rows[d["doc_id"]]["size"] == n
        sizes[d["source"]] += n
        largest[d["source"]] = max(largest[d["source"]], n)
        taken[d["source"]] += rows[d["doc_id"]]["taken"]
    targets = filled(sizes, (5, 2, 1), 3)
    for d in documents:
        r = rows[d["doc_id"]]
        assert r["source_size"] == sizes[d["source"]]
        assert r["target"] == pytest.approx(targets[d["source"]])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 3 * r["size"]
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for s, target in targets.items():
        assert abs(taken[s] - target) <= largest[s] / 2 + 1


@pytest.mark.parametrize(
    "sizes", [{"a": 10, "b": 1000, None: 5}, {"a": 0, "b": 0}, {"a": 7}, {"é": 3, "z": 90, "Z": 50, "b": 2}]
)
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in source_targets(df, (5, 2, 1), 3).collect()}
    expected = filled(sizes, (5, 2, 1), 3)
    assert found == {s: pytest.approx(t) for s, t in expected.items()}


def docs(spark, rows):
    kinds = "doc_id long, source string, n long, liking double, size string, rank string"
    return spark.createDataFrame([(*r, "x", "y") for r in rows], kinds)


def test_propensities_make_unequal_chances(spark):
    # Half of the documents are wanted four times as much as the others.
    rows = [(k, "a", 10, 4.0 if k % 2 else 1.0) for k in range(4000)]
    rows += [(k, "b", 10, None) for k in range(4000, 8000)]
    found = mix(docs(spark, rows), F.col("n"), weights=(1, 3), cap=3, propensity=F.col("liking")).collect()
    mean = defaultdict(list)
    for r in found:
        mean[r["source"], r["doc_id"] % 2].append(r["copies"])
    mean = {k: sum(v) / len(v) for k, v in mean.items()}
    assert mean["a", 1] == pytest.approx(0.8, abs=0.05) and mean["a", 0] == pytest.approx(0.2, abs=0.05)
    assert mean["b", 0] == pytest.approx(1.5, abs=0.05) and mean["b", 1] == pytest.approx(1.5, abs=0.05)
    words = sum(r["copies"] * r["size"] for r in found if r["source"] == "a")
    assert abs(words - 20_000) <= 5


def test_reruns_agree_and_edges(spark):
    rows = [(k % 50, "s" if k % 3 else None, k % 7, None) for k in range(300)]
    rows += [(None, "s", 4, -1.0), (None, "t", None, None), (7, "t", 0, 2.0), (8, "u", 100_000, None)]
    table = docs(spark, rows)
    first = mix(table, F.col("n"))
    assert first.columns == ["doc_id", "source", "size", "source_size", "target", "copies"]
    again = mix(table.repartition(7), F.col("n")).collect()
    assert sorted(map(str, first.collect())) == sorted(map(str, again))
    assert len(again) == len(rows) and all(0 <= r["copies"] <= 3 for r in again)
    assert mix(table.where("false"), F.col("n")).collect() == []


def test_word_count(spark):
    texts = ["a b\tc\x0bd\x0ce\rf\ng", None, "", "  ", "\x85\xa0x", "\x1c y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(word_count(F.col("t"))).collect()] == [7, 0, 0, 0, 1, 2]


def plainly_mixed(rows, targets, cap=3):
    """Copies as a multiset of (id, source, size, copies), row by row in order."""
    out = []
    for s, target in targets.items():
        mine = [r for r in rows if r[1] == s]
        size = sum(r[2] for r in mine)
        e = min(float(cap), target / size) if size else 0.0
        whole, rest = int(e), target - int(e) * size
        certain = [(*r[:3], whole) for r in mine]
        if whole >= cap or e == whole:
            out += certain
            continue

        def u(i):
            return int(hashlib.md5(f"7:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / (1 << 52)

        upto = 0
        for i, _, n in sorted((r[:3] for r in mine), key=lambda r: (u(r[0]), r[0] is not None, r[0] or 0, r[2])):
            upto += n
            out.append((i, s, n, whole + (upto - n / 2 <= rest)))
    return out


def test_equal_ranks_and_whole_copies(spark):
    rows = [(None, "a", 4) for _ in range(700)] + [(None, "a", k % 5) for k in range(500)]
    rows += [(k, "a", k % 11) for k in range(300)] + [(None, "b", 9)] * 1000 + [(5, "c", 2)] * 900
    rows += [(k, "c", 3) for k in range(50)] + [(None, None, 50)] * 333
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, source string, n long, liking double")
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[1]] += r[2]
    for table, sizes in ((df.repartition(6), sizes), (df.where("source = 'b'"), {"b": sizes["b"]})):
        found = mix(table, F.col("n"), row_col="whole").collect()
        mine = [r for r in rows if r[1] in sizes]
        expected = plainly_mixed(mine, filled(sizes, (5, 2, 1), 3))
        assert sorted(str((r[0], r[1], r[2], r["copies"])) for r in found) == sorted(map(str, expected))
        assert all(tuple(r["whole"])[:3] == r[:3] for r in found)


def test_a_source_of_whole_copies_has_no_border(spark, monkeypatch):
    asked = []
    real = mixing._last_taken
    monkeypatch.setattr(mixing, "_last_taken", lambda at, join: asked.append(at.count()) or real(at, join))
    rows = [(k, "a", 10, None) for k in range(500)]
    found = mix(docs(spark, rows), F.col("n")).collect()
    assert asked == [0] and [r["copies"] for r in found] == [1] * 500
