import random

import pytest

from parchmill.operators import assemble


def shuffled(spark, rows, ddl):
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, ddl).repartition(5)


def joined(df, *order):
    out = {}
    for r in df.orderBy("path", *order).collect():
        out[r.path] = out.get(r.path, "") + r.text
    return out


@pytest.mark.parametrize(("segment_bytes", "block"), [(40, 7), (10**6, 4096)])
def test_paragraphs_pages_and_shapes(spark, monkeypatch, segment_bytes, block):
    # One document holds a third of all rows and spans many segments.
    monkeypatch.setattr(assemble, "BLOCK", block)
    sizes = {"hot": 100, "b": 7, "c": 1} | {f"d{i}": 20 for i in range(10)}
    rows = [(p, i, 0, f"{p}{i}é" if i % 3 else "") for p, n in sizes.items() for i in range(n)]
    texts = {p: [r[3] for r in rows if r[0] == p] for p in sizes}
    df = shuffled(spark, rows, "path string, part_no int, row_no int, text string")
    for join, expected in (
        (assemble.join_paragraphs, {p: "\n".join(t) for p, t in texts.items()}),
        (assemble.concat_pages, {p: "".join(t) for p, t in texts.items()}),
        (assemble.join_shapes, {p: "".join(x + "\n" for x in t) for p, t in texts.items()}),
    ):
        out = join(df, segment_bytes)
        assert joined(out, "segment_no") == expected
        found = out.collect()
        assert max(len(r.text.encode()) for r in found) < segment_bytes + 20
        numbers = sorted(r.segment_no for r in found if r.path == "hot")
        assert numbers == list(range(len(numbers))) and (len(numbers) > 5) == (segment_bytes == 40)


def test_workbook_cells(spark):
    rng = random.Random(2)
    rows, expected = [], {}
    for path in ("a", "b"):
        text = ""
        for sheet in range(3):
            for row in range(rng.randrange(1, 30)):
                for cell in range(rng.randrange(0, 4)):
                    value = rng.choice([0, "", None, "x", 5, False, 1.5])
                    if value is not None:
                        rows.append((path, sheet, row, cell, str(value), bool(value)))
                    if value:
                        text += str(value) + "\t"
                rows.append((path, sheet, row, assemble.ROW_END, "", True))
                text += "\n"
        expected[path] = text
    ddl = "path string, part_no int, row_no int, cell_no int, text string, keep boolean"
    df = shuffled(spark, rows, ddl)
    for segment_bytes in (10, 10**6):
        assert joined(assemble.join_cells(df, segment_bytes), "segment_no") == expected


def test_ranges_edges_and_giants(spark, monkeypatch):
    """Segments equal those cut from the whole text, however the rows are ranged."""
    monkeypatch.setattr(assemble, "BLOCK", 3)
    rng = random.Random(4)
    rows = []
    for p in range(12):
        for i in range(rng.choice([1, 2, 40, 200])):
            rows.append((f"p{p}", i, rng.choice(["", "é", "ab", "c" * 9, None]) if rng.random() > 0.02 else "x" * 95))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        for partitions, adaptive, batch in (("1", "true", "10000"), ("7", "false", "5"), ("40", "false", "10000")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
            df = shuffled(spark, list(rows), "path string, part_no int, text string")
            for size in (30, 10**6):
                expected = []
                for p in sorted({r[0] for r in rows}):
                    cut, offset = {}, 0
                    for t in (r[2] or "" for r in rows if r[0] == p):
                        cut[offset // size] = cut.get(offset // size, "") + t
                        offset += len(t.encode())
                    expected += [(p, k, cut[s]) for k, s in enumerate(sorted(cut))]
                found = assemble.concat_pages(df, size).collect()
                assert sorted(tuple(r) for r in found) == sorted(expected)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4096")


def test_no_elements(spark):
    empty = spark.createDataFrame([], "path string, part_no int, text string")
    assert assemble.concat_pages(empty).collect() == []
    nulls = spark.createDataFrame([(None, 0, "a"), ("p", 0, None)], "path string, part_no int, text string")
    assert [tuple(r) for r in assemble.concat_pages(nulls).collect()] == [("p", 0, "")]
