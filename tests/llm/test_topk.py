"""Exact top-k against scoring everything at once."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill.llm import queries, topk
from parchmill.llm.topk import top_k


def brute(rows, asked, k, scale=1024):
    usable = [
        (i, np.floor(np.array(v, np.float64) * scale).astype(object))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for i, q in usable:
        if asked(i):
            found = [(-sum(int(a) * int(b) for a, b in zip(q, c, strict=True)), j)
                     for j, c in usable if j != i and len(c) == len(q)]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(found)[:k])]
    return sorted(out)


def got(df):
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in df.collect())


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    wanted = [r for r in rows if r[0] % 100 == 0]
    expected = []
    matrix = np.floor(np.array([v for _, v in rows], np.float64) * 1024).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    for i, v in wanted:
        scores = matrix @ np.floor(np.array(v, np.float64) * 1024).astype(np.int64)
        order = [k for k in np.lexsort((ids, -scores)) if ids[k] != i][:10]
        expected += [(i, r + 1, int(ids[k]), int(scores[k])) for r, k in enumerate(order)]
    assert got(queries.QUERIES["op8_topk"](spark, sf_dir)) == sorted(expected)


def vectors(spark, rows):
    kinds = "vec_id long, embedding array<float>, key string, slice string, score string"
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], kinds)


@pytest.mark.parametrize("seed", [1, 2])
def test_ties_copies_and_small_blocks(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows = [(k, [rng.choice([-1.0, 0.0, 0.5]) for _ in range(3)]) for k in range(150)]
    rows += [(k, [0.5, 0.5, 0.5]) for k in range(150, 260)]  # one vector very often
    rng.shuffle(rows)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    df = top_k(vectors(spark, rows), F.col("vec_id") % 9 == 0, k=5, slices=3)
    assert got(df) == brute(rows, lambda i: i % 9 == 0, 5)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0])]
    rows += [(6, [1.0]), (10, [2.0]), (None, [1.0, 1.0]), (7, []), (20, []), (8, [-1e6, 3e5]), (9, [-0.0001, 0.0])]
    asked = F.col("vec_id") % 10 == 0
    assert got(top_k(vectors(spark, rows), asked)) == brute(rows, lambda i: i % 10 == 0, 10)
    assert top_k(vectors(spark, []), asked).collect() == []
    assert top_k(vectors(spark, rows), F.lit(False)).collect() == []
    assert top_k(vectors(spark, rows[:1]), asked).collect() == []  # no other row


def test_repeated_rows(spark):
    rows = [(0, [1.0]), (0, [1.0]), (1, [3.0]), (1, [3.0]), (2, [2.0])]
    found = got(top_k(vectors(spark, rows), F.col("vec_id") == 0, k=2))
    best = [(0, 1, 1, 3 * 1024 * 1024), (0, 2, 1, 3 * 1024 * 1024)]
    assert found == sorted(best * 2)  # each query row its own two


def test_rows_that_share_an_id_are_candidates(spark, tmp_path):
    rows = [(100, [1.0]), (100, [2.0]), (101, [0.5]), (None, [9.0])]
    expected = [(100, 1, 100, 2 * 1024**2), (100, 1, 100, 2 * 1024**2), (100, 2, 101, 1024**2 // 2), (100, 2, 101, 1024**2)]
    found = got(top_k(vectors(spark, rows), F.col("vec_id") % 100 == 0))
    assert found == sorted(expected)
    vectors(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")  # rows of files, and the SQL
    assert got(queries.QUERIES["op8_topk"](spark, str(tmp_path))) == found
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert sorted(con.execute(queries.SQL["op8_topk"]).fetchall()) == found


def test_large_numbers_stay_exact(spark):
    rows = [(k, [float(2**20 + k), float(-(2**19))]) for k in range(12)]
    assert got(top_k(vectors(spark, rows), F.col("vec_id") < 3, k=4)) == brute(rows, lambda i: i < 3, 4)
    with pytest.raises(ValueError, match="long"):
        top_k(vectors(spark, [(0, [1e9, 1e9]), (1, [1e9, 1e9])]), F.col("vec_id") < 3)
