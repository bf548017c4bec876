"""Whitening against plain linear algebra on whole numbers."""

import numpy as np
import pytest

from parchmill.llm import queries, whitening
from parchmill.llm.whitening import bit_planes, cross_products, whiten


def expected(rows, components=8):
    """(n, deviations, whitened, explained) of the usable rows, in their order."""
    good = [v for _, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    length = max(map(len, good))
    x = [[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] + [100_000] * (length - len(v)) for v in good]
    x = np.array(x, object)
    n = len(x)
    centred = n * x - x.sum(axis=0)
    scatter = centred.T @ centred
    values, vectors = np.linalg.eigh(np.array(scatter / (n * n), float) / n)
    order = np.argsort(-values)[:components]
    order = order[values[order] > values.max() * 1e-12]
    white = np.array(centred / n, float) @ vectors[:, order] / np.sqrt(values[order])
    return n, [int(d) for d in (centred**2).sum(axis=1)], white, values[order] / values.sum()


def check(rows, df, components=8):
    n, deviations, white, explained = expected(rows, components)
    usable = [i for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    found = df.collect()
    k = len(explained)
    assert len(found) == n * k
    assert {r["n"] for r in found} == {n} and len({r["identity_error"] for r in found}) == 1
    assert 0 <= found[0]["identity_error"] < 1e-4
    assert sorted((str(r["vec_id"]), r["deviation"]) for r in found) == sorted(
        (str(i), d) for i, d in zip(usable, deviations, strict=True) for _ in range(k)
    )
    for c in range(k):
        mine = sorted((str(r["vec_id"]), r["whitened"], r["explained"]) for r in found if r["component"] == c + 1)
        for sign in (1, -1):
            other = sorted((str(i), w) for i, w in zip(usable, sign * white[:, c], strict=True))
            if np.allclose([m[1] for m in mine], [w for _, w in other], atol=1e-7):
                break
        else:
            raise AssertionError(f"component {c + 1}")
        assert np.allclose([m[2] for m in mine], explained[c], rtol=1e-9)


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(rows, queries.QUERIES["op13_whitening"](spark, sf_dir))


def vectors(spark, rows):
    kinds = "vec_id long, embedding array<float>, n string, component string, id string, vector string"
    return spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], kinds)


def test_edges(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK", 16)
    rng = np.random.default_rng(2)
    rows = [(k, [float(np.float32(c)) for c in rng.normal(0, 3, 5)]) for k in range(70)]
    rows += [(100, None), (101, [1.0, None]), (102, [float("nan")]), (103, [float("inf"), 1.0])]
    rows += [(104, [0.5]), (105, []), (106, [-99.0, -200.0, 3.0]), (None, [1.0, 2.0, 3.0, 4.0, 5.0])]
    check(rows, whiten(vectors(spark, rows)))
    check(rows + rows[:30], whiten(vectors(spark, rows + rows[:30])))  # repeated rows count as often


def test_components_without_variance_give_no_rows(spark):
    rows = [(k, [float(k), 2.0 * k, 7.0]) for k in range(12)]
    df = whiten(vectors(spark, rows))
    assert {r["component"] for r in df.collect()} == {1}
    check(rows, df)
    for few in ([], rows[:1], [(k, [1.0, 2.0]) for k in range(9)], [(1, None)], [(1, [])]):
        assert whiten(vectors(spark, few)).collect() == []


@pytest.mark.parametrize("bits", [1, 11, 25, 39])
def test_products_of_planes_are_exact(bits):
    half = 1 << (bits - 1)
    x = np.random.default_rng(bits).integers(-half, half, (333, 4))
    sums, products = cross_products(x)
    exact = x.astype(object)
    assert (sums == exact.sum(axis=0)).all() and (products == exact.T @ exact).all()
    y = x - x.min(axis=0)
    planes = np.unpackbits(bit_planes(y).view(np.uint8), axis=2)[..., : len(y)]
    weights = (1 << np.arange(planes.shape[1]))[None, :, None]
    assert ((planes * weights).sum(axis=1).T == y).all()


def test_too_large_entries_are_refused_and_large_deviations_are_null(spark):
    with pytest.raises(Exception, match="too large"):
        whiten(vectors(spark, [(1, [1e30]), (2, [0.0])])).collect()
    found = whiten(vectors(spark, [(1, [1e8, 1.0]), (2, [0.0, 5.0]), (3, [3.0, 5.0])])).collect()
    assert None in {r["deviation"] for r in found}
