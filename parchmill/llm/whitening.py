"""Embedding whitening from an exact scatter matrix of bit-sliced vectors.

Entries become whole numbers. In blocks of rows each dimension is shifted to start at
zero and cut into bit planes, packed across the rows into 64-bit words. The sum of the
products of two dimensions is the sum over pairs of their planes of the ones they have
in common (AND, then popcount), each weighted by its power of two: exact, in whole
numbers. The scatter matrix is centred as whole numbers too, so that the eigenvectors
come from a covariance without cancellation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.session import scratch_path

BLOCK = 8192  # rows whose planes are packed at once
MOST = 1 << 40  # entries must be below this, so that sums of products fit 38 digits
_EXACT_BITS = 24  # planes of so many bits have products that a block sums in 64 bits


def whole_numbers(column: pa.Array, length: int, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that are usable, their entries floor(scale * c) + shift as a matrix).

    A vector with a null or non-finite entry is not usable; a shorter one has zeros for
    the entries it lacks.
    """
    column = column.cast(pa.list_(pa.float64()))
    usable = column.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(usable, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0)
    values = column.flatten().to_numpy(zero_copy_only=False)  # nulls become NaN
    row = np.repeat(np.arange(len(column)), sizes)
    usable[row[~np.isfinite(values)]] = False
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    matrix = np.zeros((len(column), length))
    fits = usable[row]
    matrix[row[fits], place[fits]] = values[fits]
    matrix = np.floor(matrix[usable] * scale)
    if matrix.size and np.abs(matrix).max() + abs(shift) >= MOST:
        raise ValueError(f"an entry is too large: scaled entries must be below {MOST}")
    return usable, matrix.astype(np.int64) + shift


def bit_planes(y: np.ndarray) -> np.ndarray:
    """Planes of a matrix of non-negative numbers: dimensions x bits x words."""
    bits = max(1, int(y.max(initial=0)).bit_length())
    rows = -(-len(y) // 64) * 64
    out = np.zeros((y.shape[1], bits, rows // 64), np.uint64)
    for p in range(bits):
        ones = np.zeros((y.shape[1], rows), np.uint8)
        ones[:, : len(y)] = ((y >> p) & 1).T
        out[:, p] = np.packbits(ones, axis=1).view(np.uint64)
    return out


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of each column, sums of products of all pairs of columns), as Python numbers."""
    least = x.min(axis=0)
    y = x - least
    planes = bit_planes(y)
    dims, bits, _ = planes.shape
    kind = np.int64 if bits <= _EXACT_BITS else object
    power = np.array([1 << p for p in range(bits)], dtype=kind)
    found = np.zeros((dims, dims), kind)
    for i in range(dims):
        for p in range(bits):
            common = np.bitwise_count(planes[i, p] & planes[i:]).sum(axis=2, dtype=np.int64)
            found[i, i:] += (common.astype(kind) * power).sum(axis=1) * power[p]
    # The ones of a plane, weighted, are the sum of its dimension.
    ones = np.bitwise_count(planes).sum(axis=2, dtype=np.int64).astype(kind)
    sums = (ones * power).sum(axis=1).astype(object)
    found = np.triu(found.astype(object))
    found = found + np.triu(found, 1).T
    shift, n = least.astype(object), len(x)
    # (y + shift)(y' + shift') summed.
    found = found + np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)
    return sums + n * shift, found


def _scatter(vectors: DataFrame, length: int, scale: int, shift: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sums, sums of products) over all usable vectors. Every task adds up its
    blocks; the driver gets length * (length + 3) / 2 numbers, whatever the rows."""
    upper = np.triu_indices(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, held, size = 0, np.zeros(length, object), np.zeros((length, length), object), [], 0

        def add():
            nonlocal n, sums, products
            x = np.concatenate(held)
            s, p = cross_products(x)
            n, sums, products = n + len(x), sums + s, products + p

        for batch in batches:
            _, x = whole_numbers(batch.column(0), length, scale, shift)
            for k in range(0, len(x), BLOCK):
                part = x[k : k + BLOCK]
                if size + len(part) > BLOCK:
                    add()
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if size:
            add()
        if n:
            i = np.concatenate([[-1], np.full(length, -1), upper[0]]).astype(np.int32)
            j = np.concatenate([[-1], np.arange(length), upper[1]]).astype(np.int32)
            total = [str(v) for v in (n, *sums, *products[upper])]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total)], ["i", "j", "total"])

    parts = vectors.mapInArrow(run, "i int, j int, total string")
    rows = parts.groupBy("i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    n, sums, products = 0, np.zeros(length, object), np.zeros((length, length), object)
    for i, j, total in rows:
        if i >= 0:
            products[i, j] = products[j, i] = int(total)
        elif j >= 0:
            sums[j] = int(total)
        else:
            n = int(total)
    return n, sums, products


@dataclass(frozen=True)
class Whitening:
    """What whitens a vector of whole numbers: (x - sums / n) @ directions."""

    n: int
    length: int
    scale: int
    shift: int
    sums: tuple[int, ...]
    directions: np.ndarray  # unit eigenvectors over the roots of their eigenvalues
    explained: tuple[float, ...]


def fit(
    vectors: DataFrame, vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000
) -> Whitening:
    """The covariance of all usable vectors and its first eigenvectors.

    A component without variance (as far as double precision tells) is left out, so
    there may be fewer than `components`, and none for one vector or equal ones.
    """
    column = vectors.select(F.col(f"`{vector_col}`").alias("vector"))
    length = column.agg(F.max(F.size("vector"))).first()[0] or 0
    length = max(length, 0)
    n, sums, products = _scatter(column, length, scale, shift)
    none = Whitening(n, length, scale, shift, tuple(sums), np.zeros((length, 0)), ())
    if not n or not length:
        return none
    centred = n * products - np.outer(sums, sums)  # n * n times the covariance, in whole numbers
    covariance = np.array([[v / (n * n) for v in row] for row in centred], np.float64)
    trace = sum(centred[k, k] for k in range(length)) / (n * n)
    if not trace:
        return none
    values, directions = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > trace * length * np.finfo(float).eps]
    return Whitening(
        n,
        length,
        scale,
        shift,
        tuple(sums),
        directions[:, order] / np.sqrt(values[order]),
        tuple((values[order] / trace).tolist()),
    )


def _deviations(x: np.ndarray, model: Whitening) -> list[int | None]:
    """Exact sums of (n * x - sums) ** 2; None beyond 64 bits."""
    sums = np.array(model.sums, object)
    reach = max((abs(v) for v in (*sums, model.n * int(np.abs(x).max(initial=0)))), default=0)
    if 4 * reach * reach * model.length < 2**63:
        return ((model.n * x - sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
    parts = [sum((model.n * v - s) ** 2 for v, s in zip(row, model.sums, strict=True)) for row in x.tolist()]
    return [d if d < 2**63 else None for d in parts]


def project(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, deviation and whitened (an array by component) of all usable vectors."""
    taken = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    kind = taken.schema["id"].dataType.simpleString()
    mean = np.array([s / model.n for s in model.sums]) if model.n else np.zeros(model.length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), BLOCK):
                part = batch.slice(k, BLOCK)
                usable, x = whole_numbers(part.column(1), model.length, model.scale, model.shift)
                white = (x - mean) @ model.directions
                offsets = np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel()))
                ids = part.column(0).filter(pa.array(usable))
                deviation = pa.array(_deviations(x, model), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, deviation, lists], ["id", "deviation", "whitened"])

    return taken.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def _identity_error(white: DataFrame, components: int) -> float:
    """The largest entry of the whitened values' covariance minus the identity."""
    pairs = [(a, b) for a in range(components) for b in range(a, components)]
    entries = [F.covar_pop(F.get("whitened", F.lit(a)), F.get("whitened", F.lit(b))) for a, b in pairs]
    found = white.agg(*[e.alias(f"e{k}") for k, e in enumerate(entries)]).first()
    return max((abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True)), default=0.0)


def whiten(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    components: int = 8,
    scale: int = 1024,
    shift: int = 100_000,
) -> DataFrame:
    """For each usable vector and component: id, component (from 1), n, deviation,
    whitened, explained and identity_error.

    Rows whose vector is null or has null or non-finite entries are left out; all others
    are in the fit, each as often as it is repeated. A vector shorter than the longest
    has zeros for the entries it lacks. Entries become floor(scale * c) + shift; an entry
    of 2^40 or more after that is an error. Components without variance give no rows, so
    one vector, equal ones or an empty table give an empty result. `deviation` is null
    where it does not fit 64 bits. Rows without an id stay; columns other than the two
    are not read, whatever their names.

    The vectors are read twice, to fit and to project, without a shuffle of them. The
    numbers of a task and of the driver grow with the square of the vectors' length only.
    """
    spark = vectors.sparkSession
    model = fit(vectors, vector_col, components, scale, shift)
    made = project(vectors, model, id_col, vector_col)
    path = scratch_path(spark, "whitened")
    made.write.parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    error = _identity_error(made, len(model.explained)) if model.explained else 0.0
    if not math.isfinite(error):
        raise ValueError("the whitened values are not finite")
    shares = F.array(*map(F.lit, model.explained)) if model.explained else F.array().cast("array<double>")
    rows = made.select("id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        F.col("id").alias(id_col),
        (F.col("k") + 1).alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
