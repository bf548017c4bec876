"""Exact top-k by inner product, with distributed histogram selection.

Every query is scored against every candidate, block by block, several times. The
first times only histograms of the scores come out: they are summed over all tasks,
the interval that holds a query's kth score is found and becomes the range of the next,
finer histogram, until it is one value wide. The last time the scores above that value
come out, and of those equal to it the ones with the smallest ids.

Vectors hold whole numbers, so scores are exact. Blocks of queries meet blocks of
candidates through a shuffle on a slice number; a task holds one block of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.llm.rows import numbered
from parchmill.session import scratch_path

BINS = 256
QUERY_BLOCK = 256
BLOCK = 1024
_HELD = 32  # histograms of so many query blocks are summed before they leave a task


def whole_vector(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of every component, as double numbers; null for vectors that are
    null or hold null or non-finite components."""
    as_double = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(as_double, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(as_double, lambda x: F.floor(x * scale).cast("long")))


def _pack(size: int, slices: int):
    """Rows (key, id, vector) to blocks of equal length of vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId()
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for length in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == length))
                for k in range(0, len(rows), size):
                    part = rows.slice(k, size)
                    made += 1
                    lists = [part.column("key"), part.column("id"), part.column("vector").flatten()]
                    arrays = [
                        pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in lists
                    ]
                    head = [pa.array([x], pa.int32()) for x in (made % slices, int(length))]
                    yield pa.RecordBatch.from_arrays(
                        [*head, *arrays], ["slice", "length", "keys", "ids", "values"]
                    )

    return run


_BLOCKS = "slice int, length int, keys array<long>, ids array<long>, values array<long>"


def _list(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products: by floating point where it is exact, else by whole numbers."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if reach < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def _scored(batches: Iterator[pa.RecordBatch]):
    """(query keys, low ends, widths, wanted, candidate ids, scores, own) by block pair."""
    for batch in batches:
        for row in range(len(batch)):
            length = batch.column("length")[row].as_py()
            keys, ids, others = (_list(batch, c, row) for c in ("keys", "c_ids", "c_keys"))
            q = _list(batch, "values", row).reshape(len(keys), length)
            c = _list(batch, "c_values", row).reshape(len(ids), length)
            own = keys[:, None] == others
            state = (_list(batch, name, row) for name in ("low", "width", "wanted"))
            yield keys, *state, ids, _scores(q, c), own


def _histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by query and bin, from the top down to where the task's own counts reach
    what is wanted: no lower bin can hold the kth score of all."""
    held: dict[int, tuple] = {}

    def drained():
        for keys, wanted, counts in held.values():
            from_top = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
            above = from_top - counts
            row, at = np.nonzero((counts > 0) & (above < wanted[:, None]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[row]), pa.array(at.astype(np.int32)), pa.array(counts[row, at])],
                ["key", "bin", "n"],
            )
        held.clear()

    for keys, low, width, wanted, _, scores, own in _scored(batches):
        at = (scores - low[:, None]) // width[:, None]
        inside = (at >= 0) & (at < BINS) & ~own
        flat = (np.arange(len(keys))[:, None] * BINS + at)[inside]
        counts = np.bincount(flat, minlength=len(keys) * BINS).reshape(len(keys), BINS)
        first = int(keys[0])
        if first in held:
            held[first][2][:] += counts
        else:
            held[first] = (keys, wanted, counts)
        if len(held) >= _HELD:
            yield from drained()
    yield from drained()


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scores above each query's kth, and of those equal to it as many as are wanted."""
    for keys, low, _, wanted, ids, scores, own in _scored(batches):
        by_id = np.argsort(ids, kind="stable")
        above = (scores > low[:, None]) & ~own
        equal = ((scores == low[:, None]) & ~own)[:, by_id]
        equal &= np.cumsum(equal, axis=1) <= wanted[:, None]
        row, at = np.nonzero(above)
        row2, at2 = np.nonzero(equal)
        row, at = np.concatenate([row, row2]), np.concatenate([at, by_id[at2]])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[row]), pa.array(ids[at]), pa.array(scores[row, at])],
            ["key", "vec_id", "score"],
        )


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    slices: int | None = None,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the k best candidates of each query.

    Components x become floor(scale * x); the score is the inner product, as a long.
    Queries are the rows for which `is_query` holds; candidates are all rows but the
    query's own, others of its id among them. Equal scores go to the smaller id; with fewer than k candidates all are given.
    Rows take no part if their id or vector is null or a component is null or not
    finite; vectors of different lengths have no score. A repeated query row is a query
    of its own; repeated candidates are candidates each. Other columns are not read.
    An empty table gives an empty result. Vectors so long that a score may not fit a
    long raise ValueError.

    The queries' vectors travel once to each of `slices` (by default as many as shuffle
    partitions) and pass, the candidates' once a pass.
    """
    spark = vectors.sparkSession
    slices = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = numbered(
        vectors,
        F.col(f"`{id_col}`").cast("long").alias("id"),
        whole_vector(F.col(f"`{vector_col}`"), scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asked"),
    ).where("id IS NOT NULL AND vector IS NOT NULL")

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, f"topk-{label}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    longest = rows.agg(F.max(norm).alias("all"), F.max(F.when(F.col("asked"), norm)).alias("asked"))
    bounds = longest.first()
    reach = math.ceil((bounds["all"] or 0.0) * (bounds["asked"] or 0.0) * (1 + 1e-9)) + 1

    if reach >= 2**62:
        raise ValueError("scores of these vectors do not fit a long")
    blocks = stored(rows.mapInArrow(_pack(BLOCK, slices), _BLOCKS), "candidates")
    renamed = [F.col(c).alias(f"c_{c}") for c in ("keys", "ids", "values")]
    blocks = blocks.select("slice", "length", *renamed)
    asked = stored(rows.where("asked").select("key", "id", "vector"), "queries")
    packed = stored(asked.mapInArrow(_pack(QUERY_BLOCK, slices), _BLOCKS), "query-blocks")
    # Each query's range: `wanted` of its k best lie in it, the others above.
    width = 1
    while width * BINS < 2 * reach + 1:
        width *= BINS
    state = asked.select(
        "key", F.lit(-reach).alias("low"), F.lit(width).alias("width"), F.lit(k).alias("wanted")
    ).select("key", *[F.col(c).cast("long").alias(c) for c in ("low", "width", "wanted")])

    def met(state: DataFrame) -> DataFrame:
        """Every block of queries, with its ranges, beside every block of candidates."""
        listed = packed.select("*", F.posexplode("keys").alias("at", "key")).drop("keys")
        ranged = listed.join(state, "key")
        entry = F.struct("at", "key", "low", "width", "wanted")
        ranged = ranged.groupBy("block").agg(F.array_sort(F.collect_list(entry)).alias("s"))
        lists = [F.col(f"s.{c}").alias(c) for c in ("low", "width", "wanted")]
        both = packed.join(ranged.select("block", *lists), "block").drop("slice", "block")
        spread = both.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        return blocks.join(spread, ["slice", "length"])

    packed = packed.withColumn("block", F.element_at("keys", 1))
    while True:
        found = met(state).mapInArrow(_histograms, "key long, bin int, n long")
        counts = found.groupBy("key", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("key").orderBy(F.desc("bin"))
        counts = counts.withColumn("reached", F.sum("n").over(down))
        hit = counts.join(state.select("key", "wanted"), "key").where("reached >= wanted")
        hit = hit.groupBy("key").agg(
            F.max("bin").alias("bin"), F.max_by(F.col("reached") - F.col("n"), "bin").alias("above")
        )
        finer = max(1, width // BINS)
        # A query with fewer candidates than k keeps the low end, and so gets them all.
        state = stored(
            state.join(hit, "key", "left").select(
                "key",
                (F.col("low") + F.coalesce("bin", F.lit(0)) * F.col("width")).alias("low"),
                F.lit(finer).cast("long").alias("width"),
                (F.col("wanted") - F.coalesce("above", F.lit(0))).alias("wanted"),
            ),
            "state",
        )
        if width == 1:
            break
        width = finer
    found = met(state).mapInArrow(_chosen, "key long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    named = best.join(asked.select("key", F.col("id").alias("query_id")), "key")
    return named.select("query_id", "rank", "vec_id", "score")
