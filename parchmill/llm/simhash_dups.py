"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Every distinct fingerprint emits all variants of itself within half the radius. Two
fingerprints within the radius have a variant in common, so a shuffle on variants brings
them together; what meets there is verified in full. Copies share a fingerprint and are
one vertex, so a group of copies, however large, emits one ball.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.llm.arrays import LOWER, Texts, Words, split_words, text_slices
from parchmill.llm.components import connected_components
from parchmill.session import scratch_path

BITS = 64
_SLICE = 1 << 20  # bytes of text at once
_AT_ONCE = 1 << 15  # shingles whose bits are counted at once

# Words are runs of anything but space and the ASCII controls from tab to return.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False


def _joined(texts: Texts, words: Words) -> tuple[memoryview, np.ndarray, np.ndarray]:
    """The words in lower case with one space after each, and their new ends."""
    size = words.end - words.start
    keep = np.zeros(len(texts.data) + 1, np.int8)
    keep[words.start] = 1
    keep[words.end] -= 1
    inside = np.cumsum(keep[:-1], dtype=np.int8).astype(bool)
    start = np.concatenate([[0], np.cumsum(size + 1)[:-1]]) if len(size) else size
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    blank = np.zeros(len(out), bool)
    blank[start + size] = True
    out[~blank] = LOWER[texts.data[inside]]
    return memoryview(out.tobytes()), start, start + size


def _shingles(texts: Texts, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of `width` words (of all words, if there are fewer) and the
    offsets of each row's runs."""
    words = split_words(texts, _IN_WORD)
    data, start, end = _joined(texts, words)
    counts = np.diff(words.offsets)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(runs)])
    row = np.repeat(np.arange(texts.rows), runs)
    first = np.arange(offsets[-1]) - offsets[row] + words.offsets[row]
    last = np.minimum(first + width, words.offsets[1:][row]) - 1
    digest = xxhash.xxh64_intdigest
    places = zip(start[first].tolist(), end[last].tolist(), strict=True)
    return np.fromiter((digest(data[a:b], seed) for a, b in places), np.uint64, len(first)), offsets


def fingerprints(column: pa.Array, width: int = 3, seed: int = 42) -> np.ndarray:
    """A 64-bit fingerprint of each text: a bit is one if it is set in the hashes of more
    than half of the text's shingles. Texts without words have 0."""
    found = []
    for texts in text_slices(column, _SLICE):
        hashes, offsets = _shingles(texts, width, seed)
        ones = np.zeros((texts.rows, BITS), np.int64)
        for k in range(0, len(hashes), _AT_ONCE):
            part = hashes[k : k + _AT_ONCE]
            bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            rows = np.searchsorted(offsets, [k, k + len(part) - 1], "right") - 1
            here = np.arange(rows[0], rows[1] + 1)
            here = here[np.diff(offsets)[here] > 0]
            begins = np.maximum(offsets[here] - k, 0)
            ones[here] += np.add.reduceat(bits, begins, axis=0, dtype=np.int64)
        packed = np.packbits(2 * ones > np.diff(offsets)[:, None], axis=1)
        found.append(packed.view(">u8").ravel().astype(np.uint64))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def fingerprint(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, seed: int = 42
) -> DataFrame:
    """Columns id and mark (the fingerprint as a signed long) of every whole text."""
    taken = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = fingerprints(batch.column(1), width, seed).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks)], ["id", "mark"])

    kind = taken.schema["id"].dataType.simpleString()
    return taken.mapInArrow(run, f"id {kind}, mark long")


def ball(mark: Column, radius: int) -> Column:
    """All values that differ from `mark` in at most `radius` bits, itself among them."""
    masks = [sum(1 << b for b in bits) for k in range(radius + 1) for bits in combinations(range(BITS), k)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    return F.transform(F.array(*map(F.lit, signed)), lambda m: mark.bitwiseXOR(m))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_links(marks: DataFrame, radius: int = 2) -> DataFrame:
    """Pairs x, y of the distinct values of `marks` (one column of longs) that join the
    same values as all pairs at most `radius` bits apart do. Every pair is such a pair.

    A bucket holds the values that emitted one variant: a ball at most, 65 for a radius
    of 2. With an even radius all of them are within the radius of one another, so each
    is linked with the bucket's smallest; with an odd one all pairs of the bucket are
    compared. The radius is at most 4, where a ball is 2,081 variants.
    """
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4")
    mark = F.col(f"`{marks.columns[0]}`").alias("x")
    # A ball is many rows: few small partitions become large ones, so none are joined here.
    parts = int(marks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = marks.select(mark).where(F.col("x").isNotNull()).distinct().repartition(parts)
    emitted = values.select("x", F.explode(ball(F.col("x"), (radius + 1) // 2)).alias("variant"))
    # Hardly any variant comes twice from one task: gathering before the shuffle is in vain.
    buckets = emitted.repartition("variant").groupBy("variant").agg(F.collect_list("x").alias("met")).where(F.size("met") > 1)
    if radius % 2 == 0:
        centre = buckets.select(F.array_min("met").alias("y"), F.explode("met").alias("x"))
    else:
        centre = buckets.select(F.explode("met").alias("y"), "met").select("y", F.explode("met").alias("x"))
    pairs = centre.where((F.col("x") > F.col("y")) & (distance(F.col("x"), F.col("y")) <= radius))
    return pairs.select("x", "y").distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    radius: int = 2,
    width: int = 3,
    seed: int = 42,
) -> DataFrame:
    """For each row its id, fingerprint (16 hexadecimal digits) and component_id.

    Words are runs of anything but ASCII white space, A-Z as a-z. A text's shingles are
    all its runs of `width` words, repeats included; one with fewer words has its whole
    sequence as the only one. Documents are linked if their fingerprints differ in at
    most `radius` bits; component_id is the smallest id reachable over links.

    Null, empty and wordless texts have the fingerprint zero and are linked like any
    other. Rows without an id link others as well; where a component has no id at all,
    component_id is null. Repeated rows stay. Of a very long text a task holds the words
    once more and one hash a word. Columns other than the two are not read, whatever
    their names. An empty table gives an empty result.

    The graph is one of fingerprints: its size follows the distinct ones. Ids come in
    through a minimum by fingerprint, combined before the shuffle, and an ordinary join
    that Spark may split where one fingerprint has many documents.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "simhash-marks")
    made = fingerprint(docs, id_col, text_col, width, seed)
    made.write.parquet(path)
    made = spark.read.schema(made.schema).parquet(path)
    held = made.groupBy("mark").agg(F.min("id").alias("least"))
    reached = connected_components(near_links(held.select("mark"), radius))
    # Vertices that reach no smaller one are their own component.
    placed = held.join(reached, F.col("mark") == F.col("vertex"), "left").select(
        F.col("mark").alias("m"), "least", F.coalesce("component", "mark").alias("component")
    )
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    named = placed.join(least, "component").select("m", "component_id")
    return made.join(named, F.col("mark") == F.col("m")).select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("mark")), 16, "0").alias("fingerprint"), "component_id"
    )
