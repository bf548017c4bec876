"""Near-duplicates by circulant MinHash, with exact Jaccard verification.

Two permutations of a universe of UNIVERSE slots give the whole signature: the first
scatters a shingle's slot, the second, read circularly from there, gives its value at
every coordinate. So a shingle's values are one contiguous slice of one table.
Coordinates are cut into bands; documents that agree in a band are candidates, and
only pairs whose full shingle sets are similar enough are links.

Stages, each written to the shared folder where a later one reads it more than once:

1. per document: size and digest of its shingle set, one key a band (one scan);
2. documents of equal sets become one class, named by its smallest row;
3. in each band bucket, every class is compared with the bucket's smallest: as many
   pairs as rows, however large the bucket. What this links becomes components;
4. members of buckets that still hold several components are searched across them,
   by their rarest shingles, so no similar pair of different components is left;
5. components of all links, joined back to the documents.

Rows have numbers of their own (rows.numbered), as ids may be missing or repeated. The
sets of candidates are made in a second scan. A bitmap of some bits a candidate tells
which rows may be candidates, so the texts are not shuffled for that; from MOST_BITS on
it no longer grows, and the sets that it lets through in vain are dropped by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.arrays import mixed, shingle_hashes, split_words, text_slices, word_hashes
from parchmill.llm.components import connected_components
from parchmill.llm.rows import numbered
from parchmill.session import scratch_path

UNIVERSE = 1 << 20
BITS_EACH = 16  # of the bitmap, for each candidate
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28  # 32 MB at most

# Words are runs of anything but space and the ASCII controls from tab to return.
_IN_WORD = np.ones(256, bool)
_IN_WORD[[32, *range(9, 14)]] = False


@lru_cache(maxsize=2)
def _permutations(coordinates: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and the circular one as overlapping slices."""
    rng = np.random.Generator(np.random.PCG64(seed))
    scatter = rng.permutation(UNIVERSE).astype(np.uint32)
    ring = rng.permutation(UNIVERSE).astype(np.uint32)
    ring = np.concatenate([ring, ring[:coordinates]])
    return scatter, np.lib.stride_tricks.sliding_window_view(ring, coordinates)


def signature(shingles: np.ndarray, coordinates: int, seed: int) -> np.ndarray:
    scatter, slices = _permutations(coordinates, seed)
    slots = scatter[shingles & np.uint64(UNIVERSE - 1)]
    out = np.full(coordinates, UNIVERSE, np.uint32)
    for k in range(0, len(slots), 1024):
        np.minimum(out, slices[slots[k : k + 1024]].min(axis=0), out=out)
    return out


def _sets(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted distinct shingle hashes of that row and those after it)."""
    for texts in text_slices(column):
        words = split_words(texts, _IN_WORD)
        hashes, at = shingle_hashes(word_hashes(texts.data, words), words.offsets, width)
        yield texts.first, [np.unique(hashes[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]


def _arrays(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def signatures(
    docs: DataFrame, width: int, bands: int, rows: int, seed: int
) -> DataFrame:
    """id, doc, n_shingles, a 128-bit digest of the shingle set, and a key for each band.

    `docs` has columns id, text and doc. A document without words has no bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weigh = mixed(np.arange(1, rows + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)
        number = mixed(np.arange(bands, dtype=np.uint64) + np.uint64(0xB5))
        none = np.zeros(0, np.uint64)
        for batch in batches:
            for first, sets in _sets(batch.column("text"), width):
                keys, sizes, one, two = [], [], [], []
                for s in sets:
                    sizes.append(len(s))
                    one.append(int(s.sum(dtype=np.uint64)))
                    two.append(int(mixed(s ^ np.uint64(0xA24BAED4963EE407)).sum(dtype=np.uint64)))
                    if len(s):
                        made = signature(s, bands * rows, seed).reshape(bands, rows)
                        keys.append(mixed((made * weigh).sum(axis=1, dtype=np.uint64) + number))
                    else:
                        keys.append(none)
                named = [batch.column(c).slice(first, len(sets)) for c in ("id", "doc")]
                digests = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
                columns = [*named, pa.array(sizes, pa.int64()), *digests, _arrays(keys)]
                yield pa.RecordBatch.from_arrays(columns, _SIGNATURE)

    kind = docs.schema["doc"].dataType.simpleString()
    fields = f"id long, doc {kind}, n_shingles long, set_a long, set_b long, bands array<long>"
    return docs.select("id", "doc", "text").mapInArrow(run, fields)


_SIGNATURE = ["id", "doc", "n_shingles", "set_a", "set_b", "bands"]


def _bitmap(ids: DataFrame) -> tuple[bytes, int]:
    """Bits of the ids' hashes, gathered in pieces by Spark, and how many bits there are."""
    bits = LEAST_BITS
    most = min(ids.count() * BITS_EACH, MOST_BITS)
    while bits < most:
        bits *= 2
    rows = (
        ids.select(F.expr(f"pmod(xxhash64(id), {bits}L)").alias("bit"))
        .groupBy(F.expr("bitmap_bucket_number(bit)").alias("piece"))
        .agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
        .collect()
    )
    step = 32768 // 8
    out = bytearray(bits // 8 + step)
    for row in rows:  # pieces count from 1 for the bits from 1 on, and bit 0 is in piece 0
        at = row["piece"] * step
        out[at : at + step] = row["bits"]
    return bytes(out), bits


def _candidate_sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id and sorted shingle set of the documents that `ids` (distinct ones) names."""
    held, bits = _bitmap(ids)
    asked = docs.select("id", "text").withColumn("piece", F.expr(f"bitmap_bucket_number(pmod(xxhash64(id), {bits}L))"))
    asked = asked.withColumn("bit", F.expr(f"bitmap_bit_position(pmod(xxhash64(id), {bits}L))"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = np.frombuffer(held, np.uint8)
        for batch in batches:
            at = batch.column("piece").to_numpy() * 32768 + batch.column("bit").to_numpy()
            wanted = pa.array((have[at >> 3] >> (at & 7)) & 1 == 1)
            some = batch.filter(wanted)
            for first, sets in _sets(some.column("text"), width):
                ids = some.column("id").slice(first, len(sets))
                yield pa.RecordBatch.from_arrays([ids, _arrays(sets)], ["id", "shingles"])

    sets = asked.mapInArrow(run, "id long, shingles array<long>")
    return sets.join(ids, "id", "left_semi") if bits == MOST_BITS else sets


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets share at least `percent` per cent of their union."""

    def side(end: str) -> DataFrame:
        return sets.select(F.col("id").alias(end), F.col("shingles").alias(f"{end}_set"))

    both = pairs.join(side("x"), "x").join(side("y"), "y")
    shared = F.size(F.array_intersect("x_set", "y_set"))
    union = F.size("x_set") + F.size("y_set") - shared
    return both.where(100 * shared >= percent * union).select("x", "y")


def _close_sizes(percent: int, a: str, b: str):
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _across_components(
    members: DataFrame, sets: DataFrame, percent: int, stored: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """Pairs x, y of `members` (id, n, component) of different components that may be
    similar enough: none that is similar enough is left out.

    With all shingles in one order, the rarest first, similar sets share one of their
    first few, from which on either has enough left for the whole overlap. In a group of
    near copies the first shingles are the ones that its edits made, so members that
    differ too much do not meet, however large the group. Where a shingle does have many
    members, those of its most frequent component are met by the others only.
    """
    shingle = members.join(sets, "id").select("id", "n", "component", F.explode("shingles").alias("s"))
    spread = shingle.groupBy("s").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    listed = shingle.join(spread, "s").groupBy("id", "n", "component")
    listed = listed.agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("c"))
    # Shingles of no other member come first of all; `at` counts them.
    alone = F.col("n") - F.size("c")
    least = F.ceil(F.col("n") * percent / 100)
    few = F.greatest(F.col("n") - least + 1 - alone, F.lit(0)).cast("int")
    first = listed.select("id", "n", "component", alone.alias("alone"), F.posexplode(F.slice("c", F.lit(1), few)))
    first = first.select(
        "id", "n", "component", F.col("col.s").alias("s"), (F.col("alone") + F.col("pos")).alias("at")
    )
    first = stored(first, "prefixes")
    counts = first.groupBy("s", "component").agg(F.count(F.lit(1)).alias("k"))
    most = counts.groupBy("s").agg(F.max_by("component", "k").alias("most"), F.count(F.lit(1)).alias("several"))
    first = first.join(most.where("several > 1").select("s", "most"), "s")
    others = first.where("component != most").drop("most")
    named = [F.col(c).alias(f"{c}2") for c in ("id", "n", "component", "at")]
    needed = percent * (F.col("n") + F.col("n2"))  # of (100 + percent) times the overlap
    left = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2"))
    return (
        others.join(first.select("s", *named), "s")
        .where(F.col("component") != F.col("component2"))
        .where((100 + percent) * left >= needed)
        .select(F.greatest("id", "id2").alias("x"), F.least("id", "id2").alias("y"))
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    seed: int = 1,
    row_col: str | None = None,
) -> DataFrame:
    """For each row its id, n_shingles, component_id and kept.

    Words are runs of anything but ASCII white space, A-Z as a-z; the shingles of a
    text are its distinct runs of `width` words, or its whole sequence if it has
    fewer. Two documents are linked if their sets share at least `percent` per cent of
    their union; component_id is the smallest id reachable over links, and kept marks
    the row whose id that is. With the defaults, a pair of exactly that similarity is
    missed with a chance of 3 in a million; links are never wrong.

    Null or wordless texts have 0 shingles and are linked with nothing. Rows are
    compared, not ids: rows without an id link others as well, and two texts under one
    id are two documents. component_id is null where a component has no id at all, and
    kept false in a row without one. Repeated rows stay, each with the same result. Of a
    very long text a task holds some 30 bytes a byte. Columns other than the two are not
    read, whatever their names; `row_col` may name a long that tells rows apart, else
    they are numbered. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    taken = [F.col(f"`{id_col}`").alias("doc"), F.col(f"`{text_col}`").alias("text")]
    if row_col is None:
        docs = numbered(docs, *taken, key="id")
    else:
        docs = docs.select(*taken, F.col(f"`{row_col}`").alias("id"))

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, f"minhash-{label}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    made = stored(signatures(docs, width, bands, rows, seed), "signatures")
    nonempty = made.where("n_shingles > 0")
    classes = nonempty.groupBy("set_a", "set_b").agg(F.min("id").alias("class"), F.min("doc").alias("least"))
    named = made.join(classes.select(F.col("class").alias("id")).distinct(), "id", "left_semi")
    keyed = named.where("n_shingles > 0").select(
        "id", F.col("n_shingles").alias("n"), F.explode("bands").alias("key")
    )
    pivots = keyed.groupBy("key").agg(
        F.min("id").alias("pivot"), F.min_by("n", "id").alias("pivot_n"), F.max("id").alias("last")
    )
    shared = stored(
        keyed.join(pivots.where(F.col("pivot") != F.col("last")).drop("last"), "key"), "buckets"
    )

    pairs = shared.where((F.col("id") != F.col("pivot")) & _close_sizes(percent, "n", "pivot_n"))
    pairs = pairs.select(F.col("id").alias("x"), F.col("pivot").alias("y")).distinct()
    sets = stored(_candidate_sets(docs, shared.select("id").distinct(), width), "sets")
    links = stored(_links(pairs, sets, percent), "links")
    reached = connected_components(links)

    placed = shared.join(reached, F.col("id") == F.col("vertex"), "left").select(
        "key", "id", "n", F.coalesce("component", "id").alias("component")
    )
    ends = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b"))
    divided = placed.join(ends.where("a != b").select("key"), "key")
    divided = divided.select("id", "n", "component").distinct()
    rest = stored(_across_components(divided, sets, percent, stored), "rest")
    rest = rest.join(pairs, ["x", "y"], "left_anti")
    more = _links(rest, sets, percent)
    stars = reached.select(F.col("vertex").alias("x"), F.col("component").alias("y"))
    reached = connected_components(stars.unionAll(more))

    placed = classes.join(reached, F.col("class") == F.col("vertex"), "left").select(
        "set_a", "set_b", "least", F.coalesce("component", "class").alias("its")
    )
    named = placed.groupBy(F.col("its").alias("component")).agg(F.min("least").alias("component_id"))
    placed = placed.join(named, F.col("its") == F.col("component"))
    # The empty set takes part in no class; its digest is zero and joins with nothing.
    mine = (F.col("m.set_a") == F.col("c.set_a")) & (F.col("m.set_b") == F.col("c.set_b"))
    component = F.when(F.col("m.n_shingles") > 0, F.col("c.component_id")).otherwise(F.col("m.doc"))
    return (
        made.select("doc", "n_shingles", "set_a", "set_b")
        .alias("m")
        .join(placed.alias("c"), mine, "left")
        .select(
            F.col("m.doc").alias(id_col),
            "m.n_shingles",
            component.alias("component_id"),
            F.coalesce(F.col("m.doc") == component, F.lit(False)).alias("kept"),
        )
    )
