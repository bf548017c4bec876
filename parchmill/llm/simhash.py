"""SimHash fingerprints of whole texts, and search among them by Hamming distance.

A term is a run of two words (the only word, if a text has one); words are runs of
ASCII letters, digits and non-ASCII characters, A-Z as a-z. Every occurrence of a term
votes on each of 64 bits, for it where the term's hash has a one and against it
otherwise, with the term's length in bytes, up to MAX_WEIGHT, as its weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.llm.arrays import LOWER, shingle_hashes, split_words, text_slices, word_hashes
from parchmill.session import scratch_path

BITS = 64
MAX_WEIGHT = 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
# The bits of each byte value, most significant first.
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.float64)


def fingerprints(column: pa.Array) -> np.ndarray:
    """A 64-bit fingerprint of each text; 0 for null, empty and wordless ones."""
    found = []
    for texts in text_slices(column):
        words = split_words(texts, _IN_WORD)
        hashes = word_hashes(texts.data, words, LOWER)
        terms, at = shingle_hashes(hashes, words.offsets, 2)
        per_row = np.diff(at)
        row = np.repeat(np.arange(texts.rows), per_row)
        first = np.arange(len(terms)) - at[row] + words.offsets[row]
        last = np.minimum(first + 1, words.offsets[1:][row] - 1)
        weight = np.minimum(words.end[last] - words.start[first], MAX_WEIGHT).astype(np.float64)
        half = np.bincount(row, weight, texts.rows) / 2
        ones = np.empty((texts.rows, BITS))
        for k, part in enumerate(terms.astype(">u8").view(np.uint8).reshape(-1, 8).T):
            by_value = np.bincount(row * 256 + part, weight, texts.rows * 256)
            ones[:, 8 * k : 8 * k + 8] = by_value.reshape(texts.rows, 256) @ _BYTE_BITS
        packed = np.packbits(ones > half[:, None], axis=1)
        found.append(packed.view(">u8").ravel().astype(np.uint64))
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - np.bitwise_count(a ^ b) / BITS


def fingerprint(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id and `fingerprint` (16 hexadecimal digits) of every whole text, in one pass.

    Null and empty texts have the fingerprint of no votes, all zeros. Other columns
    are not read; repeated rows give repeated rows, an empty table an empty result. Of a
    very long text a task holds some 50 bytes a byte.
    """
    taken = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = taken.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [f"{x:016x}" for x in fingerprints(batch.column(1)).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, pa.string())], ["id", "fingerprint"]
            )

    made = taken.mapInArrow(run, f"id {kind}, fingerprint string")
    return made.select(F.col("id").alias(id_col), "fingerprint")


_COLUMNS = (
    "part int, kind string, id {kind}, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, text string"
)
_NAMES = [c.split()[0] for c in _COLUMNS.split(", ")]


def _compared(part: int, ids: pa.Array, texts: list[str], marks: np.ndarray) -> pa.RecordBatch:
    """Results of all rows but the last, whose successors are the rows after them."""
    edited, n_chars = [], []
    for text, following in zip(texts[:-1], texts[1:], strict=True):
        cut = len(text) // 3
        edited.append(text[: len(text) - cut] + following[:cut])
        n_chars.append(len(text))
    made = fingerprints(pa.array(edited, pa.large_string()))
    n = len(edited)
    columns = [
        pa.array([part] * n, pa.int32()),
        pa.array(["row"] * n, pa.string()),
        ids,
        pa.array(n_chars, pa.int64()),
        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
        pa.array([f"{x:016x}" for x in marks[:-1].tolist()], pa.string()),
        pa.array([f"{x:016x}" for x in made.tolist()], pa.string()),
        pa.array(_likeness(marks[:-1], made), pa.float64()),
        pa.array(_likeness(marks[:-1], marks[1:]), pa.float64()),
        pa.nulls(n, pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _edge(part: int, kind: str, id_value: pa.Array, text: str) -> pa.RecordBatch:
    """A row at the end of a partition, with its text, to be finished later."""
    nothing = [pa.nulls(1, t) for t in (pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2)]
    known = [pa.array([part], pa.int32()), pa.array([kind], pa.string()), id_value]
    return pa.RecordBatch.from_arrays([*known, *nothing, pa.array([text], pa.string())], _NAMES)


def _within_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row against the next; the first and the last row also as edges."""
    part = TaskContext.get().partitionId()
    id_before, text_before, mark_before = None, "", np.zeros(0, np.uint64)
    for batch in batches:
        for texts in text_slices(batch.column("text")):
            rows = batch.slice(texts.first, texts.rows)
            ids, column = rows.column("id"), rows.column("text")
            values = [t or "" for t in column.to_pylist()]
            marks = fingerprints(column)
            if id_before is None:
                yield _edge(part, "head", ids.slice(0, 1), values[0])
                known = ids.slice(0, len(ids) - 1)
            else:
                values = [text_before, *values]
                marks = np.concatenate([mark_before, marks])
                known = pa.concat_arrays([id_before, ids.slice(0, len(ids) - 1)])
            if len(known):
                yield _compared(part, known, values, marks)
            id_before = ids.slice(len(ids) - 1)
            text_before, mark_before = values[-1], marks[-1:]
    if id_before is not None:
        yield _edge(part, "open", id_before, text_before)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(len(batch)):
            row = batch.slice(k, 1)
            texts = [row.column(c)[0].as_py() or "" for c in ("text", "following")]
            yield _compared(0, row.column("id"), texts, fingerprints(pa.array(texts, pa.large_string())))


def compare_with_edits(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Fingerprints of each text and of an edited one, and how alike they are.

    The edited text is the text with its last third (rounded down, in code points)
    replaced by as many of the first code points of the next document, or all it has.
    Documents follow one another by descending id, then by a hash of the text; null
    ids come last, and the first follows the last. Columns: id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next, the
    share of equal bits with the edited text's and with the next document's.

    Null texts are empty. One document follows itself. An empty table gives an empty
    result. Other columns are not read.

    Texts are shuffled once, into ranges of ids, and streamed in order; a task holds a
    few megabytes of them and its longest one. Only the texts at the ends of ranges
    move again. Rows repeated exactly, whose order is all one, are dealt to several ranges
    by a random number that is the same whenever the scan is repeated.
    """
    spark = docs.sparkSession
    taken = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = taken.schema["id"].dataType.simpleString()
    order = [F.desc_nulls_last("id"), F.desc("hash"), F.asc("salt")]
    sorted_rows = (
        taken.withColumns({"hash": F.xxhash64("text"), "salt": F.rand(7)})
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("id", "text")
    )
    path = scratch_path(spark, "simhash")
    schema = _COLUMNS.format(kind=kind)
    sorted_rows.mapInArrow(_within_partition, schema).write.parquet(path)
    made = spark.read.schema(schema).parquet(path)

    heads = made.where("kind = 'head'").select("part", F.col("text").alias("following"))
    turn = Window.orderBy("part")  # one row a partition of the step before
    after = made.where("kind = 'head'").select(
        "part",
        F.coalesce(
            F.lead("part").over(turn),
            F.first("part").over(turn.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        ).alias("next"),
    )
    ends = (
        made.where("kind = 'open'")
        .select("part", "id", "text")
        .join(after, "part")
        .join(heads.withColumnRenamed("part", "next"), "next")
        .select("id", "text", "following")
    )
    everything = made.where("kind = 'row'").unionByName(ends.mapInArrow(_across, schema))
    return everything.select(F.col("id").alias(id_col), *_NAMES[3:9])


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def near_fingerprints(
    marks: DataFrame, radius: int = 3, blocks: int | None = None, queries: Column | None = None
) -> DataFrame:
    """Pairs of different fingerprints at most `radius` bits apart: x, y, distance.

    `marks` has one column `fingerprint` of 16 hexadecimal digits. Equal ones are taken
    once, so copies multiply nothing; nulls are left out. The 64 bits are cut into
    `blocks` (radius + 2 by default). Two fingerprints within the radius agree on
    `blocks - radius` blocks at least, so there is a table for each choice of that
    many, keyed by their bits: the permuted tables of the method. Candidates meet by
    an equal key only and are compared in full. Without `queries` each pair is given
    once, x < y as numbers; with it, a condition on `marks`, x runs over the
    fingerprints that fulfil it and y over all others.
    """
    blocks = blocks or radius + 2
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must be above radius, which is 0 at least")
    edges = [round(BITS * k / blocks) for k in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - radius):
        bits = sum((1 << edges[k + 1]) - (1 << edges[k]) for k in chosen)
        masks.append(bits - (1 << BITS) if bits >> (BITS - 1) else bits)

    asked = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = marks.where(F.col("fingerprint").isNotNull())
    rows = rows.select("fingerprint", asked.cast("int").alias("asked"))
    rows = rows.groupBy("fingerprint").agg(F.max("asked").alias("asked"))
    high = F.conv(F.substring("fingerprint", 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring("fingerprint", 9, 8), 16, 10).cast("long")
    rows = rows.select(F.shiftleft(high, 32).bitwiseOR(low).alias("n"), "asked")

    keys = F.array(
        *[
            F.struct(F.lit(k).alias("table"), F.col("n").bitwiseAND(F.lit(m)).alias("key"))
            for k, m in enumerate(masks)
        ]
    )
    keyed = rows.select("n", "asked", F.inline(keys))
    left = keyed.where("asked = 1").select("table", "key", F.col("n").alias("x"))
    right = keyed.select("table", "key", F.col("n").alias("y"))
    other = F.col("x") < F.col("y") if queries is None else F.col("x") != F.col("y")
    found = left.join(right, ["table", "key"]).where(other & (hamming(F.col("x"), F.col("y")) <= radius))
    as_text = {c: F.lpad(F.lower(F.hex(c)), 16, "0") for c in ("x", "y")}
    found = found.select("x", "y").distinct()
    distance = hamming(F.col("x"), F.col("y")).alias("distance")
    return found.select(*[as_text[c].alias(c) for c in ("x", "y")], distance)
