"""Texts to token rows of one fixed length."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parchmill.functions.text import WHITESPACE
from parchmill.operators.heavy import Summary
from parchmill.operators.slices import text_slices
from parchmill.operators.subwords import PieceTrie
from parchmill.session import batches_of, scratch_path

# White space of any script; the four separators are not in Java's class.
_SPLIT = r"(?U)[\s\x1c-\x1f]+"

# Words that are at least one in so many of all words in the texts are spread over salts
# when a vocabulary is joined.
_FREQUENT = 1000
_SALTS = 64
_ADDED = ("input_ids", "attention_mask")
# Of rows sent to Python at once when a vocabulary is joined.
_BATCH_BYTES = 4 << 20


class RepeatedToken(ValueError):
    """A vocabulary gives one token several ids."""


def _unique(vocabulary: DataFrame) -> DataFrame:
    repeated = vocabulary.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").head(1)
    if repeated:
        raise RepeatedToken(f"{repeated[0]['token']!r} occurs {repeated[0]['n']} times")
    return vocabulary.select("token", F.col("id").cast("int").alias("id"))


def words(text: Column, length: int) -> Column:
    """The first `length` white-space separated words, which are all that
    truncation to `length` tokens keeps."""
    cut = F.split(F.btrim(text, F.lit(WHITESPACE)), _SPLIT, length + 1)
    return F.slice(F.filter(cut, lambda w: w != ""), 1, length)


def fixed_length(ids: Column, length: int, pad_id: int) -> list[Column]:
    """input_ids cut or right-padded to `length`, and the attention_mask."""
    kept = F.slice(ids, 1, length)
    n = F.size(kept)
    return [
        F.concat(kept, F.array_repeat(F.lit(pad_id).cast("int"), F.lit(length) - n)).alias(
            "input_ids"
        ),
        F.concat(
            F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), F.lit(length) - n)
        ).alias("attention_mask"),
    ]


def encode_fixed_length(
    df: DataFrame,
    text: str,
    tokenise: Callable[[Column], Column],
    length: int = 2048,
    pad_id: int = 0,
) -> DataFrame:
    """Add input_ids and attention_mask, both of `length` entries; columns of these names
    are replaced, all others stay.

    `tokenise` maps a string column to an array<int> column: a pandas or Arrow
    UDF around any tokeniser, `vocabulary_tokeniser` or `subword_tokeniser`. One narrow
    stage; the padding comes last, so no shuffle ever carries it.
    """
    rows = df.select(F.struct(*map(_quoted, df.columns)).alias("row"), tokenise(F.col(_quoted(text))).alias("ids"))
    return rows.select(*_others(df), *fixed_length(F.col("ids"), length, pad_id))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _others(df: DataFrame) -> list[Column]:
    """The columns of a row kept as `row`, but for those that encoding adds."""
    return [F.col(f"row.{_quoted(c)}") for c in df.columns if c.lower() not in _ADDED]


def shipped_vocabulary(vocabulary: DataFrame) -> pa.Table:
    """(token, id) on the driver, to go to every task: for vocabularies of a size that
    each task can hold. Tokens must be unique."""
    return _unique(vocabulary).toArrow()


class _Lookup:
    """Ids of words; the index is built once in a task, not with every batch."""

    def __init__(self, tokens: pa.Array, ids: pa.Array, unk_id: int):
        self.ids = dict(zip(tokens.to_pylist(), ids.to_pylist(), strict=True))
        self.unk_id = unk_id

    def __call__(self, words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()  # each distinct word is looked up once a slice
        found = [self.ids.get(w, self.unk_id) for w in coded.dictionary.to_pylist()]
        return pa.array(found, pa.int32()).take(coded.indices)


def vocabulary_tokeniser(
    vocabulary: pa.Table, unk_id: int, length: int
) -> Callable[[Column], Column]:
    """Split on white space, cut and look up, as an Arrow UDF: many rows at once, no
    row loop, no shuffle. A batch is worked on in slices of a megabyte of text, so a task's
    memory does not follow the batch.

    The join on words would move every word of the corpus twice; looking them up
    where the text already is moves none.
    """
    tokens = vocabulary["token"].combine_chunks()
    ids = vocabulary["id"].combine_chunks()

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        look_up = _Lookup(tokens, ids, unk_id)
        for texts in (some for batch in batches for some in text_slices(batch)):
            texts = pc.utf8_trim_whitespace(texts)
            texts = pc.if_else(pc.equal(texts, ""), pa.scalar(None, texts.type), texts)
            split = pc.utf8_split_whitespace(texts, max_splits=length)
            kept = pc.list_slice(split, 0, length)
            ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(kept), 0).cast(pa.int32()))
            offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            yield pa.ListArray.from_arrays(offsets, look_up(kept.flatten()))

    return encode


def subword_tokeniser(
    vocabulary: pa.Table, unk_id: int, length: int, continuation: str = "##", max_bytes: int | None = None
) -> Callable[[Column], Column]:
    """Split on white space, then cut every word into the longest pieces of the vocabulary
    from its left, as an Arrow UDF: slices of batches, no row loop, no shuffle.

    Pieces after a word's first are those that the vocabulary has with `continuation`
    before them. A word that cannot be cut to its end, or is longer than `max_bytes`, is
    `unk_id` as a whole. A text is cut to `length` pieces. The vocabulary goes to every
    task as a trie in arrays, some 20 bytes a byte of its tokens.
    """
    trie = PieceTrie.of(vocabulary["token"].to_pylist(), vocabulary["id"].to_pylist(), continuation)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in (some for batch in batches for some in text_slices(batch)):
            split = _split(texts, length)
            flat = split.flatten()
            coded = flat.dictionary_encode()  # each distinct word is cut once a slice
            ids, ends = trie.cut(coded.dictionary, unk_id, max_bytes)
            which = coded.indices.to_numpy(zero_copy_only=False)
            count = np.diff(ends)[which] if len(which) else np.zeros(0, np.int64)
            upto = np.concatenate([[0], np.cumsum(count)])
            row_ends = np.asarray(split.offsets, np.int64) - (split.offsets[0].as_py() if len(split) else 0)
            row_ends = upto[row_ends] if len(split) else np.zeros(1, np.int64)
            place = np.arange(upto[-1]) - np.repeat(upto[:-1], count) + np.repeat(ends[which] if len(which) else count, count)
            found = pa.ListArray.from_arrays(pa.array(row_ends.astype(np.int32)), pa.array(ids[place], pa.int32()))
            yield pc.list_slice(found, 0, length)

    return encode


def _split(texts: pa.Array, length: int) -> pa.ListArray:
    """The first `length` words of each text; none of a null or blank one."""
    texts = pc.fill_null(pc.utf8_trim_whitespace(texts), "")
    kept = pc.list_slice(pc.utf8_split_whitespace(texts, max_splits=length), 0, length)
    blank = pc.equal(texts, "")
    if not pc.any(blank).as_py():
        return kept
    sizes = pc.if_else(blank, 0, pc.list_value_length(kept)).to_numpy(zero_copy_only=False)
    words = kept.flatten().filter(pa.array(np.repeat(~blank.to_numpy(zero_copy_only=False), pc.list_value_length(kept).to_numpy())))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), words)


def encode_with_vocabulary(
    spark: SparkSession,
    df: DataFrame,
    text: str,
    vocabulary: DataFrame,
    unk_id: int,
    pad_id: int,
    length: int = 2048,
    ship: bool = True,
    subwords: bool = False,
) -> DataFrame:
    """Encode with a (token, id) table; a repeated token raises RepeatedToken.

    `subwords` cuts words into pieces (see subword_tokeniser), which needs `ship`. `ship` sends the vocabulary to every task, which must have room for it, and shuffles
    nothing; without it the words are joined with the vocabulary, whatever its size."""
    if subwords and not ship:
        raise ValueError("pieces of words are looked up in tasks: the vocabulary must be shipped")
    if ship:
        make = subword_tokeniser if subwords else vocabulary_tokeniser
        tokenise = make(shipped_vocabulary(vocabulary), unk_id, length)
        return encode_fixed_length(df, text, tokenise, length, pad_id)
    return encode_by_join(spark, df, text, vocabulary, unk_id, pad_id, length)


def encode_by_join(
    spark: SparkSession,
    df: DataFrame,
    text: str,
    vocabulary: DataFrame,
    unk_id: int,
    pad_id: int,
    length: int = 2048,
) -> DataFrame:
    """The same by a join on words, for a vocabulary too large to ship to every task.

    The rows are written once with their numbers, so that the numbers stay the
    same if a task runs again. In the same pass each task sums its words up (heavy.Summary);
    merged, the summaries name every word that is at least a thousandth of all, and two
    thousand words at most. These are spread over salts, and only their entries of the
    vocabulary are repeated. A group in the last step is one text cut to `length`
    words, so it is bounded.
    """
    path = scratch_path(spark, "encode")
    numbered = df.select(
        F.struct(*map(_quoted, df.columns)).alias("row"),
        F.col(_quoted(text)).alias("text"),
        F.monotonically_increasing_id().alias("key"),
    )

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _summed(batches, length)

    schema = StructType([*numbered.schema.fields, *StructType.fromDDL(f"heavy {_HEAVY}").fields])
    with batches_of(spark, _BATCH_BYTES):
        numbered.mapInArrow(summed, schema).write.parquet(path)
    kept = spark.read.schema(schema).parquet(path)

    summaries = kept.where("heavy IS NOT NULL").select("heavy")
    total = summaries.agg(F.coalesce(F.sum("heavy.total"), F.lit(0))).first()[0]
    counts = summaries.select(F.explode("heavy.words").alias("w")).groupBy("w.token").agg(F.sum("w.n").alias("n"))
    # A summary counts a word short by its total over its size at most.
    frequent = counts.where((F.col("n") + total / (2 * _FREQUENT)) * _FREQUENT >= total)
    frequent = [r["token"] for r in frequent.select("token").collect()]

    tokens = kept.select("key", F.posexplode(words(F.col("text"), length)).alias("pos", "token"))
    often = F.col("token").isin(frequent) if frequent else F.lit(False)
    salt = F.when(often, F.pmod(F.col("key") + F.col("pos"), F.lit(_SALTS))).otherwise(0)
    salts = F.when(often, F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
    spread = _unique(vocabulary).withColumn("salt", F.explode(salts))
    entry = F.struct("pos", F.coalesce("id", F.lit(unk_id)).alias("id"))
    ids = (
        tokens.withColumn("salt", salt.cast("int"))
        .join(spread, ["token", "salt"], "left")
        .groupBy(F.col("key").alias("of"))
        .agg(F.transform(F.sort_array(F.collect_list(entry)), lambda t: t["id"]).alias("ids"))
    )
    found = F.coalesce("ids", F.array().cast("array<int>"))
    joined = kept.select("row", "key").join(ids, F.col("key") == F.col("of"), "left")
    return joined.select(*_others(df), *fixed_length(found, length, pad_id))


def _summed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The rows, the last with a summary of the words of all."""
    summary, last = Summary(2 * _FREQUENT), None
    for batch in batches:
        for texts in text_slices(batch.column("text")):
            summary.add(_split(texts, length).flatten())
        if len(batch):
            if last is not None:
                yield _with_heavy(last, None)
            yield _with_heavy(batch.slice(0, len(batch) - 1), None)
            last = batch.take(pa.array([len(batch) - 1]))  # a copy, which keeps no batch alive
    if last is not None:  # a task's summary goes with its last row
        yield _with_heavy(last, summary)


_HEAVY = "struct<total:bigint,words:array<struct<token:string,n:bigint>>>"


def _with_heavy(batch: pa.RecordBatch, summary: Summary | None) -> pa.RecordBatch:
    kind = pa.struct([("total", pa.int64()), ("words", pa.list_(pa.struct([("token", pa.string()), ("n", pa.int64())])))])
    held = [None] * len(batch)
    if summary is not None:
        held = [{"total": summary.total, "words": [{"token": w, "n": n} for w, n in summary.counts.items()]}]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(held, kind)], [*batch.schema.names, "heavy"])
