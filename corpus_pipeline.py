"""A corpus pipeline of five of the operators: documents in, piece ids out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import language_id, minhash, mixing, pieces, secret_scan
from parchmill.llm.arrays import fresh
from parchmill.llm.parted import parted
from parchmill.llm.queries import piece_model, prepare
from parchmill.llm.rows import numbered
from parchmill.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def whole(docs: DataFrame, *but: str) -> Column:
    """The rows' columns, but for some, in one: so no name of theirs can clash."""
    return F.struct(F.lit(0), *[F.col(f"`{c}`") for c in docs.columns if c not in but]).alias("row")


def columns_of(docs: DataFrame, **replaced: Column) -> list[Column]:
    """The columns of whole(), some replaced, in the order and with the types of `docs`."""
    return [replaced.get(f.name, F.col(f"row.`{f.name}`")).cast(f.dataType).alias(f.name) for f in docs.schema]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no determined language go; a missing label is filled in. Where no
    text is labelled nothing can be determined: all texts with a letter stay as they are."""
    prepare(spark)
    samples = language_id.learn(docs)
    if not samples.texts:
        return docs.where(language_id.has_letter(F.col("text")))
    said, score = fresh(docs.columns, "lang_pred"), fresh(docs.columns, "score")
    found = language_id.predicted(docs, samples, lang_col=said, score_col=score)
    kept = found.where(F.col(said) != language_id.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", said)).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of the smallest id; rows
    without an id come last. Of texts without words only equal ones of one id, or of
    none, are duplicates. Further columns of any name stay as they are."""
    prepare(spark)
    rows = numbered(docs, whole(docs))
    texts = rows.select("key", F.col("row.text").alias("text"))
    found = minhash.near_duplicates(texts, id_col="key", row_col="key").drop("kept")
    marks = rows.select(F.col("key").alias("k"), F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("hash"))
    found = found.join(marks, F.col("key") == F.col("k"))
    wordless = F.when(F.col("n_shingles") == 0, F.struct("id", "hash"))
    group = F.when(wordless.isNull(), F.col("component_id"))
    order = F.struct(F.col("id").isNull().alias("last"), "id", "key")
    found = found.select("key", group.alias("group"), wordless.alias("wordless"), order.alias("order"))
    path = scratch_path(spark, "pipeline-groups")
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    first = found.groupBy("group", "wordless").agg(F.min("order").alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.col("group").alias("g"), F.col("wordless").alias("w"), "first")
    same = F.col("group").eqNullSafe(F.col("g")) & F.col("wordless").eqNullSafe(F.col("w"))
    gone = found.join(first, same).where(F.col("key") != F.col("first.key")).select("key")
    path = scratch_path(spark, "pipeline-gone")
    gone.write.parquet(path)
    gone = spark.read.schema(gone.schema).parquet(path)
    # Only texts that may go are shuffled.
    some, others = parted(rows, F.col("key"), gone)
    kept = some.join(gone, "key", "left_anti").select("key", "row").unionAll(others.select("key", "row"))
    return kept.select(*columns_of(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text; every document stays, with all its columns, of any
    name. Findings are those of a row, whatever its id."""
    prepare(spark)
    rows = numbered(docs, whole(docs, "text"), F.col("text"))
    found = secret_scan.scan(rows.select("key", "text", F.col("row.source").alias("source")), id_col="key")
    made = secret_scan.redact(rows, found, id_col="key")
    return made.select(*columns_of(docs, text=F.col("text"), n_chars=F.length("text")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with all its columns, of any name."""
    prepare(spark)
    mixed = mixing.mix(docs, mixing.word_count(F.col("text")), row_col="row")
    copies = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    return mixed.where("copies > 0").select("row", copies.alias("copy")).select("row.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids and n_tokens; further columns, of any name, go."""
    prepare(spark)
    model = pieces.PieceModel.load(piece_model(spark))
    made = pieces.encode(docs, model, keep=("doc_id", "lang", "source"))
    return made.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("sentencepiece", encode_pieces),
]

# Cross-parsing, a trained forest and Viterbi cannot be said in SQL; tests hold the
# stages against plain restatements instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"pipeline-{name}")
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
