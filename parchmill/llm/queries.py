"""The registered query of each operator and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.llm import (
    language_id,
    licences,
    merkle,
    minhash,
    mixing,
    pieces,
    secret_scan,
    sharding,
    simhash,
    simhash_dups,
    topk,
    warc,
    whitening,
)
from parchmill.session import scratch_path, ship_package

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def prepare(spark: SparkSession) -> None:
    """What every query needs of its session: the package on all executors, UTC."""
    ship_package(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    # Texts travel to Python in batches of at most this size.
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def query(run: Query) -> Query:
    def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return run(spark, sf_dir)

    prepared.__name__ = run.__name__
    QUERIES[run.__name__] = prepared
    return run


def in_sql(sql: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        SQL[run.__name__] = sql
        return query(run)

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4
    return F.coalesce(remainder == 2, F.lit(False))


@query
def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases and licence texts in every document."""
    found = licences.scan_licences(table(spark, sf_dir, "documents"))
    return found.withColumn("n_spans", F.size("spans").cast("long")).drop("spans")


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 24 shards on disk, and where each went."""
    docs = table(spark, sf_dir, "documents")
    written = sharding.write_shards(docs, scratch_path(spark, "shards"), shards=24)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    placed = sharding.with_slots(
        written,
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
    )
    grown = sharding.consistent_shard(F.col("doc_id"), 25, 20)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard")
    )


# The same mix over all rows at once: targets by filling up sources in order, then
# documents in order of their rank until the words left to take are reached.
_MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE
           / 4503599627370496.0 AS u
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, list_extract([5.0, 2.0, 1.0]::DOUBLE[],
           ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight,
         source_size * 3.0::DOUBLE AS most, sum(source_size) OVER () ::DOUBLE AS total
  FROM sources
), filling AS (
  SELECT *, most / weight AS fills_at,
         (total - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed
), targets AS (
  SELECT *, coalesce(least((SELECT level FROM filling WHERE level < fills_at
              ORDER BY fills_at, source NULLS LAST LIMIT 1) * weight, most), most) AS target
  FROM filling
), expected AS (
  SELECT s.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0.0 END AS e
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), ranked AS (
  SELECT *, floor(e) AS certain,
         target - sum(floor(e) * size) OVER (PARTITION BY source) AS rest,
         CASE WHEN floor(e) >= 3 THEN NULL
              WHEN e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e))))
              ELSE 'inf'::DOUBLE END AS rank
  FROM expected
), placed AS (
  SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id, size
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM ranked
)
SELECT doc_id, size, source_size, target,
       (size * (certain + CASE WHEN rank IS NOT NULL AND rest > 0 AND upto - size / 2 <= rest
                               THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""


@in_sql(_MIX_SQL)
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document a mix by the weights 5, 2, 1 takes."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.word_count(F.col("text")))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


_WARC_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages
), kept AS (
  SELECT hex AS h, max(page_id) AS keeper FROM hashed GROUP BY hex
), spelled AS (
  SELECT page_id, payload_bytes, keeper,
         list_aggregate([
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             (((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)
           FOR i IN range(32)], 'string_agg', '') AS payload_digest
  FROM hashed JOIN kept ON hex = h
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END
         AS record_type,
       CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM spelled
"""


@in_sql(_WARC_SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives, and what the archives hold."""
    path = scratch_path(spark, "warc")
    warc.write_pages(table(spark, sf_dir, "pages"), path)
    return warc.read_pages(spark, path)


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of every document, with the forest's verdict. The candidate
    itself is told by its hash only."""
    found = secret_scan.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("nth").cast("long").alias("nth"),
        F.col("start").cast("long").alias("start"),
        F.length("candidate").cast("long").alias("length"),
        F.sha2("candidate", 256).alias("candidate_sha256"),
        "probability",
        "is_secret",
    )


@query
def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by shingles of four words, at 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned from the labelled documents that are not held out, predicted for all."""
    docs = table(spark, sf_dir, "documents")
    samples = language_id.learn(docs.where(~held_out()))
    found = language_id.identify(docs, samples)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def piece_model(spark: SparkSession) -> str:
    """The model file that the session's setting names."""
    path = spark.conf.get("parchmill.pieceModel", "/opt/tokenizers/piece_bpe_32k.model")
    if not Path(path).is_file():
        raise FileNotFoundError(f"no piece model at {path}: name one in the setting parchmill.pieceModel")
    return path


_TOP_K_SQL = """
WITH whole AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON len(q.v) = len(c.v) AND q.row <> c.row
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id)::INT AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@in_sql(_TOP_K_SQL)
def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all vectors for every hundredth id."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10)


@query
def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's piece ids, and whether decoding them gives its text back."""
    model = pieces.PieceModel.load(piece_model(spark))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = pieces.decode(pieces.encode(docs, model), model)
    same = pieces.same_text(F.col("text"), F.col("decoded"))
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("same"))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and how alike they are."""
    return simhash.compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op11_simhash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents by fingerprints of at most two differing bits."""
    return simhash_dups.near_duplicates(table(spark, sf_dir, "documents"), radius=2)


_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Levels of all groups' trees at once, then those over the subroots; then every leaf's
# way up, with the tampered digest folded and the siblings put one after the other.
_MERKLE_SQL = f"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, text,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-')
         || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
         || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}') AS lowered,
         list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen(doc_id::VARCHAR) + 1),
           lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::UBIGINT)),
           lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda k: k::UBIGINT)),
             lambda r, k: xor(r >> 1, (r & 1) * 3988292384::UBIGINT))) AS crc
  FROM documents
), hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
         CASE WHEN xor(crc, 4294967295::UBIGINT) % 3 = 0
              THEN sha256(head || coalesce(strlen(lowered) || ':' || lowered, '-')) END AS altered
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM hashed
), levels AS (
  SELECT 0 AS level, lang, i, leaf AS digest, count(*) OVER (PARTITION BY lang) AS size FROM leaves
  UNION ALL
  SELECT level + 1, lang, i // 8, sha256(string_agg(digest, '' ORDER BY i)), ceil(any_value(size) / 8)::BIGINT
  FROM levels WHERE size > 1 GROUP BY level, lang, i // 8
), subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS size
  FROM levels WHERE size = 1
), high AS (
  SELECT 0 AS level, i, digest, size FROM subroots
  UNION ALL
  SELECT level + 1, i // 8, sha256(string_agg(digest, '' ORDER BY i)), ceil(any_value(size) / 8)::BIGINT
  FROM high WHERE size > 1 GROUP BY level, i // 8
), runs AS (
  SELECT level, lang, i // 8 AS run, list(digest ORDER BY i) AS kids FROM levels WHERE size > 1
  GROUP BY level, lang, i // 8
), high_runs AS (
  SELECT level, i // 8 AS run, list(digest ORDER BY i) AS kids FROM high WHERE size > 1 GROUP BY level, i // 8
), climb AS (
  SELECT lang, i AS leaf_no, 0 AS level, i, coalesce(altered, leaf) AS fold, '' AS siblings, false AS last FROM leaves
  UNION ALL
  SELECT c.lang, c.leaf_no, c.level + 1, c.i // 8,
         CASE WHEN r.run IS NULL THEN c.fold ELSE sha256(array_to_string(
           list_concat(r.kids[1:(c.i % 8)], [c.fold], r.kids[(c.i % 8) + 2:]), '')) END,
         CASE WHEN r.run IS NULL THEN c.siblings ELSE c.siblings || array_to_string(
           list_concat(r.kids[1:(c.i % 8)], r.kids[(c.i % 8) + 2:]), '') END,
         r.run IS NULL
  FROM climb c LEFT JOIN runs r ON r.level = c.level AND r.lang IS NOT DISTINCT FROM c.lang AND r.run = c.i // 8
  WHERE NOT c.last
), over AS (
  SELECT c.lang, c.leaf_no, 0 AS level, s.i, c.fold, c.siblings, false AS last
  FROM climb c JOIN subroots s ON s.lang IS NOT DISTINCT FROM c.lang WHERE c.last
  UNION ALL
  SELECT c.lang, c.leaf_no, c.level + 1, c.i // 8,
         CASE WHEN r.run IS NULL THEN c.fold ELSE sha256(array_to_string(
           list_concat(r.kids[1:(c.i % 8)], [c.fold], r.kids[(c.i % 8) + 2:]), '')) END,
         CASE WHEN r.run IS NULL THEN c.siblings ELSE c.siblings || array_to_string(
           list_concat(r.kids[1:(c.i % 8)], r.kids[(c.i % 8) + 2:]), '') END,
         r.run IS NULL
  FROM over c LEFT JOIN high_runs r ON r.level = c.level AND r.run = c.i // 8 WHERE NOT c.last
), root AS (
  SELECT digest AS root FROM high WHERE size = 1
)
SELECT l.doc_id, l.leaf, s.digest AS subroot, root.root, sha256(o.siblings) AS proof_sha256,
       o.fold AS folded_root, o.fold = root.root AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN over o ON o.last AND o.lang IS NOT DISTINCT FROM l.lang AND o.leaf_no = l.i, root
"""


@in_sql(_MERKLE_SQL)
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of all documents by language; where three divides the checksum of the
    id, the verifier sees the text in lower case."""

    def leaf(text: Column) -> Column:
        return F.concat(*map(merkle.field, [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]), merkle.field(text))

    lowered = F.translate("text", _CAPITALS, _CAPITALS.lower())
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(
        table(spark, sf_dir, "documents"),
        key=F.col("doc_id"),
        group=F.col("lang"),
        leaf=leaf(F.col("text")),
        tampered=F.when(chosen, leaf(lowered)),
    )
    return found.withColumnRenamed("key", "doc_id")


@query
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every vector."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=8)


def _fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = simhash.fingerprint(table(spark, sf_dir, "documents"))
    path = scratch_path(spark, "fingerprints")
    marks.write.parquet(path)
    return spark.read.parquet(path)


@query
def simhash_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document: who is meant by one that simhash_search found."""
    return simhash.fingerprint(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint")


@query
def simhash_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every fiftieth id all fingerprints within three bits that other documents have,
    its own among them (distance 0): the smallest of their ids and how many they are.
    simhash_members has all of them by fingerprint. Documents that share an id are
    searched each."""
    marks = _fingerprints(spark, sf_dir)
    asked = F.col("doc_id") % 50 == 0
    near = simhash.near_fingerprints(marks, radius=3, queries=asked)
    held = marks.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    # What is left of a fingerprint's documents without the one that asks.
    ids = marks.groupBy("fingerprint", "doc_id").agg(F.count("*").alias("k"))
    ids = ids.join(held.where("n > 1"), "fingerprint")
    left = ids.groupBy("fingerprint", "id", "n").agg(
        F.min(F.when((F.col("doc_id") > F.col("id")) | (F.col("k") > 1), F.col("doc_id"))).alias("second")
    )
    queries = marks.where(asked).select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("x"))
    copies = queries.join(left, F.col("x") == F.col("fingerprint")).select(
        "query_id",
        F.when(F.col("query_id") == F.col("id"), F.col("second")).otherwise(F.col("id")).alias("doc_id"),
        "fingerprint",
        (F.col("n") - 1).alias("n_documents"),
        F.lit(0).alias("distance"),
    )
    found = held.select(
        F.col("id").alias("doc_id"), F.col("fingerprint").alias("y"), F.col("n").alias("n_documents")
    )
    others = queries.join(near.join(found, "y"), "x")
    others = others.select("query_id", "doc_id", F.col("y").alias("fingerprint"), "n_documents", "distance")
    return copies.unionByName(others)
