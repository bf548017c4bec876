"""Assembly of texts from element tables, routing, and extraction from files."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import builders as build
from checks.registry import given, prepared, query, spread
from parchmill.formats.storage import resolve
from parchmill.functions import text as t
from parchmill.operators import assemble
from parchmill.operators.extract import document_texts, extract_metrics, extract_texts
from parchmill.operators.route import output_collisions, route, unsupported_files
from parchmill.plans.extract_tree import extract_tree, run_extraction
from parchmill.session import scratch_path
from parchmill.sinks.text_files import read_text_files, write_text_files
from parchmill.sources.documents import list_documents
from parchmill.sources.tree import scan_tree

# --- assembly ----------------------------------------------------------------


def _segments_sql(pieces: str, order: str, start: int = 1) -> str:
    """path, segment_no and text of pieces (path, piece, order columns): a segment ends
    with the piece in which a multiple of SEGMENT_BYTES is passed."""
    return f"""{pieces}, placed AS (
      SELECT *, (sum(strlen(piece)) OVER (PARTITION BY path ORDER BY {order}
                   ROWS UNBOUNDED PRECEDING) - strlen(piece)) // {assemble.SEGMENT_BYTES} AS s FROM pieces),
    joined AS (SELECT path, s, string_agg(piece, '' ORDER BY {order}) AS text FROM placed GROUP BY ALL),
    numbered AS (SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY s) - 1 AS INTEGER)
                   AS segment_no, text FROM joined)
    SELECT path, segment_no, CASE WHEN segment_no = 0 THEN substr(text, {start}) ELSE text END AS text
    FROM numbered"""


@query(
    _segments_sql(
        """WITH pieces AS (SELECT CAST(conv_id AS VARCHAR) AS path, turn, chr(10) || text AS piece
           FROM conversations)""",
        "turn, piece",
        start=2,
    )
)
def docx_join(spark: SparkSession, sf: str) -> DataFrame:
    elements = given(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("path"), F.col("turn").alias("part_no"), "text"
    )
    return assemble.join_paragraphs(elements)


@query(
    _segments_sql(
        """WITH pieces AS (SELECT CAST(conv_id AS VARCHAR) AS path, turn, text || chr(10) AS piece
           FROM conversations)""",
        "turn, piece",
    )
)
def pptx_shapes(spark: SparkSession, sf: str) -> DataFrame:
    elements = given(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("path"),
        F.floor(F.col("turn") / 2).alias("part_no"),
        (F.col("turn") % 2).alias("row_no"),
        "text",
    )
    return assemble.join_shapes(elements)


@query(
    _segments_sql(
        """WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
           pieces AS (SELECT CAST(doc_id AS VARCHAR) AS path, unnest(p) AS piece,
                        unnest(range(len(p))) AS n FROM parts)""",
        "n",
    )
)
def pdf_concat(spark: SparkSession, sf: str) -> DataFrame:
    elements = given(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.posexplode(F.split("text", "\n")).alias("part_no", "text"),
    )
    return assemble.concat_pages(elements)


def _order_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Workbooks of many customers: a sheet per customer, a row per order."""

    def cell(n: int, value: str, data_type: str) -> Column:
        return F.struct(
            F.lit(n).alias("cell_no"),
            F.col(value).cast("string").alias("text"),
            t.truthy(F.col(value), data_type).alias("keep"),
        )

    row_end = F.struct(
        F.lit(assemble.ROW_END).alias("cell_no"), F.lit("").alias("text"), F.lit(True).alias("keep")
    )
    cells = F.array(
        cell(0, "o_orderkey", "bigint"),
        cell(1, "o_orderstatus", "string"),
        cell(2, "o_orderpriority", "string"),
        row_end,
    )
    return given(spark, sf, "orders").select(
        (F.col("o_custkey") % 100).cast("string").alias("path"),
        F.col("o_custkey").alias("part_no"),
        F.col("o_orderkey").alias("row_no"),
        F.inline(cells),
    )


@query(
    _segments_sql(
        """WITH pieces AS (
             SELECT CAST(o_custkey % 100 AS VARCHAR) AS path, o_custkey, o_orderkey, unnest(range(4)) AS n,
               unnest([
                 CASE WHEN o_orderkey <> 0 THEN CAST(o_orderkey AS VARCHAR) || chr(9) ELSE '' END,
                 CASE WHEN o_orderstatus <> '' THEN o_orderstatus || chr(9) ELSE '' END,
                 CASE WHEN o_orderpriority <> '' THEN o_orderpriority || chr(9) ELSE '' END,
                 chr(10)]) AS piece
             FROM orders)""",
        "o_custkey, o_orderkey, n",
    )
)
def xlsx_rows(spark: SparkSession, sf: str) -> DataFrame:
    return assemble.join_cells(_order_cells(spark, sf))


@query(
    """SELECT o_custkey AS part_no, o_orderkey AS row_no, cell_no, text, keep FROM (
         SELECT o_custkey, o_orderkey, 0 AS cell_no, CAST(o_orderkey AS VARCHAR) AS text,
                o_orderkey <> 0 AS keep FROM orders
         UNION ALL SELECT o_custkey, o_orderkey, 1, o_orderstatus, o_orderstatus <> '' FROM orders
         UNION ALL SELECT o_custkey, o_orderkey, 2, o_orderpriority, o_orderpriority <> ''
         FROM orders)"""
)
def xlsx_truthy_cells(spark: SparkSession, sf: str) -> DataFrame:
    return _order_cells(spark, sf).where(F.col("cell_no") < assemble.ROW_END).drop("path")


# --- routing and names -------------------------------------------------------

_ENDING = """CASE page_id % 8 WHEN 0 THEN '.docx' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xlsm'
  WHEN 3 THEN '.xlTX' WHEN 4 THEN '.Pdf' WHEN 5 THEN '.pptx' WHEN 6 THEN '.doc' ELSE '' END"""
_PATHS = f"""paths AS (
  SELECT page_id, regexp_replace(url, '[?#].*$', '') || {_ENDING} AS path FROM pages)"""
_ROUTED = rf"""{_PATHS}, routed AS (
  SELECT page_id, path, CASE
    WHEN lower(path) LIKE '%.docx' THEN 'docx'
    WHEN regexp_matches(lower(path), '\.(xlsx|xlsm|xltx|xltm)$') THEN 'xlsx'
    WHEN lower(path) LIKE '%.pdf' THEN 'pdf'
    WHEN lower(path) LIKE '%.pptx' THEN 'pptx' ELSE 'unsupported' END AS kind,
    regexp_replace(regexp_extract(path, '[^/]*$'), '^(\.*[^.].*)\.[^.]*$', '\1') || '.txt'
      AS out_name
  FROM paths)"""


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    given(spark, sf, "pages").select("page_id", "url").createOrReplaceTempView("pages")
    return spark.sql(f"WITH {_PATHS} SELECT page_id, path FROM paths")


@query(f"WITH {_ROUTED} SELECT page_id, path, kind FROM routed")
def route_by_extension(spark: SparkSession, sf: str) -> DataFrame:
    return route(_paths(spark, sf)).drop("out_name")


@query(
    f"WITH {_ROUTED} SELECT page_id, path FROM routed WHERE kind = 'unsupported'",
    name="unsupported_files",
)
def unsupported(spark: SparkSession, sf: str) -> DataFrame:
    return unsupported_files(route(_paths(spark, sf))).select("page_id", "path")


@query(f"WITH {_ROUTED} SELECT page_id, out_name FROM routed")
def output_name(spark: SparkSession, sf: str) -> DataFrame:
    return route(_paths(spark, sf)).select("page_id", "out_name")


@query(
    f"""WITH {_ROUTED} SELECT out_name, count(*) AS n_files, max(path) AS last_path
        FROM routed GROUP BY out_name HAVING count(*) > 1""",
    name="output_collisions",
)
def collisions(spark: SparkSession, sf: str) -> DataFrame:
    return output_collisions(route(_paths(spark, sf)))


# --- extraction: every document becomes a file -------------------------------


def _file(doc_id: int, text: str) -> tuple[str, bytes]:
    lines, folder = text.split("\n"), f"d{doc_id % 100:02d}"
    kind = doc_id % 7
    if kind == 0:
        return f"{folder}/{doc_id}.docx", build.docx("".join(map(build.paragraph, lines)))
    if kind == 1:
        # A row a line: the line, inline or shared, nothing, and its number, which is
        # true but for the first.
        rows = "".join(
            f"<row>{build.shared(k) if k % 2 else build.cell(line)}{build.cell(0)}{build.cell(k)}</row>"
            for k, line in enumerate(lines)
        )
        return f"{folder}/{doc_id}.XLSX", build.xlsx({"lines": rows}, build.strings(lines))
    if kind == 2:
        return f"{folder}/{doc_id}.pptx", build.pptx("".join(map(build.shape, lines)))
    if kind == 3:
        return f"{folder}/{doc_id}.pdf", b"%PDF-1.4 " + text.encode()  # no PDF file
    if kind == 4:
        return f"{folder}/.{doc_id}.docx", build.docx("".join(map(build.paragraph, lines)))
    if kind == 5:
        return f"{folder}/{doc_id}.docx", text.encode()  # no Word file
    return f"{folder}/{doc_id}.md", text.encode()


_FILES_SQL = """files AS (
  SELECT doc_id, CASE doc_id % 7
      WHEN 0 THEN 'docx' WHEN 1 THEN 'xlsx' WHEN 2 THEN 'pptx' WHEN 3 THEN 'pdf'
      WHEN 4 THEN 'docx' WHEN 5 THEN 'docx' ELSE 'unsupported' END AS kind,
    CASE doc_id % 7 WHEN 3 THEN 'error' WHEN 5 THEN 'error' WHEN 6 THEN 'unsupported' ELSE 'ok' END AS status,
    'd' || lpad(CAST(doc_id % 100 AS VARCHAR), 2, '0') || '/'
      || CASE doc_id % 7 WHEN 4 THEN '.' ELSE '' END || CAST(doc_id AS VARCHAR)
      || CASE doc_id % 7 WHEN 1 THEN '.XLSX' WHEN 2 THEN '.pptx' WHEN 3 THEN '.pdf'
           WHEN 6 THEN '.md' ELSE '.docx' END AS path,
    CASE doc_id % 7 WHEN 4 THEN '.' ELSE '' END || CAST(doc_id AS VARCHAR) || '.txt' AS out_name,
    CASE doc_id % 7
      WHEN 0 THEN text WHEN 4 THEN text
      WHEN 1 THEN list_aggregate(list_transform(string_split(text, chr(10)),
        lambda l, k: CASE WHEN l = '' THEN l ELSE l || chr(9) END
          || CASE WHEN k = 1 THEN '' ELSE (k - 1) || chr(9) END || chr(10)), 'string_agg', '')
      WHEN 2 THEN text || chr(10) END AS text
  FROM documents)"""


_FILE_DDL = "path string, content binary"


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """(path, content): one file per document."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                path, content = _file(doc_id, text)
                yield pa.RecordBatch.from_pylist([{"path": path, "content": content}])

    def make(path: str) -> None:
        documents = spread(given(spark, sf, "documents").select("doc_id", "text"))
        documents.mapInArrow(pack, _FILE_DDL).write.parquet(path)

    return spark.read.schema(_FILE_DDL).parquet(prepared(spark, sf, "files", make))


def _tree(spark: SparkSession, sf: str) -> str:
    """The same as a tree of files on disk."""
    return prepared(spark, sf, "tree", lambda path: store_files(_files(spark, sf), path))


def store_files(files: DataFrame, root: str) -> None:
    """Write (path, content) rows as files, each by the task that holds it."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                fs, name = resolve(f"{root}/{path}")
                fs.create_dir(posixpath.dirname(name), recursive=True)
                with fs.open_output_stream(name) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    files.mapInArrow(store, "n bigint").agg(F.sum("n")).collect()


@query(f"WITH {_FILES_SQL} SELECT path, out_name, kind, text, status FROM files")
def extract_files(spark: SparkSession, sf: str) -> DataFrame:
    texts = extract_texts(_files(spark, sf))
    return texts.select("path", "out_name", "kind", "text", "status")


_BROKEN = ("docx", "XLSX", "pptx", "pdf")


@query(
    """SELECT CAST(doc_id AS VARCHAR) || CASE doc_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.XLSX'
         WHEN 2 THEN '.pptx' ELSE '.pdf' END AS path,
         doc_id % 3 = 0 AND doc_id % 4 <> 3 AS no_zip, false AS has_text
       FROM documents"""
)
def extract_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Broken files of every kind: no archive, an archive cut off in its part, a wrong
    main part. Each is an error row and none fails the job."""

    def broken(doc_id: int, text: str) -> tuple[str, bytes]:
        kind = _BROKEN[doc_id % 4]
        if doc_id % 3 == 0:
            return f"{doc_id}.{kind}", text.encode()
        if doc_id % 3 == 1:
            return f"{doc_id}.{kind}", build.truncated(text, kind.lower())
        return f"{doc_id}.{kind}", build.package({"other.xml": "<other/>"})

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path, content = broken(doc_id, text)
                yield pa.RecordBatch.from_pylist([{"path": path, "content": content}])

    def make(path: str) -> None:
        documents = spread(given(spark, sf, "documents").select("doc_id", "text"))
        documents.mapInArrow(pack, _FILE_DDL).write.parquet(path)

    files = spark.read.schema(_FILE_DDL).parquet(prepared(spark, sf, "broken", make))
    texts = extract_texts(files)
    return texts.where("status = 'error'").select(
        "path",
        F.col("error").startswith("BadZipFile").alias("no_zip"),
        F.col("text").isNotNull().alias("has_text"),
    )


@query(
    f"""WITH {_FILES_SQL} SELECT count(*) AS n_files,
          count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'error') AS n_errors,
          count(*) FILTER (status = 'unsupported') AS n_unsupported,
          CAST(sum(length(text)) AS BIGINT) AS n_chars
        FROM files""",
    name="extract_metrics",
)
def metrics(spark: SparkSession, sf: str) -> DataFrame:
    return extract_metrics(extract_texts(_files(spark, sf)))


def _below(path: str) -> Column:
    return F.regexp_extract(path, r"/(d\d\d/[^/]*)\z", 1)


@query(
    f"WITH {_FILES_SQL} SELECT path, out_name, kind, text, status FROM files",
    name="extract_tree",
)
def tree(spark: SparkSession, sf: str) -> DataFrame:
    texts = extract_tree(spark, _tree(spark, sf))
    return texts.select(_below("path").alias("path"), "out_name", "kind", "text", "status")


@query(
    f"""WITH {_FILES_SQL} SELECT path, out_name, kind, text, status FROM files
        WHERE kind IN ('docx', 'xlsx') AND path LIKE 'd1%'"""
)
def scan_tree_some(spark: SparkSession, sf: str) -> DataFrame:
    """Files of two kinds in some folders of a tree; no other file is opened."""
    root = _tree(spark, sf)
    # Paths as the list has them: those of local storage begin with their folder.
    asked = F.col("kind").isin("docx", "xlsx") & F.col("path").contains("/d1")
    stored = scratch_path(spark, "records")
    scan_tree(spark, root).where(asked).write.parquet(stored)
    texts = document_texts(spark.read.parquet(stored))
    found = texts.select(_below("path").alias("path"), "out_name", "kind", "text", "status")
    return found.where(F.col("path").startswith("d1"))


@query(
    f"""WITH {_FILES_SQL} SELECT out_name AS name, CAST(strlen(text) AS BIGINT) AS length,
          (SELECT count(*) FROM files WHERE status = 'error') AS n_errors
        FROM files WHERE status = 'ok'"""
)
def extraction_job(spark: SparkSession, sf: str) -> DataFrame:
    """A tree to a table and to text files; what is in their folder then."""
    table, folder = scratch_path(spark, "table"), scratch_path(spark, "texts")
    counts = run_extraction(spark, _tree(spark, sf), table, text_folder=folder)
    return list_documents(spark, folder).select(
        t.base_name(F.col("path")).alias("name"), "length", F.lit(counts["n_errors"]).alias("n_errors")
    )


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return spread(given(spark, sf, "documents").select("doc_id", "text")).select(
        F.concat(F.lit("/in/"), name, F.lit(".docx")).alias("path"),
        F.concat(name, F.lit(".txt")).alias("out_name"),
        F.lit(0).alias("segment_no"),
        F.lit(True).alias("is_last"),
        "text",
        F.lit("ok").alias("status"),
    )


@query("SELECT 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS name, text FROM documents")
def text_sink_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "texts")
    write_text_files(_texts(spark, sf), root)
    return read_text_files(spark, root)


def _shared_names(spark: SparkSession, sf: str) -> DataFrame:
    """Texts of which ten at a time have one name."""
    name = F.concat(F.lit("n"), F.floor(F.col("part") / 10).cast("string"), F.lit(".txt"))
    texts = _texts(spark, sf).withColumn("part", F.regexp_extract("path", r"(\d+)\.docx", 1).cast("long"))
    return texts.withColumn("out_name", name).drop("part")


_NAMES = """shared AS (
  SELECT text, '/in/doc-' || doc_id || '.docx' AS path, 'n' || (doc_id // 10) AS stem,
    count(*) OVER (PARTITION BY doc_id // 10) AS n,
    max('/in/doc-' || doc_id || '.docx') OVER (PARTITION BY doc_id // 10) AS last_path
  FROM documents)"""


def _written(spark: SparkSession, sf: str, on_collision: str) -> DataFrame:
    root = scratch_path(spark, "texts")
    write_text_files(_shared_names(spark, sf), root, on_collision)
    return read_text_files(spark, root)


@query(f"WITH {_NAMES} SELECT stem || '.txt' AS name, text FROM shared WHERE path = last_path")
def text_sink_last(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf, "last")


@query(
    f"""WITH {_NAMES} SELECT stem || CASE WHEN n > 1 THEN '-' || sha256(path) ELSE '' END || '.txt'
          AS name, text FROM shared"""
)
def text_sink_suffix(spark: SparkSession, sf: str) -> DataFrame:
    return _written(spark, sf, "suffix")


@query(
    """SELECT 'doc-' || CAST(doc_id AS VARCHAR) || '.txt' AS name,
              CAST(strlen(text) AS BIGINT) AS length FROM documents""",
    name="list_documents",
)
def listing(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "texts")
    write_text_files(_texts(spark, sf), root)
    return list_documents(spark, root).select(t.base_name(F.col("path")).alias("name"), "length")
