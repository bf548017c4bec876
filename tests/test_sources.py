import configparser
import datetime as dt
import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from checks.builders import cell, error, row, xlsx
from parchmill.plans.job import METHODS, run_job
from parchmill.session import python_env_conf
from parchmill.sinks.tables import load_table
from parchmill.sources import excel
from parchmill.sources.delimited import HeaderMismatch, raw_rejects, scan_csv, scan_csv_raw
from parchmill.sources.excel import column_names, scan_excel
from parchmill.sources.tables import local_rows, scan_jdbc, scan_table, table_name

# --- catalog and local rows --------------------------------------------------


def test_names_are_identifiers():
    assert table_name("d b", "t`x") == "`d b`.`t``x`"
    with pytest.raises(ValueError):
        table_name("", "t")


def test_load_and_scan(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    df = local_rows(spark, [("Alice", 1), ("Bob", 2)], ["name", "id"])
    assert df.dtypes == [("name", "string"), ("id", "bigint")]
    load_table(df, "src", "people")
    load_table(df, "src", "people")  # replaces, does not add
    assert sorted(scan_table(spark, "src", "people").collect()) == [("Alice", 1), ("Bob", 2)]
    with pytest.raises(AnalysisException):
        scan_table(spark, "src", "people; DROP TABLE people")


def test_a_load_leaves_no_gap(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS src")
    for path in (None, str(tmp_path / "here")):
        spark.sql("DROP TABLE IF EXISTS src.swapped")
        load_table(spark.range(10).toDF("n"), "src", "swapped", path)
        table = spark.table("src.swapped")
        for k in range(1, 4):  # from itself
            load_table(table.select((table.n + 1).alias("n")), "src", "swapped", path)
            assert sorted(r.n for r in spark.table("src.swapped").collect()) == list(range(k, k + 10))
            table = spark.table("src.swapped")
        broken = spark.range(3).select(F.when(F.col("id") < 9, F.raise_error(F.lit("lost")).cast("bigint")).alias("n"))
        with pytest.raises(Exception, match="lost"):
            load_table(broken, "src", "swapped", path)
        assert sorted(r.n for r in spark.table("src.swapped").collect()) == list(range(3, 13))
        load_table(table.select(table.n.cast("string").alias("other")), "src", "swapped", path)
        assert spark.table("src.swapped").dtypes == [("other", "string")] and spark.table("src.swapped").count() == 10
        load_table(spark.table("src.swapped").limit(0), "src", "swapped", path)
        assert spark.table("src.swapped").count() == 0
    spark.range(4).withColumn("p", F.col("id") % 2).write.partitionBy("p").mode("overwrite").saveAsTable("src.parts")
    load_table(spark.table("src.parts").where("p = 1"), "src", "parts")
    assert sorted(r.id for r in spark.table("src.parts").collect()) == [1, 3]


def test_jdbc_split_needs_all_its_parts(spark):
    with pytest.raises(ValueError, match="together"):
        scan_jdbc(spark, "jdbc:none:x", "d", "t", partition_column="id")


class Recorder:
    """Stands for a session and its reader, and keeps the options."""

    def __init__(self):
        self.read, self.seen = self, None

    def format(self, name):
        assert name == "jdbc"
        return self

    def options(self, **options):
        self.seen = options
        return self

    def load(self):
        return self


def test_jdbc_options():
    whole = scan_jdbc(Recorder(), "jdbc:x", "d", "t", driver="org.x.Driver", one_task=True).seen
    assert whole == {
        "url": "jdbc:x", "dbtable": '"d"."t"', "fetchsize": "10000", "driver": "org.x.Driver",
    }
    query = "(select 1) x; drop"  # a name, whatever it says
    assert scan_jdbc(Recorder(), "jdbc:x", "", query, one_task=True, quote="`").seen["dbtable"] == f"`{query}`"
    with pytest.raises(ValueError, match="one_task"):
        scan_jdbc(Recorder(), "jdbc:x", "d", "t")
    split = dict(partition_column="id", lower_bound=1, upper_bound=9, num_partitions=3)
    seen = scan_jdbc(Recorder(), "jdbc:x", "d", "t", properties={"user": "u"}, **split).seen
    assert seen["partitionColumn"] == "id" and seen["numPartitions"] == "3"
    assert (seen["lowerBound"], seen["upperBound"], seen["user"]) == ("1", "9", "u")
    section = {"host": "h", "port": "21050", "database": "d", "table": "t", "one_task": "true"}
    section |= {"user": "u", "password": "p", "auth_mechanism": "PLAIN"}
    conf = {"processing": {"method": "read_impala"}, "impala": section}
    seen = run_job(Recorder(), conf).seen
    assert seen["url"] == "jdbc:impala://h:21050/d" and seen["dbtable"] == "`d`.`t`"
    assert (seen["user"], seen["password"], seen["auth_mechanism"]) == ("u", "p", "PLAIN")


# --- CSV ---------------------------------------------------------------------


def test_typed_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,name,d,n\n1,"a,b",2024-01-01,1.5\n2,c,2024-01-02,\n')
    df = scan_csv(spark, str(path))
    assert df.dtypes == [("id", "int"), ("name", "string"), ("d", "date"), ("n", "double")]
    expected = [(1, "a,b", dt.date(2024, 1, 1), 1.5), (2, "c", dt.date(2024, 1, 2), None)]
    assert sorted(map(tuple, df.collect())) == expected
    given = scan_csv(spark, str(path), "id bigint, name string, d string, n string")
    assert given.first()["d"] == "2024-01-01"


def raw(spark, tmp_path, *texts, **options):
    folder = tmp_path / "raw"
    folder.mkdir()
    for i, text in enumerate(texts):
        (folder / f"{i}.csv").write_bytes(text.encode())
    return scan_csv_raw(spark, str(folder), **options), str(folder)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_raw_csv(spark, tmp_path):
    text = '　a,b,c \r\n1,"x,y"\r\n\n a,b,c\n 4 ,\r, 5\n,,\n'
    df, _ = raw(spark, tmp_path, text, "a,b,c\n7,8\n")
    assert df.columns == ["a", "b", "c"] and {t for _, t in df.dtypes} == {"string"}
    expected = [
        ("1", '"x', 'y"'), ("", None, None), ("a", "b", "c"),
        ("4 ", "\r", " 5"), ("", "", ""), ("7", "8", None),
    ]
    assert rows_of(df) == sorted(expected, key=repr)


LINE = st.text(st.sampled_from("a,b \t\r\"\u3000\xa0\u0085"), max_size=8)


@settings(
    max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
@given(st.lists(LINE, min_size=1, max_size=15), st.booleans())
def test_raw_csv_as_in_python(spark, tmp_path_factory, lines, last_ended):
    folder = tmp_path_factory.mktemp("raw")
    text = "\n".join(lines) + ("\n" if last_ended else "")
    (folder / "f.csv").write_bytes(text.encode())
    records = text.split("\n")[: -1 if text.endswith("\n") else None]
    if not text:
        return
    header, *rows = [r.strip().split(",") for r in records]
    df = scan_csv_raw(spark, str(folder), on_long="reject")
    assert df.columns == header
    kept = [tuple(r + [None] * (len(header) - len(r))) for r in rows if len(r) <= len(header)]
    assert rows_of(df) == sorted(kept, key=repr)
    rejected = sorted(len(r) for r in rows if len(r) > len(header))
    assert sorted(r.n_fields for r in raw_rejects(spark, str(folder)).collect()) == rejected


def test_raw_csv_header_only(spark, tmp_path):
    df, _ = raw(spark, tmp_path, "a,b\n")
    assert df.columns == ["a", "b"] and df.count() == 0


def test_raw_csv_empty(spark, tmp_path):
    with pytest.raises(ValueError, match="no lines"):
        raw(spark, tmp_path, "")


def test_raw_csv_headers_differ(spark, tmp_path):
    with pytest.raises(HeaderMismatch):
        raw(spark, tmp_path, "a,b\n1,2\n", "a,c\n1,2\n")


def test_raw_csv_with_columns_given(spark, tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for name, text in (("0", "a,b\n1,2\na,b\n"), ("1", "c,d\n3,4\n"), ("2", "")):
        (folder / name).write_text(text)
    df = scan_csv_raw(spark, str(folder), columns=["x", "y"])
    assert df.columns == ["x", "y"] and rows_of(df) == [("1", "2"), ("3", "4"), ("a", "b")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan


def test_raw_csv_long_lines(spark, tmp_path):
    df, folder = raw(spark, tmp_path, "a,b\n1,2\n1,2,3\n")
    with pytest.raises(Exception, match="more than 2 fields: 1,2,3"):
        df.collect()
    with pytest.raises(Exception, match="more than 2 fields: 1,2,3"):
        df.select("b").collect()
    assert rows_of(scan_csv_raw(spark, folder, on_long="reject")) == [("1", "2")]
    assert rows_of(raw_rejects(spark, folder)) == [("1,2,3", 3)]


def test_raw_csv_in_many_splits(spark, tmp_path):
    lines = ["k,v"] + ["k,v" if i % 3 == 0 else f"{i},{i % 7}" for i in range(30_000)]
    text = "\n".join(lines) + "\n"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1000")
    try:
        df, _ = raw(spark, tmp_path, text, text)
        assert df.rdd.getNumPartitions() > 8
        counts = {r["k"]: r["count"] for r in df.groupBy("k").count().collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert counts["k"] == 20_000 and counts["1"] == 2 and sum(counts.values()) == 60_000


# --- workbooks ---------------------------------------------------------------


def store(folder, **books):
    folder.mkdir(exist_ok=True)
    for name, data in books.items():
        (folder / f"{name}.xlsx").write_bytes(data)
    return str(folder)


STYLES = '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'


def test_excel_types(spark, tmp_path):
    header = row("id", "name", "amount", "active", "when", None, "name", "mixed")
    body = (
        "<row>" + cell(1) + cell("a") + cell(1.5) + cell(True) + cell(45292, style=1)
        + cell(None) + cell("x") + cell(1) + "</row>"
        + "<row/>"
        + row(2.0, "NA", 2, False, None, "u", None, "t")
        + "<row/>"
    )
    data = xlsx({"first": header + body, "second": row("ignored")}, styles=STYLES)
    df = scan_excel(spark, store(tmp_path / "x", one=data))
    assert df.dtypes == [
        ("id", "bigint"), ("name", "string"), ("amount", "double"), ("active", "boolean"),
        ("when", "timestamp_ntz"), ("Unnamed: 5", "string"), ("name.1", "string"), ("mixed", "string"),
    ]
    rows = {r["id"]: tuple(r) for r in df.collect()}
    assert rows[1] == (1, "a", 1.5, True, dt.datetime(2024, 1, 1), None, "x", "1")
    assert rows[2] == (2, None, 2.0, False, None, "u", None, "t")
    assert rows[None] == (None,) * 8 and df.count() == 3


def test_excel_many_workbooks_in_one_schema(spark, tmp_path):
    folder = store(
        tmp_path / "x",
        a=xlsx({"s": row("id", "v") + row(1, 2)}),
        b=xlsx({"s": row("id", "v") + row(3, 4.5)}),
        c=xlsx({"s": row("id", "v")}),
    )
    df = scan_excel(spark, folder)
    assert df.dtypes == [("id", "bigint"), ("v", "double")]
    assert sorted(map(tuple, df.collect())) == [(1, 2.0), (3, 4.5)]
    given = scan_excel(spark, folder, "v double, id string")
    assert sorted(map(tuple, given.collect())) == [(2.0, "1"), (4.5, "3")]


def test_excel_columns_in_any_order(spark, tmp_path):
    folder = store(
        tmp_path / "x",
        a=xlsx({"s": row("id", "v", "id") + row(1, "x", 7)}),
        b=xlsx({"s": row("v", "id", "id") + row("y", 2, 8)}),
    )
    given = scan_excel(spark, folder, "v string, `id.1` bigint, id bigint")
    assert sorted(map(tuple, given.collect())) == [("x", 7, 1), ("y", 8, 2)]
    with pytest.raises(excel.HeaderMismatch, match="expected"):
        scan_excel(spark, folder, "v string, id bigint")


def test_excel_any_number_of_headers(spark, tmp_path):
    """Workbooks of one schema may all have their columns in orders of their own."""
    names = ["a", "b", "c", "d", "e"]
    books = {}
    for k, order in enumerate(itertools.islice(itertools.permutations(range(5)), 40)):
        body = row(*[names[i] for i in order]) + row(*[k * 10 + i for i in order])
        books[f"w{k}"] = xlsx({"s": body})
    df = scan_excel(spark, store(tmp_path / "x", **books), "a int, b int, c int, d int, e int")
    assert sorted(map(tuple, df.collect())) == [tuple(k * 10 + i for i in range(5)) for k in range(40)]
    with pytest.raises(excel.HeaderMismatch):
        scan_excel(spark, store(tmp_path / "x"))


def test_excel_rows_longer_than_a_piece(spark, tmp_path):
    long = "x" * 3_000_000
    data = xlsx({"s": row("a", "b", "c", "d") + row(long, long, "y", 7) + row("p", "q", "r", 8)})
    df = scan_excel(spark, store(tmp_path / "x", a=data))
    assert df.dtypes == [("a", "string"), ("b", "string"), ("c", "string"), ("d", "bigint")]
    rows = {r["d"]: tuple(r)[:3] for r in df.collect()}
    assert rows == {7: (long, long, "y"), 8: ("p", "q", "r")}


def test_excel_last_of_repeated_cells_and_cells_out_of_order(spark, tmp_path):
    body = row("a", "b") + f'<row>{cell(1, "A2")}{cell(2, "B2")}{cell(3, "A2")}</row>'
    body += f'<row>{cell(5, "B3")}{cell(4, "A3")}</row>'
    df = scan_excel(spark, store(tmp_path / "x", book=xlsx({"s": body})))
    assert sorted(map(tuple, df.collect())) == [(3, 2), (4, 5)]


def test_excel_columns_right_of_the_header(spark, tmp_path):
    data = xlsx({"s": row("id") + row(1, None, "x") + row(2)})
    df = scan_excel(spark, store(tmp_path / "x", a=data))
    assert df.columns == ["id", "Unnamed: 1", "Unnamed: 2"]
    assert sorted(map(tuple, df.collect())) == [(1, None, "x"), (2, None, None)]


def test_excel_errors_and_texts_that_read_like_them(spark, tmp_path):
    data = xlsx({"s": row("a", "b") + f"<row>{cell('#REF!')}{error('#REF!')}</row>" + row("x", 1)})
    df = scan_excel(spark, store(tmp_path / "x", a=data))
    assert sorted(map(tuple, df.collect())) == [("#REF!", None), ("x", 1)]


def test_excel_broken_workbook_fails_the_read(spark, tmp_path):
    with pytest.raises(ValueError, match="BadZipFile"):
        scan_excel(spark, store(tmp_path / "x", a=b"no workbook"))


def test_excel_large_numbers(spark, tmp_path):
    data = xlsx({"s": row("n", "m") + row(1e20, 2**53) + row(3, -1)})
    df = scan_excel(spark, store(tmp_path / "x", a=data))
    assert df.dtypes == [("n", "double"), ("m", "bigint")]
    assert sorted(map(tuple, df.collect())) == [(3.0, -1), (1e20, 2**53)]


def test_excel_formula_results(spark, tmp_path):
    formula = '<row><c><f>1+1</f><v>2</v></c><c t="str"><f>"a"</f><v>a</v></c></row>'
    df = scan_excel(spark, store(tmp_path / "x", a=xlsx({"s": row("n", "s") + formula})))
    assert [tuple(r) for r in df.collect()] == [(2, "a")]


def test_excel_headers_differ(spark, tmp_path):
    folder = store(
        tmp_path / "x", a=xlsx({"s": row("id") + row(1)}), b=xlsx({"s": row("key") + row(1)})
    )
    with pytest.raises(excel.HeaderMismatch):
        scan_excel(spark, folder)


def test_column_names():
    assert column_names(["a", None, "a", 3, "a", "a.1"]) == [
        "a", "Unnamed: 1", "a.1", "3", "a.2", "a.1.1",
    ]


# --- jobs --------------------------------------------------------------------


def test_jobs(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS jobs")
    csv = tmp_path / "in.csv"
    csv.write_text("id,name\n1,a\n")
    book = tmp_path / "in.xlsx"
    book.write_bytes(xlsx({"s": row("id", "name") + row(1, "a")}))
    conf = {
        "hive": {"database": "jobs", "table": "people"},
        "local_files": {"input_csv": str(csv), "input_excel": str(book)},
        "hdfs": {"input_csv": str(csv), "input_excel": str(book)},
    }

    def run(method):
        return [tuple(r) for r in run_job(spark, {**conf, "processing": {"method": method}}).collect()]

    assert run("load_local_to_hive") == [(1, "a")]
    assert run("read_hive_spark") == run("read_hive_hwc") == [(1, "a")]
    assert run("read_hdfs_pydoop") == [("1", "a")]
    assert run("read_local_excel") == run("read_hdfs_excel") == [(1, "a")]
    with pytest.raises(ValueError, match="read_hive_hwc"):
        run("read_hive_spark  ; a comment")
    assert len(METHODS) == 7


def test_job_from_a_configuration_file(spark, tmp_path):
    csv = tmp_path / "in.csv"
    csv.write_text("a,b\n1,2\n")
    conf = configparser.ConfigParser()
    conf.read_string(f"[hdfs]\ninput_csv = {csv}\n[processing]\nmethod = read_hdfs_pydoop\n")
    assert [tuple(r) for r in run_job(spark, conf).collect()] == [("1", "2")]


def test_python_environment_settings():
    assert python_env_conf("hdfs:///env.tar.gz", "e") == {
        "spark.archives": "hdfs:///env.tar.gz#e",
        "spark.pyspark.python": "./e/bin/python",
    }
