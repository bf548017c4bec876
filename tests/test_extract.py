import datetime as dt
import io
import random
import re
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from checks.builders import cell, docx, paragraph, pptx, row, shape, shared, strings, truncated, xlsx
from parchmill.formats import cut, storage
from parchmill.formats import strings as strings_module
from parchmill.operators import extract
from parchmill.operators.assemble import ROW_END
from parchmill.operators.extract import (
    document_elements,
    document_texts,
    extract_metrics,
    extract_texts,
    parse_documents,
)
from parchmill.plans.extract_tree import TooManyErrors, extract_tree, run_extraction
from parchmill.sinks import text_files
from parchmill.sinks.text_files import OutputCollision, write_text_files
from parchmill.sources import documents
from parchmill.sources.documents import Unreachable, list_documents, scan_visible
from parchmill.sources.tree import scan_tree


def text_of(spark, name, data):
    files = spark.createDataFrame([(name, bytearray(data))], "path string, content binary")
    rows = extract_texts(files).collect()
    assert len(rows) == 1
    return rows[0]


def test_word_paragraphs(spark):
    body = (
        paragraph("hi")
        + paragraph("")
        + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>table</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        + '<w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t><w:br w:type="page"/></w:r>'
        + "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
        + paragraph("bye")
    )
    r = text_of(spark, "/d/a.docx", docx(body))
    assert (r.status, r.out_name, r.kind) == ("ok", "a.txt", "docx")
    assert r.text == "hi\n\na\tb\nclink\nbye"


def test_workbook_rows(spark):
    one = row("x", 0, "y") + "<row/>" + row(1, "", False)
    r = text_of(spark, "/d/b.xlsx", xlsx({"one": one, "two": row("z")}))
    assert r.text == "x\ty\t\n" + "\n" + "1\t\n" + "z\t\n"


def test_workbook_values(spark):
    styles = (
        '<numFmts><numFmt numFmtId="164" formatCode="[Red]0.0&quot;d&quot;"/>'
        '<numFmt numFmtId="165" formatCode="yyyy\\-mm"/><numFmt numFmtId="166" formatCode="[h]:mm"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/>'
        '<xf numFmtId="165"/><xf numFmtId="166"/></cellXfs>'
    )
    shared = ["<si><t>plain</t></si>", "<si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si>"]
    rows = (
        '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c></row>'
        + "<row r='4'>"
        + cell(45292, "A4", 1)
        + cell(45292.5, "B4", 3)
        + cell(0.25, "C4", 1)
        + cell(1.5, "D4", 2)
        + cell(1.5, "E4", 4)
        + cell(1e7, "F4")
        + cell(59, "G4", 1)
        + cell(True, "H4")
        + cell(0.5004, "I4", 3)
        + cell(45292.000005787, "J4", 3)
        + cell(-1.25, "K4", 4)
        + cell(1e-7, "L4")
        + cell(123456789012345678901, "M4")
        + cell(3e6, "N4", 1)
        + "</row><row r='5'><c r='A5'><f>SUM(B1:B2)</f><v>3</v></c><c r='B5' t='e'><v>#N/A</v></c>"
        + "<c r='C5'><f t='shared' si='0' ref='C5:C6'>A1+$B$1</f><v>1</v></c></row>"
        + "<row r='6'><c r='C6'><f t='shared' si='0'/><v>1</v></c></row>"
    )
    r = text_of(spark, "/d/b.XLSM", xlsx({"s": rows}, shared, styles))
    lines = r.text.split("\n")
    assert lines[0] == "" and lines[2] == ""
    assert lines[1] == "plain\trich\t"
    assert lines[3].split("\t")[:-1] == [
        str(dt.datetime(2024, 1, 1)),
        str(dt.datetime(2024, 1, 1, 12)),
        "06:00:00",
        "1.5",
        "1 day, 12:00:00",
        "10000000.0",
        "1900-02-28 00:00:00",
        "True",
        "12:00:34.560000",
        "2024-01-01 00:00:00.500000",
        "-2 days, 18:00:00",
        "1e-07",
        "123456789012345678901",
        "#VALUE!",
    ]
    assert lines[4] == "=SUM(B1:B2)\t#N/A\t=A1+$B$1\t"
    assert lines[5] == "=\t"  # as stored: the formula is another cell's


def test_workbook_stated_size_clips(spark):
    data = xlsx({"s": row(1, 2, 3) + row(4, 5, 6)}, before='<dimension ref="A1:B1"/>')
    assert text_of(spark, "/d/c.xlsx", data).text == "1\t2\t\n"


def test_chart_sheet_is_an_error(spark):
    r = text_of(spark, "/d/c.xlsx", xlsx({"s": row(1)}, kind="chartsheet"))
    assert r.status == "error" and r.text is None


def test_slides(spark):
    picture = "<p:pic/>"
    group = f"<p:grpSp>{shape('in group')}</p:grpSp>"
    broken = "<p:sp><p:txBody><a:p><a:r><a:t>u</a:t></a:r><a:br/><a:r><a:t>v</a:t></a:r></a:p></p:txBody></p:sp>"
    r = text_of(
        spark, "/d/d.pptx", pptx(shape("t1") + "<p:sp/>" + picture + group, shape("t2", "t3") + broken)
    )
    assert r.text == "t1\n\nt2\nt3\nu\vv\n"


def test_workbook_strings_are_joined(spark):
    texts = ["a & <b>", "", "same", "tab\there"]
    rows = "".join(f"<row>{shared(k)}{shared(2)}</row>" for k in range(4))
    r = text_of(spark, "/d/a.xlsx", xlsx({"s": rows, "t": f"<row>{shared(0)}</row>"}, strings(texts)))
    assert r.text == "a & <b>\tsame\t\nsame\t\nsame\tsame\t\ntab\there\tsame\t\na & <b>\t\n"


def test_dates_from_1904(spark):
    styles = '<cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'
    data = xlsx({"s": f"<row>{cell(0.25, style=1)}{cell(1, style=1)}</row>"}, styles=styles)
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as new:
        for name in z.namelist():
            part = z.read(name)
            if name == "xl/workbook.xml":
                part = part.replace(b"<sheets>", b'<workbookPr date1904="1"/><sheets>')
            new.writestr(name, part)
    assert text_of(spark, "/d/a.xlsx", out.getvalue()).text == "06:00:00\t1904-01-02 00:00:00\t\n"


def test_pdf_without_a_library_says_so(spark):
    try:
        import pypdf  # noqa: F401
    except ImportError:
        r = text_of(spark, "/d/e.pdf", b"%PDF-1.4")
        assert r.status == "error" and "pypdf" in r.error and r.kind == "pdf"


def test_missing_rows_cost_nothing(spark):
    """A gap of a million rows is a number until Spark makes its line feeds."""
    far = f'<row r="1000000">{cell("far", "A1000000")}</row>'
    data = xlsx({"s": row("x") + far})
    tracemalloc.start()
    rows = list(extract._rows_of("a.xlsx", "xlsx", pa.py_buffer(data), cut.workbook(False)))
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()
    assert len(rows) == 1 and len(rows[0][4]) == 2
    text = text_of(spark, "/d/a.xlsx", data).text
    assert text == "x\t\n" + "\n" * 999_998 + "far\t\n"
    beyond = xlsx({"s": f'<row r="5000000">{cell("far")}</row>'})
    assert "last row" in text_of(spark, "/d/b.xlsx", beyond).error


def test_a_packed_workbook_is_read_in_pieces():
    """A small file of a million cells: a task holds a segment of it."""
    data = xlsx({"s": row(*[0] * 100) * 20_000})
    assert len(data) < 400_000
    rows = extract._rows_of("a.xlsx", "xlsx", pa.py_buffer(data), cut.workbook(False))
    tracemalloc.start()
    segments = [(r[2], r[3], len(r[4])) for r in rows]
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()
    assert [s[0] for s in segments] == list(range(len(segments))) and len(segments) > 3
    assert [s[1] for s in segments] == [False] * (len(segments) - 1) + [True]
    assert sum(s[2] for s in segments) == 20_000


def test_own_parser(spark):
    def lines(source):
        for i, line in enumerate(source.read().decode().split("|")):
            yield i, None, None, None, line, True

    files = spark.createDataFrame([("a.pdf", bytearray(b"x|y"))], "path string, content binary")
    parsed = parse_documents(files, {"pdf": lines})
    assert document_texts(parsed).first().text == "xy"
    assert parsed.first().status == "ok"

    def cells(source):
        yield 0, "s", 0, 0, "v", True
        yield 0, "s", 0, 1, "w", False
        yield 0, "s", 0, ROW_END, "", True

    files = spark.createDataFrame([("a.xlsx", bytearray(b""))], "path string, content binary")
    assert document_texts(parse_documents(files, {"xlsx": cells})).first().text == "v\t\n"


def test_wrong_main_part_is_an_error(spark):
    r = text_of(spark, "/d/a.docx", pptx(shape("t")))
    assert r.status == "error" and "presentation" in r.error


def make_tree(root):
    files = {
        "a.docx": docx(paragraph("hi") + paragraph("") + paragraph("bye")),
        "sub/A.DOCX": docx(paragraph("one")),
        "b.xlsx": xlsx({"s": row("x", 0, "y")}),
        "c.xlsm": xlsx({"s": row("1")}),
        "c.xltx": xlsx({"s": row("2")}),
        "deep/er/c.xltm": xlsx({"s": row("3")}),
        "d.pptx": pptx(shape("t1")),
        "e.pdf": b"no pdf",
        "bad.docx": b"not a zip",
        "empty.docx": b"",
        "_x.docx": docx(paragraph("under")),
        ".y.docx": docx(paragraph("dot")),
        ".hidden/z.docx": docx(paragraph("in hidden")),
        "n.jpg": b"jpg",
        "old.doc": b"doc",
        "with space%20.docx": docx(paragraph("sp")),
    }
    for name, data in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return files


def test_list_documents(spark, tmp_path):
    files = make_tree(tmp_path)
    rows = list_documents(spark, str(tmp_path)).collect()
    found = {r.path.removeprefix(f"file:{tmp_path}/"): r.length for r in rows}
    assert found == {k: len(v) for k, v in files.items()}


def test_extract_tree(spark, tmp_path):
    files = make_tree(tmp_path)
    rows = extract_tree(spark, str(tmp_path)).collect()
    got = {r.path.removeprefix(f"file:{tmp_path}/"): r for r in rows}
    assert set(got) == set(files) and len(rows) == len(files)
    assert got["a.docx"].text == "hi\n\nbye"
    assert got["sub/A.DOCX"].text == "one"
    assert got["_x.docx"].text == "under"
    assert got[".y.docx"].text == "dot"
    assert got[".y.docx"].out_name == ".y.txt"
    assert got[".hidden/z.docx"].text == "in hidden"
    assert got["with space%20.docx"].text == "sp"
    assert got["deep/er/c.xltm"].text == "3\t\n"
    assert got["bad.docx"].status == "error" and "BadZipFile" in got["bad.docx"].error
    assert got["empty.docx"].error == "empty file"
    assert got["n.jpg"].status == got["old.doc"].status == "unsupported"


def test_any_number_of_tasks_gives_the_same(spark, tmp_path):
    make_tree(tmp_path)
    some = sorted(map(repr, extract_tree(spark, str(tmp_path)).collect()))
    assert sorted(map(repr, extract_tree(spark, str(tmp_path), tasks=3).collect())) == some


def test_a_tree_as_a_source(spark, tmp_path, capfd):
    """Equal rows with extract_tree; files that filters leave out are not opened."""
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    (root / "a.docx").write_bytes(docx(paragraph("one")))
    (root / "sub" / ".b.docx").write_bytes(docx(paragraph("two")))
    (root / "c.XLSX").write_bytes(xlsx({"s": row("x", 1)}))
    (root / "d.docx").write_bytes(b"broken")
    (root / "e.docx").write_bytes(b"")
    (root / "f.md").write_bytes(b"text")

    def texts(df, name):
        df.write.parquet(str(tmp_path / name))
        rows = document_texts(spark.read.parquet(str(tmp_path / name))).collect()
        return sorted((r.path, r.kind, r.text, r.status, r.error) for r in rows)

    expected = sorted((r.path, r.kind, r.text, r.status, r.error) for r in extract_tree(spark, str(root)).collect())
    tree = scan_tree(spark, str(root), tasks=3)
    assert texts(tree, "all") == expected and len(expected) == 6
    assert {r.path.rpartition("/")[2]: r.length for r in tree.select("path", "length").collect()}["f.md"] == 4
    (root / "d.docx").unlink()  # whoever opens it now gets another error
    (root / "c.XLSX").unlink()
    asked = [
        ("kind", F.col("kind") == "docx", lambda r: r[1] == "docx" and "d.docx" not in r[0]),
        ("name", F.col("path").endswith("a.docx"), lambda r: r[0].endswith("a.docx")),
        ("set", F.col("kind").isin("unsupported", "pdf"), lambda r: r[1] == "unsupported"),
        ("size", (F.col("length") < 5) & F.col("path").contains("in"), lambda r: r[0][-4:] in ("e.docx"[-4:], "f.md") and r[3] != "ok" and "d.docx" not in r[0]),
    ]
    for name, condition, kept in asked:
        df = tree.where(condition & ~F.col("path").endswith("d.docx"))
        found = texts(df, name)
        assert found == [r for r in expected if kept(r)], name
    tree.where("kind = 'docx' AND length > 3 AND path LIKE '%a.docx'").explain()
    plan = capfd.readouterr().out
    assert "document_tree" in plan and not re.search(r"^\W*Filter", plan, re.M)


def test_odd_trees(spark, tmp_path):
    root = tmp_path / "[odd] {x} *"
    (root / "sub").mkdir(parents=True)
    (root / "sub" / "a.docx").write_bytes(docx(paragraph("a")))
    (root / "l.docx").symlink_to(root / "sub" / "a.docx")
    (root / "broken.docx").symlink_to(root / "nothing.docx")

    def rows():
        found = extract_tree(spark, str(root)).collect()
        return {r.path.rpartition("*/")[2]: (r.status, r.text) for r in found}

    expected = {"sub/a.docx": ("ok", "a"), "l.docx": ("ok", "a"), "broken.docx": ("error", None)}
    assert rows() == expected
    (root / "again").symlink_to(root)  # a link to a folder is not followed
    assert rows() == expected


NAMES = [
    "a.docx", "_a=b.docx", "_metadata.docx", "_common_metadata_x.docx", ".a=b.docx", "_d/x.docx",
    "_d=1/x.docx", "d._COPYING_/x.docx", "_metadata/x.docx", ".x/_d=1/x.docx", "_metadata/_q.docx",
    "k=v/_z.docx", "_common_metadata/y.docx", "A._COPYING_.docx", "sub/_temporary/0/x.docx",
    "x=1/y=2/x.docx", "n\nl/_x.docx", "n\nl/x.docx",
]


def test_every_name_is_read_once(spark, tmp_path):
    for name in NAMES:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(docx(paragraph(name.replace("\n", " "))))
    rows = extract_tree(spark, str(tmp_path)).collect()
    assert sorted(r.path.removeprefix(f"file:{tmp_path}/") for r in rows) == sorted(NAMES)
    assert {r.status for r in rows} == {"ok"}


def test_storage_only_spark_can_reach(spark, tmp_path, monkeypatch):
    files = make_tree(tmp_path)
    monkeypatch.setattr(documents, "reachable", lambda uri: False)
    with pytest.raises(Unreachable, match="scan_visible"):
        extract_tree(spark, str(tmp_path))
    rows = extract_texts(scan_visible(spark, str(tmp_path))).collect()
    names = {r.path.removeprefix(f"file:{tmp_path}/") for r in rows}
    assert names == set(files) - {"_x.docx", ".y.docx", ".hidden/z.docx", "empty.docx"}


def test_uris():
    assert storage.resolve("/a b/%20")[1] == storage.resolve("file:/a b/%20")[1] == "/a b/%20"
    assert storage.resolve("file:///a")[1] == "/a"
    assert storage.qualified("/a") == "file:/a" and storage.reachable("/a")
    assert not storage.reachable("nosuch://host/a")


def test_missing_root_is_reported(spark, tmp_path):
    rows = list_documents(spark, str(tmp_path / "none")).collect()
    assert len(rows) == 1 and "FileNotFoundError" in rows[0].problem


def test_run_extraction(spark, tmp_path):
    root = tmp_path / "in"
    make_tree(root)
    with pytest.raises(OutputCollision):
        run_extraction(spark, str(root), str(tmp_path / "t0"), str(tmp_path / "x"))
    counts = run_extraction(
        spark, str(root), str(tmp_path / "t1"), str(tmp_path / "last"), on_collision="last"
    )
    assert (counts["n_files"], counts["n_errors"], counts["n_unsupported"]) == (16, 3, 2)
    out = tmp_path / "last"
    assert (out / "c.txt").read_text() == "3\t\n"  # the greatest path wins
    assert (out / "a.txt").read_text() == "hi\n\nbye"
    assert len([p for p in out.iterdir()]) == counts["n_written"]
    run_extraction(
        spark, str(root), str(tmp_path / "t2"), str(tmp_path / "all"), on_collision="suffix"
    )
    assert len(list((tmp_path / "all").glob("c-*.txt"))) == 3
    with pytest.raises(TooManyErrors):
        run_extraction(spark, str(root), str(tmp_path / "t3"), max_error_ratio=0.01)


def test_long_texts_go_on_in_segments(spark, tmp_path, monkeypatch):
    """Segments, pieces of a record and batches of any size give the same texts."""
    lines = [f"line {i} & <more>" for i in range(20)]
    files = {
        "/d/a.docx": docx("".join(paragraph(t) for t in lines)),
        "/d/b.xlsx": xlsx({"s": "".join(f"<row>{cell(t)}{shared(k)}{cell(k)}</row>" for k, t in enumerate(lines))}, strings(lines)),
        "/d/c.pptx": pptx("".join(shape(t, t) for t in lines), shape("end")),
        "/d/d.docx": truncated("x " * 3000, "docx"),
        "/d/e.docx": b"broken",
        "/d/f.docx": docx(""),
    }

    def texts():
        made = []
        for path, data in files.items():
            kind = path.rpartition(".")[2]
            made += extract._rows_of(path, kind, pa.py_buffer(data), extract.cutters(None)[kind])
        parsed = pa.Table.from_batches([extract.batch_of([r]) for r in made])
        return document_texts(spark.createDataFrame(parsed.to_pandas(), extract.PARSED_DDL).repartition(4))

    def by_path(df):
        out = {}
        for r in df.orderBy("path", "segment_no").collect():
            out.setdefault(r.path, []).append((r.status, r.is_last, r.text))
        return out

    whole = by_path(texts())
    assert {len(v) for v in whole.values()} == {1}
    monkeypatch.setattr(extract, "SEGMENT_BYTES", 100)
    monkeypatch.setattr(cut, "PIECE_CHARS", 7)
    df = texts()
    pieces = by_path(df)
    assert len(pieces["/d/a.docx"]) > 3 and len(pieces["/d/b.xlsx"]) > 3
    for path, rows in pieces.items():
        assert [r[1] for r in rows] == [False] * (len(rows) - 1) + [True]
        assert rows[-1][0] == whole[path][0][0]
        if rows[-1][0] == "ok":
            assert "".join(r[2] for r in rows) == whole[path][0][2]
    counts = extract_metrics(df).first()
    assert (counts.n_files, counts.n_ok, counts.n_errors) == (6, 4, 2)
    written = {r.path: r.n_bytes for r in write_text_files(df, str(tmp_path / "out")).collect()}
    assert set(written) == {p for p in files if whole[p][0][0] == "ok"}
    for path, n in written.items():
        text = whole[path][0][2].encode()
        assert (tmp_path / "out" / path[3:].replace(path[-4:], "txt")).read_bytes() == text and n == len(text)


def test_batches_are_bounded(monkeypatch):
    monkeypatch.setattr(extract, "_BATCH_BYTES", 20)
    files = [docx(paragraph("12345678")) for _ in range(5)] + [b"broken"]
    columns = {"path": [f"{i}.docx" for i in range(6)], "kind": ["docx"] * 6, "content": files}
    out = list(extract.cut_batches(iter([pa.RecordBatch.from_pydict(columns)]), extract.cutters(None)))
    assert [b.num_rows for b in out] == [2, 2, 2]
    assert [r["status"] for b in out for r in b.to_pylist()] == ["ok"] * 5 + ["error"]


@pytest.mark.parametrize("limit", [10**6, 0, 40])
def test_shared_strings_by_offset(tmp_path, monkeypatch, limit):
    monkeypatch.setattr(strings_module, "IN_MEMORY", limit)
    monkeypatch.setattr(strings_module, "BLOCK", 3)
    monkeypatch.setattr(strings_module, "CACHED", 2)
    given = [f"é{k}" * (k % 5) for k in range(100)]
    table = strings_module.SharedStrings(iter(given), str(tmp_path / "s"))
    for order in (range(100), random.Random(1).sample(range(100), 100)):
        assert [table.get(k) for k in order] == [given[k] for k in order]
    assert table.get(100) is None and table.get(-1) is None and len(table.blocks) <= 2
    assert len(list((tmp_path / "s").glob("*"))) == (limit < 10**6)
    table.close()
    assert not list((tmp_path / "s").glob("*"))
    assert strings_module.SharedStrings(iter([]), str(tmp_path / "s")).get(0) is None
    assert strings_module.SharedStrings(iter(given), None).get(99) == given[99]


def test_shared_strings_in_a_file_give_the_same_texts(spark, monkeypatch):
    names = [f"name {k} & <é>" for k in range(300)]
    rows = "".join(f"<row>{shared(k)}{shared(299 - k)}{shared(777)}</row>" for k in range(300))
    data = xlsx({"s": rows}, strings(names))
    expected = "".join(f"{names[k]}\t{names[299 - k]}\t\n" for k in range(300))
    assert text_of(spark, "/d/a.xlsx", data).text == expected
    cutter = cut.workbook(False, extract.strings_folder(spark))
    monkeypatch.setattr(strings_module, "IN_MEMORY", 100)
    found = [r for r in cutter(io.BytesIO(data))]
    assert names[5] in found[5][4] and names[294] in found[5][4]


def test_elements_table(spark):
    data = xlsx({"s": row("x", 0)})
    files = spark.createDataFrame([("a.xlsx", bytearray(data))], "path string, content binary")
    rows = document_elements(parse_documents(files)).where("cell_no < 100").collect()
    assert [(r.part_name, r.row_no, r.cell_no, r.text, r.keep) for r in rows] == [
        ("s", 0, 0, "x", True),
        ("s", 0, 1, "0", False),
    ]


def test_files_are_parsed_once_and_cells_are_made_by_spark(spark):
    data = [("a.docx", bytearray(b"")), ("b.md", bytearray(b"x"))]
    files = spark.createDataFrame(data, "path string, content binary")
    texts = extract_texts(files)
    plan = texts._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "regexp_extract_all" in plan
    assert sorted(r.status for r in texts.collect()) == ["error", "unsupported"]


def test_supported_names_in_any_case(spark):
    names = ["/a.DocX", "/a.xlsx", "/a.XLTM", "/b.pdf", "/b.PPTX", "/docx", "/a.docx.bak", "/a.xls"]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    kinds = [r.kind for r in extract.route(df).select(F.col("kind")).collect()]
    assert kinds == ["docx", "xlsx", "xlsx", "pdf", "pptx"] + ["unsupported"] * 3


def test_files_are_written_and_told_of_many_at_a_time(tmp_path):
    """A file costs no batch of its own; of a file written twice each attempt has one."""
    texts = [f"é{k}" for k in range(2500)]
    columns = {"path": [f"/{k}" for k in range(2500)], "out_name": [f"{k}.txt" for k in range(2500)],
               "segment_no": [0] * 2500, "text": texts}
    for attempt in (1, 2):
        batch = pa.RecordBatch.from_pydict(columns)
        made = list(text_files._write(iter([batch.slice(0, 1700), batch.slice(1700)]), str(tmp_path)))
        assert [b.num_rows for b in made] == [1000, 1000, 500]
        rows = [r for b in made for r in b.to_pylist()]
        assert [(tmp_path / r["partial"]).read_text() for r in rows] == texts
        assert len(list(tmp_path.iterdir())) == attempt * 2500


@pytest.mark.parametrize("on_collision", ["error", "last", "suffix"])
def test_written_texts_are_read_again_in_few_tasks(spark, tmp_path, on_collision):
    texts = {f"/{k}.docx": f"é\r\n{k}" * (k % 3) for k in range(600)}
    rows = [(p, f"n{p[1:-5]}.txt", 0, True, t, "ok") for p, t in texts.items()]
    if on_collision != "error":
        rows += [(f"/z{p}", name, 0, True, t + "!", "ok") for p, name, _, _, t, _ in rows[:5]]
    df = spark.createDataFrame(rows, "path string, out_name string, segment_no int, is_last boolean, text string, status string")
    folder = str(tmp_path / "out")
    told = write_text_files(df, folder, on_collision).collect()
    stored = text_files.read_text_files(spark, folder)
    assert stored.rdd.getNumPartitions() <= 3
    found = {r.name: r.text for r in stored.collect()}
    by_path = {r[0]: r[4] for r in rows}
    assert found == {r.out_name: by_path[r.path] for r in told}
    assert len(found) == {"error": 600, "last": 600, "suffix": 605}[on_collision]
    assert found["n4.txt"] == "é\r\n4" + "!" * (on_collision == "last") if on_collision != "suffix" else "n4.txt" not in found
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_a_missing_pdf_library_is_looked_for_once(monkeypatch):
    """A search of all places for each file takes longer than the file."""
    import io
    import sys

    from parchmill.formats import cut

    asked = []

    class Spy:
        @staticmethod
        def find_spec(name, path=None, target=None):
            asked.append(name)

    monkeypatch.setattr(sys, "meta_path", [Spy])
    monkeypatch.setattr(sys, "path", [*sys.path, "/nowhere"])
    monkeypatch.delitem(sys.modules, "pypdf", raising=False)
    for _ in range(5):
        with pytest.raises(ModuleNotFoundError, match="No module named 'pypdf'"):
            list(cut.pdf(io.BytesIO(b"")))
    assert asked == ["pypdf"]
