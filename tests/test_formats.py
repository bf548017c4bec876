"""Random texts survive the way into a file and out of it again."""

import pyarrow as pa
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from checks.builders import docx, paragraph, pptx, row, shape, xlsx
from parchmill.operators.extract import document_elements, document_texts, parse_documents

# What XML can carry as it is; a carriage return would come back as a line feed.
CHARS = st.characters(exclude_categories=("Cs", "Cc"), exclude_characters="\ufffe\uffff")
TEXT = st.text(CHARS, max_size=20)
LINES = st.lists(TEXT, max_size=12)
NUMBERS = st.one_of(st.integers(-(10**12), 10**12), st.floats(allow_nan=False, allow_infinity=False))
CELLS = st.lists(st.lists(st.one_of(TEXT, NUMBERS, st.booleans()), max_size=5), max_size=8)
# Many files at once: a Spark job costs more than a file.
QUICK = settings(
    max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def parsed(spark, files):
    table = pa.table({"path": list(files), "content": list(files.values())})
    return parse_documents(spark.createDataFrame(table))


@QUICK
@given(st.lists(LINES, min_size=5, max_size=40))
def test_word_and_slides(spark, texts):
    files = {f"{k}.docx": docx("".join(map(paragraph, t))) for k, t in enumerate(texts)}
    files |= {f"{k}.pptx": pptx("".join(map(shape, t)), shape(*t)) for k, t in enumerate(texts)}
    found = {r.path: r.text for r in document_texts(parsed(spark, files)).collect()}
    for k, t in enumerate(texts):
        assert found[f"{k}.docx"] == "\n".join(t)
        assert found[f"{k}.pptx"] == "".join(x + "\n" for x in t) + "\n".join(t) + "\n"


@QUICK
@given(st.lists(CELLS, min_size=5, max_size=40))
def test_workbooks(spark, books):
    files = {f"{k}.xlsx": xlsx({"s": "".join(row(*r) for r in b)}) for k, b in enumerate(books)}
    found = {}
    elements = document_elements(parsed(spark, files)).where(F.col("cell_no") >= 0)
    for r in elements.orderBy("path", "row_no", "cell_no").collect():
        found.setdefault(r.path, []).append((r.row_no, r.cell_no, r.text, r.keep))
    for k, b in enumerate(books):
        expected = [(i, j, str(v), bool(v)) for i, r in enumerate(b) for j, v in enumerate(r)]
        assert found.get(f"{k}.xlsx", []) == expected
