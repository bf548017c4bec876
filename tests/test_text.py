import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from parchmill.functions import text as t

PLAIN = st.characters(exclude_categories=("Cs",), exclude_characters="\0")
LINES = st.lists(
    st.text(st.one_of(PLAIN, st.sampled_from(t.WHITESPACE + ",#\t")), max_size=12), max_size=30
)
QUICK = settings(
    max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def column(spark, values, of):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    return [r.out for r in df.select("i", of(F.col("v")).alias("out")).orderBy("i").collect()]


def test_whitespace_is_that_of_python():
    assert set(t.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


@QUICK
@given(LINES)
def test_strip(spark, lines):
    assert column(spark, lines, t.strip) == [s.strip() for s in lines]


@QUICK
@given(LINES)
def test_split_and_count(spark, lines):
    assert column(spark, lines, lambda c: t.split_fields(c, ",")) == [s.split(",") for s in lines]
    assert column(spark, lines, lambda c: t.count_char(c, "\t")) == [s.count("\t") for s in lines]


NAMES = ["a", ".a", "a.", "..x", ".a.b", "...", "a.b.c", "", "....a.b", "a b.txt", "a\n.b", "é.X"]


@pytest.mark.parametrize("folder", ["", "/", "x.y/", "/a/b.c/"])
def test_output_name(spark, folder):
    paths = [folder + n for n in NAMES]
    expected = [os.path.splitext(os.path.basename(p))[0] + ".txt" for p in paths]
    assert column(spark, paths, t.out_name) == expected


def test_truthy(spark):
    df = spark.sql("SELECT * FROM VALUES (null, null, null, null), ('', 0, 0.0D, false), "
                   "('0', 1, -0.5D, true) AS v(s, i, d, b)")
    out = df.select(*[t.truthy(F.col(n), k).alias(n) for n, k in df.dtypes]).collect()
    assert [set(r) for r in out] == [{False}, {False}, {True}]
