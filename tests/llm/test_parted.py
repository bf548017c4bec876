"""Rows that may have a key, and those that certainly do not."""

import pytest
from pyspark.sql import functions as F

from parchmill.llm import parted as module
from parchmill.llm.secret_scan import candidates, redact


@pytest.mark.parametrize("most", [1 << 28, 1 << 16])
def test_all_rows_are_in_one_part(spark, monkeypatch, most):
    monkeypatch.setattr(module, "MOST_BITS", most)
    rows = spark.range(60_000).select(F.when(F.col("id") != 7, F.col("id")).alias("id"), F.lit("x").alias("t"))
    for keys in ([], [0], list(range(3, 60_000, 9))):
        few = spark.createDataFrame([(k,) for k in keys], "k long")
        some, others = module.parted(rows, F.col("id"), few)
        assert some.columns == others.columns == ["id", "t"]
        some, others = [r.id for r in some.collect()], [r.id for r in others.collect()]
        assert len(some) + len(others) == 60_000 and {*some, *others} == {None, *range(60_000)} - {7}
        assert {*keys} <= {*some, 7} and not {*keys} & {*others}
        assert len(some) <= len(keys) + (60_000 / 8 if most > 1 << 16 else 12_000)


def test_texts_without_a_secret_are_not_shuffled(spark, make):
    key = "k3y+" + "aB1" * 8
    docs = make([(k, f'token = "{key}"' if k == 5 else f"text {k}") for k in range(500)], source="s")
    findings = candidates(docs).withColumnRenamed("id", "doc_id").withColumn("is_secret", F.lit(True))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = redact(docs, findings)
        rows = {r.doc_id: r.text for r in made.collect()}
        plan = made._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == {k: 'token = "[SECRET]"' if k == 5 else f"text {k}" for k in range(500)}
    final = plan.split("Initial Plan")[0]
    assert "Union" in final and final.count("BroadcastHashJoin") == 2 and final.count("SortMergeJoin") == 1
