import hashlib
import json

import pytest
from pyspark.sql import functions as F

from parchmill.functions.masks import MASKS, mask, mask_sql
from parchmill.operators import policies
from parchmill.operators.masked_views import create_masked_view
from parchmill.operators.masking import apply_masks
from parchmill.operators.policies import (
    InvalidPolicyLine,
    apply_upsert,
    desired_policies,
    drop_versions,
    has_field,
    lookup_policy,
    parse_policies,
    policy_document,
    policy_outcomes,
    policy_rejects,
    policy_store_after,
    policy_upsert_plan,
    store_as_of,
    store_versions,
    stored_items,
    stored_rules,
)
from parchmill.plans.masking_policies import apply_rule_list
from parchmill.sources.lines import scan_policy_lines


def masked(spark, option, values, data_type="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {data_type}")
    field = df.schema["v"]
    out = df.select(mask(F.col("v"), field.dataType, option).alias("v"))
    assert out.schema["v"].dataType == (field.dataType)
    return [r.v for r in out.collect()]


def test_redact(spark):
    assert masked(spark, "MASK", ["AbC-12 éÉß٣", "", None]) == ["XxX-nn xXxn", "", None]
    assert masked(spark, "MASK", [9223372036854775807, -105, None], "bigint") == [
        1111111111111111111,
        -111,
        None,
    ]
    assert masked(spark, "MASK", [1.5], "double") == [None]


def test_show_last_4(spark):
    values = ["4111-1111-1234-5678", "Abcdefgh", "abc", "abcd", "", None]
    assert masked(spark, "MASK_SHOW_LAST_4", values) == [
        "xxxx-xxxx-xxxx-5678", "xxxxefgh", "abc", "abcd", "", None,
    ]
    assert masked(spark, "MASK_SHOW_LAST_4", [123456, 12, None], "int") == [113456, 12, None]
    assert masked(spark, "MASK_SHOW_LAST_4", [True], "boolean") == [None]


def test_hash_and_null(spark):
    assert masked(spark, "MASK_HASH", ["é", None]) == [
        hashlib.sha256("é".encode()).hexdigest(),
        None,
    ]
    assert masked(spark, "MASK_HASH", [5], "int") == [None]
    assert masked(spark, "MASK_NULL", [5.0], "double") == [None]


def test_unknown_mask(spark):
    with pytest.raises(ValueError, match="MASK_SOME"):
        masked(spark, "MASK_SOME", ["a"])


LIST = """# rules
  # indented comment

mydb,mytable,ssn,MASK
mydb, mytable , credit card ,MASK_SHOW_LAST_4
mydb,customers,email,MASK_HASH
sales,orders,order_total,MASK_NULL
mydb,mytable,ssn,MASK_HASH"""


def rule_file(spark, tmp_path, text):
    path = tmp_path / "rules.txt"
    path.write_text(text)
    return scan_policy_lines(spark, str(path))


def test_parse(spark, tmp_path):
    rules = parse_policies(rule_file(spark, tmp_path, LIST)).orderBy("line_pos").collect()
    assert [(r.database, r.table, r.column, r.masking_option) for r in rules] == [
        ("mydb", "mytable", "ssn", "MASK"),
        ("mydb", "mytable", "credit card", "MASK_SHOW_LAST_4"),
        ("mydb", "customers", "email", "MASK_HASH"),
        ("sales", "orders", "order_total", "MASK_NULL"),
        ("mydb", "mytable", "ssn", "MASK_HASH"),
    ]


def test_malformed_lines(spark, tmp_path):
    lines = rule_file(spark, tmp_path, "a,b,c,MASK\na,b,c\na,b,c,d,e\n")
    with pytest.raises(InvalidPolicyLine, match="a,b,c"):
        parse_policies(lines)
    assert parse_policies(lines, on_error="skip").count() == 1
    assert {r.n_fields for r in policy_rejects(lines).collect()} == {3, 5}


def test_apply_masks(spark, tmp_path):
    rules = parse_policies(rule_file(spark, tmp_path, LIST))
    df = spark.createDataFrame([("123-45", "4111-5678", 1)], ["SSN", "credit card", "n"])
    out = apply_masks(df, "mydb", "mytable", rules)
    row = out.collect()[0]
    assert out.columns == df.columns
    assert row["SSN"] == hashlib.sha256(b"123-45").hexdigest()  # the last rule wins
    assert row["credit card"] == "xxxx-5678" and row["n"] == 1
    assert apply_masks(df, "mydb", "other", rules).collect() == df.collect()


def test_columns_that_differ_in_case_only(spark, tmp_path):
    rules = parse_policies(rule_file(spark, tmp_path, "d,t,ssn,MASK_NULL"))
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = spark.createDataFrame([("111", "222", "x")], ["ssn", "SSN", "n"])
        assert apply_masks(df, "d", "t", rules).collect() == [(None, None, "x")]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_masked_plan_has_no_python_and_keeps_pushdown(spark, tmp_path):
    rules = parse_policies(rule_file(spark, tmp_path, "d,t,s,MASK_HASH\nd,t,n,MASK_NULL"))
    path = str(tmp_path / "t")
    spark.range(10).selectExpr("id", "string(id) s", "id n").write.parquet(path)
    out = apply_masks(spark.read.parquet(path), "d", "t", rules).where("id > 5").select("id", "s")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert "GreaterThan(id,5)" in plan and "ReadSchema: struct<id:bigint,s:string>" in plan


def test_document(spark):
    parts = [F.lit(v) for v in ("d", "t", "c", "ANY_OPTION")]
    row = spark.range(1).select(policy_document(*parts, service="svc").alias("j")).first()
    document = json.loads(row.j)
    assert list(document)[:4] == ["service", "name", "policyType", "description"]
    assert document["name"] == "masking-d-t-c" and document["policyType"] == 0
    assert document["options"] == {} and document["policyItems"] == []
    item = document["dataMaskPolicyItems"][0]
    assert item["dataMaskInfo"] == {
        "dataMaskType": "ANY_OPTION", "conditionExpr": "", "valueExpr": "",
    }
    assert item["groups"] == ["public"] and document["resources"]["table"]["values"] == ["t"]


def wanted(spark, *rules):
    rows = [(i, *r) for i, r in enumerate(rules)]
    ddl = "line_pos bigint, database string, table string, column string, masking_option string"
    return desired_policies(spark.createDataFrame(rows, ddl), "svc")


def test_upsert(spark):
    store = spark.createDataFrame(
        [(7, "masking-a-b-c", "old"), (9, "masking-a-b-c", "second"), (3, "other", "kept")],
        "id bigint, name string, document string",
    )
    desired = wanted(
        spark,
        ("a", "b", "c", "MASK"),
        ("a", "b", "c", "MASK_HASH"),
        ("x-y", "z", "c", "MASK"),
        ("x", "y-z", "c", "MASK_NULL"),
        ("n", "n", "n", "MASK"),
    )
    plan = policy_upsert_plan(desired, store)
    rows = {r.name: r for r in plan.collect()}
    assert rows["masking-a-b-c"].action == "update" and rows["masking-a-b-c"].id == 7
    assert rows["masking-a-b-c"].masking_option == "MASK_HASH"
    assert rows["masking-a-b-c"].n_lines == 2 and not rows["masking-a-b-c"].ambiguous
    assert rows["masking-x-y-z-c"].ambiguous and rows["masking-x-y-z-c"].action == "create"
    after = {r.id: (r.name, r.document) for r in policy_store_after(desired, store).collect()}
    assert after[3] == ("other", "kept") and after[9] == ("masking-a-b-c", "second")
    assert '"MASK_HASH"' in after[7][1]
    assert {after[i][0] for i in (10, 11)} == {"masking-x-y-z-c", "masking-n-n-n"}
    assert len(after) == 5
    assert lookup_policy(store, "other").first().id == 3


def test_rule_list_job(spark, tmp_path):
    spark.sql("CREATE DATABASE IF NOT EXISTS pol")
    path = tmp_path / "rules.txt"
    path.write_text(LIST)
    rows = apply_rule_list(spark, str(path), "pol", "from_list", "svc").collect()
    assert {r.action for r in rows} == {"create"} and len(rows) == 4
    assert all(r.succeeded for r in rows)
    rows = apply_rule_list(spark, str(path), "pol", "from_list", "svc", policy_type=1).collect()
    assert {r.action for r in rows} == {"update"} and all(r.succeeded for r in rows)
    stored = spark.table("pol.from_list").where("name = 'masking-mydb-mytable-ssn'").first()
    document = json.loads(stored.document)
    assert document["policyType"] == 1
    assert document["dataMaskPolicyItems"][0]["dataMaskInfo"]["dataMaskType"] == "MASK_HASH"
    path.write_text("a,b\n")
    with pytest.raises(InvalidPolicyLine):
        apply_rule_list(spark, str(path), "pol", "from_list", "svc")


def test_apply_upsert_to_a_table(spark, tmp_path):
    folder = tmp_path / "pol2"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS pol2 LOCATION '{folder}'")
    first = apply_upsert(spark, "pol2", "store", wanted(spark, ("a", "b", "c", "MASK")))
    assert [(r.name, r.action, r.id, r.succeeded) for r in first.collect()] == [
        ("masking-a-b-c", "create", 1, True)
    ]
    again = wanted(spark, ("a", "b", "c", "MASK_NULL"), ("a", "b", "d", "MASK"))
    second = {r.name: (r.action, r.id, r.succeeded) for r in apply_upsert(spark, "pol2", "store", again).collect()}
    assert second == {
        "masking-a-b-c": ("update", 1, True),
        "masking-a-b-d": ("create", 2, True),
    }
    assert spark.table("pol2.store").count() == 2
    places = [p.name for p in folder.iterdir() if p.name.startswith("store__")]
    assert len(places) == 2  # the state before is there for those that read it


def test_an_upsert_that_fails_changes_nothing(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS pol")
    apply_upsert(spark, "pol", "kept", wanted(spark, ("a", "b", "c", "MASK")))
    before = spark.table("pol.kept").collect()
    broken = wanted(spark, ("a", "b", "c", "MASK_NULL")).withColumn(
        "document", F.raise_error(F.lit("lost")).cast("string")
    )
    with pytest.raises(Exception, match="lost"):
        apply_upsert(spark, "pol", "kept", broken)
    assert spark.table("pol.kept").collect() == before


def test_two_upserts_at_once_both_count(spark, monkeypatch):
    """A second job commits between the reading and the commit of the first."""
    spark.sql("CREATE DATABASE IF NOT EXISTS pol")
    apply_upsert(spark, "pol", "busy", wanted(spark, ("a", "b", "c", "MASK"), ("a", "b", "d", "MASK")))
    merge, waiting = policies.merge_policies, [wanted(spark, ("a", "b", "c", "MASK_NULL"), ("a", "b", "x", "MASK"))]

    def interrupted(new, store):
        merged = merge(new, store)
        if waiting:
            other = waiting.pop()
            apply_upsert(spark, "pol", "busy", other)
        return merged

    monkeypatch.setattr(policies, "merge_policies", interrupted)
    rows = apply_upsert(spark, "pol", "busy", wanted(spark, ("a", "b", "d", "MASK_HASH"), ("a", "b", "y", "MASK"))).collect()
    assert sorted((r.name, r.action, r.succeeded) for r in rows) == [
        ("masking-a-b-d", "update", True), ("masking-a-b-y", "create", True),
    ]
    held = {r.column: r.masking_option for r in stored_rules(spark.table("pol.busy")).collect()}
    assert held == {"c": "MASK_NULL", "d": "MASK_HASH", "x": "MASK", "y": "MASK"}
    ids = [r.id for r in spark.table("pol.busy").collect()]
    assert sorted(ids) == [1, 2, 3, 4]
    assert store_versions(spark, "pol", "busy") == [1, 2, 3]
    first, second = ({r.column for r in stored_rules(store_as_of(spark, "pol", "busy", v)).collect()} for v in (1, 2))
    assert first == {"c", "d"} and second == {"c", "d", "x"}
    assert store_as_of(spark, "pol", "busy", 0).collect() == []
    drop_versions(spark, "pol", "busy", keep=1)
    assert store_versions(spark, "pol", "busy") == [3] and spark.table("pol.busy").count() == 4
    apply_upsert(spark, "pol", "busy", wanted(spark, ("a", "b", "z", "MASK")))
    assert spark.table("pol.busy").count() == 5


def test_a_store_without_versions_keeps_its_state(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS pol")
    spark.createDataFrame([(4, "masking-a-b-c", "{}")], "id bigint, name string, document string").write.saveAsTable("pol.old")
    apply_upsert(spark, "pol", "old", wanted(spark, ("a", "b", "c", "MASK"), ("a", "b", "d", "MASK")))
    assert [tuple(r) for r in store_as_of(spark, "pol", "old", 1).collect()] == [(4, "masking-a-b-c", "{}")]
    assert {r.id for r in spark.table("pol.old").collect()} == {4, 5}


# --- views -------------------------------------------------------------------


@pytest.fixture(scope="module")
def people(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS seen")
    rows = [(k, f"Name-{k}é", k * 1000 + 7, k / 7, k % 2 == 0, "x'y") for k in range(50)] + [(None,) * 6]
    kinds = "id int, name string, number bigint, share double, flag boolean, `odd``col` string"
    spark.createDataFrame(rows, kinds).repartition(1).write.mode("overwrite").saveAsTable("seen.people")
    spark.createDataFrame([(me(spark), "staff"), ("other", "admins")], "user_name string, group_name string").write.mode(
        "overwrite"
    ).saveAsTable("seen.members")
    return spark.table("seen.people")


def me(spark):
    return spark.sql("SELECT current_user()").first()[0]


def rules_for(spark, *pairs):
    rows = [(k, "seen", "people", c, o) for k, (c, o) in enumerate(pairs)]
    return spark.createDataFrame(rows, "line_pos int, database string, table string, column string, masking_option string")


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("option", sorted(MASKS))
def test_a_view_masks_like_the_function(spark, people, option):
    rules = rules_for(spark, *[(c.upper(), option) for c in people.columns if c != "id"])
    create_masked_view(spark, "seen", "people", "view", rules)
    view = spark.table("seen.view")
    assert view.schema.simpleString() == people.schema.simpleString()
    assert rows_of(view) == rows_of(apply_masks(people, "seen", "people", rules))
    with pytest.raises(ValueError, match="no mask"):
        mask_sql("`a`", people.schema["id"].dataType, "MASK_NO")


def test_who_reads_a_view_decides(spark, people):
    rules = rules_for(spark, ("name", "MASK_NULL"))
    masked_rows, plain = rows_of(apply_masks(people, "seen", "people", rules)), rows_of(people)

    def seen(**exempt):
        create_masked_view(spark, "seen", "people", "view", rules, members=("seen", "members"), **exempt)
        return rows_of(spark.sql("SELECT * FROM seen.view"))

    assert seen() == seen(exempt_users=["o'ther"]) == seen(exempt_groups=["admins"]) == masked_rows
    assert seen(exempt_users=["x", me(spark)]) == seen(exempt_groups=["staff"]) == plain
    with pytest.raises(ValueError, match="members"):
        create_masked_view(spark, "seen", "people", "view", rules, exempt_groups=["staff"])


def test_stored_policies_with_several_items(spark, people):
    def document(column, *items):
        return json.dumps(
            {
                "resources": {k: {"values": [v]} for k, v in (("database", "seen"), ("table", "people"), ("column", column))},
                "dataMaskPolicyItems": [
                    {"dataMaskInfo": {"dataMaskType": o}, "users": u, "groups": g} for o, u, g in items
                ],
            }
        )

    rows = [
        (1, "a", document("name", ("MASK_NONE", [me(spark)], []), ("MASK", [], ["public"]))),
        (2, "b", document("number", ("MASK_NONE", ["nobody"], []), ("MASK_HASH", [], ["staff"]), ("MASK", [], ["public"]))),
        (3, "c", document("share", ("MASK_NULL", [], ["admins"]))),
        (4, "d", document("id", ("MASK_NULL", ["nobody"], []))),
        (5, "e", "no json"),
    ]
    store = spark.createDataFrame(rows, "id bigint, name string, document string")
    create_masked_view(spark, "seen", "people", "view", stored_items(store), members=("seen", "members"))
    expected = apply_masks(people, "seen", "people", rules_for(spark, ("number", "MASK_HASH")))
    assert rows_of(spark.table("seen.view")) == rows_of(expected)


def test_filters_on_columns_without_a_mask_reach_the_scan(spark, people):
    rules = rules_for(spark, ("name", "MASK"))
    for exempt, pushed in ((["nobody"], ["IsNotNull(id)"]), ([me(spark)], ["IsNotNull(id)", "IsNotNull(name)"])):
        create_masked_view(spark, "seen", "people", "view", rules, exempt_users=exempt)
        df = spark.sql("SELECT id, name FROM seen.view WHERE id > 3 AND name = 'Name-5é'")
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan.partition("PushedFilters: [")[2].partition("]")[0]
        assert all(p in filters for p in pushed) and ("name" in filters) == (len(pushed) > 1)
        assert "number" not in plan.partition("ReadSchema")[2]
        assert df.count() == (len(pushed) > 1)


def test_rules_and_store_are_read_once(spark, tmp_path):
    rules, store = str(tmp_path / "rules"), str(tmp_path / "store")
    wanted(spark, ("a", "b", "c", "MASK"), ("n", "n", "n", "MASK")).write.parquet(rules)
    spark.createDataFrame([(4, "masking-a-b-c", "x")], "id bigint, name string, document string").write.parquet(store)
    for made in (policy_store_after, policy_outcomes):
        df = made(spark.read.parquet(rules), spark.read.parquet(store))
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert rules not in plan and store not in plan  # read before, once, to be merged
        assert df.count() == 2


def test_stored_documents_are_read_back(spark):
    empty = spark.createDataFrame([], "id bigint, name string, document string")
    store = policy_store_after(wanted(spark, ("d", "t", "c", "MASK_HASH")), empty)
    store = store.unionByName(spark.createDataFrame([(9, "x", "no json"), (10, "y", "{}")], empty.schema))
    rows = {r.id: r for r in stored_rules(store).collect()}
    assert rows[1][1:] == ("masking-d-t-c", "svc", 0, "d", "t", "c", "MASK_HASH")
    assert rows[9][2:] == rows[10][2:] == (None,) * 6
    found = store.select("id", has_field(F.col("document"), "resources", "table").alias("f")).collect()
    assert {r.id: r.f for r in found} == {1: True, 9: False, 10: False}
