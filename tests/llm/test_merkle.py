"""The manifest against trees built in plain Python."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from parchmill.llm import merkle, queries

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    values = (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(digests):
    out = [digests]
    while len(out[-1]) > 1:
        below = out[-1]
        out.append([digest("".join(below[k : k + 8])) for k in range(0, len(below), 8)])
    return out


def climbed(tree, at, fold, siblings):
    for level in tree[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        left, right = run[: at % 8], run[at % 8 + 1 :]
        siblings += left + right
        fold, at = digest("".join([*left, fold, *right])), at // 8
    return fold


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda n: (n is not None, (n or "").encode()))
    trees = {}
    for n in names:
        groups[n].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
        trees[n] = levels([leaf(r, r["text"]) for r in groups[n]])
    over = levels([trees[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, r in enumerate(groups[n]):
            text = r["text"]
            if r["doc_id"] is not None and text is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                text = text.translate(LOWER)
            siblings = []
            fold = climbed(trees[n], i, leaf(r, text), siblings)
            fold = climbed(over, k, fold, siblings)
            root = over[-1][0]
            out.append((r["doc_id"], leaf(r, r["text"]), trees[n][-1][0], root, digest("".join(siblings)), fold, fold == root))
    return sorted(map(str, out))


FIELDS = ("doc_id", "text", "lang", "source", "n_chars")


def found(spark, rows, tmp_path, **more):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(*(r[c] for c in FIELDS), *more.values()) for r in rows], kinds + "".join(f", {c} string" for c in more))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return queries.QUERIES["op12_merkle"](spark, str(tmp_path))


def as_rows(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted(str(tuple(r[c] for c in names)) for r in df.collect())


def some_rows(n, langs, seed=1):
    rng = random.Random(seed)
    texts = [None, "", "Abc é", "xyz", "QQ W", "A" * 50_000]
    return [
        {
            "doc_id": rng.randrange(n) if rng.random() > 0.1 else None,
            "text": rng.choice(texts),
            "lang": rng.choice(langs),
            "source": rng.choice([None, "s", "T"]),
            "n_chars": rng.choice([None, 5]),
        }
        for _ in range(n)
    ]


def test_query_equals_its_sql(spark, sf_dir, documents):
    rows = as_rows(queries.QUERIES["op12_merkle"](spark, sf_dir))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    result = con.execute(queries.SQL["op12_merkle"]).fetchall()
    assert rows == sorted(map(str, result)) == expected([r.asDict() for r in documents])
    assert {r[-1] for r in result} == {True, False}


@pytest.mark.parametrize(
    ("n", "langs"), [(1, ["en"]), (3, ["a", "b", "c"]), (9, ["en"]), (90, [None, "", "é", "z", *map(str, range(9))])]
)
def test_shapes_nulls_ties_and_repeats(spark, tmp_path, n, langs):
    rows = some_rows(n, langs)
    rows += rows[: n // 3]
    clashing = dict(tree="t", size="s", id="i", place="p", digest="d", leaf="l", salt="x", part="y", listed="z")
    assert as_rows(found(spark, rows, tmp_path, **clashing)) == expected(rows)


def test_many_equal_rows_and_copies_of_high_nodes(spark):
    rows = [dict(doc_id=7, text="Same", lang="en", source=None, n_chars=4)] * 200 + some_rows(120, ["en", "de"], 5)
    df = spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")

    def text(c):
        return F.concat(*[merkle.field(F.col(x)) for x in ("doc_id", "source", "lang", "n_chars")], merkle.field(c))

    lowered = F.translate("text", queries._CAPITALS, queries._CAPITALS.lower())
    seen = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, text(lowered))
    made = merkle.manifest(df, F.col("doc_id"), F.col("lang"), text(F.col("text")), seen, spread=3)
    assert as_rows(made.withColumnRenamed("key", "doc_id")) == expected(rows)


def test_empty_table_and_untampered_rows(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(20)], "k int, t string")
    made = merkle.manifest(df, F.col("k"), F.lit("g"), F.col("t"))
    assert {(r["verified"], r["folded_root"] == r["root"]) for r in made.collect()} == {(True, True)}
    assert merkle.manifest(df.limit(0), F.col("k"), F.lit("g"), F.col("t")).collect() == []
