"""The pipeline's stages, one after the other, against plain restatements."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parchmill.llm.pieces import PieceModel
from parchmill.llm.queries import piece_model
from parchmill.llm.rows import numbered
from parchmill.session import scratch_path
from tests.llm.test_minhash import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows before the first stage and after each one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        path = scratch_path(spark, f"test-{name}")
        made.write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs.collect())
    return out


def ids(rows):
    return [r["doc_id"] for r in rows]


def test_columns_and_order():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "near_duplicates", "secret_scan", "mix_sources", "sentencepiece"]


def test_language(stages):
    before, after = stages[:2]
    lettered = [d for d in before if any(map(str.isalpha, d["text"] or ""))]
    assert sorted(ids(after)) == sorted(ids(lettered))
    assert all(d["lang"] is not None for d in after) and after[0].__fields__ == before[0].__fields__


def test_near_duplicates(stages):
    before, after = stages[1:3]
    kept = [i for i, _, _, first in brute([(d["doc_id"], d["text"]) for d in before], 5, 80) if first]
    assert sorted(ids(after)) == sorted(kept)
    assert {d["doc_id"]: d["text"] for d in before}.items() >= {d["doc_id"]: d["text"] for d in after}.items()


def test_secrets(stages):
    before, after = stages[2:4]
    assert sorted(ids(before)) == sorted(ids(after))
    text, assigned = {d["doc_id"]: d["text"] for d in before}, r'(?i)token = "[0-9a-f]{16,}"'
    for d in after:
        old = text[d["doc_id"]]
        assert d["n_chars"] == len(d["text"]) and not re.search(assigned, d["text"])
        if not re.search(r"[A-Za-z0-9+/_=\-]{16,}", old):
            assert d["text"] == old
        if "[SECRET]" in d["text"]:
            parts = d["text"].split("[SECRET]")
            assert re.fullmatch(r"[A-Za-z0-9+/_=\-]{16,}".join(map(re.escape, parts)), old)


def test_mix(stages):
    before, after = stages[3:5]
    copies, words = Counter(ids(after)), defaultdict(int)
    size, largest = defaultdict(int), 0
    for d in before:
        n = len(re.findall(r"[^ \t-\r]+", d["text"] or ""))
        size[d["source"]] += n
        largest = max(largest, n)
        words[d["source"]] += n * copies[d["doc_id"]]
    assert max(copies.values()) <= 3 and set(copies) <= set(ids(before))
    assert abs(sum(words.values()) - sum(size.values())) <= largest / 2 * len(size)


def test_pieces(spark, stages):
    before, after = stages[4:6]
    model = PieceModel.load(piece_model(spark))
    text = {d["doc_id"]: d["text"] for d in before}
    assert Counter(ids(before)) == Counter(ids(after))
    for r in after:
        assert model.decode(r["ids"]) == text[r["doc_id"]] and r["n_tokens"] == len(r["ids"])


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, stages[-1]))


def test_stages_stand_rows_of_nulls(spark, sf_dir):
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "Some words", None, None, None)]
    for n in (0, 3):
        docs = spark.createDataFrame(rows[:n], kinds)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert [f.name for f in docs.schema] == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(docs.collect(), kinds)
        corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()


KINDS = "doc_id long, text string, lang string, source string, n_chars long"


def test_secrets_of_rows_without_an_id_are_redacted(spark, sf_dir):
    rows, clean = [], []
    for k in range(60):
        i, key = (None, None, 7)[k % 3], f"{k * 7919 + 10**19:x}"
        for before, after in ((f'my token = "{key}" here', 'my token = "[SECRET]" here'), (f"the commit {key}1 is it",) * 2):
            rows.append((i, before, "en", "s", len(before)))
            clean.append((i, after, "en", "s", len(after)))
    made = corpus_pipeline.redact_secrets(spark, spark.createDataFrame(rows, KINDS), sf_dir).collect()
    assert sorted(map(str, map(tuple, made))) == sorted(map(str, clean))


def test_mix_of_repeated_and_missing_ids(spark, sf_dir):
    rows = [(None, f"some words {k % 9}" + " more" * (k % 5), "en", "s", k) for k in range(120)]
    rows += [(7, f"other text {k}", "en", "t", k) for k in range(80)]
    rows += [(8, "the same row", "en", None, 0)] * 40 + [(k, "a b c", "en", "u", k) for k in range(100, 200)]
    made = corpus_pipeline.mix_sources(spark, spark.createDataFrame(rows, KINDS), sf_dir).collect()
    given, taken = Counter(rows), Counter(map(tuple, made))
    assert set(taken) <= set(given) and all(n <= 3 * given[r] for r, n in taken.items())
    words = sum(len(r[1].split()) for r in rows)
    assert abs(sum(len(r["text"].split()) for r in made) - words) <= 4 * 7 / 2


def test_near_duplicates_of_repeated_and_missing_ids(spark, sf_dir):
    def text(name, n=40):
        return " ".join(f"{name}{k}" for k in range(n))

    texts = [
        (None, text("a")), (None, text("a", 41)), (None, text("b")), (5, text("b")),  # copies without an id
        (1, text("c")), (9, text("c")), (9, text("d")),  # two texts under one id
        (7, text("e")), (7, text("e")), (None, text("f")), (None, None), (None, None), (3, ""), (3, ""), (4, ""),
    ]
    rows = [(i, t, "en", "s", k) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows, KINDS)
    made = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert made.columns == docs.columns
    found = Counter((r["doc_id"], r["text"]) for r in made.collect())
    one_of_a = [t for i, t in found if t in (text("a"), text("a", 41))]
    assert len(one_of_a) == 1
    expected = [(5, text("b")), (1, text("c")), (9, text("d")), (7, text("e")), (None, text("f")), (None, None)]
    assert found == Counter([(None, one_of_a[0]), *expected, (3, ""), (4, "")])


def test_texts_without_any_label_stay(spark, sf_dir):
    texts = ["Some words", "mehr Wörter", "слова", None, "", "12 + 3"]
    rows = [(k, t, None, "a", 0) for k, t in enumerate(texts)] + [(None, "more words", None, None, None)]
    rows += [(9, None, "en", "a", 0), (10, "1 2", "en", "a", 0)]
    docs = spark.createDataFrame(rows, KINDS)
    made = corpus_pipeline.identify_language(spark, docs, sf_dir)
    assert made.schema == docs.schema
    assert sorted(map(str, map(tuple, made.collect()))) == sorted(map(str, [*rows[:3], rows[6]]))


def test_rows_of_files_keep_their_numbers(spark, tmp_path):
    rows = [(None, f"text {k}", "en", "s", k) for k in range(500)]
    spark.createDataFrame(rows, KINDS).repartition(5).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    made = numbered(docs, F.col("n_chars"))
    assert made.columns == ["n_chars", "key"]
    first = {r["key"]: r["n_chars"] for r in made.collect()}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        again = {r["key"]: r["n_chars"] for r in made.where("n_chars >= 0").repartition(3).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert first == again and sorted(first.values()) == list(range(500))


CLASHING = (
    "score", "Lang_Pred", "file_path", "ROW_INDEX", "number", "__hash", "__row_number", "_metadata", "ids",
    "row", "key", "group", "order", "candidate", "marks", "copies",
)


@pytest.mark.parametrize("from_files", [False, True])
def test_stages_stand_any_further_columns(spark, sf_dir, tmp_path, from_files):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    docs = rows.select("*", *[F.concat(F.lit(f"{c} of "), "doc_id").alias(c) for c in CLASHING])
    names = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        if from_files:
            docs.write.parquet(str(tmp_path / f"{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{k}"))
        docs = stage(spark, docs, sf_dir)
        if k < 4:
            assert docs.columns == names
            for r in docs.collect():
                assert all(r[c] == f"{c} of {r['doc_id']}" for c in CLASHING)
    assert docs.columns == ["doc_id", "lang", "source", "ids", "n_tokens"] and docs.count() > 20
