import random

import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrameWriter, Observation
from pyspark.sql import functions as F

from parchmill.functions.text import WHITESPACE
from parchmill.operators import encode, prompts
from parchmill.operators.heavy import Summary
from parchmill.operators.subwords import PieceTrie
from parchmill.plans.training_rows import write_training_rows
from parchmill.sources.lines import scan_prompt_lines

QUICK = settings(
    max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
TEXT = st.text(
    st.one_of(st.characters(exclude_categories=("Cs",), exclude_characters="\0"), st.sampled_from(WHITESPACE)),
    max_size=20,
)


def lines_of(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "line string")


def expected_pairs(lines):
    fields = [x.strip().split("\t") for x in lines if x.strip()]
    return [(f[0].strip(), f[1].strip()) for f in fields if len(f) == 2]


@QUICK
@given(st.lists(TEXT, max_size=40))
def test_pairs_as_in_python(spark, lines):
    got = [tuple(r) for r in prompts.prompt_pairs(lines_of(spark, lines)).collect()]
    assert sorted(got) == sorted(expected_pairs(lines))


EDGES = ["", "   ", "a\t", "\tb", "x\ty\tz", "a\t \tb", " a \t b ", "one", "　a\tb\xa0", "a\tb"]


def test_edges(spark):
    lines = lines_of(spark, EDGES)
    assert prompts.prompt_pairs(lines).collect() == [("a", "b")] * 3
    rejects = {(r.line, r.n_fields) for r in prompts.prompt_rejects(lines).collect()}
    assert rejects == {("a", 1), ("b", 1), ("x\ty\tz", 3), ("a\t \tb", 3), ("one", 1)}
    assert prompts.prompt_counts(lines).first().asDict() == {
        "n_lines": 10, "n_blank": 2, "n_rejected": 5, "n_records": 3,
    }


def test_line_ends(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes("é\tb\r\nc\td\re\tf\n".encode())
    pairs = prompts.prompt_pairs(scan_prompt_lines(spark, str(path))).collect()
    assert sorted(map(tuple, pairs)) == [("c", "d"), ("e", "f"), ("é", "b")]


def test_format(spark):
    df = spark.createDataFrame([("q", "a"), ("q", ""), ("q", None)], "i string, r string")
    out = [r.p for r in df.select(prompts.format_prompt(F.col("i"), F.col("r")).alias("p")).collect()]
    opened = (
        "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\nq"
        "\n<|start_header_id|>assistant<|end_header_id|>\n"
    )
    assert out == [opened + "a<|eot_id|>", opened, opened]


def test_no_valid_rows(spark):
    with pytest.raises(prompts.NoValidRows):
        prompts.require_rows(prompts.prompt_pairs(lines_of(spark, ["x"])))


def test_records_are_counted_on_the_way(spark):
    seen = Observation("records")
    pairs = prompts.observe_records(prompts.prompt_pairs(lines_of(spark, EDGES)), seen)
    pairs.write.format("noop").mode("overwrite").save()
    assert seen.get == {"n_records": 3}


def test_prompts_are_one_narrow_stage(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_text("a\tb\n")
    df = prompts.training_prompts(scan_prompt_lines(spark, str(path)))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def encoded(texts, vocabulary, length, unk, pad):
    out = []
    for text in texts:
        ids = [vocabulary.get(w, unk) for w in (text or "").split()][:length]
        mask = [1] * len(ids) + [0] * (length - len(ids))
        out.append((text, ids + [pad] * (length - len(ids)), mask))
    return sorted(out, key=repr)


def vocabulary_of(spark, vocabulary):
    return spark.createDataFrame(list(vocabulary.items()), "token string, id int")


@QUICK
@given(st.lists(st.one_of(st.none(), TEXT), min_size=1, max_size=20))
def test_encode_as_in_python(spark, texts):
    vocabulary = {"a": 5, "b": 6, "0": 7}
    texts = texts + ["a b c  a", "b " * 9]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    out = encode.encode_with_vocabulary(spark, df, "t", vocabulary_of(spark, vocabulary), 0, 2, 4)
    assert sorted(map(tuple, out.collect()), key=repr) == encoded(texts, vocabulary, 4, 0, 2)


def test_both_ways_give_the_same(spark):
    vocabulary = {f"w{i}": i + 10 for i in range(50)}
    # A third of the words is one word, and a third of the rows are copies.
    texts = [" ".join(f"w{(i * j) % 60 if j % 3 else 1}" for j in range(i % 12)) for i in range(40)]
    texts += ["w1 w1 unseen"] * 20 + [None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    words = vocabulary_of(spark, vocabulary)
    for ship in (True, False):
        out = encode.encode_with_vocabulary(spark, df, "t", words, 0, 2, 8, ship=ship)
        assert sorted(map(tuple, out.collect()), key=repr) == encoded(texts, vocabulary, 8, 0, 2)


def pieces_of(word, vocabulary, unk, most=None):
    """The longest pieces from the left, in a plain loop."""
    out, at = [], 0
    if most is not None and len(word.encode()) > most:
        return [unk]
    while at < len(word):
        for end in range(len(word), at, -1):
            found = vocabulary.get(("##" if at else "") + word[at:end])
            if found is not None:
                break
        else:
            return [unk]
        out.append(found)
        at = end
    return out


@QUICK
@given(st.lists(st.one_of(st.none(), st.text(" abcdé\t", max_size=40)), min_size=1, max_size=20), st.randoms())
def test_subwords_as_in_a_plain_loop(spark, texts, rng):
    letters = "abcdé"
    tokens = {"".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(12)}
    tokens |= {"##" + "".join(rng.choice(letters) for _ in range(rng.randrange(1, 4))) for _ in range(20)} | {"", "##", "#"}
    vocabulary = {t: k + 10 for k, t in enumerate(sorted(tokens))}
    usable = {t: k for t, k in vocabulary.items() if t not in ("", "##")}
    texts = texts + ["abcabc # dd", "a" * 60, None, ""]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    out = encode.encode_with_vocabulary(spark, df, "t", vocabulary_of(spark, vocabulary), 0, 2, 9, subwords=True)
    expected = []
    for t in texts:
        ids = sum((pieces_of(w, usable, 0) for w in (t or "").split()), [])[:9]
        expected.append((t, ids + [2] * (9 - len(ids)), [1] * len(ids) + [0] * (9 - len(ids))))
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(expected, key=repr)


def test_subwords_of_long_words_other_signs_and_no_vocabulary(spark):
    words = pa.array(["abab", "", "ab" * 3000, "x", "ba"])
    trie = PieceTrie.of(["ab", "b", "a"], [1, 2, 3], "")
    ids, ends = trie.cut(words, 9, max_bytes=4)
    assert ids.tolist() == [1, 1, 9, 9, 2, 3] and ends.tolist() == [0, 2, 2, 3, 4, 6]
    assert trie.cut(words.slice(2, 1), 9)[0].tolist() == [1] * 3000
    empty = PieceTrie.of([], [], "##")
    assert empty.cut(words, 9)[0].tolist() == [9, 9, 9, 9]
    with pytest.raises(ValueError, match="shipped"):
        df = spark.createDataFrame([("a",)], "t string")
        encode.encode_with_vocabulary(spark, df, "t", vocabulary_of(spark, {"a": 1}), 0, 2, ship=False, subwords=True)


@pytest.mark.parametrize("ship", [True, False])
def test_columns_of_any_name_stay(spark, ship):
    names = ("_ids", "_row", "row", "key", "text", "heavy", "token", "pos", "salt", "a`b.c", "Input_IDs")
    df = spark.createDataFrame([("a b", *range(len(names)))], ["t", *names])
    out = encode.encode_with_vocabulary(spark, df, "t", vocabulary_of(spark, {"a": 5}), 0, 2, 3, ship=ship)
    assert out.columns == ["t", *names[:-1], "input_ids", "attention_mask"]
    assert tuple(out.first()) == ("a b", *range(len(names) - 1), [5, 0, 2], [1, 1, 0])


def test_summaries_name_every_frequent_value():
    rng = random.Random(5)
    values = ["hot"] * 4000 + [f"often{k % 7}" for k in range(2100)] + [f"rare{k}" for k in range(9000)]
    rng.shuffle(values)
    size = 60
    merged, total = {}, 0
    for part in range(5):
        summary = Summary(size)
        mine = values[part::5]
        for k in range(0, len(mine), 97):
            summary.add(pa.array(mine[k : k + 97]))
        assert len(summary.counts) <= size and summary.total == len(mine)
        total += summary.total
        for v, n in summary.counts.items():
            merged[v] = merged.get(v, 0) + n
    for v in set(values):
        true = values.count(v) if v in merged or not v.startswith("rare") else 1
        assert merged.get(v, 0) <= true <= merged.get(v, 0) + total / size
    assert merged["hot"] > 3500 and {f"often{k}" for k in range(7)} <= set(merged)
    empty = Summary(3)
    empty.add(pa.array([], pa.string()))
    assert empty.counts == {} and empty.total == 0


def test_frequent_words_are_salted_in_one_pass(spark):
    """Half of all words are one word; the vocabulary's other entries are not repeated."""
    texts = ["the " * 20 + f"w{k} w{k + 1}" for k in range(300)]
    vocabulary = {"the": 5} | {f"w{k}": k + 10 for k in range(300)}
    df = spark.createDataFrame([(x,) for x in texts], "t string").repartition(4)
    out = encode.encode_with_vocabulary(spark, df, "t", vocabulary_of(spark, vocabulary), 0, 2, 22, ship=False)
    assert sorted(map(tuple, out.collect()), key=repr) == encoded(texts, vocabulary, 22, 0, 2)


@pytest.mark.parametrize("ship", [True, False])
def test_repeated_tokens_are_refused(spark, ship):
    df = spark.createDataFrame([("a b",)], "t string")
    words = spark.createDataFrame([("a", 5), ("a", 6)], "token string, id int")
    with pytest.raises(encode.RepeatedToken, match="'a' occurs 2"):
        encode.encode_with_vocabulary(spark, df, "t", words, 0, 2, 4, ship=ship).collect()


def test_own_tokeniser(spark):
    @F.pandas_udf("array<int>")
    def code_points(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: [ord(c) for c in s])

    df = spark.createDataFrame([("ab",), ("abcde",)], "t string")
    out = encode.encode_fixed_length(df, "t", code_points, length=3, pad_id=9).collect()
    assert [(r.input_ids, r.attention_mask) for r in out] == [
        ([97, 98, 9], [1, 1, 0]),
        ([97, 98, 99], [1, 1, 1]),
    ]


def test_training_rows_job(spark, tmp_path):
    source, target = tmp_path / "lines.txt", tmp_path / "rows"
    source.write_text("q\ta\nno pair\nr\tb\n")
    words = vocabulary_of(spark, {"q": 5, "assistant": 6})
    tokenise = encode.vocabulary_tokeniser(encode.shipped_vocabulary(words), 0, 5)
    assert write_training_rows(spark, str(source), str(target), tokenise, pad_id=9, length=5) == 2
    rows = spark.read.parquet(str(target)).collect()
    assert sorted(r.input_ids for r in rows) == [[0, 0, 0, 0, 9], [0, 5, 0, 0, 9]]
    assert {tuple(r.attention_mask) for r in rows} == {(1, 1, 1, 1, 0)}
    source.write_text("no pair\n")
    with pytest.raises(prompts.NoValidRows):
        write_training_rows(spark, str(source), str(tmp_path / "none"), tokenise, pad_id=9)
    assert not (tmp_path / "none").exists()
    source.write_text("q\ta\nno pair\nr\tb\n")
    other = dict(pad_id=9, length=5, vocabulary=words)
    assert write_training_rows(spark, str(source), str(tmp_path / "joined"), **other) == 2
    joined = spark.read.parquet(str(tmp_path / "joined")).collect()
    assert sorted(r.input_ids for r in joined) == sorted(r.input_ids for r in rows)
    with pytest.raises(ValueError, match="tokeniser or a vocabulary"):
        write_training_rows(spark, str(source), str(tmp_path / "x"), pad_id=9)


def test_encoding_does_not_shuffle(spark):
    df = spark.createDataFrame([("a",)], "t string")
    out = encode.encode_with_vocabulary(spark, df, "t", vocabulary_of(spark, {"a": 1}), 0, 2, 4)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


LONG_TEXTS = pa.array([None, "", *(f" w{k} " + "and so on " * 3000 for k in range(100)), "w1 " * 900_000, "w2"])


def test_a_batch_of_words_is_looked_up_in_slices(spark):
    """What a task makes of texts does not grow with the batch that holds them."""
    vocabulary = pa.table({"token": ["and", "w1", "w2"], "id": pa.array([7, 8, 9], pa.int32())})
    look_up = encode.vocabulary_tokeniser(vocabulary, 0, 3).func
    made = list(look_up(iter([LONG_TEXTS.slice(1), LONG_TEXTS.slice(0, 0), LONG_TEXTS.slice(3, 60)])))
    assert max(map(len, made)) <= (1 << 20) // 30_000 + 3 and len(made) >= 6
    got = [ids for array in made for ids in array.to_pylist()]
    ids = [[], *([{1: 8, 2: 9}.get(k, 0), 7, 0] for k in range(100)), [8, 8, 8], [9]]
    assert got == ids + ids[2:62]


def test_a_batch_of_words_is_cut_in_slices(spark):
    vocabulary = pa.table({"token": ["a", "##nd", "w", "##1", "so", "on"], "id": pa.array(range(2, 8), pa.int32())})
    cut = encode.subword_tokeniser(vocabulary, 0, 3).func
    made = list(cut(iter([LONG_TEXTS, LONG_TEXTS.slice(0, 0), LONG_TEXTS.slice(3, 60)])))
    assert max(map(len, made)) <= (1 << 20) // 30_000 + 3 and len(made) >= 6
    got = [ids for array in made for ids in array.to_pylist()]
    known = {1: [4, 5, 2], 11: [4, 5, 5]}
    ids = [[], [], *(known.get(k, [0, 2, 3]) for k in range(100)), [4, 5, 4], [0]]
    assert got == ids + ids[3:63]


def test_words_are_summed_up_in_slices(monkeypatch):
    """A task's summary goes with its last row, and no batch is held until the next."""
    sizes, batches = [], [LONG_TEXTS, LONG_TEXTS.slice(0, 0), LONG_TEXTS.slice(3, 60)]

    class Sized(Summary):
        def add(self, values):
            sizes.append(len(values))
            super().add(values)

    monkeypatch.setattr(encode, "Summary", Sized)
    made = list(encode._summed((pa.RecordBatch.from_arrays([b], ["text"]) for b in batches), 9000))
    assert max(sizes) <= 35 * 9000 and sum(sizes) == 160 * 9000 + 9000 + 1
    rows = [t for b in made for t in b.column("text").to_pylist()]
    assert rows == [t for b in batches for t in b.to_pylist()]
    heavy = [h for b in made for h in b.column("heavy").to_pylist()]
    assert heavy[:-1] == [None] * (len(rows) - 1) and heavy[-1]["total"] == sum(sizes)


def test_rows_go_to_python_in_small_batches(spark, monkeypatch):
    """A vocabulary's join does not send rows by the thousand; the session's setting stays."""
    key, seen, write = "spark.sql.execution.arrow.maxBytesPerBatch", [], DataFrameWriter.parquet

    def spied(self, *args, **kwargs):
        seen.append(int(spark.conf.get(key).rstrip("b")))
        return write(self, *args, **kwargs)

    monkeypatch.setattr(DataFrameWriter, "parquet", spied)
    before = spark.conf.get(key)
    df = spark.createDataFrame([("a b",)], "t string")
    made = encode.encode_by_join(spark, df, "t", vocabulary_of(spark, {"a": 1}), 0, 2, 3)
    assert [r.input_ids for r in made.collect()] == [[1, 0, 2]]
    assert seen and max(seen) <= 4 << 20 and spark.conf.get(key) == before
