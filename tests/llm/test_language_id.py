"""Cross-parsing against a plain parse, and held-out accuracy."""

import math
import random
import zlib

import pytest

from parchmill.llm import queries
from parchmill.llm.language_id import Samples, identify, learn


def read(text):
    """Bytes as the operator reads them: letters in lower case, else one space."""
    out = []
    for b in text.encode():
        c = b + 32 if 65 <= b < 91 else b if 97 <= b < 123 or b > 127 else 32
        if not (c == 32 and out and out[-1] == 32):
            out.append(c)
    return bytes(out)


def phrases(text, sample):
    """Greedy longest matches, with Python's own search."""
    count, text, sample = 0, read(text), read(sample.decode())
    at = 0
    while at < len(text):
        n = 1
        while at + n < len(text) and text[at : at + n + 1] in sample:
            n += 1
        if n > 1 and text[at : at + 1] not in sample:
            n = 1
        count, at = count + 1, at + n
    return count * math.log2(len(sample) + 2)


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_parse(make, seed):
    rng = random.Random(seed)

    def text(letters, n):
        return "".join(rng.choice(letters) for _ in range(n))

    samples = Samples((("x", text("abcd  ", 400).encode()), ("y", text("cdeé. ", 300).encode())))
    rows = [(k, text("abcdeé! Zq", rng.randrange(1, 2500))) for k in range(40)]
    found = {r["doc_id"]: r for r in identify(make(rows), samples).collect()}
    for k, t in rows:
        costs = [phrases(t, s) for _, s in samples.texts]
        assert found[k]["lang_pred"] == ("x" if costs[0] <= costs[1] else "y")
        assert found[k]["score"] == pytest.approx(1 - min(costs) / max(costs))


def test_phrases_run_over_the_edges_of_pieces(make):
    """Texts whose pieces have no common beginning with what runs into them, too."""
    samples = Samples((("x", b"a" * 700 + b" " + b"ab" * 500), ("y", b"abcabcab" * 90)))
    texts = ["a" * 9000, "ab" * 4000, "abc" * 3000, "a" * 5000 + "ab" * 3000 + "b" * 2000, "ba" * 511 + "a" * 3000]
    texts += ["a" * n for n in (1023, 1024, 1025, 2048, 2049)]
    found = {r["doc_id"]: r for r in identify(make(list(enumerate(texts * 20))), samples).collect()}
    for k, t in enumerate(texts):
        costs = [phrases(t, s) for _, s in samples.texts]
        assert found[k]["lang_pred"] == ("x" if costs[0] <= costs[1] else "y")
        assert found[k]["score"] == pytest.approx(1 - min(costs) / max(costs))
        assert {found[k + len(texts) * j]["score"] for j in range(20)} == {found[k]["score"]}


def test_query_accuracy_on_held_out_documents(spark, sf_dir, documents):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op7_language_id"](spark, sf_dir).collect()}
    assert len(rows) == len(documents)
    held = right = 0
    for r in documents:
        out = zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2
        assert rows[r["doc_id"]]["held_out"] == out and 0 <= rows[r["doc_id"]]["score"] <= 1
        if out and r["lang"] is not None:
            held += 1
            right += rows[r["doc_id"]]["lang_pred"] == r["lang"]
    assert held >= 20 and right >= 0.95 * held


def test_edges(spark, make):
    train = spark.createDataFrame(
        [("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("12 3", "es")]
        + [("la casa", None)] * 5,
        "text string, lang string",
    )
    samples = learn(train)
    assert [lang for lang, _ in samples.texts] == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "The Dog"), (5, "und die"), (6, "中文"), (7, "x" * 300_000)]
    rows += [(4, "The Dog"), (None, "the cat")]
    found = identify(make(rows, lang_pred="a", score="b", __text="c"), samples).collect()
    said = [(r["doc_id"], r["lang_pred"]) for r in found]
    assert said[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (5, "de")]
    assert said[5][1] in ("de", "en") and found[3] == found[7] and said[8] == (None, "en")
    assert identify(make([]), samples).collect() == []
    nothing = learn(train.where("false"))
    assert {(r["lang_pred"], r["score"]) for r in identify(make(rows), nothing).collect()} == {("und", 0.0)}
    one = learn(train.where("lang = 'en'"))
    assert [r["score"] for r in identify(make(rows[3:4]), one).collect()] == [1.0]
    with pytest.raises(ValueError, match="Lang_Pred"):
        identify(make(rows, Lang_Pred="a"), samples, keep=("Lang_Pred",))
    kept = identify(make(rows[:4], lang="z"), samples, keep=("lang", "text")).columns
    assert kept == ["doc_id", "lang", "text", "lang_pred", "score"]


def test_the_sample_does_not_depend_on_row_order(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert learn(docs) == learn(docs.repartition(5, "source"))
