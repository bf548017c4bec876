"""Licence scans against a plain search."""

import random
import re

import pytest

from parchmill.llm import queries
from parchmill.llm.licence_texts import PHRASES, TEMPLATES
from parchmill.llm.licences import scan_licences

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def expected(text, phrases=PHRASES):
    words, places, labels = words_of(text), [], set()
    for phrase, label in phrases.items():
        sought = phrase.split()
        for k in range(len(words)):
            if words[k : k + len(sought)] == sought:
                places.append(k)
                labels.add(label)
    ends = (min(places), max(places)) if places else (None, None)
    return (len(words), len(places), *ends, ",".join(sorted(labels)))


def got(row):
    return tuple(row[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels"))


def test_query_equals_plain_search(spark, sf_dir, documents):
    text = {r["doc_id"]: r["text"] for r in documents}
    rows = queries.QUERIES["op1_licence_scan"](spark, sf_dir).collect()
    assert len(rows) == len(documents) and any(r["n_base"] for r in rows)
    for r in rows:
        assert got(r) == expected(text[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlapping_phrases(make, seed):
    rng = random.Random(seed)
    phrases = {"a a": "x", "a b a": "y", "b": "z", "a a b c": "w", "c a a": "x"}
    rows = [(k, " ".join(rng.choice("aaabbcd") for _ in range(rng.randrange(30)))) for k in range(60)]
    templates = [("t", "a b c a a b c d"), ("u", "d c b a")]
    found = scan_licences(make(rows), phrases=phrases, templates=templates, min_match=3).collect()
    text = dict(rows)
    for r in found:
        assert got(r) == expected(text[r["doc_id"]], phrases)


def longest_runs(words, template, least):
    """Words of a text that lie in a run of `least` words that the template has too."""
    covered = set()
    runs = {tuple(template[k : k + least]) for k in range(len(template) - least + 1)}
    for k in range(len(words) - least + 1):
        if tuple(words[k : k + least]) in runs:
            covered |= set(range(k, k + least))
    return covered


def test_spans_of_templates(make):
    mit = next(t for label, t in TEMPLATES if label == "mit")
    gpl = next(t for label, t in TEMPLATES if label == "gpl")
    some = mit.split()
    changed = " ".join([*some[:20], "well", *some[21:50], "indeed", *some[50:]])
    texts = {
        1: f"Some code.\n{mit}\nMore code.",
        2: changed,
        3: "no licence at all " * 20,
        4: f"{gpl} {'other words ' * 40} {mit}",
        5: " ".join(some[:12]),  # a small part
        6: " ".join(reversed(some)),
    }
    rows = {r["doc_id"]: r for r in scan_licences(make(list(texts.items()))).collect()}
    assert rows[1]["labels"] == "mit" and rows[1]["score"] == 1.0 and rows[1]["n_base"] == 0
    span = next(s for s in rows[1]["spans"] if s["label"] == "mit")
    assert (span["first_word"], span["last_word"]) == (2, 1 + len(words_of(mit)))
    assert rows[2]["labels"] == "mit" and 0.9 < rows[2]["score"] < 1
    assert rows[3]["labels"] == "" and rows[3]["spans"] == []
    assert rows[4]["labels"] == "gpl,mit" and rows[4]["base_labels"] == "gpl"
    assert rows[5]["labels"] == "" and 0 < rows[5]["score"] < 0.5
    assert rows[6]["labels"] == ""
    for r in rows.values():  # a chain covers only words of long common runs
        words = words_of(texts[r["doc_id"]])
        for s in r["spans"]:
            templates = [words_of(t) for label, t in TEMPLATES if label == s["label"]]
            covered = max(len(longest_runs(words, t, 4)) for t in templates)
            assert 0 < s["covered"] <= covered


def test_edges(make):
    rows = [(1, None), (2, ""), (3, "...!"), (4, "MIT License"), (4, "MIT License"), (5, "KMIT license")]
    rows += [(6, "mit " * 100_000), (None, "cc by"), (7, "mit, LICENSE-mit License")]
    found = scan_licences(make(rows, labels="a", id="b", score="c"))
    assert found.columns[0] == "doc_id" and len(found.columns) == 9
    out = [(r["doc_id"], *got(r), r["labels"], r["score"]) for r in found.collect()]
    texts = [t for _, t in rows]
    assert [r[1:6] for r in out] == [expected(t) for t in texts]
    assert out[0][6:] == ("", 0.0) and out[3][6] == "mit" and out[3][7] == 1.0
    assert scan_licences(make([])).collect() == []
