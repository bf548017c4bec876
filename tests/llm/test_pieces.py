"""Segmentation against a plain Viterbi and the library, and exact round trips."""

import os
import random

import pyarrow as pa
import pytest

from parchmill.llm import queries
from parchmill.llm.arrays import text_slices
from parchmill.llm.pieces import MARKER, PieceModel, _encoded, decode, encode

PATH = "/opt/tokenizers/piece_bpe_32k.model"
needs_file = pytest.mark.skipif(not os.path.exists(PATH), reason="no piece model here")

ALPHABET = "ab cé中"


def toy(seed):
    rng = random.Random(seed)
    listed = [("<unk>", 0.0, "special"), ("<s>", 0.0, "special")]
    listed += [(f"<0x{b:02X}>", 0.0, "byte") for b in range(256)]
    words = {MARKER, "a", "b", "c"}
    while len(words) < 40:
        words.add("".join(rng.choice("abcé" + MARKER) for _ in range(rng.randrange(1, 6))))
    listed += [(w, -rng.randrange(1, 60) / 4, "piece") for w in sorted(words)]
    return listed


def plain(listed, text):
    """The same segmentation, over characters, with a dictionary."""
    if not text:
        return []
    pieces = {p: (k, s) for k, (p, s, kind) in enumerate(listed) if kind == "piece"}
    unknown = min(s for _, s in pieces.values()) - 10
    text = MARKER + text.replace(" ", MARKER)
    best = [0.0] + [float("-inf")] * len(text)
    came = [None] * (len(text) + 1)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            found = pieces.get(text[i:j])
            score = found[1] if found else unknown if j == i + 1 else None
            if score is not None and best[i] + score > best[j]:
                best[j], came[j] = best[i] + score, (i, found[0] if found else None)
    out, at = [], len(text)
    while at:
        i, k = came[at]
        out.append([k] if k is not None else [2 + b for b in text[i].encode()])
        at = i
    return [k for part in reversed(out) for k in part]


def encoded(model, texts):
    out = []
    for part in text_slices(pa.array(texts, pa.string()), 300):
        ids, offsets = model.encode_texts(part)
        out += [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_equals_plain_viterbi(seed, monkeypatch):
    listed, rng = toy(seed), random.Random(seed)
    model = PieceModel.of(listed)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(60))) for _ in range(80)]
    texts += ["abc" * 300, "", " ", "   "]
    expected = [plain(listed, t) for t in texts]
    assert encoded(model, texts) == expected
    monkeypatch.setattr("parchmill.llm.pieces.LONG_UNIT", 3)  # most units one by one
    monkeypatch.setattr("parchmill.llm.pieces.LANES", 5)
    assert encoded(model, texts) == expected
    assert [model.decode(e) for e in expected] == texts


@needs_file
def test_equals_the_library_with_a_unigram_model(tmp_path, documents):
    import sentencepiece

    raw = open(PATH, "rb").read()
    # Field 3 of the trainer's settings is the kind of model: 1 unigram, 2 BPE.
    assert raw.count(b"\x18\x02 \x80\xfa\x01") == 1
    copy = tmp_path / "unigram.model"
    copy.write_bytes(raw.replace(b"\x18\x02 \x80\xfa\x01", b"\x18\x01 \x80\xfa\x01"))
    library = sentencepiece.SentencePieceProcessor(model_file=str(copy))
    # Its sums are of single precision: short lines without unknown characters. Its plain
    # encode() takes short cuts that miss the best now and then; the n-best search does not.
    lines = [x[:80] for r in documents for x in (r["text"] or "").split("\n") if x][:600]
    model = PieceModel.load(PATH)
    best = [library.nbest_encode_as_ids(x, 2)[0] for x in lines]
    known = [k for k, b in enumerate(best) if model.scores[b].min() > -1e6 and not set(b) & set(model.bytes_ids)]
    lines, best = [lines[k] for k in known], [best[k] for k in known]
    assert len(lines) > 300
    mine = encoded(model, lines)
    score = model.scores
    assert [score[m].sum() for m in mine] == [score[b].sum() for b in best]
    assert sum(m == b for m, b in zip(mine, best, strict=True)) > 0.98 * len(lines)  # but for ties


@needs_file
def test_query_is_a_round_trip(spark, sf_dir, documents):
    rows = queries.QUERIES["op9_sentencepiece"](spark, sf_dir).collect()
    assert len(rows) == len(documents) and all(r["same"] for r in rows)
    model = PieceModel.load(PATH)
    by_id = {r["doc_id"]: r["text"] for r in documents}
    for r in rows:
        assert r["n_tokens"] == len(r["ids"]) and model.decode(r["ids"]) == by_id[r["doc_id"]]


def test_edges(make):
    model = PieceModel.of(toy(1))
    texts = [None, "", "\n\t", "a" * 100_000, f"x{MARKER}y", "\U0001f600 café", "ab", "ab"]
    df = encode(make(list(enumerate(texts)), IDS="x", __ids="y", decoded="z"), model)
    assert df.columns == ["doc_id", "text", "__ids", "decoded", "ids"]
    found = sorted(decode(df, model).collect())
    assert [r["decoded"] for r in found] == [(t or "").replace(MARKER, " ") for t in texts]
    assert found[0]["ids"] == [] and found[6]["ids"] == found[7]["ids"]
    assert decode(encode(make([]), model), model).collect() == []
    with pytest.raises(ValueError):
        PieceModel.of([("a", -1.0, "piece")])


def test_a_batch_of_texts_is_encoded_in_slices():
    """What a task holds does not follow the batch; a megabyte of text takes some 30 MB."""
    model = PieceModel.of(toy(7))
    texts = ["a b中" * 15_000, None, "", *("cab é中" * 10_000 for _ in range(39))]
    batch = pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    made = list(_encoded(iter([batch, batch.slice(0, 3)]), model, 1, ["n"], "ids"))
    assert max(len(b) for b in made) <= (1 << 20) // 90_000 + 3 and len(made) >= 5
    assert [n for b in made for n in b.column("n").to_pylist()] == [*range(len(texts)), 0, 1, 2]
    ids = [x for b in made for x in b.column("ids").to_pylist()]
    assert [ids[0], *ids[3:5]] == encoded(model, [texts[0], *texts[3:5]]) and ids[1] == ids[2] == []
    assert all(x == ids[3] for x in ids[4:-3]) and ids[-3:] == ids[:3]
