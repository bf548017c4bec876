"""SentencePiece encoding and decoding with a unigram model.

The pieces of a model file, with their scores as log scores, lie in a double-array
trie over bytes. A text is cut into the pieces of greatest total score (Viterbi). A
character that is no piece costs more than any piece and becomes its bytes' pieces.
Spaces are the marker U+2581, with one before the text, and become spaces again when
decoded.

Wherever two neighbouring bytes stand together in no piece, every segmentation has a
cut, so a text falls into short units that are solved apart, with the same result.
Thousands of units step through the trie together as lanes of NumPy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from parchmill.llm.arrays import Texts, fresh, text_slices

MARKER = "▁"
SLICE = 1 << 20  # bytes of text at once
LANES = 1 << 15
LANE_BYTES = 1 << 20  # of all units that step together, each as long as the longest
LONG_UNIT = 512  # bytes; longer units are solved one by one
UNKNOWN_PENALTY = 10.0  # fixed value: what an unknown character costs beyond the worst piece
_SPACE = 32


class DoubleArray:
    """A trie in two arrays: the child of s by byte c is t = base[s] + c if check[t] = s."""

    def __init__(self, words: Sequence[bytes]):
        children: list[dict[int, int]] = [{}]
        ends = [-1]
        for k, word in enumerate(words):
            node = 0
            for c in word:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][c]
            ends[node] = k
        size = 2 * len(children) + 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        place = {0: 0}
        check[0] = -2  # taken
        begin = {True: 1, False: 1}  # where to look for places of one child, of several
        for node, moves in enumerate(children):  # parents come before their children
            at = place.pop(node)
            value[at] = ends[node]
            if not moves:
                continue
            codes = sorted(moves)
            alone = len(codes) == 1
            spot, seen, taken = max(begin[alone], codes[0]), 0, 0
            while True:
                if spot + 256 >= len(check):
                    more = len(check)
                    base += [0] * more
                    check += [-1] * more
                    value += [-1] * more
                seen += 1
                if check[spot] != -1:
                    taken += 1
                elif all(check[spot - codes[0] + c] == -1 for c in codes):
                    break
                spot += 1
            if taken >= 0.9 * seen:  # nearly full up to here: begin further on from now on
                begin[alone] = spot
            base[at] = spot - codes[0]
            for c in codes:
                check[base[at] + c] = at
                place[moves[c]] = base[at] + c
        last = max(k for k, c in enumerate(check) if c != -1) + 257
        self.base, self.check, self.value = (
            np.array((a + [fill] * 257)[:last], np.int32)
            for a, fill in ((base, 0), (check, -1), (value, -1))
        )


@dataclass
class PieceModel:
    """Pieces, scores and their trie; spaces stand for the marker inside."""

    pieces: list[bytes]  # by id; what decoding gives
    scores: np.ndarray
    bytes_ids: np.ndarray  # id of each byte's piece
    first_id: list[int]  # of the trie's words
    trie: DoubleArray
    pairs: np.ndarray  # whether two bytes stand together in a piece
    unknown: float
    prefix: bool

    @staticmethod
    def load(path: str, prefix: bool = True) -> PieceModel:
        """From a SentencePiece model file of identity normalisation, on the driver.

        `prefix` puts a space before each text, as the model's normaliser says."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        found = []
        for k in range(n):
            special = model.is_control(k) or model.is_unknown(k) or model.is_unused(k)
            kind = "byte" if model.is_byte(k) else "special" if special else "piece"
            found.append((model.id_to_piece(k), model.get_score(k), kind))
        return PieceModel.of(found, prefix)

    @staticmethod
    def of(listed: Sequence[tuple[str, float, str]], prefix: bool = True) -> PieceModel:
        """From (piece, score, kind) by id; kind is piece, byte (like <0x0A>) or special."""
        pieces, ids, words = [], [], []
        bytes_ids = np.full(256, -1, np.int32)
        for k, (piece, _, kind) in enumerate(listed):
            if kind == "byte":
                b = int(piece[3:5], 16)
                bytes_ids[b] = k
                pieces.append(bytes([b]))
            elif kind == "piece":
                word = piece.replace(MARKER, " ").encode()
                pieces.append(word)
                words.append(word)
                ids.append(k)
            else:
                pieces.append(b"")
        if (bytes_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        pairs = np.zeros(65536, bool)
        for word in words:
            for a, b in zip(word[:-1], word[1:], strict=True):
                pairs[a * 256 + b] = True
        scores = np.array([s for _, s, _ in listed], np.float64)
        least = min((scores[k] for k in ids), default=0.0)
        trie = DoubleArray(words)
        return PieceModel(
            pieces, scores, bytes_ids, ids, trie, pairs, float(least) - UNKNOWN_PENALTY, prefix
        )

    def decode(self, ids: Sequence[int]) -> str:
        text = b"".join([self.pieces[k] for k in ids]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    @cached_property
    def _lists(self) -> list[list[int]]:
        return [a.tolist() for a in (self.trie.base, self.trie.check, self.trie.value)]

    def _one(self, unit: bytes) -> list[tuple[int, int]]:
        """(start, id) of the best pieces of a long unit; -1 for an unknown character."""
        base, check, value = self._lists
        n = len(unit)
        best = [float("-inf")] * (n + 1)
        best[0], came = 0.0, [(0, -1)] * (n + 1)
        for i in range(n):
            if best[i] == float("-inf"):
                continue
            size, single = _char_size(unit[i]), False
            state = 0
            for j in range(i, n):
                t = base[state] + unit[j]
                if check[t] != state:
                    break
                state = t
                if value[t] >= 0:
                    piece = self.first_id[value[t]]
                    single = single or j + 1 - i == size
                    if best[i] + self.scores[piece] > best[j + 1]:
                        best[j + 1], came[j + 1] = best[i] + self.scores[piece], (i, piece)
            end = min(i + size, n)
            if not single and best[i] + self.unknown > best[end]:
                best[end], came[end] = best[i] + self.unknown, (i, -1)
        out, at = [], n
        while at:
            out.append(came[at])
            at = came[at][0]
        return out

    def _lanes(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, out: np.ndarray) -> None:
        """Write the ids of some units, longest first, to `out` at their pieces' first
        bytes; -2 marks an unknown character."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        word_id = np.array([*self.first_id, -1], np.int32)
        word_score = np.append(self.scores[self.first_id], 0.0)
        longest, n = int(size[0]), len(start)
        steps = data[np.minimum(start + np.arange(longest)[:, None], len(data) - 1)]
        best = np.full((longest + 1, n), -np.inf)
        best[0] = 0.0
        came = np.zeros((longest + 1, n), np.int32)
        piece = np.full((longest + 1, n), -2, np.int32)
        active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
        for i in range(longest):
            lanes = np.flatnonzero((steps[i, : active[i]] & 0xC0) != 0x80)  # characters' first bytes
            width = _CHAR_SIZE[steps[i, lanes]]
            single = np.zeros(n, bool)
            at, state, size_here = lanes, np.zeros(len(lanes), np.int32), width
            for j in range(i, longest):
                if at.size and at[-1] >= active[j]:
                    inside = at < active[j]
                    at, state, size_here = at[inside], state[inside], size_here[inside]
                target = base[state] + steps[j, at]
                ok = check[target] == state
                at, state, size_here = at[ok], target[ok], size_here[ok]
                if not at.size:
                    break
                word = value[state]
                ends = word >= 0
                lane, word = at[ends], word[ends]
                single[lane[size_here[ends] == j + 1 - i]] = True
                score = best[i, lane] + word_score[word]
                better = score > best[j + 1, lane]
                lane = lane[better]
                best[j + 1, lane] = score[better]
                came[j + 1, lane] = i
                piece[j + 1, lane] = word_id[word[better]]
            other = ~single[lanes]
            lane = lanes[other]
            end = np.minimum(i + width[other], size[lane])
            score = best[i, lane] + self.unknown
            better = score > best[end, lane]
            lane, end = lane[better], end[better]
            best[end, lane], came[end, lane], piece[end, lane] = score[better], i, -2
        lane, at = np.arange(n), size.copy()
        while lane.size:
            begins = came[at, lane]
            out[start[lane] + begins] = piece[at, lane]
            more = begins > 0
            lane, at = lane[more], begins[more].astype(at.dtype)

    def encode_texts(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """All ids and, by row, the offsets of its own."""
        data, offsets = texts.data, texts.offsets
        filled = np.diff(offsets) > 0
        if self.prefix:
            data = np.insert(data, offsets[:-1][filled], _SPACE)
            offsets = offsets + np.concatenate([[0], np.cumsum(filled)])
        cuts = np.ones(len(data) + 1, bool)
        if len(data) > 1:
            pair = data[:-1].astype(np.int32) * 256 + data[1:]
            cuts[1:-1] = ~self.pairs[pair] & ((data[1:] & 0xC0) != 0x80)
        cuts[offsets] = True
        start = np.flatnonzero(cuts[:-1])
        size = np.diff(np.append(start, len(data)))
        out = np.full(len(data), -1, np.int32)
        order = np.argsort(-size, kind="stable")
        many = int(np.searchsorted(-size[order], -LONG_UNIT, "left"))
        for k in order[:many]:
            unit = data[start[k] : start[k] + size[k]].tobytes()
            for at, found in self._one(unit):
                out[start[k] + at] = found if found >= 0 else -2
        rest = order[many:]
        k = 0
        while k < len(rest):
            most = max(1, min(LANES, LANE_BYTES // int(size[rest[k]])))
            chosen = rest[k : k + most]
            self._lanes(data, start[chosen], size[chosen], out)
            k += most
        unknown = np.flatnonzero(out == -2)
        width = _CHAR_SIZE[data[unknown]]
        for k in range(4):  # the pieces of its bytes
            place = unknown[width > k] + k
            place = place[place < len(data)]
            out[place] = self.bytes_ids[data[place]]
        taken = out >= 0
        return out[taken], np.concatenate([[0], np.cumsum(taken)])[offsets]


# Bytes of a character, by its first byte.
_CHAR_SIZE = np.ones(256, np.int64)
_CHAR_SIZE[0xC0:0xE0], _CHAR_SIZE[0xE0:0xF0], _CHAR_SIZE[0xF0:] = 2, 3, 4


def _char_size(first: int) -> int:
    return int(_CHAR_SIZE[first])


def encode(
    docs: DataFrame,
    model: PieceModel,
    text_col: str = "text",
    ids_col: str = "ids",
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The rows with a column of their whole text's piece ids, in one pass.

    Null and empty texts have no ids. A marker in the text is taken for a space. The
    columns of `docs` (or those in `keep`) stay, but for one named like `ids_col`, in
    any case, which is replaced. Repeated rows stay. The model (a few megabytes, by its number of pieces) goes to
    every task.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != ids_col.lower()]
    taken = docs.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(text_col) if text_col in kept else len(kept)
    if at == len(kept):
        taken = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(fresh(kept, "text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, model, at, kept, ids_col)

    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(ids_col, ArrayType(IntegerType()))
    return taken.mapInArrow(run, schema)


def _encoded(
    batches: Iterator[pa.RecordBatch], model: PieceModel, at: int, kept: list[str], ids_col: str
) -> Iterator[pa.RecordBatch]:
    """The first columns and the ids of the texts in column `at`, a slice at a time."""
    for batch in batches:
        column = pc.replace_substring(batch.column(at), MARKER, " ")
        for texts in text_slices(column, SLICE):
            ids, offsets = model.encode_texts(texts)
            made = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            rows = batch.slice(texts.first, texts.rows)
            yield pa.RecordBatch.from_arrays([*rows.columns[: len(kept)], made], [*kept, ids_col])


def decode(
    rows: DataFrame, model: PieceModel, ids_col: str = "ids", text_col: str = "decoded"
) -> DataFrame:
    """The rows with the text that their ids stand for; null ids give null.

    Bytes that form no UTF-8 become U+FFFD; control ids stand for nothing. The other
    columns stay, but for one named like `text_col`, which is replaced.
    """
    kept = [c for c in rows.columns if c.lower() != text_col.lower()]
    ids = fresh(kept, "ids")
    taken = rows.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{ids_col}`").alias(ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, len(batch), 256):
                part = batch.slice(k, 256)
                texts = [None if x is None else model.decode(x) for x in part.column(len(kept)).to_pylist()]
                made = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], made], [*kept, text_col])

    schema = rows.select(*[F.col(f"`{c}`") for c in kept]).schema.add(text_col, "string")
    return taken.mapInArrow(run, schema)


def same_text(text: Column, decoded: Column) -> Column:
    """Whether decoding gave the text back, markers taken for the spaces they stand for."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(MARKER), F.lit(" ")) == decoded
