"""Language identification by cross-parsing.

For each language a suffix automaton of a bounded sample of its labelled text is
built. A text is cut, greedily from the left, into the longest phrases that occur
in that sample. The language that needs the fewest phrases, each weighed by the
bits that name a place in its sample, wins.

Texts are read as UTF-8 bytes: A-Z as a-z; a run of other ASCII characters is one
space. Thousands of pieces of PIECE bytes step through an automaton together, each as if
a phrase began with it. Then every piece is entered again with the phrase that runs into
it, until both ways begin a phrase at one byte, from where on they are the same. So the
phrases are those of the whole text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from parchmill.llm.arrays import Texts, text_slices

PIECE = 1024
_SLICE = 2 << 20  # bytes of text at once
_FEW = 32  # pieces that are entered one by one
UNDETERMINED = "und"
_SPACE = 32

# What each byte is read as.
_READ_AS = np.full(256, _SPACE, np.uint8)
_READ_AS[97:123] = np.arange(97, 123)
_READ_AS[65:91] = np.arange(97, 123)
_READ_AS[128:] = np.arange(128, 256)


@dataclass(frozen=True)
class Samples:
    """What prediction needs: (language, sample text) by language. A few kilobytes each."""

    texts: tuple[tuple[str, bytes], ...]


def learn(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    sample_docs: int = 64,
    sample_chars: int = 256,
) -> Samples:
    """Samples of each labelled language.

    The bound: `sample_docs` texts a language, of each a window of `sample_chars`
    characters at a place that its hash gives. The texts are those of the smallest hash
    in `sample_docs` hash buckets, so equal texts count once and the sample does not
    depend on the order of rows. It is
    gathered with partial aggregation: a language may hold any share of the rows.
    Rows without text, letters or label teach nothing.
    """
    rows = docs.select(F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where(
        F.col("l").isNotNull() & has_letter(F.col("t"))
    )
    key = F.xxhash64("t")
    places = F.greatest(F.length("t") - sample_chars, F.lit(0)) + 1
    begin = (1 + F.pmod(F.xxhash64(F.lit(1), "t"), places)).cast("int")
    found = (
        rows.groupBy("l", F.pmod(key, F.lit(sample_docs)).alias("b"))
        .agg(F.min_by(F.substring("t", begin, F.lit(sample_chars)), key).alias("t"))
        .orderBy("l", "b")
        .collect()  # at most sample_docs short rows a language
    )
    by_lang: dict[str, list[str]] = {}
    for row in found:
        by_lang.setdefault(row["l"], []).append(row["t"])
    return Samples(tuple((lang, " ".join(ts).encode()) for lang, ts in sorted(by_lang.items())))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def _squeezed(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Read bytes with runs of spaces as one, and the new row offsets."""
    read = _READ_AS[texts.data]
    space = read == _SPACE
    drop = np.zeros(len(read), bool)
    drop[1:] = space[1:] & space[:-1]
    starts = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    drop[starts] = False
    kept = np.concatenate([[0], np.cumsum(~drop)])
    return read[~drop], kept[texts.offsets]


class Automaton:
    """All substrings of one text, as a table of moves.

    `moves[state + symbol]` is twice the next state, plus one where the longest match
    ends before this symbol and a phrase begins with it. States are multiples of the
    number of symbols, so that a step is one addition and one look-up.
    """

    def __init__(self, sample: bytes):
        texts = Texts(0, np.frombuffer(sample, np.uint8), np.array([0, len(sample)]))
        read, _ = _squeezed(texts)
        known = np.unique(read)
        self.symbol = np.zeros(256, np.int32)  # 0: occurs nowhere in the sample
        self.symbol[known] = np.arange(1, len(known) + 1)
        self.bits = math.log2(len(read) + 2)
        n = len(known) + 1
        after = self._states(self.symbol[read].tolist())
        table = np.zeros((len(after), n), np.int64)
        for state, edges in enumerate(after):
            for symbol, target in edges.items():
                table[state, symbol] = target
        missing = table == 0  # no move leads back to the root
        missing[0] = True  # whatever leaves the root begins a phrase
        table = np.where(missing, table[0], table) * (n * 2) + missing
        self.moves = table.astype(np.int32).ravel()

    @staticmethod
    def _states(symbols: list[int]) -> list[dict[int, int]]:
        after: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in symbols:
            new = len(after)
            after.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in after[p]:
                after[p][c] = new
                p = link[p]
            if p >= 0:
                q = after[p][c]
                if length[q] != length[p] + 1:  # split: the shorter strings of q end elsewhere too
                    split = len(after)
                    after.append(dict(after[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = split
                    while p >= 0 and after[p].get(c) == q:
                        after[p][c] = split
                        p = link[p]
                    q = split
                link[new] = q
            last = new
        return after

    def phrases(self, steps: np.ndarray, active: np.ndarray, follows: np.ndarray, number: np.ndarray) -> np.ndarray:
        """How many phrases begin in each piece. `steps[i]` holds the i-th bytes of the
        pieces, longest piece first, of which `active[i]` are that long. Piece k goes on
        where piece `follows[k]` ends, or begins a text if that is -1; `number[k]` is its
        place among all pieces."""
        lanes = steps.shape[1]
        state = np.zeros(lanes, np.int32)
        begins = np.zeros(steps.shape, bool)
        symbols = self.symbol[steps]
        for i, n in enumerate(active.tolist()):
            move = self.moves[state[:n] + symbols[i, :n]]
            begins[i, :n] = move & 1
            state[:n] = move >> 1
        begins[0, : active[0] if len(active) else 0] = True
        after = np.full(lanes, -1)
        after[follows[follows >= 0]] = np.flatnonzero(follows >= 0)
        size = np.searchsorted(-active, -np.arange(lanes), "left")  # steps of each piece
        more = np.zeros(lanes, np.int64)  # phrases that begin there beyond those counted
        entered = np.flatnonzero(follows >= 0)
        # What has found no common beginning ends otherwise, and so the next piece begins.
        redone = set()
        for lane, s in self._entered(symbols, begins, size, entered, state[follows[entered]], more, number):
            if lane not in redone:
                lane, met = int(after[lane]), False
                while lane >= 0 and not met:
                    redone.add(lane)
                    more[lane], s, met = self._walk(symbols[: size[lane], lane], begins[: size[lane], lane], s)
                    lane = int(after[lane])
        return begins.sum(axis=0) + more

    def _entered(self, symbols, begins, size, lanes, state, more, number) -> list[tuple[int, int]]:
        """Enter pieces in given states, and count into `more`. Gives (piece, its end
        state) of those without a common beginning, in the order of their text."""
        left, i = [], 0
        while lanes.size:
            ended = size[lanes] <= i
            left += zip(lanes[ended].tolist(), state[ended].tolist(), strict=True)
            lanes, state = lanes[~ended], state[~ended]
            if len(lanes) <= _FEW:
                break
            move = self.moves[state + symbols[i, lanes]]
            mine, counted = (move & 1).astype(bool), begins[i, lanes]
            more[lanes] += mine.astype(np.int64) - counted
            apart = ~(mine & counted)
            lanes, state, i = lanes[apart], (move >> 1)[apart], i + 1
        for lane, s in zip(lanes.tolist(), state.tolist(), strict=True):
            extra, s, met = self._walk(symbols[i : size[lane], lane], begins[i : size[lane], lane], s)
            more[lane] += extra
            if not met:
                left.append((lane, s))
        return sorted(left, key=lambda found: number[found[0]])

    def _walk(self, symbols: np.ndarray, begins: np.ndarray, state: int) -> tuple[int, int, bool]:
        """(phrases begun beyond those counted, end state, whether both ways met)."""
        moves, more = self.moves, 0
        for symbol, counted in zip(symbols.tolist(), begins.tolist(), strict=True):
            move = int(moves[state + symbol])
            state = move >> 1
            if move & 1 and counted:
                return more, state, True
            more += (move & 1) - counted
        return more, state, False


@lru_cache(maxsize=4)
def _automata(samples: Samples) -> tuple[Automaton, ...]:
    return tuple(Automaton(text) for _, text in samples.texts)


def _costs(samples: Samples, texts: Texts) -> np.ndarray:
    """Bits each language needs for each row: a matrix of languages by rows."""
    read, offsets = _squeezed(texts)
    lengths = np.diff(offsets)
    pieces = -(-lengths // PIECE)
    row = np.repeat(np.arange(texts.rows), pieces)
    first = np.concatenate([[0], np.cumsum(pieces)])
    start = offsets[row] + (np.arange(first[-1]) - first[row]) * PIECE
    size = np.minimum(PIECE, offsets[1:][row] - start)
    order = np.argsort(-size, kind="stable")
    place = np.argsort(order)
    before = np.where(start > offsets[row], np.concatenate([[-1], place])[: len(place)], -1)[order]
    start, size, row = start[order], size[order], row[order]
    out = np.zeros((len(samples.texts), texts.rows))
    if not len(start):
        return out
    longest = int(size[0])
    active = np.searchsorted(-size, -np.arange(1, longest + 1), "right")
    steps = read[np.minimum(start + np.arange(longest)[:, None], len(read) - 1)]
    for k, automaton in enumerate(_automata(samples)):
        counts = automaton.phrases(steps, active, before, order)
        out[k] = np.bincount(row, counts, texts.rows) * automaton.bits
    return out


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def _lettered(texts: Texts) -> np.ndarray:
    """Rows that hold a letter of any script."""
    seen = np.concatenate([[0], np.cumsum(_ASCII_LETTER[texts.data])])
    out = np.diff(seen[texts.offsets]) > 0
    for r in np.flatnonzero(~out & (np.diff(texts.offsets) > 0)):
        raw = texts.data[texts.offsets[r] : texts.offsets[r + 1]]
        out[r] = bool((raw > 127).any()) and any(map(str.isalpha, raw.tobytes().decode("utf-8", "replace")))
    return out


def _predicted(samples: Samples, column: pa.Array) -> tuple[pa.Array, pa.Array]:
    names, scores = [], []
    langs = np.array([lang for lang, _ in samples.texts], dtype=object)
    for texts in text_slices(column, _SLICE):
        lettered = _lettered(texts)
        if not len(langs):
            names += [UNDETERMINED] * texts.rows
            scores.append(np.zeros(texts.rows))
            continue
        costs = _costs(samples, texts)
        best = costs.argmin(axis=0)  # of equal ones the first, by name
        ranked = np.sort(costs, axis=0)
        score = np.ones(texts.rows)
        if len(langs) > 1:
            score = 1 - ranked[0] / np.maximum(ranked[1], 1e-9)
        names += np.where(lettered, langs[best], UNDETERMINED).tolist()
        scores.append(np.where(lettered, score, 0.0))
    flat = np.concatenate(scores) if scores else np.zeros(0)
    return pa.array(names, pa.string()), pa.array(flat)


def identify(
    docs: DataFrame,
    samples: Samples,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Each row's id (and the columns named in `keep`), lang_pred and score.

    Every whole text is parsed, in one pass without a shuffle. The score is one less
    the best language's bits over the second best's: 0 for a tie, which goes to the
    smaller name, 1 if only one language was learned. A text that is null or has no
    letter is `und` with score 0, and so is every text if nothing was learned. Other
    columns are not read; a kept one named lang_pred or score, in any case, is refused.
    Of a very long text a task holds some 30 bytes a byte. Repeated rows give repeated
    rows, an empty table an empty one.
    """
    kept = list(dict.fromkeys((id_col, *keep)))
    clash = [c for c in kept if c.lower() in ("lang_pred", "score")]
    if clash:
        raise ValueError(f"the result has a column {clash[0]} of its own")
    return predicted(docs.select(*[F.col(f"`{c}`") for c in kept if c != text_col], f"`{text_col}`"), samples, text_col).select(
        *[F.col(f"`{c}`") for c in kept], "lang_pred", "score"
    )


def predicted(
    docs: DataFrame,
    samples: Samples,
    text_col: str = "text",
    lang_col: str = "lang_pred",
    score_col: str = "score",
) -> DataFrame:
    """All columns of the rows, and two more of the names given: see identify()."""
    at = docs.columns.index(text_col)
    names = [*docs.columns, lang_col, score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *_predicted(samples, batch.column(at))], names)

    schema = StructType([*docs.schema.fields]).add(lang_col, "string").add(score_col, "double")
    return docs.mapInArrow(run, schema)
