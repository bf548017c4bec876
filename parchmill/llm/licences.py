"""Licence scans with a generalised suffix automaton of licence words.

One automaton holds every run of words of all templates and phrases. Reading a text
word by word through it gives, at each word, the longest run ending there that occurs
in any template: the matching statistics. Runs of `min_match` words or more that
cannot be lengthened are chained, by template and in order, into covered spans. A
phrase occurs at a word exactly if its state is on the suffix path of the state there.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z as a-z.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm.arrays import Words, split_words, text_slices, word_hashes
from parchmill.llm.licence_texts import PHRASES, TEMPLATES

_IN_WORD = np.zeros(256, bool)
_IN_WORD[48:58] = _IN_WORD[65:91] = _IN_WORD[97:123] = _IN_WORD[128:] = True
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text: str) -> list[bytes]:
    return _WORD.findall(text.encode().lower())


class WordAutomaton:
    """Generalised suffix automaton of templates and phrases over numbered words."""

    def __init__(self, templates: Sequence[tuple[str, str]], phrases: Mapping[str, str], min_match: int):
        self.labels = [label for label, _ in templates]
        texts = [_words(text) for _, text in templates]
        self.sizes = [len(t) for t in texts]
        sought = [_words(p) for p in phrases]
        vocabulary = sorted({w for t in (*texts, *sought) for w in t})
        self.number = {w: k + 1 for k, w in enumerate(vocabulary)}

        self.after: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []  # state, template, words read
        for t, words in enumerate(texts):
            state = 0
            for k, word in enumerate(words):
                state = self._add(state, self.number[word])
                ends.append((state, t, k + 1))
        whole = []
        for phrase, words in zip(phrases.values(), sought, strict=True):
            state = 0
            for word in words:
                state = self._add(state, self.number[word])
            whole.append((words, phrase))

        by_length = sorted(range(1, len(self.after)), key=lambda s: self.length[s])
        # Where in which templates the runs of a state end; kept for long ones only.
        places: list[set[tuple[int, int]]] = [set() for _ in self.after]
        for state, t, k in ends:
            places[state].add((t, k))
        for state in reversed(by_length):
            if self.length[state] < min_match:
                break
            if self.length[self.link[state]] >= min_match:
                places[self.link[state]] |= places[state]
        self.places = [sorted(p) for p in places]
        # Phrases that end wherever a state's longest run does: (words, label).
        self.phrases: list[tuple[tuple[int, str], ...]] = [() for _ in self.after]
        for words, label in whole:
            state = 0
            for word in words:
                state = self.after[state][self.number[word]]
            self.phrases[state] += ((len(words), label),)
        for state in by_length:
            self.phrases[state] += self.phrases[self.link[state]]

        data = np.frombuffer(b"".join(vocabulary), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in vocabulary])]).astype(np.int64)
        hashes = word_hashes(data, Words(bounds[:-1], bounds[1:], bounds[:1]))
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], (order + 1).astype(np.int32)

    def _add(self, last: int, c: int) -> int:
        """The state after one more word of a text whose state so far is `last`."""
        after, link, length = self.after, self.link, self.length
        if c in after[last]:
            q = after[last][c]
            return q if length[q] == length[last] + 1 else self._split(last, c, q)
        new = self._state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._split(p, c, q)
        return new

    def _state(self, moves: dict[int, int], length: int, link: int) -> int:
        self.after.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.after) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        part = self._state(dict(self.after[q]), self.length[p] + 1, self.link[q])
        self.link[q] = part
        while p >= 0 and self.after[p].get(c) == q:
            self.after[p][c] = part
            p = self.link[p]
        return part

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, by its hash; 0 for words in no template."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.ids[at], 0)


class _Row:
    """What is found in one text."""

    def __init__(self, automaton: WordAutomaton, min_match: int, max_gap: int):
        self.automaton, self.min_match, self.max_gap = automaton, min_match, max_gap
        self.n_base, self.first, self.last = 0, None, None
        self.base: set[str] = set()
        # By template, the chain that may go on: start, end, end in the template, words covered.
        self.open: dict[int, list[int]] = {}
        self.spans: list[tuple[str, int, int, int, float]] = []

    def read(self, start: int, numbers: list[int]) -> None:
        """A run of known words, the first of which is word `start` of the text."""
        after, link, longest = self.automaton.after, self.automaton.link, self.automaton.length
        phrases = self.automaton.phrases
        state = length = 0
        for k, c in enumerate(numbers):
            before, size = state, length
            while state and c not in after[state]:
                state = link[state]
                length = longest[state]
            if size >= self.min_match and length != size:  # the match before ended
                self._match(start + k - size, size, before)
            if c in after[state]:
                state = after[state][c]
                length += 1
            for words, label in phrases[state]:
                if words <= length:
                    place = start + k + 1 - words
                    self.n_base += 1
                    self.base.add(label)
                    self.first = place if self.first is None else min(self.first, place)
                    self.last = place if self.last is None else max(self.last, place)
        if length >= self.min_match:
            self._match(start + len(numbers) - length, length, state)

    def _match(self, start: int, length: int, state: int) -> None:
        end, seen = start + length, set()
        for template, template_end in self.automaton.places[state]:
            chain = self.open.get(template)
            begins = template_end - length
            if chain and start - chain[1] <= self.max_gap and end > chain[1] and template not in seen:
                overlap = max(0, chain[1] - start)
                if begins + overlap >= chain[2]:  # goes on further down the template
                    chain[3] += length - overlap
                    chain[1], chain[2] = end, template_end
                    seen.add(template)
                    continue
            if template not in seen and not (chain and end <= chain[1]):
                later = [e for t, e in self.automaton.places[state] if t == template and e > template_end]
                if chain and any(e - length + max(0, chain[1] - start) >= chain[2] for e in later):
                    continue  # a later place in the template carries the chain on
                self._close(template)
                self.open[template] = [start, end, template_end, length]
                seen.add(template)

    def _close(self, template: int) -> None:
        chain = self.open.pop(template, None)
        if chain:
            cover = min(1.0, chain[3] / self.automaton.sizes[template])
            label = self.automaton.labels[template]
            self.spans.append((label, chain[0], chain[1] - 1, chain[3], cover))

    def finish(self, min_cover: float) -> dict:
        for template in list(self.open):
            self._close(template)
        score = max((s[4] for s in self.spans), default=0.0)
        spans = sorted(s for s in self.spans if s[4] >= min_cover)
        labels = self.base | {s[0] for s in spans}
        names = ("label", "first_word", "last_word", "covered", "coverage")
        return {
            "n_base": self.n_base,
            "first_word": self.first,
            "last_word": self.last,
            "base_labels": ",".join(sorted(self.base)),
            "labels": ",".join(sorted(labels)),
            "score": 1.0 if self.base else score,
            "spans": [dict(zip(names, s, strict=True)) for s in spans],
        }


@lru_cache(maxsize=4)
def _automaton(templates, phrases, min_match: int) -> WordAutomaton:
    return WordAutomaton(templates, dict(phrases), min_match)


_SPAN = "struct<label: string, first_word: bigint, last_word: bigint, covered: bigint, coverage: double>"
_FIELDS = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, "
    f"labels string, score double, spans array<{_SPAN}>"
)
_ARROW = pa.struct(
    [
        ("n_base", pa.int64()),
        ("first_word", pa.int64()),
        ("last_word", pa.int64()),
        ("base_labels", pa.string()),
        ("labels", pa.string()),
        ("score", pa.float64()),
        (
            "spans",
            pa.list_(
                pa.struct(
                    [
                        ("label", pa.string()),
                        ("first_word", pa.int64()),
                        ("last_word", pa.int64()),
                        ("covered", pa.int64()),
                        ("coverage", pa.float64()),
                    ]
                )
            ),
        ),
    ]
)


def scan_licences(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES,
    phrases: Mapping[str, str] = PHRASES,
    min_match: int = 4,
    max_gap: int = 20,
    min_cover: float = 0.6,
) -> DataFrame:
    """What each whole text has of the phrases and templates, in one pass, no shuffle.

    n_words; n_base, the number of all places of all phrases, with the smallest and
    the largest first word of one (from 0, null if none); base_labels, the labels of
    phrases found, and labels, those of phrases and of spans found, both sorted and
    comma-joined; score, the largest share of a template that a chain covers, 1 where
    a phrase is found; spans, the chains that cover at least `min_cover` of a
    template. A chain goes on over at most `max_gap` words that match nothing.

    Null and empty texts have no words and nothing found. Only the two columns named
    are read, so others may have any name. Repeated rows give repeated rows, an empty
    table an empty result. Of a very long text a task holds some 30 bytes a byte.
    """
    wanted = tuple((str(a), str(b)) for a, b in templates)
    sought = tuple((str(a), str(b)) for a, b in phrases.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(wanted, sought, min_match)
        nothing = _Row(automaton, min_match, max_gap).finish(min_cover)
        for batch in batches:
            for texts in text_slices(batch.column(1)):
                words = split_words(texts, _IN_WORD)
                numbers = automaton.numbers(word_hashes(texts.data, words))
                found = [nothing] * texts.rows
                for row, runs in _runs(numbers, words.offsets):
                    result = _Row(automaton, min_match, max_gap)
                    for a, b in runs:
                        result.read(a - words.offsets[row].item(), numbers[a:b].tolist())
                    found[row] = result.finish(min_cover)
                ids = batch.column(0).slice(texts.first, texts.rows)
                made = pa.array(found, _ARROW).flatten()
                counts = pa.array(np.diff(words.offsets).astype(np.int64))
                names = ["id", "n_words", *[f.name for f in _ARROW]]
                yield pa.RecordBatch.from_arrays([ids, counts, *made], names)

    taken = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = taken.schema["id"].dataType.simpleString()
    return taken.mapInArrow(run, f"id {kind}, {_FIELDS}").withColumnRenamed("id", id_col)


def _runs(numbers: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """By row, the runs of known words. Between them nothing matches."""
    known = np.zeros(len(numbers) + 1, bool)
    known[:-1] = numbers > 0
    starts = known.copy()
    starts[1:] &= ~known[:-1]
    breaks = offsets[:-1][np.diff(offsets) > 0]
    starts[breaks] = known[breaks]
    ends = known[:-1] & ~known[1:]
    ends[breaks[breaks > 0] - 1] |= known[breaks[breaks > 0] - 1]
    start, end = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    edges = np.flatnonzero(np.diff(row, prepend=-1))
    if not len(edges):
        return
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(row)], strict=True):
        yield int(row[a]), list(zip(start[a:b].tolist(), end[a:b].tolist(), strict=True))
