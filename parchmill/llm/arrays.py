"""Texts of an Arrow batch as flat NumPy arrays: bytes, words, word hashes, shingles.

All of it works on the UTF-8 bytes of whole texts, a few megabytes at a time, so
that a task's memory is bounded by that and by its longest single text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20  # of text handled at once; a longer text is handled alone

# A-Z become a-z, as the contracts of the operators ask; other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def fresh(taken: Iterable[str], name: str) -> str:
    """A column name like `name` that is none of `taken`, in any case."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name += "_"
    return name


class Texts(NamedTuple):
    """Some consecutive rows: row r is `data[offsets[r]:offsets[r + 1]]`; nulls are empty."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of a string column in runs of at most `limit` bytes (or one row)."""
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, where, what = column.buffers()[:3]
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)
    offsets = offsets[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(what, np.uint8) if what else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield Texts(row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        row = end


class Words(NamedTuple):
    start: np.ndarray  # byte of each word's start and end
    end: np.ndarray
    offsets: np.ndarray  # words of row r are offsets[r] to offsets[r + 1]


def split_words(texts: Texts, in_word: np.ndarray) -> Words:
    """Runs of bytes for which the 256-entry table `in_word` is true, within a row."""
    inside = np.zeros(len(texts.data) + 1, bool)
    inside[:-1] = in_word[texts.data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    breaks = texts.offsets[:-1][np.diff(texts.offsets) > 0]
    starts[breaks] = inside[breaks]
    start = np.flatnonzero(starts)
    ends = inside[:-1] & ~inside[1:]
    ends[breaks[breaks > 0] - 1] |= inside[breaks[breaks > 0] - 1]
    return Words(start, np.flatnonzero(ends) + 1, np.searchsorted(start, texts.offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (SplitMix64): every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_NEAR_POWERS = 1 << 12


@lru_cache(maxsize=2)
def _powers(n: int, step: int = 1) -> np.ndarray:
    """base ** (step * k) for k below n, modulo 2^64."""
    out, done = np.ones(n, np.uint64), 1
    with np.errstate(over="ignore"):
        while done < n:  # doubling
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(pow(_BASE, step * done, 1 << 64))
            done += more
    return out


def word_hashes(data: np.ndarray, words: Words, byte_values: np.ndarray = LOWER) -> np.ndarray:
    """A 64-bit hash of each word, a polynomial of its bytes; `byte_values` maps them first.

    A megabyte of words is handled at once, or one longer word.
    """
    out = np.zeros(len(words.start), np.uint64)
    values = byte_values.astype(np.uint64) + np.uint64(1)
    size = words.end - words.start
    upto = np.cumsum(size)
    k = 0
    while k < len(out):
        limit = (upto[k - 1] if k else 0) + SLICE_BYTES
        end = max(k + 1, int(np.searchsorted(upto, limit, "right")))
        here = size[k:end]
        first = np.cumsum(here) - here
        place = np.arange(int(here.sum())) - np.repeat(first, here)
        terms = values[data[place + np.repeat(words.start[k:end], here)]]
        longest = int(here.max())
        if longest <= _NEAR_POWERS:
            terms *= _powers(_NEAR_POWERS)[place]
        else:  # of places and of rounds of places
            rounds = _powers(-(-longest // _NEAR_POWERS), _NEAR_POWERS)
            terms *= _powers(_NEAR_POWERS)[place % _NEAR_POWERS] * rounds[place // _NEAR_POWERS]
        out[k:end] = np.add.reduceat(terms, first)
        k = end
    return mixed(out)


def shingle_hashes(hashes: np.ndarray, offsets: np.ndarray, width: int):
    """(hashes of all runs of `width` words inside a row, offsets by row).

    A row with fewer words, but one at least, has its whole sequence as the one run.
    """
    counts = np.diff(offsets)
    runs = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    out_offsets = np.concatenate([[0], np.cumsum(runs)])
    if not out_offsets[-1]:
        return np.zeros(0, np.uint64), out_offsets
    row = np.repeat(np.arange(len(counts)), runs)
    at = np.arange(out_offsets[-1]) - out_offsets[row] + offsets[row]
    left = offsets[1:][row] - at  # words from here to the row's end
    out = np.full(len(at), 0x51, np.uint64)
    padded = np.concatenate([hashes, np.zeros(width, np.uint64)])
    factor = np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        out = np.where(left > k, (out ^ padded[at + k]) * factor + np.uint64(k + 1), out)
    return mixed(out), out_offsets
