"""Words cut into the longest pieces of a vocabulary, many words in step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_FIRST, _NEXT = 0, 1  # roots of the trie: of pieces that begin a word, of those that go on


@dataclass(frozen=True)
class PieceTrie:
    """A trie over bytes in arrays: the child of a node by a byte is found by a binary
    search for node * 256 + byte among the sorted `edges`."""

    edges: np.ndarray
    children: np.ndarray
    ids: np.ndarray  # by node; -1 where no piece ends

    @staticmethod
    def of(tokens: Sequence[str], ids: Sequence[int], continuation: str) -> PieceTrie:
        """An empty token, or nothing after the continuation sign, is no piece."""
        found: dict[int, int] = {}
        values = [-1, -1]
        for token, number in zip(tokens, ids, strict=True):
            roots = [(_FIRST, token)]
            if token.startswith(continuation):
                roots = [(_NEXT, token.removeprefix(continuation))] if continuation else [(_FIRST, token), (_NEXT, token)]
            for node, piece in roots:
                for byte in piece.encode():
                    edge = node * 256 + byte
                    if edge not in found:
                        found[edge] = len(values)
                        values.append(-1)
                    node = found[edge]
                if piece:
                    values[node] = number
        edges = np.array(sorted(found), np.int64)
        return PieceTrie(edges, np.array([found[e] for e in edges.tolist()], np.int64), np.array(values, np.int64))

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The children; -1 where there is none."""
        edge = node * 256 + byte
        at = np.minimum(np.searchsorted(self.edges, edge), max(len(self.edges) - 1, 0))
        if not len(self.edges):
            return np.full(len(edge), -1)
        return np.where(self.edges[at] == edge, self.children[at], -1)

    def cut(self, words: pa.Array, unk_id: int, max_bytes: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces of all words, offsets by word)."""
        words = words.cast(pa.large_string())
        n = len(words)
        if not n:
            return np.zeros(0, np.int64), np.zeros(1, np.int64)
        _, where, data = words.buffers()
        offsets = np.frombuffer(where, np.int64)[words.offset : words.offset + n + 1]
        data = np.frombuffer(data, np.uint8) if data else np.zeros(1, np.uint8)
        begin, end = offsets[:-1].copy(), offsets[1:]
        unknown = np.zeros(n, bool)
        if max_bytes is not None:
            unknown |= end - begin > max_bytes
        # Each word walks on from `at`; the longest piece so far ends at `best`.
        lane = np.flatnonzero((end > begin) & ~unknown)
        at, node, best, piece = begin.copy(), np.zeros(n, np.int64), begin.copy(), np.full(n, -1)
        count = np.zeros(n, np.int64)
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while lane.size:
            inside = at[lane] < end[lane]
            child = np.full(len(lane), -1)
            moving = lane[inside]
            child[inside] = self._step(node[moving], data[at[moving]].astype(np.int64))
            on = child >= 0
            moved, child = lane[on], child[on]
            node[moved] = child
            at[moved] += 1
            ends = self.ids[child] >= 0
            best[moved[ends]], piece[moved[ends]] = at[moved[ends]], self.ids[child[ends]]
            stuck = lane[~on]
            cut = stuck[best[stuck] > begin[stuck]]
            unknown[stuck[best[stuck] == begin[stuck]]] = True
            made.append((cut, count[cut], piece[cut]))
            count[cut] += 1
            begin[cut] = at[cut] = best[cut]
            node[cut] = _NEXT
            going = ~unknown[lane] & (begin[lane] < end[lane])
            lane = lane[going]
        count[unknown] = 1
        upto = np.concatenate([[0], np.cumsum(count)])
        out = np.full(int(upto[-1]), unk_id, np.int64)
        for word, nth, found in made:
            known = ~unknown[word]
            out[upto[word[known]] + nth[known]] = found[known]
        return out, upto
