"""Token counts of greedy longest-match word pieces, by a linear automaton.

The vocabulary is a trie over bytes. Every node has a failure link and the number of pieces that are popped on the way:
from a node without a child for the next byte, its string is known to begin with those pieces, and the rest of it is the
failure node. Links are folded into a complete transition table, so that every byte of a word costs one step, and the
counts come without any piece being built. All words of a chunk are stepped together.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernel import iter_words, separators, text_buffer

_loaded: dict[str, Automaton] = {}
#: A word of more than LONG bytes is stepped as segments of this length side by side.
LONG, SEGMENT = 1 << 15, 1 << 12


class Automaton:
    """Pieces are byte strings; every single byte must be one, so that each word has a division."""

    def __init__(self, pieces: Iterable[bytes], marker: bytes = b" "):
        children: list[dict[int, int]] = [{}]
        is_piece, depth, parent, byte = [False], [0], [0], [0]
        for piece in pieces:
            node = 0
            for b in piece:
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                    is_piece.append(False)
                    depth.append(depth[node] + 1)
                    parent.append(node)
                    byte.append(b)
                node = nxt
            if piece:
                is_piece[node] = True
        if len(children[0]) < 256 or not all(is_piece[v] for v in children[0].values()):
            raise ValueError("every single byte must be a piece")
        order = sorted(range(1, len(children)), key=depth.__getitem__)
        failure, popped = [0] * len(children), [0] * len(children)
        for v in order:
            if is_piece[v]:
                failure[v], popped[v] = 0, 1
                continue
            z, n = failure[parent[v]], popped[parent[v]]
            while byte[v] not in children[z]:
                n += popped[z]
                z = failure[z]
            failure[v], popped[v] = children[z][byte[v]], n
        nodes = len(children)
        self.to = np.zeros((nodes, 256), np.int32)
        self.rest = np.zeros(nodes, np.int64)  # pieces of a node's whole string
        failure, popped, depth = np.array(failure), np.array(popped), np.array(depth)
        for b, v in children[0].items():
            self.to[0, b] = v
        by_depth = np.argsort(depth, kind="stable")
        levels = np.split(by_depth, np.flatnonzero(np.diff(depth[by_depth])) + 1)[1:]
        for level in levels:
            self.rest[level] = popped[level] + self.rest[failure[level]]
        # a step pops no more pieces than its node's string has
        self.pops = np.zeros((nodes, 256), np.min_scalar_type(int(self.rest.max())))
        for level in levels:
            self.to[level] = self.to[failure[level]]
            self.pops[level] = self.pops[failure[level]] + popped[level, None].astype(self.pops.dtype)
            for v in level:
                for b, child in children[v].items():
                    self.to[v, b], self.pops[v, b] = child, 0
        self.start, self.before = 0, 0
        for b in marker:
            self.before += int(self.pops[self.start, b])
            self.start = int(self.to[self.start, b])

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word buf[start:end], the marker standing before it."""
        out = np.empty(len(starts), np.int64)
        long = ends - starts > LONG
        for i in np.flatnonzero(long):
            out[i] = self._long(buf, int(starts[i]), int(ends[i]))
        short = np.flatnonzero(~long)
        state, n = self._step(buf, starts[short], ends[short], np.full(len(short), self.start))
        out[short] = self.before + n + self.rest[state]
        return out

    def _step(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """State after and pieces popped in each buf[start:end], from the given states; all are stepped together."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        at, length = starts[order], length[order]
        state, n = state[order].astype(np.int64), np.zeros(len(at), np.int64)
        k, shorter = 0, -length
        live = int(np.searchsorted(shorter, 0, "left"))
        to, pops = self.to.ravel(), self.pops.ravel()
        while live:
            key = state[:live] * 256 + buf[at[:live] + k]
            n[:live] += pops[key]
            state[:live] = to[key]
            k += 1
            live = int(np.searchsorted(shorter, -k, "left"))
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return state[back], n[back]

    def _long(self, buf: np.ndarray, start: int, end: int) -> int:
        """Pieces of one very long word. Its segments are stepped side by side from guessed states; those that turn out to
        begin in another state than the segment before ends in are stepped again, until all agree, which is exact."""
        starts = np.arange(start, end, SEGMENT)
        ends = np.minimum(starts + SEGMENT, end)
        begin = np.full(len(starts), self.start, np.int64)
        state, n = self._step(buf, starts, ends, begin)
        while True:
            wrong = np.flatnonzero(begin[1:] != state[:-1]) + 1
            if not len(wrong):
                return self.before + int(n.sum()) + int(self.rest[state[-1]])
            begin[wrong] = state[wrong - 1]
            state[wrong], n[wrong] = self._step(buf, starts[wrong], ends[wrong], begin[wrong])


def byte_pieces(path: str) -> list[bytes]:
    """The vocabulary of a byte-level tokenizer file as byte strings.

    Such files write a byte as its Latin-1 character where that is printable, and the others as code points from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", [])}
    return [bytes(code[c] for c in piece) for piece in data["model"]["vocab"] if piece not in special]


def load(path: str) -> Automaton:
    if path not in _loaded:
        _loaded[path] = Automaton(byte_pieces(path))
    return _loaded[path]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens.

    Words are runs of non-separators, each divided greedily into the longest pieces of the vocabulary, with the space
    before it as part of the word. A null, empty or blank text has no words and no tokens. vocabulary: path of a
    byte-level tokenizer file that every executor has. Other columns are ignored, whatever their names.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, sep = load(vocabulary), separators()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for w in iter_words(batch.column(1), sep):
                base = int(offsets[w.first])
                n = automaton.count(data[base : base + int(w.text_starts[-1])], w.starts, w.ends)
                total = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.first, len(w.bounds) - 1), pa.array(np.diff(w.bounds)), pa.array(np.diff(total[w.bounds]))], ["doc_id", "n_words", "n_tokens"]
                )

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(count, "doc_id long, n_words long, n_tokens long")
