"""Vectorised word hashing over Arrow text batches (numpy; no Python loop over characters or words)."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes that one step works on; a longer document is hashed in pieces cut between words.
CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 5
_powers: tuple[np.ndarray, np.ndarray] | None = None


def separators(punctuation: bool = False) -> np.ndarray:
    """Byte table: True for what ends a word. With punctuation, every ASCII byte but letters and digits does."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    if punctuation:
        for b in range(128):
            t[b] = not chr(b).isalnum()
    return t


_LOWER = np.arange(1, 257, dtype=np.uint64)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.empty(CHUNK, np.uint64), np.empty(CHUNK, np.uint64)
        for table, base in ((up, _BASE), (down, inverse)):
            table[0], n = 1, 1
            while n < CHUNK:  # doubling: table[n:2n] = table[:n] * base**n
                m = min(n, CHUNK - n)
                table[n : n + m] = table[:m] * np.uint64(pow(base, n, 1 << 64))
                n += m
        _powers = up, down
    return _powers


class Words(NamedTuple):
    """Words of the documents first..first+len(bounds)-2 of a batch; bounds[i]:bounds[i+1] are those of document i."""

    first: int
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_starts: np.ndarray


def _hash_piece(buf: np.ndarray, doc_starts: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up, down = _power_tables()
    inside = ~sep[buf]
    first, last = np.empty(len(buf), bool), np.empty(len(buf), bool)
    first[0], last[-1] = True, True
    np.logical_not(inside[:-1], out=first[1:])
    np.logical_not(inside[1:], out=last[:-1])
    at = doc_starts[doc_starts < len(buf)]
    first[at] = True
    last[at[at > 0] - 1] = True
    starts, ends = np.flatnonzero(inside & first), np.flatnonzero(inside & last) + 1
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_LOWER[buf] * up[: len(buf)], out=total[1:])
    return starts, ends, mix((total[ends] - total[starts]) * down[starts])


def _words(buf: np.ndarray, doc_starts: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(buf) <= CHUNK:
        return _hash_piece(buf, doc_starts, sep) if len(buf) else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    parts, at = [], 0
    while at < len(buf):
        end = min(at + CHUNK, len(buf))
        if end < len(buf):
            cut = np.flatnonzero(sep[buf[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word longer than a chunk: hashed by itself
                more = np.flatnonzero(sep[buf[end:]])
                stop = end + int(more[0]) if len(more) else len(buf)
                h = np.uint64(0)
                for i in range(at, stop, CHUNK):
                    piece = buf[i : min(i + CHUNK, stop)]
                    h = mix(np.array([h + np.sum(_LOWER[piece] * _power_tables()[0][: len(piece)])], np.uint64))[0]
                parts.append((np.array([at]), np.array([stop]), np.array([h], np.uint64)))
                at = stop
                continue
        s, e, h = _hash_piece(buf[at:end], np.zeros(0, np.int64), sep)
        parts.append((s + at, e + at, h))
        at = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null text is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_utf8())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def iter_words(column: pa.Array, sep: np.ndarray) -> Iterator[Words]:
    """Lower-cased (A-Z) word hashes of a text column, in steps of about CHUNK bytes of whole documents."""
    if not len(column):
        return
    data, offsets = text_buffer(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        lo, hi = int(offsets[at]), int(offsets[stop])
        inner = offsets[at : stop + 1] - lo
        starts, ends, hashes = _words(data[lo:hi], inner[:-1] if stop - at > 1 else np.zeros(0, np.int64), sep)
        yield Words(at, np.searchsorted(starts, inner), hashes, starts, ends, inner)
        at = stop


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; only the first len-k+1 are whole."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += hashes[j : j + n] * np.uint64(pow(0xD1342543DE82EF95, j + 1, 1 << 64))
    return mix(out)


def shingle_sets(w: Words, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document; a document of fewer than k words has its whole sequence as one."""
    whole = shingle_hashes(w.hashes, k)
    for lo, hi in zip(w.bounds[:-1], w.bounds[1:], strict=True):
        n = hi - lo
        if n >= k:
            yield np.unique(whole[lo : hi - k + 1])
        elif n:
            short = shingle_hashes(w.hashes[lo:hi], n)
            yield mix(short + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)
