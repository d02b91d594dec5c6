"""Word shingles of whole texts as 64-bit hashes, in numpy over Arrow buffers.

Words are hashed by a polynomial over their bytes, all words of a block of texts at once; a
shingle combines the hashes of its words. A document is never cut: one larger than a block is
hashed in pieces that end at white space.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once.
BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_RANDOM = np.random.default_rng(20240131)
_BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_ODD = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, as many as a block has needed so far."""

    n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = n
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)
        return self.up, self.down


_POWERS = _Powers()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values in which every bit depends on every other."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in lower-cased bytes, and each word's document.

    ``first`` holds the offset at which each document starts.
    """
    n = len(data)
    space = _SPACE[data]
    begin = ~space
    begin[1:] &= space[:-1]
    edges = first[first < n]
    begin[edges] = ~space[edges]
    start = np.flatnonzero(begin)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stop = ~space
    stop[:-1] &= space[1:] | begin[1:]
    end = np.flatnonzero(stop) + 1
    up, down = _POWERS.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h = mix(h + (end - start).astype(np.uint64) * _ODD[0])
    return h, np.searchsorted(first, start, side="right") - 1


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(data):
        to = min(len(data), at + BLOCK)
        while to < len(data):
            gaps = np.flatnonzero(_SPACE[data[at:to]])
            if len(gaps):
                to = at + int(gaps[-1]) + 1
                break
            to = min(len(data), to + BLOCK)
        yield data[at:to]
        at = to


def shingle_sets(
    words: np.ndarray, doc: np.ndarray, n_docs: int, width: int
) -> tuple[np.ndarray, np.ndarray]:
    """All documents' sorted distinct shingles, and the offset of each document's (n + 1).

    A document with fewer words than ``width`` has its whole sequence as the one shingle.
    """
    count = np.bincount(doc, minlength=n_docs)
    offset = np.concatenate(([0], np.cumsum(count)))
    k = np.maximum(count - width + 1, 0)
    short = (count > 0) & (count < width)
    if len(words) >= width:
        h = words[: len(words) - width + 1] * _ODD[1]
        for i in range(1, width):
            h = h + words[i : len(words) - width + 1 + i] * _ODD[1 + i]
        at = np.repeat(offset[:-1] - np.concatenate(([0], np.cumsum(k)[:-1])), k)
        h = mix(h[at + np.arange(len(at))])
    else:
        h = np.zeros(0, np.uint64)
    sizes = k + short
    begins = np.concatenate(([0], np.cumsum(sizes)))
    out = np.zeros(begins[-1], np.uint64)
    of_long = np.repeat(~short, sizes)
    out[of_long] = h
    for d in np.flatnonzero(short):
        own = words[offset[d] : offset[d + 1]]
        parts = np.append(own * _ODD[32 : 32 + len(own)], _ODD[48 + len(own)])
        out[begins[d]] = mix(parts.sum(dtype=np.uint64, keepdims=True))[0]
    for d in np.flatnonzero(sizes > 1):
        out[begins[d] : begins[d + 1]].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[begins[:-1][sizes > 0]] = True
    kept = np.concatenate(([0], np.cumsum(fresh)))
    return out[fresh], kept[begins]


def blocks(
    texts: pa.Array, width: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of every block of texts: first and last row, distinct shingles, offsets by row.

    A null text is an empty one.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        last = int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1
        last = min(max(last, row + 1), len(texts))
        raw = data[offsets[row] : offsets[last]]
        raw = np.frombuffer(raw.tobytes().lower(), np.uint8)
        if last == row + 1 and len(raw) > BLOCK:
            words = np.concatenate([word_hashes(p, np.zeros(1, np.int64))[0] for p in _pieces(raw)])
            doc = np.zeros(len(words), np.int64)
        else:
            words, doc = word_hashes(raw, offsets[row:last] - offsets[row])
        yield row, last, *shingle_sets(words, doc, last - row, width)
        row = last
