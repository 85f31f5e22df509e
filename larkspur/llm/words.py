"""Words and word windows of texts as 64-bit hashes, many at a time.

Words are runs of bytes other than 0x20 and 0x09-0x0D, so every text is taken whole and as it is. A word's hash is a
polynomial over its bytes, taken from running sums over the batch, then mixed; a window's is one over its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from larkspur.llm.arrow import by_bytes

U = np.uint64
BASE, STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that are hashed at a time.
SLICE = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16), base, U)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _powers[base] = held
    return held[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of ``data`` begin, and their hashes."""
    raw = np.frombuffer(data, np.uint8)
    gap = np.empty(len(raw) + 2, bool)
    gap[0] = gap[-1] = True
    gap[1:-1] = SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    begin, end = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum((raw.astype(U) + U(1)) * powers(BASE, len(raw)), out=sums[1:])
    return begin, mix((sums[end] - sums[begin]) * powers(INVERSE, len(raw))[begin] if len(begin) else sums[:0])


def _pieces(data: bytes) -> Iterator[bytes]:
    """Parts of a long text that end between words."""
    start = 0
    while len(data) - start > 4 * SLICE:
        cut = next((i for i in range(start + SLICE, len(data)) if SPACE[data[i]]), len(data))
        yield data[start:cut]
        start = cut
    yield data[start:]


def hashed_texts(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, word hashes) of each text, in order."""
    for s in by_bytes(texts, SLICE):
        if s.stop - s.start == 1 and len(texts[s.start]) > 4 * SLICE:
            yield s.start, np.concatenate([_hashed(p)[1] for p in _pieces(texts[s.start])])
            continue
        begin, hashes = _hashed(b"\n".join(texts[s]))
        first = np.cumsum([0] + [len(t) + 1 for t in texts[s]])
        at = np.searchsorted(begin, first)
        for k in range(s.stop - s.start):
            yield s.start + k, hashes[at[k] : at[k + 1]]


def windows(words: np.ndarray, n: int) -> np.ndarray:
    """The hash of every ``n`` consecutive words (none if there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return words[:0]
    h = np.zeros(m, U)
    for j in range(n):
        h = h * U(STEP) + words[j : j + m]
    return mix(h)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted different ``n``-word windows; with fewer words, the whole sequence as one."""
    if not len(words):
        return words
    return np.unique(windows(words, n) if len(words) >= n else mix(windows(words, len(words)) + U(len(words))))
