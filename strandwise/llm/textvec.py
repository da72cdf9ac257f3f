"""Vectorised word hashing over blocks of documents (numpy, no per-word Python).

Words are maximal runs of bytes outside space and 0x09-0x0D with A-Z folded to
a-z. A word's 64-bit value is a polynomial over a table of random odd numbers,
taken from prefix sums, so a block of text costs a few passes over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes of text that one pass takes: its arrays of 8 bytes a character stay near the cache.
PIECE = 1 << 18


def splitmix(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit numbers by the splitmix64 rule."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed)
        z = (z ^ (z >> U(30))) * U(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> U(27))) * U(0x94D049BB133111EB)
        return z ^ (z >> U(31))


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = h ^ (h >> U(32))
        h = h * U(0xD6E8FEB86659FD93)
        h = h ^ (h >> U(29))
        h = h * U(0xA0761D6478BD642F)
        return h ^ (h >> U(32))


_BASE = 0x5851F42D4C957F2D
_INV = pow(_BASE, -1, 1 << 64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_VAL = splitmix(256, 17)[_FOLD]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_pow: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse: slices of one table,
    but for a single word longer than some pieces, whose table isn't kept."""
    size = max(n, 4 * PIECE)
    if _pow and n <= len(_pow[0]):
        return _pow[0][:n], _pow[1][:n]
    made = [np.cumprod(np.full(size, b, U)) for b in (U(_BASE), U(_INV))]
    if size == 4 * PIECE:
        _pow[:] = made
    return made[0][:n], made[1][:n]


def _pieces(texts: list[bytes | None]) -> Iterator[tuple[int, bytes]]:
    """(document's index, run of its bytes that ends between words)."""
    for i, t in enumerate(texts):
        at, t = 0, t or b""
        while len(t) - at > PIECE:
            end = max(t.rfind(b" ", at, at + PIECE), t.rfind(b"\n", at, at + PIECE))
            if end <= at:
                ends = [e for e in (t.find(b" ", at + PIECE), t.find(b"\n", at + PIECE)) if e >= 0]
                end = min(ends, default=len(t))
            yield i, t[at:end]
            at = end
        yield i, t[at:]


SHAPES = 32
_LAST = np.full(256, 3, np.int64)
_LAST[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_LAST[46], _LAST[44] = 1, 2


def _shape(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A number under SHAPES for each word: its length in four steps, its last
    byte (letter, full stop, comma, other), any byte outside ASCII."""
    high = np.concatenate(([0], np.cumsum(data >= 128)))
    size = np.searchsorted([3, 6, 10], e - s, side="right")
    return (size * 4 + _LAST[data[e - 1]]) * 2 + (high[e] > high[s])


def _hash(data: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    word = ~space[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word, [False])).view(np.int8)))
    s, e = edge[::2], edge[1::2]
    if not len(s):
        return np.zeros(0, U), s, e
    up, down = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U)
        np.cumsum(_VAL[data] * up[:-1], out=total[1:])
        h = (total[e] - total[s]) * down[s] + (e - s).astype(U) * U(0x9E3779B97F4A7C15)
    return mix(h), s, e


def word_hashes(texts: list[bytes | None], shapes: list | None = None, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the index of each text's first (one more at the
    end). ``shapes``, a list, gets arrays of the words' shapes; ``space`` marks
    the bytes that aren't part of words, space and line feed among them."""
    hashes, counts, block, size = [np.zeros(0, U)], np.zeros(len(texts) + 1, np.int64), [], 0

    def flush():
        nonlocal block, size
        if not block:
            return
        data = np.frombuffer(b" ".join(p for _, p in block), np.uint8)
        h, s, e = _hash(data, space)
        if shapes is not None:
            shapes.append(_shape(data, s, e))
        ends = np.cumsum([len(p) + 1 for _, p in block])
        np.add.at(counts, np.array([i + 1 for i, _ in block]), np.diff(np.searchsorted(s, ends), prepend=0))
        hashes.append(h)
        block, size = [], 0

    for i, p in _pieces(texts):
        if size + len(p) > PIECE:
            flush()
        block.append((i, p))
        size += len(p) + 1
    flush()
    return np.concatenate(hashes), np.cumsum(counts)


def runs(texts: list[bytes | None], size: int = 2 * PIECE) -> Iterator[tuple[int, int]]:
    """(begin, end) of runs of texts with about ``size`` bytes, one text at least:
    what numpy holds at once follows the run, not the Arrow batch."""
    begin = held = 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= size:
            yield begin, i + 1
            begin, held = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


_SH = [U(x) for x in splitmix(8, 99) | U(1)]


def shingle_sets(texts: list[bytes | None], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed k-word shingles of each text, sorted, and the index of
    each text's first. Under k words the whole sequence is the one shingle."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    with np.errstate(over="ignore"):
        m = max(0, len(h) - k + 1)
        sh = np.zeros(m, U)
        for j in range(k):
            sh += h[j : j + m] * _SH[j]
        sh = mix(sh)
        of = np.repeat(np.arange(len(n)), np.maximum(n - k + 1, 0))
        first = np.concatenate(([0], np.cumsum(np.maximum(n - k + 1, 0))))
        pos = np.arange(len(of)) - first[of] + at[of]
        vals = sh[pos]
        short = np.flatnonzero((n > 0) & (n < k))
        extra = [int(sum(int(h[at[i] + j]) * int(_SH[j]) for j in range(int(n[i]))) + int(n[i])) % (1 << 64) for i in short]
    of = np.concatenate((of, short))
    vals = np.concatenate((vals, mix(np.array(extra, U))))
    order = np.lexsort((vals, of))
    of, vals = of[order], vals[order]
    keep = np.ones(len(of), bool)
    keep[1:] = (of[1:] != of[:-1]) | (vals[1:] != vals[:-1])
    of, vals = of[keep], vals[keep]
    return vals, np.searchsorted(of, np.arange(len(n) + 1))
