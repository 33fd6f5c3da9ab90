"""Word and shingle fingerprints of whole Arrow text columns in numpy, without a Python step a word.

A word is a run of bytes other than blank, tab, line feed, vertical tab, form feed and carriage return.
A-Z count as a-z. Fingerprints are 64 bits of a polynomial over randomised bytes, mixed at the end; two
different words or shingles agree with a chance of about 2^-60.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once. A longer text is worked off in pieces cut between words.
PIECE = 1 << 20
U = np.uint64
_BASE = U(0x9E3779B97F4A7C13)  # odd, so that its powers have inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (multiply and shift, twice)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(1, 257, dtype=U) * U(0xA24BAED4963EE407))
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
_powers: dict[str, np.ndarray] = {}


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_powers.get("up", ())):
        with np.errstate(over="ignore"):
            inverse = U(pow(int(_BASE), -1, 1 << 64))
            for name, base in (("up", _BASE), ("down", inverse)):
                steps = np.full(n, base, U)
                steps[0] = 1
                _powers[name] = np.cumprod(steps)
    return _powers["up"][:n], _powers["down"]


def column(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), offsets


def slices(offsets: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most size bytes together, or of one longer row."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, hi
        lo = hi


def _words(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints, starts and ends of the words in data; rows: where rows begin in it."""
    n = len(data)
    if not n:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~_SPACE[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = rows[(rows > 0) & (rows < n)]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _grown(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_BYTE[data] * up[:n], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U)), start, end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows offsets cut from data: word fingerprints, starts and ends (counted from the first row's
    start), and at which word each row begins (n + 1 numbers)."""
    base, data = offsets[0], data[offsets[0] : offsets[-1]]
    rows = offsets - base
    parts, lo = [], 0
    while lo < len(data):
        hi = min(len(data), lo + 2 * PIECE)
        if hi < len(data):
            near = data[lo:hi]
            gaps = np.flatnonzero(_SPACE[near])
            if len(gaps):
                hi = lo + int(gaps[-1]) + 1
            else:  # one word longer than a piece: to its end
                after = np.flatnonzero(_SPACE[data[hi:]])
                hi = hi + int(after[0]) + 1 if len(after) else len(data)
        h, s, e = _words(data[lo:hi], rows[(rows > lo) & (rows < hi)] - lo)
        parts.append((h, s + lo, e + lo))
        lo = hi
    if not parts:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    h, s, e = (np.concatenate(x) for x in zip(*parts))
    return h, s, e, np.searchsorted(s, rows)


def shingles(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of each row's k-word shingles, and where each row begins in them. A row of 1 to k - 1
    words has its whole sequence as its only shingle."""
    n = np.diff(rows)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    starts = np.concatenate([[0], np.cumsum(counts)])
    place = np.arange(starts[-1]) - np.repeat(starts[:-1], counts) + np.repeat(rows[:-1], counts)
    left = np.repeat(np.minimum(n, k), counts)  # words in each shingle
    total = left.astype(U) * U(0xC2B2AE3D27D4EB4F)
    for j in range(k):
        at = np.minimum(place + j, max(len(hashes) - 1, 0))
        step = np.where(left > j, hashes[at], U(0)) if len(hashes) else np.zeros(0, U)
        total = (total ^ (total >> U(29))) * U(0x9FB21C651E98DF25) + step
    return mix(total), starts
