"""Words and word shingles of many texts at once, as 64-bit hashes, from the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed together; a longer text is a block of its own.
BLOCK_BYTES = 1 << 19

#: What separates words.
SPACES = b" \t\n\v\f\r"

_U = np.uint64
_DRAW = np.random.default_rng(11)
_LETTER = _DRAW.integers(1 << 62, 1 << 63, 256, dtype=_U) * _U(2) + _U(1)
_LETTER[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = _LETTER[list(b"abcdefghijklmnopqrstuvwxyz")]
_PLACE = _DRAW.integers(1 << 62, 1 << 63, 33, dtype=_U) * _U(2) + _U(1)
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
#: A step from one letter to the next, and back; their product is 1.
_STEP = int(_DRAW.integers(1 << 60, 1 << 61)) * 8 + 3
_BACK = pow(_STEP, -1, 1 << 64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes whose bits all depend on each other, in place."""
    h ^= h >> _U(32)
    h *= _PLACE[-1]
    h ^= h >> _U(29)
    return h


class Hasher:
    """Holds powers of the step for blocks of texts."""

    def __init__(self) -> None:
        self.forth = self.back = np.ones(1, _U)

    def _grow(self, n: int) -> None:
        while len(self.forth) < n:
            k = len(self.forth)
            self.forth = np.concatenate([self.forth, self.forth * _U(pow(_STEP, k, 1 << 64))])
            self.back = np.concatenate([self.back, self.back * _U(pow(_BACK, k, 1 << 64))])

    def words(self, data: np.ndarray, ends: np.ndarray, letters: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of texts end to end, A-Z lower-cased, and how many words each text has. ends: where texts end; letters: which bytes words are of, else all but white space."""
        if not len(data):
            return np.zeros(0, _U), np.zeros(len(ends), np.int64)
        n = len(data)
        self._grow(n + 1)
        word = (~_SPACE if letters is None else letters)[data]
        first, last = word.copy(), word.copy()
        border = np.append(0, ends[:-1])
        first[1:] &= ~word[:-1]
        at = border[border < n]
        first[at] = word[at]
        last[:-1] &= ~word[1:]
        at = ends[(ends > 0) & (ends <= n)] - 1
        last[at] = word[at]
        lo, hi = np.flatnonzero(first), np.flatnonzero(last) + 1
        total = np.zeros(n + 1, _U)
        np.cumsum(_LETTER[data] * self.forth[:n], out=total[1:])
        h = (total[hi] - total[lo]) * self.back[lo] + (hi - lo).astype(_U)
        return mixed(h), np.diff(np.append(0, np.searchsorted(lo, ends)))

    def shingles(self, data: np.ndarray, ends: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """For each text, hashes of its n-word shingles in order, repeats as well; with fewer words, of all of them as one."""
        w, count = self.words(data, ends)
        every = np.zeros(max(0, len(w) - n + 1), _U)
        for k in range(n if len(every) else 0):
            every += w[k : len(w) - n + 1 + k] * _PLACE[k]
        mixed(every)
        at = 0
        for c in count.tolist():
            if c >= n:
                yield every[at : at + c - n + 1]
            elif c:
                yield mixed((w[at : at + c] * _PLACE[:c]).sum(keepdims=True) + _U(c))
            else:
                yield every[:0]
            at += c


def blocks(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo to hi of a string column whose texts hold about ``most`` bytes, these bytes, and where each text ends in them.

    Nulls are empty. Nothing is copied, so a block must be done with before the next batch is asked for.
    """
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo + 1 : hi + 1] - off[lo]
        lo = hi
