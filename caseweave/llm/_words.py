"""Words of many texts at once, over the bytes of an Arrow string array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK = 2 << 20


def _lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Lower-cases A-Z and keeps all else.
LOWER = _lower()
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing: bytes over 0x7F only occur in other characters.
IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b > 127 for b in range(256)])
#: Bytes of the words [^\x20\x09-\x0D]+.
NOT_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])


class Words:
    """The words of several texts: bytes data, starts and ends of words, first[i] the number of words before text i."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, inside: np.ndarray):
        self.data, self.bounds = LOWER[data], bounds
        flag = np.zeros(len(data) + 1, dtype=bool)
        flag[:-1] = inside[self.data]
        before = np.zeros(len(data) + 1, dtype=bool)
        before[1:] = flag[:-1]
        before[bounds[:-1]] = False  # a word doesn't reach over from the text before
        self.starts = np.flatnonzero(flag & ~before)
        after = np.zeros(len(data) + 1, dtype=bool)
        after[:-1] = flag[1:]
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        after[last] = False
        self.ends = np.flatnonzero(flag & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)
        self._raw: bytes | None = None

    @property
    def raw(self) -> bytes:
        if self._raw is None:
            self._raw = self.data.tobytes()
        return self._raw

    def word(self, i: int) -> bytes:
        return self.raw[self.starts[i] : self.ends[i]]

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word: a polynomial over its bytes, mixed. Equal words have equal hashes everywhere."""
        power, back = _powers(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=total[1:])
        h = (total[self.ends] - total[self.starts]) * back[self.starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        return h


_cache: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2**64, and of its inverse, up to n - 1."""
    if not _cache or len(_cache[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 1))
        made = []
        for base in (_ODD, _BACK):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        if n > 16 * CHUNK:  # a very long text: don't hold its tables
            return made[0], made[1]
        _cache[:] = made
    return _cache[0], _cache[1]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive hashes (those of different texts too; the caller leaves them out)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    g = np.full(n, np.uint64(k), dtype=np.uint64)
    for j in range(k):
        g = (g ^ h[j : j + n]) * np.uint64(0xFF51AFD7ED558CCD)
        g ^= g >> np.uint64(33)
    return g


def text_chunks(texts: pa.Array, inside: np.ndarray, chunk: int = CHUNK) -> Iterator[tuple[int, Words]]:
    """(index of the first text, words of some consecutive texts), null as empty; whole texts, about chunk bytes each time."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + chunk, "right")) - 1)
        yield i, Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], inside)
        i = j
