"""Words and word windows of whole texts as 64-bit hashes, in numpy, many texts at a time.

Words are `[^\\x20\\x09-\\x0D]+` in UTF-8. A word's hash is a polynomial over its bytes and a window's a polynomial
over its words' hashes, both modulo 2**64 and finished by an avalanche, so all come from running sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Text bytes hashed side by side; a longer text is a group of its own.
GROUP_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xD1342543DE82EF95


def mix(x: np.ndarray) -> np.ndarray:
    """The finisher of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BYTE = mix((np.arange(1, 257, dtype=np.uint64)) * np.uint64(_BASE))
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        made = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers[base] = tuple(made)
    return _powers[base][0][:n], _powers[base][1][:n]


def _window_sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """sum(values[i] * base**(i - begin)) over begin <= i < end, for each span."""
    powers, inverse = _power(base, len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=total[1:])
    return (total[end] - total[begin]) * inverse[begin]


@dataclass
class Words:
    """The words of a group of texts, one after the other."""

    data: bytes
    begin: np.ndarray  # byte where each word begins, in data
    end: np.ndarray
    first: np.ndarray  # first[d]:first[d + 1] are the words of text d
    hashes: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word) of each k words in a row that lie in one text."""
        n = len(self.hashes)
        if n < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.arange(n - k + 1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = at[text[at] == text[at + k - 1]]
        return mix(_window_sums(self.hashes, at, at + k, _WINDOW_BASE) + np.uint64(k)), at

    def sequence(self, d: int) -> int:
        """One hash of all words of text d."""
        part = self.hashes[self.first[d] : self.first[d + 1]]
        span = np.array([0]), np.array([len(part)])
        return int(mix(_window_sums(part, *span, _WINDOW_BASE) + np.uint64(len(part)))[0])


def split_words(texts: list[bytes]) -> Words:
    data = b" ".join(texts) + b" "
    buffer = np.frombuffer(data, np.uint8)
    space = _SPACE[buffer]
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate([[0], np.searchsorted(begin, ends)])
    hashes = mix(_window_sums(_BYTE[buffer], begin, end, _BASE) + (end - begin).astype(np.uint64))
    return Words(data, begin, end, first, hashes)


def grouped(rows: Iterator[tuple], text: int = 1) -> Iterator[list[tuple]]:
    """Rows in lists of about GROUP_BYTES of text; `text` is the place of the bytes."""
    group, size = [], 0
    for row in rows:
        group.append(row)
        size += len(row[text]) + 1
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
