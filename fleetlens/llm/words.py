"""Words of texts and 64-bit hashes of word sequences, vectorised with numpy.

Words are runs of bytes other than blank, tab, line feed, vertical tab, form
feed and return, as UTF-8.  Hashes are sums of mixed values times powers of an
odd number modulo 2**64, so any run of words costs one subtraction of prefix
sums.  They are the same in every task and run.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a bijection)."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0x9E3779B97F4A7C15)
    return x ^ (x >> _U(32))


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = -(-n // 65_536) * 65_536
            self.up, self.down = (np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, b, np.uint64)]), dtype=np.uint64) for b in (self.base, self.inverse))
        return self.up, self.down


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA0761D6478BD642F))
_IN_WORD = Powers(0xC2B2AE3D27D4EB4F)
_IN_RUN = {1: Powers(0x9E3779B97F4A7C15), 2: Powers(0x165667B19E3779F9)}


@dataclass
class Words:
    """Words of several texts, one after another.

    ``offsets[i]:offsets[i + 1]`` are the words of text i; ``start`` and
    ``end`` are byte positions in ``data`` (all texts joined by line feeds).
    """

    data: bytes
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def doc(self) -> np.ndarray:
        """The text number of every word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def split(texts: list[str | None], lower: bool = False) -> Words:
    """Words of the texts (null: none); ``lower`` changes A-Z only."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(raw) + b"\n"
    if lower:
        data = _LOWER[np.frombuffer(data, np.uint8)].tobytes()
    buf = np.frombuffer(data, np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    start, end = edge[0::2], edge[1::2]
    up, down = _IN_WORD.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], dtype=np.uint64, out=total[1:])
    hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    text_end = np.cumsum([len(r) + 1 for r in raw])
    offsets = np.concatenate([[0], np.searchsorted(start, text_end)]).astype(np.int64)
    return Words(data, offsets, start, end, hashes)


def runs(words: Words, length: int, base: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``length`` words that lie in one text, and the
    position (word number over all texts) where each starts.  ``base`` picks
    one of two independent hash functions."""
    n = len(words.hash)
    first = np.arange(n - length + 1) if n >= length else np.zeros(0, np.int64)
    if len(first):
        doc = words.doc()
        first = first[doc[: n - length + 1] == doc[length - 1 :]]
    up, down = _IN_RUN[base].upto(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words.hash * up[:n], dtype=np.uint64, out=total[1:])
    return mix((total[first + length] - total[first]) * down[first]), first


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
