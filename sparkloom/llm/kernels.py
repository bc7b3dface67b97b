"""Vectorised byte, word and shingle hashing shared by the text operators.

Everything here works on one Arrow batch inside a Spark task: the texts of the
batch are laid end to end as bytes and hashed with numpy. Positions are byte
offsets into that concatenation; ``bounds`` holds the start of every text.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_held_powers: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64; the longest run asked for is kept."""
    held = _held_powers.get(int(base))
    if held is None or len(held) < n:
        held = np.full(n + n // 4 + 1, base, dtype=np.uint64)
        held[0] = 1
        held = _held_powers[int(base)] = np.cumprod(held, dtype=np.uint64)
    return held[:n]


#: A random-looking 64-bit value for each byte, so that a range hash is not a
#: polynomial in the small byte values themselves.
BYTE_VALUES = mix64((np.arange(256, dtype=np.uint64) + np.uint64(1)) * _ODD)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class RangeHasher:
    """O(1) hashes of any byte range of one buffer (sums modulo 2**64)."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self._sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(BYTE_VALUES[data] * _powers(_BASE, n), out=self._sums[1:])
        self._back = _powers(_INVERSE, n + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of data[start:end]; the length takes part in the hash."""
        raw = (self._sums[end] - self._sums[start]) * self._back[start]
        return mix64(raw + (end - start).astype(np.uint64) * _ODD)

    def every(self, length: int) -> np.ndarray:
        """Hashes of all ranges of one length, for comparing with each other."""
        n = max(0, len(self._sums) - length)
        raw = (self._sums[length:] - self._sums[:n]) * self._back[:n]
        raw ^= raw >> np.uint64(32)
        raw *= _MIX1
        raw ^= raw >> np.uint64(29)
        return raw


def lay_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one uint8 array, each followed by one zero byte, and the
    start of each text (with the end of the buffer as last entry)."""
    bounds = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    return np.frombuffer(b"\0".join([*texts, b""]), dtype=np.uint8), bounds


#: Bytes that end a word, and the lower-casing of A-Z alone.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, and for each
    text the index of its first word (one more entry closes the last text)."""
    data, bounds = lay_out(texts)
    inside = np.ones(256, dtype=bool)
    inside[list(SPACES)] = False
    is_word = inside[data]
    is_word[bounds[1:] - 1] = False  # the separator after each text
    edge = np.flatnonzero(np.diff(np.concatenate(([0], is_word.view(np.int8), [0]))))
    start, end = edge[0::2], edge[1::2]
    return RangeHasher(data)(start, end), np.searchsorted(start, bounds)


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes of ``size`` words.

    A text of fewer words has its whole word sequence as one shingle; a text
    without words has an empty set.
    """
    words, first = word_hashes(texts)
    n = len(words)
    whole = np.zeros(max(0, n - size + 1), dtype=np.uint64)
    weights = _powers(np.uint64(0xA24BAED4963EE407), size + 1)[1:]
    for j in range(size if len(whole) else 0):
        whole += words[j : j + len(whole)] * weights[j]
    whole = mix64(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            short = (words[a:b] * weights[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mix64(np.array([short], dtype=np.uint64)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out
