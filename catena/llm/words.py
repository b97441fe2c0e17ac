"""Words of many texts at once, as numpy arrays: boundaries and 64-bit hashes.

A word is a run of bytes other than ASCII white space. Its hash takes eight
bytes at a time and mixes in between, so that words of up to eight bytes and one
length never collide; very long words are hashed by XXH3. Hashes of windows are
polynomials of those over cumulative sums modulo 2^64, so that a window of any
length costs one subtraction, and are mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WINDOW_BASE = 0xD6E8FEB86659FD93
#: The low bytes of eight, by their number.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LENGTH, _STEP = _U(0x9E3779B97F4A7C15), _U(0xA0761D6478BD642F)
#: Bytes of the longest word that is hashed along with the others.
LONG_WORD = 256
_powers: dict[tuple[int, bool], np.ndarray] = {}


def power(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, or of its inverse."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        step = pow(base, -1, 1 << 64) if inverse else base
        size = 1 << max(16, (n - 1).bit_length())
        have = np.ones(1, _U)
        while len(have) < size:
            have = np.concatenate((have, have * _U(pow(step, len(have), 1 << 64))))
        if size <= 1 << 23:
            _powers[base, inverse] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(32))


class Words:
    """The words of a list of texts: begin and end bytes in data, hash, and the words before each text."""

    def __init__(self, texts: list[bytes]):
        raw = b" " + b" ".join(texts) + b" " * 9
        data = np.frombuffer(raw, np.uint8)
        space = _SPACE[data]
        cut = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.begin, self.end = cut[0::2], cut[1::2]
        offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
        #: Word index at which each text begins; one more at the end.
        self.first = np.searchsorted(self.begin, offsets)
        self.count = np.diff(self.first)
        self.data = data
        #: Eight bytes from each place on.
        self._eight = np.ndarray(len(data) - 7, "<u8", raw, strides=(1,))
        size = self.end - self.begin
        self.hash = mix((self._eight[self.begin] & _LOW[np.minimum(size, 8)]) ^ (size.astype(_U) * _LENGTH))
        more = np.flatnonzero((size > 8) & (size <= LONG_WORD))
        at = 8
        while len(more):
            left = size[more] - at
            part = self._eight[self.begin[more] + at] & _LOW[np.minimum(left, 8)]
            self.hash[more] = mix(self.hash[more] * _STEP + part)
            more = more[left > 8]
            at += 8
        for k in np.flatnonzero(size > LONG_WORD).tolist():
            self.hash[k] = xxhash.xxh3_64_intdigest(raw[self.begin[k] : self.end[k]])

    def of_text(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, at: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
        """Hashes of size words from each word index in at."""
        n = len(self.hash)
        sums = np.empty(n + 1, _U)
        sums[0] = 0
        np.cumsum((mix(self.hash ^ _U(salt)) if salt else self.hash) * power(_WINDOW_BASE, n), out=sums[1:])
        return mix((sums[at + size] - sums[at]) * power(_WINDOW_BASE, n + 1, True)[at])


def chunks(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, Words]]:
    """Words of about limit bytes of texts at a time, each with the index of its first text."""
    a = size = 0
    for b, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield a, Words(texts[a:b])
            a, size = b, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, Words(texts[a:])


def spark_xxhash64(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a column of longs, as signed longs (XXH64 of eight bytes with seed 42)."""
    p1, p2, p3, p4, p5 = (_U(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    rot = lambda v, r: (v << _U(r)) | (v >> _U(64 - r))
    h = np.full(len(x), 42 + 8, _U) + p5
    h ^= rot(x.astype(np.int64).view(_U) * p2, 31) * p1
    h = rot(h, 27) * p1 + p4
    h = (h ^ (h >> _U(33))) * p2
    h = (h ^ (h >> _U(29))) * p3
    return (h ^ (h >> _U(32))).view(np.int64)
