"""Vectorised 64-bit hashes of the words of many texts.

A word is hashed eight bytes at a time with a non-linear mix after each step, so that no rule of spelling
makes two words collide. Works on the bytes of Arrow string columns: A-Z count as a-z, words are runs of
bytes other than space and 0x09-0x0D. Everything is numpy on slices of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
_U = np.uint64


def _splitmix(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SEP = np.zeros(256, dtype=bool)
_SEP[[32, 9, 10, 11, 12, 13]] = True
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
_GOLD = _U(0x9E3779B97F4A7C15)
LONG_WORD = 512


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _splitmix(x)


class Spans:
    """Hashes of spans of bytes; ``fold``: what each byte counts as."""

    def __init__(self, data: np.ndarray, fold: np.ndarray):
        n = len(data)
        self._low = np.zeros(n + 8, np.uint8)
        self._low[:n] = fold[data]
        #: The eight bytes from each position on, as one number.
        self._eight = np.ndarray((n + 1,), np.dtype("<u8"), self._low.data, 0, (1,))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each span, eight at a time, mixed after each step; long ones by BLAKE2b."""
        size = end - start
        with np.errstate(over="ignore"):
            h = _splitmix(size.astype(np.uint64) * _GOLD)
            h = _splitmix((h ^ (self._eight[start] & _MASK[np.minimum(size, 8)])) * _GOLD)
            left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
            k = 8
            while len(left):
                some = self._eight[start[left] + k] & _MASK[np.minimum(size[left] - k, 8)]
                h[left] = _splitmix((h[left] ^ some) * _GOLD)
                k += 8
                left = left[size[left] > k]
        for i in np.flatnonzero(size > LONG_WORD).tolist():
            digest = hashlib.blake2b(self._low[start[i] : end[i]].tobytes(), digest_size=8).digest()
            h[i] = int.from_bytes(digest, "little")
        return h


class Words(Spans):
    """Words of a slice of texts: ``hash``, byte ``start`` and ``end``, and ``first`` word of each text.

    ``separators``: whether a byte parts words.
    """

    def __init__(self, data: np.ndarray, offs: np.ndarray, fold: np.ndarray = _FOLD, separators: np.ndarray = _SEP):
        super().__init__(data, fold)
        n = len(data)
        word = ~separators[data]
        inner = word.copy()
        inner[1:] &= word[:-1]
        inner[:1] = False
        at = offs[:-1][offs[:-1] < n]
        inner[at] = False  # a text's first byte continues no word
        self.start = np.flatnonzero(word & ~inner)
        stop = np.ones(n, dtype=bool)
        stop[:-1] = ~inner[1:]
        self.end = np.flatnonzero(word & stop) + 1
        self.first = np.searchsorted(self.start, offs)
        self.hash = self.span(self.start, self.end)


def slices(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of slices of about SLICE_BYTES; nulls are empty texts."""
    if pa.types.is_string(text.type) or pa.types.is_binary(text.type):
        kind = np.int32
    else:
        kind = np.int64
    n = len(text)
    if not n:
        return
    if text.null_count:
        text = text.fill_null("" if not pa.types.is_binary(text.type) else b"")
    _, obuf, dbuf = text.buffers()
    offs = np.frombuffer(obuf, dtype=kind)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(dbuf, dtype=np.uint8) if dbuf is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = int(np.searchsorted(offs, offs[a] + SLICE_BYTES, side="right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


_STEP = mix(np.arange(11, 11 + 8, dtype=np.uint64)) | _U(1)


def shingle_sets(w: Words, width: int = 5) -> Iterator[np.ndarray]:
    """For each text of the slice its sorted distinct shingle hashes.

    A text of fewer words than ``width`` has its whole sequence as one shingle; none has none.
    """
    with np.errstate(over="ignore"):
        total = np.zeros(max(0, len(w.hash) - width + 1), dtype=np.uint64)
        for j in range(width):
            total += w.hash[j : len(w.hash) - width + 1 + j] * _STEP[j] if len(total) else _U(0)
        total = _splitmix(total)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= width:
                yield np.unique(total[a : b - width + 1])
            elif b > a:
                short = (w.hash[a:b] * _STEP[: b - a]).sum(dtype=np.uint64) + _U((b - a) * 0x632BE59BD9B4E019 & (2**64 - 1))
                yield _splitmix(np.array([short], dtype=np.uint64))
            else:
                yield np.zeros(0, dtype=np.uint64)
