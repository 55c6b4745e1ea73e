"""Byte spans: words of a text, hashes that read eight bytes at a time, and exact comparison."""

from __future__ import annotations

import numpy as np
import xxhash

#: Spans of more bytes are hashed and compared one by one.
LONG = 64
_masks = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_white = np.zeros(256, bool)
_white[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets where words (runs without white space x20, x09-x0D) start and end."""
    edge = np.diff(np.concatenate([[True], _white[np.frombuffer(data, np.uint8)], [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


class Spans:
    """The spans [starts, ends) of ``data``."""

    def __init__(self, data: bytes, starts: np.ndarray, ends: np.ndarray):
        self.data, self.starts, self.ends, self.size = data, starts, ends, ends - starts
        padded = data + bytes(8)
        self.eights = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on

    def _word(self, rows: np.ndarray, j: int) -> np.ndarray:
        """Bytes 8 j to 8 j + 7 of the spans ``rows``, zero beyond their ends."""
        return self.eights[self.starts[rows] + 8 * j] & _masks[np.minimum(self.size[rows] - 8 * j, 8)]

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash per span, mixed word by word."""
        h = mix(self.size.astype(np.uint64) + np.uint64(seed))
        rows = np.flatnonzero((self.size > 0) & (self.size <= LONG))
        for j in range(LONG // 8):
            if not len(rows):
                break
            x = (h[rows] ^ self._word(rows, j)) * np.uint64(0x9FB21C651E98DF25)
            h[rows] = (x ^ (x >> np.uint64(35))) * np.uint64(0xD6E8FEB86659FD93)
            rows = rows[self.size[rows] > 8 * (j + 1)]
        for i in np.flatnonzero(self.size > LONG).tolist():
            h[i] = xxhash.xxh64_intdigest(self.data[self.starts[i] : self.ends[i]], seed)
        return mix(h)

    def differ(self, other: np.ndarray) -> np.ndarray:
        """The spans i whose bytes are not those of span ``other[i]``."""
        unlike = self.size != self.size[other]
        rows = np.flatnonzero(~unlike & (self.size <= LONG) & (self.size > 0) & (other != np.arange(len(other))))
        for j in range(LONG // 8):
            if not len(rows):
                break
            unlike[rows] |= self._word(rows, j) != self._word(other[rows], j)
            rows = rows[self.size[rows] > 8 * (j + 1)]
        for i in np.flatnonzero(~unlike & (self.size > LONG)).tolist():
            k = other[i]
            unlike[i] = i != k and self.data[self.starts[i] : self.ends[i]] != self.data[self.starts[k] : self.ends[k]]
        return np.flatnonzero(unlike)
