"""Word, window and shingle hashes of many texts at once, on the bytes of an Arrow string column.

A word is read in lanes of eight bytes, which a mixer that is one-to-one folds in one after the other; words of more
than LONG bytes are hashed by BLAKE2. A window's hash is that of two overlapping halves, mixed, down to single words.
Nothing is a polynomial, so no pattern of bytes or words makes two of them agree but by the chance of 64 bits; a
second stream of other constants, from the words on, gives 128 bits where `stream=1` is asked for too.
"""

from __future__ import annotations

import hashlib

import numpy as np

_U = np.uint64


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of splitmix64; one-to-one for each salt."""
    with np.errstate(over="ignore"):
        x = x + _U((0x9E3779B97F4A7C15 * (2 * salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> _U(shift)
            x *= _U(factor)
        x ^= x >> _U(31)
    return x


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of more bytes than this are hashed one by one.
LONG = 256
#: Bytes of a lane that belong to a word with so many bytes left.
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)


def lanes(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as little-endian numbers; zeros beyond the end."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    return np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))


class Words:
    """Words of a run of texts: byte spans, 64-bit hashes, and the first word of each text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lower: bool = False):
        n = len(buf)
        solid = ~SPACE[buf]
        begins = np.empty(n + 1, bool)
        begins[1:n] = solid[1:] & ~solid[:-1] if n else False
        begins[n] = False
        ends = np.zeros(n + 1, bool)
        if n:
            begins[0] = solid[0]
            ends[1:n] = solid[:-1] & ~solid[1:]
            ends[n] = solid[-1]
            inner = offs[1:-1]
            inner = inner[(inner > 0) & (inner < n)]
            begins[inner] = solid[inner]
            ends[inner] = solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.starts, offs, "left")  # of each text, and the total
        self.count = np.diff(self.first)
        self._buf = LOWER[buf] if lower else buf
        self._hashes: dict[int, np.ndarray] = {}

    @property
    def hash(self) -> np.ndarray:
        return self.hashes(0)

    def hashes(self, stream: int) -> np.ndarray:
        """64 bits of each word; streams 0 and 1 are independent."""
        if stream not in self._hashes:
            self._hashes[stream] = self._read(stream)
        return self._hashes[stream]

    def _read(self, stream: int) -> np.ndarray:
        size, lane = self.ends - self.starts, lanes(self._buf)
        h = mix(size.astype(_U), 41 + stream)
        todo, k = np.arange(len(size)), 0
        if len(size) and (far := size > LONG).any():
            todo = np.flatnonzero(~far)
            for i in np.flatnonzero(far):
                digest = hashlib.blake2b(self._buf[self.starts[i] : self.ends[i]].tobytes(), digest_size=16).digest()
                h[i] = int.from_bytes(digest[8 * stream : 8 * stream + 8], "little")
        else:  # the first lane of all at once
            h = mix(h ^ (lane[self.starts] & _KEEP[np.minimum(size, 8)]), 43 + stream)
            todo, k = np.flatnonzero(size > 8), 1
        while len(todo):
            left = size[todo] - 8 * k
            h[todo] = mix(h[todo] ^ (lane[self.starts[todo] + 8 * k] & _KEEP[np.minimum(left, 8)]), 43 + stream)
            todo, k = todo[left > 8], k + 1
        return h

    def windows(self, width: int, stream: int = 0) -> np.ndarray:
        """Hash of the words i .. i+width-1 for every i; those that cross texts are for the caller to leave out."""
        g, have = self.hashes(stream), 1
        if len(g) < width:
            return np.zeros(0, _U)
        while have < width:  # two overlapping runs of `have` words make one of up to twice as many
            step = min(have, width - have)
            with np.errstate(over="ignore"):
                h = g[:-step] * _U(0xD6E8FEB86659FD93)
                h += g[step:]
                h ^= h >> _U(32)
                h *= _U((0xA0761D6478BD642F, 0xE7037ED1A0B428DB)[stream])
            g, have = h, have + step
        return mix(g, 7 + stream)

    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def window_starts(self, width: int) -> np.ndarray:
        """Words at which a whole window of one text begins."""
        many = np.maximum(self.count - width + 1, 0)
        return ranges(self.first[:-1], many)


def ranges(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """begin[k], begin[k]+1, ... (many[k] of them), for all k, in one array."""
    total = int(many.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(many)
    return np.arange(total) + np.repeat(begin - (ends - many), many)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text: (hashes, where each text's begin).

    Fewer words than the width: the whole sequence as one; no words: none.
    """
    all_windows = words.windows(width)
    at = words.window_starts(width)
    h = all_windows[at] if len(at) else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(words.count)), np.maximum(words.count - width + 1, 0))
    short = np.flatnonzero((words.count > 0) & (words.count < width))
    if len(short):
        h, owner = np.concatenate([h, _whole(words, short, width)]), np.concatenate([owner, short])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
        h, owner = h[new], owner[new]
    return h, np.searchsorted(owner, np.arange(len(words.count) + 1), "left")


def _whole(words: Words, which: np.ndarray, width: int) -> np.ndarray:
    """Hash of all words of texts with fewer than `width`."""
    out = mix(words.count[which].astype(_U), 3)
    for k in range(width - 1):
        on = np.flatnonzero(words.count[which] > k)
        out[on] = mix(out[on] ^ words.hash[words.first[which[on]] + k], 5)
    return out
