"""Chunks of texts, cut before every space, and a table of what is known of them; shared by token counts and packing.

Byte-level pre-tokenisers never join across the start of a space that stands alone, so a text of plain letters may be
cut there and each chunk looked at once. Chunks of up to KEY bytes are keys as they are, with nothing hashed away: two
words of 64 bits, found in an open-addressing table by array operations. The table's size is fixed; it starts afresh
when half full. Longer chunks, and texts that may not be cut, are asked for again in each batch and not kept, so no
long text or word stays in memory.
"""

from __future__ import annotations

import numpy as np

from .textops import lanes, mix, ranges

_U = np.uint64
KEY = 16
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of plain text: printable ASCII, white space, and the Latin-1 letters' two bytes (checked as pairs).
_ODD = np.ones(256, bool)
_ODD[[*range(0x09, 0x0E), *range(0x20, 0x7F)]] = False
_LETTER = np.zeros(256, bool)  # second bytes after 0xC3: all but the signs of multiplication and division
_LETTER[[b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)]] = True


def plain(buf: np.ndarray, offs: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Which texts may be cut before each space without changing their pre-tokens: Latin-1 letters and ASCII only, no
    space inside a longer run of white space or at the end, no special string."""
    n = len(buf)
    bad = np.zeros(n + 1, np.int32)
    odd = np.flatnonzero(_ODD[buf])
    if len(odd):
        after, before = buf[np.minimum(odd + 1, n - 1)], buf[np.maximum(odd - 1, 0)]
        bad[odd] = ~(((buf[odd] == 0xC3) & _LETTER[after]) | ((before == 0xC3) & _LETTER[buf[odd]]))
    edge = np.zeros(n + 2, bool)  # the ends of texts count as white space
    edge[1 : n + 1] = _WHITE[buf]
    space = np.flatnonzero(buf == 0x20)
    first, last = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    first[offs[:-1]], last[offs[1:]] = True, True
    bad[space] |= (edge[space] | first[space]) & (edge[space + 2] | last[space + 1])
    bad[space] |= last[space + 1]
    total = np.zeros(n + 2, np.int64)
    np.cumsum(bad, out=total[1:])
    out = total[offs[1:]] == total[offs[:-1]]
    raw = buf.tobytes() if special else b""
    for x in special:
        at = raw.find(x)
        while at >= 0:
            out[np.searchsorted(offs, at, "right") - 1] = False
            at = raw.find(x, at + 1)
    return out


class Known:
    """Open addressing from keys of KEY bytes to numbers 0, 1, 2, ... in the order of arrival."""

    def __init__(self, bits: int):
        self.bits, self.n = bits, 0
        self.keys, self.number = np.zeros((1 << bits, 2), _U), np.full(1 << bits, -1, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(keys[:, 0] + keys[:, 1] * _U(0x9E3779B97F4A7C15)) >> _U(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of keys; -1 for those that are not there."""
        slot = self._slot(keys)
        out = self.number[slot]
        there = self.keys[slot]
        todo = np.flatnonzero((out >= 0) & ((there[:, 0] != keys[:, 0]) | (there[:, 1] != keys[:, 1])))
        slot, keys = slot[todo], keys[todo]
        while len(todo):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            got, there = self.number[slot], self.keys[slot]
            out[todo] = got
            on = np.flatnonzero((got >= 0) & ((there[:, 0] != keys[:, 0]) | (there[:, 1] != keys[:, 1])))
            todo, slot, keys = todo[on], slot[on], keys[on]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = np.flatnonzero(self.number[s] < 0)
            _, first = np.unique(s[free], return_index=True)
            put = todo[free[first]]
            self.keys[slot[put]], self.number[slot[put]] = keys[put], self.n + put
            left = np.ones(len(todo), bool)
            left[free[first]] = False
            todo = todo[left]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        self.n += len(keys)


class Chunks:
    """Values of texts' chunks, computed once for each chunk that is kept.

    learn(bytes, ends) gives the values of chunks that lie end to end in bytes, as (values, how many of each chunk);
    whole does the same for texts that may not be cut.
    """

    def __init__(self, learn, whole, special: list[bytes], kind, bits: int = 20):
        self.learn, self.whole, self.special = learn, whole, special
        self.bits, self.kind = bits, kind
        self._drop()

    def _drop(self) -> None:
        self.known = Known(self.bits)
        self.values, self.begin = np.zeros(1 << 12, self.kind), np.zeros(1 << 12, np.int64)

    def _keep(self, values: np.ndarray, size: np.ndarray) -> None:
        n, k = self.known.n, len(size)
        while len(self.begin) <= n + k:
            self.begin = np.concatenate([self.begin, np.zeros_like(self.begin)])
        end = self.begin[n] + len(values)
        while len(self.values) < end:
            self.values = np.concatenate([self.values, np.zeros_like(self.values)])
        self.values[self.begin[n] : end] = values
        self.begin[n + 1 : n + k + 1] = self.begin[n] + np.cumsum(size)

    def read(self, buf: np.ndarray, offs: np.ndarray, end=()) -> tuple[np.ndarray, np.ndarray]:
        """(values of all texts end to end, where each text's begin). After each text come the values `end`."""
        texts = len(offs) - 1
        cuttable = plain(buf, offs, self.special)
        size = np.diff(offs)
        # entries: chunks of texts that may be cut, other texts whole, and one end for each text
        starts = buf == 0x20
        inside = np.repeat(cuttable, size)
        starts &= inside
        starts[offs[:-1][size > 0]] = True
        at = np.flatnonzero(starts)
        owner = np.searchsorted(offs, at, "right") - 1
        stop = np.empty(len(at), np.int64)
        stop[:-1] = at[1:]
        if len(at):
            stop[-1] = len(buf)
        long = stop - at
        short = cuttable[owner] & (long <= KEY)
        # three kinds of values lie end to end: known ones, those of this batch alone, and the end's
        which = np.empty(len(at), np.int64)
        pick = np.flatnonzero(short)
        lane = lanes(buf)
        keys = np.empty((len(pick), 2), _U)
        keys[:, 0] = lane[at[pick]] & _KEEP[np.minimum(long[pick], 8)]
        keys[:, 1] = lane[np.minimum(at[pick] + 8, len(buf))] & _KEEP[np.clip(long[pick] - 8, 0, 8)]
        ask = lambda f, i: f(buf[ranges(at[i], long[i])].tobytes(), np.cumsum(long[i]))
        which[pick] = self._numbers(keys, lambda one: ask(self.learn, pick[one]))
        own, sizes, n = [], [], self.known.n
        odd = np.flatnonzero(~short)
        if len(odd):
            words, texts_ = odd[cuttable[owner[odd]]], odd[~cuttable[owner[odd]]]
            for part, f in ((words, self.learn), (texts_, self.whole)):
                if len(part):
                    values, many = ask(f, part)
                    which[part] = n + sum(map(len, sizes)) + np.arange(len(part))
                    own.append(values)
                    sizes.append(many)
        tail = np.asarray(end, self.kind)
        values = np.concatenate([self.values[: self.begin[n]], *own, tail])
        begin = np.concatenate([self.begin[: n + 1], self.begin[n] + np.cumsum(np.concatenate([*sizes, [len(tail)]]).astype(np.int64))])
        first_of = np.searchsorted(owner, np.arange(texts + 1), "left")
        entry = np.empty(len(at) + texts, np.int64)
        entry[np.arange(len(at)) + owner] = which
        entry[first_of[1:] + np.arange(texts)] = len(begin) - 2
        many = begin[entry + 1] - begin[entry]
        total = np.r_[0, np.cumsum(many)]
        return values[ranges(begin[entry], many)], total[first_of + np.arange(texts + 1)]

    def _numbers(self, keys: np.ndarray, learn) -> np.ndarray:
        """Numbers of keys; those that are not known are learned first."""
        number = self.known.find(keys)
        new = np.flatnonzero(number < 0)
        for full in (False, True):
            order = new[np.lexsort((keys[new, 1], keys[new, 0]))]
            first = np.ones(len(order), bool)
            first[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
            one = order[first]
            if full or 2 * (self.known.n + len(one)) <= len(self.known.number):
                break
            self._drop()
            new = np.arange(len(keys))
        if 2 * len(one) > len(self.known.number):  # one text of more chunks than the table takes
            self.known = Known(int(4 * len(one)).bit_length())
        if len(one):
            values, many = learn(one)
            self._keep(values, many)
            base = self.known.n
            self.known.add(keys[one])
            number[order] = base + np.cumsum(first) - 1
        return number
