"""Token counts of byte-level BPE vocabularies: rank-synchronous merging of ragged arrays.

Texts are cut at spaces into chunks, chunks by the vocabulary's pre-tokeniser pattern into pieces. All pieces that
a batch needs and the worker has not met yet are merged together: they lie end to end in one array of symbols, and
each round finds every sequence's lowest-ranked adjacent pair and applies it at once in all sequences. Sequences
without a pair left are done; what survives are the tokens. Counts are kept by chunk, as pure functions of the
string, so the keeping changes speed only. A piece of over LONG_PIECE bytes goes through a heap of its pairs instead.

Defined results: null and empty texts have 0 bytes and 0 tokens. Special strings inside a text are single tokens, as
in the library's default. No truncation at any length. Repeated rows are counted row by row; extra columns are
carried along by `count_tokens`, and a clash with an output name is an error that names the column.
"""

from __future__ import annotations

import json
import re
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .chunks import Chunks
from .shared import ship, text_pieces, worker_store

NO_RANK = np.iinfo(np.int32).max
#: Pieces of more bytes than this are merged one by one.
LONG_PIECE = 1024

# Pre-tokeniser pattern of byte-level BPE, for any text (Unicode properties), and the same over ASCII and the Latin-1
# letters only, where Python's faster engine agrees with it.
ANY = regex.compile(
    r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
_L = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")


class PairTable:
    """Open-addressing table from a pair of symbols to (rank, merged symbol)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        n = len(left)
        self.bits = max(4, int(n * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.full(1 << self.bits, NO_RANK, np.int32)
        self.merged = merged.astype(np.int32)
        key = (left.astype(np.int64) << 32) | right
        todo, slot = np.arange(n), self._slot(key)
        while len(todo):
            s = slot[todo]
            free = self.keys[s] < 0
            _, first = np.unique(s, return_index=True)
            winner = np.zeros(len(todo), bool)
            winner[first] = True
            put = todo[free & winner]
            self.keys[slot[put]], self.rank[slot[put]] = key[put], put
            todo = todo[~(free & winner)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.int64) << 32) | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.rank[slot], NO_RANK)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.rank[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out


class Merger:
    """A byte-level BPE vocabulary file in the library's JSON form."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        ids = {k: i for i, k in enumerate(dict.fromkeys([*vocab, *(a + b for a, b in pairs)]))}
        shown = [b for r in ((33, 127), (161, 173), (174, 256)) for b in range(*r)]  # bytes that stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte = np.array([ids.get(char[b], -1) for b in range(256)], np.int32)
        self.table = PairTable(*(np.array(x, np.int64) for x in zip(*((ids[a], ids[b], ids[a + b]) for a, b in pairs), strict=True)))
        added = spec.get("added_tokens") or []
        added = [a for a in added if a["content"]]
        if any(a.get("lstrip") or a.get("rstrip") or a.get("single_word") for a in added):
            raise ValueError("added tokens that strip spaces or match whole words only are not supported")
        self.pairs: dict[int, int] | None = None
        self.added = [a["content"] for a in added]
        self.special = re.compile("|".join(re.escape(x) for x in sorted((a["content"] for a in added), key=lambda x: -len(x)))) if added else None

    def _long(self, piece: bytes) -> int:
        """Number of symbols that one long piece ends with. Its pairs wait in a heap by rank and place, so a merge costs
        its neighbours alone, where a round over arrays costs the whole piece."""
        if self.pairs is None:
            t = self.table
            at = np.flatnonzero(t.keys >= 0)
            self.pairs = dict(zip(t.keys[at].tolist(), t.rank[at].tolist(), strict=True))
        sym = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(sym)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.table.ranks(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(r, i) for i, r in enumerate(first.tolist()) if r != NO_RANK]
        heapify(heap)
        left = n
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j < 0 or sym[i] < 0 or self.pairs.get(sym[i] << 32 | sym[j]) != rank:
                continue
            sym[i], sym[j] = int(self.table.merged[rank]), -1
            k = after[i] = after[j]
            left -= 1
            if k >= 0:
                before[k] = i
                if (r := self.pairs.get(sym[i] << 32 | sym[k])) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := self.pairs.get(sym[h] << 32 | sym[i])) is not None:
                heappush(heap, (r, h))
        return left

    def surviving(self, pieces: list[bytes]) -> np.ndarray:
        """Number of symbols that each piece ends with."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out = np.zeros(len(pieces), np.int64)
        long = np.flatnonzero(size > LONG_PIECE)
        for i in long.tolist():
            out[i] = self._long(pieces[i])
        here = np.flatnonzero(size <= LONG_PIECE)
        sym = self.byte[np.frombuffer(b"".join(pieces) if not len(long) else b"".join(pieces[i] for i in here.tolist()), np.uint8)]
        seq = np.repeat(here, size[here])
        while len(sym):
            rank = np.full(len(sym), NO_RANK, np.int32)
            same = np.flatnonzero(seq[1:] == seq[:-1])
            rank[same] = self.table.ranks(sym[same], sym[same + 1])
            begin = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            many = np.diff(np.r_[begin, len(sym)])
            low = np.minimum.reduceat(rank, begin)
            done = low == NO_RANK
            out[seq[begin[done]]] = many[done]
            least = np.repeat(low, many)
            alive = least != NO_RANK
            hit = alive & (rank == least)
            at = np.flatnonzero(hit)
            if len(at) > 1 and (np.diff(at) == 1).any():  # a run of one symbol: every other pair, from the left
                head = np.r_[True, np.diff(at) != 1]
                at = at[(np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))) % 2 == 0]
            sym[at] = self.table.merged[rank[at]]
            alive[at + 1] = False
            sym, seq = sym[alive], seq[alive]
        return out


class Counter:
    """Counts tokens of texts with one vocabulary; one for each Python worker."""

    def __init__(self, path: str, bits: int = 20):
        self.merger = Merger(path)
        special = [x.encode() for x in self.merger.added]
        self.chunks = Chunks(self._learn, self._whole, special, np.dtype(np.int64), bits)

    def _by_pattern(self, pattern, texts: list[str]) -> np.ndarray:
        found = [pattern.findall(x) for x in texts]
        pieces = {x: k for k, x in enumerate(dict.fromkeys(chain.from_iterable(found)))}
        names, counts = list(pieces), [np.zeros(0, np.int64)]
        for at in range(0, len(names), 65_536):
            counts.append(self.merger.surviving([x.encode("utf-8", "surrogatepass") for x in names[at : at + 65_536]]))
        each = np.concatenate(counts)
        size = np.fromiter(map(len, found), np.int64, len(found))
        total = np.r_[0, np.cumsum(each[np.fromiter((pieces[x] for x in chain.from_iterable(found)), np.int64, int(size.sum()))])]
        end = np.cumsum(size)
        return total[end] - total[end - size]

    def _learn(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._by_pattern(PLAIN, _strings(raw, ends)), np.ones(len(ends), np.int64)

    def _whole(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of any letters, with special strings, each of which is one token."""
        out, parts, owner = np.zeros(len(ends), np.int64), [], []
        for i, text in enumerate(_strings(raw, ends)):
            cut = self.merger.special.split(text) if self.merger.special else [text]
            out[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        np.add.at(out, owner, self._by_pattern(ANY, parts))
        return out, np.ones(len(ends), np.int64)

    def count(self, texts) -> np.ndarray:
        """Tokens of each text of an Arrow string array (or list)."""
        out = [np.zeros(0, np.int64)]
        for _, _, buf, offs in text_pieces(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())):
            values, begin = self.chunks.read(buf, offs)
            total = np.r_[0, np.cumsum(values)]
            out.append(total[begin[1:]] - total[begin[:-1]])
        return np.concatenate(out)


def _strings(raw: bytes, ends: np.ndarray) -> list[str]:
    ends = ends.tolist()
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text") -> DataFrame:
    """All columns of docs but the text, and n_bytes, n_tokens, over_limit (n_tokens > limit)."""
    ship(docs.sparkSession)
    new = ["n_bytes", "n_tokens", "over_limit"]
    if clash := {*new} & {*docs.columns}:
        raise ValueError(f"columns of these names exist already: {sorted(clash)}")
    keep = [c for c in docs.columns if c != text]
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        counter = worker_store(f"tokens:{path}", lambda: Counter(path))
        for b in batches:
            col = b.column(text)
            sizes = [np.diff(offs) for _, _, _, offs in text_pieces(col)]
            counts = counter.count(col)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate([np.zeros(0, np.int64), *sizes])), pa.array(counts), pa.array(counts > limit)], names=[*keep, *new])

    return docs.mapInArrow(run, schema)
