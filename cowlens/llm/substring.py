"""Removal of repeated passages: difference-cover anchors, then extension to whole windows.

A difference cover D modulo v has, for any two places i and j, a shift d < v with both i+d and j+d in D modulo v.
So two equal runs of `width` words share a pair of equal anchor windows of width-v+1 words that both lie at cover
positions, and only those positions need hashing: |D|/v of all. Two rounds follow, each of which sends hashes, not
texts, to the bucket that owns them and back to the block of documents that asked:

1. anchors at cover positions: which of a block's anchors occur elsewhere, too;
2. every window that reaches over such an anchor is extended to its whole width and hashed with 128 bits, two streams
   that are independent from the words on: which of them start in two places.

A block sends each hash at most twice, so a passage that a third of all documents hold costs a bucket two entries
a block, however often it occurs. Blocks are dealt by a hash of the row's number, so rows that repeat are spread;
docs should be a table whose rows keep their order when they are read again (files, a checkpoint). The exchange of the
documents is one, used three times.

Defined results: null and empty texts have no words, nothing is removed, and what is kept is the empty string.
Texts shorter than the window are kept. Rows that repeat (same doc_id, same text) are different places, so their
windows repeat. Null doc_ids are kept. Extra columns are carried if named; a clash of these with the result's is an error
that names them.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, release, ship, text_pieces
from .textops import Words, ranges

#: Difference covers: period and residues whose differences take every value.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}

SENT = "bucket int, block int, hashes binary"
BACK = "block int, hashes binary"


def cover_for(width: int) -> tuple[int, tuple[int, ...]]:
    """The sparsest cover that leaves anchors of at least two fifths of the window; all positions for narrow windows."""
    fit = [v for v in COVERS if width - v + 1 >= max(2, 2 * width // 5)]
    return (max(fit), COVERS[max(fit)]) if fit else (1, (0,))


def _at_cover(words: Words, width: int) -> tuple[np.ndarray, int]:
    """Word indices at which anchors begin, and the anchors' width."""
    period, residues = cover_for(width)
    anchor = width - period + 1
    at = words.window_starts(anchor)
    place = at - np.repeat(words.first[:-1], np.maximum(words.count - anchor + 1, 0))
    lut = np.zeros(period, bool)
    lut[list(residues)] = True
    return at[lut[place % period]], anchor


def _twice(keys: np.ndarray) -> np.ndarray:
    """Sorted keys (rows of one or two words), each at most twice."""
    keys = keys[np.lexsort(keys.T[::-1])]
    if len(keys) > 2:
        third = np.zeros(len(keys), bool)
        third[2:] = (keys[2:] == keys[:-2]).all(1)
        keys = keys[~third]
    return keys


def _send(parts: list[np.ndarray], columns: int, block: int, buckets: int) -> pa.Table:
    keys = _twice(np.concatenate(parts)) if parts else np.zeros((0, columns), np.uint64)
    to = (keys[:, 0] % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    keys, to = keys[order], to[order]
    owner, begin = np.unique(to, return_index=True)
    blobs = [x.tobytes() for x in np.split(keys, begin[1:])] if len(owner) else []
    return pa.table({"bucket": pa.array(owner, pa.int32()), "block": pa.array([block] * len(owner), pa.int32()), "hashes": pa.array(blobs, pa.binary())})


def _match(columns: int):
    def run(t: pa.Table) -> pa.Table:
        blocks, blobs = t.column("block").to_numpy(), t.column("hashes").to_pylist()
        keys = np.frombuffer(b"".join(blobs), np.uint64).reshape(-1, columns)
        owner = np.repeat(blocks, [len(x) // (8 * columns) for x in blobs])
        order = np.lexsort([*keys.T[::-1]])
        keys, owner = keys[order], owner[order]
        same = (keys[1:] == keys[:-1]).all(1)
        shared = np.r_[same, False] | np.r_[False, same]
        keys, owner = keys[shared], owner[shared]
        order = np.argsort(owner, kind="stable")
        keys, owner = keys[order], owner[order]
        who, begin = np.unique(owner, return_index=True)
        out = [np.unique(x, axis=0).tobytes() if columns > 1 else np.unique(x).tobytes() for x in np.split(keys, begin[1:])] if len(who) else []
        return pa.table({"block": pa.array(who, pa.int32()), "hashes": pa.array(out, pa.binary())})

    return run


def _known(t: pa.Table, columns: int) -> np.ndarray:
    return np.frombuffer(b"".join(t.column("hashes").to_pylist()), np.uint64).reshape(-1, columns)


def _member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array."""
    if not len(among):
        return np.zeros(len(keys), bool)
    return among[np.minimum(np.searchsorted(among, keys), len(among) - 1)] == keys


def _repeated(words: Words, width: int, starts: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Those of the window starts whose two hashes are a row of known, which is sorted by its first column."""
    starts = starts[_member(words.windows(width, 0)[starts], known[:, 0])]
    if not len(starts):
        return starts
    a, b = words.windows(width, 0)[starts], words.windows(width, 1)[starts]
    out = np.zeros(len(starts), bool)
    step, hi = np.searchsorted(known[:, 0], a, "left"), np.searchsorted(known[:, 0], a, "right")
    todo = np.arange(len(starts))
    while len(todo):  # almost always one round: first words rarely agree by chance
        out[todo] |= known[step[todo], 1] == b[todo]
        step[todo] += 1
        todo = todo[(step[todo] < hi[todo]) & ~out[todo]]
    return starts[out]


def _candidates(words: Words, width: int, shared: np.ndarray) -> np.ndarray:
    """Window starts that reach over a shared anchor."""
    at, anchor = _at_cover(words, width)
    hit = at[_member(words.windows(anchor)[at], shared)] if len(at) else at
    if not len(hit):
        return hit
    reach = np.zeros(len(words.starts) + 1, np.int64)
    np.add.at(reach, np.maximum(hit - (width - anchor), 0), 1)
    np.add.at(reach, hit + 1, -1)
    over = np.cumsum(reach[:-1]) > 0
    starts = words.window_starts(width)
    return starts[over[starts]]


def _window_keys(words: Words, width: int, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros((0, 2), np.uint64)
    return np.stack([words.windows(width, 0)[starts], words.windows(width, 1)[starts]], 1)


def remove_repeated(docs: DataFrame, width: int = 35, carry: list[str] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text: each text without the words of windows that also start elsewhere.

    carry: other columns of docs to hand on, after these.
    """
    carry = [c for c in carry or [] if c != "doc_id"]
    if clash := {*carry} & {"n_words", "n_removed", "kept_text", "block"}:
        raise ValueError(f"cannot carry columns of these names: {sorted(clash)}")
    ship(docs.sparkSession)
    n = partitions(docs)
    blocks, buckets = 2 * n, n
    id_type = docs.schema["doc_id"].dataType.simpleString()
    dealt = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"), *(c for c in carry if c != "text"))
        .withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int"))
        .repartition(n, "block")
    )

    def anchors(t: pa.Table) -> pa.Table:
        release()
        parts = []
        for _, _, buf, offs in text_pieces(t.column("text")):
            words = Words(buf, offs)
            at, anchor = _at_cover(words, width)
            if len(at):
                parts.append(_twice(words.windows(anchor)[at].reshape(-1, 1)))
        return _send(parts, 1, t.column("block")[0].as_py(), buckets)

    def windows(t: pa.Table, back: pa.Table) -> pa.Table:
        if not t.num_rows or not back.num_rows:
            return _send([], 2, 0, buckets)
        shared, parts = np.sort(_known(back, 1)[:, 0]), []
        for _, _, buf, offs in text_pieces(t.column("text")):
            words = Words(buf, offs)
            starts = _candidates(words, width, shared)
            if len(starts):
                parts.append(_twice(_window_keys(words, width, starts)))
        return _send(parts, 2, t.column("block")[0].as_py(), buckets)

    def cut(t: pa.Table, back: pa.Table) -> pa.Table:
        release()
        repeated, counts, removed, kept = _known(back, 2), [], [], []
        repeated = repeated[np.argsort(repeated[:, 0], kind="stable")]
        for i, j, buf, offs in text_pieces(t.column("text")):
            words = Words(buf, offs)
            gone = np.zeros(len(words.starts), bool)
            starts = words.window_starts(width)
            if len(starts) and len(repeated):
                hit = _repeated(words, width, starts, repeated)
                gone[ranges(hit, np.full(len(hit), width))] = True
            total = np.r_[0, np.cumsum(gone)]
            away = total[words.first[1:]] - total[words.first[:-1]]
            counts.append(words.count)
            removed.append(away)
            raw = buf.tobytes()
            for k in range(j - i):
                own = raw[offs[k] : offs[k + 1]].split()
                if away[k]:
                    own = compress(own, ~gone[words.first[k] : words.first[k + 1]])
                kept.append(b" ".join(own))
        join = lambda x: pa.array(np.concatenate(x) if x else [], pa.int64())
        return pa.table({"doc_id": t.column("doc_id"), "n_words": join(counts), "n_removed": join(removed), "kept_text": pa.array(kept, pa.binary()).cast(pa.string())} | {c: t.column(c) for c in carry})

    def ask(sent: DataFrame, columns: int) -> DataFrame:
        return sent.repartition(n, "bucket").groupBy("bucket").applyInArrow(_match(columns), BACK).repartition(n, "block").groupBy("block")

    by_block = dealt.groupBy("block")
    shared = ask(by_block.applyInArrow(anchors, SENT), 1)
    repeated = ask(dealt.groupBy("block").cogroup(shared).applyInArrow(windows, SENT), 2)
    more = "".join(f", `{c}` {dealt.schema[c].dataType.simpleString()}" for c in carry)
    return dealt.groupBy("block").cogroup(repeated).applyInArrow(cut, f"doc_id {id_type}, n_words long, n_removed long, kept_text string{more}")
