"""Packing documents into token sequences: first-fit decreasing by a tournament tree, in randomised groups.

Documents become token ids and one end id, cut into whole sequences and a remainder. Whole pieces fill a sequence
each; all pieces are dealt by a hash of their row's number into groups of about `group_size` pieces, each group sorted
by falling length, and each piece put into the first bin with room. The tree holds the largest free room below each
node, so the first such bin is found in as many steps as the tree is high. Rows that repeat have numbers of their
own, so groups are of about equal size whatever the table's skew.

Bins that stay partly filled may be cut free of padding: a sequence whose length is a power of two needs none.

Defined results: null and empty texts are one piece of the end id; a null doc_id is kept as null and dealt like any
other; repeated rows are packed as often as they occur; an empty table gives no pieces. Other columns of documents are
not carried into pieces; those of pieces are, but for the two that packing gives.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import Chunks
from .shared import release, ship, text_pieces, worker_store
from .textops import ranges

#: Chunks that are asked for in one call of the library.
JOINED = 128
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long"


class Encoder:
    """Token ids by the tokenizers library; those of chunks are kept."""

    def __init__(self, path: str, bits: int = 20):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        special = [t.content.encode() for t in self.tok.get_added_tokens_decoder().values()]
        vocab = self.tok.get_vocab()
        self.size = np.zeros(max(vocab.values(), default=0) + 1, np.int64)  # bytes of each token: one character each
        self.size[list(vocab.values())] = list(map(len, vocab))
        self.joined = not any(b" " in x for x in special)
        self.chunks = Chunks(self._learn, self._each, special, np.dtype("<u4"), bits)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [e.ids for at in range(0, len(texts), 4096) for e in self.tok.encode_batch_fast(texts[at : at + 4096], add_special_tokens=False)]
        size = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", int(size.sum())), size

    def _each(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = ends.tolist()
        return self._encode([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip([0, *ends], ends)])

    def _learn(self, raw: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that begin with a space and a letter stay apart in one text, so many are asked for in one call; the
        tokens' bytes tell which are whose. Others are asked for one by one."""
        buf, begin = np.frombuffer(raw, np.uint8), np.r_[0, ends[:-1]]
        long = ends - begin
        apart = (long > 1) & (buf[begin] == 0x20) & (buf[np.minimum(begin + 1, len(buf) - 1)] > 0x20) & self.joined
        many, values = np.zeros(len(ends), np.int64), []
        join, rest = np.flatnonzero(apart), np.flatnonzero(~apart)
        if len(join):
            flat = buf[ranges(begin[join], long[join])].tobytes()
            cut = np.cumsum(long[join])
            last = cut[np.r_[np.arange(JOINED - 1, len(join) - 1, JOINED), len(join) - 1]]  # ends of the groups
            ids, _ = self._each(flat, last)
            at = np.cumsum(self.size[ids])
            place = np.searchsorted(at, cut)
            if at[-1] != len(flat) or (at[place] != cut).any():
                join, rest = join[:0], np.arange(len(ends))
            else:
                many[join] = np.diff(np.r_[-1, place])
                values.append(ids)
        if len(rest):
            ids, many[rest] = self._each(buf[ranges(begin[rest], long[rest])].tobytes(), np.cumsum(long[rest]))
            values.append(ids)
        # values come in the order of join, then rest: back into that of the chunks
        order = np.concatenate([join, rest])
        first = np.empty(len(ends), np.int64)
        first[order] = np.r_[0, np.cumsum(many[order])[:-1]]
        return np.concatenate(values)[ranges(first, many)], many

    def encode(self, buf: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, each followed by end_id; where each text's begin)."""
        return self.chunks.read(buf, offs, (end_id,))


def token_pieces(docs: DataFrame, path: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of each document's ids (with the end id): doc_id, start, length, ids, doc_tokens. Other columns are not carried."""
    ship(docs.sparkSession)

    def run(batches):
        encoder = worker_store(f"encoder:{path}", lambda: Encoder(path))
        for b in batches:
            for i, j, buf, offs in text_pieces(b.column("text")):
                ids, begin = encoder.encode(buf, offs, end_id)
                many = np.diff(begin)
                pieces = -(-many // size)
                doc = np.repeat(np.arange(j - i), pieces)
                start = size * ranges(np.zeros(j - i, np.int64), pieces)
                length = np.minimum(size, many[doc] - start)
                at = np.r_[0, 4 * np.cumsum(length)]  # pieces lie end to end, as the ids do
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])
                own = b.column("doc_id").slice(i, j - i).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([own, pa.array(start), pa.array(length), raw.cast(pa.binary()), pa.array(many[doc])], names=["doc_id", "start", "length", "ids", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item. The tournament tree's leaves are the free rooms of the bins, in order."""
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [size] * (2 * leaves)
    bins, offs = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, k = int(lengths[i]), 1
        while k < leaves:
            k *= 2
            if tree[k] < need:
                k += 1
        bins[i], offs[i] = k - leaves, size - tree[k]
        tree[k] -= need
        while k > 1:
            k //= 2
            best = max(tree[2 * k], tree[2 * k + 1])
            if tree[k] == best:
                break
            tree[k] = best
    return bins, offs


def pack(pieces: DataFrame, size: int = 2048, group_size: int = 4096, seed: int = 17) -> DataFrame:
    """Adds sequence_id and offset (replacing columns of these names); pieces needs length, other columns are carried along.

    Pieces are shuffled whole, so keep them narrow. Rows are dealt by their number, so pieces should be a table whose rows
    keep their order when they are read again: one that was read from files, written or checkpointed.
    """
    ship(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    groups = max(1, -(-pieces.count() // group_size))
    names, schema = pieces.columns, pieces.schema.add("sequence_id", "long").add("offset", "long")
    number = "group"
    while number in names:
        number = "_" + number
    own = [c for c in ("doc_id", "start", "length") if c in names]
    dealt = pieces.withColumn(number, F.pmod(F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), *own), F.lit(groups)))
    parts = max(int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")), groups // 64)

    def run(t: pa.Table) -> pa.Table:
        release()
        group = t.column(number)[0].as_py()
        t = t.sort_by([(c, "ascending") for c in ("length", *(c for c in own if c != "length"))])
        bins, offs = first_fit_decreasing(t.column("length").to_numpy(), size)
        return t.select(names).append_column("sequence_id", pa.array(bins * groups + group)).append_column("offset", pa.array(offs))

    return dealt.repartition(parts, number).groupBy(number).applyInArrow(run, schema)
