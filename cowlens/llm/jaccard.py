"""Exact Jaccard self-join of word shingle sets: size-banded tiles, bitmap bounds, sorted-array intersection.

1. Each text becomes its sorted distinct shingle hashes. Texts with equal sets are one node (a 64-bit digest of the
   set; below about 1e8 different sets a chance clash has odds under 1 in 3,000). The same pass counts all shingles
   of the corpus into a sketch of fixed size, which gives one global order, rarest first.
2. Sets of size s that reach the threshold t share a shingle among the first s - ceil(t s) + 1 of that order. Those
   prefixes are dealt into tiles, one for each shingle; common passages come last in the order and so make no tiles.
3. Within a tile only nodes whose sizes allow the threshold are compared. Rounds compare each node with a few centres
   of its size band and of the band below; pairs that are in one component by then need no more comparing. Once few
   pairs are left (or after the last round) all of them are compared, so a large group of near copies costs about
   as many comparisons as it has members, and yet no component is missed.
4. A pair must pass the bound of its hashed bitmaps (bits that differ are at least so many shingles that differ)
   before its arrays are intersected exactly.

Defined results: null, empty and blank texts have no shingles and are components of their own; texts with fewer
words than a shingle are one shingle. Repeated rows, also of one doc_id, each get a row. A component's id is its
least non-null doc_id; rows of null ids alone get null. Extra columns are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import cut, cut_counted, cut_rows, partitions, release, ship, text_pieces
from .textops import Words, mix, shingles

SKETCH_BITS, SLICE = 20, 4096
ENTRY = np.dtype([("h", "<u4"), ("size", "<u4"), ("node", "<i8")])
LABELLED = np.dtype([*ENTRY.descr, ("comp", "<i8")])
#: Centres of a tile's size band in a round, and rounds at most before all remaining pairs are compared.
CENTRES, ROUNDS = 8, 6
#: Buckets over which the tiles of one first node are spread at most.
SPREAD = 4
#: Bytes of tiles that one task takes in a round.
TILE_BYTES = 4 << 20
#: Node representatives and labels up to this number are sent to all executors (16 bytes each); beyond, they are shuffled.
BROADCAST_IDS = 500_000


def _sets(column, width: int):
    """(first row, hashes, begins, nodes) for runs of rows; a node is null where there are no shingles."""
    release()
    for i, _, buf, offs in text_pieces(column):
        h, begin = shingles(Words(buf, offs, lower=True), width)
        yield i, h, begin, _nodes(h, begin)


def _nodes(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Digest of each sorted set: two sums of mixed hashes and the size, mixed."""
    many = np.diff(begin)
    out = np.zeros(len(many), np.uint64)
    full = np.flatnonzero(many)
    if len(full):
        with np.errstate(over="ignore"):
            a = np.add.reduceat(mix(h, 21), begin[:-1][full])
            b = np.bitwise_xor.reduceat(mix(h, 22), begin[:-1][full])
            out[full] = mix(mix(a, 23) ^ (b * np.uint64(0x9E3779B97F4A7C15)) ^ many[full].astype(np.uint64), 24)
    return out.view(np.int64)


def _bits(size: int) -> int:
    return min(1 << 16, max(1 << 9, 1 << int(4 * size - 1).bit_length()))


def _bitmap(h: np.ndarray) -> bytes:
    m = _bits(len(h))
    flags = np.zeros(m, bool)
    flags[(mix(h, 31) >> np.uint64(64 - m.bit_length() + 1)).astype(np.int64)] = True
    return np.packbits(flags).tobytes()


def _differ(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ, after folding the longer one."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = np.packbits(np.unpackbits(a).reshape(-1, 2).any(1))
    while len(b) > len(a):
        b = np.packbits(np.unpackbits(b).reshape(-1, 2).any(1))
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _sketch_slices(total: np.ndarray) -> list[bytes]:
    return [zlib.compress(x.tobytes(), 1) for x in total.reshape(-1, SLICE)]


def describe(docs: DataFrame, width: int) -> DataFrame:
    """A row for each document (doc_id, n_shingles, node, bitmap), and rows of sketch counts (slice, counts)."""

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "n_shingles", "node", "bitmap", "slice", "counts"]
        for b in batches:
            sizes, nodes, maps = [], [], []
            for _, h, begin, node in _sets(b.column("text"), width):
                total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
                sizes += np.diff(begin).tolist()
                nodes += [int(x) if s else None for x, s in zip(node, np.diff(begin), strict=True)]
                maps += [_bitmap(h[begin[k] : begin[k + 1]]) if begin[k + 1] > begin[k] else None for k in range(len(begin) - 1)]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(maps, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if total.any():
            parts = _sketch_slices(total)
            n = len(parts)
            yield pa.RecordBatch.from_arrays([pa.nulls(n, id_arrow), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32()), pa.array(parts, pa.binary())], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema["doc_id"].dataType
    id_arrow = to_arrow_type(id_type)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type.simpleString()}, n_shingles long, node long, bitmap binary, slice int, counts binary")


def _order(described: DataFrame) -> np.ndarray:
    """Rank of each sketch cell by its count over the whole corpus: a table of fixed size."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for k, x in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(zlib.decompress(x), np.int64)
                total[k] = total[k] + x if k in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in total.values()], pa.binary())], names=["slice", "counts"])

    sums = described.where("slice is not null").select("slice", "counts").mapInArrow(add, "slice int, counts binary").repartition(16, "slice").mapInArrow(add, "slice int, counts binary")
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in sums.collect():  # 2**SKETCH_BITS counters, whatever the corpus
        counts[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    rank = np.empty(len(counts), np.int32)
    rank[np.argsort(counts, kind="stable")] = np.arange(len(counts), dtype=np.int32)
    return rank


def _unpack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), ENTRY)


def tiles(docs: DataFrame, rank, width: int, percent: int, parts: int) -> DataFrame:
    """(bucket, entries): prefix shingles that two nodes at least share, with those nodes and their sizes."""
    buckets = parts

    def send(batches):
        order_of = rank.value
        for b in batches:
            for _, h, begin, node in _sets(b.column("text"), width):
                if not len(h):
                    continue
                many = np.diff(begin)
                owner = np.repeat(np.arange(len(many)), many)
                order = np.lexsort((h, order_of[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], owner))
                prefix = many - -(-percent * many // 100) + 1
                place = np.arange(len(h)) - np.repeat(begin[:-1], many)
                at = place < np.repeat(prefix, many)
                h, owner = h[order][at], owner[at]
                out = np.empty(len(h), ENTRY)
                out["h"], out["size"], out["node"] = h & np.uint64(0xFFFFFFFF), many[owner], node[owner]
                to = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                out, to = out[order], to[order]
                who, first = np.unique(to, return_index=True)
                yield pa.RecordBatch.from_arrays([pa.array(who, pa.int32()), pa.array([x.tobytes() for x in np.split(out, first[1:])], pa.binary())], names=["bucket", "entries"])

    def split(e: np.ndarray, to: np.ndarray) -> pa.Table:
        order = np.argsort(to, kind="stable")
        e, to = e[order], to[order]
        who, first = np.unique(to, return_index=True)
        parts = [x.tobytes() for x in np.split(e, first[1:])] if len(who) else []
        return pa.table({"bucket": pa.array(who, pa.int32()), "entries": pa.array(parts, pa.binary())})

    def match(t: pa.Table) -> pa.Table:
        e = _unpack(t.column("entries").to_pylist())
        e = e[np.lexsort((e["node"], mix(e["node"].view(np.uint64), 0), e["h"]))]
        new = np.ones(len(e), bool)
        new[1:] = (e["h"][1:] != e["h"][:-1]) | (e["node"][1:] != e["node"][:-1])
        e = e[new]
        same = e["h"][1:] == e["h"][:-1]
        e = e[np.r_[same, False] | np.r_[False, same]]
        if not len(e):
            return split(e, np.zeros(0, np.int64))
        # tiles that share nodes mostly share their first node: dealt by it, a pair is met in few buckets instead of many
        begin = _bounds(e)
        many = np.diff(begin)
        key = np.repeat(e["node"][begin[:-1]].view(np.uint64), many) ^ (e["h"] % np.uint32(SPREAD)).astype(np.uint64)
        return split(e, (mix(key, 51) % np.uint64(buckets)).astype(np.int64))

    def gather(t: pa.Table) -> pa.Table:
        e = _unpack(t.column("entries").to_pylist())
        return pa.table({"bucket": t.column("bucket")[:1].cast(pa.int32()), "entries": pa.array([e[np.lexsort((e["node"], e["h"]))].tobytes()], pa.binary())})

    sent = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(send, "bucket int, entries binary")
    found = sent.repartition(parts, "bucket").groupBy("bucket").applyInArrow(match, "bucket int, entries binary")
    return found.repartition(parts, "bucket").groupBy("bucket").applyInArrow(gather, "bucket int, entries binary")


def _bounds(e: np.ndarray) -> np.ndarray:
    return np.r_[np.flatnonzero(np.r_[True, e["h"][1:] != e["h"][:-1]]), len(e)]


def _edges_table(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    pairs = np.unique(np.stack([lo, hi], 1), axis=0) if len(lo) else np.zeros((0, 2), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def with_centres(tiled: DataFrame, percent: int, seed: int) -> DataFrame:
    """Each node with the centres of its size band in the tile, and with those of the band below.

    Centres are the nodes of least mixed digest, so tiles that share nodes tend to agree on them. Pairs of one
    component, or of sizes that rule the threshold out, are left out.
    """

    def run(batches):
        for t in batches:
            kind = LABELLED if "pairs" in t.schema.names else ENTRY
            for blob in t.column("entries").to_pylist():
                e = np.frombuffer(blob, kind)
                if not len(e):
                    continue
                many = np.diff(_bounds(e))
                band = np.floor(np.log(e["size"]) / np.log(100 / percent) + 1e-9).astype(np.int64)
                key = np.repeat(np.arange(len(many)), many) * 1024 + band + 1
                order = np.lexsort((mix(e["node"].view(np.uint64), seed), key))
                e, key = e[order], key[order]
                size, node, comp = e["size"].astype(np.int64), e["node"], e["comp" if kind is LABELLED else "node"]
                groups, first = np.unique(key, return_index=True)
                last = np.r_[first[1:], len(key)]
                here, every = np.searchsorted(groups, key), np.arange(len(key))
                prior = np.maximum(here - 1, 0)
                prior = np.where(groups[prior] == key - 1, prior, -1)
                left, right = [], []
                for c in range(CENTRES):
                    for group in (here, prior):
                        centre = first[group] + c
                        ok = (group >= 0) & (centre < last[group])
                        a, b = centre[ok], every[ok]
                        lo, hi = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                        ok = (comp[a] != comp[b]) & (100 * lo >= percent * hi)
                        left.append(node[a[ok]])
                        right.append(node[b[ok]])
                yield _edges_table(np.concatenate(left), np.concatenate(right))

    return tiled.mapInArrow(run, "a long, b long").distinct()


def mixed(tiled: DataFrame, labels: DataFrame, small: bool) -> DataFrame:
    """(bucket, pairs, entries): tiles whose nodes are in several components, and how many pairs those make.

    Small labels are sent to the tiles, whose entries stay where they are; else both are shuffled.
    """

    def unpack(batches):
        for t in batches:
            for k, blob in zip(t.column("bucket").to_pylist(), t.column("entries").to_pylist(), strict=True):
                e = np.frombuffer(blob, ENTRY)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(e), k), pa.int32()), pa.array(e["h"].astype(np.int64)), pa.array(e["size"].astype(np.int64)), pa.array(e["node"])], names=["bucket", "h", "size", "node"])

    def run(t: pa.Table) -> pa.Table:
        e = np.empty(t.num_rows, LABELLED)
        for c in LABELLED.names:
            e[c] = t.column(c).to_numpy()
        e = e[np.lexsort((e["node"], e["size"], e["comp"], e["h"]))]
        begin = _bounds(e)
        several = np.minimum.reduceat(e["comp"], begin[:-1]) != np.maximum.reduceat(e["comp"], begin[:-1])
        e = e[np.repeat(several, np.diff(begin))]
        if not len(e):
            return pa.table({"bucket": pa.array([], pa.int32()), "pairs": pa.array([], pa.int64()), "entries": pa.array([], pa.binary())})
        many = np.diff(_bounds(e))
        own = np.diff(np.r_[np.flatnonzero(np.r_[True, (e["h"][1:] != e["h"][:-1]) | (e["comp"][1:] != e["comp"][:-1])]), len(e)])
        pairs = int((many * many).sum() - (own * own).sum()) // 2
        return pa.table({"bucket": t.column("bucket")[:1].cast(pa.int32()), "pairs": pa.array([pairs], pa.int64()), "entries": pa.array([e.tobytes()], pa.binary())})

    def runs(batches):  # a bucket's rows come one after the other, as unpack gave them
        held: list[pa.RecordBatch] = []
        for b in batches:
            k = b.column("bucket").to_numpy()
            cut_at = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for x, y in zip(cut_at[:-1], cut_at[1:], strict=True):
                if held and y > x and held[0].column("bucket")[0].as_py() != int(k[x]):
                    yield from run(pa.Table.from_batches(held)).to_batches()
                    held = []
                if y > x:
                    held.append(b.slice(x, y - x))
        if held:
            yield from run(pa.Table.from_batches(held)).to_batches()

    rows = tiled.mapInArrow(unpack, "bucket int, h long, size long, node long")
    rows = rows.join(F.broadcast(labels) if small else labels, "node", "left").select("bucket", "h", "size", "node", F.coalesce("component", "node").alias("comp"))
    schema = "bucket int, pairs long, entries binary"
    return rows.mapInArrow(runs, schema) if small else rows.groupBy("bucket").applyInArrow(run, schema)


def all_pairs(several: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """All pairs of a tile whose nodes are in different components, and whose sizes and bitmaps allow the threshold.

    A bucket's nodes bring their bitmaps once; each pair is bounded once a bucket, however many tiles it shares.
    """

    def members(batches):
        for t in batches:
            for k, blob in zip(t.column("bucket").to_pylist(), t.column("entries").to_pylist(), strict=True):
                own = np.unique(np.frombuffer(blob, LABELLED)["node"])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), k), pa.int32()), pa.array(own)], names=["bucket", "node"])

    def run(t: pa.Table, m: pa.Table) -> pa.Table:
        names = m.column("node").to_numpy()
        order = np.argsort(names)
        names, maps = names[order], m.column("bitmap").take(pa.array(order)).to_pylist()
        bits = np.array([len(x) for x in maps])
        rows = {w: np.stack([np.frombuffer(maps[i], np.uint64) for i in np.flatnonzero(bits == w)]) for w in np.unique(bits)}
        halved = {w: np.packbits(np.unpackbits(x.view(np.uint8), axis=1).reshape(len(x), -1, 2).any(2), axis=1).view(np.uint64) for w, x in rows.items() if w // 2 in rows}
        row_of = np.zeros(len(maps), np.int64)
        for w in rows:
            row_of[bits == w] = np.arange((bits == w).sum())
        size_of = np.zeros(len(names), np.int64)
        kept = []

        def bound(pairs: np.ndarray) -> np.ndarray:
            i, j = pairs >> 32, pairs & 0xFFFFFFFF
            differ = np.zeros(len(pairs), np.int64)
            for w in rows:
                same = np.flatnonzero((bits[i] == w) & (bits[j] == w))
                for at in range(0, len(same), 8192):
                    k = same[at : at + 8192]
                    differ[k] = np.bitwise_count(rows[w][row_of[i[k]]] ^ rows[w][row_of[j[k]]]).sum(1)
                # sizes that allow the threshold differ by one doubling of the bitmap at most
                for big, small in ((i, j), (j, i)):
                    other = np.flatnonzero((bits[big] == w) & (bits[small] * 2 == w))
                    for at in range(0, len(other), 8192):
                        k = other[at : at + 8192]
                        differ[k] = np.bitwise_count(halved[w][row_of[big[k]]] ^ rows[w // 2][row_of[small[k]]]).sum(1)
            n = size_of[i] + size_of[j]
            most = np.minimum((n - differ) // 2, np.minimum(size_of[i], size_of[j]))
            return pairs[100 * most >= percent * (n - most)]

        waiting, many = [], 0
        for blob in t.column("entries").to_pylist():
            e = np.frombuffer(blob, LABELLED)
            e = e[np.lexsort((e["node"], e["size"], e["h"]))]
            at_node = np.searchsorted(names, e["node"])
            size_of[at_node] = e["size"]
            begin = _bounds(e)
            for x, y in zip(begin[:-1], begin[1:], strict=True):
                s, c, n = e["size"][x:y].astype(np.int64), e["comp"][x:y], at_node[x:y]
                top = np.searchsorted(s, s * 100 // percent, "right")
                for k in range(len(s)):
                    far = n[k + 1 : top[k]][c[k + 1 : top[k]] != c[k]]
                    if len(far):
                        waiting.append(np.minimum(far, n[k]) << 32 | np.maximum(far, n[k]))
                        many += len(far)
                if many > 4_000_000:
                    kept.append(bound(np.unique(np.concatenate(waiting))))
                    waiting, many = [], 0
        if waiting:
            kept.append(bound(np.unique(np.concatenate(waiting))))
        pairs = np.unique(np.concatenate(kept)) if kept else np.zeros(0, np.int64)
        return pa.Table.from_batches([_edges_table(names[pairs >> 32], names[pairs & 0xFFFFFFFF])])

    own = several.mapInArrow(members, "bucket int, node long").join(nodes.select("node", "bitmap"), "node")
    return several.groupBy("bucket").cogroup(own.groupBy("bucket")).applyInArrow(run, "a long, b long").distinct()


def verify(docs: DataFrame, edges: DataFrame, nodes: DataFrame, width: int, percent: int, many: int) -> tuple[DataFrame, int]:
    """Edges that reach the threshold, and how many: bound by bitmaps, then by intersection of the sorted arrays.

    many: number of the edges; stages of few rows get few tasks.
    """
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("rep").alias(f"rep_{k}"), F.col("n_shingles").alias(f"n_{k}"), F.col("bitmap").alias(f"map_{k}"))

    def bound(batches):
        for t in batches:
            na, nb = t.column("n_a").to_numpy(), t.column("n_b").to_numpy()
            differ = np.array([_differ(x, y) for x, y in zip(t.column("map_a").to_pylist(), t.column("map_b").to_pylist(), strict=True)], np.int64)
            most = np.minimum((na + nb - differ) // 2, np.minimum(na, nb))  # of the intersection
            ok = 100 * most >= percent * (na + nb - most)
            yield t.filter(pa.array(ok)).select(["a", "b", "rep_a", "rep_b"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    both = edges.join(side("a"), "a").join(side("b"), "b").coalesce(max(1, many // 5_000))
    near, left = cut_counted(both.mapInArrow(bound, f"a long, b long, rep_a {id_type}, rep_b {id_type}"))
    wanted = near.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("rep_a").alias("doc_id")), F.struct(F.col("b").alias("node"), F.col("rep_b").alias("doc_id")))).alias("x")).select("x.*").distinct()
    reps, sets_many = wanted.select("doc_id").distinct(), wanted.count()
    if sets_many <= BROADCAST_IDS:
        reps = F.broadcast(reps)

    def arrays(batches):
        for t in batches:
            for _, h, begin, node in _sets(t.column("text"), width):
                full = np.flatnonzero(np.diff(begin))
                yield pa.RecordBatch.from_arrays([pa.array(node[full]), pa.array([h[begin[k] : begin[k + 1]].tobytes() for k in full], pa.binary())], names=["node", "hashes"])

    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(reps, docs["doc_id"].eqNullSafe(reps["doc_id"]), "left_semi").select("text")
    sets = texts.mapInArrow(arrays, "node long, hashes binary").dropDuplicates(["node"])

    def exact(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column("x").to_pylist(), t.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(p) + len(q) - len(np.union1d(p, q))
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            yield t.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    pairs = near.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return cut_counted(pairs.coalesce(max(1, sets_many // 1_000, left // 10_000)).mapInArrow(exact, "a long, b long"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    n = partitions(docs)
    described = cut(describe(docs, width))
    rank = spark.sparkContext.broadcast(_order(described))
    rows = described.where("slice is null").select("doc_id", "n_shingles", "node", "bitmap")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n_shingles"), F.max("bitmap").alias("bitmap"))
    nodes = cut_rows(nodes, 20_000)
    tiled = cut(tiles(docs, rank, width, percent, n))
    members = tiled.agg(F.sum(F.length("entries"))).first()[0] or 0
    tiled = tiled.coalesce(max(1, members // TILE_BYTES))
    seen, many = cut_counted(with_centres(tiled, percent, 0))
    links, _ = verify(docs, seen, nodes, width, percent, many)
    labels, labelled = cut_counted(components(links))
    for k in range(1, ROUNDS + 1):
        several = cut(mixed(tiled, labels, labelled <= BROADCAST_IDS))
        pairs = several.agg(F.sum("pairs")).first()[0] or 0
        if not pairs:
            break
        final = k == ROUNDS or pairs * ENTRY.itemsize <= 4 * members  # few pairs for the memberships there are
        edges, many = cut_counted((all_pairs(several, nodes, percent) if final else with_centres(several, percent, k)).join(seen, ["a", "b"], "left_anti"))
        found, new = verify(docs, edges, nodes, width, percent, many)
        if new:
            links = links.unionByName(found)
            labels, labelled = cut_counted(components(links))
        if final:
            break
        seen = seen.unionByName(edges)
    named = nodes.join(labels, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("root"))
    ids = named.groupBy("root").agg(F.min("rep").alias("least"))
    final = named.join(ids, "root").select("node", "least")
    return rows.drop("bitmap").join(final, "node", "left").select("doc_id", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))
