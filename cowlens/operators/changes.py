"""Changes of an image in place: few structures are written by the driver, counts and flags by patches of all workers.

A change rewrites the structure that it is about (a header field, a level-1 table, the snapshot table, a directory),
appends what needs room at the end of the file, and then `recount` brings all reference counts and COPIED flags to what
the structures say, so no operation keeps books of its own. Data clusters are not moved.

The driver holds tables of one image whose size is that of its level-1 table (8 bytes for 512 MiB of guest at clusters of
64 KiB), never level-2 tables, counts or data.
"""

from __future__ import annotations

import os
import struct
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import image as im
from ..sources.build import COPIED

PATCH = "image_id string, offset long, bytes binary"
#: Header fields: place and bytes.
FIELDS = {
    "version": (4, 4), "backing_offset": (8, 8), "backing_size": (16, 4), "bits": (20, 4), "virtual_size": (24, 8), "crypt": (32, 4), "l1_entries": (36, 4), "l1_offset": (40, 8),
    "table_offset": (48, 8), "table_clusters": (56, 4), "snapshots": (60, 4), "snapshots_offset": (64, 8), "incompatible": (72, 8), "autoclear": (88, 8), "order": (96, 4), "length": (100, 4),
}
INCOMPATIBLE_DIRTY, INCOMPATIBLE_DATA_FILE, INCOMPATIBLE_EXTENDED = 1, 4, 16
AUTOCLEAR_BITMAPS = 1


class Editor:
    """One image, opened for changes by the driver."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            if f.read(4) != b"QFI\xfb":
                raise ValueError(f"{path}: no image")
        self.size = 1 << self.get("bits")
        self.order = self.get("order") if self.get("version") >= 3 else 4
        self.extended = bool(self.get("version") >= 3 and self.get("incompatible") & INCOMPATIBLE_EXTENDED)
        self.per_l2 = self.size // (16 if self.extended else 8)

    def read(self, offset: int, n: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(offset)
            return f.read(n).ljust(n, b"\0")

    def write(self, offset: int, data: bytes) -> None:
        with open(self.path, "r+b") as f:
            f.seek(offset)
            f.write(data)
            f.flush()
            os.fsync(f.fileno())

    def get(self, field: str) -> int:
        at, n = FIELDS[field]
        return int.from_bytes(self.read(at, n), "big")

    def set(self, **fields: int) -> None:
        """Header fields; one write, of the header's first 112 bytes."""
        raw = bytearray(self.read(0, 112))
        for name, value in fields.items():
            at, n = FIELDS[name]
            raw[at : at + n] = value.to_bytes(n, "big")
        self.write(0, bytes(raw))

    def append(self, data: bytes) -> int:
        """New clusters at the end of the file; where they begin."""
        at = -(-os.path.getsize(self.path) // self.size) * self.size
        self.write(at, data.ljust(max(1, -(-len(data) // self.size)) * self.size, b"\0"))
        return at

    def words(self, offset: int, n: int) -> np.ndarray:
        return np.frombuffer(self.read(offset, 8 * n), ">u8").astype(np.uint64)

    def extensions(self) -> list[tuple[int, bytes]]:
        raw, out = self.read(0, self.size), []
        at = self.get("length") if self.get("version") >= 3 else 72
        while at + 8 <= len(raw):
            kind, n = struct.unpack(">II", raw[at : at + 8])
            if kind == 0 or at + 8 + n > len(raw):
                break
            out.append((kind, raw[at + 8 : at + 8 + n]))
            at += 8 + -(-n // 8) * 8
        return out

    def backing(self) -> str | None:
        return self.read(self.get("backing_offset"), self.get("backing_size")).decode() if self.get("backing_offset") else None

    def rewrite_header(self, extensions: list[tuple[int, bytes]], backing: str | None) -> None:
        """The first cluster with these extensions and backing name."""
        at = self.get("length") if self.get("version") >= 3 else 72
        raw = bytearray(self.read(0, at))
        for kind, data in [*extensions, (0, b"")]:
            raw += struct.pack(">II", kind, len(data)) + data.ljust(-(-len(data) // 8) * 8, b"\0")
        name = (backing or "").encode()
        if len(name) > 1023 or len(raw) + len(name) > self.size:
            raise ValueError("header, extensions and backing name do not fit into the first cluster")
        raw[8:20] = struct.pack(">QI", len(raw) if name else 0, len(name))
        self.write(0, bytes(raw + name).ljust(self.size, b"\0"))

    def mark_dirty(self, on: bool) -> None:
        """The flag that counts can't be trusted: set before they change, taken away once they are right. Version 2 has none."""
        if self.get("version") >= 3:
            flags = self.get("incompatible")
            self.set(incompatible=flags | INCOMPATIBLE_DIRTY if on else flags & ~INCOMPATIBLE_DIRTY)

    def cover(self) -> None:
        """Reference blocks for every cluster of the file, and a larger reference table where it has no room for them."""
        per = self.size * 8 >> self.order
        while True:
            total = -(-os.path.getsize(self.path) // self.size)
            offset, room = self.get("table_offset"), self.get("table_clusters") * (self.size // 8)
            need = -(-total // per)
            if need > room:
                clusters = max(2 * self.get("table_clusters"), -(-need * 8 // self.size))
                at = self.append(self.read(offset, room * 8).ljust(clusters * self.size, b"\0"))
                self.set(table_offset=at, table_clusters=clusters)
                continue
            table = self.words(offset, need)
            missing = np.flatnonzero(table == 0)
            if not len(missing):
                return
            for k in missing.tolist():
                self.write(offset + 8 * k, self.append(bytes(self.size)).to_bytes(8, "big"))


def apply_patches(patches: DataFrame) -> int:
    """Positioned writes of (image_id, offset, bytes); how many. Tasks that run again write the same bytes."""

    def put(batches):
        n = 0
        for b in batches:
            for path, at, data in zip(*(b.column(c).to_pylist() for c in ("image_id", "offset", "bytes")), strict=True):
                with open(path, "r+b") as f:
                    f.seek(at)
                    f.write(data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    done = patches.repartition("image_id", F.shiftright("offset", 26)).mapInArrow(put, "n long")
    return done.agg(F.sum("n")).first()[0] or 0


def _turned(rows: DataFrame, files: im.Files, change) -> DataFrame:
    """Patches of whole clusters. rows: image_id, cluster_idx, index, value; change(bytes, indices, values) gives new bytes."""
    grouped = rows.groupBy("image_id", "cluster_idx").agg(F.sort_array(F.collect_set(F.struct("index", "value"))).alias("at"))
    size = 1 << files.cluster_bits

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                raw, at = b.column("bytes")[k].as_py(), b.column("at")[k].as_py()
                if raw is None:
                    continue
                new = change(raw, np.array([x["index"] for x in at], np.int64), np.array([x["value"] for x in at], object))
                if new != raw:
                    yield pa.RecordBatch.from_arrays([b.column("image_id").slice(k, 1), pa.array([b.column("cluster_idx")[k].as_py() * size], pa.int64()), pa.array([new], pa.binary())], names=["image_id", "offset", "bytes"])

    return im.fetch(grouped, files).mapInArrow(run, PATCH)


def differing(stored: DataFrame, expected: DataFrame) -> DataFrame:
    """image_id, cluster_idx, stored, expected of every count that is wrong, whether a block covers the cluster or not."""
    x = stored.withColumn("stored", F.col("stored").cast("decimal(20,0)")).join(expected, ["image_id", "cluster_idx"], "full")
    return x.select("image_id", "cluster_idx", F.coalesce("stored", F.lit(0)).alias("stored"), F.coalesce("expected", F.lit(0)).alias("expected")).where("stored <> expected")


def recount(spark: SparkSession, path: str, leaks_only: bool = False) -> dict[str, int]:
    """Repairs counts (only those too high, if asked), then COPIED flags; how many of each differed.

    Flags are those of the counts as they are expected; with leaks_only they are left alone.
    """
    e = Editor(path)
    e.mark_dirty(True)
    if not leaks_only:
        e.cover()
    bits = e.get("bits")
    files = im.Files(spark, [path], bits)
    head = im.header(files)
    tables = tuple(t.persist() for t in im.all_tables(head, files, bits, e.extended))
    expected = im.expected_refcounts(head, files, bits, e.extended, tables).persist()
    wrong = differing(im.stored_refcounts(head, files, bits, e.order), expected)
    wrong = (wrong.where("stored > expected") if leaks_only else wrong).persist()
    per = e.size * 8 >> e.order
    most = (1 << (1 << e.order)) - 1
    if not wrong.where(F.col("expected") > F.lit(most).cast("decimal(20,0)")).isEmpty():
        raise ValueError(f"a count does not fit into {1 << e.order} bits")
    blocks = im.refcount_blocks(head, files, bits).select("image_id", "block", F.shiftright("offset", bits).alias("block_cluster"))
    rows = wrong.select("image_id", F.expr(f"cluster_idx div {per}").alias("block"), (F.col("cluster_idx") % per).alias("index"), F.col("expected").cast("decimal(20,0)").alias("value")).join(blocks, ["image_id", "block"])
    order = e.order

    def counts(raw: bytes, at: np.ndarray, values: np.ndarray) -> bytes:
        x = im.counts_of(raw, order).astype(np.uint64)
        x[at] = [int(v) for v in values]
        return im.counts_to(x, order)

    found = wrong.agg(F.count_if(F.col("stored") > F.col("expected")).alias("leaks"), F.count_if(F.col("stored") < F.col("expected")).alias("mismatches")).first().asDict()
    apply_patches(_turned(rows.select("image_id", F.col("block_cluster").alias("cluster_idx"), "index", "value"), files, counts))
    if not leaks_only:
        found["flags"] = _reflag(files, expected, tables, bits, e.extended)
    for t in (*tables, expected, wrong):
        t.unpersist()
    e.mark_dirty(False)
    return found


def wrong_flags(expected: DataFrame, tables: tuple[DataFrame, DataFrame, DataFrame], bits: int, extended: bool) -> DataFrame:
    """Level-1 and level-2 entries (image_id, place, value) whose COPIED flag is not whether the count is one; place is the
    entry's offset in the file. Compressed entries never have the flag. tables: what all_tables gives."""
    roots, l1, l2 = tables
    width = 16 if extended else 8
    one = expected.select("image_id", "cluster_idx", (F.col("expected") == 1).alias("one"))
    up = l1.join(roots.select("image_id", "table_id", F.col("offset").alias("root")), ["image_id", "table_id"])
    up = up.select("image_id", (F.col("root") + F.col("l1_index") * 8).alias("place"), "copied", F.lit("table").alias("kind"), F.shiftright("l2_offset", bits).alias("cluster_idx"))
    low = l2.join(l1.select("image_id", "table_id", "l1_index", "l2_offset"), ["image_id", "table_id", "l1_index"])
    low = low.select("image_id", (F.col("l2_offset") + F.col("l2_index") * width).alias("place"), "copied", "kind", F.shiftright("host_offset", bits).alias("cluster_idx"))
    x = up.unionByName(low).join(one, ["image_id", "cluster_idx"]).withColumn("one", F.col("one") & (F.col("kind") != "compressed"))
    return x.where("copied <> one").select("image_id", "place", F.col("one").alias("value")).distinct()


def _reflag(files: im.Files, expected: DataFrame, tables: tuple, bits: int, extended: bool) -> int:
    rows = wrong_flags(expected, tables, bits, extended).persist()
    size = 1 << bits

    def flags(raw: bytes, at: np.ndarray, values: np.ndarray) -> bytes:
        w = np.frombuffer(raw, ">u8").astype(np.uint64)
        on = values.astype(bool)
        w[at[on]] |= np.uint64(COPIED)
        w[at[~on]] &= ~np.uint64(COPIED)
        return w.astype(">u8").tobytes()

    n = rows.count()
    if n:
        apply_patches(_turned(rows.select("image_id", F.shiftright("place", bits).alias("cluster_idx"), F.expr(f"(place % {size}) div 8").alias("index"), "value"), files, flags))
    rows.unpersist()
    return n


# snapshots


def _records(e: Editor) -> list[dict]:
    at, out = e.get("snapshots_offset"), []
    for _ in range(e.get("snapshots")):
        raw = e.read(at, 40)
        l1, n, id_size, name_size = struct.unpack(">QIHH", raw[:16])
        extra = int.from_bytes(raw[36:40], "big")
        body = e.read(at + 40, extra + id_size + name_size)
        out.append({"l1": l1, "entries": n, "head": raw, "extra": body[:extra], "id": body[extra : extra + id_size].decode(), "name": body[extra + id_size :].decode()})
        at += -(-(40 + extra + id_size + name_size) // 8) * 8
    return out


def _write_records(e: Editor, records: list[dict]) -> None:
    raw = b""
    for r in records:
        one = struct.pack(">QIHH", r["l1"], r["entries"], len(r["id"].encode()), len(r["name"].encode())) + r["head"][16:36] + struct.pack(">I", len(r["extra"])) + r["extra"] + r["id"].encode() + r["name"].encode()
        raw += one.ljust(-(-len(one) // 8) * 8, b"\0")
    at = e.append(raw) if raw else 0
    e.set(snapshots=len(records), snapshots_offset=at)


def find(records: list[dict], key: str) -> dict:
    """By name first, then by id."""
    for field in ("name", "id"):
        for r in records:
            if r[field] == key:
                return r
    raise ValueError(f"no snapshot {key!r}")


def snapshot_create(spark: SparkSession, path: str, name: str, seconds: int | None = None) -> str:
    """A snapshot of the active table; its id. An empty or known name is an error."""
    e = Editor(path)
    records = _records(e)
    if not name or name in {r["name"] for r in records}:
        raise ValueError(f"no or known name: {name!r}")
    new = str(1 + max((int(r["id"]) for r in records if r["id"].isdigit()), default=0))
    n = e.get("l1_entries")
    table = e.words(e.get("l1_offset"), n) & ~np.uint64(COPIED)
    at = e.append(table.astype(">u8").tobytes())
    head = bytes(16) + struct.pack(">IIQI", int(time.time() if seconds is None else seconds), 0, 0, 0)
    records.append({"l1": at, "entries": n, "head": head.ljust(40, b"\0"), "extra": struct.pack(">QQ", 0, e.get("virtual_size")), "id": new, "name": name})
    _write_records(e, records)
    recount(spark, path)
    return new


def snapshot_delete(spark: SparkSession, path: str, key: str) -> None:
    e = Editor(path)
    records = _records(e)
    gone = find(records, key)
    _write_records(e, [r for r in records if r is not gone])
    recount(spark, path)


def snapshot_apply(spark: SparkSession, path: str, key: str) -> None:
    """The active table becomes a copy of the snapshot's, with its guest size; the snapshot stays."""
    e = Editor(path)
    r = find(_records(e), key)
    table = e.words(r["l1"], r["entries"]) & ~np.uint64(COPIED)
    at = e.append(table.astype(">u8").tobytes())
    size = int.from_bytes(r["extra"][8:16], "big") if len(r["extra"]) >= 16 else e.get("virtual_size")
    e.set(l1_offset=at, l1_entries=r["entries"], virtual_size=size)
    recount(spark, path)


# size and backing


def resize(spark: SparkSession, path: str, virtual_size: int) -> None:
    """Guest size. Growing makes the level-1 table longer where needed; shrinking is an error if there are snapshots or if
    anything is stored beyond the new end."""
    e = Editor(path)
    need = -(-virtual_size // (e.size * e.per_l2))
    have, old = e.get("l1_entries"), e.get("virtual_size")
    if virtual_size <= 0:
        raise ValueError("a size must be positive")
    if virtual_size < old:
        if e.get("snapshots"):
            raise ValueError("an image with snapshots cannot shrink")
        files = im.Files(spark, [path], e.get("bits"))
        l2 = im.l2_entries(im.l1_entries(im.active_tables(im.header(files)), files, e.get("bits")), files, e.get("bits"), extended=e.extended)
        if not l2.where(F.col("guest_cluster") >= -(-virtual_size // e.size)).where("kind <> 'zero'").isEmpty():
            raise ValueError("data lie beyond the new end")
    if need > have:
        table = np.zeros(need, np.uint64)
        table[:have] = e.words(e.get("l1_offset"), have)
        at = e.append(table.astype(">u8").tobytes())
        e.set(l1_offset=at, l1_entries=need, virtual_size=virtual_size)
        recount(spark, path)
    else:
        e.set(virtual_size=virtual_size)


def truncate_tail(spark: SparkSession, path: str) -> int:
    """Cuts free clusters off the end of the file; bytes saved."""
    e = Editor(path)
    files = im.Files(spark, [path], e.get("bits"))
    last = im.stored_refcounts(im.header(files), files, e.get("bits"), e.order).agg(F.max("cluster_idx")).first()[0]
    end = os.path.getsize(path)
    new = min(end, ((0 if last is None else last) + 1) * e.size)
    os.truncate(path, new)
    return end - new


def rebase(path: str, backing: str | None) -> None:
    """The backing name alone; the guest must read the same through the new one, or be flattened first."""
    e = Editor(path)
    e.rewrite_header(e.extensions(), backing)


# dirty bitmaps


def _directory(e: Editor) -> list[dict]:
    for kind, data in e.extensions():
        if kind == im.BITMAPS_EXTENSION and len(data) >= 24:
            n, _, size, offset = struct.unpack(">IIQQ", data[:24])
            raw, at, out = e.read(offset, size), 0, []
            for _ in range(n):
                table, entries, flags, type_, bits, name_size, extra = struct.unpack(">QIIBBHI", raw[at : at + 24])
                name = raw[at + 24 + extra : at + 24 + extra + name_size].decode()
                out.append({"table": table, "entries": entries, "flags": flags, "type": type_, "bits": bits, "extra": raw[at + 24 : at + 24 + extra], "name": name})
                at += -(-(24 + extra + name_size) // 8) * 8
            return out
    return []


def _write_directory(e: Editor, bitmaps: list[dict]) -> None:
    raw = b""
    for b in bitmaps:
        one = struct.pack(">QIIBBHI", b["table"], b["entries"], b["flags"], b["type"], b["bits"], len(b["name"].encode()), len(b["extra"])) + b["extra"] + b["name"].encode()
        raw += one.ljust(-(-len(one) // 8) * 8, b"\0")
    rest = [x for x in e.extensions() if x[0] != im.BITMAPS_EXTENSION]
    own = [(im.BITMAPS_EXTENSION, struct.pack(">IIQQ", len(bitmaps), 0, len(raw), e.append(raw)))] if bitmaps else []
    e.rewrite_header([*rest, *own], e.backing())
    flags = e.get("autoclear")
    e.set(autoclear=flags | AUTOCLEAR_BITMAPS if bitmaps else flags & ~AUTOCLEAR_BITMAPS)


def bitmap_create(spark: SparkSession, path: str, name: str, granularity_bits: int = 16, auto: bool = True) -> None:
    """An empty bitmap: names of 1 to 1023 bytes, once each; granularities of 2**9 to 2**31; 65535 bitmaps at most."""
    e = Editor(path)
    if e.get("version") < 3:
        raise ValueError("bitmaps need version 3")
    bitmaps = _directory(e)
    if not 1 <= len(name.encode()) <= 1023 or name in {b["name"] for b in bitmaps}:
        raise ValueError(f"no, long or known name: {name!r}")
    if not 9 <= granularity_bits <= 31 or len(bitmaps) >= 65_535:
        raise ValueError("granularity out of range, or too many bitmaps")
    granules = -(-e.get("virtual_size") // (1 << granularity_bits))
    entries = max(1, -(-granules // (8 * e.size)))
    bitmaps.append({"table": e.append(bytes(8 * entries)), "entries": entries, "flags": 2 if auto else 0, "type": 1, "bits": granularity_bits, "extra": b"", "name": name})
    _write_directory(e, bitmaps)
    recount(spark, path)


def bitmap_delete(spark: SparkSession, path: str, name: str) -> None:
    e = Editor(path)
    bitmaps = _directory(e)
    if name not in {b["name"] for b in bitmaps}:
        raise ValueError(f"no bitmap {name!r}")
    _write_directory(e, [b for b in bitmaps if b["name"] != name])
    recount(spark, path)


def bitmap_flag(path: str, name: str, auto: bool) -> None:
    """Whether writes are tracked by the bitmap."""
    e = Editor(path)
    bitmaps = _directory(e)
    if name not in {b["name"] for b in bitmaps}:
        raise ValueError(f"no bitmap {name!r}")
    data = dict(e.extensions())[im.BITMAPS_EXTENSION]
    at = int.from_bytes(data[16:24], "big")
    for b in bitmaps:
        if b["name"] == name:
            e.write(at + 12, (b["flags"] & ~2 | 2 * auto).to_bytes(4, "big"))
        at += -(-(24 + len(b["extra"]) + len(b["name"].encode())) // 8) * 8
