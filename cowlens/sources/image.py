"""Image files as DataFrames: clusters, header, extensions, address tables, reference counts, snapshots, guest bytes.

Metadata and bytes are apart. Rows that say which cluster they want are what is shuffled; `fetch` reads those clusters, by
ranged reads of the files (`Files`) where they are decoded, so no exchange carries bytes. Small files in a store that only
Spark reads come as rows of clusters instead (`clusters`), and are joined.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType, StructField, StructType

from ..functions import bits
from ..functions.codecs import inflate
from ..shipping import ship

CLUSTERS = "image_id string, cluster_idx bigint, bytes binary"
#: Bytes that one task of the ranged reader takes.
SPLIT = 64 << 20


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _ImageReader(DataSourceReader):
    """Ranged reads, so that no row or task holds a whole file."""

    def __init__(self, options: dict):
        self.paths = options["path"].split(",")
        self.size = 1 << int(options.get("clusterbits", 16))
        self.first, self.last = int(options.get("firstcluster", 0)), int(options.get("lastcluster", 1 << 62))

    def partitions(self):
        step, out = max(1, SPLIT // self.size), []
        for p in self.paths:
            end = min(-(-os.path.getsize(p) // self.size), self.last + 1)
            out += [_Range(p, k, min(k + step, end)) for k in range(self.first, end, step)]
        return out

    def read(self, partition):
        with open(partition.path, "rb") as f:
            f.seek(partition.first * self.size)
            for k in range(partition.first, partition.last, 64):
                rows = []
                for c in range(k, min(k + 64, partition.last)):
                    data = f.read(self.size)
                    if data:
                        rows.append((partition.path, c, data.ljust(self.size, b"\0")))
                if rows:
                    a, b, c = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["image_id", "cluster_idx", "bytes"])


class ImageSource(DataSource):
    """spark.read.format("cowlens_image").option("path", ...).option("clusterbits", ...): files on a file system that all workers mount."""

    @classmethod
    def name(cls) -> str:
        return "cowlens_image"

    def schema(self) -> str:
        return CLUSTERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _ImageReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ImageSource)


def _pread(handles: dict, path: str, at: int, size: int) -> bytes:
    """Bytes of a file, fewer at its end, none beyond; handles keeps one file open."""
    if path not in handles:
        for f in handles.values():
            f.close()
        handles.clear()
        handles[path] = open(path, "rb")  # noqa: SIM115  closed when the next one is opened, or with the worker's task
    f = handles[path]
    f.seek(at)
    return f.read(size)


class Files:
    """Clusters of image files on a file system that all workers mount; an image's id is its path. Nothing is read here."""

    def __init__(self, spark: SparkSession, paths: list[str], cluster_bits: int):
        ship(spark)
        self.spark, self.paths, self.cluster_bits = spark, paths, cluster_bits
        #: Goes into every plan over this object, so that Spark never takes what it cached of an earlier state of the files.
        self.token = uuid.uuid4().hex

    def with_bits(self, cluster_bits: int) -> Files:
        return Files(self.spark, self.paths, cluster_bits)

    def first(self) -> DataFrame:
        """The first cluster of each file."""
        if len(self.paths) > 64:
            want = self.spark.createDataFrame([(p, 0) for p in self.paths], "image_id string, cluster_idx bigint")
        else:
            want = self.spark.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, self.paths))).alias("image_id"), F.lit(0).cast("long").alias("cluster_idx"))
        return fetch(want, self, spread=len(self.paths) > 64)

    def all(self) -> DataFrame:
        """Every cluster with its bytes, by ranged reads."""
        register(self.spark)
        return self.spark.read.format("cowlens_image").option("path", ",".join(self.paths)).option("clusterbits", str(self.cluster_bits)).load()

    def lengths(self) -> DataFrame:
        """image_id, length: sizes of the files."""
        return self.spark.createDataFrame([(p, os.path.getsize(p)) for p in self.paths], "image_id string, length bigint")


Clusters = DataFrame | Files


def _first(cluster: Clusters) -> DataFrame:
    return cluster.first() if isinstance(cluster, Files) else cluster.where("cluster_idx = 0")


def _spread(want: DataFrame) -> DataFrame:
    """Wanted clusters dealt by runs of neighbours, since one table's rows may all come of one row."""
    return want.repartition("image_id", F.shiftright("cluster_idx", 6)).sortWithinPartitions("image_id", "cluster_idx")


def fetch(want: DataFrame, cluster: Clusters, spread: bool = True, then: Callable | None = None, schema: str | StructType | None = None) -> DataFrame:
    """want (image_id, cluster_idx, others) with bytes, a whole cluster each; null beyond the end of the file or without a
    cluster_idx. spread: deal the wanted clusters to all workers first. then: turns batches into those of the schema in the
    worker that has read them, 64 clusters at a time."""
    if not isinstance(cluster, Files):
        got = want.join(cluster, ["image_id", "cluster_idx"], "left")
        return got if then is None else got.mapInArrow(then, schema)
    size, names, token = 1 << cluster.cluster_bits, want.columns, cluster.token

    def run(batches):
        handles: dict = {}
        assert token
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                raw = [_pread(handles, p, c * size, size) if c is not None and c >= 0 else b"" for p, c in zip(part.column("image_id").to_pylist(), part.column("cluster_idx").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.ljust(size, b"\0") if x else None for x in raw], pa.binary())], names=[*names, "bytes"])

    do, out = (run, StructType([*want.schema.fields, StructField("bytes", BinaryType())])) if then is None else (lambda batches: then(run(batches)), schema)
    return (_spread(want) if spread else want).mapInArrow(do, out)


def clusters(spark: SparkSession, path: str, cluster_bits: int, pattern: str | None = None) -> DataFrame:
    """host_cluster of small files in any store that Spark reads (one file is one row before it is cut)."""
    reader = spark.read.format("binaryFile")
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    size = 1 << cluster_bits
    n = F.ceil(F.col("length") / size)
    cut = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    x = files.where("length > 0").select(F.col("path").alias("image_id"), "content", cut.alias("cluster_idx"))
    raw = F.substring("content", (F.col("cluster_idx") * size + 1).cast("int"), F.lit(size))
    return x.select("image_id", "cluster_idx", F.rpad(raw, size, F.lit(b"\0")).alias("bytes"))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """Files in a folder (mounted by all workers) that start with the magic, with their sizes. Four bytes of each are read."""
    ship(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "length")  # contents are not read

    def run(batches):
        from urllib.parse import unquote, urlparse

        for b in batches:
            names = [unquote(urlparse(p).path) if p.startswith("file:") else p for p in b.column("path").to_pylist()]
            yield b.filter(pa.array([_pread({}, p, 0, 4) == b"QFI\xfb" for p in names], pa.bool_()))

    return files.mapInArrow(run, files.schema)


def header(cluster: Clusters) -> DataFrame:
    """Header fields of each image; version 2 gets the defaults of version 3's fields."""
    cluster = _first(cluster)
    b = F.col("bytes")
    u = lambda at, width=4: bits.big_endian(b, at, width)
    wide = lambda at: bits.masked(*bits.halves(b, at), 0, 62)
    v3 = F.col("version") >= 3
    x = cluster.where(F.hex(F.substring("bytes", 1, 4)) == "514649FB").withColumn("version", u(4))
    return x.select(
        "image_id", F.col("version").cast("int").alias("version"), wide(8).alias("backing_file_offset"), u(16).alias("backing_file_size"), u(20).cast("int").alias("cluster_bits"),
        wide(24).alias("virtual_size"), u(32).cast("int").alias("crypt_method"), u(36).alias("l1_entries"), wide(40).alias("l1_offset"), wide(48).alias("refcount_table_offset"),
        u(56).alias("refcount_table_clusters"), u(60).alias("snapshot_count"), wide(64).alias("snapshots_offset"),
        *(F.when(v3, bits.unsigned(*bits.halves(b, at))).otherwise(F.lit(0).cast("decimal(20,0)")).alias(name) for at, name in ((72, "incompatible"), (80, "compatible"), (88, "autoclear"))),
        F.when(v3, u(96)).otherwise(4).cast("int").alias("refcount_order"), F.when(v3, u(100)).otherwise(72).alias("header_length"),
        F.when(v3 & (u(100) > 104), u(104, 1)).otherwise(0).cast("int").alias("compression_type"),
        F.when(wide(8) > 0, F.decode(F.substring(b, (wide(8) + 1).cast("int"), u(16).cast("int")), "UTF-8")).alias("backing_file"),
    )


def extensions(cluster: Clusters) -> DataFrame:
    """Header extensions in order: image_id, pos, type_id, data. Ends at type 0 or where the data does."""

    def run(batches):
        for t in batches:
            rows = []
            for image, raw in zip(t.column("image_id").to_pylist(), t.column("bytes").to_pylist(), strict=True):
                version = int.from_bytes(raw[4:8], "big")
                at, pos = (int.from_bytes(raw[100:104], "big") if version >= 3 else 72), 0
                while at + 8 <= len(raw):
                    kind, n = int.from_bytes(raw[at : at + 4], "big"), int.from_bytes(raw[at + 4 : at + 8], "big")
                    if kind == 0 or at + 8 + n > len(raw):
                        break
                    rows.append((image, pos, kind, raw[at + 8 : at + 8 + n]))
                    at, pos = at + 8 + -(-n // 8) * 8, pos + 1
            a = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(a[0], pa.string()), pa.array(a[1], pa.int32()), pa.array(a[2], pa.int64()), pa.array(a[3], pa.binary())], names=["image_id", "pos", "type_id", "data"])

    return _first(cluster).where("bytes is not null").select("image_id", "bytes").mapInArrow(run, "image_id string, pos int, type_id long, data binary")


def _words(tables: DataFrame, cluster: Clusters, cluster_bits: int, width: int = 8, empty: bool = False) -> DataFrame:
    """Words of contiguous tables (image_id, others, offset, entries): index, hi, lo, and for entries of two words hi2, lo2.

    A table is spread over its clusters, so one of any length is read in parallel, and decoded where it is read. Entries of
    zeros are left out unless `empty`; what lies beyond the end of the file has none (`beyond_end` tells).
    """
    size = 1 << cluster_bits
    per, words = size // width, width // 8
    want = tables.where("entries > 0").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("entries") - 1) / per))))
    want = want.withColumn("cluster_idx", F.shiftright("offset", cluster_bits) + F.col("part"))
    others = [c for c in tables.columns if c not in ("image_id", "entries")]
    names = ["index", "hi", "lo", "hi2", "lo2"][: 1 + 2 * words]
    schema = reduce(lambda t, f: t.add(f), (want.schema[c] for c in ("image_id", *others)), StructType())
    schema = reduce(lambda t, n: t.add(n, "long"), names, schema)

    def decode(batches):
        for b in batches:
            for k in range(b.num_rows):
                raw = b.column("bytes")[k].as_py()
                if raw is None:
                    continue
                part, entries = b.column("part")[k].as_py(), b.column("entries")[k].as_py()
                w = np.frombuffer(raw, ">u4").astype(np.int64).reshape(per, 2 * words)[: entries - part * per]
                at = np.arange(len(w)) if empty else np.flatnonzero(w.any(1))
                if not len(at):
                    continue
                row = b.slice(k, 1)
                own = [row.column(c).take(pa.array(np.zeros(len(at), np.int64))) for c in ("image_id", *others)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(part * per + at), *(pa.array(w[at, j]) for j in range(2 * words))], names=schema.names)

    return fetch(want, cluster).select("image_id", *others, "entries", "part", "bytes").mapInArrow(decode, schema)


def beyond_end(tables: DataFrame, lengths: DataFrame) -> DataFrame:
    """Tables (image_id, offset, entries, others) that do not lie within their file, with the file's length."""
    return tables.join(lengths, "image_id").where("entries > 0 and offset + entries * 8 > length")


def strict(violations: DataFrame) -> None:
    """Strict mode: the first violation is an error. In lenient mode the same rows are a report."""
    row = violations.first()
    if row is not None:
        raise ValueError("damaged image: " + ", ".join(f"{k}={v}" for k, v in row.asDict().items()))


def l1_entries(tables: DataFrame, cluster: Clusters, cluster_bits: int) -> DataFrame:
    """Level-1 entries that point somewhere: image_id, table_id, l1_index, l2_offset, copied."""
    x = _words(tables, cluster, cluster_bits)
    x = x.select("image_id", "table_id", F.col("index").alias("l1_index"), bits.masked(F.col("hi"), F.col("lo"), 9, 55).alias("l2_offset"), bits.bit(F.col("hi"), F.col("lo"), 63).alias("copied"))
    return x.where("l2_offset <> 0")


def l2_tables(l1: DataFrame, cluster_bits: int, extended: bool = False) -> DataFrame:
    """The level-2 tables that level-1 entries point at, as _words takes them."""
    per = (1 << cluster_bits) // (16 if extended else 8)
    return l1.select("image_id", "table_id", "l1_index", F.col("l2_offset").alias("offset"), F.lit(per).alias("entries"))


def l2_entries(l1: DataFrame, cluster: Clusters, cluster_bits: int, keep_empty: bool = False, extended: bool = False) -> DataFrame:
    """Level-2 entries. The compressed bit is tested first; a zero flag beside an offset is a preallocated zero.

    Extended entries have 16 bytes; the second word holds the subclusters' bits (alloc: the low half, zero: the high one),
    and bit 0 of the first has no meaning. Their kind is `compressed`, `zero` if all subclusters are, `unallocated` if none
    has a bit, and else `standard`.
    """
    per = (1 << cluster_bits) // (16 if extended else 8)
    x = _words(l2_tables(l1, cluster_bits, extended), cluster, cluster_bits, 16 if extended else 8, keep_empty)
    hi, lo = F.col("hi"), F.col("lo")
    packed = bits.bit(hi, lo, 62)
    offset, size = bits.compressed_descriptor(bits.masked(hi, lo, 0, 61), cluster_bits)
    host = bits.masked(hi, lo, 9, 55)
    if extended:
        kind = F.when(packed, "compressed").when((F.col("hi2") == bits.LOW32) & (F.col("lo2") == 0), "zero").when((F.col("hi2") == 0) & (F.col("lo2") == 0), "unallocated").otherwise("standard")
        more = [F.when(~packed, F.col("lo2")).alias("alloc"), F.when(~packed, F.col("hi2")).alias("zero")]
    else:
        kind = F.when(packed, "compressed").when(bits.bit(hi, lo, 0), "zero").when(host == 0, "unallocated").otherwise("standard")
        more = []
    x = x.select(
        "image_id", "table_id", "l1_index", F.col("index").alias("l2_index"), (F.col("l1_index") * per + F.col("index")).alias("guest_cluster"), kind.alias("kind"),
        F.when(packed, offset).when(host != 0, host).alias("host_offset"), bits.bit(hi, lo, 63).alias("copied"), F.when(packed, size).alias("compressed_size"), *more,
    )
    return x if keep_empty else x.where("kind <> 'unallocated'")


def active_tables(head: DataFrame) -> DataFrame:
    return head.select("image_id", F.lit("active").alias("table_id"), F.col("l1_offset").alias("offset"), F.col("l1_entries").alias("entries"))


def snapshots(head: DataFrame, cluster: Clusters, cluster_bits: int) -> DataFrame:
    """Snapshot records of variable length, parsed from their clusters in one small group for each image."""
    size = 1 << cluster_bits
    h = head.where("snapshot_count > 0").select("image_id", "snapshot_count", F.shiftright("snapshots_offset", cluster_bits).alias("first"))
    # a record has two strings of up to 64 KiB; what the count can need at most is read, not a fixed cap
    need = F.sequence(F.col("first"), F.col("first") + F.ceil(F.col("snapshot_count") * 132_000 / size))
    near = fetch(h.withColumn("cluster_idx", F.explode(need)), cluster).where("bytes is not null")

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cluster_idx")
        raw, rows, at = b"".join(t.column("bytes").to_pylist()), [], 0
        u = lambda p, n: int.from_bytes(raw[at + p : at + p + n], "big")
        for k in range(t.column("snapshot_count")[0].as_py()):
            id_size, name_size, extra = u(12, 2), u(14, 2), u(36, 4)
            text = at + 40 + extra
            disk = u(48, 8) if extra >= 16 else None
            rows.append((t.column("image_id")[0].as_py(), k, raw[text : text + id_size].decode("utf-8", "replace"), raw[text + id_size : text + id_size + name_size].decode("utf-8", "replace"), u(0, 8), u(8, 4), u(16, 4), u(20, 4), u(32, 4), disk))
            at += -(-(40 + extra + id_size + name_size) // 8) * 8
        names = ["image_id", "snap_idx", "id", "name", "l1_offset", "l1_entries", "seconds", "ts_nanos", "vm_state_size", "virtual_disk_size"]
        return pa.table({n: pa.array(v, pa.string() if n in ("image_id", "id", "name") else pa.int64()) for n, v in zip(names, zip(*rows, strict=True), strict=True)})

    return near.select("image_id", "cluster_idx", "bytes", "snapshot_count").groupBy("image_id").applyInArrow(run, "image_id string, snap_idx long, id string, name string, l1_offset long, l1_entries long, seconds long, ts_nanos long, vm_state_size long, virtual_disk_size long")


def refcount_blocks(head: DataFrame, cluster: Clusters, cluster_bits: int) -> DataFrame:
    """image_id, block, offset of the reference blocks that the reference table names."""
    t = head.select("image_id", F.col("refcount_table_offset").alias("offset"), (F.col("refcount_table_clusters") * ((1 << cluster_bits) // 8)).alias("entries"))
    x = _words(t, cluster, cluster_bits).select("image_id", F.col("index").alias("block"), bits.masked(F.col("hi"), F.col("lo"), 9, 62).alias("offset"))
    return x.where("offset <> 0")


def counts_of(raw: bytes, order: int) -> np.ndarray:
    """The counts of a reference block. Widths below a byte begin at a byte's high bits."""
    width = 1 << order
    if width >= 8:
        return np.frombuffer(raw, f">u{width // 8}")
    b = np.frombuffer(raw, np.uint8)
    return ((b[:, None] >> np.arange(8 - width, -1, -width, dtype=np.uint8)) & ((1 << width) - 1)).ravel()


def counts_to(counts: np.ndarray, order: int) -> bytes:
    """A reference block of counts: the inverse of counts_of."""
    width = 1 << order
    if width >= 8:
        return counts.astype(f">u{width // 8}").tobytes()
    x = counts.astype(np.uint8).reshape(-1, 8 // width) << np.arange(8 - width, -1, -width, dtype=np.uint8)
    return x.sum(1).astype(np.uint8).tobytes()


def stored_refcounts(head: DataFrame, cluster: Clusters, cluster_bits: int, refcount_order: int) -> DataFrame:
    """(image_id, cluster_idx, stored) of every cluster that a block covers and whose count is not zero."""
    per_block = (1 << cluster_bits) * 8 // (1 << refcount_order)
    blocks = refcount_blocks(head, cluster, cluster_bits).withColumn("cluster_idx", F.shiftright("offset", cluster_bits))

    def decode(batches):
        for b in batches:
            for image, block, raw in zip(*(b.column(c).to_pylist() for c in ("image_id", "block", "bytes")), strict=True):
                if raw is None:
                    continue
                counts = counts_of(raw, refcount_order)
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(at), pa.string()), pa.array(block * per_block + at), pa.array([int(x) for x in counts[at]], pa.decimal128(20))], names=["image_id", "cluster_idx", "stored"])

    return fetch(blocks, cluster).select("image_id", "block", "bytes").mapInArrow(decode, "image_id string, cluster_idx long, stored decimal(20,0)")


def all_roots(head: DataFrame, cluster: Clusters, cluster_bits: int) -> DataFrame:
    """Level-1 tables of the active state (`active`) and of the snapshots (`s0`, `s1`, ...)."""
    snaps = snapshots(head, cluster, cluster_bits)
    name = F.concat(F.lit("s"), F.col("snap_idx").cast("string"))
    return active_tables(head).unionByName(snaps.select("image_id", name.alias("table_id"), F.col("l1_offset").alias("offset"), F.col("l1_entries").alias("entries")))


def _bitmap_regions(cluster: Clusters, cluster_bits: int) -> DataFrame:
    """image_id, offset, length of all that bitmaps take: directory, tables and data."""
    ext = extensions(cluster)
    b = F.col("data")
    own = ext.where((F.col("type_id") == BITMAPS_EXTENSION) & (F.octet_length("data") >= 24)).select("image_id", bits.masked(*bits.halves(b, 16), 0, 62).alias("offset"), bits.masked(*bits.halves(b, 8), 0, 62).alias("length"))
    directory = bitmap_directory(ext, cluster, cluster_bits)
    tables = directory.select("image_id", F.col("name").alias("table_id"), F.col("table_offset").alias("offset"), F.col("table_size").alias("entries"))
    data = _words(tables, cluster, cluster_bits).select("image_id", bits.masked(F.col("hi"), F.col("lo"), 9, 55).alias("offset"), F.lit(1).cast("long").alias("length")).where("offset <> 0")
    return own.unionByName(tables.select("image_id", "offset", (F.col("entries") * 8).alias("length"))).unionByName(data)


def all_tables(head: DataFrame, cluster: Clusters, cluster_bits: int, extended: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(level-1 tables, their entries, level-2 entries with a host) of the active state and all snapshots."""
    roots = all_roots(head, cluster, cluster_bits)
    l1 = l1_entries(roots, cluster, cluster_bits)
    return roots, l1, l2_entries(l1, cluster, cluster_bits, keep_empty=True, extended=extended).where("host_offset is not null")


def expected_refcounts(head: DataFrame, cluster: Clusters, cluster_bits: int, extended: bool = False, tables: tuple | None = None) -> DataFrame:
    """(image_id, cluster_idx, expected) by counting all references of header, tables, data, snapshots, bitmaps and blocks.
    tables: what all_tables gives, if it is there already."""
    size = 1 << cluster_bits
    span = lambda df, offset, length: df.select("image_id", F.explode(F.sequence(F.shiftright(offset, cluster_bits), F.shiftright(offset + F.greatest(length, F.lit(1)) - 1, cluster_bits))).alias("cluster_idx"))
    snaps = snapshots(head, cluster, cluster_bits)
    roots, l1, l2 = tables or all_tables(head, cluster, cluster_bits, extended)
    t = head.select("image_id", F.col("refcount_table_offset").alias("offset"), (F.col("refcount_table_clusters") * size).alias("length"))
    blocks = refcount_blocks(head, cluster, cluster_bits)
    used = snaps.groupBy("image_id").agg(F.sum(F.ceil((40 + 16 + F.octet_length("id") + F.octet_length("name")) / 8) * 8).alias("length"))
    snap_table = head.join(used, "image_id").select("image_id", F.col("snapshots_offset").alias("offset"), "length")
    parts = [
        head.select("image_id", F.lit(0).cast("long").alias("cluster_idx")),
        span(roots, F.col("offset"), F.col("entries") * 8),
        span(l1, F.col("l2_offset"), F.lit(1)),
        span(l2, F.col("host_offset"), F.coalesce("compressed_size", F.lit(1))),
        span(t, F.col("offset"), F.col("length")),
        span(blocks, F.col("offset"), F.lit(1)),
        span(snap_table, F.col("offset"), F.col("length")),
        span(_bitmap_regions(cluster, cluster_bits), F.col("offset"), F.col("length")),
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy("image_id", "cluster_idx").agg(F.count("*").alias("expected"))


def read_clusters(entries: DataFrame, cluster: Clusters, cluster_bits: int, compression: Column | int = 0, decrypt: Callable[[bytes, int, int], bytes] | None = None) -> DataFrame:
    """(image_id, table_id, guest_cluster, bytes, error) of every entry given. Zero clusters read as zeros.

    Extended entries (alloc, zero) read subcluster by subcluster: allocated ones from the host cluster, others as zeros; one
    with both bits is an error, and so is an allocated one without a host cluster. They get a column `below`, the
    subclusters that ask the next layer. Compressed extents collect the clusters they touch (one more than their bytes at
    most) and are inflated in Arrow batches; damage is reported, not raised. decrypt(bytes, host offset, guest offset)
    turns the bytes of standard clusters of encrypted images.
    """
    size = 1 << cluster_bits
    extended = "alloc" in entries.columns
    masks = ["alloc", "zero"] if extended else []
    e = entries.select("image_id", "table_id", "guest_cluster", "kind", "host_offset", "compressed_size", *masks)
    names = ["image_id", "table_id", "guest_cluster"]
    none = [F.lit(None).cast("long").alias("below")] if extended else []
    zeros = e.where("kind = 'zero'").select(*names, F.lit(bytes(size)).alias("bytes"), F.lit(None).cast("string").alias("error"), *none)
    want = e.where("kind = 'standard'").withColumn("cluster_idx", F.shiftright("host_offset", cluster_bits))
    if decrypt is not None or extended:
        plain = fetch(want, cluster, then=_turn(size, decrypt, extended), schema="image_id string, table_id string, guest_cluster long, bytes binary, error string" + (", below long" if extended else ""))
    else:
        error = F.when(F.col("bytes").isNull(), "beyond the end of the file")
        plain = fetch(want, cluster).select(*names, F.coalesce("bytes", F.lit(bytes(size))).alias("bytes"), error.alias("error"))
    c = e.where("kind = 'compressed'")
    c = c.withColumn("cluster_idx", F.explode(F.sequence(F.shiftright("host_offset", cluster_bits), F.shiftright(F.col("host_offset") + F.col("compressed_size") - 1, cluster_bits))))
    if isinstance(cluster, Files):  # extents lie in the file as they are asked for
        data = _extents(e.where("kind = 'compressed'"), cluster)
    else:
        c = c.join(cluster, ["image_id", "cluster_idx"]).groupBy(*names, "host_offset", "compressed_size").agg(F.sort_array(F.collect_list(F.struct("cluster_idx", "bytes"))).alias("parts"))
        joined = F.aggregate("parts", F.lit(b""), lambda a, x: F.concat(a, x["bytes"]))
        data = c.withColumn("packed", F.substring(joined, (F.col("host_offset") % size + 1).cast("int"), F.col("compressed_size").cast("int")))
    c = data.withColumn("r", inflate(F.col("packed"), size, compression))
    c = c.select(*names, F.coalesce("r.bytes", F.lit(bytes(size))).alias("bytes"), F.col("r.error").alias("error"), *none)
    return zeros.unionByName(plain).unionByName(c)


def _extents(entries: DataFrame, files: Files) -> DataFrame:
    """Compressed entries with their packed bytes, read where they lie."""
    x = entries.select("image_id", "table_id", "guest_cluster", "host_offset", "compressed_size", F.shiftright("host_offset", files.cluster_bits).alias("cluster_idx"))
    names, token = [*x.columns, "packed"], files.token

    def run(batches):
        handles: dict = {}
        assert token
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                raw = [_pread(handles, *z) for z in zip(*(part.column(c).to_pylist() for c in ("image_id", "host_offset", "compressed_size")), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=names)

    return _spread(x).mapInArrow(run, StructType([*x.schema.fields, StructField("packed", BinaryType())]))


def _turn(size: int, decrypt, extended: bool):
    """Decrypts host clusters and blanks the subclusters that are not allocated; what has an error reads as zeros."""

    def run(batches):
        for b in (x.slice(at, 64) for x in batches for at in range(0, x.num_rows, 64)):
            out, errors, below = [], [], []
            for k, raw in enumerate(b.column("bytes").to_pylist()):
                alloc, zero = (b.column("alloc")[k].as_py(), b.column("zero")[k].as_py()) if extended else (1, 0)
                host = b.column("host_offset")[k].as_py()
                if alloc & zero:
                    errors.append("subcluster with both bits")
                elif alloc and host is None:
                    errors.append("subcluster without a cluster")
                else:
                    errors.append("beyond the end of the file" if alloc and raw is None else None)
                if errors[-1] is not None:
                    out.append(bytes(size))
                    below.append(None)
                    continue
                raw = bytes(size) if raw is None else raw
                if decrypt is not None:
                    raw = decrypt(raw, host, b.column("guest_cluster")[k].as_py() * size)
                if extended:
                    part = size // 32
                    raw = b"".join(raw[i * part : (i + 1) * part] if alloc >> i & 1 else bytes(part) for i in range(32))
                    below.append(~(alloc | zero) & 0xFFFFFFFF)
                out.append(raw)
            own = [b.column(c) for c in ("image_id", "table_id", "guest_cluster")]
            more = [pa.array(below, pa.int64())] if extended else []
            yield pa.RecordBatch.from_arrays([*own, pa.array(out, pa.binary()), pa.array(errors, pa.string()), *more], names=["image_id", "table_id", "guest_cluster", "bytes", "error", *(["below"] if extended else [])])

    return run


#: Header extensions of the format: dirty bitmaps, place of the encryption header, name of the external data file.
BITMAPS_EXTENSION, CRYPTO_EXTENSION, DATA_FILE_EXTENSION = 0x23852875, 0x0537BE77, 0x44415441


def bitmap_directory(ext: DataFrame, cluster: Clusters, cluster_bits: int) -> DataFrame:
    """Entries of the dirty-bitmap directories: image_id, name, table_offset, table_size, in_use, auto, type, granularity_bits."""
    b = F.col("data")
    x = ext.where((F.col("type_id") == BITMAPS_EXTENSION) & (F.octet_length("data") >= 24))
    x = x.select("image_id", bits.big_endian(b, 0, 4).alias("n"), bits.masked(*bits.halves(b, 8), 0, 62).alias("size"), bits.masked(*bits.halves(b, 16), 0, 62).alias("offset"))
    first, last = F.shiftright("offset", cluster_bits), F.shiftright(F.col("offset") + F.greatest("size", F.lit(1)) - 1, cluster_bits)
    near = fetch(x.withColumn("cluster_idx", F.explode(F.sequence(first, last))), cluster).where("bytes is not null")
    names = ["image_id", "name", "table_offset", "table_size", "in_use", "auto", "type", "granularity_bits"]

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cluster_idx")
        raw, rows, at = b"".join(t.column("bytes").to_pylist()), [], 0
        u = lambda p, n: int.from_bytes(raw[at + p : at + p + n], "big")
        for _ in range(t.column("n")[0].as_py()):
            if at + 24 > len(raw):
                break
            flags, name_size, extra = u(12, 4), u(18, 2), u(20, 4)
            name = raw[at + 24 + extra : at + 24 + extra + name_size].decode("utf-8", "replace")
            rows.append((t.column("image_id")[0].as_py(), name, u(0, 8), u(8, 4), bool(flags & 1), bool(flags & 2), u(16, 1), u(17, 1)))
            at += -(-(24 + extra + name_size) // 8) * 8
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds, strict=True)})

    return near.select("image_id", "cluster_idx", "bytes", "n").groupBy("image_id").applyInArrow(run, "image_id string, name string, table_offset long, table_size long, in_use boolean, auto boolean, type long, granularity_bits long")


def dirty_granules(directory: DataFrame, cluster: Clusters, cluster_bits: int) -> DataFrame:
    """(image_id, bitmap, bit_no) of every dirty granule. A table entry without offset is all ones if bit 0 is set, else all zeros."""
    size = 1 << cluster_bits
    t = directory.select("image_id", F.col("name").alias("table_id"), F.col("table_offset").alias("offset"), F.col("table_size").alias("entries"))
    e = _words(t, cluster, cluster_bits).select("image_id", F.col("table_id").alias("bitmap"), "index", bits.masked(F.col("hi"), F.col("lo"), 9, 55).alias("at"), bits.bit(F.col("hi"), F.col("lo"), 0).alias("ones"))
    full = e.where("at = 0 and ones").select("image_id", "bitmap", F.explode(F.sequence(F.col("index") * size * 8, (F.col("index") + 1) * size * 8 - 1)).alias("bit_no"))
    data = fetch(e.where("at <> 0").select("image_id", "bitmap", "index", F.shiftright("at", cluster_bits).alias("cluster_idx")), cluster)

    def decode(batches):
        for b in batches:
            for image, name, index, raw in zip(*(b.column(c).to_pylist() for c in ("image_id", "bitmap", "index", "bytes")), strict=True):
                if raw is None:
                    continue
                at = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))) + index * size * 8
                yield pa.RecordBatch.from_arrays([pa.array([image] * len(at), pa.string()), pa.array([name] * len(at), pa.string()), pa.array(at)], names=["image_id", "bitmap", "bit_no"])

    return full.unionByName(data.select("image_id", "bitmap", "index", "bytes").mapInArrow(decode, "image_id string, bitmap string, bit_no long"))


def file_violations(head: DataFrame, sizes: DataFrame) -> DataFrame:
    """(image_id, rule): parts of the header that lie outside the file. sizes: image_id, length."""
    x = head.join(sizes, "image_id")
    size = F.expr("shiftleft(1L, cluster_bits)")
    rules = {
        "l1_beyond_end": F.col("l1_offset") + F.col("l1_entries") * 8 > F.col("length"),
        "l1_unaligned": F.col("l1_offset") % size != 0,
        "refcount_table_beyond_end": F.col("refcount_table_offset") + F.col("refcount_table_clusters") * size > F.col("length"),
        "refcount_table_missing": F.col("refcount_table_clusters") == 0,
        "backing_name_beyond_header": (F.col("backing_file_offset") > 0) & (F.col("backing_file_offset") + F.col("backing_file_size") > size),
        "backing_name_too_long": F.col("backing_file_size") > 1023,
        "snapshots_beyond_end": (F.col("snapshot_count") > 0) & (F.col("snapshots_offset") >= F.col("length")),
        "header_length": (F.col("version") >= 3) & ((F.col("header_length") < 104) | (F.col("header_length") > size)),
        "compression_type": F.col("compression_type") > 1,
        "version": ~F.col("version").isin(2, 3),
        "cluster_bits": ~F.col("cluster_bits").between(9, 21),
        "refcount_order": F.col("refcount_order") > 6,
        "extended_entries": (F.expr("shiftright(cast(incompatible as bigint), 4) & 1") == 1) & (F.col("cluster_bits") < 14),
        "incompatible_features": F.col("incompatible") >= 32,
    }
    broken = F.array_compact(F.array(*(F.when(bad, F.lit(name)) for name, bad in rules.items())))
    return x.select("image_id", F.explode(broken).alias("rule"))
