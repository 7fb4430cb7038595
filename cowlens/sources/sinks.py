"""Sinks: raw files, images, reports. Data are laid out by ranks and prefix sums, metadata follow from aggregates.

An image is assembled as a table of host clusters first, so any writer can take it; `write_clusters` puts the clusters
at their places in one file that all workers mount (tasks that run again write the same bytes).
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codecs import compress, is_zero
from ..operators.mapping import ranked
from .build import COMPRESSED, COPIED, MAGIC

#: Guest clusters whose compressed bytes are packed together: a bounded group, whatever the image's size.
PACK = 64
HOST = "cluster_idx bigint, bytes binary"


def write_clusters(clusters: DataFrame, path: str, cluster_size: int, total: int) -> None:
    """Positioned writes of (cluster_idx, bytes); what has no row stays a hole."""
    with open(path, "wb") as f:
        f.truncate(total * cluster_size)

    def put(rows):
        with open(path, "r+b") as f:
            for r in rows:
                f.seek(r["cluster_idx"] * cluster_size)
                f.write(r["bytes"])

    # each task writes the rows it has: places don't depend on one another, so nothing is dealt anew or sorted
    clusters.select("cluster_idx", "bytes").foreachPartition(put)


def write_raw(guest: DataFrame, path: str, virtual_size: int, cluster_size: int) -> None:
    """Raw file of guest clusters (guest_cluster, bytes); zero clusters are holes."""
    solid = guest.where(~is_zero(F.col("bytes"))).select(F.col("guest_cluster").alias("cluster_idx"), "bytes")
    write_clusters(solid, path, cluster_size, -(-virtual_size // cluster_size))
    with open(path, "r+b") as f:
        f.truncate(virtual_size)


def _prefix(sizes: DataFrame, key: str, amount: str, name: str) -> DataFrame:
    """Running sum of `amount` before each key, by ranges of keys: (key, name)."""
    x = sizes.withColumn("__r", F.expr(f"{key} div 4096"))
    per = x.groupBy("__r").agg(F.sum(amount).alias("__n"))
    per = per.withColumn("__base", F.coalesce(F.sum("__n").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inner = F.coalesce(F.sum(amount).over(Window.partitionBy("__r").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return x.withColumn("__i", inner).join(per, "__r").select(key, (F.col("__base") + F.col("__i")).cast("long").alias(name))


def assemble(guest: DataFrame, virtual_size: int, cluster_bits: int = 16, packed: bool = False, backing: str | None = None, extended: bool = False, content: Column | None = None) -> tuple[DataFrame, int]:
    """(host clusters, how many): an image of guest clusters (guest_cluster, bytes). Zero clusters are left out.

    Clusters are padded where they are written, so what is shorter is shuffled as it is. content: their bytes as an expression
    over guest's columns instead of the column bytes, evaluated there too.

    extended: level-2 entries of 16 bytes with the subclusters' bits, from columns alloc and zero (all allocated if missing);
    clusters of 16 KiB at least, not packed.

    Order of the file: header, level-1 table, level-2 tables, data, reference table, reference blocks.
    """
    spark, size = guest.sparkSession, 1 << cluster_bits
    if extended and (packed or cluster_bits < 14):
        raise ValueError("extended entries need clusters of 16 KiB at least, and are not packed")
    words = 2 if extended else 1
    per = size // (8 * words)
    entries = -(-virtual_size // (size * per))
    l1_clusters = max(1, -(-entries * 8 // size))
    masks = ["alloc", "zero"] if extended and "alloc" in guest.columns else []
    content = F.col("bytes") if content is None else content
    solid, padded = guest.where(~is_zero(content)), F.rpad(content, size, F.lit(b"\0")).alias("bytes")
    one = F.lit(0).alias("all")
    l2 = ranked(solid.select(F.expr(f"guest_cluster div {per}").alias("l1_index")).distinct().select("*", one), "all", "l1_index", name="l2_rank").drop("all").persist()
    n_l2 = l2.count()
    first_l2, first = 1 + l1_clusters, 1 + l1_clusters + n_l2
    if packed:
        x = 62 - (cluster_bits - 8)

        def pack(t: pa.Table) -> pa.Table:
            t = t.sort_by("guest_cluster")
            blobs = [compress(b) for b in t.column("bytes").to_pylist()]
            offs = np.cumsum([0, *(-(-len(b) // 512) * 512 for b in blobs)])
            raw = b"".join(b.ljust(-(-len(b) // 512) * 512, b"\0") for b in blobs)
            return pa.table({"pack": t.column("pack")[:1], "guests": [t.column("guest_cluster").to_pylist()], "offsets": [offs[:-1].tolist()], "sizes": [[len(b) for b in blobs]], "raw": [raw]})

        packs = solid.select("guest_cluster", padded).withColumn("pack", F.expr(f"guest_cluster div {PACK}")).groupBy("pack").applyInArrow(pack, "pack long, guests array<long>, offsets array<long>, sizes array<long>, raw binary").persist()
        lengths = packs.select("pack", F.ceil(F.length("raw") / size).alias("n"))
        n_data = lengths.agg(F.sum("n")).first()[0] or 0
        at = packs.join(_prefix(lengths, "pack", "n", "base"), "pack")
        pieces = at.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.length("raw") / size).cast("int") - 1)))
        data = pieces.select((first + F.col("base") + F.col("k")).alias("cluster_idx"), F.rpad(F.substring("raw", (F.col("k") * size + 1).cast("int"), F.lit(size)), size, F.lit(b"\0")).alias("bytes"))
        e = at.select("base", F.inline(F.arrays_zip("guests", "offsets", "sizes")))
        # the descriptor's top bit is set beside the others in two halves, since 1 << 62 and sectors fit a long
        word = F.lit(COMPRESSED) + F.shiftleft(F.ceil(F.col("sizes") / 512).cast("long") - 1, x) + (first + F.col("base")) * size + F.col("offsets")
        entry = e.select(F.col("guests").alias("guest_cluster"), word.alias("word"), F.lit(False).alias("copied"))
        used = e.select(F.explode(F.sequence(F.expr(f"(base * {size} + offsets) div {size}"), F.expr(f"(base * {size} + offsets + ceil(sizes / 512) * 512 - 1) div {size}"))).alias("c")).groupBy("c").agg(F.count("*").alias("refs")).select((F.col("c") + first).alias("cluster_idx"), "refs")
    else:
        placed = ranked(solid.select("guest_cluster", *masks, one), "all", "guest_cluster", name="r").drop("all").persist()
        n_data = placed.count()
        data = solid.drop(*masks).join(placed.select("guest_cluster", "r"), "guest_cluster").select((F.col("r") + first).alias("cluster_idx"), padded)
        states = [F.col(c) if masks else F.lit(v) for c, v in (("alloc", 0xFFFFFFFF), ("zero", 0))] if extended else []
        entry = placed.select("guest_cluster", ((F.col("r") + first) * size).alias("word"), F.lit(True).alias("copied"), *(x.cast("long").alias(n) for x, n in zip(states, ("alloc", "zero"))))
        used = None
    table_at = first + n_data
    blocks, refs_per_block = 1, size // 2
    while True:
        table_clusters = max(1, -(-blocks * 8 // size))
        total = table_at + table_clusters + blocks
        if blocks * refs_per_block >= total:
            break
        blocks = -(-total // refs_per_block)

    def l2_table(t: pa.Table) -> pa.Table:
        out, slot = np.zeros((per, words), ">u8"), t.column("slot").to_numpy()
        out[slot, 0] = t.column("word").to_numpy().astype(np.uint64) | np.where(t.column("copied").to_numpy(zero_copy_only=False), np.uint64(COPIED), np.uint64(0))
        if words == 2:
            out[slot, 1] = t.column("zero").to_numpy().astype(np.uint64) << np.uint64(32) | t.column("alloc").to_numpy().astype(np.uint64)
        return pa.table({"cluster_idx": t.column("cluster_idx")[:1], "bytes": pa.array([out.tobytes()], pa.binary())})

    e = entry.withColumn("l1_index", F.expr(f"guest_cluster div {per}")).join(l2, "l1_index")
    l2s = e.select((F.col("l2_rank") + first_l2).alias("cluster_idx"), (F.col("guest_cluster") % per).alias("slot"), "word", "copied", *(["alloc", "zero"] if extended else [])).groupBy("cluster_idx").applyInArrow(l2_table, HOST)
    l1 = spark.range(l1_clusters).select((F.col("id") + 1).alias("cluster_idx"), F.lit(-1).cast("long").alias("slot"), F.lit(0).cast("long").alias("word"))
    l1 = l1.unionByName(l2.select((F.expr(f"l1_index div {size // 8}") + 1).alias("cluster_idx"), (F.col("l1_index") % (size // 8)).alias("slot"), ((F.col("l2_rank") + first_l2) * size).alias("word")))

    def l1_table(t: pa.Table) -> pa.Table:
        out, slot = np.zeros(size // 8, ">u8"), t.column("slot").to_numpy()
        real = slot >= 0
        out[slot[real]] = t.column("word").to_numpy()[real].astype(np.uint64) | np.uint64(COPIED)
        return pa.table({"cluster_idx": t.column("cluster_idx")[:1], "bytes": pa.array([out.tobytes()], pa.binary())})

    l1s = l1.groupBy("cluster_idx").applyInArrow(l1_table, HOST)

    def counts(batches):  # blocks in which all clusters of the file count one
        for b in batches:
            ids, raw = b.column("id").to_pylist(), []
            for k in ids:
                n = np.zeros(refs_per_block, ">u2")
                n[: max(0, min(refs_per_block, total - k * refs_per_block))] = 1
                raw.append(n.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([table_at + table_clusters + k for k in ids], pa.int64()), pa.array(raw, pa.binary())], names=["cluster_idx", "bytes"])

    block = spark.range(blocks).mapInArrow(counts, HOST)
    if used is not None:  # packed clusters count their extents

        def patch(t: pa.Table, u: pa.Table) -> pa.Table:
            if not t.num_rows:
                return t.select(["cluster_idx", "bytes"])
            n = np.frombuffer(t.column("bytes")[0].as_py(), ">u2").copy()
            n[u.column("cluster_idx").to_numpy() % refs_per_block] = u.column("refs").to_numpy()
            return pa.table({"cluster_idx": t.column("cluster_idx"), "bytes": pa.array([n.tobytes()], pa.binary())})

        keyed = used.withColumn("block", F.expr(f"cluster_idx div {refs_per_block}"))
        own = block.withColumn("block", F.col("cluster_idx") - (table_at + table_clusters))
        block = own.groupBy("block").cogroup(keyed.groupBy("block")).applyInArrow(patch, HOST)
    pointers = np.zeros(table_clusters * (size // 8), ">u8")
    pointers[:blocks] = (np.arange(blocks) + table_at + table_clusters) * size
    table = [(table_at + k, pointers[k * (size // 8) : (k + 1) * (size // 8)].tobytes()) for k in range(table_clusters)]
    head = struct.pack(">IIQIIQIIQQIIQ", MAGIC, 3, 0, 0, cluster_bits, virtual_size, 0, entries, size, table_at * size, table_clusters, 0, 0) + struct.pack(">QQQII", 16 if extended else 0, 0, 0, 4, 112) + bytes(8) + bytes(8)
    if backing is not None:
        name = backing.encode()
        head = head[:8] + struct.pack(">QI", len(head), len(name)) + head[20:] + name
    fixed = spark.createDataFrame([(0, head.ljust(size, b"\0")), *table], HOST)
    return fixed.unionByName(l1s).unionByName(l2s).unionByName(data).unionByName(block), total


def convert_raw(spark, source: str, path: str, cluster_bits: int = 16, packed: bool = False) -> int:
    """Raw file to image; returns clusters written. Ranged reads, so the file may have any size."""
    import os

    from .image import register

    register(spark)
    raw = spark.read.format("cowlens_image").option("path", source).option("clusterbits", str(cluster_bits)).load()
    host, total = assemble(raw.select(F.col("cluster_idx").alias("guest_cluster"), "bytes"), os.path.getsize(source), cluster_bits, packed)
    write_clusters(host, path, 1 << cluster_bits, total)
    return total


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines."""
    report.write.mode("overwrite").json(path)
