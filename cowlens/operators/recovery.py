"""Recovery of damaged images: what a cluster looks like, which cluster size fits, which tables are plausible.

One Arrow pass reduces every cluster to a row of statistics; all that follows are joins and aggregations of such rows.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.codecs import decompress

STATISTICS = "image_id string, cluster_idx bigint, magic boolean, zeros bigint, entries int, nonzero int, valid_l2 int, valid_l1 int, distinct_entries int, small_counts int, compressed boolean, first_lba bigint, boot boolean, longest_run bigint"


def statistics(cluster: DataFrame, cluster_bits: int, end: int = 1 << 56) -> DataFrame:
    """A row for each cluster: how its words would read as entries of the tables of the format. Valid entries name places
    behind the header's cluster and before `end`, the length of the file; so do compressed ones, or any word that begins with a
    letter were one."""
    size = 1 << cluster_bits
    place = np.uint64((1 << (62 - (cluster_bits - 8))) - 1)

    def run(batches):
        for t in batches:
            out = []
            for idx, raw in zip(t.column("cluster_idx").to_pylist(), t.column("bytes").to_pylist(), strict=True):
                raw = bytes(raw).ljust(size, b"\0")
                b = np.frombuffer(raw, np.uint8)
                w = np.frombuffer(raw, ">u8").astype(np.uint64)
                full = w[w != 0]
                host, flags = full & np.uint64(0x00FFFFFFFFFFFE00), full & ~np.uint64(0x00FFFFFFFFFFFE00)
                aligned = (host % np.uint64(size) == 0) & (host != 0) & (host < np.uint64(end))
                packed = ((full >> np.uint64(62)) & np.uint64(1) == 1) & (full & place >= np.uint64(size)) & (full & place < np.uint64(end))
                plain = (flags & ~np.uint64((1 << 63) | 1)) == 0
                l2 = packed | (plain & (aligned | ((host == 0) & (flags & np.uint64(1) == 1))))
                l1 = (flags & ~np.uint64(1 << 63) == 0) & aligned
                counts = np.frombuffer(raw, ">u2")
                edge = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True])
                try:
                    decompress(raw, size)
                    inflates = raw[:1] != b"\0"
                except Exception:  # noqa: BLE001  not a stream
                    inflates = False
                boot = raw[510:512] == b"\x55\xaa"
                lba = int.from_bytes(raw[454:458], "little") if boot else None
                out.append((idx, raw[:4] == b"QFI\xfb", int((b == 0).sum()), len(w), len(full), int(l2.sum()), int(l1.sum()), len(np.unique(full)), int(((counts > 0) & (counts < 256)).sum()), inflates, lba, boot, int(np.diff(edge).max())))
            cols = list(zip(*out, strict=True)) or [[]] * 13
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([t.column("image_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[x.split(" ")[0] for x in STATISTICS.split(", ")])

    return cluster.select("image_id", "cluster_idx", "bytes").mapInArrow(run, STATISTICS)


def classify(stats: DataFrame, cluster_bits: int) -> DataFrame:
    """Adds kind: empty, header, unknown, compressed, refcount, l2, l1 or data, tested in this order."""
    size = 1 << cluster_bits
    few = F.col("distinct_entries") * 4 < F.col("nonzero")  # the same entry again and again is no address table
    table = (F.col("nonzero") > 0) & ~few
    kind = (
        F.when(F.col("zeros") == size, "empty")
        .when(F.col("magic"), "header")
        .when(F.col("cluster_idx") == 0, "unknown")
        .when(F.col("compressed"), "compressed")
        .when((F.col("small_counts") > 0) & (F.col("small_counts") * 2 + F.col("zeros") >= size) & (F.col("valid_l2") * 2 < F.col("nonzero")), "refcount")
        .when(table & (F.col("valid_l2") == F.col("nonzero")) & (F.col("valid_l1") < F.col("nonzero")), "l2")
        .when(table & (F.col("valid_l1") == F.col("nonzero")), "l1")
        .otherwise("data")
    )
    return stats.withColumn("kind", kind)


def summary(classes: DataFrame) -> DataFrame:
    return classes.groupBy("image_id", "kind").agg(F.count("*").alias("clusters"))


def has_structure(stats: DataFrame, cluster_bits: int) -> DataFrame:
    """More than 1 % zero bytes, or a run of eight equal bytes."""
    size = 1 << cluster_bits
    return stats.withColumn("structured", (F.expr(f"zeros * 100 div {size}") > 1) | (F.col("longest_run") >= 8))


def detect(spark: SparkSession, path: str) -> int:
    """Cluster bits of an image file: the header's if it is whole, else the field's if the magic alone is damaged and the
    field's value scores, else the best score."""
    from ..sources.image import Files, header

    files = Files(spark, [path], 9)
    head = header(files).first()
    if head is not None and 9 <= head.cluster_bits <= 21:
        return head.cluster_bits
    scores = {r.cluster_bits: r.score for r in detect_cluster_bits(spark, path).collect()}  # one row a candidate
    raw = files.first().first().bytes
    field = int.from_bytes(raw[20:24], "big") if raw is not None else 0
    return field if scores.get(field, 0) > 0 else max(scores, key=lambda k: (scores[k], -CANDIDATES.index(k)))


CANDIDATES = (16, 12, 13, 14, 15, 17, 18, 9)


def detect_cluster_bits(spark: SparkSession, path: str, candidates: tuple[int, ...] = CANDIDATES, sample: int = 256) -> DataFrame:
    """Scores of candidate cluster sizes, best first; 64 KiB wins ties. A systematic sample of each is read and scored."""
    from ..sources.image import Files, fetch

    scores, length = None, os.path.getsize(path)
    for place, bits in enumerate(candidates):
        n = -(-length // (1 << bits))
        step = max(1, -(-n // sample))
        want = spark.range(0, n, step).select(F.lit(path).alias("image_id"), F.col("id").alias("cluster_idx"))
        s = classify(statistics(fetch(want, Files(spark, [path], bits)), bits, length), bits)
        score = F.sum(F.when(F.col("kind") == "l2", F.col("valid_l2")).when(F.col("kind") == "l1", F.col("valid_l1")).when(F.col("kind") == "header", 1).otherwise(0))
        row = s.agg(F.coalesce(score, F.lit(0)).cast("long").alias("score")).select(F.lit(bits).alias("cluster_bits"), F.lit(place).alias("place"), "score")
        scores = row if scores is None else scores.unionByName(row)
    return scores.orderBy(F.desc("score"), "place")


def orphan_tables(found: DataFrame, l1: DataFrame) -> DataFrame:
    """Scanned level-2 tables with the level-1 index that points at them, or else their rank by place among the rest."""
    from .mapping import ranked

    own = l1.select("image_id", F.col("l2_offset").alias("offset"), "l1_index")
    known = found.join(own, ["image_id", "offset"])
    lost = found.join(own, ["image_id", "offset"], "left_anti")
    placed = ranked(lost, "image_id", "offset", width=1 << 40, name="l1_index")
    return known.select("image_id", "offset", "l1_index", F.lit(True).alias("exact")).unionByName(placed.select("image_id", "offset", "l1_index", F.lit(False).alias("exact")))


def without_garbage(entries: DataFrame) -> DataFrame:
    """Entries without those of tables that have four or more and less than a quarter valid ones."""
    per = entries.groupBy("image_id", "table_id", "l1_index").agg(F.count("*").alias("n"), F.sum(F.col("valid").cast("int")).alias("ok"))
    bad = per.where("n >= 4 and ok * 4 < n").select("image_id", "table_id", "l1_index")
    return entries.join(bad, ["image_id", "table_id", "l1_index"], "left_anti")


def _found_tables(stats: DataFrame, files) -> DataFrame:
    """(image_id, offset) of scanned clusters that read as tables and whose entries do not mostly name other tables or counts.

    A level-2 table without flags of its own looks like a level-1 table; what it points at tells them apart.
    """
    from ..functions import bits as fb
    from ..sources import image as im

    bits = files.cluster_bits
    like = stats.where("kind in ('l1', 'l2')").select("image_id", F.shiftleft("cluster_idx", bits).alias("offset"), F.lit((1 << bits) // 8).alias("entries"))
    words = im._words(like, files, bits).select("image_id", "offset", F.shiftright(fb.masked(F.col("hi"), F.col("lo"), 9, 55), bits).alias("cluster_idx"))
    named = stats.where("kind in ('l1', 'l2', 'refcount')").select("image_id", "cluster_idx", F.lit(1).alias("named"))
    x = words.join(named, ["image_id", "cluster_idx"], "left").groupBy("image_id", "offset").agg(F.count("*").alias("n"), F.count("named").alias("named"))
    return x.where("2 * named < n").select("image_id", "offset")


#: Hypotheses in the order that settles ties: entries of 8 or 16 bytes, level-1 entries trusted or only where a table is found.
HYPOTHESES = (("standard, trusted", False, False), ("standard, validated", False, True), ("extended, trusted", True, False), ("extended, validated", True, True))


def reconstruct(files, guest_limit: int | None = None) -> tuple[str, int, DataFrame]:
    """(name, score, level-2 entries) of the most plausible reading of a damaged image.

    Tables are those that level 1 names (if the header can be read) and those that the scan finds besides, which take the
    level-1 places after the known ones, in order of their place in the file. Entries of garbage tables go, conflicts
    of a guest cluster go to the entry whose host lies first.
    """
    from ..sources import image as im
    from . import integrity

    bits = files.cluster_bits
    size, spark = 1 << bits, files.spark
    stats = classify(statistics(files.all(), bits, max(map(os.path.getsize, files.paths))), bits).persist()
    found = _found_tables(stats, files).persist()
    in_file = files.lengths().select("image_id", F.ceil(F.col("length") / size).cast("long").alias("clusters"))
    head = im.header(files)
    row = head.first()
    l1 = None if row is None else im.l1_entries(im.active_tables(head), files, bits)
    stored = None if row is None or not 0 <= row.refcount_order <= 6 else im.stored_refcounts(head, files, bits, row.refcount_order)
    empty = spark.createDataFrame([], "image_id string, l2_offset long, l1_index long")
    best = None
    for name, extended, validate in HYPOTHESES:
        if extended and bits < 14:
            continue
        own = empty if l1 is None else l1.select("image_id", "l2_offset", F.col("l1_index").cast("long").alias("l1_index"))
        if validate:
            own = own.join(found.withColumnRenamed("offset", "l2_offset"), ["image_id", "l2_offset"])
        after = own.groupBy("image_id").agg((F.max("l1_index") + 1).alias("after"))
        tables = orphan_tables(found, own).join(after, "image_id", "left")
        tables = tables.select("image_id", F.col("offset").alias("l2_offset"), F.when(F.col("exact"), F.col("l1_index")).otherwise(F.col("l1_index") + F.coalesce("after", F.lit(0))).cast("long").alias("l1_index"))
        tables = tables.unionByName(own).distinct().withColumn("table_id", F.lit("active"))
        entries = im.l2_entries(tables, files, bits, extended=extended).join(in_file, "image_id")
        inside = (F.col("host_offset") >= size) & (F.col("host_offset") < F.col("clusters") * size)
        entries = entries.withColumn("valid", (F.col("host_offset").isNull() & (F.col("kind") == "zero")) | inside).drop("clusters")
        entries = without_garbage(entries).persist()
        scored = entries.where("host_offset is not null").select("image_id", F.lit(1).alias("table_id"), "guest_cluster", "kind", F.shiftright("host_offset", bits).alias("host_cluster"))
        known = in_file.select("image_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("clusters") - 1)).alias("cluster_idx"))
        known = known.withColumn("stored", F.lit(1)) if stored is None else known.join(stored, ["image_id", "cluster_idx"], "left").select("image_id", "cluster_idx", F.coalesce("stored", F.lit(0)).alias("stored"))
        limit = guest_limit or (-(-row.virtual_size // size) if row is not None and row.virtual_size > 0 else 1 << 55)
        score = integrity.plausibility(scored, known, limit).agg(F.sum("score")).first()[0]
        score = -(1 << 62) if score is None else score
        if best is None or score > best[1]:
            best = (name, score, entries)
    name, score, entries = best
    first = F.min(F.struct(F.coalesce("host_offset", F.lit(0)), "l1_index", "l2_index"))
    keep = entries.where("valid").groupBy("image_id", "guest_cluster").agg(first.alias("k")).select("image_id", "guest_cluster", "k.l1_index", "k.l2_index")
    return name, score, entries.join(keep, ["image_id", "guest_cluster", "l1_index", "l2_index"]).drop("valid")


def probe_streams(entries: DataFrame, files, compression: int = 0, sample: int = 100) -> DataFrame:
    """How many of at most `sample` compressed entries, those of least host offset, inflate: tried, inflated."""
    from ..sources import image as im

    some = entries.where("kind = 'compressed'").orderBy("image_id", "host_offset").limit(sample)
    return im.read_clusters(some, files, files.cluster_bits, compression).agg(F.count("*").alias("tried"), F.count_if(F.col("error").isNull()).alias("inflated"))


def find_luks(files, first: int = 64) -> DataFrame:
    """(image_id, offset) of an encryption header: where the extension says, else the first cluster that begins like one."""
    from ..functions import bits as fb
    from ..sources import image as im

    ext = im.extensions(files).where((F.col("type_id") == im.CRYPTO_EXTENSION) & (F.octet_length("data") >= 16))
    named = ext.select("image_id", fb.masked(*fb.halves(F.col("data"), 0), 0, 62).alias("offset"), F.lit(0).alias("rank"))
    want = files.spark.createDataFrame([(p,) for p in files.paths], "image_id string").withColumn("cluster_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(first - 1).cast("long"))))
    seen = im.fetch(want, files).where(F.hex(F.substring("bytes", 1, 6)) == "4C554B53BABE").select("image_id", F.shiftleft("cluster_idx", files.cluster_bits).alias("offset"), F.lit(1).alias("rank"))
    best = F.min(F.struct("rank", "offset"))
    return named.unionByName(seen).groupBy("image_id").agg(best.alias("b")).select("image_id", F.col("b.offset").alias("offset"))


def partition_gap(stats: DataFrame, cluster_bits: int) -> DataFrame:
    """First guest cluster of the first partition, where a cluster reads as a master boot record."""
    return stats.where("boot and first_lba > 0 and first_lba < 4294967295").select("image_id", "cluster_idx", F.expr(f"first_lba * 512 div {1 << cluster_bits}").alias("first_partition_cluster"))


def merge_layers(layers: DataFrame) -> DataFrame:
    """Mappings of a chain flattened: the layer nearest the leaf wins, zero entries included."""
    best = F.max(F.struct("layer", "host_offset", "kind"))
    return layers.groupBy("guest_cluster").agg(best.alias("e")).select("guest_cluster", "e.layer", "e.host_offset", "e.kind")


def forest(images: DataFrame) -> DataFrame:
    """Backing forest: images (image_id, backing_file) as edges to the image of that name; roots have no parent."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    p = images.select(F.col("image_id").alias("parent"), name("image_id").alias("name"))
    return images.withColumn("name", name("backing_file")).join(p, "name", "left").select(F.col("image_id").alias("node"), "parent", (F.col("backing_file").isNotNull() & F.col("parent").isNull()).alias("missing"))
