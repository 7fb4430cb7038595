"""Command line: python -m cowlens.cli info|dump|check|snapshot|bitmap|hash|resize|rebase|commit|convert|analyze|recover ..."""

from __future__ import annotations

import argparse
import os
import re
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import ciphers
from .functions.codecs import blake3_hash
from .operators import changes, dirty, recovery, writes
from .sources import image as im
from .sources import sinks

#: Issues of each kind that `check` prints before "... and N more".
SHOWN = 10
UNITS = {"": 1, "K": 1 << 10, "M": 1 << 20, "G": 1 << 30, "T": 1 << 40}


def parse_size(text: str) -> int:
    """Bytes, or a number with K, M, G or T."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)\s*([KMGT]?)(?:i?B)?", text.strip().upper().replace("IB", "B"))
    if not m:
        raise ValueError(f"no size: {text!r}")
    return int(float(m[1]) * UNITS[m[2]])


def format_size(n: int) -> str:
    for unit in ("T", "G", "M", "K"):
        if n >= UNITS[unit]:
            return f"{n / UNITS[unit]:.2f} {unit}iB"
    return f"{n} B"


def resolve(name: str, image: str) -> str:
    """Path of a backing or data file that an image names: relative names are beside the image."""
    name = name.removeprefix("json:").removeprefix("file:")
    return name if os.path.isabs(name) else os.path.normpath(os.path.join(os.path.dirname(os.path.abspath(image)), name))


class Opened:
    """An image's tables, defined lazily. The geometry comes from the header's first 512 bytes."""

    def __init__(self, spark: SparkSession, path: str, password: str | None = None, lenient: bool = False):
        if not os.path.exists(path):
            raise SystemExit(f"{path}: no file")
        head = im.header(im.Files(spark, [path], 9)).first()
        if head is None:
            raise SystemExit(f"{path}: no image")
        self.spark, self.path = spark, path
        self.bits, self.order, self.compression, self.size = head.cluster_bits, head.refcount_order, head.compression_type, head.virtual_size
        features = int(head.incompatible)
        self.extended, self.external = bool(features & changes.INCOMPATIBLE_EXTENDED), bool(features & changes.INCOMPATIBLE_DATA_FILE)
        self.files = im.Files(spark, [path], self.bits)
        self.header = im.header(self.files)
        self.backing = im.header(self.files).first().backing_file
        if not lenient:
            im.strict(im.file_violations(self.header, self.files.lengths()))
            im.strict(im.beyond_end(im.active_tables(self.header), self.files.lengths()))
            im.strict(im.beyond_end(im.l2_tables(self.l1(), self.bits, self.extended), self.files.lengths()))
        self.decrypt = self._cipher(head.crypt_method, password)

    def _cipher(self, method: int, password: str | None):
        if method == 0 or password is None:
            return None
        if method != 2:
            raise SystemExit("only LUKS encryption is read")
        data = {r.type_id: bytes(r.data) for r in im.extensions(self.files).collect()}[im.CRYPTO_EXTENSION]
        offset, length = int.from_bytes(data[:8], "big"), int.from_bytes(data[8:16], "big")
        with open(self.path, "rb") as f:
            f.seek(offset)
            raw = f.read(length)
        return ciphers.cluster_cipher(raw, password.encode())

    def l1(self) -> DataFrame:
        return im.l1_entries(im.active_tables(self.header), self.files, self.bits)

    def l2(self) -> DataFrame:
        return im.l2_entries(self.l1(), self.files, self.bits, extended=self.extended)

    def guest(self) -> DataFrame:
        """Clusters that this image holds itself. With an external data file, host offsets are places in that."""
        entries, files = self.l2(), self.files
        if self.external:
            names = {r.type_id: bytes(r.data) for r in im.extensions(self.files).collect()}
            if im.DATA_FILE_EXTENSION not in names:
                raise SystemExit(f"{self.path}: the data file has no name")
            data = resolve(names[im.DATA_FILE_EXTENSION].decode(), self.path)
            entries, files = entries.withColumn("image_id", F.lit(data)), im.Files(self.spark, [data], self.bits)
        return im.read_clusters(entries, files, self.bits, self.compression, self.decrypt)

    def chain(self) -> list[Opened]:
        """This image and those below it, nearest first; a loop is an error."""
        out, seen = [self], {os.path.abspath(self.path)}
        while out[-1].backing:
            path = resolve(out[-1].backing, out[-1].path)
            if os.path.abspath(path) in seen:
                raise SystemExit(f"{path}: the chain has a loop")
            seen.add(os.path.abspath(path))
            out.append(Opened(self.spark, path, lenient=True))
        return out

    def read_through(self) -> DataFrame:
        """Guest clusters of the whole chain (guest_cluster, bytes, error); all images must have clusters of one size."""
        chain = self.chain()
        if len({x.bits for x in chain}) > 1:
            raise SystemExit("images of a chain with clusters of several sizes")
        if len(chain) == 1:
            return self.guest()
        if any(x.extended for x in chain):
            raise SystemExit("subclusters of a chain are not merged")
        layers, sizes = None, []
        for depth, x in enumerate(chain):
            own = x.guest().select(F.lit(depth).alias("depth"), "guest_cluster", F.lit("standard").alias("kind"), "bytes", "error")
            layers = own if layers is None else layers.unionByName(own)
            sizes.append((depth, -(-x.size // (1 << x.bits))))
        near = writes.read_through(layers, self.spark.createDataFrame(sizes, "depth int, clusters long"))
        return near.join(layers.select("depth", "guest_cluster", "error"), ["depth", "guest_cluster"]).where(F.col("guest_cluster") < -(-self.size // (1 << self.bits)))

    def issues(self) -> DataFrame:
        """cluster_idx, stored, expected, kind of every count that is wrong, whether a block covers the cluster or not."""
        x = changes.differing(im.stored_refcounts(self.header, self.files, self.bits, self.order), im.expected_refcounts(self.header, self.files, self.bits, self.extended))
        return x.drop("image_id").withColumn("kind", F.when(F.col("stored") > F.col("expected"), "leak").otherwise("mismatch"))


def show(df: DataFrame, limit: int | None = None) -> None:
    rows = df.toLocalIterator() if limit is None else df.limit(limit).collect()
    for r in rows:
        print("  ".join(f"{k}={v.hex() if isinstance(v, (bytes, bytearray)) else v}" for k, v in r.asDict().items()))


def check(x: Opened) -> int:
    issues = x.issues().persist()
    counts = {r.kind: r["count"] for r in issues.groupBy("kind").count().collect()}
    for kind, n in sorted(counts.items()):
        print(f"{kind}: {n}")
        show(issues.where(F.col("kind") == kind).drop("kind").orderBy("cluster_idx"), SHOWN)
        if n > SHOWN:
            print(f"... and {n - SHOWN} more")
    if not counts:
        print("clean")
    return 1 if counts else 0


def write_guest(x: Opened, guest: DataFrame, target: str, to: str, packed: bool) -> None:
    guest = guest.persist()
    if not guest.where(F.col("error").isNotNull()).isEmpty():
        raise SystemExit(f"{x.path}: clusters that can't be read; see analyze")
    if to == "raw":
        sinks.write_raw(guest, target, x.size, 1 << x.bits)
    else:
        host, total = sinks.assemble(guest, x.size, x.bits, packed)
        sinks.write_clusters(host, target, 1 << x.bits, total)
    guest.unpersist()


def convert(spark: SparkSession, source: str, target: str, to: str, packed: bool, bits: int, password: str | None = None) -> None:
    with open(source, "rb") as f:
        magic = f.read(4) == b"QFI\xfb"
    if not magic:
        sinks.convert_raw(spark, source, target, bits, packed)
        return
    x = Opened(spark, source, password)
    write_guest(x, x.read_through(), target, to, packed)


def commit(spark: SparkSession, path: str) -> None:
    """The backing image becomes a new file that reads as the overlay does; then the overlay holds nothing."""
    x = Opened(spark, path)
    if not x.backing:
        raise SystemExit(f"{path}: no backing image")
    base = resolve(x.backing, path)
    below = Opened(spark, base)
    if below.size < x.size:
        raise SystemExit("the backing image is smaller; resize it first")
    if changes.Editor(base).get("snapshots"):
        raise SystemExit("the backing image has snapshots, which a new file would lose")
    own = x.guest()
    rest = below.guest().join(own.select("guest_cluster"), "guest_cluster", "left_anti").select("guest_cluster", "bytes", "error")
    guest = rest.unionByName(own.select("guest_cluster", "bytes", "error"))
    write_guest(below, guest, base + ".new", "image", False)
    if below.backing:
        changes.rebase(base + ".new", below.backing)
    os.replace(base + ".new", base)
    empty, total = sinks.assemble(guest.limit(0), x.size, x.bits, backing=x.backing)
    sinks.write_clusters(empty, path + ".new", 1 << x.bits, total)
    os.replace(path + ".new", path)


def recover(spark: SparkSession, path: str, target: str, bits: int | None) -> None:
    """A raw file of what the tables found in a damaged image map, whatever its header says."""
    files = im.Files(spark, [path], bits or recovery.detect(spark, path))
    name, score, entries = recovery.reconstruct(files)
    print(f"hypothesis={name} score={score} cluster_bits={files.cluster_bits}")
    guest = im.read_clusters(entries, files, files.cluster_bits).select("guest_cluster", "bytes")
    sinks.write_raw(guest, target, (guest.agg(F.max("guest_cluster")).first()[0] + 1) << files.cluster_bits, 1 << files.cluster_bits)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="cowlens")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "analyze", "commit"):
        sub.add_parser(name).add_argument("path")
    k = sub.add_parser("check")
    k.add_argument("path")
    k.add_argument("--repair", choices=("leaks", "all"))
    d = sub.add_parser("dump")
    d.add_argument("table", choices=("l1", "l2", "refcounts"))
    d.add_argument("path")
    s = sub.add_parser("snapshot")
    s.add_argument("action", choices=("list", "create", "apply", "delete"))
    s.add_argument("path")
    s.add_argument("name", nargs="?")
    b = sub.add_parser("bitmap")
    b.add_argument("action", choices=("list", "create", "delete", "enable", "disable", "dump"))
    b.add_argument("path")
    b.add_argument("name", nargs="?")
    b.add_argument("--granularity-bits", type=int, default=16)
    h = sub.add_parser("hash", help="BLAKE3 of the guest's clusters that are stored")
    h.add_argument("path")
    r = sub.add_parser("resize")
    r.add_argument("path")
    r.add_argument("size", type=parse_size)
    e = sub.add_parser("rebase", help="changes the backing name only")
    e.add_argument("path")
    e.add_argument("backing", nargs="?")
    c = sub.add_parser("convert", help="raw to image, image to raw, or image to image, which is a compaction; chains are flattened")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--to", choices=("raw", "image"), default="image")
    c.add_argument("--packed", action="store_true")
    c.add_argument("--cluster-bits", type=int, default=16)
    c.add_argument("--password")
    v = sub.add_parser("recover")
    v.add_argument("path")
    v.add_argument("target")
    v.add_argument("--cluster-bits", type=int)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("cowlens").getOrCreate()
    try:
        return run(spark, a)
    except ValueError as error:
        raise SystemExit(f"{error}") from error


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.command == "convert":
        convert(spark, a.source, a.target, a.to, a.packed, a.cluster_bits, a.password)
    elif a.command == "commit":
        commit(spark, a.path)
    elif a.command == "recover":
        recover(spark, a.path, a.target, a.cluster_bits)
    elif a.command == "resize":
        changes.resize(spark, a.path, a.size)
    elif a.command == "rebase":
        changes.rebase(a.path, a.backing)
    elif a.command == "info":
        x = Opened(spark, a.path, lenient=True)
        show(x.header)
        show(im.extensions(x.files))
        print(f"size: {format_size(x.size)}")
    elif a.command == "check":
        if a.repair:
            print("  ".join(f"{k}={v}" for k, v in changes.recount(spark, a.path, a.repair == "leaks").items()))
        return check(Opened(spark, a.path, lenient=True))
    elif a.command == "dump":
        x = Opened(spark, a.path, lenient=True)
        table = {"l1": x.l1, "l2": x.l2, "refcounts": lambda: im.stored_refcounts(x.header, x.files, x.bits, x.order)}[a.table]()
        show(table.orderBy({"l1": "l1_index", "l2": "guest_cluster", "refcounts": "cluster_idx"}[a.table]))
    elif a.command == "hash":
        show(Opened(spark, a.path).guest().select("guest_cluster", F.hex(blake3_hash(F.col("bytes"))).alias("hash")).orderBy("guest_cluster"))
    elif a.command == "analyze":
        x = Opened(spark, a.path, lenient=True)
        show(recovery.summary(recovery.classify(recovery.statistics(x.files.all(), x.bits, os.path.getsize(a.path)), x.bits)).orderBy("kind"))
    elif a.command == "snapshot":
        if a.action == "list":
            x = Opened(spark, a.path, lenient=True)
            show(im.snapshots(x.header, x.files, x.bits).orderBy("snap_idx"))
        else:
            {"create": changes.snapshot_create, "apply": changes.snapshot_apply, "delete": changes.snapshot_delete}[a.action](spark, a.path, a.name or "")
    elif a.command == "bitmap":
        bitmap(spark, a)
    return 0


def bitmap(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.action == "create":
        changes.bitmap_create(spark, a.path, a.name or "", a.granularity_bits)
    elif a.action == "delete":
        changes.bitmap_delete(spark, a.path, a.name)
    elif a.action in ("enable", "disable"):
        changes.bitmap_flag(a.path, a.name, a.action == "enable")
    else:
        x = Opened(spark, a.path, lenient=True)
        directory = im.bitmap_directory(im.extensions(x.files), x.files, x.bits)
        if a.action == "list":
            show(directory)
            return
        own = directory.where(F.col("name") == a.name)
        row = own.first()
        if row is None:
            raise SystemExit(f"no bitmap {a.name}")
        regions = dirty.regions(im.dirty_granules(own, x.files, x.bits), 1 << row.granularity_bits, x.size)
        show(regions.orderBy("start_offset"))
        show(dirty.totals(regions))


if __name__ == "__main__":
    sys.exit(main())
