"""Queries that write image files from the tables and read them back: real files through real readers, writers and repairs.

Each document's first 1000 characters are one guest cluster, padded with zeros, at three times its doc_id. Files go to the
cluster's shared folder, which all workers mount.
"""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bits as fb
from ..functions import codecs
from ..operators import changes, recovery, writes
from ..shipping import shared_folder, ship
from ..sources import image as im
from ..sources import sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
BITS = 12
SIZE = 1 << BITS

_TEXTS = "texts as (select doc_id, min(text) as text from documents where length(text) > 0 and doc_id is not null group by doc_id)"
_PADDED = f"unhex(hex(encode(left(text, 1000))) || repeat('00', cast({SIZE} - octet_length(encode(left(text, 1000))) as int)))"
_GUEST = f"with {_TEXTS}, guest as (select doc_id, doc_id * 3 as guest_cluster, sha256({_PADDED}) as sha from texts)"


class Folder:
    """The tables, and a new folder for the files of one query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        ship(spark)
        self.spark, self.sf_dir = spark, sf_dir
        url = urlparse(shared_folder(spark, "images"))
        if url.scheme not in ("", "file"):
            raise ValueError("image files need a folder that all workers mount")
        self.path = unquote(url.path)
        os.makedirs(self.path)
        self._texts: DataFrame | None = None

    def texts(self) -> DataFrame:
        """doc_id and the first 1000 characters of its least text, written once. The least prefix is the least text's, so no
        exchange carries whole texts."""
        if self._texts is None:
            d = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet").where("length(text) > 0 and doc_id is not null")
            d = d.select("doc_id", F.substring("text", 1, 1000).alias("text")).groupBy("doc_id").agg(F.min("text").alias("text"))
            table = f"{shared_folder(self.spark, 'texts')}"
            d.write.parquet(table)
            self._texts = self.spark.read.schema(d.schema).parquet(table)
        return self._texts

    def raw(self) -> DataFrame:
        """The guest clusters without their padding."""
        return self.texts().select((F.col("doc_id") * 3).alias("guest_cluster"), F.encode("text", "UTF-8").alias("bytes"))

    def guest(self) -> DataFrame:
        return self.raw().withColumn("bytes", F.rpad("bytes", SIZE, F.lit(b"\0")))

    def virtual_size(self, guest: DataFrame) -> int:
        return ((guest.agg(F.max("guest_cluster")).first()[0] or 0) + 1) * SIZE

    def build(self, name: str, guest: DataFrame | None = None, bits: int = BITS, **options) -> str:
        """Path of an image of the guest clusters."""
        guest = self.raw() if guest is None else guest
        path = f"{self.path}/{name}"
        host, total = sinks.assemble(guest, self.virtual_size(guest) // SIZE << bits, bits, **options)
        sinks.write_clusters(host, path, 1 << bits, total)
        return path

    def files(self, path: str, bits: int = BITS) -> im.Files:
        return im.Files(self.spark, [path], bits)


def query(sql: str):
    """Registers a function of Folder as q_<name>, with its SQL."""

    def add(f):
        name = f"q_{f.__name__}"
        QUERIES[name] = lambda spark, sf_dir: f(Folder(spark, sf_dir))
        ORACLES[name] = sql
        return f

    return add


def entries(files: im.Files, extended: bool = False) -> DataFrame:
    l1 = im.l1_entries(im.active_tables(im.header(files)), files, files.cluster_bits)
    return im.l2_entries(l1, files, files.cluster_bits, extended=extended)


def hashed(guest: DataFrame, *columns: str) -> DataFrame:
    return guest.select("guest_cluster", *columns, F.sha2("bytes", 256).alias("sha"))


@query(f"{_GUEST} select guest_cluster, 'standard' as kind, true as copied, sha, null::varchar as error from guest")
def image_guest(x: Folder) -> DataFrame:
    """Image sink, then header, both levels of tables and guest bytes by ranged reads."""
    files = x.files(x.build("a.img"))
    e = entries(files)
    return hashed(im.read_clusters(e, files, BITS).join(e.select("guest_cluster", "kind", "copied"), "guest_cluster"), "kind", "copied", "error")


@query(f"{_GUEST} select guest_cluster, 'compressed' as kind, false as copied, sha, null::varchar as error from guest")
def image_packed(x: Folder) -> DataFrame:
    """The same, compressed and packed several to a host cluster."""
    files = x.files(x.build("a.img", packed=True))
    e = entries(files)
    return hashed(im.read_clusters(e, files, BITS).join(e.select("guest_cluster", "kind", "copied"), "guest_cluster"), "kind", "copied", "error")


@query(f"{_GUEST} select 'data clusters counted once' as what, count(*) as n from guest union all select 'counts that differ', 0 union all select 'rules broken', 0 union all select 'images found', 2")
def image_counts(x: Folder) -> DataFrame:
    """Stored counts against those that all references make, of a plain and a packed image; header against file; discovery."""
    plain, packed = x.build("a.img"), x.build("b.img", packed=True)
    with open(f"{x.path}/c.txt", "w") as f:
        f.write("no image")
    out = []
    for path in (plain, packed):
        files = x.files(path)
        head = im.header(files)
        out.append((files, head, im.stored_refcounts(head, files, BITS, 4)))
    files, head, stored = out[0]
    one = entries(files).select("image_id", F.shiftright("host_offset", BITS).alias("cluster_idx")).join(stored.where("stored = 1"), ["image_id", "cluster_idx"])
    wrong = [changes.differing(s, im.expected_refcounts(h, f, BITS)) for f, h, s in out]
    rules = [im.file_violations(h, f.lengths()).select("image_id") for f, h, _ in out]
    row = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    return row("data clusters counted once", one).unionByName(row("counts that differ", wrong[0].unionByName(wrong[1]))).unionByName(row("rules broken", rules[0].unionByName(rules[1]))).unionByName(row("images found", im.discover(x.spark, x.path)))


_SUB = """with d as (select distinct doc_id, doc_id * 3 as guest_cluster, doc_id % 32 as a, (doc_id + 7) % 32 as z from documents where length(text) > 0 and doc_id is not null)
select guest_cluster, array_to_string(list_transform(range(0, 32), lambda i: case when i = a then 'U' when i = z then 'Z' else 'A' end), '') as states, cast(1 as bigint) << a as below,
  sha256(unhex(array_to_string(list_transform(range(0, 32), lambda i: case when i = a or i = z then repeat('00', 512) else hex(repeat(lpad(cast(doc_id as varchar), 8, '0'), 64)) end), ''))) as sha from d"""


@query(_SUB)
def image_subclusters(x: Folder) -> DataFrame:
    """Extended entries: one subcluster of each cluster is left to the layer below, another is zero."""
    one = lambda k: F.expr(f"shiftleft(1L, cast((doc_id + {k}) % 32 as int))")
    guest = x.texts().select("doc_id", (F.col("doc_id") * 3).alias("guest_cluster"), (F.lit(fb.LOW32) - one(0) - one(7)).alias("alloc"), one(7).alias("zero"))
    content = F.repeat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(2048)).cast("binary")
    files = x.files(x.build("a.img", guest, 14, extended=True, content=content), 14)
    e = entries(files, extended=True)
    got = im.read_clusters(e, files, 14).join(e.select("guest_cluster", fb.state_map(F.col("alloc"), F.col("zero")).alias("states")), "guest_cluster")
    return hashed(got, "states", "below")


@query(f"{_GUEST} select guest_cluster, case when doc_id % 2 = 0 then 0 else 1 end as depth, case when doc_id % 2 = 0 then sha256(unhex(hex(encode(cast(doc_id as varchar))) || repeat('00', {SIZE} - length(cast(doc_id as varchar))))) else sha end as sha from guest")
def image_overlay(x: Folder) -> DataFrame:
    """A chain of two images: the overlay holds the even documents' clusters, the image below all."""
    base = x.build("base.img")
    own = x.texts().where("doc_id % 2 = 0").select((F.col("doc_id") * 3).alias("guest_cluster"), F.col("doc_id").cast("string").cast("binary").alias("bytes"))
    overlay = x.build("overlay.img", own, backing="base.img")
    files = im.Files(x.spark, [overlay, base], BITS)
    heads = {h.image_id: h for h in im.header(files).collect()}  # two rows
    named = heads[overlay].backing_file
    if os.path.join(x.path, named) != base:
        raise ValueError(named)
    depth = F.when(F.col("image_id") == overlay, 0).otherwise(1).alias("depth")
    sizes = x.spark.createDataFrame([(d, heads[p].virtual_size // SIZE) for d, p in enumerate(files.paths)], "depth int, clusters long")
    near = writes.read_through(entries(files).select("*", depth), sizes)  # entries only: bytes are read where they are taken
    return hashed(im.read_clusters(near, files, BITS).select("*", depth), "depth")


@query(f"{_GUEST} select guest_cluster, sha from guest")
def raw_round_trip(x: Folder) -> DataFrame:
    """Raw sink, ranged raw source, image of that, and raw again."""
    guest = x.guest()
    sinks.write_raw(guest, f"{x.path}/a.raw", x.virtual_size(guest), SIZE)
    sinks.convert_raw(x.spark, f"{x.path}/a.raw", f"{x.path}/a.img", BITS)
    files = x.files(f"{x.path}/a.img")
    sinks.write_raw(im.read_clusters(entries(files), files, BITS), f"{x.path}/b.raw", x.virtual_size(guest), SIZE)
    raw = x.files(f"{x.path}/b.raw").all().where(~codecs.is_zero(F.col("bytes")))
    return hashed(raw.withColumnRenamed("cluster_idx", "guest_cluster"))


@query(f"{_GUEST} select guest_cluster, sha from guest")
def image_recover(x: Folder) -> DataFrame:
    """An image whose level-1 table and header are wiped: cluster size by score, tables by scan, the best hypothesis."""
    path = x.build("a.img")
    e = changes.Editor(path)
    e.write(e.get("l1_offset"), bytes(e.get("l1_entries") * 8))
    e.write(0, b"lost")
    bits = recovery.detect(x.spark, path)
    files = x.files(path, bits)
    _, _, found = recovery.reconstruct(files)
    return hashed(im.read_clusters(found, files, bits))


@query(f"""{_GUEST}, s(step, snapshots, bitmaps, grown) as (values ('built', 0, 0, 0), ('snapshot created', 1, 0, 0), ('snapshot deleted, bitmap created', 0, 1, 0), ('size grown', 0, 1, 1), ('counts wiped and repaired', 0, 1, 1))
select step, cast(snapshots as bigint) as snapshots, cast(bitmaps as bigint) as bitmaps, (select max(guest_cluster) + 1 from guest) * (1 + 3 * grown) as clusters, cast(0 as bigint) as wrong_counts, cast(0 as bigint) as wrong_flags,
  (select count(*) from guest) as stored from s""")
def image_changes(x: Folder) -> DataFrame:
    """Changes in place; after each, the counts and flags that are wrong, and what the image says."""
    spark, path = x.spark, x.build("a.img")
    size, out = changes.Editor(path).get("virtual_size"), None

    def state(step: str) -> DataFrame:
        files = x.files(path)
        head = im.header(files)
        tables = tuple(t.persist() for t in im.all_tables(head, files, BITS))
        expected = im.expected_refcounts(head, files, BITS, tables=tables).persist()
        n = lambda df: df.agg(F.count("*").alias("n")).first()[0]
        row = (step, n(im.snapshots(head, files, BITS)), n(im.bitmap_directory(im.extensions(files), files, BITS)), head.first().virtual_size // SIZE, n(changes.differing(im.stored_refcounts(head, files, BITS, 4), expected)), n(changes.wrong_flags(expected, tables, BITS, False)), n(entries(files)))
        for t in (*tables, expected):
            t.unpersist()
        return spark.createDataFrame([row], "step string, snapshots long, bitmaps long, clusters long, wrong_counts long, wrong_flags long, stored long")

    def wipe() -> None:
        e = changes.Editor(path)
        first = int(e.words(e.get("table_offset"), 1)[0])
        e.write(first, bytes(SIZE))
        changes.recount(spark, path)

    steps = {
        "built": lambda: None,
        "snapshot created": lambda: changes.snapshot_create(spark, path, "one"),
        "snapshot deleted, bitmap created": lambda: (changes.snapshot_delete(spark, path, "one"), changes.bitmap_create(spark, path, "marks", 12)),
        "size grown": lambda: changes.resize(spark, path, 4 * size),
        "counts wiped and repaired": wipe,
    }
    for step, change in steps.items():
        change()
        out = state(step) if out is None else out.unionByName(state(step))
    return out


_PIECE = "repeat(lpad(cast(event_id as varchar), 8, '0'), 64)"


@query(f"""with w as (select event_id, event_id as guest_cluster, (user_id % 200) * 16 as intra, {_PIECE} as data, event_id % 3 = 0 as based from events)
select guest_cluster, sha256(unhex(repeat(case when based then '62' else '00' end, cast(intra as int)) || hex(data) || repeat(case when based then '62' else '00' end, cast({SIZE} - 512 - intra as int)))) as sha from w""")
def write_pieces(x: Folder) -> DataFrame:
    """Partial writes over clusters that are there or not: read, modify, write as a new version."""
    e = x.spark.read.parquet(f"{x.sf_dir}/events.parquet")
    data = F.repeat(F.lpad(F.col("event_id").cast("string"), 8, "0"), F.lit(64)).cast("binary")
    w = e.select(F.lit("a").alias("image_id"), (F.col("event_id") * SIZE + F.col("user_id") % 200 * 16).alias("offset_bytes"), F.lit(0).alias("seq"), data.alias("data"))
    base = e.where("event_id % 3 = 0").select(F.lit("a").alias("image_id"), F.col("event_id").alias("guest_cluster"), F.lit(b"b" * SIZE).alias("bytes"))
    return hashed(writes.new_version(base, writes.apply_writes(base, w, SIZE)))


@query("select doc_id, sha256(text) as deflate, sha256(text) as zstd from documents where length(text) > 0")
def codec_round_trip(x: Folder) -> DataFrame:
    """Both codecs, there and back."""
    d = x.spark.read.parquet(f"{x.sf_dir}/documents.parquet").where("length(text) > 0").select("doc_id", F.col("text").cast("binary").alias("raw"))
    back = lambda kind: F.sha2(codecs.inflate(codecs.packed(F.col("raw"), kind), F.octet_length("raw"), kind)["bytes"], 256)
    return d.select("doc_id", back(codecs.DEFLATE).alias("deflate"), back(codecs.ZSTD).alias("zstd"))


@query(f"{_GUEST} select guest_cluster, sha from guest")
def report_json(x: Folder) -> DataFrame:
    """A report as JSON lines, read again."""
    sinks.write_report(hashed(x.guest()), f"{x.path}/report")
    return x.spark.read.schema("guest_cluster long, sha string").json(f"{x.path}/report")
