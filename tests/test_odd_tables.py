"""Queries over tables that the small data don't have: products beyond 64 bits, more orphans than slots, short texts."""

import hashlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cowlens.operators import writes
from cowlens.plans import catalogue, images
from cowlens.sources import image as im
from cowlens.sources import sinks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_descriptor_of_a_product_beyond_64_bits(spark, tmp_path):
    keys = (0, 1, 29_183, 29_184, 150_001, 900_000, 36_000_000)
    spark.createDataFrame([(k, 1) for k in keys], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.l1_offset: (r.host_offset, r["bytes"]) for r in catalogue.QUERIES["q_descriptor_decode"](spark, str(tmp_path)).collect()}
    words = {k * 256: k * 256 * 1_234_567_890_123 % (1 << 62) for k in keys}
    assert got == {at: (w & (1 << 54) - 1, ((w >> 54) + 1) * 512 - (w & 511)) for at, w in words.items()}


def test_orphans_beyond_the_slots(spark, tmp_path):
    spark.range(20_300).select(F.col("id").alias("p_partkey"), F.lit(1).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    row = F.struct((F.col("id") * 7).alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(0).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"), F.lit("A").alias("l_returnflag"), F.lit("O").alias("l_linestatus"), F.lit(1.0).alias("l_quantity"))
    spark.range(90).select(row.alias("r")).select("r.*").write.parquet(f"{tmp_path}/lineitem.parquet")
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = c.sql(catalogue.ORACLES["q_orphan_assign"]).fetchall()
    assert len(want) == 20_000 - 90
    assert sorted(map(tuple, catalogue.QUERIES["q_orphan_assign"](spark, str(tmp_path)).collect())) == sorted(want)
    assert catalogue.QUERIES["q_orphan_assign_images"](spark, str(tmp_path)).count() == 20_300 - 90  # loses none


@pytest.mark.parametrize("last", ["hello", "documentd"])
def test_short_texts_are_no_tables(spark, tmp_path, last):
    """The last table has one entry, and what it points at reads as a table if any word that begins with a letter may."""
    texts = [(i, f"some text of number {i} and more") for i in range(342)] + [(342, last), (343, None), (344, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.guest_cluster, r.sha) for r in images.QUERIES["q_image_recover"](spark, str(tmp_path)).collect()}
    assert got == {(3 * i, hashlib.sha256(t.encode().ljust(4096, b"\0")).hexdigest()) for i, t in texts if t}


def test_layers_are_chosen_before_bytes_are_read(spark, tmp_path):
    guest = spark.range(40).select((F.col("id") * 3).alias("guest_cluster"), F.col("id").cast("string").cast("binary").alias("bytes"))
    host, total = sinks.assemble(guest, 200 << 12, 12)
    sinks.write_clusters(host, f"{tmp_path}/a.img", 4096, total)
    files = im.Files(spark, [f"{tmp_path}/a.img"], 12)
    e = images.entries(files).select("*", F.lit(0).alias("depth"))
    near = writes.read_through(e, spark.createDataFrame([(0, 100)], "depth int, clusters long"))
    got = {r.guest_cluster: bytes(r.bytes).rstrip(b"\0") for r in im.read_clusters(near, files, 12).collect()}
    assert got == {3 * k: str(k).encode() for k in range(34)}


def test_no_exchange_carries_whole_texts_or_padding(spark, tmp_path):
    text = "x" * 3000
    spark.createDataFrame([(i, text + str(i)) for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    x = images.Folder(spark, str(tmp_path))
    assert "Exchange" not in plan(x.guest()) and x.guest().count() == 50
    assert {len(r.text) for r in x.texts().collect()} == {1000}
    content = F.repeat(F.lit("ab"), F.col("guest_cluster").cast("int")).cast("binary")
    host, total = sinks.assemble(spark.range(5).select((F.col("id") + 1).alias("guest_cluster")), 10 << 12, 12, content=content)
    sinks.write_clusters(host, f"{x.path}/a.img", 4096, total)
    files = im.Files(spark, [f"{x.path}/a.img"], 12)
    assert {r.guest_cluster: bytes(r.bytes).rstrip(b"\0") for r in im.read_clusters(images.entries(files), files, 12).collect()} == {k: b"ab" * k for k in range(1, 6)}


def test_subclusters_are_cut_where_they_are_read(spark, tmp_path):
    """One pass in Python, so no batch of thousands of whole clusters goes from one worker to the next."""
    guest = spark.range(70).select(F.col("id").alias("guest_cluster"), F.lit(1).cast("long").alias("alloc"), F.lit(2).cast("long").alias("zero"))
    host, total = sinks.assemble(guest, 100 << 14, 14, extended=True, content=F.lit(b"z" * (1 << 14)))
    sinks.write_clusters(host, f"{tmp_path}/a.img", 1 << 14, total)
    files = im.Files(spark, [f"{tmp_path}/a.img"], 14)
    e = images.entries(files, extended=True)
    e = spark.createDataFrame(e.collect(), e.schema)
    got = im.read_clusters(e, files, 14)
    assert sum("MapInArrow" in line for line in plan(got).splitlines()) == 2  # plain and compressed entries
    assert {(bytes(r.bytes), r.below, r.error) for r in got.collect()} == {(b"z" * 512 + bytes((1 << 14) - 512), 0xFFFFFFFC, None)}
    assert got.count() == 70
    lost = e.limit(1).withColumn("host_offset", F.lit(None).cast("long"))
    assert [r.error for r in im.read_clusters(lost, files, 14).collect()] == ["subcluster without a cluster"]
