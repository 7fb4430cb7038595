"""Writes, layered reads and recovery on real images."""

import random

import pytest
from pyspark.sql import functions as F

from cowlens.operators import chains, recovery, writes
from cowlens.sources import image as im
from cowlens.sources.build import Image, build

BITS, SIZE = 12, 4096


def test_writes_equal_a_byte_array(spark):
    r = random.Random(1)
    disk, base = bytearray(60 * SIZE), {}
    for g in r.sample(range(60), 20):
        base[g] = r.randbytes(SIZE)
        disk[g * SIZE : (g + 1) * SIZE] = base[g]
    ws = []
    for seq in range(60):
        data = r.randbytes(r.choice([0, 1, 100, SIZE, 3 * SIZE + 5]))
        at = r.randrange(0, 56 * SIZE)
        disk[at : at + len(data)] = data
        ws.append(("i", at, seq, data))
    b = spark.createDataFrame([("i", g, d) for g, d in base.items()], "image_id string, guest_cluster long, bytes binary")
    w = spark.createDataFrame(ws, "image_id string, offset_bytes long, seq long, data binary")
    v = writes.new_version(b, writes.apply_writes(b, w, SIZE)).persist()
    got = bytearray(60 * SIZE)
    for x in v.collect():
        got[x.guest_cluster * SIZE : (x.guest_cluster + 1) * SIZE] = x.bytes
    assert got == disk
    for at, n in ((0, 10), (SIZE - 3, 2 * SIZE), (5000, 1)):
        assert b"".join(bytes(x.bytes) for x in writes.read_range(v, at, n, SIZE).orderBy("piece").collect()) == bytes(disk[at : at + n])


def test_layers_and_forest(spark, tmp_path):
    leaf = Image(100 * SIZE, BITS, {1: b"L" * SIZE, 2: None, 60: b"M" * SIZE}, backing="base.qcow2")
    base = Image(50 * SIZE, BITS, {1: b"B" * SIZE, 2: b"C" * SIZE, 3: b"D" * SIZE})
    (tmp_path / "leaf.qcow2").write_bytes(build(leaf))
    (tmp_path / "base.qcow2").write_bytes(build(base))
    (tmp_path / "note.txt").write_bytes(b"no image")
    assert im.discover(spark, str(tmp_path)).count() == 2
    c = im.clusters(spark, str(tmp_path), BITS, "*.qcow2")
    head = im.header(c)
    f = recovery.forest(head.select("image_id", "backing_file"))
    links = f.select(F.element_at(F.split("node", "/"), -1).alias("node"), F.element_at(F.split("parent", "/"), -1).alias("parent"))
    assert {(x.node, x.depth) for x in chains.depths(links).collect()} == {("base.qcow2", 0), ("leaf.qcow2", 1)}
    l2 = im.l2_entries(im.l1_entries(im.active_tables(head), c, BITS), c, BITS)
    data = im.read_clusters(l2, c, BITS).join(l2.select("image_id", "guest_cluster", "kind"), ["image_id", "guest_cluster"])
    layers = data.withColumn("depth", F.when(F.col("image_id").endswith("leaf.qcow2"), 0).otherwise(1))
    sizes = spark.createDataFrame([(0, 100), (1, 50)], "depth int, clusters long")
    got = {x.guest_cluster: (x.depth, bytes(x.bytes)[:1]) for x in writes.read_through(layers, sizes).collect()}
    assert got == {1: (0, b"L"), 2: (0, b"\0"), 3: (1, b"D"), 60: (0, b"M")}


def test_recovery_classes(spark, tmp_path):
    r = random.Random(2)
    x = Image(3000 * SIZE, BITS, {g: r.randbytes(SIZE) for g in r.sample(range(3000), 120)}, set())
    raw = bytearray(build(x))
    (tmp_path / "a.qcow2").write_bytes(raw)
    c = im.clusters(spark, str(tmp_path), BITS)
    k = recovery.classify(recovery.statistics(c, BITS), BITS)
    got = {y.cluster_idx: y.kind for y in k.collect()}
    head = im.header(c)
    l1 = im.l1_entries(im.active_tables(head), c, BITS)
    l2 = im.l2_entries(l1, c, BITS)
    assert got[0] == "header"
    assert all(got[y.l2_offset // SIZE] in ("l2", "l1") for y in l1.collect())
    assert all(got[y.host_offset // SIZE] == "data" for y in l2.collect())
    assert got[head.first().l1_offset // SIZE] == "l1"
    raw[:SIZE] = bytes(SIZE)
    (tmp_path / "a.qcow2").write_bytes(raw)
    assert {y.kind for y in recovery.classify(recovery.statistics(im.clusters(spark, str(tmp_path), BITS), BITS), BITS).where("cluster_idx = 0").collect()} == {"empty"}
    found = spark.createDataFrame([("i", 4096), ("i", 8192), ("i", 1 << 20)], "image_id string, offset long")
    own = spark.createDataFrame([("i", 8192, 5)], "image_id string, l2_offset long, l1_index long")
    assert {(y.offset, y.l1_index, y.exact) for y in recovery.orphan_tables(found, own).collect()} == {(8192, 5, True), (4096, 0, False), (1 << 20, 1, False)}


def test_snapshot_names(spark):
    e = spark.createDataFrame([("i", "active", 1, True), ("i", "old", 1, False)], "image_id string, table_id string, guest_cluster long, copied boolean")
    assert writes.snapshot(e, "i", "new", e).collect() == [("i", "new", 1, False)]
    for bad in ("", "old"):
        with pytest.raises(ValueError):
            writes.snapshot(e, "i", bad, e)
    s = spark.createDataFrame([("i", 0, "2", "a"), ("i", 1, "1", "2")], "image_id string, snap_idx long, id string, name string")
    assert writes.find_snapshot(s, "2").first().snap_idx == 1 and writes.find_snapshot(s, "1").first().snap_idx == 1
