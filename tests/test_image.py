"""Images built in Python, decoded with Spark, compared with what was put in."""

import random

import pytest
from pyspark.sql import functions as F

from cowlens.functions.blake3 import blake3
from cowlens.functions.codecs import DEFLATE, ZSTD, compress, decompress
from cowlens.sources import image as im
from cowlens.sources.build import Image, Snapshot, build

BITS = 12
SIZE = 1 << BITS


def content(seed, n=40):
    r = random.Random(seed)
    return {g: (None if g % 7 == 3 else r.randbytes(64) * (SIZE // 64)) for g in r.sample(range(1500), n)}


def make(order=4, compression=0, version=3):
    base = content(1)
    old = content(2, 12) | {g: base[g] for g in list(base)[:10]}
    return Image(2000 * SIZE, BITS, base, set(list(base)[::3]), [Snapshot("1", "first", old), Snapshot("2", "zweité"[:5] + "e", content(3, 5))], refcount_order=order, compression=compression, version=version, extensions=[(0x6803F857, b"abc"), (0x1234, b"")])


@pytest.fixture(params=[(4, 0), (0, 0), (3, 1), (6, 0)])
def loaded(request, spark, tmp_path):
    order, compression = request.param
    x = make(order, compression)
    if order == 0:
        x.snapshots = []  # one bit counts to one
        x.clusters = {g: (d if d is None else d[:-8] + g.to_bytes(8, "big")) for g, d in x.clusters.items()}
    (tmp_path / "a.qcow2").write_bytes(build(x))
    c = im.clusters(spark, str(tmp_path), BITS, "*.qcow2")
    return x, c, im.header(c), order, compression


def test_header_and_extensions(loaded):
    x, c, head, order, compression = loaded
    h = head.first()
    assert (h.version, h.cluster_bits, h.virtual_size, h.refcount_order, h.compression_type) == (3, BITS, x.virtual_size, order, compression)
    assert [(r.pos, r.type_id, bytes(r.data)) for r in im.extensions(c).orderBy("pos").collect()] == [(0, 0x6803F857, b"abc"), (1, 0x1234, b"")]


def test_guest_bytes(loaded):
    x, c, head, _, compression = loaded
    l2 = im.l2_entries(im.l1_entries(im.active_tables(head), c, BITS), c, BITS)
    got = {r.guest_cluster: bytes(r.bytes) for r in im.read_clusters(l2, c, BITS, compression).collect() if r.error is None}
    assert got == {g: d or bytes(SIZE) for g, d in x.clusters.items()}
    kinds = {r.guest_cluster: r.kind for r in l2.collect()}
    assert all((kinds[g] == "zero") == (d is None) for g, d in x.clusters.items())


def test_refcounts_agree(loaded):
    x, c, head, order, _ = loaded
    stored = {r.cluster_idx: int(r.stored) for r in im.stored_refcounts(head, c, BITS, order).collect()}
    expected = {r.cluster_idx: r.expected for r in im.expected_refcounts(head, c, BITS).collect()}
    assert stored == expected


def test_snapshots(loaded):
    x, c, head, _, _ = loaded
    rows = im.snapshots(head, c, BITS).orderBy("snap_idx").collect()
    assert [(r.id, r.name, r.virtual_disk_size) for r in rows] == [(s.id, s.name, x.virtual_size) for s in x.snapshots]
    if rows:
        roots = im.snapshots(head, c, BITS).select("image_id", F.col("id").alias("table_id"), F.col("l1_offset").alias("offset"), F.col("l1_entries").alias("entries"))
        l2 = im.l2_entries(im.l1_entries(roots, c, BITS), c, BITS)
        got = {(r.table_id, r.guest_cluster): bytes(r.bytes) for r in im.read_clusters(l2, c, BITS).collect()}
        assert got == {(s.id, g): d or bytes(SIZE) for s in x.snapshots for g, d in s.clusters.items()}


def test_ranged_source(spark, tmp_path):
    x = make()
    p = tmp_path / "b.qcow2"
    p.write_bytes(build(x))
    im.register(spark)
    a = spark.read.format("cowlens_image").option("path", str(p)).option("clusterbits", str(BITS)).load()
    b = im.clusters(spark, str(p), BITS)
    assert {(r.cluster_idx, bytes(r.bytes)) for r in a.collect()} == {(r.cluster_idx, bytes(r.bytes)) for r in b.collect()}


def test_damaged_stream_is_data(spark, tmp_path):
    x = Image(100 * SIZE, BITS, {5: b"ab" * (SIZE // 2)}, {5})
    raw = bytearray(build(x))
    packed = compress(x.clusters[5])
    at = raw.find(packed)
    raw[at : at + len(packed)] = b"\xff" * len(packed)
    (tmp_path / "c.qcow2").write_bytes(raw)
    c = im.clusters(spark, str(tmp_path), BITS)
    l2 = im.l2_entries(im.l1_entries(im.active_tables(im.header(c)), c, BITS), c, BITS)
    row = im.read_clusters(l2, c, BITS).first()
    assert row.error and bytes(row.bytes) == bytes(SIZE)


@pytest.mark.parametrize("kind", [DEFLATE, ZSTD])
def test_codec_round_trip(kind):
    data = random.Random(4).randbytes(100) * 50
    assert decompress(compress(data, kind) + bytes(300), len(data), kind) == data


def test_blake3_vectors():
    f = lambda n: blake3(bytes(i % 251 for i in range(n))).hex()
    assert f(0) == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert f(1025) == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"
    assert f(2049) == "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"
