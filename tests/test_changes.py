"""Changes in place, large sparse files, strict mode, encryption, external data, subclusters and recovery on real files."""

import hashlib
import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from cowlens import cli
from cowlens.functions import ciphers
from cowlens.operators import changes, recovery
from cowlens.sources import image as im
from cowlens.sources import sinks
from cowlens.sources.build import Image, Snapshot, build

from .test_ciphers import luks1

BITS = 12
SIZE = 1 << BITS


def random_image(seed=1, n=30, **more):
    r = random.Random(seed)
    return Image(900 * SIZE, BITS, {g: r.randbytes(SIZE) for g in r.sample(range(800), n)}, **more)


def guest_of(spark, path, **more):
    x = cli.Opened(spark, str(path), **more)
    return {r.guest_cluster: bytes(r.bytes) for r in x.guest().collect() if r.error is None}


def clean(spark, path):
    x = cli.Opened(spark, str(path))
    tables = tuple(t.persist() for t in im.all_tables(x.header, x.files, x.bits, x.extended))
    expected = im.expected_refcounts(x.header, x.files, x.bits, x.extended, tables).persist()
    stored = im.stored_refcounts(x.header, x.files, x.bits, x.order)
    out = changes.differing(stored, expected).isEmpty() and changes.wrong_flags(expected, tables, x.bits, x.extended).isEmpty()
    for t in (*tables, expected):
        t.unpersist()
    return out


def test_changes_keep_the_guest_and_the_counts(spark, tmp_path):
    old = random_image(2, 10).clusters
    x = random_image(snapshots=[Snapshot("7", "first", old)])
    x.compressed = set(list(x.clusters)[:5])
    path = str(tmp_path / "a.img")
    open(path, "wb").write(build(x))
    assert changes.snapshot_create(spark, path, "second", 5) == "8"
    for name in ("", "second"):
        with pytest.raises(ValueError):
            changes.snapshot_create(spark, path, name)
    changes.bitmap_create(spark, path, "marks", 12)
    with pytest.raises(ValueError):
        changes.bitmap_create(spark, path, "marks")
    with pytest.raises(ValueError):
        changes.resize(spark, path, 100 * SIZE)  # has snapshots
    changes.resize(spark, path, 9000 * SIZE)
    assert guest_of(spark, path) == x.clusters
    changes.snapshot_apply(spark, path, "first")
    assert clean(spark, path) and guest_of(spark, path) == old
    changes.snapshot_delete(spark, path, "8")
    changes.bitmap_delete(spark, path, "marks")
    changes.snapshot_delete(spark, path, "first")
    assert changes.truncate_tail(spark, path) >= 0 and clean(spark, path) and guest_of(spark, path) == old
    with pytest.raises(ValueError):
        changes.resize(spark, path, SIZE)  # data beyond
    changes.rebase(path, "below.img")
    assert cli.Opened(spark, path).backing == "below.img"


def test_repair_of_counts_and_flags(spark, tmp_path):
    x = random_image(3)
    raw = bytearray(build(x))
    raw[-SIZE:] = bytes(random.Random(1).choices(b"\0\0\0\1\2", k=SIZE))  # the reference block
    path = tmp_path / "a.img"
    path.write_bytes(raw)
    assert not clean(spark, path)
    before = cli.Opened(spark, str(path)).issues().where("kind = 'leak'").count()
    assert changes.recount(spark, str(path), leaks_only=True) == {"leaks": before, "mismatches": 0}
    assert cli.Opened(spark, str(path)).issues().where("kind = 'leak'").count() == 0
    changes.recount(spark, str(path))
    assert clean(spark, path) and guest_of(spark, path) == x.clusters


def test_a_file_of_more_than_two_gib(spark, tmp_path, capsys):
    path = str(tmp_path / "a.img")
    open(path, "wb").write(build(random_image(4)))
    os.truncate(path, 3 << 30)
    assert cli.main(["check", path]) == 0 and capsys.readouterr().out == "clean\n"
    assert im.discover(spark, str(tmp_path)).first().length == 3 << 30


def test_exchanges_of_metadata_carry_no_bytes(spark, tmp_path):
    path = str(tmp_path / "a.img")
    open(path, "wb").write(build(random_image(5, snapshots=[Snapshot("1", "s", {3: b"x" * SIZE})])))
    x = cli.Opened(spark, path)
    for df in (x.l1(), x.l2(), im.stored_refcounts(x.header, x.files, BITS, 4), im.expected_refcounts(x.header, x.files, BITS)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" in plan
        for line in plan.splitlines():
            body = line.lstrip(" :+-*()0123456789")
            if body.startswith("Exchange"):
                assert "bytes" not in body, body


def test_strict_and_lenient(spark, tmp_path):
    x = random_image(6)
    raw = bytearray(build(x))
    l1 = int.from_bytes(raw[40:48], "big")
    raw[l1 : l1 + 8] = ((1 << 40) | 1 << 63).to_bytes(8, "big")  # a table far beyond the end
    path = tmp_path / "a.img"
    path.write_bytes(raw)
    with pytest.raises(ValueError, match="damaged"):
        cli.Opened(spark, str(path))
    got = guest_of(spark, path, lenient=True)
    assert got == {g: d for g, d in x.clusters.items() if g >= SIZE // 8}
    y = cli.Opened(spark, str(path), lenient=True)
    assert im.beyond_end(im.l2_tables(y.l1(), BITS), y.files.lengths()).count() == 1


def test_encrypted_clusters_are_read(spark, tmp_path):
    master = random.Random(9).randbytes(64)
    head = luks1(b"open", master)
    x = random_image(7, 12)
    raw = bytearray(build(x))
    offset = len(raw)
    x.extensions = [(im.CRYPTO_EXTENSION, struct.pack(">QQ", offset, len(head)))]
    raw = bytearray(build(x))
    raw[32:36] = (2).to_bytes(4, "big")
    (tmp_path / "plain.img").write_bytes(build(random_image(7, 12)))
    for e in cli.Opened(spark, str(tmp_path / "plain.img")).l2().collect():
        at = e.host_offset
        raw[at : at + SIZE] = ciphers.xts(bytes(raw[at : at + SIZE]), master, at // 512, True)
    path = tmp_path / "a.img"
    path.write_bytes(bytes(raw) + head)
    assert guest_of(spark, path, password="open") == x.clusters
    assert guest_of(spark, path) != x.clusters
    with pytest.raises(ValueError):
        cli.Opened(spark, str(path), password="shut")
    assert recovery.find_luks(cli.Opened(spark, str(path)).files).first().offset == offset


def test_external_data_file(spark, tmp_path):
    x = random_image(8, 10)
    raw = bytearray(build(Image(x.virtual_size, BITS, x.clusters, extensions=[(im.DATA_FILE_EXTENSION, b"data.raw")])))
    raw[72:80] = (4).to_bytes(8, "big")
    path = tmp_path / "a.img"
    (tmp_path / "data.raw").write_bytes(bytes(raw))  # host offsets are places in this file
    path.write_bytes(bytes(raw[: 40 * SIZE]))
    assert guest_of(spark, path) == x.clusters


def test_subclusters(spark, tmp_path):
    bits = 14
    size = 1 << bits
    r = random.Random(10)
    rows = [(g, r.randbytes(size), r.getrandbits(32), 0) for g in (0, 5, 2000)]
    rows = [(g, d, a, r.getrandbits(32) & ~a) for g, d, a, _ in rows]
    guest = spark.createDataFrame(rows, "guest_cluster long, bytes binary, alloc long, zero long")
    host, total = sinks.assemble(guest, 3000 * size, bits, extended=True)
    path = str(tmp_path / "a.img")
    sinks.write_clusters(host, path, size, total)
    x = cli.Opened(spark, path)
    assert x.extended and x.issues().count() == 0
    part = size // 32
    want = {g: (b"".join(d[k * part : (k + 1) * part] if a >> k & 1 else bytes(part) for k in range(32)), ~(a | z) & 0xFFFFFFFF) for g, d, a, z in rows}
    assert {e.guest_cluster: (bytes(e.bytes), e.below) for e in x.guest().collect()} == want
    e = changes.Editor(path)
    at = next(e_.host_offset for e_ in x.l2().collect() if e_.guest_cluster == 0)
    table = int(e.words(e.get("l1_offset"), 1)[0]) & ~(1 << 63)
    e.write(table + 8, (0xFFFFFFFF << 32 | 1).to_bytes(8, "big"))  # both bits of subcluster 0
    bad = {b.guest_cluster: b.error for b in x.guest().collect()}
    assert at and bad[0] == "subcluster with both bits" and bad[5] is None


def test_commit_and_recover(spark, tmp_path, capsys):
    base, top = random_image(11, 20), random_image(12, 20)
    base_path, path = tmp_path / "base.img", tmp_path / "top.img"
    base_path.write_bytes(build(base))
    top.backing = "base.img"
    path.write_bytes(build(top))
    want = {**base.clusters, **top.clusters}
    cli.main(["convert", str(path), str(tmp_path / "flat.raw"), "--to", "raw"])
    flat = (tmp_path / "flat.raw").read_bytes()
    assert all(flat[g * SIZE : (g + 1) * SIZE] == d for g, d in want.items())
    cli.main(["commit", str(path)])
    assert guest_of(spark, base_path) == want and guest_of(spark, path) == {} and clean(spark, base_path)
    raw = bytearray(base_path.read_bytes())
    l1 = int.from_bytes(raw[40:48], "big")
    raw[l1 : l1 + 16] = bytes(16)
    base_path.write_bytes(raw)
    cli.main(["recover", str(base_path), str(tmp_path / "found.raw")])
    assert "standard" in capsys.readouterr().out
    found = (tmp_path / "found.raw").read_bytes()
    assert all(found[g * SIZE : (g + 1) * SIZE] == d for g, d in want.items())


def test_probes(spark, tmp_path):
    x = random_image(13, 20)
    x.clusters = {g: d[:64] * (SIZE // 64) for g, d in x.clusters.items()}
    x.compressed = set(x.clusters)
    path = str(tmp_path / "a.img")
    open(path, "wb").write(build(x))
    y = cli.Opened(spark, path)
    row = recovery.probe_streams(y.l2(), y.files).first()
    assert (row.tried, row.inflated) == (20, 20)
    assert cli.parse_size("1.5G") == 3 << 29 and cli.parse_size("10") == 10 and cli.format_size(1536) == "1.50 KiB"
    with pytest.raises(ValueError):
        cli.parse_size("x")
    hashes = y.guest().select(F.sha2("bytes", 256).alias("h"), "guest_cluster").collect()
    assert all(h.h == hashlib.sha256(x.clusters[h.guest_cluster]).hexdigest() for h in hashes)
