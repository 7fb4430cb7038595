"""Convert there and back: images that Spark wrote, read by Spark, consistent by their own counts."""

import random

import pytest
from pyspark.sql import functions as F

from cowlens.sources import image as im
from cowlens.sources import sinks

BITS, SIZE = 12, 4096


@pytest.mark.parametrize("packed", [False, True])
def test_raw_to_image_to_raw(spark, tmp_path, packed):
    r = random.Random(7)
    raw = b"".join(bytes(SIZE) if r.random() < 0.4 else r.randbytes(50) * 81 + b"xxxxxx"[: SIZE - 4050] + bytes(40) for _ in range(700))[: 690 * SIZE + 100]
    (tmp_path / "d.raw").write_bytes(raw)
    total = sinks.convert_raw(spark, str(tmp_path / "d.raw"), str(tmp_path / "d.qcow2"), BITS, packed)
    assert (tmp_path / "d.qcow2").stat().st_size == total * SIZE
    c = im.clusters(spark, str(tmp_path), BITS, "*.qcow2").persist()
    head = im.header(c)
    assert head.first().virtual_size == len(raw)
    l2 = im.l2_entries(im.l1_entries(im.active_tables(head), c, BITS), c, BITS)
    assert {x.kind for x in l2.select("kind").distinct().collect()} == {"compressed" if packed else "standard"}
    guest = im.read_clusters(l2, c, BITS)
    assert guest.where(F.col("error").isNotNull()).count() == 0
    sinks.write_raw(guest, str(tmp_path / "back.raw"), len(raw), SIZE)
    assert (tmp_path / "back.raw").read_bytes() == raw
    stored = {x.cluster_idx: int(x.stored) for x in im.stored_refcounts(head, c, BITS, 4).collect()}
    expected = {x.cluster_idx: x.expected for x in im.expected_refcounts(head, c, BITS).collect()}
    assert stored == expected
