"""Commands on images that the tests build."""

import random

from cowlens import cli
from cowlens.sources.build import Image, Snapshot, build

SIZE = 4096


def test_commands(spark, tmp_path, capsys):
    r = random.Random(3)
    clusters = {g: r.randbytes(SIZE) for g in (1, 5, 600)}
    x = Image(900 * SIZE, 12, clusters, {5}, [Snapshot("1", "snap", {1: clusters[1]})])
    raw = bytearray(build(x))
    path = tmp_path / "a.qcow2"
    path.write_bytes(raw)
    run = lambda *a: (cli.main([str(y) for y in a]), capsys.readouterr().out)
    assert run("check", path) == (0, "clean\n")
    assert "virtual_size=3686400" in run("info", path)[1]
    assert "name=snap" in run("snapshot", "list", path)[1]
    assert run("dump", "l2", path)[1].count("guest_cluster=") == 3
    assert "kind=header" in run("analyze", path)[1]
    disk = bytearray(900 * SIZE)
    for g, d in clusters.items():
        disk[g * SIZE : (g + 1) * SIZE] = d
    run("convert", path, tmp_path / "a.raw", "--to", "raw")
    assert (tmp_path / "a.raw").read_bytes() == disk
    run("convert", path, tmp_path / "b.qcow2")
    assert run("check", tmp_path / "b.qcow2") == (0, "clean\n")
    run("convert", tmp_path / "b.qcow2", tmp_path / "b.raw", "--to", "raw")
    assert (tmp_path / "b.raw").read_bytes() == disk
    at = len(raw) - SIZE  # the reference block is last
    raw[at : at + 2], raw[at + 2 : at + 4] = b"\0\7", b"\0\0"
    path.write_bytes(raw)
    code, out = run("check", path)
    assert code == 1 and "leak: 1" in out and "mismatch: 1" in out
