"""Archives as a source: formats, levels, budgets, ranges."""

import io
import os
import tarfile
import zipfile

import pytest

from artiscope.binary import archives, sevenzip
from artiscope.plans import specimens
from artiscope.sources import archives as AS

FILES = "path string, content binary"


def zipped(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


@pytest.mark.parametrize("coding", ["copy", "lzma", "lzma2"])
@pytest.mark.parametrize("packed_header", [False, True])
def test_seven_zip(coding, packed_header):
    blocks = [[("a.txt", b"x" * 5000), ("d/b.txt", b"hello")], [("c", b"1")], [("../out", b"no"), ("é.txt", os.urandom(300))]]
    data = specimens.seven_zip(blocks, coding, packed_header)
    found, notes = archives.members("x.7z", data, 1 << 20)
    assert not notes and found == [(n, b) for block in blocks for n, b in block if ".." not in n]
    listed = archives.listing("x", io.BytesIO(data))  # known by its first bytes, too
    assert listed.kind == "7z" and [e.block for e in listed.entries] == [0, 0, 1, 2] and listed.total == 5308


def test_seven_zip_that_is_broken_or_not_supported():
    data = specimens.seven_zip([[("a.txt", b"x" * 5000)]])
    assert archives.members("x.7z", data[:-2], 1 << 20) == ([], ["x.7z: ValueError"])
    flipped = bytearray(data)
    flipped[40] ^= 0xFF
    found, notes = archives.members("x.7z", bytes(flipped), 1 << 20)
    assert not found and len(notes) == 1
    other = data.replace(b"\x21\x21\x01\x10", b"\x21\x04\x01\x10")
    import struct
    import zlib

    size = struct.unpack_from("<Q", other, 20)[0]
    header = other[-size:]
    start = struct.pack("<QQI", *struct.unpack_from("<QQ", other, 12), zlib.crc32(header))
    other = other[:8] + struct.pack("<I", zlib.crc32(start)) + start + other[32:]
    assert archives.members("x.7z", other, 1 << 20)[1] == ["x.7z: Unsupported"]
    with pytest.raises(ValueError):
        sevenzip.parse(io.BytesIO(b"7z\xbc\xaf\x27\x1c" + bytes(8)))


def collected(out):
    members, notes = out
    return {r.path: (bytes(r.content), r.depth, r.extracted_from) for r in members.collect()}, {(r.path, r.note) for r in notes.collect()}


def test_levels_and_mixed_kinds(spark, tmp_path):
    deep = zipped({"leaf.txt": b"leaf" * 30})
    for _ in range(3):
        deep = zipped({"inner.zip": deep})
    (tmp_path / "a.zip").write_bytes(deep)
    (tmp_path / "b.tar.gz").write_bytes(specimens.tar_archive([("in.7z", specimens.seven_zip([[("s/x.txt", b"seven")]])), ("../bad", b"x"), ("t.txt", b"t")], True))
    (tmp_path / "c.rar").write_bytes(b"Rar!....")
    (tmp_path / "d.exe").write_bytes(b"MZ" + b"\0" * 100 + b"Inno Setup Setup Data (6.2.0)")
    (tmp_path / "plain.exe").write_bytes(b"MZ" + b"\0" * 100)
    (tmp_path / "n.txt").write_bytes(b"no archive")
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("regexp_replace(path, '^file:/+', '/') as path", "content")
    r = str(tmp_path)
    for mounted in (True, False):
        members, notes = collected(AS.expand(files, max_depth=2, mounted=mounted))
        assert {k.removeprefix(r): v[1] for k, v in members.items()} == {
            "/a.zip > inner.zip": 1,
            "/a.zip > inner.zip > inner.zip": 2,
            "/a.zip > inner.zip > inner.zip > inner.zip": 3,
            "/b.tar.gz > in.7z": 1,
            "/b.tar.gz > t.txt": 1,
            "/b.tar.gz > in.7z > s/x.txt": 2,
        }
        assert members[f"{r}/b.tar.gz > in.7z > s/x.txt"][0] == b"seven" and members[f"{r}/b.tar.gz > t.txt"][2] == f"{r}/b.tar.gz"
        assert {(p.removeprefix(r), n) for p, n in notes} == {
            ("/a.zip > inner.zip > inner.zip > inner.zip", "deeper than the limit"),
            ("/c.rar", "c.rar: unreadable archive isn't unpacked"),
            ("/d.exe", "d.exe: inno archive isn't unpacked"),
        }


def test_a_budget_for_each_root_over_its_levels(spark):
    nested = {"1.zip": zipped({"x": os.urandom(400)}), "2.zip": zipped({"x": b"\0" * 5000}), "3.zip": zipped({"x": os.urandom(200)})}
    inner = sum(map(len, nested.values()))
    rows = [("r/a.zip", bytearray(zipped(nested))), ("r/bomb.zip", bytearray(zipped({"z": b"\0" * 100_000}))), ("r/small.zip", bytearray(zipped({"y": b"fits"})))]
    members, notes = collected(AS.expand(spark.createDataFrame(rows, FILES), max_total=inner + 650))
    # 1.zip fits, 2.zip doesn't, 3.zip still does; the other roots have budgets of their own
    assert set(members) == {"r/a.zip > 1.zip", "r/a.zip > 2.zip", "r/a.zip > 3.zip", "r/a.zip > 1.zip > x", "r/a.zip > 3.zip > x", "r/small.zip > y"}
    assert notes == {("r/a.zip > 2.zip", "2.zip: larger than the limit when unpacked"), ("r/bomb.zip", "bomb.zip: larger than the limit when unpacked")}


def test_ranges_keep_blocks_whole(spark, tmp_path):
    bodies = {f"m{k:02}.bin": os.urandom(1000) for k in range(30)}
    (tmp_path / "a.zip").write_bytes(zipped(bodies))
    (tmp_path / "b.7z").write_bytes(specimens.seven_zip([list(bodies.items())[k : k + 10] for k in (0, 10, 20)]))
    with tarfile.open(tmp_path / "c.tar", "w") as t:
        for name, body in bodies.items():
            info = tarfile.TarInfo(name)
            info.size = len(body)
            t.addfile(info, io.BytesIO(body))
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("regexp_replace(path, '^file:/+', '/') as path", "content")
    members, notes = collected(AS.expand(files, mounted=True, range_bytes=4000))
    assert not notes and len(members) == 90 and all(body == bodies[p.rsplit(" > ", 1)[1]] for p, (body, _, _) in members.items())
    listed = archives.listing("b.7z", io.BytesIO((tmp_path / "b.7z").read_bytes()))
    assert [len(x) for x in AS._ranges(listed.entries, 4000)] == [10, 10, 10]
    assert [len(x) for x in AS._ranges(archives.listing("a.zip", io.BytesIO((tmp_path / "a.zip").read_bytes())).entries, 4000)] == [4] * 7 + [2]


def test_candidates_are_the_first_by_path(spark):
    rows = [(f"r/{k}.zip", bytearray(zipped({"y": b"%d" % k}))) for k in (3, 1, 2)] + [("r/0.txt", bytearray(zipped({"y": b"0"})))]
    members, _ = AS.expand(spark.createDataFrame(rows, FILES), max_archives=2)
    assert sorted(r.path for r in members.collect()) == ["r/1.zip > y", "r/2.zip > y"]
    members, _ = AS.expand(spark.createDataFrame(rows, FILES).limit(0))
    assert members.count() == 0
