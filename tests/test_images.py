import os
import random

import pytest

from blockcat.sources import exfat, pathindex


def some_files():
    rng = random.Random(2)
    out = {f"{d}{i}.bin": rng.randbytes(rng.choice([0, 1, 4096, 9000])) for d in ("", "a/", "a/b/", "long folder name/") for i in range(12)}
    return out | {"a/ünïcode name that takes more than one entry.txt": b"x" * 5000}


def test_exfat_image_round_trip(spark, tmp_path):
    files = some_files()
    data = exfat.write_image(files)
    (tmp_path / "one.img").write_bytes(data)
    spark.dataSource.register(exfat.Exfat)
    rows = spark.read.format("blockcat_exfat").load(str(tmp_path)).collect()
    got = {r.rel: data[r.image_offset : r.image_offset + r.size] for r in rows if not r.is_dir}
    assert got == files and all(r.contiguous for r in rows)
    assert {r.rel for r in rows if r.is_dir} == {"a", "a/b", "long folder name"}
    reader = exfat.Reader(lambda o, n: data[o : o + n])
    assert reader.find(["none", "A/B/3.BIN", "0.bin"])[0] == "a/b/3.bin"


def test_broken_images_are_refused():
    data = bytearray(exfat.write_image({"x.bin": b"1"}))
    with pytest.raises(ValueError):
        exfat.Reader(lambda o, n: bytes(1024)[o : o + n])
    reader = exfat.Reader(lambda o, n: bytes(data[o : o + n]))
    at = reader.offset(reader.root) + 64 + 40
    data[at] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(reader.entries())


def test_bitmap_holds_its_own_clusters():
    for used in range(0, 3000, 7):
        own, total = exfat.bitmap_clusters(used, 16, 5)
        assert total == used + own + 5 and (own - 1) * 128 < total <= own * 128


def test_path_index_round_trip(spark):
    rng = random.Random(1)
    rows = [(f"/app/{rng.choice('aAbB')}{i}.bin", rng.randrange(9999), -i) for i in range(300)]
    data = pathindex.write(rows)
    assert sorted(pathindex.read(data)) == sorted(rows)
    assert [r[0].lower() for r in pathindex.read(data)] == sorted(r[0].lower() for r in rows)
    for path, size, mtime in rows:
        assert pathindex.find(data, path.upper()) == (path, size, mtime)
    assert pathindex.find(data, "/none") is None
    with pytest.raises(ValueError):
        pathindex.read(b"x" * 48)
    df = spark.createDataFrame([("c", *r) for r in rows], "container string, rel string, size long, mtime long")
    assert bytes(pathindex.write_indexes(df).first().data) == data
    assert os.path.sep == "/"


def test_inode_image_round_trip(spark):
    from blockcat.sources import inodes

    files = some_files()
    data = inodes.write_image(files, 4096)
    df = spark.createDataFrame([("one", data)], "image string, content binary")
    rows = inodes.list_images(df).collect()
    assert {r.rel: data[r.image_offset : r.image_offset + r.size] for r in rows} == files
    assert len({r.inode for r in rows}) == len(files)
    with pytest.raises(ValueError):
        inodes.Reader(lambda o, n: bytes(n))
    with pytest.raises(ValueError):
        list(inodes.parse_entries(inodes.entry(1, 2, "x")[:20].ljust(24, b"\1")[:8] + bytes([9, 0, 0, 0, 17, 0, 0, 0]) + b"toolong!"))
