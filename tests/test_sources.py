import os

import pytest

from blockcat.sources import sinks, text
from blockcat.sources.blockstore import BlockStore, pack, read_offsets
from blockcat.sources.files import Files
from blockcat.plans import pipelines
from blockcat.streaming import logs


def test_scan_sees_hidden_names(spark, tmp_path):
    (tmp_path / "a/b").mkdir(parents=True)
    for name in ("a/x.txt", "a/b/.DS_Store", "._y", "_ok.bin"):
        (tmp_path / name).write_bytes(b"123")
    os.symlink(tmp_path / "a", tmp_path / "link")
    spark.dataSource.register(Files)
    rows = {r.rel: r for r in spark.read.format("blockcat_files").option("path", str(tmp_path)).load().collect()}
    assert set(rows) == {"a", "a/x.txt", "a/b", "a/b/.DS_Store", "._y", "_ok.bin"}
    assert {k for k, r in rows.items() if r.junk} == {"a/b/.DS_Store", "._y"}
    assert rows["a/x.txt"].size == 3 and rows["a"].is_dir
    with pytest.raises(Exception, match="neither a file"):
        spark.read.format("blockcat_files").option("path", str(tmp_path)).option("strict", "true").load().count()


def test_containers_round_trip(spark, tmp_path):
    bodies = {"one": b"abc" * 2000, "two": os.urandom(5000)}
    df = spark.createDataFrame(list(bodies.items()), "container string, body binary")
    packed = pipelines.pack(df, 1024)
    sizes = spark.createDataFrame([(k, len(v)) for k, v in bodies.items()], "container string, size long")
    sinks.write_containers(packed.join(sizes, "container"), str(tmp_path), 1024).collect()
    assert sorted(os.listdir(tmp_path)) == ["one", "two"]
    spark.dataSource.register(BlockStore)
    got = spark.read.format("blockcat_blocks").load(str(tmp_path))
    want = {(r.container, r.idx): (r.off, r.stored_len) for r in packed.collect()}
    assert {(r.container, r.idx): (r.off, r.stored_len) for r in got.collect()} == want


def test_bad_containers_are_refused():
    good = pack([b"x" * 10, b"y" * 1024], 1024, 2000)
    assert read_offsets(good)[2] == [2048, 2058, 3082]
    for data in (b"", b"?" + good[1:], good[:1024] + (9999).to_bytes(8, "little") + good[1032:]):
        with pytest.raises(ValueError):
            read_offsets(data)


def test_text_formats(spark, tmp_path):
    (tmp_path / "h.jsonl").write_text('{"id":"a","n":1}\nbroken\n{"id":"b","n":2}\n')
    assert sorted((r.id, r.n) for r in text.read_jsonl(spark, str(tmp_path / "h.jsonl"), "id string, n int").collect()) == [("a", 1), ("b", 2)]
    (tmp_path / "bad.tsv").write_text("block\tstored_len\n3\t9\n1\t8\n3\t9\n")
    assert sorted(r.block for r in text.read_bad_blocks(spark, str(tmp_path / "bad.tsv"), 5).collect()) == [1, 3]
    with pytest.raises(Exception, match="out of range"):
        text.read_bad_blocks(spark, str(tmp_path / "bad.tsv"), 3).collect()
    (tmp_path / "c.ini").write_text('# x\nscanpath = "/data/a"\r\nscan_depth=2\n;y\n')
    assert [(r.key, r.value) for r in text.read_settings(spark, str(tmp_path / "c.ini")).orderBy("n").collect()] == [("scanpath", "/data/a"), ("scan_depth", "2")]
    (tmp_path / "v/1.2").mkdir(parents=True)
    (tmp_path / "v/1.2/lib.bin").write_bytes(b"z")
    assert text.read_versions(spark, str(tmp_path / "v")).first().version == "1.2"


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("a", 1, "enqueue"), ("a", 2, "start"), ("b", 1, "enqueue"), ("a", 3, "cancel"), ("a", 4, "finish"), ("b", 2, "cancel"), ("b", 3, "start")]
    df = spark.createDataFrame(rows, "op_id string, seq long, event string")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).json(str(tmp_path / "in"))
    q = logs.operation_states(stream).writeStream.format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.op_id, r.seq, r.status) for r in spark.table("states").collect()) == [("a", 1, "queued"), ("a", 2, "running"), ("a", 3, "running"), ("a", 4, "cancelled"), ("b", 1, "queued"), ("b", 2, "cancelled"), ("b", 3, "cancelled")]
    q = logs.latest(stream, ["op_id"], ["seq"], ["event"]).writeStream.format("memory").queryName("latest").outputMode("complete").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.op_id, r.seq, r.event) for r in spark.table("latest").collect()} == {("a", 4, "finish"), ("b", 3, "start")}


def test_containers_are_read_in_runs_and_bodies_written(spark, tmp_path):
    bodies = {"one": os.urandom(9000) + b"x" * 9000, "two": b"y" * 100}
    df = spark.createDataFrame(list(bodies.items()), "container string, body binary")
    packed = pipelines.pack(df, 1024)
    sizes = spark.createDataFrame([(k, len(v)) for k, v in bodies.items()], "container string, size long")
    sinks.write_containers(packed.join(sizes, "container"), str(tmp_path / "c"), 1024).collect()
    spark.dataSource.register(BlockStore)
    got = spark.read.format("blockcat_blocks").option("blocks", "5").load(str(tmp_path / "c"))
    assert got.rdd.getNumPartitions() == 5
    assert {(r.container, r.idx): bytes(r.stored) for r in got.collect()} == {(r.container, r.idx): bytes(r.stored) for r in packed.collect()}
    assert {r.container: r.bytes for r in sinks.write_bodies(packed, str(tmp_path / "b"), 1024).collect()} == {k: len(v) for k, v in bodies.items()}
    assert {p: (tmp_path / "b" / p).read_bytes() for p in bodies} == bodies and len(os.listdir(tmp_path / "b")) == 2
    bad = packed.withColumn("stored", packed["stored"].substr(1, 3))
    with pytest.raises(Exception, match="bad stream"):
        sinks.write_bodies(bad, str(tmp_path / "d"), 1024).collect()


def test_sidecar_bytes(spark):
    import hashlib

    digests = [hashlib.sha256(bytes([i])).digest() for i in range(3)]
    data = sinks.sidecar_bytes(digests, 1024, 3000, 3000)
    stored = spark.createDataFrame([("a", 3, 3000, 3000), ("b", 3, 3001, 3000), ("c", 4, 3000, 3000), ("d", 1, 1, 1)], "container string, blocks long, logical long, nested long")
    got = {r.container: r for r in sinks.read_sidecars(spark.createDataFrame([(k, data) for k in "abc"], "container string, content binary"), stored, 1024).collect()}
    assert {k: r["mode"] for k, r in got.items()} == {"a": "used", "b": "stale", "c": "invalid", "d": "missing"}
    assert got["a"].digests == [d.hex() for d in digests]


def test_wrapped_containers(spark, tmp_path):
    from blockcat.sources import inodes, wrapper

    body = os.urandom(20_000) + b"z" * 30_000
    df = spark.createDataFrame([("one", body)], "container string, body binary")
    packed = pipelines.pack(df, 4096)
    whole = packed.withColumn("size", packed["idx"] * 0 + len(body))
    assert sinks.write_containers(whole, str(tmp_path), 4096, wrapped=True).first().bytes == (tmp_path / "one").stat().st_size
    data = (tmp_path / "one").read_bytes()
    read = lambda at, n: data[at : at + n]
    start, stored, content, name, block = wrapper.inner(read)
    assert (start, content, name, block) == (6 * 4096, len(body), "pfs_image.dat", 4096) and len(data) == (6 + -(-stored // 4096)) * 4096
    assert read_offsets(data[start:])[2][-1] == stored
    assert [(rel, at, n) for rel, _, at, n in inodes.Reader(read).files()] == [("pfs_image.dat", start, stored)]
    spark.dataSource.register(BlockStore)
    back = spark.read.format("blockcat_blocks").option("blocks", "3").load(str(tmp_path))
    assert {(r.idx, bytes(r.stored)) for r in back.collect()} == {(r.idx, bytes(r.stored)) for r in packed.collect()}
    assert sum(r.dirty for r in wrapper.slack_report(spark, str(tmp_path)).collect()) == 0
    hurt = bytearray(data)
    hurt[4 * 4096 + 9] = hurt[-1] = 7
    (tmp_path / "one").write_bytes(hurt)
    assert sorted((r.off, r.dirty) for r in wrapper.slack_report(spark, str(tmp_path)).filter("dirty > 0").collect()) == [(4 * 4096, 1), (start + stored, 1)]
    with pytest.raises(ValueError):
        wrapper.inner(lambda at, n: bytes(n))
