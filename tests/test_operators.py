import random
import zlib

import pytest
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.operators import blocks as B
from blockcat.operators import catalog, index, layout, oplog, schedule, shared
from blockcat.plans import pipelines


def fnv(data, basis, prime, bits):
    for b in data:
        basis = (basis ^ b) * prime % 2**bits
    return basis


def test_hashes_of_bytes(spark):
    words = ["", "a", "/app0/Data/x.bin", "straße", "日本"]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = df.select("w", S.fnv1a32(F.col("w")).alias("a"), S.fnv1a64_hex(S.ascii_lower(F.col("w"))).alias("b")).collect()
    for r in rows:
        low = r.w.encode().lower()
        assert r.a == fnv(r.w.encode(), 2166136261, 16777619, 32)
        assert r.b == f"{fnv(low, 1469598103934665603, 1099511628211, 64):016x}"


def test_prefix_boundary_and_case(spark):
    df = spark.createDataFrame([("/data/x",), ("/database/x",), ("/mnt/usb7",), ("/mnt/usb70",)], "p string")
    assert [r[0] for r in df.select(S.storage_class(F.col("p"))).collect()] == ["internal", "other", "usb", "other"]
    df = spark.createDataFrame([("ÀA",)], "p string")
    assert df.select(S.ascii_lower(F.col("p"))).first()[0] == "Àa"


def test_gain_edge_and_predicted(spark):
    df = spark.createDataFrame([(62_259,), (62_260,)], "n int")
    assert [r[0] for r in df.select(S.gain_reached(F.col("n"))).collect()] == [True, False]
    df = spark.createDataFrame([(0, 700), (1, 500), (1001, 500)], "s long, r int")
    assert [r[0] for r in df.select(S.predicted_stored(F.col("s"), F.col("r"))).collect()] == [0, 1, 501]


def naive_greedy(sizes, predicted, names, credit):
    left, out = set(range(len(sizes))), []
    gain = [max(0, s - p) for s, p in zip(sizes, predicted)]
    while left:
        fit = [i for i in left if predicted[i] <= credit]
        if fit:
            best, reverse = min(fit, key=lambda i: (gain[i] <= 0, -sizes[i], -gain[i], names[i].lower(), names[i])), False
        else:
            best, reverse = min(left, key=lambda i: (-sizes[i], names[i].lower(), names[i])), True
        left.discard(best)
        out.append((best, reverse))
        credit += gain[best]
    return out


def test_greedy_equals_a_search_at_each_step():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randrange(0, 25)
        sizes = [rng.randrange(0, 50) for _ in range(n)]
        predicted = [rng.randrange(0, s + 1) if s else 0 for s in sizes]
        names = [f"{rng.choice('aAbB')}{i}" for i in range(n)]
        credit = rng.randrange(0, 40)
        assert schedule.greedy_order(sizes, predicted, names, credit) == naive_greedy(sizes, predicted, names, credit)


def test_start_credit():
    assert schedule.start_credit(0, 0) == (1 << 30) - (128 << 20)
    assert schedule.start_credit(1000, 0) == 875
    assert schedule.start_credit(1000, 2000) == 1000


def test_slots():
    assert [index.slot_count(n) for n in (0, 1, 2, 3, 4, 5)] == [0, 2, 4, 8, 8, 16]
    slots, stats = index.place([8, 8, 8, 0])
    assert slots == [0, 1, 2, 3] and stats["duplicate_groups"] == 3 and stats["longest"] == 3


def files(spark, n=6, block=1024):
    rng = random.Random(3)
    rows = [(f"c{i}", bytes(rng.randrange(256) for _ in range(block * i // 2)) + b"ab" * (300 * i)) for i in range(n)]
    return spark.createDataFrame(rows, "container string, body binary"), dict(rows)


def test_pack_then_unpack_gives_the_same(spark):
    df, bodies = files(spark)
    packed = pipelines.pack(df, 1024)
    back = {r.container: bytes(r.body) for r in pipelines.unpack(packed, 1024).collect()}
    assert back == {k: v for k, v in bodies.items() if v}
    for r in packed.collect():
        assert r.compressed == (r.stored_len < 1024)


def test_corrupt_blocks_are_found(spark):
    df, _ = files(spark)
    packed = pipelines.pack(df, 1024).cache()
    bad = packed.withColumn("stored", F.when(F.col("compressed"), F.substring("stored", 1, 10)).otherwise(F.col("stored")))
    errors = {r.container for r in pipelines.unpack(bad, 1024).filter("error is not null").collect()}
    assert errors == {r.container for r in packed.filter("compressed").collect()}


def test_verify_and_repair(spark):
    df, _ = files(spark)
    packed = pipelines.pack(df, 1024).cache()
    live = B.cut(df, "container", "body", 1024)
    assert {r.state for r in pipelines.verify(packed, live, 1024).collect()} == {"matched"}
    stale = packed.withColumn("sha", F.lit("x"))
    assert {r.state for r in pipelines.verify(stale, live, 1024).collect()} == {"matched-by-bytes"}
    hurt = live.withColumn("data", F.when(F.col("idx") == 0, F.lit(b"?")).otherwise(F.col("data")))
    states = pipelines.verify(packed, hurt, 1024)
    assert {(r.container, r.idx) for r in states.filter("state = 'bad'").collect()} == {(r.container, 0) for r in packed.select("container").distinct().collect()}
    rows = pipelines.repair_offsets(packed, states, 1024).collect()
    assert all(r.new_len == 1024 for r in rows if r.idx == 0)


def test_repair_gives_containers_that_can_be_written(spark):
    df, bodies = files(spark)
    packed = pipelines.pack(df, 1024).cache()
    live = B.cut(df, "container", "body", 1024)
    damaged = packed.withColumn("stored", F.when(F.col("idx") % 2 == 0, F.lit(b"junk")).otherwise(F.col("stored"))).withColumn("sha", F.when(F.col("idx") % 2 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.col("sha")))
    source = live.filter("not (container = 'c5' and idx = 2)")
    states = pipelines.verify(damaged, live, 1024)
    mended = pipelines.repair(damaged, states, source, 1024)
    back = {r.container: r for r in pipelines.unpack(mended, 1024).collect()}
    assert {k: bytes(r.body) for k, r in back.items() if r.error is None} == {k: v for k, v in bodies.items() if v and k != "c5"}
    assert back["c5"].error and [(r.container, r.idx) for r in pipelines.unrepaired(states, source).collect()] == [("c5", 2)]
    ends = {}
    for r in sorted(mended.collect(), key=lambda r: (r.container, r.idx)):
        assert r.off == ends.get(r.container, r.off)
        ends[r.container] = r.off + r.stored_len


def test_one_container_in_many_chunks(spark):
    rng = random.Random(7)
    rows = [("one", i, rng.randrange(1, 50)) for i in rng.sample(range(2000), 900)] + [(None, i, 1) for i in range(5)]
    df = spark.createDataFrame(rows, "container string, idx long, n int").repartition(7)
    got = {(r.container, r.idx): (r.before, r.last) for r in shared.value_before(shared.sum_before(df, "container", "idx", "n", "before", 64), "container", "idx", "n", "last", 64).collect()}
    for name in ("one", None):
        total, last = 0, None
        for _, i, n in sorted((r for r in rows if r[0] == name), key=lambda r: r[1]):
            assert got[name, i] == (total, last)
            total, last = total + n, n
    paths = spark.createDataFrame([("one", f"{rng.choice('aAbB')}/f{i}", i) for i in range(400)], "container string, rel string, size long")
    starts = layout.block_starts(paths, "container", 100, True).collect()
    at = 0
    for r in sorted(starts, key=lambda r: (r.rel.lower(), r.rel)):
        assert r.block_start == at
        at += r.blocks


def test_patch_changes_only_what_it_meets(spark):
    df, bodies = files(spark)
    packed = pipelines.pack(df, 1024).cache()
    patches = spark.createDataFrame([("c5", 1000, 60, b"x" * 60, 1), ("c5", 1030, 5, b"yyyyy", 2)], "container string, off long, size long, bytes binary, seq int")
    after = pipelines.patch(packed, patches, 1024)
    body = {r.container: bytes(r.body) for r in pipelines.unpack(after, 1024).collect()}
    want = bytearray(bodies["c5"])
    want[1000:1060] = b"x" * 60
    want[1030:1035] = b"yyyyy"
    assert body["c5"] == bytes(want) and body["c4"] == bodies["c4"]


def test_verify_set_stays_in_the_container(spark):
    bad = spark.createDataFrame([("a", 0), ("a", 9)], "container string, idx long")
    total = spark.createDataFrame([("a", 10)], "container string, blocks long")
    assert sorted(r.idx for r in B.verify_set(bad, total, "container").collect()) == [0, 1, 8, 9]


def test_case_collision(spark):
    df = spark.createDataFrame([("c", "/app0/A.bin"), ("c", "/app0/a.bin")], "container string, rel string")
    assert [r.rel for r in layout.dedup_paths(df, "container").collect()] == ["/app0/A.bin"]
    with pytest.raises(Exception, match="case only"):
        layout.dedup_paths(df, "container", strict=True).collect()


def test_history_keeps_the_keys_updated_last(spark):
    rng = random.Random(5)
    log = [(f"k{rng.randrange(100)}", i) for i in range(400)]
    table = {}
    for k, i in log:
        if k not in table and len(table) == 64:
            del table[min(table, key=table.get)]
        table[k] = i
    df = spark.createDataFrame(log, "k string, n int")
    assert {r.k: r.n for r in oplog.bounded_history(df, ["k"], ["n"], []).collect()} == table


def test_tail_run_starts_as_far_right_as_it_can(spark):
    used = "0010000110000100"
    df = spark.createDataFrame([("v", i, c == "1") for i, c in enumerate(used)], "volume string, cluster long, used boolean")
    best = max(s for s in range(len(used)) if used[s : s + 4] == "0000")
    r = layout.tail_run(df, 4, 2).first()
    assert (r["first"], r["count"]) == (best, 4)


def test_stored_is_raw_where_deflate_gains_little(spark):
    df = spark.createDataFrame([("a", 0, bytes(range(256)) * 4), ("b", 0, b"\0" * 1024)], "container string, idx long, data binary")
    rows = {r.container: r for r in B.encode(df, 1024).collect()}
    for k, r in rows.items():
        small = len(zlib.compress({"a": bytes(range(256)) * 4, "b": b"\0" * 1024}[k], 7))
        assert r.compressed == ((1024 - small) * 100 >= 1024 * 5)


def test_first_differences_of_whole_blocks(spark):
    rows, want = [], {}
    for n, at in enumerate((0, 31, 32, 33, 1000, 40_000, 65_535)):
        x = bytes(i % 251 for i in range(65_536))
        rows.append((n, x, x[:at] + bytes([x[at] ^ 1]) + x[at + 1 :]))
        rows.append((n + 100, x, x[:at]))
        want |= {n: at, n + 100: at}
    rows += [(200, x, x), (201, b"", b""), (202, None, b"z"), (203, None, None)]
    want |= {200: -1, 201: -1, 202: 0, 203: -1}
    got = B.first_differences(spark.createDataFrame(rows, "n int, a binary, b binary"), "a", "b").collect()
    assert {r.n: r.first_diff for r in got} == want


def test_paths_by_their_last_bytes(spark):
    """What a pattern that ends in a dollar sign would let through."""
    rows = {"/a/.": False, "/a\n": False, "/.": True, "/..": False, "/a/..": False, "/a": True, "a": False, "/a\\": False, "/" + "n" * 1023: False, "/" + "n" * 1022: True}
    df = spark.createDataFrame([(k,) for k in rows], "p string")
    assert {r.p: r.s for r in df.select("p", S.path_safe(F.col("p")).alias("s")).collect()} == rows
    df = spark.createDataFrame([("PPSA01234",), ("PPSA01234\n",)], "t string")
    assert [r[0] for r in df.select(S.title_id_valid(F.col("t"))).collect()] == [True, False]
    assert [r[0] for r in df.select(S.sha256_valid(F.concat(F.sha2("t", 256), F.substring("t", 10, 1)))).collect()] == [True, False]


def test_wide_sizes(spark):
    df = spark.createDataFrame([(10**16, 950), (4 * 10**16, 950), (2**62, 500)], "s long, r int")
    assert [r[0] for r in df.select(S.predicted_stored(F.col("s"), F.col("r"))).collect()] == [95 * 10**14, 4 * 10**16, 2**62]
    df = spark.createDataFrame([(2**55 + 1, 1), (2**63 - 1, 2), (5, 0)], "a long, b long")
    assert [r[0] for r in df.select(S.ceil_div(F.col("a"), F.col("b"))).collect()] == [2**55 + 1, 2**62, 0]


def test_checksum_leaves_places_out(spark):
    raw = bytes(range(1, 200))
    h = 0
    for i, b in enumerate(raw):
        if i not in (4, 100, 101):
            h = ((h >> 1 | (h & 1) << 31) + b) % 2**32
    df = spark.createDataFrame([(raw,), (None,)], "c binary")
    assert [r[0] for r in df.select(S.checksum32(F.col("c"), (100, 4, 101))).collect()] == [h, None]


def test_many_roots(spark):
    """More roots than a driver should list; each title is asked of those that have a file of its name."""
    roots = spark.range(6000).select(F.concat(F.lit("/r"), F.col("id").cast("string")).alias("root"), (-F.col("id")).alias("pos"))
    files_ = spark.createDataFrame([("/r10/a.x",), ("/r5999/a.x",), ("/r7/b.x",), ("/none/c.x",)], "path string")
    titles = spark.createDataFrame([("a",), ("b",), ("c",)], "title string")
    got = catalog.first_existing(titles, roots, files_, F.concat("title", F.lit(".x")))
    assert {r.title: r.path for r in got.collect()} == {"a": "/r5999/a.x", "b": "/r7/b.x"}


def test_scan_cache(spark):
    now, scans = [0.0], []

    def scan():
        scans.append(1)
        return spark.range(len(scans))

    cache = catalog.ScanCache(scan, 10, lambda: now[0])
    assert cache.get().count() == cache.get().count() == 1
    now[0] = 9.9
    assert cache.get().count() == 1 and cache.get(force=True).count() == 2
    now[0] = 20
    assert cache.get().count() == 3
    cache.invalidate()
    assert cache.get().count() == 4


def test_scratch_keeps_what_it_is_told(spark):
    from pathlib import Path

    with shared.scratch() as keep:
        gone = shared.Stored(spark.range(3), "gone")
        keep.append(shared.Stored(spark.range(4), "kept"))
    there = lambda x: Path(x.path.removeprefix("file:")).exists()
    assert not there(gone) and there(keep[0]) and keep[0].df.count() == 4


def test_tail_run_beyond_the_cap(spark):
    df = spark.range(6000).select(F.lit("v").alias("volume"), F.col("id").alias("cluster"), F.lit(False).alias("used"))
    assert layout.tail_run(df, 4097, 0).count() == 0
    assert layout.tail_run(df, 4096, 5).first()["count"] == 4096


def test_index_refuses_what_it_cannot_hold(spark):
    df = spark.createDataFrame([("c", "a\tb", 1, 1)], "container string, rel string, size long, mtime long")
    with pytest.raises(Exception, match="can't be indexed"):
        pipelines.build_index(df).collect()
