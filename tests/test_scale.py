"""Findings of the second round: work that one task did alone, and keys beyond those of the small tables."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from blockcat import registry
from blockcat.llm import token_files
from blockcat.operators import catalog
from blockcat.sources.blockstore import Blocks, BlockStore, _shared, pack


def test_pairs_of_one_title_are_many_tasks_work(spark):
    rows = [("t", f"/{i}") for i in range(40)] + [("t", "/0"), ("u", "/0"), ("u", "/1"), ("v", "/1"), ("v", None), (None, "/1")]
    got = catalog.competitors(spark.createDataFrame(rows, "title string, source_path string").coalesce(1), block=4).withColumn("task", F.spark_partition_id()).collect()
    want = sorted((a, p, q) for a, p in rows for b, q in rows if a == b and None not in (a, p, q) and p != q)
    assert sorted((r.title, r.source_path, r.other_path) for r in got) == want
    assert len({r.task for r in got if r.title == "t"}) > 1


def test_customers_of_the_same_title_keep_their_own_links(spark, tmp_path):
    keys = [2, 3, 6, 7, 12, 10_002, 10_004, 10_006, 10_012, 20_002, 20_012, 20_013]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    got = registry.QUERIES["mounted_titles"](spark, str(tmp_path)).select("title", "source_path", "image_path").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duck.execute(registry.ORACLE["mounted_titles"]).fetchall()))


def test_small_containers_share_tasks(spark, tmp_path):
    for i in range(60):
        (tmp_path / f"c{i:02}").write_bytes(pack([bytes([i, k]) * 9 for k in range(i % 4)], 1024, i % 4 * 1024))
    (tmp_path / "long").write_bytes(pack([bytes([k]) * 9 for k in range(10)], 1024, 10_000))
    spark.dataSource.register(BlockStore)
    got = spark.read.format("blockcat_blocks").option("blocks", "4").load(str(tmp_path))
    assert got.rdd.getNumPartitions() == 4  # three runs of the long one, and one task for the others
    want = {(f"c{i:02}", k, bytes([i, k]) * 9) for i in range(60) for k in range(i % 4)} | {("long", k, bytes([k]) * 9) for k in range(10)}
    assert sorted((r.container, r.idx, bytes(r.stored)) for r in got.collect()) == sorted(want)
    assert [sum(x.count for x in t.runs) for t in _shared([Blocks("p", 0, 3), Blocks("q", 0, 1), Blocks("r", 0, 1), Blocks("s", 0, 9)], 4)] == [4, 1, 9]


def test_ids_of_every_width_are_packed_by_whole_words(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(np, "unpackbits", None)  # a byte a bit was most of the time
    for width in range(33):
        for n in (0, 1, 127, 128, 129, 1000):
            ids = rng.integers(0, 2**width, n, dtype=np.uint64).astype(np.uint32)
            index, places, values, payload = token_files.encode_blocks(ids)
            assert len(payload) == 16 * int(index["width"].astype(int).sum()) and len(places) == len(values) == int(index["exceptions"].astype(int).sum())
            assert np.array_equal(token_files.decode_blocks(index, places, values, payload)[:n], ids)
    index, _, _, payload = token_files.encode_blocks(np.array([*range(64)] * 2, dtype=np.uint32), 100)
    bits = int.from_bytes(payload, "little")
    assert index["width"].tolist() == [6] and [bits >> 6 * i & 63 for i in range(128)] == [*range(64)] * 2
