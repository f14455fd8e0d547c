"""Queries over blocks, layouts, indexes, schedules and logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.operators import blocks as B
from blockcat.operators import index, layout, oplog, schedule
from blockcat.operators.shared import shared_folder, stored, value_before
from blockcat.plans import pipelines
from blockcat.sources import sinks
from blockcat.sources.blockstore import BlockStore
from blockcat.streaming import logs
from blockcat.plans.inputs import BLOCKS_SQL, FILES_SQL, PREDICTED_SQL, blocks, files, load

QUERIES, ORACLE = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Line items as stored blocks: container (order), idx, stored_len."""
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("container"), F.col("l_linenumber").cast("long").alias("idx"), (F.col("l_quantity") * 1000).cast("long").alias("stored_len")).groupBy("container", "idx").agg(F.max("stored_len").alias("stored_len"))


_STORED = "stored AS (SELECT l_orderkey AS container, l_linenumber::BIGINT AS idx, max((l_quantity * 1000)::BIGINT) AS stored_len FROM lineitem GROUP BY 1, 2)"
_OFFSETS = "offs AS (SELECT *, 1024 + coalesce(sum(stored_len) OVER (PARTITION BY container ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM stored)"


@query(f"""WITH {BLOCKS_SQL} SELECT container, idx, octet_length(data)::BIGINT AS len, sha256(data) AS sha FROM blocks""")
def block_digests(spark: SparkSession, d: str) -> DataFrame:
    return blocks(spark, d).select("container", "idx", F.octet_length("data").cast("long").alias("len"), B.digest(F.col("data")).alias("sha"))


@query(f"WITH {_STORED}, {_OFFSETS} SELECT container, idx, stored_len, off FROM offs")
def offset_table(spark: SparkSession, d: str) -> DataFrame:
    return B.offsets(_stored(spark, d), "container", "stored_len", 1024)


@query(f"""WITH {_STORED}, {_OFFSETS}, o AS (SELECT container, idx, stored_len, CASE WHEN container % 97 = 0 AND idx = 3 THEN 0 ELSE off END AS off FROM offs)
    SELECT container, idx, stored_len, off FROM (SELECT *, lag(off) OVER (PARTITION BY container ORDER BY idx) AS b FROM o) WHERE b > off""")
def monotone_check(spark: SparkSession, d: str) -> DataFrame:
    rows = B.offsets(_stored(spark, d), "container", "stored_len", 1024)
    return B.not_monotone(rows.withColumn("off", F.when((F.col("container") % 97 == 0) & (F.col("idx") == 3), F.lit(0)).otherwise(F.col("off"))), "container")


@query(f"""WITH {FILES_SQL} SELECT doc_id, container, rel, size, greatest(1, (size + 511) // 512)::BIGINT AS blocks,
    coalesce(sum(greatest(1, (size + 511) // 512)) OVER (PARTITION BY container ORDER BY lower(rel), rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_start FROM files""")
def block_start(spark: SparkSession, d: str) -> DataFrame:
    return layout.block_starts(files(spark, d), "container", 512, True)


_SEGMENTS = "seg AS (SELECT l_orderkey AS container, l_partkey * 17 % 9000 AS off, (l_quantity * 40)::BIGINT AS size, l_linenumber AS seg FROM lineitem)"


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").select(F.col("l_orderkey").alias("container"), (F.col("l_partkey") * 17 % 9000).alias("off"), (F.col("l_quantity") * 40).cast("long").alias("size"), F.col("l_linenumber").alias("seg"))


@query(f"""WITH {_SEGMENTS}, b AS (SELECT unnest(range(20)) AS idx)
    SELECT container, seg, off, size, idx, greatest(off, idx * 1024) AS lo, least(off + size, (idx + 1) * 1024) AS hi FROM seg JOIN b ON off < (idx + 1) * 1024 AND off + size > idx * 1024""")
def block_segment_overlap(spark: SparkSession, d: str) -> DataFrame:
    return B.overlaps(_segments(spark, d), "container", 1024)


@query(f"""WITH {_SEGMENTS}, {_STORED} SELECT container, idx, stored_len, EXISTS (SELECT 1 FROM seg s WHERE s.container = b.container AND s.size > 0 AND s.off < (b.idx + 1) * 1024 AND s.off + s.size > b.idx * 1024) AS force_raw FROM stored b""")
def force_raw_blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.forced_raw(_stored(spark, d), _segments(spark, d), "container", 1024)


@query("""WITH t AS (SELECT l_orderkey AS container, max(l_linenumber)::BIGINT + 1 AS blocks FROM lineitem GROUP BY 1),
    bad AS (SELECT DISTINCT l_orderkey AS container, l_linenumber::BIGINT AS idx FROM lineitem WHERE (l_orderkey + l_linenumber) % 13 = 0)
    SELECT DISTINCT container, n AS idx FROM bad JOIN t USING (container), unnest([idx - 1, idx, idx + 1]) AS u(n) WHERE n >= 0 AND n < blocks""")
def verify_neighbours(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("container"), F.col("l_linenumber").cast("long").alias("idx"))
    return B.verify_set(li.filter((F.col("container") + F.col("idx")) % 13 == 0), li.groupBy("container").agg((F.max("idx") + 1).alias("blocks")), "container")


_BAD = "bad AS (SELECT container, idx FROM stored WHERE (container + idx) % 5 = 0)"
_REPAIR = f"""rep AS (SELECT container, idx, stored_len, 1024 + coalesce(sum(stored_len) OVER w, 0)::BIGINT AS old_off,
        CASE WHEN (container + idx) % 5 = 0 THEN 65536 ELSE stored_len END AS new_len,
        1024 + coalesce(sum(CASE WHEN (container + idx) % 5 = 0 THEN 65536 ELSE stored_len END) OVER w, 0)::BIGINT AS new_off
    FROM stored WINDOW w AS (PARTITION BY container ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _repaired(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = B.offsets(_stored(spark, d), "container", "stored_len", 1024)
    bad = rows.filter((F.col("container") + F.col("idx")) % 5 == 0).select("container", "idx")
    return B.repaired_offsets(rows, bad, "container", start=1024), bad


@query(f"WITH {_STORED}, {_REPAIR} SELECT * FROM rep")
def repair_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _repaired(spark, d)[0]


@query(f"""WITH {_STORED}, {_REPAIR}, g AS (SELECT *, idx - row_number() OVER (PARTITION BY container ORDER BY idx) AS run FROM rep WHERE (container + idx) % 5 <> 0)
    SELECT container, min(idx) AS first, count(*) AS blocks, min(old_off) AS old_off, min(new_off) AS new_off, sum(new_len)::BIGINT AS size FROM g GROUP BY container, run""")
def copy_ranges(spark: SparkSession, d: str) -> DataFrame:
    rows, bad = _repaired(spark, d)
    return B.copy_ranges(rows, bad, "container")


@query(f"""WITH {_STORED}, {_REPAIR} SELECT container, CASE WHEN bool_or(new_off < old_off) AND bool_or(new_off > old_off) THEN 'mixed' WHEN bool_or(new_off < old_off) THEN 'left'
    WHEN bool_or(new_off > old_off) THEN 'right' ELSE 'overwrite' END AS strategy FROM rep WHERE (container + idx) % 5 <> 0 GROUP BY container""")
def apply_strategy(spark: SparkSession, d: str) -> DataFrame:
    rows, bad = _repaired(spark, d)
    return B.apply_strategy(rows.join(bad, ["container", "idx"], "left_anti"), "container")


def _live(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Blocks with a wrong stored hash here and there, and the same blocks with damage here and there."""
    own = blocks(spark, d)
    at = F.col("container") * 7 + F.col("idx")
    expected = own.withColumn("sha", F.when(at % 11 == 0, F.lit("stale")).otherwise(B.digest(F.col("data"))))
    return expected, own.withColumn("data", F.when(at % 13 == 0, F.concat(F.unhex(F.lit("00")), F.col("data"))).otherwise(F.col("data"))).filter(at % 17 != 0)


_STATE = "(CASE WHEN pos % 17 = 0 OR pos % 13 = 0 THEN 'bad' WHEN pos % 11 = 0 THEN 'matched-by-bytes' ELSE 'matched' END)"


@query(f"WITH {BLOCKS_SQL} SELECT container, idx, {_STATE} AS state, (CASE WHEN pos % 17 > 0 AND pos % 13 = 0 THEN 0 END)::BIGINT AS first_diff FROM (SELECT container, idx, container * 7 + idx AS pos FROM blocks)")
def verify_two_stage(spark: SparkSession, d: str) -> DataFrame:
    return B.compare(*_live(spark, d), "container")


@query(f"""WITH {BLOCKS_SQL} SELECT container, count(*) AS checked, count_if(s <> 'bad')::BIGINT AS matched, count_if(s <> 'matched')::BIGINT AS hash_mismatched, count_if(s = 'bad')::BIGINT AS bad
    FROM (SELECT container, {_STATE} AS s FROM (SELECT container, idx, container * 7 + idx AS pos FROM blocks)) GROUP BY container""")
def verify_hashes(spark: SparkSession, d: str) -> DataFrame:
    return B.outcome_counts(B.compare(*_live(spark, d), "container"), "container")


@query(f"""WITH {BLOCKS_SQL} SELECT container, idx, octet_length(data)::BIGINT AS len, sha256(data) AS sha FROM blocks WHERE (container * 7 + idx) % 13 = 0 OR (container * 7 + idx) % 17 = 0""")
def bad_block_report(spark: SparkSession, d: str) -> DataFrame:
    expected, live = _live(spark, d)
    bad = B.compare(expected, live, "container").filter("state = 'bad'").select("container", "idx")
    return blocks(spark, d).join(bad, ["container", "idx"]).select("container", "idx", F.octet_length("data").cast("long").alias("len"), B.digest(F.col("data")).alias("sha"))


@query("""SELECT o_orderkey AS container, o_custkey AS blocks, o_orderkey % 10 AS size, CASE WHEN c.c_custkey IS NULL THEN 'missing' WHEN o_orderkey % 3 = 0 THEN 'stale' ELSE 'used' END AS mode
    FROM orders LEFT JOIN customer c ON c_custkey = o_orderkey""")
def hash_mode(spark: SparkSession, d: str) -> DataFrame:
    orders = load(spark, d, "orders").select(F.col("o_orderkey").alias("container"), F.col("o_custkey").alias("blocks"), (F.col("o_orderkey") % 10).alias("size"))
    have = load(spark, d, "customer").select(F.col("c_custkey").alias("container"))
    side = orders.join(have, "container", "left_semi").withColumn("size", F.when(F.col("container") % 3 == 0, F.lit(-1)).otherwise(F.col("size")))
    return B.hash_mode(orders, side, "container")


@query("""SELECT doc_id, (CASE WHEN coalesce(strlen(text), 0) = 0 OR doc_id % 3 = 0 THEN -1 ELSE doc_id * 7919 % strlen(text) END)::BIGINT AS first_diff FROM documents""")
def first_difference(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts against copies that differ at some byte of the whole, or end there."""
    a = F.col("text").cast("binary")
    at = (F.col("doc_id") * 7919 % F.octet_length("text")).cast("int")
    head = F.substring(a, F.lit(1), at)
    other = F.when(F.col("doc_id") % 3 == 1, F.concat(head, F.unhex(F.lit("00")), F.substring(a, at + 2, F.octet_length("text")))).otherwise(head)
    b = F.when((F.col("doc_id") % 3 == 0) | (F.octet_length("text") == 0), a).otherwise(other)
    return B.first_differences(load(spark, d, "documents").select("doc_id", a.alias("a"), b.alias("b")), "a", "b").select("doc_id", "first_diff")


@query(f"WITH {FILES_SQL} SELECT container, lower(rel) AS folded, min(rel) AS rel, count(*) AS n FROM (SELECT container, rel FROM files UNION ALL SELECT container, upper(rel) FROM files WHERE doc_id % 9 = 0) GROUP BY 1, 2")
def index_dedup(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return layout.dedup_paths(f.select("container", "rel").unionByName(f.filter("doc_id % 9 = 0").select("container", S.ascii_upper(F.col("rel")).alias("rel"))), "container")


@query(f"""WITH {FILES_SQL}, g AS (SELECT container, doc_id % 40 AS hash, first(size ORDER BY doc_id) AS f, count(*) AS n FROM files GROUP BY 1, 2)
    SELECT container, hash, n, CASE WHEN n > 1 THEN 2147483648 + count_if(n > 1) OVER (PARTITION BY container ORDER BY hash) - 1 ELSE f END::BIGINT AS value FROM g""")
def path_table_collisions(spark: SparkSession, d: str) -> DataFrame:
    return layout.path_table(files(spark, d).select("container", (F.col("doc_id") % 40).alias("hash"), F.col("size").alias("value"), F.col("doc_id").alias("seq")), "container")


@query(f"""WITH {FILES_SQL}, r AS (SELECT DISTINCT container, regexp_replace(rel, '/[^/]*$', '') AS rel, 0 AS k FROM files UNION ALL SELECT container, rel, 1 FROM files)
    SELECT container, rel, k = 0 AS is_dir, 2 + row_number() OVER (PARTITION BY container ORDER BY k, lower(rel), rel) AS inode FROM r""")
def inode_numbers(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return layout.inode_numbers(f.select("container", S.parent(F.col("rel")).alias("rel")).distinct(), f, "container", 3)


@query(f"""WITH {FILES_SQL}, f AS (SELECT container, CASE WHEN doc_id % 12 = 5 THEN 'p' || doc_id || '.prx' WHEN doc_id % 97 = 0 THEN 'AMPR_emu.index' ELSE rel END AS rel, size, doc_id FROM files)
    SELECT *, row_number() OVER (PARTITION BY container ORDER BY regexp_matches(lower(rel), '^[^/]*\\.s?prx$') OR lower(rel) = 'ampr_emu.index', doc_id) - 1 AS place FROM f""")
def tail_partition(spark: SparkSession, d: str) -> DataFrame:
    """Files in the order they are given (here of their ids), those of the tail moved behind the others."""
    rel = F.when(F.col("doc_id") % 12 == 5, F.concat(F.lit("p"), F.col("doc_id").cast("string"), F.lit(".prx"))).when(F.col("doc_id") % 97 == 0, "AMPR_emu.index").otherwise(F.col("rel"))
    return layout.tail_order(files(spark, d).withColumn("rel", rel), "container", "doc_id")


@query("""WITH free AS (SELECT l_suppkey AS volume, o AS cluster FROM (SELECT DISTINCT l_suppkey FROM lineitem) s, unnest(range(200)) AS u(o)
        WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.l_suppkey AND l.l_partkey % 200 = o)),
    i AS (SELECT volume, max(cluster) AS last, count(*) AS n FROM (SELECT *, cluster - row_number() OVER (PARTITION BY volume ORDER BY cluster) AS run FROM free) GROUP BY volume, run)
    SELECT volume, max(last) - 2 AS first, 3::BIGINT AS count FROM i WHERE n >= 3 GROUP BY volume""")
def tail_run(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    used = li.select(F.col("l_suppkey").alias("volume"), (F.col("l_partkey") % 200).alias("cluster")).distinct().withColumn("used", F.lit(True))
    every = li.select(F.col("l_suppkey").alias("volume")).distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))))
    return layout.tail_run(every.join(used, ["volume", "cluster"], "left").withColumn("used", F.coalesce("used", F.lit(False))), 3, 2)


@query(f"WITH {FILES_SQL} SELECT min(greatest(doc_id, 500)) AS next_block FROM files WHERE doc_id + (size + 1023) // 1024 > 500 AND (size + 1023) // 1024 > 0")
def next_needed_block(spark: SparkSession, d: str) -> DataFrame:
    return layout.next_needed(files(spark, d).select(F.col("doc_id").alias("first_block"), S.ceil_div(F.col("size"), F.lit(1024)).alias("blocks")), 500)


@query(None)
def slot_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.slot_statistics(index.records(files(spark, d), "container"), "container")


@query("""SELECT conv_id, max(turn) AS turn, last(role ORDER BY turn) AS role, last(text ORDER BY turn) AS text FROM conversations GROUP BY conv_id""")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    return oplog.latest(load(spark, d, "conversations"), ["conv_id"], ["turn"], ["role", "text"])


@query("""SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id ORDER BY event_id DESC LIMIT 64""")
def history_topk(spark: SparkSession, d: str) -> DataFrame:
    return oplog.bounded_history(load(spark, d, "events"), ["user_id"], ["event_id"], [])


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n = 1 AND event_id % 4 <> 0""")
def size_cache_state(spark: SparkSession, d: str) -> DataFrame:
    log = load(spark, d, "events").select("user_id", "event_id", "event_type", F.when(F.col("event_id") % 4 == 0, 0).otherwise(1).alias("valid"))
    return oplog.cache_state(log, "user_id", ["event_id"], ["event_type"])


@query("""SELECT event_id, ts FROM events ORDER BY (event_id % 50 = 7) DESC, ts DESC, event_id LIMIT 256""")
def lru_keep(spark: SparkSession, d: str) -> DataFrame:
    return oplog.least_recent_out(load(spark, d, "events").select("event_id", "ts"), "ts", "event_id", busy=F.col("event_id") % 50 == 7)


@query("""SELECT user_id::VARCHAR AS path, max(CASE WHEN event_id % 5 = 0 THEN event_id END) AS first_at, min(event_id) AS arrived FROM events GROUP BY user_id ORDER BY first_at DESC NULLS LAST, arrived, path LIMIT 128""")
def priority_queue(spark: SparkSession, d: str) -> DataFrame:
    return oplog.queue_order(load(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("at"), (F.col("event_id") % 5 == 0).alias("priority"))).withColumnRenamed("at", "arrived")


@query("""SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type""")
def changed_sizes(spark: SparkSession, d: str) -> DataFrame:
    return oplog.changed_only(load(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", ["event_id"], "event_type")


@query("""SELECT l_orderkey, sum(greatest(0, (l_quantity * 100)::BIGINT - (l_linenumber * 700)))::BIGINT AS saved FROM lineitem GROUP BY l_orderkey""")
def savings(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(oplog.savings((F.col("l_quantity") * 100).cast("long"), F.col("l_linenumber").cast("long") * 700)).alias("saved"))


@query("""WITH j AS (SELECT user_id AS container, event_id AS idx, CASE event_id % 9 WHEN 0 THEN 0 WHEN 8 THEN 2 ELSE 1 END AS state FROM events)
    SELECT container, coalesce(min(CASE WHEN state = 0 THEN idx END), max(idx) + 1) AS known, count_if(state = 1)::BIGINT AS matched, count_if(state = 2)::BIGINT AS bad, count_if(state = 0)::BIGINT AS unknown FROM j GROUP BY container""")
def journal_prefix(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return oplog.known_prefix(load(spark, d, "events").select(F.col("user_id").alias("container"), e.alias("idx"), F.when(e % 9 == 0, 0).when(e % 9 == 8, 2).otherwise(1).alias("state")), "container")


@query(f"""WITH {FILES_SQL}, p AS (SELECT container, rel, size, doc_id, {PREDICTED_SQL} AS predicted FROM files),
    s AS (SELECT *, 300 + coalesce(sum(greatest(0, size - predicted)) OVER (PARTITION BY container ORDER BY lower(rel), rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS credit,
        row_number() OVER (PARTITION BY container ORDER BY lower(rel), rel) - 1 AS schedule_order FROM p)
    SELECT *, predicted > credit AS reverse_required FROM s""")
def schedule_path(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return schedule.by_path(f.withColumn("predicted", S.predicted_stored(F.col("size"), S.stored_ratio(F.col("rel")))), "container", 300)


@query(None)
def schedule_greedy(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return schedule.greedy(f.withColumn("predicted", S.predicted_stored(F.col("size"), S.stored_ratio(F.col("rel")))), "container", 300)


@query("""SELECT o_custkey AS container, sum(least(o_orderkey % 900, 500))::BIGINT AS freed, sum(o_orderkey % 70)::BIGINT AS temp, max(o_orderkey % 3000) AS output,
    greatest(0, 800 + sum(least(o_orderkey % 900, 500)) - max(o_orderkey % 3000) - sum(o_orderkey % 70))::BIGINT AS credit FROM orders GROUP BY o_custkey""")
def stream_credit(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    state = load(spark, d, "orders").select(F.col("o_custkey").alias("container"), (k % 900).alias("committed"), F.lit(500).cast("long").alias("original"), (k % 70).alias("reverse_temp"), (k % 3000).alias("output"))
    return schedule.credit_now(state, "container", 1000, 200)


@query(f"WITH {BLOCKS_SQL} SELECT container, count(*) AS blocks, sum(octet_length(data))::BIGINT AS bytes, true AS same FROM blocks GROUP BY container")
def unpack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Every block through the codec and back, compared with what went in (a short last block comes back padded)."""
    packed = B.encode(blocks(spark, d).withColumn("sha", B.digest(F.col("data"))).withColumn("len", F.octet_length("data")), 1024)
    back = B.decode(packed.drop("compressed"), 1024)
    same = F.col("error").isNull() & (B.digest(F.substring(F.col("data"), F.lit(1), F.col("len"))) == F.col("sha"))
    return back.groupBy("container").agg(F.count("*").alias("blocks"), F.sum(F.col("len").cast("long")).alias("bytes"), F.bool_and(same).alias("same"))


_PATCH = """patch AS (SELECT doc_id AS container, doc_id * 7919 % strlen(text) AS off, 'PATCH' || lpad((doc_id % 10)::VARCHAR, 95, 'x') AS bytes FROM documents WHERE strlen(text) > 0)"""


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """A patch for every document, within its bytes or beyond its end."""
    docs = load(spark, d, "documents").filter("octet_length(text) > 0")
    data = F.concat(F.lit("PATCH"), F.lpad((F.col("doc_id") % 10).cast("string"), 95, "x"))
    return docs.select(F.col("doc_id").alias("container"), (F.col("doc_id") * 7919 % F.octet_length("text")).alias("off"), F.lit(100).cast("long").alias("size"), data.cast("binary").alias("bytes"), F.lit(1).alias("seq"))


@query(f"WITH {_PATCH} SELECT DISTINCT container, n AS idx FROM patch, unnest(range(off // 1024, (off + 99) // 1024 + 1)) AS u(n)")
def changed_blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.changed_blocks(_patches(spark, d), "container", 1024)


_PATCHED = "whole AS (SELECT container, off, ((encode(d.text))[1:off] || encode(bytes) || (encode(d.text))[off + 101:])[1:strlen(d.text)] AS body FROM patch JOIN documents d ON d.doc_id = container)"


@query(f"""WITH {_PATCH}, {_PATCHED}
    SELECT container, n AS idx, sha256(body[n * 1024 + 1 : (n + 1) * 1024]) AS sha FROM whole, unnest(range(off // 1024, least((off + 99) // 1024, (octet_length(body) - 1) // 1024) + 1)) AS u(n)""")
def patch_blocks(spark: SparkSession, d: str) -> DataFrame:
    return B.patched(blocks(spark, d), _patches(spark, d), "container", 1024).select("container", "idx", B.digest(F.col("data")).alias("sha"))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """All documents but null ones as containers of packed blocks."""
    docs = load(spark, d, "documents").filter("octet_length(text) > 0")
    return pipelines.pack(docs.select(F.col("doc_id").alias("container"), F.col("text").cast("binary").alias("body")), 1024)


def _told(unpacked: DataFrame) -> DataFrame:
    return unpacked.select("container", F.octet_length("body").cast("long").alias("bytes"), F.sha2("body", 256).alias("sha"), "error")


_TOLD = "SELECT doc_id AS container, strlen(text)::BIGINT AS bytes, sha256(text) AS sha, NULL::VARCHAR AS error FROM documents WHERE strlen(text) > 0"


@query("""SELECT doc_id AS container, ((strlen(text) + 1023) // 1024)::BIGINT AS blocks, (CASE WHEN (strlen(text) + 1023) // 1024 + 1 <= 0 THEN 0 ELSE 1024 + (greatest(0, 8 * ((strlen(text) + 1023) // 1024 + 1)) + 1023) // 1024 * 1024 END)::BIGINT AS first_off,
    true AS in_order FROM documents WHERE strlen(text) > 0""")
def pack_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Packed containers: blocks, where the first one is stored, and whether each begins where the one before it ends."""
    rows = value_before(_packed(spark, d).withColumn("end", F.col("off") + F.col("stored_len")), "container", "idx", "end", "before")
    return rows.groupBy("container").agg(F.count("*").alias("blocks"), F.min("off").alias("first_off"), F.bool_and(F.col("before").isNull() | (F.col("before") == F.col("off"))).alias("in_order"))


@query(_TOLD)
def unpack_bodies(spark: SparkSession, d: str) -> DataFrame:
    return _told(pipelines.unpack(_packed(spark, d), 1024))


@query(_TOLD)
def repair_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks damaged in the store, found by their digests and replaced from the source: what is unpacked is the source again."""
    packed = _packed(spark, d)
    at = F.col("container") * 7 + F.col("idx")
    hurt = packed.withColumn("stored", F.when(at % 5 == 0, F.concat(F.lit("?").cast("binary"), F.substring("stored", 2, 2000))).otherwise(F.col("stored"))).withColumn("sha", F.when(at % 5 == 0, F.sha2(F.lit("?"), 256)).otherwise(F.col("sha")))
    source = blocks(spark, d)
    states = pipelines.verify(hurt, source, 1024)
    return _told(pipelines.unpack(pipelines.repair(hurt, states, source, 1024), 1024))


@query(f"WITH {_PATCH}, {_PATCHED} SELECT container, octet_length(body)::BIGINT AS bytes, sha256(body) AS sha, NULL::VARCHAR AS error FROM whole")
def patch_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Patched containers, checked to be in order and unpacked."""
    after = pipelines.patch(_packed(spark, d), _patches(spark, d), 1024)
    torn = B.not_monotone(after, "container").select("container").distinct()
    return _told(pipelines.unpack(after.join(torn, "container", "left_anti"), 1024))


@query("""SELECT doc_id AS container, strlen(text)::BIGINT AS source_size, CASE WHEN need <= doc_id % 5 * 4096 THEN 'verified' ELSE 'no-space' END AS outcome
    FROM (SELECT *, (strlen(text) + 1023) // 1024 * 1024 + 1024 + (8 * ((strlen(text) + 1023) // 1024 + 1) + 1023) // 1024 * 1024 AS need FROM documents WHERE strlen(text) > 0)""")
def compress_report(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").filter("octet_length(text) > 0").select(F.col("doc_id").alias("container"), F.col("text").cast("binary").alias("body"))
    _, report = pipelines.compress(docs, docs.select("container", (F.col("container") % 5 * 4096).alias("free")), 1024)
    return report.select("container", "source_size", "outcome")


@query("""SELECT doc_id AS container, r AS rel, sha256(CASE r WHEN 'a' THEN (encode(text))[1:strlen(text) // 3] WHEN 'b' THEN (encode(text))[strlen(text) // 3 + 1:] ELSE encode('') END) AS sha, NULL::VARCHAR AS error
    FROM documents, unnest(['a', 'b', 'empty']) AS u(r) WHERE strlen(text) > 0""")
def extract_files(spark: SparkSession, d: str) -> DataFrame:
    """Three files in each packed image: its first third, the rest, and an empty one."""
    n = F.octet_length("text").cast("long")
    third = F.call_function("div", n, F.lit(3))
    own = lambda rel, off, size: F.struct(F.lit(rel).alias("rel"), off.alias("image_offset"), size.alias("size"))
    zero = F.lit(0).cast("long")
    plan = load(spark, d, "documents").filter("octet_length(text) > 0").select(F.col("doc_id").alias("container"), F.inline(F.array(own("a", zero, third), own("b", third, n - third), own("empty", zero, zero))))
    return pipelines.extract(_packed(spark, d), plan, 1024).select("container", "rel", F.sha2("body", 256).alias("sha"), "error")


@query(f"""WITH {BLOCKS_SQL}, s AS (SELECT container, container * 7 + idx AS pos FROM blocks), c AS (SELECT container, count_if(pos % 17 = 0 OR pos % 13 = 0) AS bad, count_if(pos % 11 = 0) AS stale FROM s GROUP BY container)
    SELECT container, CASE WHEN bad > 0 THEN 'bad-blocks' ELSE 'ok' END AS status, bad::BIGINT AS bad FROM c""")
def repair_summaries(spark: SparkSession, d: str) -> DataFrame:
    counts = pipelines.outcome(B.compare(*_live(spark, d), "container"))
    rows = sinks.repair_summary(counts).withColumn("s", F.from_json("summary", "struct<status:string,rawMismatches:long>"))
    return rows.select("container", "s.status", F.col("s.rawMismatches").alias("bad"))


@query(f"""WITH {_STORED}, {_REPAIR} SELECT container, count(*) AS blocks, sum(stored_len)::BIGINT AS old, sum(new_len)::BIGINT AS new, list(idx ORDER BY idx) FILTER ((container + idx) % 5 = 0)::VARCHAR AS bad,
    (min(old_off) FILTER ((container + idx) % 5 = 0))::BIGINT AS first_bad FROM rep GROUP BY container HAVING count_if((container + idx) % 5 = 0) > 0""")
def patch_requests(spark: SparkSession, d: str) -> DataFrame:
    rows = B.offsets(_stored(spark, d), "container", "stored_len", 1024)
    asked = sinks.patch_request(rows, rows.filter((F.col("container") + F.col("idx")) % 5 == 0), 65_536)
    told = asked.withColumn("r", F.from_json("request", "struct<blockCount:long,oldStoredSize:long,newStoredSize:long,badBlocks:array<struct<block:long,storedOffset:long>>>"))
    numbers = F.concat(F.lit("["), F.array_join(F.col("r.badBlocks.block").cast("array<string>"), ", "), F.lit("]"))
    return told.select("container", F.col("r.blockCount").alias("blocks"), F.col("r.oldStoredSize").alias("old"), F.col("r.newStoredSize").alias("new"), numbers.alias("bad"), F.col("r.badBlocks")[0]["storedOffset"].alias("first_bad"))


@query("""WITH c AS (SELECT doc_id AS container, (strlen(text) + 1023) // 1024 AS n, strlen(text) AS logical, sha256((encode(text))[1:1024]) AS first FROM documents WHERE strlen(text) > 0)
    SELECT container, CASE container % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'invalid' WHEN 2 THEN 'stale' WHEN 3 THEN 'invalid' ELSE 'used' END AS mode, CASE WHEN container % 5 = 4 THEN first END AS first FROM c""")
def sidecar_modes(spark: SparkSession, d: str) -> DataFrame:
    """Binary sidecars that are missing, of a wrong magic, of another size, cut off, or fine."""
    parts = blocks(spark, d).groupBy("container").agg(F.array_sort(F.collect_list(F.struct("idx", F.unhex(B.digest(F.col("data"))).alias("h")))).alias("h"), F.sum(F.octet_length("data")).cast("long").alias("logical"), F.count("*").alias("blocks"))
    number = S.to_little_endian
    k = F.col("container") % 5
    head = F.concat(F.when(k == 1, F.lit("?").cast("binary")).otherwise(F.lit("P").cast("binary")), F.lit("FSCVHS1").cast("binary"), number(F.lit(1), 4), number(F.lit(4096), 4), number(F.lit(1024), 8), number(F.col("logical") + F.when(k == 2, 1).otherwise(0), 8), number(F.col("logical"), 8), number(F.col("blocks"), 8), number(F.lit(0), 4), number(F.lit(1), 4))
    body = F.unhex(F.array_join(F.transform("h", lambda x: F.hex(x["h"])), ""))
    whole = F.concat(F.rpad(head, 4096, F.unhex(F.lit("00"))), body)
    files_ = parts.filter(k > 0).select("container", F.when(k == 3, F.substring(whole, F.lit(1), F.octet_length(whole) - 1)).otherwise(whole).alias("content"))
    told = sinks.read_sidecars(files_, parts.select("container", "blocks", "logical", F.col("logical").alias("nested")), 1024)
    return told.select("container", "mode", F.col("digests")[0].alias("first"))


@query("""SELECT doc_id::VARCHAR AS container, strlen(text)::BIGINT AS bytes, sha256(text) AS sha, NULL::VARCHAR AS error FROM documents WHERE strlen(text) > 0""")
def container_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents packed, written to container files (every other one in an outer image), read back block by block, and unpacked. The folder must be mounted everywhere."""
    folder = f"{shared_folder(spark).removeprefix('file://').removeprefix('file:')}/containers-{uuid.uuid4().hex[:8]}"
    packed = _packed(spark, d).withColumn("container", F.col("container").cast("string"))
    sizes = load(spark, d, "documents").filter("octet_length(text) > 0").select(F.col("doc_id").cast("string").alias("container"), F.octet_length("text").cast("long").alias("size"))
    whole = stored(packed.join(sizes, "container").select("container", "idx", "stored", "size"), "to-write")
    odd = F.col("container").cast("long") % 2 == 1
    written = stored(sinks.write_containers(whole.filter(~odd), folder, 1024).unionByName(sinks.write_containers(whole.filter(odd), folder, 1024, wrapped=True)), "written")
    spark.dataSource.register(BlockStore)
    back = spark.read.format("blockcat_blocks").option("blocks", "64").load(folder).join(written.select("container").distinct(), "container", "left_semi")
    lens = back.join(sizes, "container").withColumn("len", F.least(F.lit(1024).cast("long"), F.col("size") - F.col("idx") * 1024))
    return _told(pipelines.unpack(lens.select("container", "idx", "len", "stored"), 1024))


@query(f"""WITH {FILES_SQL}, r AS (SELECT container, rel FROM files UNION ALL SELECT container, upper(rel) FROM files WHERE doc_id % 9 = 0), k AS (SELECT container, lower(rel) AS f, min(rel) AS rel FROM r GROUP BY 1, 2)
    SELECT container, rel FROM k""")
def index_records(spark: SparkSession, d: str) -> DataFrame:
    """The records of path indexes, the index's own name left out."""
    f = files(spark, d).select("container", "rel", "size", F.lit(0).cast("long").alias("mtime"))
    more = f.unionByName(files(spark, d).filter("doc_id % 9 = 0").select("container", S.ascii_upper(F.col("rel")).alias("rel"), "size", F.lit(0).cast("long").alias("mtime")))
    own = f.select("container").distinct().select("container", F.lit("Ampr_Emu.index").alias("rel"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime"))
    return pipelines.build_index(more.unionByName(own)).select("container", "rel")


@query("""WITH j AS (SELECT event_id % 40 AS container, event_id AS idx, CASE WHEN event_id % 9 = 0 THEN 0 ELSE 1 END AS state FROM events)
    SELECT container, idx FROM j WHERE state = 0 OR container % 4 = 0""")
def scan_resume(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that are still to be scanned: those that the journal doesn't know, and all of a container whose journal no longer fits it."""
    e = F.col("event_id")
    rows = load(spark, d, "events").select((e % 40).alias("container"), e.alias("idx"), F.when(e % 9 == 0, 0).otherwise(1).alias("state"))
    heads = rows.groupBy("container").agg(F.count("*").alias("blocks"), F.count_if(F.col("state") == 1).alias("matched"), F.lit(0).alias("bad"), F.count_if(F.col("state") == 1).alias("scanned"))
    now = heads.select("container", (F.col("blocks") + F.when(F.col("container") % 4 == 0, 1).otherwise(0)).alias("blocks"))
    fit = oplog.resumable(heads, now, ["container", "blocks"])
    return logs.unscanned(rows.select("container", "idx"), rows.join(fit.select("container"), "container", "left_semi"))


@query(f"""WITH {FILES_SQL}, p AS (SELECT container, rel, size, doc_id AS schedule_order FROM files),
    j AS (SELECT container, rel, doc_id AS k, CASE WHEN doc_id % 400 < 150 THEN 'done' WHEN doc_id % 7 = 0 THEN 'writing' END AS state, CASE WHEN doc_id % 7 = 0 THEN size // 2 ELSE size * 2 END AS committed FROM files),
    s AS (SELECT container, schedule_order, state = 'done' IS TRUE AS done, size, CASE WHEN state IS NOT NULL THEN committed ELSE 0 END AS committed FROM p JOIN j USING (container, rel))
    SELECT container, count_if(done)::BIGINT AS done, sum(CASE WHEN done THEN size ELSE least(committed, size) END)::BIGINT AS freed, min(CASE WHEN NOT done THEN schedule_order END) AS next,
        arg_min(committed, schedule_order) FILTER (NOT done)::BIGINT AS partial FROM s GROUP BY container""")
def stream_resume(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    k = F.col("doc_id")
    plan = f.select("container", "rel", "size", k.alias("schedule_order"))
    lines = f.select("container", "rel", F.when(k % 400 < 150, "done").when(k % 7 == 0, "writing").alias("state"), F.when(k % 7 == 0, S.ceil_div(F.col("size") - 1, F.lit(2))).otherwise(F.col("size") * 2).alias("committed"))
    journal = lines.filter("state is not null").withColumn("seq", F.lit(2)).unionByName(lines.filter("state is not null").withColumn("seq", F.lit(1)).withColumn("state", F.lit("started")).withColumn("committed", F.lit(0).cast("long")))
    return schedule.resume(plan, journal, "container")
