"""Queries over roots, probes, enrichment, lookups and virtual images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.operators import blocks as B
from blockcat.operators import catalog as C
from blockcat.operators import layout, oplog
from blockcat.operators.shared import running_totals
from blockcat.plans.inputs import FILES_SQL, files, load

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query("""WITH r AS (SELECT regexp_replace('/r/' || (n_nationkey % 7), '/+$', '') AS root, 0 AS list, n_nationkey::BIGINT AS pos FROM nation
    UNION ALL SELECT '/r/' || (c_custkey % 11), 1, c_custkey FROM customer)
    SELECT root, first(list ORDER BY list, pos) AS list, first(pos ORDER BY list, pos) AS pos FROM r GROUP BY root""")
def scan_roots(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "nation").select(F.concat(F.lit("/r/"), (F.col("n_nationkey") % 7).cast("string"), F.lit("/")).alias("root"), F.col("n_nationkey").alias("pos"))
    b = load(spark, d, "customer").select(F.concat(F.lit("/r/"), (F.col("c_custkey") % 11).cast("string")).alias("root"), F.col("c_custkey").alias("pos"))
    return C.distinct_roots([a, b]).select("root", "at.list", "at.pos")


@query("""SELECT 'd' || doc_id AS dir, 'T' || doc_id AS title FROM documents WHERE doc_id % 3 = 0 AND doc_id % 5 <> 0""")
def app_probe(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").select("doc_id")
    i = F.col("doc_id").cast("string")
    found = docs.select(F.concat(F.lit("d"), i, F.when(F.col("doc_id") % 3 == 0, "/EBOOT.bin").otherwise("/sub/eboot.bin")).alias("rel"))
    key = F.when(F.col("doc_id") % 2 == 0, "titleId").otherwise(F.when(F.col("doc_id") % 5 == 0, "name").otherwise("title_id"))
    params = docs.filter("doc_id % 5 <> 0 or doc_id % 2 = 1").select(F.concat(F.lit("d"), i).alias("dir"), F.concat(F.lit('{"'), key, F.lit('":"T'), i, F.lit('"}')).alias("json"))
    return C.apps(found, params)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN 'PPSA' || lpad((doc_id % 100000)::VARCHAR, 5, '0') END AS title FROM documents""")
def title_in_name(spark: SparkSession, d: str) -> DataFrame:
    digits = F.lpad((F.col("doc_id") % 100_000).cast("string"), 5, "0")
    path = F.concat(F.lit("/PPSA99999/x-"), F.when(F.col("doc_id") % 3 == 0, "none").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("ppsa"), digits, F.lit("-v1"))).otherwise(F.concat(F.lit("PPSA"), digits)), F.lit(".img"))
    return load(spark, d, "documents").select("doc_id", S.title_id_in_name(path).alias("title"))


@query("""SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1, 2) THEN doc_id * 7919 % 4294967296 END AS hash FROM documents""")
def mount_hash(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 6
    h = F.lpad(F.hex(F.col("doc_id") * 7919 % (1 << 32)), 8, "0")
    path = F.concat(F.when(k == 3, "/mnt/views/T1_").otherwise("/mnt/view/T1_"), F.when(k == 1, F.lower(h)).when(k == 4, F.concat(F.lit("x"), h)).otherwise(h), F.when(k == 2, "/x/y").when(k == 5, "\n").otherwise(""))
    return load(spark, d, "documents").select("doc_id", S.mount_hash(path, F.lit("T1"), "/mnt/view").alias("hash"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'a b&c' || page_id END AS arg FROM pages""")
def query_arguments(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("/api?x=1"), F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("&path=a+b%26c"), F.col("page_id").cast("string"))).otherwise("&paths=1"), F.lit("&y=2"))
    return load(spark, d, "pages").select("page_id", S.query_argument(url, "path").alias("arg"))


@query("""SELECT o_orderkey, 1000000 + (o_custkey + 2 - 2) * 65536 AS off FROM orders""")
def cluster_offsets(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", S.cluster_offset(F.col("o_custkey") + 2, 1_000_000).alias("off"))


@query(f"""WITH {FILES_SQL} SELECT container, bool_or(doc_id % 31 = 0) AS needs_index, count_if(doc_id % 29 = 0)::BIGINT AS unsupported FROM files GROUP BY container""")
def index_needed(spark: SparkSession, d: str) -> DataFrame:
    rel = F.when(F.col("doc_id") % 31 == 0, "Module/Marker.prx").when(F.col("doc_id") % 29 == 0, "a\tb").otherwise(F.col("rel"))
    rows = files(spark, d).withColumn("bad", F.when(F.col("doc_id") % 29 == 0, ~S.index_path_supported(F.lit("a\tb"))).otherwise(~S.index_path_supported(F.col("rel")))).withColumn("rel", rel)
    return rows.groupBy("container").agg(F.bool_or(S.index_marker(F.col("rel"), ["module/marker.prx", "lib/marker.sprx"])).alias("needs_index"), F.count_if("bad").alias("unsupported"))


@query("""SELECT c_custkey, '/data/' || c_custkey AS source_path, CASE WHEN c_custkey % 3 = 0 THEN c_custkey * 10 ELSE 0 END AS size, c_custkey % 3 <> 0 AS size_pending FROM customer""")
def size_enrichment(spark: SparkSession, d: str) -> DataFrame:
    games = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("/data/"), F.col("c_custkey").cast("string")).alias("source_path"))
    return C.with_sizes(games, games.filter("c_custkey % 3 = 0").select(F.col("source_path").alias("path"), (F.col("c_custkey") * 10).alias("size")))


@query("""WITH g AS (SELECT c_custkey AS title, c_custkey % 5 AS own_root, 500::BIGINT AS compressed FROM customer),
    f AS (SELECT c_custkey AS title, r_regionkey AS root, r_regionkey AS pos, (c_custkey * 37 + r_regionkey * 211) % 1000 AS size FROM customer, region WHERE (c_custkey + r_regionkey) % 2 = 0),
    c AS (SELECT g.title, f.size, f.root <> g.own_root AS a, f.pos FROM g JOIN f USING (title) WHERE f.root = g.own_root OR f.size > g.compressed)
    SELECT g.title, own_root, compressed, x.source_size FROM g LEFT JOIN (SELECT title, first(size ORDER BY a, pos, size) AS source_size FROM c GROUP BY title) x USING (title)""")
def source_inference(spark: SparkSession, d: str) -> DataFrame:
    customer, region = load(spark, d, "customer"), load(spark, d, "region")
    games = customer.select(F.col("c_custkey").alias("title"), (F.col("c_custkey") % 5).alias("own_root"), F.lit(500).cast("long").alias("compressed"))
    pairs = customer.select("c_custkey", F.explode(F.array(*[F.lit(i) for i in range(region.count())])).alias("r")).filter("(c_custkey + r) % 2 = 0")
    return C.compression_source(games, pairs.select(F.col("r").alias("root"), F.col("r").alias("pos"), F.col("c_custkey").alias("title"), ((F.col("c_custkey") * 37 + F.col("r") * 211) % 1000).alias("size")))


@query("""SELECT conv_id AS key, 'memory' AS side FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 = 0)
    UNION ALL SELECT DISTINCT conv_id, 'persisted' FROM conversations WHERE conv_id % 3 <> 0""")
def history_union(spark: SparkSession, d: str) -> DataFrame:
    keys = load(spark, d, "conversations").select(F.col("conv_id").alias("key")).distinct()
    return C.not_in_memory(keys.withColumn("side", F.lit("persisted")), keys.filter("key % 3 = 0").withColumn("side", F.lit("memory")))


@query(f"WITH {FILES_SQL} SELECT rel, size FROM files WHERE doc_id <> 7 UNION ALL SELECT upper(rel), 99 FROM files WHERE doc_id = 7")
def index_refresh(spark: SparkSession, d: str) -> DataFrame:
    f = files(spark, d)
    return C.refreshed(f.select("rel", "size"), f.filter("doc_id = 7").select(F.upper("rel").alias("rel"), F.lit(99).cast("long").alias("size")))


_ACTIONS = ("compress", "uncompress", "extract-image", "validate-repair", "validate-only", "move-to-usb", "move-to-internal", "copy-to-usb", "set-read-only", "other")


@query(f"""WITH o AS (SELECT o_orderkey, ['queued', 'running', 'success', 'failed', 'cancelled', 'odd'][(o_orderkey % 6 + 1)::INT] AS status, {list(_ACTIONS)}[(o_orderkey % 10 + 1)::INT] AS action FROM orders)
    SELECT o_orderkey, CASE status WHEN 'queued' THEN 'pending' WHEN 'odd' THEN 'unknown' ELSE status END AS label, CASE action WHEN 'other' THEN 'unknown' ELSE action END AS action,
        CASE action WHEN 'compress' THEN 'Compress' WHEN 'uncompress' THEN 'Unpack' WHEN 'extract-image' THEN 'Extract' WHEN 'validate-repair' THEN 'Repair' WHEN 'validate-only' THEN 'Validate' WHEN 'move-to-usb' THEN 'Move' WHEN 'move-to-internal' THEN 'Move' ELSE 'Operation' END AS doing,
        CASE action WHEN 'compress' THEN 'Compressed' WHEN 'uncompress' THEN 'Unpacked' WHEN 'extract-image' THEN 'Extracted' WHEN 'validate-repair' THEN 'Validated and repaired' WHEN 'validate-only' THEN 'Validated' WHEN 'move-to-usb' THEN 'Moved to USB' WHEN 'move-to-internal' THEN 'Moved to internal storage' ELSE 'Completed' END AS done,
        CASE action WHEN 'compress' THEN 'Cancelled compression' WHEN 'uncompress' THEN 'Cancelled unpack' WHEN 'extract-image' THEN 'Cancelled extract' WHEN 'validate-repair' THEN 'Cancelled validation and repair' WHEN 'validate-only' THEN 'Cancelled validation' WHEN 'move-to-usb' THEN 'Cancelled USB move' WHEN 'move-to-internal' THEN 'Cancelled internal move' ELSE 'Cancelled operation' END AS stopped FROM o""")
def status_labels(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("o_orderkey") % len(xs) + 1).cast("int"))
    action = pick(_ACTIONS)
    status = pick(("queued", "running", "success", "failed", "cancelled", "odd"))
    return load(spark, d, "orders").select("o_orderkey", S.label_of(status).alias("label"), S.action_name(action).alias("action"), S.action_label(action).alias("doing"), S.past_label(action).alias("done"), S.cancel_label(action).alias("stopped"))


@query("""SELECT min(o_orderkey) AS seq FROM orders WHERE o_orderstatus = 'O' HAVING min(o_orderkey) IS NOT NULL""")
def next_queued(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").otherwise("success")
    return oplog.next_queued(load(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), status.alias("status")))


@query("""SELECT min(o_orderkey) AS seq FROM orders WHERE o_orderstatus NOT IN ('O', 'P')""")
def slot_to_reuse(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").otherwise("failed")
    return oplog.slot_to_reuse(load(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), status.alias("status")))


@query(f"WITH {FILES_SQL} SELECT container, count(*) AS entries, sum(size)::BIGINT AS bytes, sum((size + 511) // 512)::BIGINT AS blocks FROM files GROUP BY container")
def extract_totals(spark: SparkSession, d: str) -> DataFrame:
    return layout.extract_totals(files(spark, d), "container", 512)


@query(f"WITH {FILES_SQL} SELECT container, rel, size FROM files WHERE lower(rel) <> 'en/data/f8.bin'")
def list_without(spark: SparkSession, d: str) -> DataFrame:
    return layout.without(files(spark, d).select("container", "rel", "size"), "EN/DATA/F8.bin")


@query(f"WITH {FILES_SQL} SELECT doc_id, row_number() OVER (ORDER BY doc_id % 50 * 512, size, rel) - 1 AS place FROM files")
def extract_order(spark: SparkSession, d: str) -> DataFrame:
    ordered = layout.extract_order(files(spark, d).select("doc_id", "rel", "size", (F.col("doc_id") % 50 * 512).alias("image_offset")))
    return running_totals(ordered, ["image_offset", "size", "rel"], label="extract-order").select("doc_id", F.col("before").alias("place"))


@query("""WITH u AS (SELECT DISTINCT l_suppkey AS volume, l_partkey % 200 AS cluster FROM lineitem) SELECT volume, count(*) AS used, 200 - count(*) AS free FROM u GROUP BY volume""")
def allocated_clusters(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    used = li.select(F.col("l_suppkey").alias("volume"), (F.col("l_partkey") % 200).alias("cluster")).distinct().withColumn("used", F.lit(True))
    every = li.select(F.col("l_suppkey").alias("volume")).distinct().withColumn("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))))
    return layout.allocated(every.join(used, ["volume", "cluster"], "left").withColumn("used", F.coalesce("used", F.lit(False))))


@query("""WITH r AS (SELECT doc_id // 40 AS container, doc_id % 40 AS idx, sha256((doc_id // 3)::VARCHAR) AS sha, doc_id % 7 = 3 AS verified FROM documents),
    s AS (SELECT *, lag(sha) OVER (PARTITION BY container ORDER BY idx) AS b, min(CASE WHEN verified THEN idx END) OVER (PARTITION BY container) AS f FROM r)
    SELECT container, idx, sha, verified, coalesce(idx >= f AND NOT coalesce(b = sha, false), false) AS trusted FROM s""")
def stale_reads(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    reads = load(spark, d, "documents").select(F.expr("doc_id div 40").alias("container"), (i % 40).alias("idx"), F.sha2(F.expr("doc_id div 3").cast("string"), 256).alias("sha"), (i % 7 == 3).alias("verified"))
    return oplog.stale_reads(reads, "container")


@query("""SELECT l_orderkey AS container, coalesce(bool_and(n IS NULL OR n = c + 1), true) AS contiguous
    FROM (SELECT l_orderkey, c, lead(c) OVER (PARTITION BY l_orderkey ORDER BY p) AS n FROM
        (SELECT l_orderkey, l_linenumber AS p, max(CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber * 2 ELSE l_linenumber END) AS c FROM lineitem GROUP BY ALL)) GROUP BY l_orderkey""")
def contiguity_check(spark: SparkSession, d: str) -> DataFrame:
    c = F.when(F.col("l_orderkey") % 3 == 0, F.col("l_linenumber") * 2).otherwise(F.col("l_linenumber"))
    chain = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("container"), F.col("l_linenumber").alias("place"), c.alias("cluster")).groupBy("container", "place").agg(F.max("cluster").alias("cluster"))
    return B.contiguous(chain, "container")


@query("""WITH s AS (SELECT doc_id AS container, encode(substr(md5(doc_id::VARCHAR), 1, 20)) AS a, 1500 + doc_id % 600 AS off FROM documents),
    w AS (SELECT container, unhex(repeat('00', off::INT)) || a || unhex(repeat('00', (3000 - 20 - off)::INT)) AS body FROM s)
    SELECT container, n AS idx, sha256(body[n * 1024 + 1 : least(3000, (n + 1) * 1024)]) AS sha FROM w, unnest(range(3)) AS u(n)""")
def virtual_image(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    segments = docs.select(F.col("doc_id").alias("container"), (F.lit(1500) + F.col("doc_id") % 600).alias("off"), F.substring(F.md5(F.col("doc_id").cast("string")), 1, 20).cast("binary").alias("bytes"))
    totals = docs.select(F.col("doc_id").alias("container"), F.lit(3000).cast("long").alias("size"))
    return B.virtual_blocks(segments, totals, "container", 1024).select("container", "idx", B.digest(F.col("data")).alias("sha"))


def _titles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c, e = F.col("c_custkey"), F.col("event_id")
    pick = lambda xs, k: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    games = load(spark, d, "customer").select(
        F.concat(F.lit("T"), (c % 400).cast("string")).alias("title"), F.concat(pick(("/data/", "/mnt/usb1/"), c), c.cast("string")).alias("source_path"), F.col("c_name").alias("name"), pick(("folder", "image", "compressed", "unknown"), c).alias("kind"),
        F.lit("").alias("output_path"), (c * 10).alias("size"), F.when(c % 3 == 0, F.lit(0).cast("long")).otherwise(c * 4).alias("compressed"), (c % 2 == 0).alias("is_mounted"), F.when(c % 5 == 0, "working").otherwise("").alias("mount_status"),
    )
    ops = load(spark, d, "events").select(
        F.concat(F.lit("T"), (e % 600).cast("string")).alias("title"), F.when(e % 20 == 0, "").otherwise(F.concat(F.lit("/data/"), (e % 1500).cast("string"), F.lit("/"))).alias("path"), F.concat(F.lit("op-"), e.cast("string")).alias("op_id"),
        pick(("compress", "odd"), e).alias("action"), pick(("running", "queued", "success"), e).alias("status"), e.alias("slot"), e.alias("seq"), F.lit("").alias("output_path"), F.when(e % 4 == 0, "").otherwise("shown").alias("display_name"), F.lit("unknown").alias("kind"),
    )
    return games, ops


_TITLES = """games AS (SELECT 'T' || (c_custkey % 400) AS title, ['/data/', '/mnt/usb1/'][(c_custkey % 2 + 1)::INT] || c_custkey AS source_path, c_name AS name, ['folder', 'image', 'compressed', 'unknown'][(c_custkey % 4 + 1)::INT] AS kind,
        c_custkey * 10 AS size, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey * 4 END AS compressed, c_custkey % 2 = 0 AS is_mounted, CASE WHEN c_custkey % 5 = 0 THEN 'working' WHEN c_custkey % 2 = 0 THEN 'mounted' ELSE 'not-mounted' END AS mount FROM customer),
    ops AS (SELECT 'T' || (event_id % 600) AS title, CASE WHEN event_id % 20 = 0 THEN '' ELSE '/data/' || (event_id % 1500) END AS path, ['running', 'queued', 'success'][(event_id % 3 + 1)::INT] AS status, event_id AS slot FROM events)"""


@query(f"""WITH {_TITLES}, m AS (SELECT g.title, g.source_path, min(CASE WHEN o.status = 'running' THEN slot END) AS active, min(CASE WHEN o.status = 'queued' THEN slot END) AS pending
        FROM games g LEFT JOIN ops o ON g.title = o.title AND (o.path = '' OR o.path = g.source_path) GROUP BY ALL)
    SELECT title, source_path, kind, size::BIGINT AS size, mount, CASE WHEN compressed > 0 THEN greatest(0, size - compressed) ELSE 0 END::BIGINT AS saved, 'op-' || active AS active, CASE WHEN active IS NOT NULL THEN 'running' END AS active_status,
        'op-' || pending AS pending, CASE WHEN pending IS NOT NULL THEN 'pending' END AS pending_status, CASE WHEN source_path LIKE '/data/%' THEN 'internal' ELSE 'usb' END AS storage, kind <> 'unknown' AND source_path NOT LIKE '/data/%' AS movable
    FROM games JOIN m USING (title, source_path)""")
def catalog_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summaries, read back from their JSON."""
    op = "struct<id:string,action:string,status:string>"
    rows = C.summary(*_titles(spark, d)).withColumn("s", F.from_json("summary", f"struct<sourceKind:string,sourceSize:long,mountStatus:string,savedBytes:long,storage:string,canMoveToInternal:boolean,activeOp:{op},pendingOp:{op}>"))
    return rows.select("title", "source_path", F.col("s.sourceKind").alias("kind"), F.col("s.sourceSize").alias("size"), F.col("s.mountStatus").alias("mount"), F.col("s.savedBytes").alias("saved"), F.col("s.activeOp.id").alias("active"), F.col("s.activeOp.status").alias("active_status"), F.col("s.pendingOp.id").alias("pending"), F.col("s.pendingOp.status").alias("pending_status"), F.col("s.storage").alias("storage"), F.col("s.canMoveToInternal").alias("movable"))


@query(f"""WITH {_TITLES}, alone AS (SELECT title, path, max(slot) AS slot FROM ops WHERE status <> 'success' AND title NOT IN (SELECT title FROM games) GROUP BY title, path)
    SELECT title, name, kind, source_path, mount AS status FROM games UNION ALL SELECT title, CASE WHEN slot % 4 = 0 THEN title ELSE 'shown' END, 'unknown', CASE WHEN path = '' THEN '' ELSE path || '/' END, 'working' FROM alone""")
def games_and_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    games, ops = _titles(spark, d)
    mount = F.when(F.col("mount_status") != "", F.col("mount_status")).when(F.col("is_mounted"), "mounted").otherwise("not-mounted")
    return C.with_fallbacks(games.withColumn("status", mount), ops)
