"""Queries over the catalogue's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.operators import catalog as C
from blockcat.plans.inputs import FILES_SQL, files, load
from blockcat.sources.sinks import upsert_markers

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


@query(f"WITH {FILES_SQL} SELECT container, count(*) AS entries, count_if(doc_id % 7 > 0)::BIGINT AS files, count_if(doc_id % 7 = 0)::BIGINT AS dirs, coalesce(sum(CASE WHEN doc_id % 7 > 0 THEN size END), 0)::BIGINT AS bytes FROM files GROUP BY container")
def disk_usage(spark: SparkSession, d: str) -> DataFrame:
    return C.disk_usage(files(spark, d).withColumn("is_dir", F.col("doc_id") % 7 == 0), "container")


@query(f"""WITH {FILES_SQL} SELECT container, count(*) AS entries, count_if(doc_id % 5 > 0)::BIGINT AS files, count_if(doc_id % 5 = 0)::BIGINT AS dirs,
    coalesce(sum(CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 > 0 AND size > 0 THEN (size + 511) // 512 * 512 ELSE size END), 0)::BIGINT AS bytes FROM files GROUP BY container""")
def disk_usage_allocated(spark: SparkSession, d: str) -> DataFrame:
    rows = files(spark, d).withColumn("is_dir", F.col("doc_id") % 5 == 0).withColumn("blocks", F.when(F.col("doc_id") % 3 > 0, S.ceil_div(F.col("size"), F.lit(512))).otherwise(F.lit(0)))
    return C.disk_usage(rows, "container", allocated=True)


@query(f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'folder' WHEN doc_id % 4 = 1 THEN 'unknown' WHEN lower(rel) LIKE '%.dat' THEN 'image' ELSE 'unknown' END AS kind FROM files""")
def classify_sources(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", C.classify(F.col("rel"), F.col("doc_id") % 4 < 2, F.col("doc_id") % 4 == 0).alias("kind"))


def _games(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").select(F.concat(F.lit("T"), (F.col("c_custkey") % 400).cast("string")).alias("title"), F.concat(F.lit("/data/"), F.col("c_custkey").cast("string")).alias("source_path"), "c_custkey")


_GAMES = "games AS (SELECT 'T' || (c_custkey % 400) AS title, '/data/' || c_custkey AS source_path, c_custkey FROM customer)"


@query("""WITH r AS (
        SELECT c_custkey % 700 AS instance, 'folder' AS kind, 'm' || c_custkey AS path, true AS is_mounted, '/mnt/' || c_custkey AS mount_path, 0 AS side FROM customer
        UNION ALL SELECT s_suppkey * 3, CASE WHEN s_suppkey % 2 = 0 THEN 'compressed' ELSE 'image' END, 'a' || s_suppkey, false, NULL, 1 FROM supplier)
    SELECT instance, first(kind ORDER BY (kind <> 'compressed')::INT, side, kind, path) AS kind, first(path ORDER BY (kind <> 'compressed')::INT, side, kind, path) AS path,
        bool_or(is_mounted) AS is_mounted, min(mount_path) AS mount_path FROM r GROUP BY instance""")
def catalog_union_dedup(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("c_custkey")
    mounted = load(spark, d, "customer").select((key % 700).alias("instance"), F.lit("folder").alias("kind"), F.concat(F.lit("m"), key.cast("string")).alias("path"), F.lit(True).alias("is_mounted"), F.concat(F.lit("/mnt/"), key.cast("string")).alias("mount_path"))
    s = F.col("s_suppkey")
    found = load(spark, d, "supplier").select((s * 3).alias("instance"), F.when(s % 2 == 0, "compressed").otherwise("image").alias("kind"), F.concat(F.lit("a"), s.cast("string")).alias("path"), F.lit(False).alias("is_mounted"), F.lit(None).cast("string").alias("mount_path"))
    return C.union_by_instance(mounted, found)


def _operations(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return load(spark, d, "events").select(F.concat(F.lit("T"), (e % 600).cast("string")).alias("title"), F.when(e % 20 == 0, "").otherwise(F.concat(F.lit("/data/"), (e % 1500).cast("string"))).alias("path"), e.alias("op_id"), F.when(e % 30 == 0, "running").otherwise("queued").alias("status"), e.alias("seq"))


_OPS = """ops AS (SELECT 'T' || (event_id % 600) AS title, CASE WHEN event_id % 20 = 0 THEN '' ELSE '/data/' || (event_id % 1500) END AS path, event_id AS op_id,
    CASE WHEN event_id % 30 = 0 THEN 'running' ELSE 'queued' END AS status, event_id AS seq FROM events)"""


@query(f"""WITH {_GAMES}, {_OPS} SELECT g.title, g.source_path, g.c_custkey, min(o.op_id) AS op_id, first(o.status ORDER BY o.seq) AS op_status
    FROM games g LEFT JOIN ops o ON g.title = o.title AND (o.path = '' OR o.path = g.source_path) GROUP BY ALL""")
def games_with_ops(spark: SparkSession, d: str) -> DataFrame:
    return C.with_operations(_games(spark, d), _operations(spark, d))


@query(f"""WITH {_GAMES}, {_OPS} SELECT title, path, max(op_id) AS op_id, last(status ORDER BY seq) AS status FROM ops WHERE title NOT IN (SELECT title FROM games) GROUP BY title, path""")
def ops_without_games(spark: SparkSession, d: str) -> DataFrame:
    return C.operations_without_title(_games(spark, d), _operations(spark, d))


@query("""WITH old AS (SELECT doc_id, quality % 2 AS indexed, 'old' AS state FROM labels), new AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 END::INT AS indexed, 'new' AS state FROM documents WHERE doc_id % 3 > 0)
    SELECT coalesce(n.doc_id, o.doc_id) AS doc_id, coalesce(n.indexed, o.indexed)::INT AS indexed, coalesce(n.state, o.state) AS state FROM new n FULL JOIN old o ON n.doc_id = o.doc_id""")
def marker_state(spark: SparkSession, d: str) -> DataFrame:
    old = load(spark, d, "labels").select("doc_id", (F.col("quality") % 2).cast("int").alias("indexed"), F.lit("old").alias("state"))
    new = load(spark, d, "documents").filter("doc_id % 3 > 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.lit(1)).alias("indexed"), F.lit("new").alias("state"))
    return upsert_markers(old, new, ["doc_id"], ["indexed"])


@query("""WITH v AS (SELECT sha256(text) AS sha, max('v' || item_id) AS version FROM benchmark GROUP BY 1)
    SELECT i.item_id, v.version FROM benchmark i LEFT JOIN v ON sha256(i.text) = v.sha""")
def version_match(spark: SparkSession, d: str) -> DataFrame:
    b = load(spark, d, "benchmark")
    versions = b.select(F.upper(F.sha2("text", 256)).alias("sha256"), F.concat(F.lit("v"), F.col("item_id").cast("string")).alias("version"))
    return C.version_of_hash(b.select("item_id", F.sha2("text", 256).alias("sha256")), versions).select("item_id", "version")


@query(f"""WITH {FILES_SQL}, p AS (SELECT string_split(rel, '/') AS x FROM files)
    SELECT DISTINCT array_to_string(x[1:n], '/') AS dir FROM p, unnest(range(1, len(x))) AS u(n)""")
def parent_dirs(spark: SparkSession, d: str) -> DataFrame:
    return C.parent_dirs(files(spark, d))


_TITLES = (
    ('{"localizedParameters":{"defaultLanguage":"xx","fr-FR":{"titleName":"fr"},"en-US":{"titleName":"","name":"en@"}}}', "en@"),
    ('{"localizedParameters":{"defaultLanguage":"de-DE","en-US":{"titleName":"us"},"de-DE":{"titleName":"de@","name":"no"}}}', "de@"),
    ('{"localizedParameters":{"fr-FR":{"titleName":"fr"},"EN-AU":{"titleName":"au@"}}}', "au@"),
    ('{"localizedParameters":{"de-DE":"x","fr-FR":{"name":"fr@"}},"titleName":"no"}', "fr@"),
    ('{"localizedParameters":{"defaultLanguage":"fr-FR"},"x":{"titleName":"deep@"},"titleName":"late"}', "deep@"),
    ('{"titleName":"","name":"plain@"}', "plain@"),
    ('{"locales":{"en-US":{"titleId":"no"}}}', "T@"),
    ("not json", "T@"),
)


@query("SELECT doc_id, replace(" + str([t for _, t in _TITLES]) + "[(doc_id % 8 + 1)::INT], '@', doc_id::VARCHAR) AS title FROM documents")
def localized_title(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id").cast("string")
    json = F.replace(F.element_at(F.array(*[F.lit(x) for x, _ in _TITLES]), (F.col("doc_id") % len(_TITLES) + 1).cast("int")), F.lit("@"), i)
    return load(spark, d, "documents").select("doc_id", C.localized_title(json, F.concat(F.lit("T"), i)).alias("title"))


@query(f"WITH {_GAMES} SELECT a.title, a.source_path, b.source_path AS other_path FROM games a JOIN games b ON a.title = b.title AND a.source_path <> b.source_path")
def competing_instances(spark: SparkSession, d: str) -> DataFrame:
    return C.competitors(_games(spark, d))


@query("""WITH a AS (SELECT c_custkey AS id, c_custkey % 2 AS kind, '/d/' || (c_custkey % 90) AS path, c_custkey % 50 AS title, c_custkey % 77 AS h FROM customer),
    b AS (SELECT s_suppkey AS id, s_suppkey % 2 AS kind, '/d/' || (s_suppkey % 90) AS path, s_suppkey % 50 AS title, s_suppkey % 77 AS h FROM supplier)
    SELECT a.id AS left_id, b.id AS right_id FROM a JOIN b ON (a.kind = b.kind AND a.path = b.path) OR (a.title = b.title AND a.h = b.h)""")
def mount_identity(spark: SparkSession, d: str) -> DataFrame:
    def side(t: DataFrame, key: str, end: str) -> DataFrame:
        k = F.col(key)
        return t.select(k.alias("id"), (k % 2).alias("kind"), F.concat(F.lit("/d/"), (k % 90).cast("string"), F.lit(end)).alias("path"), (k % 50).alias("title"), (k % 77).alias("path_hash"))

    return C.same_mount(side(load(spark, d, "customer"), "c_custkey", "/"), side(load(spark, d, "supplier"), "s_suppkey", ""))


@query("""WITH t AS (SELECT n_name AS title FROM nation), f AS (SELECT r_name || '/' || n_name AS path FROM region, nation WHERE (n_nationkey + r_regionkey) % 3 = 0),
    w AS (SELECT title, r_name || '/' || title AS path, r_regionkey AS pos FROM t, region)
    SELECT title, first(path ORDER BY pos) AS path FROM w WHERE path IN (SELECT path FROM f) GROUP BY title""")
def first_root(spark: SparkSession, d: str) -> DataFrame:
    nation, region = load(spark, d, "nation"), load(spark, d, "region")
    keys = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")), lambda r: (F.col("n_nationkey") + r) % 3 == 0)
    found = nation.select("n_name", F.explode(keys).alias("r_regionkey")).join(region, "r_regionkey").select(F.concat("r_name", F.lit("/"), "n_name").alias("path"))
    return C.first_existing(nation.select(F.col("n_name").alias("title")), region.select(F.col("r_name").alias("root"), F.col("r_regionkey").alias("pos")), found, F.col("title"))


@query("""WITH l AS (SELECT turn + conv_id * 100 AS pos, 'k' || (conv_id % 40) AS key, 'old' || conv_id AS line FROM conversations),
    n AS (SELECT 'k' || (n_nationkey * 3) AS key, 'new' || n_nationkey AS line FROM nation)
    SELECT pos, key, line FROM l WHERE key NOT IN (SELECT key FROM n)
    UNION ALL SELECT (SELECT min(pos) FROM l WHERE l.key = n.key), key, line FROM n WHERE key IN (SELECT key FROM l)
    UNION ALL SELECT (SELECT max(pos) FROM l) + row_number() OVER (ORDER BY key), key, line FROM n WHERE key NOT IN (SELECT key FROM l)""")
def config_upsert(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "conversations").select((F.col("turn") + F.col("conv_id") * 100).alias("pos"), F.concat(F.lit("k"), (F.col("conv_id") % 40).cast("string")).alias("key"), F.concat(F.lit("old"), F.col("conv_id").cast("string")).alias("line"))
    new = load(spark, d, "nation").select(F.concat(F.lit("k"), (F.col("n_nationkey") * 3).cast("string")).alias("key"), F.concat(F.lit("new"), F.col("n_nationkey").cast("string")).alias("line"))
    return C.upsert_lines(lines, new)


@query("""SELECT n_regionkey AS storage, first('/r' || (n_nationkey % 4) ORDER BY n_nationkey % 4, n_nationkey) AS root FROM nation GROUP BY n_regionkey""")
def target_root(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "nation").select(F.col("n_regionkey").alias("storage"), (F.col("n_nationkey") % 4).alias("score"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("/r"), (F.col("n_nationkey") % 4).cast("string")).alias("root"))
    return C.first_per_key(n, ["storage"], [F.col("score"), F.col("pos")], ["root"])


@query("""WITH l AS (SELECT turn + conv_id * 100 AS pos, 'k' || (conv_id % 40) AS key, 'old' || conv_id AS line FROM conversations), n AS (SELECT DISTINCT 'k' || (n_nationkey * 3) AS key FROM nation)
    SELECT pos, key, line FROM l WHERE key NOT IN (SELECT key FROM n)""")
def config_remove(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "conversations").select((F.col("turn") + F.col("conv_id") * 100).alias("pos"), F.concat(F.lit("k"), (F.col("conv_id") % 40).cast("string")).alias("key"), F.concat(F.lit("old"), F.col("conv_id").cast("string")).alias("line"))
    return C.without_lines(lines, load(spark, d, "nation").select(F.concat(F.lit("k"), (F.col("n_nationkey") * 3).cast("string")).alias("key")))


@query("""WITH l AS (SELECT turn + conv_id * 100 AS pos, CASE WHEN conv_id % 3 = 0 THEN 'scanpath' ELSE 'k' END AS key, 'old' AS line FROM conversations),
    v AS (SELECT '/d/' || (n_nationkey % 9) AS value, min(n_nationkey) AS n FROM nation GROUP BY 1)
    SELECT pos, key, line FROM l WHERE key <> 'scanpath' UNION ALL SELECT (SELECT max(pos) FROM l WHERE key <> 'scanpath') + row_number() OVER (ORDER BY n), 'scanpath', 'scanpath=' || value FROM v""")
def config_list(spark: SparkSession, d: str) -> DataFrame:
    lines = load(spark, d, "conversations").select((F.col("turn") + F.col("conv_id") * 100).alias("pos"), F.when(F.col("conv_id") % 3 == 0, "scanpath").otherwise("k").alias("key"), F.lit("old").alias("line"))
    values = load(spark, d, "nation").select(F.concat(F.lit("/d/"), (F.col("n_nationkey") % 9).cast("string")).alias("value"), F.col("n_nationkey").alias("n"))
    return C.with_listed(lines, "scanpath", values)


_SETTINGS = (("ScanPath", "/data/a/"), ("x", "1"), ("scanpath", "/data/.hid"), ("scanpath", "/system_ex/app/b"), ("scanpath", "/mnt/usb0"), ("scan_depth", "7"), ("scan_depth", "1"), ("recursive_scan", "yes"), ("scanpath", "/data/a"))


@query("""WITH base AS (SELECT * FROM (VALUES ('/data/a', 0), ('/mnt/usb0', 4)) t(root, pos)),
    kids AS (SELECT base.root || '/' || (nation.n_nationkey % 6) AS root, pos FROM nation JOIN base ON (n_nationkey % 2 = 0) = (base.root = '/data/a') WHERE n_nationkey % 6 <> 5),
    manual AS (SELECT '/m/' || (n_nationkey % 4) AS root, n_nationkey AS pos FROM nation WHERE n_nationkey % 5 <> 0),
    u AS (SELECT root, 0 AS list, pos FROM base UNION ALL SELECT root, 1, pos FROM kids UNION ALL SELECT root, 2, pos FROM manual)
    SELECT root, first(list ORDER BY list, pos) AS list, first(pos ORDER BY list, pos)::BIGINT AS pos FROM u GROUP BY root""")
def roots_resolved(spark: SparkSession, d: str) -> DataFrame:
    settings = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(_SETTINGS)], "n long, key string, value string")
    n = F.col("n_nationkey")
    nation = load(spark, d, "nation")
    name = F.when(n % 6 == 5, F.concat(F.lit("."), n.cast("string"))).otherwise((n % 6).cast("string"))
    folders = nation.select(F.concat(F.when(n % 2 == 0, "/data/a/").otherwise("/mnt/usb0/"), name).alias("path"))
    manual = nation.select(n.alias("n"), F.concat(F.lit("/m/"), (n % 4).cast("string"), F.lit("/t"), F.when(n % 5 == 0, ".img").otherwise(".FFPFSC")).alias("path"))
    return C.resolved_roots(settings, spark.createDataFrame([(0, "/data")], "n long, path string"), folders, manual)


@query("""WITH e AS (SELECT '/r/' || (c_custkey % 20) || '/' || CASE WHEN c_custkey % 13 = 0 THEN '.h' ELSE 't' END || c_custkey || ['.ffpfsc', '.exfat', '', '.txt', '/x.dat'][(c_custkey % 5 + 1)::INT] AS path, c_custkey % 5 = 2 AS is_dir, c_custkey FROM customer)
    SELECT '/r/' || (c_custkey % 20) AS root, path, ['compressed', 'image', 'folder'][(c_custkey % 5 + 1)::INT] AS kind FROM e
    WHERE c_custkey % 20 < 15 AND c_custkey % 13 <> 0 AND (c_custkey % 5 IN (0, 1) OR (c_custkey % 5 = 2 AND c_custkey % 3 = 0))""")
def artifact_scan(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    end = F.element_at(F.array(*[F.lit(x) for x in (".ffpfsc", ".exfat", "", ".txt", "/x.dat")]), (c % 5 + 1).cast("int"))
    rows = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("/r/"), (c % 20).cast("string"), F.when(c % 13 == 0, "/.h").otherwise("/t"), c.cast("string"), end).alias("path"), (c % 5 == 2).alias("is_dir"))
    roots = rows.select((c % 20).alias("k")).distinct().filter("k < 15").select(F.concat(F.lit("/r/"), F.col("k").cast("string")).alias("root"))
    return C.artifacts(roots, rows.select("path", "is_dir"), rows.filter("c_custkey % 3 = 0").select(F.col("path").alias("dir")))


@query("""SELECT 'TITLE' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS title, CASE WHEN c_custkey % 2 = 0 THEN '/src/' || c_custkey END AS source_path, CASE WHEN c_custkey % 3 = 0 THEN '/img/' || c_custkey END AS image_path
    FROM customer WHERE (c_custkey % 2 = 0 OR c_custkey % 3 = 0) AND c_custkey % 7 <> 0""")
def mounted_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles repeat every 10,000 customers, each customer's folder is one of its own: a folder has one link of each kind."""
    c = F.col("c_custkey")
    customer = load(spark, d, "customer")
    path = F.concat(F.lit("/user/"), c.cast("string"), F.lit("/app/"), F.when(c % 7 == 0, "bad").otherwise("TITLE"), F.lpad((c % 10_000).cast("string"), 4, "0"))
    one = customer.filter("c_custkey % 2 = 0").select(F.concat(path, F.lit("/mount.lnk")).alias("path"), F.concat(F.lit("/src/"), c.cast("string"), F.lit("\n")).alias("target"))
    two = customer.filter("c_custkey % 3 = 0").select(F.concat(path, F.lit("/mount_img.lnk")).alias("path"), F.concat(F.lit("/img/"), c.cast("string")).alias("target"))
    return C.mounted_titles(customer.select(path.alias("path")), one.unionByName(two))


@query("""WITH c AS (SELECT ['/mnt/ext0', '/mnt/ext1', '/mnt/usb0', '/mnt/usb7', '/mnt/usb9'][(n_nationkey + 1)::INT] AS root, (40 + n_nationkey * 20) * 1048576 AS total, (n_nationkey * 4) * 1048576 AS free FROM nation WHERE n_nationkey < 5)
    SELECT * FROM (VALUES ('usb7', 'USB 7', '/mnt/usb7', '/mnt/usb7/homebrew')) t(id, name, root, target_root) JOIN c USING (root)""")
def storage_targets(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey")
    root = F.element_at(F.array(*[F.lit(x) for x in ("/mnt/ext0", "/mnt/ext1", "/mnt/usb0", "/mnt/usb7", "/mnt/usb9")]), (n + 1).cast("int"))
    return C.storage_targets(load(spark, d, "nation").filter("n_nationkey < 5").select(root.alias("root"), ((n * 20 + 40) * (1 << 20)).alias("total"), (n * 4 * (1 << 20)).alias("free")))
