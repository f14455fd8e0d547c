"""Queries over the scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.plans.inputs import FILES_SQL, RATIO_SQL, files, load

QUERIES, ORACLE = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return add


_BYTES = "list_transform(string_split({0}, ''), lambda c: unicode(c))"


@query(f"""WITH {FILES_SQL} SELECT doc_id, list_reduce(list_prepend(2166136261::UBIGINT, list_transform({_BYTES.format('rel')}, lambda c: c::UBIGINT)),
    lambda h, b: (xor(h, b) * 16777619) % 4294967296)::BIGINT AS hash FROM files""")
def fnv32_path(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", S.fnv1a32(F.col("rel")).alias("hash"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, lpad(lower(to_hex(list_reduce(list_prepend(1469598103934665603::UHUGEINT, list_transform({_BYTES.format('lower(rel)')}, lambda c: c::UHUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::UBIGINT)), 16, '0') AS hash FROM files""")
def fnv64_path(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", S.fnv1a64_hex(S.ascii_lower(F.col("rel"))).alias("hash"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform({_BYTES.format('upper(rel)')}, lambda c: c::BIGINT)),
    lambda h, b: (h * 31 + b) % 4294967296)::BIGINT AS hash FROM files""")
def upper_path_hash(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", S.path_hash31(F.col("rel")).alias("hash"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, list_reduce(list_prepend(0::BIGINT, list_transform({_BYTES.format("upper(regexp_extract(rel, '[^/]*$'))")}, lambda c: c::BIGINT)),
    lambda h, b: (((h >> 1) + (h % 2) * 32768 + b) % 65536 >> 1) + (((h >> 1) + (h % 2) * 32768 + b) % 65536 % 2) * 32768)::BIGINT AS hash FROM files""")
def name_hash(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", S.name_hash16(S.base_name(F.col("rel"))).alias("hash"))


_TEXT_BYTES = "list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::{0})"


@query(f"""SELECT doc_id, list_reduce(list_prepend(0::BIGINT, {_TEXT_BYTES.format('BIGINT')}), lambda h, b: ((h >> 1) + (h % 2) * 2147483648 + b) % 4294967296)::BIGINT AS checksum
    FROM documents WHERE strlen(text) > 0""")
def rotate_checksum(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("octet_length(text) > 0").select("doc_id", S.checksum32(F.col("text")).alias("checksum"))


@query(f"""SELECT doc_id, lpad(lower(to_hex(list_reduce(list_prepend(1469598103934665603::UHUGEINT, {_TEXT_BYTES.format('UHUGEINT')}),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616)::UBIGINT)), 16, '0') AS hash FROM documents WHERE strlen(text) > 0""")
def fnv64_data(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").filter("octet_length(text) > 0").select("doc_id", S.fnv1a64_bytes_hex(F.col("text")).alias("hash"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, regexp_extract(rel, '[^/]*$') AS name, regexp_replace(rel, '/[^/]*$', '') AS dir,
    regexp_replace(regexp_extract(rel, '[^/]*$'), '\\.[^.]*$', '') AS stem, lower(regexp_extract(rel, '(\\.[^./]+)$', 1)) AS ext FROM files""")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    rel = F.col("rel")
    return files(spark, d).select("doc_id", S.base_name(rel).alias("name"), S.parent(rel).alias("dir"), S.stem(rel).alias("stem"), S.extension(rel).alias("ext"))


_ROOTS = ("/data", "/database", "/mnt/ext0", "/mnt/ext1/x", "/mnt/usb3", "/mnt/usb9", "/mnt/ext10", "/data/.Trash", "/data/RECYCLER", "/system_ex/app", "/system_ex/apps", "/data/" + "n" * 255, "/data/" + "n" * 256)
_PATH_SQL = f"{list(_ROOTS)}[(page_id % {len(_ROOTS)} + 1)::INT] || CASE WHEN page_id % 5 = 0 THEN '' ELSE '/t' || page_id END"


def _paths(spark: SparkSession, d: str) -> DataFrame:
    root = F.element_at(F.array(*[F.lit(x) for x in _ROOTS]), (F.col("page_id") % len(_ROOTS) + 1).cast("int"))
    return load(spark, d, "pages").select("page_id", "url", F.concat(root, F.when(F.col("page_id") % 5 == 0, "").otherwise(F.concat(F.lit("/t"), F.col("page_id").cast("string")))).alias("path"))


@query(f"""WITH p AS (SELECT page_id, {_PATH_SQL} AS path FROM pages)
    SELECT page_id, path, CASE WHEN path = '/data' OR path LIKE '/data/%' THEN 'internal' WHEN path = '/mnt/ext0' OR path LIKE '/mnt/ext0/%' THEN 'external'
        WHEN path LIKE '/mnt/ext1/%' THEN 'm2' WHEN regexp_matches(path, '^/mnt/usb[0-7](/|$)') THEN 'usb' ELSE 'other' END AS storage FROM p""")
def storage_class(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).select("page_id", "path", S.storage_class(F.col("path")).alias("storage"))


@query(f"""WITH p AS (SELECT page_id, {_PATH_SQL} AS path FROM pages)
    SELECT page_id, path FROM p WHERE len(list_filter(string_split(path, '/'), lambda x: x LIKE '.%' OR strlen(x) > 255
        OR lower(x) IN ('$recycle.bin', 'system volume information', 'recycler', 'recycled', 'found.000', 'lost+found'))) = 0""")
def mountable_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).filter(~S.has_system_folder(F.col("path"))).select("page_id", "path")


@query(f"""WITH p AS (SELECT page_id, {_PATH_SQL} AS path FROM pages) SELECT page_id, path FROM p WHERE path <> '/system_ex/app' AND path NOT LIKE '/system\\_ex/app/%' ESCAPE '\\'""")
def system_paths(spark: SparkSession, d: str) -> DataFrame:
    return _paths(spark, d).filter(~S.is_system_path(F.col("path"))).select("page_id", "path")


_TAILS = ("", "/.", "/..", "/./x", "/../x", "/.x", "/x.", "/x//y", "/é", "/x\\y", "/x\n", "\n", "/x\x7f", "/", "/" + "n" * 1024)
_TAILS_SQL = "[" + ", ".join("'" + t.replace("\n", "' || chr(10) || '").replace("\x7f", "' || chr(127) || '") + "'" for t in _TAILS) + "]"


@query(f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '/a' ELSE url END || {_TAILS_SQL}[(page_id // 2 % {len(_TAILS)} + 1)::INT] AS p FROM pages)
    SELECT page_id, p, starts_with(p, '/') AND strlen(p) < 1024 AND regexp_full_match(p, '[\\x20-\\x7E]*') AND strpos(p, chr(92)) = 0 AND strpos(p, '//') = 0 AND strpos(p, '/./') = 0
        AND strpos(p, '/../') = 0 AND NOT (strlen(p) >= 3 AND (ends_with(p, '/.') OR ends_with(p, '/..'))) AS safe FROM p""")
def path_safety(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(*[F.lit(x) for x in _TAILS]), F.expr(f"cast(page_id div 2 % {len(_TAILS)} + 1 as int)"))
    path = F.concat(F.when(F.col("page_id") % 2 == 0, "/a").otherwise(F.col("url")), tail)
    return load(spark, d, "pages").select("page_id", path.alias("p"), S.path_safe(path).alias("safe"))


@query(f"WITH {FILES_SQL} SELECT doc_id, rel, {RATIO_SQL} AS ratio FROM files")
def ext_ratio(spark: SparkSession, d: str) -> DataFrame:
    return files(spark, d).select("doc_id", "rel", S.stored_ratio(F.col("rel")).alias("ratio"))


@query(f"""WITH {FILES_SQL}, f AS (SELECT doc_id, rel, size * [1, 1000, 1000000000, 20000000000000][(doc_id % 4 + 1)::INT] AS size FROM files)
    SELECT doc_id, size, (CASE WHEN size = 0 THEN 0 WHEN size::HUGEINT * ({RATIO_SQL}) > 18446744073709551615 THEN size
        ELSE greatest(1, least(size, (size::HUGEINT * ({RATIO_SQL}) + 999) // 1000)) END)::BIGINT AS predicted FROM f""")
def predicted_stored(spark: SparkSession, d: str) -> DataFrame:
    wide = F.element_at(F.array(*[F.lit(x).cast("long") for x in (1, 1000, 10**9, 2 * 10**13)]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = files(spark, d).withColumn("size", F.col("size") * wide)
    return rows.select("doc_id", "size", S.predicted_stored(F.col("size"), S.stored_ratio(F.col("rel"))).alias("predicted"))


@query("""WITH n AS (SELECT o_orderkey, (36028797018963968 + o_orderkey * 7919) AS a, o_orderkey % 5 * (1 + o_custkey) AS b FROM orders)
    SELECT o_orderkey, (CASE WHEN b = 0 THEN 0 ELSE (a::HUGEINT + b - 1) // b END)::BIGINT AS pieces, least(a::HUGEINT * b, 9223372036854775807)::BIGINT AS product FROM n""")
def wide_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.lit(1 << 55) + F.col("o_orderkey") * 7919, F.col("o_orderkey") % 5 * (F.col("o_custkey") + 1)
    return load(spark, d, "orders").select("o_orderkey", S.ceil_div(a, b).alias("pieces"), S.saturating_product(a, b).alias("product"))


@query("""WITH t AS (SELECT c_custkey, substr(replace(c_name, '#', ''), 1, 5 + (c_custkey % 8)::INT) || CASE WHEN c_custkey % 3 = 0 THEN chr(10) ELSE '' END AS title FROM customer)
    SELECT c_custkey, title, strlen(title) = 9 AND regexp_full_match(title, '[A-Za-z0-9]*') AS valid FROM t""")
def title_valid(spark: SparkSession, d: str) -> DataFrame:
    title = F.substring(F.replace("c_name", F.lit("#"), F.lit("")), F.lit(1), (F.lit(5) + F.col("c_custkey") % 8).cast("int"))
    title = F.concat(title, F.when(F.col("c_custkey") % 3 == 0, "\n").otherwise(""))
    return load(spark, d, "customer").select("c_custkey", title.alias("title"), S.title_id_valid(title).alias("valid"))


_VERSIONS = ("1.2", "a_b-C.9", "", "x" * 63, "x" * 64, "1/2", "1.2\n", "é")


@query(f"""WITH v AS (SELECT c_custkey, {list(_VERSIONS[:6])!r}[(c_custkey % 8 + 1)::INT] AS v6, c_custkey % 8 AS k, ['latest', 'manual', 'custom', 'Latest', ''][(c_custkey % 5 + 1)::INT] AS intent FROM customer),
    w AS (SELECT c_custkey, intent, CASE k WHEN 6 THEN '1.2' || chr(10) WHEN 7 THEN 'é' ELSE v6 END AS v FROM v)
    SELECT c_custkey, strlen(v) BETWEEN 1 AND 63 AND regexp_full_match(v, '[A-Za-z0-9._-]*') AS version_ok, intent IN ('latest', 'manual', 'custom') AS intent_ok FROM w""")
def version_rules(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (F.col("c_custkey") % len(xs) + 1).cast("int"))
    return load(spark, d, "customer").select("c_custkey", S.version_safe(pick(_VERSIONS)).alias("version_ok"), S.intent_valid(pick(("latest", "manual", "custom", "Latest", ""))).alias("intent_ok"))


@query("""WITH n AS (SELECT doc_id, ['.DS_Store', '._x', '__MACOSX', 'x.txt', '.hidden', '_ok.bin'][(doc_id % 6 + 1)::INT] AS name FROM documents)
    SELECT doc_id, name FROM n WHERE NOT (name IN ('.DS_Store', '__MACOSX') OR name LIKE '.\\_%' ESCAPE '\\')""")
def hygiene_filter(spark: SparkSession, d: str) -> DataFrame:
    name = F.element_at(F.array(*[F.lit(x) for x in (".DS_Store", "._x", "__MACOSX", "x.txt", ".hidden", "_ok.bin")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", name.alias("name")).filter(~S.is_junk(F.col("name")))


@query("""SELECT o_orderkey, (65536 + (greatest(0, 8 * (o_orderkey * 37 + 1) - 64512) + 65535) // 65536 * 65536)::BIGINT AS span FROM orders""")
def header_span(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", S.header_span(F.col("o_orderkey") * 37).alias("span"))


@query("""SELECT o_orderkey, ((65536 - (o_orderkey * 131) % 65536) * 100 >= 65536 * 5) AS kept FROM orders""")
def gain_filter(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", S.gain_reached((F.col("o_orderkey") * 131) % 65536).alias("kept"))


_NAMES = ("Ampr_emu.index", "ampr_emu.index.tmp", "EBOOT.BIN", "eboot.bin\n", "x/eboot1.bin", "a.prx", "lib/a.sprx", "FakeLib/a", "sce_module/b", "data/x.so", "data/ampr_emu.index", "iboot.bin", "a.prx\n", "sce_modules/c")
_NAMES_SQL = "[" + ", ".join("'" + n.replace("\n", "' || chr(10) || '") + "'" for n in _NAMES) + "]"


@query(f"""WITH n AS (SELECT doc_id, {_NAMES_SQL}[(doc_id % {len(_NAMES)} + 1)::INT] AS rel FROM documents), l AS (SELECT doc_id, rel, lower(rel) AS r, lower(list_last(string_split(rel, '/'))) AS b FROM n)
    SELECT doc_id, rel, (starts_with(b, 'eboot') OR starts_with(b, 'iboot')) AND ends_with(b, '.bin') OR len(list_filter(['.prx', '.sprx', '.self', '.elf', '.dll', '.so'], lambda x: ends_with(b, x))) > 0 AS executable,
        starts_with(r, 'fakelib/') OR starts_with(r, 'sce_module/') OR (strpos(r, '/') = 0 AND (r IN ('ampr_emu.index', 'eboot.bin', 'iboot.bin') OR ends_with(r, '.prx') OR ends_with(r, '.sprx'))) AS tail,
        r IN ('ampr_emu.index', 'ampr_emu.index.tmp') AS own_index FROM l""")
def payload_rules(spark: SparkSession, d: str) -> DataFrame:
    rel = F.element_at(F.array(*[F.lit(x) for x in _NAMES]), (F.col("doc_id") % len(_NAMES) + 1).cast("int"))
    return load(spark, d, "documents").select("doc_id", rel.alias("rel"), S.is_executable(rel).alias("executable"), S.goes_to_tail(rel).alias("tail"), S.is_root_index(rel).alias("own_index"))


@query(f"""WITH {FILES_SQL} SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'UNKNOWN' ELSE 'T' || doc_id END || ':image:' ||
    lpad(lower(to_hex(list_reduce(list_prepend(2166136261::UBIGINT, list_transform({_BYTES.format('rel')}, lambda c: c::UBIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296))), 8, '0') AS instance FROM files""")
def instance_ids(spark: SparkSession, d: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 11 == 0, "").otherwise(F.concat(F.lit("T"), F.col("doc_id").cast("string")))
    return files(spark, d).select("doc_id", S.instance_id(title, F.lit("image"), F.col("rel")).alias("instance"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'recovery' ELSE 'op-' || conv_id END || CASE WHEN conv_id % 2 = 0 THEN '' ELSE ':' || conv_id END AS key FROM conversations""")
def history_keys(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("turn") % 3 == 0, ":x").otherwise(F.concat(F.lit("op-"), F.col("conv_id").cast("string"), F.lit(":phase")))
    return load(spark, d, "conversations").select("conv_id", "turn", S.history_key(op, F.when(F.col("conv_id") % 2 == 0, F.lit(0)).otherwise(F.col("conv_id"))).alias("key"))


@query("""SELECT o_orderkey, CASE WHEN size > 0 AND size < 5000000 THEN size ELSE 5000000 END AS min_free, greatest(0, size - 1000000)::BIGINT AS short,
    CASE WHEN 12000000 >= (size * 6 + 4) // 5 THEN 'copy-replace' ELSE 'in-place' END AS strategy
    FROM (SELECT o_orderkey, round(o_totalprice * 100)::BIGINT AS size FROM orders)""")
def space_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "orders").select("o_orderkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("size"))
    return rows.select("o_orderkey", S.minimum_free(F.col("size"), F.lit(5_000_000).cast("long")).alias("min_free"), S.shortfall(F.col("size"), F.lit(1_000_000).cast("long")).alias("short"), S.repair_strategy(F.col("size"), F.lit(12_000_000).cast("long")).alias("strategy"))


@query("""WITH e AS (SELECT event_id, ['compress', 'validate-repair', 'uncompress', 'move-to-usb', 'other'][(event_id % 5 + 1)::INT] AS verb, ['repairing', 'scan'][(event_id // 5 % 2 + 1)::INT] AS phase,
        (event_id % 3) * 100 AS copied, (event_id % 4) * 10 AS output, (event_id % 7) * 5 AS read, (event_id % 2) * 9 AS written, (event_id % 6) * 3 AS copy FROM events),
    m AS (SELECT *, CASE WHEN verb = 'compress' THEN CASE WHEN copied > 0 OR output = 0 THEN copied ELSE output END
        WHEN verb = 'validate-repair' AND phase = 'repairing' THEN CASE WHEN greatest(copy, written) > 0 THEN greatest(copy, written) ELSE copied END
        WHEN verb = 'validate-repair' THEN CASE WHEN copied > 0 THEN copied ELSE read END ELSE copied END AS b,
        CASE WHEN verb = 'compress' THEN CASE WHEN copied > 0 OR output = 0 THEN 'compressed-input' ELSE 'compressed-output' END
        WHEN verb = 'validate-repair' AND phase = 'repairing' THEN CASE WHEN greatest(copy, written) > 0 THEN CASE WHEN copy > 0 THEN 'repair-copy' ELSE 'repair-write' END ELSE 'repair-progress' END
        WHEN verb = 'validate-repair' THEN 'validated' WHEN verb = 'uncompress' THEN 'unpacked-output' WHEN verb = 'move-to-usb' THEN 'transferred' ELSE 'copied' END AS s FROM e)
    SELECT event_id, CASE WHEN b <= 0 THEN greatest(copy, written, read) ELSE b END::BIGINT AS bytes,
        CASE WHEN b <= 0 AND greatest(copy, written, read) > 0 THEN 'repair-io' ELSE s END AS source FROM m""")
def job_speed(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i + 1).cast("int"))
    m = S.speed_metric(pick(("compress", "validate-repair", "uncompress", "move-to-usb", "other"), e % 5), pick(("repairing", "scan"), F.floor(e / 5) % 2), e % 3 * 100, e % 4 * 10, e % 7 * 5, e % 2 * 9, e % 6 * 3)
    return load(spark, d, "events").select("event_id", m.alias("m")).select("event_id", "m.bytes", "m.source")


@query("""SELECT e.event_id, CASE WHEN k1 IS NOT NULL AND k2 IS NOT NULL THEN CASE WHEN k1 = k2 THEN 'serial' ELSE 'pipelined' END
    WHEN d1 = d2 THEN 'serial' ELSE 'pipelined' END AS policy,
    CASE WHEN k1 IS NOT NULL AND k2 IS NOT NULL THEN CASE WHEN k1 = k2 THEN 'same-physical-root' ELSE 'different-physical-root' END
    WHEN d1 = d2 THEN 'same-st-dev' ELSE 'different-st-dev' END AS reason
    FROM (SELECT event_id, CASE WHEN event_id % 3 > 0 THEN event_id % 4 END AS k1, CASE WHEN event_id % 5 > 0 THEN event_id % 2 END AS k2, event_id % 7 AS d1, event_id % 6 AS d2 FROM events) e""")
def overlap_policy(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    p = S.overlap_policy([("physical-root", F.when(e % 3 > 0, e % 4), F.when(e % 5 > 0, e % 2)), ("st-dev", e % 7, e % 6)])
    return load(spark, d, "events").select("event_id", p.alias("p")).select("event_id", "p.policy", "p.reason")


@query("""SELECT doc_id, (doc_id % 5 > 0) AND (doc_id % 3 <> 0) AND CASE WHEN doc_id % 2 = 0 THEN doc_id % 4 = 0 ELSE doc_id % 7 <> 0 END AS needed FROM documents""")
def update_needed(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    cur, new = F.sha2(F.lit("a"), 256), F.sha2(F.lit("b"), 256)
    needed = S.update_needed(i % 5 > 0, F.when(i % 3 == 0, F.upper(new)).otherwise(cur), new, F.when(i % 2 == 0, F.when(i % 4 == 0, "latest").otherwise("pinned")), F.upper(cur), i % 7 == 0)
    return load(spark, d, "documents").select("doc_id", needed.alias("needed"))


@query("""WITH t AS (SELECT conv_id, turn, chr(11) || ' ' || substr(text, 1, 9 + turn) || chr(12) || chr(127) || chr(9) || chr(10) || text AS text FROM conversations),
    c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]', '', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS s FROM t)
    SELECT conv_id, turn, CASE WHEN length(s) > 40 THEN rtrim(substr(s, 1, 40)) || '...' ELSE s END AS short FROM c""")
def text_compaction(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("\x0b "), F.substring(F.col("text"), F.lit(1), F.lit(9) + F.col("turn").cast("int")), F.lit("\x0c\x7f\t\n"), F.col("text"))
    return load(spark, d, "conversations").select("conv_id", "turn", S.compact_text(text, 40).alias("short"))


@query("""SELECT event_id, (event_id % 300 * 256 + event_id % 256)::BIGINT AS value, (18446744073709551615 - event_id)::DECIMAL(20, 0) AS wide,
    lower(printf('%02x', event_id % 128)) || '0700' AS written FROM events""")
def little_endian(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    raw = S.to_little_endian(e % 300 * 256 + e % 256, 4)
    return load(spark, d, "events").select("event_id", S.little_endian(raw, 0, 4).alias("value"), S.little_endian(F.concat(raw, S.to_little_endian(-1 - e, 8)), 4, 8).alias("wide"), F.lower(F.hex(S.to_little_endian(e % 128 + 7 * 256, 3))).alias("written"))


_JSON_SQL = """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"x":{"name" : "in' || doc_id || '"},"name":"out"}' WHEN 1 THEN '{"name":"","size": ' || doc_id || '}' WHEN 2 THEN '{"name":7,"more":{"name":"late"},"on":true}'
    WHEN 3 THEN '{"name":"a\\"b' || doc_id || '","on": false,"size":"x"}' ELSE '{}' END AS json FROM documents"""


@query(f"""WITH j AS ({_JSON_SQL}) SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'in' || doc_id WHEN 3 THEN 'a"b' || doc_id END AS name,
    (CASE doc_id % 5 WHEN 1 THEN doc_id WHEN 3 THEN 0 ELSE 5 END)::BIGINT AS size, doc_id % 5 = 2 AS on_ FROM j""")
def json_lookups(spark: SparkSession, d: str) -> DataFrame:
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 5
    json = (
        F.when(k == 0, F.concat(F.lit('{"x":{"name" : "in'), i, F.lit('"},"name":"out"}'))).when(k == 1, F.concat(F.lit('{"name":"","size": '), i, F.lit("}"))).when(k == 2, F.lit('{"name":7,"more":{"name":"late"},"on":true}'))
        .when(k == 3, F.concat(F.lit('{"name":"a\\"b'), i, F.lit('","on": false,"size":"x"}'))).otherwise("{}")
    )
    return load(spark, d, "documents").select("doc_id", S.json_string(json, "name").alias("name"), S.json_number(json, "size", 5).alias("size"), S.json_bool(json, "on").alias("on_"))


_STATE = "(event_id % 11 > 0) AS used, event_id % 2 = 0 AS scanning, event_id % 3 = 0 AS queued, event_id % 5 = 0 AS failed, event_id % 7 = 0 AS done, event_id % 4 AS size, event_id % 9 AS measured_at"


@query(f"""SELECT event_id, CASE WHEN NOT used THEN 'unknown' WHEN (scanning OR queued) AND size > 0 THEN 'refreshing' WHEN scanning THEN 'scanning' WHEN queued THEN 'queued'
    WHEN failed THEN 'failed' WHEN done THEN 'done' WHEN size > 0 AND measured_at > 0 THEN 'cached' ELSE 'unknown' END AS state FROM (SELECT event_id, {_STATE} FROM events)""")
def size_states(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return load(spark, d, "events").select("event_id", S.size_state(e % 11 > 0, e % 2 == 0, e % 3 == 0, e % 5 == 0, e % 7 == 0, e % 4, e % 9).alias("state"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'exfat' WHEN 1 THEN 'inodes' ELSE 'unknown' END AS by_bytes, CASE doc_id % 4 WHEN 0 THEN 'exfat' WHEN 1 THEN 'inodes' WHEN 2 THEN 'inodes' ELSE 'unknown' END AS by_name FROM documents""")
def nested_types(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 4
    inodes = F.concat(S.to_little_endian(F.lit(2), 8), S.to_little_endian(F.lit(20130315), 8))
    header = F.when(k == 0, F.concat(F.lit("xyz"), F.lit(S.EXFAT_NAME), F.col("doc_id").cast("string")).cast("binary")).when(k == 1, inodes).when(k == 2, F.substring(inodes, 1, 15)).otherwise(F.lit("").cast("binary"))
    name = F.when(k == 0, "/a/X.EXFAT").when(k == 1, "/a/x.ffpfs").when(k == 2, "pfs_image.dat").otherwise("x.bin")
    return load(spark, d, "documents").select("doc_id", S.nested_type(header).alias("by_bytes"), S.nested_type_of_name(name).alias("by_name"))


@query("""WITH g AS (SELECT c_custkey, 'T' || c_custkey AS title, ['folder', 'image', 'compressed', 'image'][(c_custkey % 4 + 1)::INT] AS kind, '/x/' || c_custkey || CASE WHEN c_custkey % 4 = 1 THEN '.FFPFSC' ELSE '.dat' END AS output FROM customer)
    SELECT c_custkey, CASE kind WHEN 'folder' THEN '/data/homebrew/' || title || '.ffpfsc' WHEN 'image' THEN CASE WHEN output LIKE '%.FFPFSC' THEN '/data/homebrew/' || c_custkey || '.FFPFSC' END END AS path FROM g""")
def target_paths(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("folder", "image", "compressed", "image")]), (c % 4 + 1).cast("int"))
    output = F.concat(F.lit("/x/"), c.cast("string"), F.when(c % 4 == 1, ".FFPFSC").otherwise(".dat"))
    return load(spark, d, "customer").select("c_custkey", S.target_path(F.lit("/data/homebrew"), F.concat(F.lit("T"), c.cast("string")), kind, output).alias("path"))
