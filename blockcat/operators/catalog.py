"""File and title catalogue: classification, unions with preference, and the joins of titles with what is known of them.

Every join of the catalogue is an equi-join (disjunctions become unions of two), so nothing plans as a nested loop.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.operators.shared import Stored, partitions, running_totals, small, stored

# Ends of names that tell what a source is.
COMPRESSED_ENDS, IMAGE_ENDS = (".ffpfsc",), (".exfat", ".ffpfs", ".pfs", ".dat")


def disk_usage(files: DataFrame, by: str, allocated: bool = False) -> DataFrame:
    """Entries, files, folders and bytes per root; allocated bytes where blocks of 512 are known."""
    size = F.when(F.col("blocks") > 0, F.col("blocks") * 512).otherwise(F.col("size")) if allocated else F.col("size")
    return files.groupBy(by).agg(F.count("*").alias("entries"), F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("dirs"), F.coalesce(F.sum(F.when(~F.col("is_dir"), size)), F.lit(0)).alias("bytes"))


def classify(path: Column, is_dir: Column, has_app: Column) -> Column:
    """compressed, image, folder or unknown; the first rule that holds."""
    low = S.ascii_lower(path)
    ends = lambda xs: low.rlike("(" + "|".join(x.replace(".", r"\.") for x in xs) + r")\z")
    return F.when(~is_dir & ends(COMPRESSED_ENDS), "compressed").when(~is_dir & ends(IMAGE_ENDS), "image").when(is_dir & has_app, "folder").otherwise("unknown")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rest: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``: an aggregation, so it combines before the shuffle and no key needs a sort."""
    least = F.min(F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c) for c in rest]))
    return df.groupBy(*keys).agg(least.alias("_first")).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in rest])


def union_by_instance(mounted: DataFrame, artifacts: DataFrame, key: str = "instance") -> DataFrame:
    """Mounted and found rows, one per instance: a compressed row wins, else the mounted one; mount fields are merged in."""
    rows = mounted.withColumn("_side", F.lit(0)).unionByName(artifacts.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in rows.columns if c not in (key, "is_mounted", "mount_path", "_side")]
    best = F.min(F.struct((F.col("kind") != "compressed").cast("int").alias("_a"), F.col("_side"), *[F.col(c) for c in rest]))
    out = rows.groupBy(key).agg(best.alias("_b"), F.bool_or("is_mounted").alias("is_mounted"), F.min(F.when(F.col("is_mounted"), F.col("mount_path"))).alias("mount_path"))
    return out.select(key, *[F.col(f"_b.{c}").alias(c) for c in rest], "is_mounted", "mount_path")


def with_operations(games: DataFrame, operations: DataFrame) -> DataFrame:
    """Each title with its running or queued operation: same title, and the same path or none."""
    ops = operations.select(F.col("title").alias("_t"), "path", "op_id", "status", "seq")
    by_path = games.join(ops.filter("path <> ''"), (F.col("title") == F.col("_t")) & (F.col("source_path") == F.col("path")))
    by_title = games.join(ops.filter("path = ''"), F.col("title") == F.col("_t"))
    found = by_path.unionByName(by_title).groupBy("title", "source_path").agg(F.min(F.struct("seq", "op_id", "status")).alias("_o"))
    found = found.select(F.col("title").alias("_gt"), F.col("source_path").alias("_gp"), F.col("_o.op_id").alias("op_id"), F.col("_o.status").alias("op_status"))
    return games.join(found, (F.col("title") == F.col("_gt")) & (F.col("source_path") == F.col("_gp")), "left").drop("_gt", "_gp")


def operations_without_title(games: DataFrame, operations: DataFrame) -> DataFrame:
    """Operations that no title row stands for, one per title and path, the latest."""
    alone = operations.join(games.select("title").distinct(), "title", "left_anti")
    return alone.groupBy("title", "path").agg(F.max(F.struct("seq", "op_id", "status")).alias("_o")).select("title", "path", F.col("_o.op_id").alias("op_id"), F.col("_o.status").alias("status"))


def same_mount(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left_id, right_id): same kind and path (trailing slash or not), or same title and path hash: two equi-joins."""
    a = left.select(F.col("id").alias("left_id"), "kind", S.without_trailing_slash(F.col("path")).alias("p"), "title", "path_hash")
    b = right.select(F.col("id").alias("right_id"), F.col("kind").alias("k2"), S.without_trailing_slash(F.col("path")).alias("p2"), F.col("title").alias("t2"), F.col("path_hash").alias("h2"))
    one = a.join(b, (F.col("kind") == F.col("k2")) & (F.col("p") == F.col("p2")))
    two = a.join(b, (F.col("title") == F.col("t2")) & (F.col("path_hash") == F.col("h2")))
    return one.select("left_id", "right_id").unionByName(two.select("left_id", "right_id")).distinct()


def first_existing(titles: DataFrame, roots: DataFrame, files: DataFrame, name: Column) -> DataFrame:
    """(title, path): the file called ``name`` (made from the title) right below the first root (root, pos) that has it.

    Asked from the files' side: a file's folder is joined with the roots and its name with the titles', so no title meets
    every root, and a title's first hit is an aggregation.
    """
    have = files.select("path").distinct().select("path", S.parent(F.col("path")).alias("_dir"), S.base_name(F.col("path")).alias("_name"))
    under = have.join(small(roots.groupBy(F.col("root").alias("_dir")).agg(F.min("pos").alias("_pos"))), "_dir")
    wanted = titles.select("title", name.alias("_name")).distinct()
    return under.join(wanted, "_name").groupBy("title").agg(F.min_by("path", F.struct("_pos", "path")).alias("path"))


def parent_dirs(files: DataFrame, path: str = "rel") -> DataFrame:
    """Every folder that some file lies in, once."""
    parts = F.split(F.col(path), "/")
    ups = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    return files.select(F.explode(ups).alias("dir")).filter("dir <> ''").distinct()


def localized_title(parameters: Column, title: Column) -> Column:
    """Name of a title from its JSON: of ``localizedParameters`` the entry of the default language, en-US, en-GB, any that
    begins with en-, any; titleName before name in each; else the first titleName, the first name, the title id."""
    parsed = F.from_json(parameters, "struct<localizedParameters:map<string,string>>")["localizedParameters"]
    name = lambda x: F.coalesce(F.nullif(F.get_json_object(x, "$.titleName"), F.lit("")), F.nullif(F.get_json_object(x, "$.name"), F.lit("")))
    entries = F.filter(F.map_entries(parsed), lambda e: F.startswith(F.ltrim(e["value"]), F.lit("{")))
    named = F.filter(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), name(e["value"]).alias("n"))), lambda e: e["n"].isNotNull())
    pick = lambda rule: F.try_element_at(F.filter(named, rule), F.lit(1))["n"]
    own = F.nullif(parsed["defaultLanguage"], F.lit(""))
    order = (lambda e: e["k"] == own, lambda e: e["k"] == "en-US", lambda e: e["k"] == "en-GB", lambda e: S.ascii_lower(e["k"]).startswith("en-"), lambda e: F.lit(True))
    return F.coalesce(*[pick(rule) for rule in order], S.json_string(parameters, "titleName"), S.json_string(parameters, "name"), title)


def version_of_hash(games: DataFrame, versions: DataFrame) -> DataFrame:
    """Titles with the greatest version whose hash is theirs, whatever the case of the digits."""
    known = versions.groupBy(S.ascii_lower(F.col("sha256")).alias("_sha")).agg(F.max("version").alias("version"))
    return games.join(known, S.ascii_lower(F.col("sha256")) == F.col("_sha"), "left").drop("_sha")


#: Instances of one title that one task compares with as many others.
PAIR_BLOCK = 1024


def competitors(games: DataFrame, block: int = PAIR_BLOCK) -> DataFrame:
    """(title, source_path, other_path): instances of one title from different sources.

    There are as many rows as pairs, so a title is no single task's: its instances are dealt by path into blocks of about ``block``,
    and each pair of blocks is a key of the join. Tables are dealt out even where they are small enough to be broadcast.
    """
    spark = games.sparkSession
    rows = games.select("title", "source_path")
    n_blocks = rows.groupBy(F.col("title").alias("_g")).agg(F.ceil(F.count("*") / block).alias("_k"))
    dealt = stored(rows.join(small(n_blocks), F.col("title") == F.col("_g")).withColumn("_own", F.pmod(F.xxhash64("source_path"), F.col("_k"))).select("title", "source_path", "_own", "_k"), "instances")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1))
    keys = ["title", "_a", "_b"]
    a = dealt.select("title", "source_path", F.col("_own").alias("_a"), every.alias("_b")).repartition(partitions(spark), *keys)
    b = dealt.select("title", F.col("source_path").alias("other_path"), every.alias("_a"), F.col("_own").alias("_b")).repartition(partitions(spark), *keys)
    met = a.hint("merge").join(b, keys)
    return met.filter(F.col("source_path") != F.col("other_path")).select("title", "source_path", "other_path")


def upsert_lines(lines: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """A config file (pos, key, line) with new lines (key, line): the first match is replaced, later ones go, the rest is appended
    in order of the keys."""
    first = lines.groupBy(key).agg(F.min("pos").alias("_first"))
    kept = lines.join(new.select(key), key, "left_anti").select("pos", key, "line")
    placed = new.join(first, key, "left")
    replaced = placed.filter("_first is not null").select(F.col("_first").cast("long").alias("pos"), key, "line")
    last = lines.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
    added = running_totals(placed.filter("_first is null").select(key, "line"), [key, "line"], label="appended")
    return kept.unionByName(replaced).unionByName(added.select((F.col("before") + last + 1).cast("long").alias("pos"), key, "line"))


def without_lines(lines: DataFrame, keys: DataFrame, key: str = "key") -> DataFrame:
    """A config file without the lines of some keys."""
    return lines.join(keys.select(key), key, "left_anti")


def with_listed(lines: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """A config file in which a key that may stand several times has exactly these values (value, n), at the end and in order."""
    kept = lines.filter(F.col("key") != key)
    last = kept.agg(F.coalesce(F.max("pos"), F.lit(-1))).first()[0]
    listed = running_totals(values.groupBy("value").agg(F.min("n").alias("n")), ["n", "value"], label="listed")
    return kept.select("pos", "key", "line").unionByName(listed.select((F.col("before") + last + 1).cast("long").alias("pos"), F.lit(key).alias("key"), F.concat(F.lit(key + "="), F.col("value")).alias("line")))


def usable_root(root: Column) -> Column:
    """Whether a scan may start there: a safe path, not of the system, without hidden or system folders."""
    return S.path_safe(root) & ~S.is_system_path(root) & ~S.has_system_folder(root)


def resolved_roots(settings: DataFrame, defaults: DataFrame, folders: DataFrame, manual: DataFrame) -> DataFrame:
    """(root, list, pos): where titles are looked for. ``settings`` has (n, key, value); ``defaults`` and ``manual`` (n, path).

    Paths set as scanpath, or the defaults if no usable one is set; with scan_depth 2 or recursive_scan also the folders
    right below those (``folders`` has path); then the folders of files listed by hand. The first place of a root counts.
    """
    low = S.ascii_lower(F.col("key"))
    own = settings.filter(low == "scanpath").select(S.without_trailing_slash(F.col("value")).alias("root"), F.col("n").alias("pos")).filter(usable_root(F.col("root")))
    depth = F.when((low == "scan_depth") & F.col("value").isin("1", "2"), F.col("value").cast("int")).when((low == "recursive_scan") & S.ini_bool(F.col("value")), F.lit(2))
    facts = settings.agg(F.max_by(depth, F.when(depth.isNotNull(), F.col("n"))).alias("d")).first()  # one row
    base = own if own.limit(1).count() else defaults.select(S.without_trailing_slash(F.col("path")).alias("root"), F.col("n").alias("pos")).filter(usable_root(F.col("root")))
    lists = [base]
    if (facts.d or 1) > 1:
        below = folders.select(F.col("path").alias("root"), S.parent(F.col("path")).alias("_up")).join(base.select(F.col("root").alias("_up"), "pos"), "_up")
        lists.append(below.select("root", "pos").filter(usable_root(F.col("root"))))
    else:
        lists.append(base.limit(0))
    lists.append(manual.filter(S.ascii_lower(F.col("path")).endswith(COMPRESSED_ENDS[0])).select(S.parent(F.col("path")).alias("root"), F.col("n").alias("pos")).filter(usable_root(F.col("root"))))
    return distinct_roots(lists).select("root", "at.list", "at.pos")


def artifacts(roots: DataFrame, entries: DataFrame, boots: DataFrame) -> DataFrame:
    """(root, path, kind): what lies right below each root (entries: path, is_dir) and is a compressed image, an image or a
    folder with a title in it (boots: dir); everything else is no candidate."""
    child = entries.select("path", "is_dir", S.parent(F.col("path")).alias("root")).join(roots.select("root").distinct(), "root", "left_semi")
    fit = child.filter(~S.is_junk(S.base_name(F.col("path"))) & ~S.has_system_folder(F.col("path")) & ~S.is_system_path(F.col("path")))
    have = boots.select(F.col("dir").alias("path")).distinct().withColumn("_app", F.lit(True))
    rows = fit.join(have, "path", "left").withColumn("kind", classify(F.col("path"), F.col("is_dir"), F.coalesce("_app", F.lit(False))))
    return rows.filter("kind <> 'unknown'").select("root", "path", "kind")


def mounted_titles(folders: DataFrame, links: DataFrame, most: int | None = None) -> DataFrame:
    """(title, source_path, image_path): title folders (path) and what they are linked to (path of the link file, target):
    ``mount.lnk`` names the folder, ``mount_img.lnk`` the image. At most ``most`` titles, if that is given, by name."""
    named = folders.select(S.base_name(F.col("path")).alias("title"), "path").filter(S.title_id_valid(F.col("title")))
    link = links.select(S.parent(F.col("path")).alias("_dir"), S.base_name(F.col("path")).alias("_file"), F.trim(F.regexp_replace("target", r"[\r\n]+\z", "")).alias("_to"))
    per = link.groupBy("_dir").agg(F.max(F.when(F.col("_file") == "mount.lnk", F.nullif("_to", F.lit("")))).alias("source_path"), F.max(F.when(F.col("_file") == "mount_img.lnk", F.nullif("_to", F.lit("")))).alias("image_path"))
    rows = named.join(per, F.col("path") == F.col("_dir")).filter("source_path is not null or image_path is not null").select("title", "source_path", "image_path")
    return rows if most is None else rows.orderBy("title").limit(most)


class ScanCache:
    """The artifacts of a scan, kept in shared storage for ``seconds`` or until they are invalidated."""

    def __init__(self, scan: Callable[[], DataFrame], seconds: float = 10.0, clock: Callable[[], float] = time.monotonic):
        self.scan, self.seconds, self.clock, self.kept, self.at = scan, seconds, clock, None, 0.0

    def get(self, force: bool = False) -> DataFrame:
        if force or self.kept is None or self.clock() - self.at >= self.seconds:
            self.invalidate()
            self.kept, self.at = Stored(self.scan(), "artifacts"), self.clock()
        return self.kept.df

    def invalidate(self) -> None:
        if self.kept is not None:
            self.kept.drop()
        self.kept = None


# Places that titles can be moved to, as id, name, root and folder; the least total and free bytes of one.
TARGETS = (("ext0", "External SSD", "/mnt/ext0", "/mnt/ext0/homebrew"), ("ext1", "M.2 SSD", "/mnt/ext1", "/mnt/ext1/homebrew"), *((f"usb{i}", f"USB {i}", f"/mnt/usb{i}", f"/mnt/usb{i}/homebrew") for i in range(8)))
LEAST_TOTAL, LEAST_FREE = 64 << 20, 10 << 20


def storage_targets(capacity: DataFrame) -> DataFrame:
    """(id, name, root, target_root, total, free) of known places with enough room; ``capacity`` has (root, total, free)."""
    known = capacity.sparkSession.createDataFrame(list(TARGETS), "id string, name string, root string, target_root string")
    return capacity.filter((F.col("total") >= LEAST_TOTAL) & (F.col("free") >= LEAST_FREE)).join(F.broadcast(known), "root").select("id", "name", "root", "target_root", "total", "free")


def summary(games: DataFrame, operations: DataFrame) -> DataFrame:
    """(title, source_path, summary): JSON of each title (title, source_path, name, kind, output_path, size, compressed, is_mounted,
    mount_status) with its running and its waiting operation (title, path, op_id, action, status, slot): of several the one in the first slot."""
    ops = operations.select(F.col("title").alias("_t"), S.without_trailing_slash(F.col("path")).alias("_p"), "slot", "status", F.struct(F.col("op_id").alias("id"), S.action_name(F.col("action")).alias("action"), S.label_of(F.col("status")).alias("status")).alias("_op"))
    g = games.select(F.col("title").alias("_gt"), F.col("source_path").alias("_gs"), S.without_trailing_slash(F.col("source_path")).alias("_gp"))
    met = g.join(ops.filter("_p <> ''"), (F.col("_gt") == F.col("_t")) & (F.col("_gp") == F.col("_p"))).unionByName(g.join(ops.filter("_p = ''"), F.col("_gt") == F.col("_t")))
    first = lambda status: F.min_by(F.when(F.col("status") == status, F.col("_op")), F.when(F.col("status") == status, F.col("slot")))
    found = met.groupBy("_gt", "_gs").agg(first("running").alias("activeOp"), first("queued").alias("pendingOp"))
    rows = games.join(found, (F.col("title") == F.col("_gt")) & (F.col("source_path") == F.col("_gs")), "left")
    status = F.coalesce(F.nullif("mount_status", F.lit("")), F.when(F.col("is_mounted"), "mounted").otherwise("not-mounted"))
    saved = F.greatest(F.lit(0).cast("long"), F.col("size") - F.col("compressed"))
    fields = F.struct(
        F.col("title").alias("titleId"), S.instance_id(F.col("title"), F.col("kind"), F.col("source_path")).alias("instanceId"), "name", F.col("kind").alias("sourceKind"), F.col("source_path").alias("sourcePath"), F.col("output_path").alias("outputPath"),
        S.storage_class(F.col("source_path")).alias("storage"), status.alias("mountStatus"), F.col("size").alias("sourceSize"), F.col("compressed").alias("compressedSize"), F.when(F.col("compressed") > 0, saved).otherwise(F.lit(0).cast("long")).alias("savedBytes"),
        F.col("is_mounted").alias("isMounted"), ((F.col("kind") != "unknown") & ~S.under_root(F.col("source_path"), "/data")).alias("canMoveToInternal"), "activeOp", "pendingOp",
    )
    return rows.select("title", "source_path", F.to_json(fields).alias("summary"))


def with_fallbacks(games: DataFrame, operations: DataFrame) -> DataFrame:
    """Titles (title, name, kind, source_path, status) and a row for each running or waiting operation (title, path, output_path,
    display_name, kind, action, status, op_id, seq) that no title stands for: its own paths and names, working."""
    alone = operations_without_title(games, operations.filter(F.col("status").isin("running", "queued")))
    rows = operations.join(alone.select("op_id"), "op_id", "left_semi")
    kind = F.when(F.col("kind") != "unknown", F.col("kind")).when(F.col("action") == "extract-image", "image").when(F.col("action").isin("uncompress", "validate-repair", "validate-only"), "compressed").otherwise("unknown")
    own = rows.select("title", F.when(F.col("display_name") != "", F.col("display_name")).otherwise(F.col("title")).alias("name"), kind.alias("kind"), F.when(F.col("path") != "", F.col("path")).otherwise(F.col("output_path")).alias("source_path"), F.lit("working").alias("status"))
    return games.select("title", "name", "kind", "source_path", "status").unionByName(own)


def distinct_roots(lists: Sequence[DataFrame]) -> DataFrame:
    """(root, pos): the roots of several (root, pos) lists, the earlier lists first, each once, at its first place."""
    rows = None
    for n, one in enumerate(lists):
        part = one.select(S.without_trailing_slash(F.col("root")).alias("root"), F.struct(F.lit(n).alias("list"), F.col("pos").cast("long").alias("pos")).alias("at"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("root").agg(F.min("at").alias("at"))


def apps(files: DataFrame, parameters: DataFrame) -> DataFrame:
    """(dir, title): folders with a boot file right in them whose parameters (dir, json) name a title."""
    boot = files.filter(S.ascii_lower(S.base_name(F.col("rel"))).isin("eboot.bin", "iboot.bin")).select(S.parent(F.col("rel")).alias("dir")).distinct()
    title = F.coalesce(S.json_string(F.col("json"), "titleId"), S.json_string(F.col("json"), "title_id"))
    return parameters.filter(F.octet_length("json") <= 131_072).select("dir", title.alias("title")).filter("title is not null").join(boot, "dir", "left_semi")


def with_sizes(games: DataFrame, cache: DataFrame) -> DataFrame:
    """Titles with the cached size of their path; ``size_pending`` where there is none."""
    known = cache.select(F.col("path").alias("_p"), F.col("size").alias("_s"))
    rows = games.join(known, F.col("source_path") == F.col("_p"), "left")
    return rows.withColumn("size", F.coalesce("_s", F.lit(0).cast("long"))).withColumn("size_pending", F.col("_p").isNull()).drop("_p", "_s")


def compression_source(games: DataFrame, folders: DataFrame) -> DataFrame:
    """Titles with the size of the folder they were probably made from: the sibling ``<title>-app``, else the first root's that is larger."""
    f = folders.select("root", "pos", F.col("title").alias("_t"), F.col("size").alias("_size"))
    rows = games.join(f, F.col("title") == F.col("_t"), "left").filter(F.col("_t").isNull() | (F.col("root") == F.col("own_root")) | (F.col("_size") > F.col("compressed")))
    best = rows.groupBy("title").agg(F.min(F.struct((F.col("root") != F.col("own_root")).alias("a"), F.col("pos"), F.col("_size").alias("size")))["size"].alias("source_size"))
    return games.join(best, "title", "left")


def not_in_memory(persisted: DataFrame, memory: DataFrame, key: str = "key") -> DataFrame:
    """Persisted rows and those in memory, memory winning."""
    return memory.unionByName(persisted.join(memory.select(key), key, "left_anti"))


def refreshed(files: DataFrame, new: DataFrame) -> DataFrame:
    """A scan with one generated file's row replaced or added (by path, whatever its case)."""
    names = new.select(S.ascii_lower(F.col("rel")).alias("_l"))
    return files.join(names, S.ascii_lower(F.col("rel")) == F.col("_l"), "left_anti").unionByName(new)
