"""Scalar functions as Column expressions: hashes, paths, codecs, validity rules and small arithmetic.

Hashes over bytes are folds that no built-in has; they run over a whole Arrow batch at once, byte by byte of all its values.
Patterns end in ``\\z``: ``$`` would also match before a last line feed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Hash parameters. The 64-bit basis is the one that stored indexes use, not the usual one.
FNV32_BASIS, FNV32_PRIME = 2166136261, 16777619
FNV64_BASIS, FNV64_PRIME = 1469598103934665603, 1099511628211

# Names of metadata that a desktop system leaves behind.
JUNK_NAMES = (".DS_Store", ".Spotlight-V100", ".Trashes", ".fseventsd", ".TemporaryItems", ".DocumentRevisions-V100", ".VolumeIcon.icns", ".apdisk", ".metadata_never_index", ".com.apple.timemachine.donotpresent", "__MACOSX", "Icon\r")

# Folders that never hold a title, in lower case.
SYSTEM_FOLDERS = ("$recycle.bin", "system volume information", "recycler", "recycled", "found.000", "lost+found")

# Where the system keeps its own applications, and the name of a title's path index (and of its temporary form).
SYSTEM_ROOT = "/system_ex/app"
INDEX_NAMES = ("ampr_emu.index", "ampr_emu.index.tmp")

# Stored size expected of a file, in thousandths of its size, by the end of its name.
RATIOS = {
    950: (".pkg", ".pak", ".ucas", ".utoc", ".mp4", ".m4v", ".bik", ".bk2", ".wem", ".opus", ".ogg", ".mp3", ".jpg", ".jpeg", ".png", ".zip", ".rar", ".7z", ".gz", ".zst", ".lz4", ".xz"),
    500: (".json", ".xml", ".txt", ".ini", ".cfg", ".lua", ".js", ".css", ".ush", ".usf", ".shader", ".hlsl", ".glsl", ".csv", ".tsv"),
    850: (".bin", ".prx", ".sprx", ".self", ".elf", ".dll", ".so"),
}
OTHER_RATIO = 700

# Storage class of a path by its root.
STORAGE = {"internal": ("/data",), "external": ("/mnt/ext0",), "m2": ("/mnt/ext1",), "usb": tuple(f"/mnt/usb{i}" for i in range(8))}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def ascii_upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start of each value, its length) of a string or binary column; null counts as empty."""
    column = column.cast(pa.large_binary())
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(at), 0)
    return np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8), at[:-1], size


def _fold(column: pa.Array, start: int, kind: type, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """h = step(h, byte) over the bytes of each value, all values of the batch together."""
    data, at, size = _bytes(column)
    order = np.argsort(-size, kind="stable")
    at, longest_first = at[order], size[order]
    h = np.full(len(size), start, dtype=kind)
    left = np.searchsorted(-longest_first, -np.arange(int(size.max(initial=0))), side="left")  # values longer than each place
    for place, n in enumerate(left.tolist()):
        h[:n] = step(h[:n], data[at[:n] + place].astype(kind))
    out = np.empty_like(h)
    out[order] = h
    return out


def _nulls_stay(column: pa.Array, values: pa.Array) -> pa.Array:
    return pa.compute.if_else(column.is_valid(), values, None)


@F.arrow_udf(LongType())
def _fnv32(c: pa.Array) -> pa.Array:
    h = _fold(c, FNV32_BASIS, np.uint32, lambda h, b: (h ^ b) * np.uint32(FNV32_PRIME))
    return _nulls_stay(c, pa.array(h.astype(np.int64)))


@F.arrow_udf(StringType())
def _fnv64(c: pa.Array) -> pa.Array:
    h = _fold(c, FNV64_BASIS, np.uint64, lambda h, b: (h ^ b) * np.uint64(FNV64_PRIME))
    return _nulls_stay(c, pa.array([f"{x:016x}" for x in h.tolist()], type=pa.string()))


@F.arrow_udf(LongType())
def _path31(c: pa.Array) -> pa.Array:
    return _nulls_stay(c, pa.array(_fold(c, 0, np.uint32, lambda h, b: h * np.uint32(31) + b).astype(np.int64)))


@F.arrow_udf(LongType())
def _name16(c: pa.Array) -> pa.Array:
    turn = lambda h: (h >> np.uint16(1)) | (h << np.uint16(15))
    return _nulls_stay(c, pa.array(_fold(c, 0, np.uint16, lambda h, b: turn(turn(h) + b)).astype(np.int64)))


@F.arrow_udf(LongType())
def _checksum32(c: pa.Array) -> pa.Array:
    turn = lambda h: (h >> np.uint32(1)) | (h << np.uint32(31))
    return _nulls_stay(c, pa.array(_fold(c, 0, np.uint32, lambda h, b: turn(h) + b).astype(np.int64)))


@F.arrow_udf(LongType())
def _first_difference(a: pa.Array, b: pa.Array) -> pa.Array:
    def one(x: bytes, y: bytes) -> int:
        if x == y:
            return -1
        n = min(len(x), len(y))
        other = np.flatnonzero(np.frombuffer(x, np.uint8, n) != np.frombuffer(y, np.uint8, n))
        return int(other[0]) if len(other) else n

    values = [one(x or b"", y or b"") for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
    return pa.array(values, type=pa.int64())


def fnv1a32(c: Column) -> Column:
    """FNV-1a of the bytes, 32 bits, as a long."""
    return _fnv32(c.cast("binary"))


def fnv1a64_bytes_hex(c: Column) -> Column:
    """FNV-1a of the bytes with the stored indexes' basis, 64 bits, as 16 hex digits."""
    return _fnv64(c.cast("binary"))


def fnv1a64_hex(c: Column) -> Column:
    """The same for paths: zero becomes one."""
    out = fnv1a64_bytes_hex(c)
    return F.when(out == "0" * 16, F.lit("0" * 15 + "1")).otherwise(out)


def path_hash31(c: Column) -> Column:
    """h = upper(byte) + 31 h modulo 2**32 over a path."""
    return _path31(ascii_upper(c).cast("binary"))


def name_hash16(c: Column) -> Column:
    """Rotate-and-add over the upper-cased 16-bit characters of an ASCII name (low byte, then a zero high byte)."""
    return _name16(ascii_upper(c).cast("binary"))


def checksum32(c: Column, skip: Sequence[int] = ()) -> Column:
    """Rotate-and-add over bytes, 32 bits, leaving out the given places."""
    c = c.cast("binary")
    if skip:
        cuts = [-1, *sorted(set(skip))]
        parts = [F.substring(c, a + 2, z - a - 1) for a, z in zip(cuts, cuts[1:], strict=False) if z - a > 1]
        c = F.concat(*parts, F.substring(c, F.lit(cuts[-1] + 2), F.octet_length(c)))
    return _checksum32(c)


def first_difference(a: Column, b: Column) -> Column:
    """The first byte at which two whole values differ, a shorter one differing where it ends; -1 if equal (null counts as empty)."""
    return _first_difference(a.cast("binary"), b.cast("binary"))


def little_endian(c: Column, offset: int, width: int) -> Column:
    """The unsigned integer of ``width`` bytes at an offset of a binary value: a long, of 8 bytes a decimal(20,0); null if it is cut off."""
    part = F.substring(c, offset + 1, width)
    number = F.conv(F.hex(_reversed(part, width)), 16, 10)
    return F.when(F.octet_length(part) == width, number.cast("decimal(20,0)" if width == 8 else "long"))


def _reversed(c: Column, width: int) -> Column:
    return F.concat(*[F.substring(c, width - i, 1) for i in range(width)])


def to_little_endian(value: Column, width: int) -> Column:
    """A number's lowest ``width`` bytes, lowest first (a negative long stands for the unsigned one of the same bits)."""
    return F.substring(_reversed(F.unhex(F.lpad(F.hex(value.cast("long")), 16, "0")), 8), 1, width)


def _div(a: Column, b: Column) -> Column:
    """Integer division, never through floating point."""
    return F.call_function("div", a, b)


def ceil_div(a: Column, b: Column) -> Column:
    a, b = a.cast("long"), b.cast("long")
    return F.when(b == 0, F.lit(0).cast("long")).otherwise(_div(a, b) + (a % b > 0).cast("long"))


def saturating_product(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_multiply(a, b), F.lit(2**63 - 1))


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def parent(c: Column) -> Column:
    """The path before the last slash: "/" for a child of the root, "" without a slash."""
    at = F.length(c) - F.length(base_name(c))
    return F.when(at == 0, F.lit("")).when(at == 1, F.lit("/")).otherwise(F.substring(c, F.lit(1), at - 1))


def stem(c: Column) -> Column:
    """The base name without its last extension (a leading dot begins none)."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def extension(c: Column) -> Column:
    return ascii_lower(F.regexp_extract(base_name(c), r".(\.[^.]+)$", 1))


def without_trailing_slash(c: Column) -> Column:
    return F.regexp_replace(c, "(?<=.)/+$", "")


def same_path(a: Column, b: Column) -> Column:
    return without_trailing_slash(a) == without_trailing_slash(b)


def under_root(c: Column, root: str) -> Column:
    """The root itself or something below it: /database isn't under /data."""
    return (c == root) | c.startswith(root + "/")


def storage_class(c: Column) -> Column:
    out = None
    for name, roots in STORAGE.items():
        for root in roots:
            out = F.when(under_root(c, root), name) if out is None else out.when(under_root(c, root), name)
    return out.otherwise("other")


def is_junk(name: Column) -> Column:
    return name.isin(*JUNK_NAMES) | name.startswith("._")


def has_system_folder(path: Column) -> Column:
    """Whether a segment is hidden, a system folder or of 256 bytes and more; an empty path has one too."""
    bad = F.exists(F.split(path, "/"), lambda s: s.startswith(".") | ascii_lower(s).isin(*SYSTEM_FOLDERS) | (F.octet_length(s) >= 256))
    return (path == "") | bad


def is_system_path(path: Column) -> Column:
    """Whether a path lies where the system keeps its own applications."""
    return under_root(path, SYSTEM_ROOT)


def title_id_valid(c: Column) -> Column:
    return c.rlike(r"\A[A-Za-z0-9]{9}\z")


def path_safe(c: Column) -> Column:
    """Absolute, under 1024 bytes, printable ASCII, no backslash, empty or dot segments (a lone ``/.`` passes)."""
    dots = (F.octet_length(c) >= 3) & (c.endswith("/..") | c.endswith("/."))
    return (F.octet_length(c) < 1024) & c.rlike(r"\A/[\x20-\x7E]*\z") & ~c.rlike(r"\\|//|/\.\.?/") & ~dots


def version_safe(c: Column) -> Column:
    """1 to 63 letters, digits, dots, underscores and hyphens."""
    return c.rlike(r"\A[A-Za-z0-9._-]{1,63}\z")


def intent_valid(c: Column) -> Column:
    return c.isin("latest", "manual", "custom")


def sha256_valid(c: Column) -> Column:
    return c.rlike(r"\A[0-9a-fA-F]{64}\z")


def is_executable(path: Column) -> Column:
    name = ascii_lower(base_name(path))
    return name.rlike(r"(?s)\A[ei]boot.*\.bin\z|\.(prx|sprx|self|elf|dll|so)\z")


def goes_to_tail(rel: Column) -> Column:
    """Whether a file is laid out after all others: libraries' folders, and boot files, modules and the index in the root."""
    low = ascii_lower(rel)
    return low.rlike(r"\A(fakelib|sce_module)/") | low.rlike(r"\A([ei]boot\.bin|[^/]*\.s?prx)\z") | (low == INDEX_NAMES[0])


def is_root_index(rel: Column) -> Column:
    """Whether a file is the index itself, or its temporary form: neither is indexed."""
    return ascii_lower(rel).isin(*INDEX_NAMES)


def stored_ratio(rel: Column) -> Column:
    """Expected stored thousandths by the end of the name, whatever its case."""
    low, out = ascii_lower(rel), None
    for ratio, ends in RATIOS.items():
        rule = low.rlike("(" + "|".join(e.replace(".", r"\.") for e in ends) + r")\z")
        out = F.when(rule, ratio) if out is None else out.when(rule, ratio)
    return out.otherwise(OTHER_RATIO)


def predicted_stored(size: Column, ratio: Column) -> Column:
    """The size times the ratio, rounded up, at least 1 and at most the size; the size itself where the product needs over 64 bits."""
    size, ratio = size.cast("long"), ratio.cast("long")
    rest = size % 1000 * ratio + 999
    product = _div(size, F.lit(1000)) * ratio + _div(rest, F.lit(1000))  # parts that can't overflow
    wide = size > _div(F.lit(Decimal(2**64 - 1)), ratio)
    return F.when(size == 0, F.lit(0).cast("long")).when(wide, size).otherwise(F.greatest(F.lit(1).cast("long"), F.least(size, product)))


def gain_reached(stored: Column, block: int = 65_536, percent: int = 5) -> Column:
    """Whether a compressed block is small enough to be kept."""
    return (F.lit(block) - stored) * 100 >= block * percent


def header_span(blocks: Column, block: int = 65_536) -> Column:
    """Bytes before a container's data: a first block, then whole blocks for what its offsets need beyond it."""
    over = F.greatest(F.lit(0).cast("long"), (blocks + 1) * 8 - (block - 1024))
    return F.lit(block).cast("long") + ceil_div(over, F.lit(block)) * block


def instance_id(title: Column, kind: Column, source: Column) -> Column:
    return F.concat_ws(":", F.when(title == "", F.lit("UNKNOWN")).otherwise(title), kind, F.lower(F.lpad(F.hex(fnv1a32(source)), 8, "0")))


def history_key(op_id: Column, created: Column) -> Column:
    head = F.substring_index(op_id, ":", 1)
    return F.concat(F.when(head == "", F.lit("recovery")).otherwise(head), F.when(created != 0, F.concat(F.lit(":"), created.cast("string"))).otherwise(""))


def minimum_free(source: Column, budget: Column) -> Column:
    return F.when((source > 0) & (source < budget), source).otherwise(budget)


def shortfall(required: Column, free: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), required - free)


def repair_strategy(size: Column, free: Column) -> Column:
    """Copy if a fifth more than the size is free, else in place."""
    return F.when(free >= ceil_div(size * 6, F.lit(5)), "copy-replace").otherwise("in-place")


def compact_text(c: Column, limit: int) -> Column:
    """Runs of space, tab and line ends become one space, other control characters go; what exceeds ``limit`` characters
    is cut off and marked by three dots."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", ""), r"[ \t\r\n]+", " "))
    head = F.rtrim(F.substring(clean, 1, limit))
    return F.when(F.char_length(clean) <= limit, clean).otherwise(F.when(head == "", head).otherwise(F.concat(head, F.lit("..."))))


def ini_value(line: Column, key: str) -> Column:
    """The value of ``key = value`` without quotes; null for another line or a comment."""
    m = F.regexp_extract(line, rf"^[ \t]*{key}[ \t]*=[ \t]*(.*?)[ \t\r]*$", 1)
    return F.when(line.rlike(rf"^[ \t]*{key}[ \t]*="), F.regexp_replace(m, "^\"(.*)\"$", "$1"))


def ini_bool(value: Column) -> Column:
    low = ascii_lower(value)
    return F.when(low.isin("1", "true", "yes", "on"), True).when(low.isin("0", "false", "no", "off"), False)


def speed_metric(verb: Column, phase: Column, copied: Column, output: Column, read: Column, written: Column, copy: Column) -> Column:
    """struct(bytes, source): which counter of a job tells its progress."""
    zero = F.lit(0).cast("long")
    plus = lambda c: F.greatest(zero, c)

    def pair(n: Column, name: Column | str) -> Column:
        return F.struct(n.cast("long").alias("bytes"), (F.lit(name) if isinstance(name, str) else name).alias("source"))

    repair = F.greatest(plus(copy), plus(written))
    repairing = phase.isin("repairing", "copying", "metadata")
    first = (
        F.when((verb == "compress") & ((copied > 0) | (output <= 0)), pair(plus(copied), "compressed-input"))
        .when(verb == "compress", pair(output, "compressed-output"))
        .when(verb.isin("validate-repair", "validate-only") & repairing & (repair > 0), pair(repair, F.when(copy > 0, "repair-copy").otherwise("repair-write")))
        .when(verb.isin("validate-repair", "validate-only") & repairing, pair(plus(copied), "repair-progress"))
        .when(verb.isin("validate-repair", "validate-only"), pair(F.when(copied > 0, copied).otherwise(read), "validated"))
        .when(verb == "uncompress", pair(plus(copied), "unpacked-output"))
        .when(verb == "extract-image", pair(plus(copied), "extracted-output"))
        .when(verb == "read-speed-test", pair(plus(copied), "read-test"))
        .when(verb.isin("move-to-usb", "move-to-internal", "copy-to-usb", "copy-to-internal"), pair(plus(copied), "transferred"))
        .otherwise(pair(plus(copied), "copied"))
    )
    any_io = F.greatest(repair, plus(read))
    return F.when((first["bytes"] <= 0) & (any_io > 0), pair(any_io, "repair-io")).otherwise(pair(plus(first["bytes"]), first["source"]))


def overlap_policy(levels: Sequence[tuple[str, Column, Column]]) -> Column:
    """struct(policy, reason) for two devices: the first level that both know decides."""
    out = F.struct(F.lit("serial").alias("policy"), F.lit("unresolved-device-id").alias("reason"))
    for name, a, b in reversed(list(levels)):
        same = F.struct(F.lit("serial").alias("policy"), F.lit(f"same-{name}").alias("reason"))
        other = F.struct(F.lit("pipelined").alias("policy"), F.lit(f"different-{name}").alias("reason"))
        out = F.when(a.isNotNull() & b.isNotNull(), F.when(a == b, same).otherwise(other)).otherwise(out)
    return out


def update_needed(present: Column, current: Column, latest: Column, intent: Column, selected: Column, cached: Column) -> Column:
    """Whether a binary should be updated: known, not the latest, and either chosen as latest or never seen."""
    fine = present & F.coalesce(sha256_valid(current) & sha256_valid(latest), F.lit(False)) & (ascii_lower(current) != ascii_lower(latest))
    return fine & F.when(intent.isNotNull(), (intent == "latest") & (ascii_lower(selected) == ascii_lower(current))).otherwise(~cached)


def title_id_in_name(path: Column, letters: str = "PPSA") -> Column:
    """The first id of the given letters and five digits anywhere in the base name, in upper case; null if none."""
    return F.nullif(F.upper(F.regexp_extract(base_name(path), f"(?i)({letters}[0-9]{{5}})", 1)), F.lit(""))


def mount_hash(path: Column, title: Column, base: str) -> Column:
    """The number of ``<base>/<title>_<8 hex digits>``, at the end or before a slash; null for another path or an empty title."""
    head = F.concat(F.lit(base + "/"), title, F.lit("_"))
    digits = F.substring(path, F.length(head) + 1, F.lit(8))
    after = F.substring(path, F.length(head) + 9, F.lit(1))
    fits = (title != "") & F.startswith(path, head) & digits.rlike(r"\A[0-9a-fA-F]{8}\z") & after.isin("", "/")
    return F.when(fits, F.conv(digits, 16, 10).cast("long"))


def cluster_offset(cluster: Column, heap: int, size: int = 65_536) -> Column:
    """Where a cluster's bytes begin; clusters count from 2."""
    return F.lit(heap).cast("long") + (cluster - 2) * size


def query_argument(url: Column, name: str) -> Column:
    """A decoded query argument (plus is a space); null if the address has none of that name."""
    raw = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(url.rlike(rf"[?&]{name}="), F.try_url_decode(raw))


def index_marker(rel: Column, markers: Sequence[str]) -> Column:
    """Whether a path is one of the markers, whatever its case."""
    return ascii_lower(rel).isin(*[m.lower() for m in markers])


def index_path_supported(rel: Column) -> Column:
    return (rel != "") & ~rel.rlike(r"[\t\n\r]")


def json_string(text: Column, key: str) -> Column:
    """The string after the first place where the quoted key stands in a JSON text, whatever it is nested in; null if no string follows there or it is empty."""
    found = F.regexp_extract(text, rf'(?s)\A.*?"{key}"(?:\s*:\s*"((?:[^"\\]|\\.)*)")?', 1)
    return F.nullif(F.regexp_replace(found, r"(?s)\\(.)", "$1"), F.lit(""))


def json_number(text: Column, key: str, fallback: int = 0) -> Column:
    """The digits after the first place where the quoted key stands; 0 if none follow the colon, the fallback without key or colon."""
    pattern = rf'(?s)\A.*?"{key}"(\s*:\s*([0-9]*))?'
    return F.when(F.coalesce(F.regexp_extract(text, pattern, 1), F.lit("")) == "", F.lit(fallback).cast("long")).otherwise(F.coalesce(F.nullif(F.regexp_extract(text, pattern, 2), F.lit("")), F.lit("0")).cast("long"))


def json_bool(text: Column, key: str, fallback: bool = False) -> Column:
    """A top-level true or false of an object; the fallback for anything else."""
    value = F.get_json_object(text, f"$.{key}")
    return F.when(value == "true", True).when(value == "false", False).otherwise(F.lit(fallback))


def _label(value: Column, labels: dict[str, str], other: str) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), value), F.lit(other))


# What statuses, actions and states of sizes are called.
STATUSES = {"queued": "pending", "running": "running", "success": "success", "failed": "failed", "cancelled": "cancelled"}
ACTIONS = ("compress", "make-image", "uncompress", "extract-image", "validate-repair", "validate-only", "move-to-usb", "move-to-internal", "copy-to-usb", "copy-to-internal", "refresh-mount", "delete-game-data", "read-speed-test", "build-ampr-index", "set-read-only", "update-ampr")
SIZE_STATES = ("cached", "queued", "scanning", "refreshing", "done", "failed")
ACTION_LABELS = {"compress": "Compress", "uncompress": "Unpack", "extract-image": "Extract", "validate-repair": "Repair", "validate-only": "Validate", "move-to-usb": "Move", "move-to-internal": "Move"}
PAST_LABELS = {"compress": "Compressed", "uncompress": "Unpacked", "extract-image": "Extracted", "validate-repair": "Validated and repaired", "validate-only": "Validated", "move-to-usb": "Moved to USB", "move-to-internal": "Moved to internal storage"}
CANCEL_LABELS = {"compress": "Cancelled compression", "uncompress": "Cancelled unpack", "extract-image": "Cancelled extract", "validate-repair": "Cancelled validation and repair", "validate-only": "Cancelled validation", "move-to-usb": "Cancelled USB move", "move-to-internal": "Cancelled internal move"}


def label_of(status: Column) -> Column:
    """What a status is called where people read it: what is queued is pending."""
    return _label(status, STATUSES, "unknown")


def action_name(action: Column) -> Column:
    return F.when(action.isin(*ACTIONS), action).otherwise("unknown")


def size_state_name(state: Column) -> Column:
    return F.when(state.isin(*SIZE_STATES), state).otherwise("unknown")


def action_label(action: Column) -> Column:
    return _label(action, ACTION_LABELS, "Operation")


def past_label(action: Column) -> Column:
    return _label(action, PAST_LABELS, "Completed")


def cancel_label(action: Column) -> Column:
    return _label(action, CANCEL_LABELS, "Cancelled operation")


def size_state(used: Column, scanning: Column, queued: Column, failed: Column, done: Column, size: Column, measured_at: Column) -> Column:
    """The state of a measured size, one of seven: the first rule that holds."""
    known = size > 0
    return (
        F.when(~used, "unknown").when(scanning, F.when(known, "refreshing").otherwise("scanning")).when(queued, F.when(known, "refreshing").otherwise("queued"))
        .when(failed, "failed").when(done, "done").when(known & (measured_at > 0), "cached").otherwise("unknown")
    )


# First bytes of inner images: two little-endian numbers of 64 bits, and a name at byte 3.
INODE_IMAGE_VERSION, INODE_IMAGE_MAGIC, EXFAT_NAME = 2, 20130315, "EXFAT   "


def nested_type(header: Column) -> Column:
    """What an inner image is, by its first bytes."""
    inodes = (little_endian(header, 0, 8) == INODE_IMAGE_VERSION) & (little_endian(header, 8, 8) == INODE_IMAGE_MAGIC)
    return F.when(F.coalesce(inodes, F.lit(False)), "inodes").when(F.substring(header, 4, 8) == F.lit(EXFAT_NAME).cast("binary"), "exfat").otherwise("unknown")


def nested_type_of_name(path: Column) -> Column:
    """What an image is by the end of its name."""
    low = ascii_lower(path)
    return F.when(low.endswith(".exfat"), "exfat").when(low.endswith(".ffpfs") | low.endswith(".pfs") | low.endswith(".dat"), "inodes").otherwise("unknown")


def target_path(root: Column, title: Column, kind: Column, output: Column) -> Column:
    """Where a packed title goes: ``<root>/<title>.ffpfsc`` from a folder, ``<root>/<name of the output>`` from an image if
    that name is fit; null otherwise or if it would reach 1024 bytes."""
    name = base_name(output)
    fit = (name != "") & ~name.startswith(".") & ascii_lower(name).endswith(".ffpfsc")
    path = F.concat(root, F.lit("/"), F.when(kind == "folder", F.concat(title, F.lit(".ffpfsc"))).when((kind == "image") & fit, name))
    return F.when((root != "") & (F.octet_length(path) < 1024), path)
