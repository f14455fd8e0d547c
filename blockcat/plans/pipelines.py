"""Whole operations as plans: pack, unpack, verify, repair, patch, compress, extract, index. Inputs are never changed.

What the codec or a digest has been paid for is stored once (see ``operators.shared``); bytes cross a shuffle only where
they must change place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockcat.functions import scalars as S
from blockcat.operators import blocks as B
from blockcat.operators import index, layout
from blockcat.operators.shared import partitions, small, stored

PACKED = ["container", "idx", "len", "sha", "stored", "compressed", "stored_len"]


def placed(rows: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """Packed blocks with ``off``, the place of each in its container behind the header and its table."""
    heads = rows.groupBy("container").agg(F.count("*").alias("_n"))
    heads = heads.select(F.col("container").alias("_c"), S.header_span(F.col("_n"), block).alias("_span"))
    at = B.offsets(rows.select(*PACKED), "container", "stored_len")
    return at.join(small(heads), F.col("container") == F.col("_c")).withColumn("off", F.col("off") + F.col("_span")).drop("_c", "_span")


def pack(files: DataFrame, block: int = B.BLOCK, raw: DataFrame | None = None) -> DataFrame:
    """Blocks of (container, body) with digest, stored bytes and offset."""
    rows = B.cut(files, "container", "body", block).withColumn("sha", B.digest(F.col("data"))).withColumn("len", F.octet_length("data").cast("long"))
    if raw is not None:
        rows = B.forced_raw(rows, raw, "container", block)
    rows = stored(B.encode(rows, block).withColumn("stored_len", F.octet_length("stored").cast("long")).select(*PACKED), "packed")
    return placed(rows, block)


def _joined(keys: list[str], kinds: str):
    """Pieces sorted by keys and place, joined to one value per key; linear in the bytes, one value in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple | None = None
        pieces: list[bytes] = []
        error: str | None = None

        def out() -> pa.RecordBatch:
            row = [*own, b"".join(pieces) if error is None else None, error]
            return pa.RecordBatch.from_arrays([pa.array([v], type=t) for v, t in zip(row, types, strict=True)], names=names)

        names = [*keys, "body", "error"]
        types: list[pa.DataType] = []
        for b in batches:
            types = types or [*[b.column(k).type for k in keys], pa.binary(), pa.string()]
            for *key, piece, bad in zip(*[b.column(k).to_pylist() for k in keys], b.column("piece"), b.column("error").to_pylist(), strict=True):
                if tuple(key) != own:
                    if own is not None:
                        yield out()
                    own, pieces, error = tuple(key), [], None
                error = max(filter(None, (error, bad)), default=None)
                if error is None:
                    pieces.append(piece.as_py())
        if own is not None:
            yield out()

    return run, f"{kinds}, body binary, error string"


def _assemble(parts: DataFrame, keys: list[str]) -> DataFrame:
    kinds = ", ".join(f"`{k}` {dict(parts.dtypes)[k]}" for k in keys)
    dealt = parts.repartition(partitions(parts.sparkSession), *keys).sortWithinPartitions(*keys, "at").select(*keys, "piece", "error")
    return dealt.mapInArrow(*_joined(keys, kinds))


def unpack(blocks: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """(container, body, error) from packed blocks; a container with a bad block has its error and no body. A body is one
    value, so below 2 GB; ``sources.sinks.write_bodies`` streams larger ones to files."""
    back = B.decode(blocks.select("container", "idx", "len", "stored"), block)
    return _assemble(back.select("container", F.col("idx").alias("at"), F.substring("data", F.lit(1), F.col("len").cast("int")).alias("piece"), "error"), ["container"])


def extract(blocks: DataFrame, plan: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """(container, rel, body, error): files of packed images, by a plan of (container, rel, image_offset, size).

    Each file names the blocks it lies in; those are inflated once and only the parts that belong to files are moved.
    """
    spans = plan.select("container", "rel", F.col("image_offset").alias("off"), "size")
    parts = B.overlaps(spans, "container", block).select(F.col("container").alias("_c"), F.col("idx").alias("_i"), "rel", "lo", "hi")
    needed = parts.select(F.col("_c").alias("container"), F.col("_i").alias("idx")).distinct()
    data = B.decode(blocks.select("container", "idx", "stored").join(needed, ["container", "idx"], "left_semi"), block)
    both = parts.join(data, (F.col("container") == F.col("_c")) & (F.col("idx") == F.col("_i")), "left")
    piece = F.substring("data", (F.col("lo") - F.col("_i") * block + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int"))
    error = F.when(F.col("container").isNull(), "missing block").otherwise(F.col("error"))
    found = _assemble(both.select(F.col("_c").alias("container"), "rel", F.col("lo").alias("at"), piece.alias("piece"), error.alias("error")), ["container", "rel"])
    empty = plan.filter("size = 0").select("container", "rel", F.lit("").cast("binary").alias("body"), F.lit(None).cast("string").alias("error"))
    return found.unionByName(empty)


def verify(packed: DataFrame, live: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """(container, idx, state) of each packed block against live data (container, idx, data).

    Digests are taken where the live bytes lie, and 32 bytes a block are joined; only blocks that differ are inflated and compared.
    """
    want = packed.select("container", "idx", F.unhex("sha").alias("_want"))
    have = live.select("container", "idx", F.unhex(B.digest(F.col("data"))).alias("_have"))
    told = stored(want.join(have, ["container", "idx"], "left").select("container", "idx", F.coalesce(F.col("_want") == F.col("_have"), F.lit(False)).alias("same"), F.col("_have").isNotNull().alias("there")), "digests")
    fine = told.filter("same").select("container", "idx", F.lit("matched").alias("state"))
    gone = told.filter("not there").select("container", "idx", F.lit("bad").alias("state"))
    doubt = small(told.filter("not same and there").select("container", "idx"))
    back = B.decode(packed.select("container", "idx", "len", "stored").join(doubt, ["container", "idx"], "left_semi"), block)
    now = live.select("container", "idx", F.col("data").alias("_live")).join(doubt, ["container", "idx"], "left_semi")
    state = F.when(F.col("error").isNull() & (F.substring("data", F.lit(1), F.col("len").cast("int")) == F.col("_live")), "matched-by-bytes").otherwise("bad")
    return fine.unionByName(gone).unionByName(back.join(now, ["container", "idx"]).select("container", "idx", state.alias("state")))


def outcome(states: DataFrame) -> DataFrame:
    """Per container: counts of block states, and what a validation says of them: valid, valid-by-bytes or bad."""
    counts = B.outcome_counts(states, "container")
    return counts.withColumn("outcome", F.when(F.col("bad") > 0, "bad").when(F.col("hash_mismatched") > 0, "valid-by-bytes").otherwise("valid"))


def repair(packed: DataFrame, states: DataFrame, source: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """Packed blocks that can be written: bad ones are replaced by the source's bytes (container, idx, data), stored raw, with
    new digests; all places are reckoned anew. A bad block that the source lacks stays as it is (``unrepaired`` finds it)."""
    bad = states.filter("state = 'bad'").select("container", "idx").distinct()
    mend = source.select("container", "idx", "data").join(small(bad), ["container", "idx"], "left_semi")
    new = mend.select("container", "idx", F.octet_length("data").cast("long").alias("len"), B.digest(F.col("data")).alias("sha"), F.rpad("data", block, F.unhex(F.lit("00"))).alias("stored"), F.lit(False).alias("compressed"), F.lit(block).cast("long").alias("stored_len"))
    kept = packed.select(*PACKED).join(small(new.select("container", "idx")), ["container", "idx"], "left_anti")
    return placed(stored(kept.unionByName(new), "repaired"), block)


def unrepaired(states: DataFrame, source: DataFrame) -> DataFrame:
    """(container, idx) of bad blocks that the source lacks."""
    return states.filter("state = 'bad'").select("container", "idx").join(source.select("container", "idx"), ["container", "idx"], "left_anti")


def repair_offsets(packed: DataFrame, states: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """Old and new place of every block when bad ones are written raw: what a repair in place has to move."""
    bad = states.filter("state = 'bad'").select("container", "idx")
    heads = packed.groupBy("container").agg(F.min(F.struct("idx", "off"))["off"].alias("_first"))
    rows = B.repaired_offsets(packed.select("container", "idx", "stored_len", "off"), bad, "container", block)
    return rows.join(small(heads), "container").withColumn("new_off", F.col("new_off") + F.col("_first")).drop("_first")


def patch(packed: DataFrame, patches: DataFrame, block: int = B.BLOCK) -> DataFrame:
    """Packed blocks after byte patches, with new places: only changed ones are decoded, edited and encoded again."""
    changed = small(B.changed_blocks(patches, "container", block))
    own = B.decode(packed.join(changed, ["container", "idx"], "left_semi").select("container", "idx", "len", "stored"), block)
    edited = B.patched(own.select("container", "idx", "len", "data"), patches, "container", block)
    fresh = edited.withColumn("sha", B.digest(F.substring("data", F.lit(1), F.col("len").cast("int"))))
    fresh = B.encode(fresh, block).withColumn("stored_len", F.octet_length("stored").cast("long"))
    kept = packed.join(changed, ["container", "idx"], "left_anti")
    return placed(stored(kept.select(*PACKED).unionByName(fresh.select(*PACKED)), "patched"), block)


def compress(files: DataFrame, free: DataFrame, block: int = B.BLOCK) -> tuple[DataFrame, DataFrame]:
    """(packed blocks, report): titles (container, body) packed where their volume has room, and each one read back.

    ``free`` has (container, free). A title needs its own size and a header at most; one that might not fit is left out and
    reported as no-space. The report has (container, source_size, stored_size, saved, outcome): verified, mismatch or no-space.
    """
    sizes = files.select("container", F.octet_length("body").cast("long").alias("source_size"))
    need = S.header_span(S.ceil_div(F.col("source_size"), F.lit(block)), block) + S.ceil_div(F.col("source_size"), F.lit(block)) * block
    plan = sizes.join(free, "container", "left").select("container", "source_size", (need <= F.coalesce("free", F.lit(0))).alias("fits"))
    packed = pack(files.join(plan.filter("fits").select("container"), "container", "left_semi"), block)
    back = B.decode(packed.select("container", "idx", "len", "sha", "stored"), block)
    same = F.col("error").isNull() & (B.digest(F.substring("data", F.lit(1), F.col("len").cast("int"))) == F.col("sha"))
    read = back.groupBy("container").agg(F.bool_and(F.coalesce(same, F.lit(False))).alias("same"), F.sum("len").alias("read"))
    size = packed.groupBy("container").agg(F.max(F.col("off") + F.col("stored_len")).alias("stored_size"))
    rows = plan.join(read, "container", "left").join(size, "container", "left")
    whole = F.coalesce(F.col("same") & (F.col("read") == F.col("source_size")), F.col("source_size") == 0)
    end = F.when(~F.col("fits"), "no-space").when(whole, "verified").otherwise("mismatch")
    saved = F.when(F.col("fits"), F.greatest(F.lit(0).cast("long"), F.col("source_size") - F.coalesce("stored_size", F.lit(0))))
    return packed, rows.select("container", "source_size", F.when(F.col("fits"), F.coalesce("stored_size", F.lit(0).cast("long"))).alias("stored_size"), saved.alias("saved"), end.alias("outcome"))


def build_index(entries: DataFrame, strict: bool = False) -> DataFrame:
    """Index records of (container, rel, size, mtime): one per folded path, hashed, in order. The index itself is left out;
    a path that it can't hold ends the build."""
    listed = entries.filter(~S.is_root_index(F.col("rel")))
    checked = F.when(S.index_path_supported(F.col("rel")), F.col("rel")).otherwise(F.raise_error(F.concat(F.lit("path can't be indexed: "), F.col("rel"))))
    listed = listed.withColumn("rel", checked)
    kept = layout.dedup_paths(listed, "container", strict).select("container", "rel")
    rows = index.records(listed.join(kept, ["container", "rel"], "left_semi").dropDuplicates(["container", "rel"]), "container")
    return rows.orderBy("container", *layout.path_order())
