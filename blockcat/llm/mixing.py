"""Mixing sources to target weights.

A document gets a hash-random key. Documents are range-sorted by (source, key), so a source of any size spreads over
many tasks; running totals of their sizes give each one its place in its source's shuffled order. A source's target is
cut exactly: whole epochs first, then the documents whose words lie before the rest of the budget; the document at the
cut gives the words up to it. The cut is one row per source, so deciding a document's share moves no text.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, ...; together they get ``share`` of all words; a
source gets at most ``cap`` times its own words, the excess going to the others by weight. With w the weight and s the
words, the target is min(cap * s, w * level) for the one level that makes the sum right; one pass over the sources in
order of cap * s / w finds it.

Defined cases: null text has size 0, null source is a source of its own; rows alike in source, key, doc_id and size
share a cut evenly; an empty table gives an empty result; columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from blockcat.llm.common import fresh, running_totals, small, stored, words_count

WEIGHTS = (5, 2, 1)


def _key(doc_id: Column) -> Column:
    return F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 16)


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size)."""
    one = Window.partitionBy(F.lit(0))
    n = F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))).withColumn("most", F.col("source_size") * cap)
    fill = one.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rows = rows.withColumn("level", (F.sum("source_size").over(one) * share - full) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("free", F.col("most") > F.col("w") * F.col("level"))
    rows = rows.withColumn("final", F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("w"), "source", "level"))).over(one)["level"])
    return rows.select("source", "source_size", F.when(F.col("free"), F.col("w") * F.col("final")).otherwise(F.col("most")).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` with size, source_size, target and taken (the words the mix takes of it, repeats counted)."""
    kept = [c for c in docs.columns if c.lower() not in ("size", "source_size", "target", "taken")]
    size = words_count(F.col("text"))
    sized = stored(docs.select("source", F.col("doc_id").cast("long").alias("id"), size.alias("size"), _key(F.col("doc_id")).alias("key")), "sized")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.expr("cast(round(target) as long) div nullif(source_size, 0)")).cast("long"))
    plan = stored(plan.withColumn("rest", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")).withColumnRenamed("source", "_source"), "targets")
    placed = running_totals(sized, ["source", "key", "id", "size"], "size", "source", "mix-order")
    at_cut = placed.join(small(plan), F.col("source").eqNullSafe(F.col("_source"))).filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("size") >= F.col("rest")))
    cut = stored(at_cut.select(F.col("_source").alias("_s"), F.col("key").alias("_k"), F.col("id").alias("_i"), F.col("size").alias("_n")), "cut")
    # rows that the order cannot tell from the one at the cut
    like = F.col("source").eqNullSafe(F.col("_s")) & (F.col("key") == F.col("_k")) & F.col("id").eqNullSafe(F.col("_i")) & (F.col("size") == F.col("_n"))
    tied = placed.join(small(cut), like).groupBy("_s", "_k", "_i", "_n").agg(F.min("before").alias("cut_before"), F.count("*").alias("tied"))
    known = plan.join(tied, F.col("_source").eqNullSafe(F.col("_s")), "left")
    name, own = fresh(docs, "_plan", "_own")
    facts = F.struct("source_size", "target", "epochs", "rest", F.struct("_k", F.coalesce("_i", F.lit(-(2**63))).alias("_i"), "_n").alias("edge"), "cut_before", "tied").alias(name)
    source = f"{name}source"
    facts_of = stored(known.select(F.col("_source").alias(source), facts), "plan")
    rows = docs.select(*[F.col(c) for c in kept], F.struct(size.alias("size"), _key(F.col("doc_id")).alias("key")).alias(own))
    rows = rows.join(small(facts_of), F.col("source").eqNullSafe(F.col(source)), "left")
    p, own_size = F.col(name), F.col(own)["size"]
    order = F.struct(F.col(own)["key"].alias("_k"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_i"), own_size.alias("_n"))
    partial = F.when(p["tied"].isNull(), F.lit(0)).when(order < p["edge"], own_size).when(order == p["edge"], F.floor(F.least(p["rest"] - p["cut_before"], own_size * p["tied"]) / p["tied"])).otherwise(F.lit(0))
    return rows.select(*[F.col(c) for c in kept], own_size.alias("size"), p["source_size"].alias("source_size"), p["target"].alias("target"), (p["epochs"] * own_size + partial).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document once per epoch; the one at a source's cut gives its first words."""
    whole, mixed_in = fresh(docs, "_row", "_words")
    rows = mix(docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias(whole)), weights, share, cap).filter("taken > 0")
    parts = F.expr("filter(transform(sequence(0, cast((taken - 1) div size as int)), i -> least(size, taken - i * size)), w -> w > 0)")
    rows = rows.withColumn(mixed_in, F.explode(parts))
    cut = F.col(mixed_in) < F.col("size")
    text = F.when(cut, _first_words(F.col("text"), F.col(mixed_in))).otherwise(F.col("text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(cut, F.char_length(text).cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col(whole)["n_chars"])
    return rows.select(*[new[c].alias(c) if c in new else F.col(whole)[c].alias(c) for c in docs.columns])


def _first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    parts = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), n.cast("int")), "")
