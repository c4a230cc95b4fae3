"""Seeded, reproducible samples: quotas by largest remainder, stratified subsets, first-wins duplicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .calibrate import spread
from .ordered import hash_bucket, ranks


def allocate(sizes: DataFrame, key: str, size: str, budget: Column, by: Sequence[str] = ()) -> DataFrame:
    """sizes (a row a group) with take: budget split in proportion to size by largest remainder, ties by key; groups of nothing left out.

    No share exceeds its group's size, as the budget is cut to the total.
    """
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    whole = sizes.select("*", F.sum(size).over(part).alias("__total"), budget.cast("long").alias("__b"))
    whole = whole.select("*", F.least("__b", "__total").alias("__budget"))
    quota = F.col("__budget") * F.col(size) / F.col("__total")
    shares = whole.where("__total > 0").select("*", quota.alias("__quota"), F.floor(quota).alias("__floor"))
    left = F.col("__budget") - F.sum("__floor").over(part)
    order = F.row_number().over(part.orderBy((F.col("__quota") - F.col("__floor")).desc(), F.col(key)))
    taken = shares.select(*sizes.columns, (F.col("__floor") + (order <= left).cast("long")).alias("take"))
    return taken.where("take > 0")


def stratified_subset(rows: DataFrame, limit: int, seed: str = "seed", id_col: str = "id", label: str = "y", source: str = "source") -> DataFrame:
    """Half real, half generated, spread over sources in proportion, picked by a hash of the id; all rows for a limit of 0 or beyond them."""
    if limit <= 0 or limit >= rows.count():
        return rows
    sizes = rows.groupBy(label, source).agg(F.count("*").alias("size"))
    budget = F.when(F.col(label) == 0, limit // 2).otherwise(limit - limit // 2)
    quotas = allocate(sizes, source, "size", budget, [label]).select(label, source, "take")
    keyed = rows.select("*", spread(F.col(id_col), seed).alias("__h"))
    ranked = ranks(keyed, [label, source], hash_bucket(F.col("__h")), [F.col("__h"), F.col(id_col)], "__rank")
    return ranked.join(F.broadcast(quotas), [label, source]).where("__rank < take").select(*rows.columns)  # a row a source


def first_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in the given order; combines before the shuffle, so no key's rows meet in one task."""
    others = [c for c in rows.columns if c not in order]
    first = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.min(F.struct(*order, *others)).alias("r"))
    return first.select(*[F.col("r")[c].alias(c) for c in rows.columns])


def last_of_each(rows: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    others = [c for c in rows.columns if c not in order]
    last = rows.groupBy(*[F.col(c).alias(f"__{c}") for c in key]).agg(F.max(F.struct(*order, *others)).alias("r"))
    return last.select(*[F.col("r")[c].alias(c) for c in rows.columns])


def dedup_by_content(rows: DataFrame, content: str, order: Sequence[str]) -> DataFrame:
    """Rows of distinct content with digest, the first 16 hex digits of its SHA-256; the first in order stays."""
    digested = rows.select("*", F.sha2(F.col(content).cast("binary"), 256).alias("__digest"))
    kept = first_of_each(digested, ["__digest"], order)
    return kept.select(*rows.columns, F.left(F.col("__digest"), F.lit(16)).alias("digest"))


def admit(items: DataFrame, per_source: int, least_side: int = 224) -> DataFrame:
    """The rows that a benchmark takes, source by source in order of source_pos.

    Of a source's items, in order of item_pos, those count whose digest no
    kept item has, that decode (width not null), that are no animation and
    whose shorter side is least_side or more; the first per_source are kept,
    of the first three times as many candidates.  Only a kept item's digest
    blocks later ones, so sources are taken one after the other: on the
    driver, from the keys of 3 * per_source items a source.
    """
    fit = items.where((F.col("item_pos") < 3 * per_source) & F.col("width").isNotNull() & (F.col("n_frames") <= 1) & (F.least("width", "height") >= least_side))
    keys = fit.where("source_pos IS NOT NULL").groupBy("source_pos", "digest").agg(F.min("item_pos").alias("item_pos")).select("source_pos", "item_pos", "digest")
    taken, count, seen = [], {}, set()
    for r in keys.orderBy("source_pos", "item_pos", "digest").collect():
        if r["digest"] not in seen and count.get(r["source_pos"], 0) < per_source:
            count[r["source_pos"]] = count.get(r["source_pos"], 0) + 1
            taken.append(tuple(r))
            if r["digest"] is not None:
                seen.add(r["digest"])
    kept = items.sparkSession.createDataFrame(taken, keys.schema).toDF("__source", "__item", "__digest")
    same = (F.col("source_pos") == F.col("__source")) & (F.col("item_pos") == F.col("__item")) & F.col("digest").eqNullSafe(F.col("__digest"))
    return first_of_each(fit.join(F.broadcast(kept), same, "left_semi"), ["source_pos", "digest"], ["item_pos"])  # per_source rows a source
