"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws an exponential key scaled by its quality weight.  Within
a source, documents sorted by key are prefix-summed up to the token budget;
whole epochs come first and only the rest of the budget is sampled.

The prefix sums need no source in one task: the key's range is cut into
BUCKETS ranges a source, whose sums are added up first; only the one range
in which the budget ends is then sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import WORD, documents, few, materialize

MAX_REPEAT = 3
BUCKETS = 1024
SEED = "mix-1"
#: Quality weights of documents that labels calls good, calls bad, or doesn't name.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(id_col: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight; u in (0, 1) from 52 bits of an md5 of seed and id, so reruns and engines agree."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 13), 16, 10)
    u = (bits.cast("long") + F.lit(0.5)) / F.lit(float(2**52))
    return -F.log(u) / weight


def source_targets(sized: DataFrame, source: str, size: str, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, __source_size, __target): water-filling under a cap of max_repeat times each source's size.

    Sources by code point, null last, weigh 1, 2, 3, repeating.  What a capped
    source can't take is shared out again by weight: all others end at one
    level of target over weight, found by a scan in the order of the caps.
    """
    totals = sized.groupBy(source).agg(F.sum(size).alias("s"))
    order = Window.orderBy(F.col(source).asc_nulls_last())
    caps = totals.select(
        source,
        "s",
        (1 + (F.row_number().over(order) - 1) % 3).cast("double").alias("w"),
        (F.col("s") * float(max_repeat)).alias("cap"),
    )
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col(source).asc_nulls_last())
    up_to, whole = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("s").over(whole) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(up_to), F.lit(0.0))
    )
    levels = caps.select("*", F.when(level <= F.col("cap") / F.col("w"), level).alias("level"))
    levels = levels.select("*", F.first("level", ignorenulls=True).over(whole).alias("final"))
    return levels.select(source, F.col("s").alias("__source_size"), F.least("cap", F.coalesce("final", F.lit(0.0)) * F.col("w")).alias("__target"))


def mix(sized: DataFrame, source: str = "source", size: str = "__size", key: str = "__key", tie: str = "doc_id") -> DataFrame:
    """sized with __source_size, __target and __copies (long) added.

    sized has a row for each document with its size in words, its source
    (null is a source) and its exponential key.  A source of target t and
    size s takes floor(t / s) whole epochs; the rest of t is filled in key
    order, up to the document that brings the sum nearest.  Ties in the key
    go by id, then size; equal rows of one id may differ only in which of
    them is taken.  Sources without words and documents without words take
    nothing, or epochs of no words.  An empty table gives an empty result.
    """
    bucket = F.least(F.floor((1 - F.exp(-F.col(key))) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    base = materialize(sized.select("*", bucket.alias("__bucket")), "mix-base", large=True)
    targets = source_targets(base, source, size)
    sums = base.groupBy(source, "__bucket").agg(F.sum(size).alias("n"))
    upto = Window.partitionBy(source).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.select(F.col(source).alias("__s"), "__bucket", "n", F.sum("n").over(upto).alias("end"))
    epochs = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size"))).otherwise(0).cast("long")
    plan = targets.select(F.col(source).alias("__s"), "__source_size", "__target", epochs.alias("__epochs"))
    plan = plan.select("*", (F.col("__target") - F.col("__epochs") * F.col("__source_size")).alias("__rest"))
    cuts = sums.join(plan, sums["__s"].eqNullSafe(plan["__s"])).where(F.col("end") > F.col("__rest")).groupBy(plan["__s"].alias("__c"))
    cuts = cuts.agg(F.min(F.struct("__bucket", (F.col("end") - F.col("n")).alias("start"))).alias("cut"))
    plan = plan.join(cuts, F.col("__s").eqNullSafe(F.col("__c")), "left")
    plan = materialize(plan.select("__s", "__source_size", "__target", "__epochs", "__rest", F.col("cut.__bucket").alias("__cut"), F.col("cut.start").alias("__start")), "mix-plan")
    joined = base.join(plan, F.col(source).eqNullSafe(F.col("__s")))
    at_cut = F.col("__bucket") == F.coalesce("__cut", F.lit(-1))
    clear = joined.where(~at_cut).select("*", (F.col("__cut").isNotNull() & (F.col("__bucket") < F.col("__cut"))).alias("__in"))
    before = Window.partitionBy(source).orderBy(key, tie, size).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("__start") + F.coalesce(F.sum(size).over(before), F.lit(0)) + F.col(size) / 2
    edge = joined.where(at_cut).select("*", (reached <= F.col("__rest")).alias("__in"))
    copies = F.col("__epochs") + F.col("__in").cast("long")
    own = [c for c in sized.columns if c not in ("__key",)]
    return clear.unionByName(edge).select(*own, "__source_size", "__target", copies.alias("__copies"))


def quality_weights(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with __weight from labels' quality; an id of several labels takes the best."""
    best = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("__label_id")).agg(F.max("quality").alias("__quality"))
    joined = docs.join(few(materialize(best, "labels")), F.col(id_col) == F.col("__label_id"), "left")
    weight = F.when(F.col("__quality") == 1, GOOD).when(F.col("__quality") == 0, BAD).otherwise(UNKNOWN)
    return joined.select(*docs.columns, weight.alias("__weight"))


def sized_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The input of mix(): keep (all columns, if None), __size and __key."""
    keep = keep or docs.columns
    sized = docs.select(*keep, n_words(F.col(text_col)).alias("__size"))
    weighed = quality_weights(sized, labels, id_col)
    return weighed.select(*keep, "__size", exponential_key(F.col(id_col), F.col("__weight")).alias("__key"))


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sized_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id", "source"])
    return mix(sized).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
    )


QUERIES = {"op1_mix": op1_mix}
ORACLE = {
    "op1_mix": f"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sized AS (
  SELECT d.doc_id, d.source, CAST(coalesce(len(regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    -ln((CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
      / CASE b.q WHEN 1 THEN {GOOD}::DOUBLE WHEN 0 THEN {BAD}::DOUBLE ELSE {UNKNOWN}::DOUBLE END AS key
  FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS s FROM sized GROUP BY source),
caps AS (
  SELECT source, s, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS DOUBLE) AS w, s * {MAX_REPEAT}::DOUBLE AS cap FROM totals),
scan AS (
  SELECT *, (sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM caps),
final AS (SELECT arg_min(level, cap / w) AS level FROM scan WHERE level <= cap / w),
plan AS (SELECT source, s, least(cap, coalesce((SELECT level FROM final), 0) * w) AS target FROM caps),
epochs AS (SELECT *, CASE WHEN s > 0 THEN CAST(floor(target / s) AS BIGINT) ELSE 0 END AS e FROM plan),
run AS (
  SELECT z.*, p.s, p.target, p.e, p.target - p.e * p.s AS rest,
    coalesce(sum(z.size) OVER (PARTITION BY z.source ORDER BY z.key, z.doc_id, z.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized z JOIN epochs p ON z.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, s AS source_size, target,
  CAST(size * (e + CASE WHEN before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM run"""
}
