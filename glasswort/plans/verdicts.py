"""Queries of calibration, fusion and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from . import bench as B

FPR5, LOW = B.THRESHOLDS["fpr5"], B.THRESHOLDS["abstain_low"]
WEIGHTS = {"commforensics384": 2.0, "haywoodsloan": 0.5}


def fused(weights: dict[str, float] | None = None) -> Column:
    return S.fuse({m: F.col(f"d{B.DETECTORS.index(m)}") for m in B.MEMBERS}, {m: B.CALIBRATORS[m] for m in B.MEMBERS}, weights)


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused scores with made-up states: every 50th row failed, every 40th is cut short, every 30th says so itself, half of those for a region."""
    at = lambda n: F.col("id") % n == n - 1
    told = F.when(at(30), F.array(F.lit("EXIF:Software names Midjourney"))).otherwise(F.array().cast("array<string>"))
    hint = F.when(at(20), F.array(F.lit("EXIF:Artist mentions Krea"))).otherwise(F.array().cast("array<string>"))
    return B.wide(spark, sf_dir).select(
        "id", fused().alias("p"), F.when(at(50), "ImageLoadError: cut").alias("error"), told.alias("ai"), (F.col("id") % 60 == 59).alias("partial"), hint.alias("weak"), at(40).alias("truncated")
    )


def verdict_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.verdict(F.col("p"), F.lit(FPR5), F.lit(LOW), F.col("error"), F.size("ai") > 0, F.col("partial"), F.col("truncated"))
    return judged(spark, sf_dir).select("id", F.round("p", 6).alias("p"), v.alias("verdict"))


def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    no = F.lit(False)
    v = S.verdict(F.col("p"), F.lit(FPR5), F.lit(LOW), F.lit(None).cast("string"), no, no, no)
    return B.wide(spark, sf_dir).select(fused().alias("p")).groupBy(v.alias("verdict")).agg(F.count("*").alias("n"))


def basis_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = S.basis(F.col("p"), F.lit(FPR5), F.lit(LOW), F.col("error"), F.col("ai"), F.col("partial"), F.col("weak"), F.col("truncated"), F.lit(3))
    return judged(spark, sf_dir).select("id", b.alias("basis"))


_JUDGED = f"""{B.SQL_WIDE}, j AS (SELECT id, {B.sql_fused()} AS p, id % 50 = 49 AS bad, id % 30 = 29 AS told, id % 60 = 59 AS part, id % 20 = 19 AS hint, id % 40 = 39 AS cut FROM wide)"""
_PLAIN = f"CASE WHEN p >= {FPR5}::DOUBLE THEN 'AI-GENERATED' WHEN p > {LOW}::DOUBLE THEN 'UNCERTAIN' ELSE 'REAL' END"


def per_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated scores of each row as JSON, members sorted and rounded."""
    names = sorted(B.MEMBERS)
    made = F.array(*[F.concat(F.lit(f'"{m}":'), F.format_string("%.4f", S.platt(F.col(f"d{B.DETECTORS.index(m)}"), *B.CALIBRATORS[m]))) for m in names])
    return B.wide(spark, sf_dir).select("id", F.concat(F.lit("{"), F.array_join(made, ","), F.lit("}")).alias("per_model"))


def score_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.wide(spark, sf_dir).select("id", S.bar(F.round(F.col("d0"), 3)).alias("bar"), S.fmt(F.round(F.col("d0"), 3), 3).alias("shown"))


QUERIES = {
    "verdict_counts": verdict_counts,
    "verdict_rows": verdict_rows,
    "basis_text": basis_text,
    "fuse_weighted": lambda s, d: B.wide(s, d).select("id", F.round(fused(WEIGHTS), 6).alias("p")),
    "fuse_unweighted": lambda s, d: B.wide(s, d).select("id", F.round(S.fuse_unweighted([F.col("d0"), F.col("d1"), F.col("d2")]), 6).alias("p")),
    "platt_apply": lambda s, d: B.wide(s, d).select("id", *[F.round(S.platt(F.col(f"d{k}"), *B.CALIBRATORS[m]), 6).alias(f"p{k}") for k, m in enumerate(B.DETECTORS)]),
    "per_model_json": per_model,
    "operating_point": lambda s, d: s.createDataFrame([("fpr1",), ("none",), ("balanced",)], "asked string").select(
        "asked",
        S.operating_point(F.create_map(*[F.lit(x) for kv in B.THRESHOLDS.items() for x in kv]), F.col("asked")).alias("threshold"),
        S.operating_point(F.create_map(F.lit("fpr9"), F.lit(0.9)), F.col("asked")).alias("bare"),
    ),
    "score_bar": score_bars,
}
ORACLE = {
    "verdict_counts": f"WITH {B.SQL_WIDE}, f AS (SELECT {B.sql_fused()} AS p FROM wide) SELECT {_PLAIN} AS verdict, count(*) AS n FROM f GROUP BY 1",
    "verdict_rows": f"""WITH {_JUDGED} SELECT id, round(p, 6) AS p, CASE WHEN bad THEN 'ERROR' WHEN told AND part THEN 'AI-EDITED' WHEN told THEN 'AI-GENERATED'
  WHEN cut THEN 'UNCERTAIN' ELSE {_PLAIN} END AS verdict FROM j""",
    "basis_text": f"""WITH {_JUDGED} SELECT id, CASE WHEN bad THEN 'ImageLoadError: cut'
  WHEN told THEN 'metadata describes ' || CASE WHEN part THEN 'a generated region in an otherwise real image' ELSE 'the whole image' END || ': EXIF:Software names Midjourney'
  WHEN hint THEN 'pixel ensemble; weak metadata hint (EXIF:Artist mentions Krea)'
  WHEN cut THEN 'file is truncated; the missing part decoded as flat grey, so the score would describe the padding'
  WHEN {_PLAIN} = 'UNCERTAIN' THEN 'pixel ensemble is between the operating points (0.54 < p <= 0.71)'
  ELSE 'pixel ensemble (' || CASE WHEN abs(p - {FPR5}::DOUBLE) < 0.1 THEN 'borderline' WHEN abs(p - {FPR5}::DOUBLE) > 0.3 THEN 'clear' ELSE 'moderate' END || ', 3 models)' END AS basis FROM j""",
    "fuse_weighted": f"WITH {B.SQL_WIDE} SELECT id, round({B.sql_fused(weights=WEIGHTS)}, 6) AS p FROM wide",
    "fuse_unweighted": f"WITH {B.SQL_WIDE} SELECT id, round({B.sql_sigmoid('((' + ' + '.join(B.sql_logit(f'd{k}') for k in range(3)) + ') / 3)')}, 6) AS p FROM wide",
    "platt_apply": f"WITH {B.SQL_WIDE} SELECT id, " + ", ".join(f"round({B.sql_platt(f'd{k}', *B.CALIBRATORS[m])}, 6) AS p{k}" for k, m in enumerate(B.DETECTORS)) + " FROM wide",
    "per_model_json": f"WITH {B.SQL_WIDE} SELECT id, '{{' || " + " || ',' || ".join(f"'\"{m}\":' || printf('%.4f', {B.sql_platt(f'd{B.DETECTORS.index(m)}', *B.CALIBRATORS[m])})" for m in sorted(B.MEMBERS)) + " || '}' AS per_model FROM wide",
    "operating_point": f"SELECT * FROM (VALUES ('fpr1', {B.THRESHOLDS['fpr1']}::DOUBLE, 0.5::DOUBLE), ('none', {FPR5}::DOUBLE, 0.5::DOUBLE), ('balanced', 0.5::DOUBLE, 0.5::DOUBLE)) t(asked, threshold, bare)",
    "score_bar": f"""WITH {B.SQL_WIDE} SELECT id, repeat('#', CAST(round_even(round(d0, 3) * 20, 0) AS INTEGER)) || repeat('.', 20 - CAST(round_even(round(d0, 3) * 20, 0) AS INTEGER)) AS bar,
  printf('%.3f', round(d0, 3)) AS shown FROM wide""",
}
