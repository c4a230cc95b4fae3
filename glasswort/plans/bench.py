"""Evaluation tables that stand on the driver's tables, for Spark and, as SQL, for DuckDB.

`embeddings` plays the cached features: label 3 and above is generated, each
label a generator, and the first components give detectors' raw scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import sigmoid

# Published calibrators (a, b) and operating points.
CALIBRATORS = {
    "commforensics384": (0.476334451164735, 3.5334653494494375),
    "haywoodsloan": (0.3523083957497153, 1.9089088646013481),
    "clip-probe": (1.449219085766425, 1.2189045220586423),
    "organika-sdxl": (0.15898301630217943, 1.3381631988760947),
}
THRESHOLDS = {"fpr1": 0.815121562553877, "fpr5": 0.7115239744244183, "fpr10": 0.6439323890779922, "balanced": 0.5, "abstain_low": 0.5437693116611861}
DETECTORS = tuple(CALIBRATORS)
MEMBERS = DETECTORS[:3]
#: Shift of the component that a protocol's scores read.
PROTOCOLS = {"native": 0, "matched": 4, "crop": 8}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, generator, source, track, embedding)."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("label") >= 3).cast("int").alias("y"),
        F.concat(F.lit("g"), F.col("label").cast("string")).alias("generator"),
        F.concat(F.lit("s"), (F.col("vec_id") % 5).cast("string")).alias("source"),
        F.when(F.col("vec_id") % 2 == 1, "cf").otherwise("local").alias("track"),
        "embedding",
    )


def raw(k: int) -> Column:
    return sigmoid(24 * F.get("embedding", F.lit(k)).cast("double") - 2)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bench with d0 to d3, a raw score a detector."""
    return bench(spark, sf_dir).select("*", *[raw(k).alias(f"d{k}") for k in range(len(DETECTORS))])


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, generator, source, track, detector, score)."""
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), raw(k).alias("score")) for k, d in enumerate(DETECTORS)]))
    return bench(spark, sf_dir).select("id", "y", "generator", "source", "track", each.alias("s")).select("id", "y", "generator", "source", "track", "s.*")


def protocol_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, detector, protocol, score)."""
    pairs = [(d, p, k + shift) for k, d in enumerate(DETECTORS) for p, shift in PROTOCOLS.items()]
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("detector"), F.lit(p).alias("protocol"), raw(k).alias("score")) for d, p, k in pairs]))
    return bench(spark, sf_dir).select("id", "y", each.alias("s")).select("id", "y", "s.*")


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels with documents, a second manifest: (id, y, source, lang, score); scores tie."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = table(spark, sf_dir, "labels").select("doc_id", "toxic").join(docs, "doc_id")
    score = 1 / (1 + F.exp(-(F.col("n_chars").cast("double") - 1000) / 500))
    return joined.select(F.col("doc_id").alias("id"), F.col("toxic").alias("y"), "source", "lang", score.alias("score"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a scale workload: (y, flag, score); few distinct scores, all tied."""
    return table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_linestatus").alias("status"), (F.col("l_discount") * 10).alias("score"), (F.col("l_extendedprice") / 1e5).alias("price_score"))


def _sql_raw(k: int) -> str:
    return f"(1 / (1 + exp(-(24 * CAST(embedding[{k + 1}] AS DOUBLE) - 2))))"


SQL_BENCH = """bench AS (
  SELECT vec_id AS id, CAST(label >= 3 AS INTEGER) AS y, 'g' || label AS generator, 's' || (vec_id % 5) AS source,
    CASE WHEN vec_id % 2 = 1 THEN 'cf' ELSE 'local' END AS track, embedding FROM embeddings)"""
SQL_WIDE = SQL_BENCH + ",\nwide AS (SELECT *, " + ", ".join(f"{_sql_raw(k)} AS d{k}" for k in range(len(DETECTORS))) + " FROM bench)"
SQL_SCORES = SQL_BENCH + ",\nscores AS (" + " UNION ALL ".join(f"SELECT id, y, generator, source, track, '{d}' AS detector, {_sql_raw(k)} AS score FROM bench" for k, d in enumerate(DETECTORS)) + ")"
SQL_PROTOCOLS = (
    SQL_BENCH
    + ",\nscores AS ("
    + " UNION ALL ".join(f"SELECT id, y, '{d}' AS detector, '{p}' AS protocol, {_sql_raw(k + s)} AS score FROM bench" for k, d in enumerate(DETECTORS) for p, s in PROTOCOLS.items())
    + ")"
)
SQL_TOXICITY = """tox AS (
  SELECT l.doc_id AS id, l.toxic AS y, d.source, d.lang, 1 / (1 + exp(-(CAST(d.n_chars AS DOUBLE) - 1000) / 500)) AS score
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def sql_logit(p: str) -> str:
    return f"ln(least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE) / (1 - least(greatest({p}, 1e-6::DOUBLE), 1 - 1e-6::DOUBLE)))"


def sql_sigmoid(z: str) -> str:
    return f"(1 / (1 + exp(-least(greatest({z}, -60::DOUBLE), 60::DOUBLE))))"


def sql_platt(p: str, a: float | str, b: float | str) -> str:
    return sql_sigmoid(f"({a}::DOUBLE * {sql_logit(p)} + {b}::DOUBLE)")


def sql_fused(members: tuple[str, ...] = MEMBERS, weights: dict[str, float] | None = None) -> str:
    weights = {m: (weights or {}).get(m, 1.0) for m in members}
    terms = " + ".join(f"{weights[m]}::DOUBLE * {sql_logit(sql_platt(f'd{DETECTORS.index(m)}', *CALIBRATORS[m]))}" for m in members)
    return sql_sigmoid(f"(({terms}) / {sum(weights.values())}::DOUBLE)")


def sql_ranking(source: str, by: str = "", score: str = "score") -> str:
    """CTEs ending in `ranked`: (by, n_ai, n_real, auroc, ap)."""
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""grp AS (SELECT {keys}{score} AS s, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY {keys}{score}),
run AS (SELECT *, coalesce(sum(pos) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_before,
  coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_before, sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n
  FROM grp WINDOW w AS ({part}ORDER BY s)),
ranked AS (SELECT {keys}CAST(max(p) AS BIGINT) AS n_ai, CAST(max(n) AS BIGINT) AS n_real,
  CASE WHEN max(p) > 0 AND max(n) > 0 THEN CAST(sum(pos * (neg_before + neg / 2.0)) AS DOUBLE) / CAST(max(p) * max(n) AS DOUBLE) END AS auroc,
  CASE WHEN max(p) > 0 AND max(n) > 0 THEN sum(CAST(pos AS DOUBLE) * CAST(p - pos_before AS DOUBLE) / CAST(p - pos_before + n - neg_before AS DOUBLE)) / CAST(max(p) AS DOUBLE) END AS ap
  FROM run {group})"""
