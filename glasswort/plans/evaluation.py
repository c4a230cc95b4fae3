"""Queries of evaluation: rates, rankings, thresholds, groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import evaluation as E
from . import bench as B


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so summation order doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_DET = ["detector"]
#: Degradations of scores, as (slope, shift) of their log-odds.
DEGRADED = {"clean": (1.0, 0.0), "jpeg30": (0.6, -0.7), "blur_1": (0.8, 0.3)}


def degraded(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("degradation"), S.sigmoid(a * S.logit(F.col("score")) + b).alias("dscore")) for n, (a, b) in DEGRADED.items()]))
    return B.scores(spark, sf_dir).select("id", "y", "detector", each.alias("e")).select("id", "y", "detector", "e.degradation", F.col("e.dscore").alias("score"))


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(E.report(B.protocol_scores(spark, sf_dir), 0.2).select("detector", "protocol", "n", "auroc", "ap", "balanced_accuracy", "tpr", "fpr"))


QUERIES = {
    "confusion": lambda s, d: rounded(E.confusion(B.scores(s, d), 0.2, _DET)),
    "metrics_at_threshold": lambda s, d: rounded(E.confusion(B.toxicity(s, d), 0.5)),
    "auroc": lambda s, d: rounded(E.ranking(B.toxicity(s, d)).select("n_ai", "n_real", "auroc")),
    "average_precision": lambda s, d: rounded(E.ranking(B.toxicity(s, d), ["lang"]).select("lang", "ap")),
    "auroc_by_detector": lambda s, d: rounded(E.ranking(B.scores(s, d), _DET).select("detector", "auroc")),
    "auroc_at_scale": lambda s, d: rounded(E.ranking(B.returns(s, d), ["status"]).select("status", "n_ai", "n_real", "auroc", "ap")),
    "auroc_distinct_scores": lambda s, d: rounded(E.ranking(B.returns(s, d), [], "price_score").select("auroc", "ap")),
    "threshold_fpr": lambda s, d: rounded(E.threshold_at_fpr(B.scores(s, d), 0.05, _DET), 9),
    "threshold_fpr_zero": lambda s, d: E.threshold_at_fpr(B.toxicity(s, d), 0.0).select((F.col("threshold") > 0.5).alias("above"), F.round("threshold", 9).alias("threshold")),
    "threshold_tpr": lambda s, d: rounded(E.threshold_at_tpr(B.scores(s, d), 0.98, _DET), 9),
    "operating_points": lambda s, d: rounded(E.operating_points(B.scores(s, d), _DET), 9),
    "wilson_by_generator": lambda s, d: rounded(E.recall_by(B.scores(s, d).where("detector = 'clip-probe'"), 0.2, "generator")),
    "recall_by_generator": lambda s, d: rounded(E.recall_by(B.scores(s, d), 0.3, "generator").select("generator", "n", F.col("share").alias("recall"))),
    "fp_by_source": lambda s, d: rounded(E.recall_by(B.scores(s, d), 0.3, "source", 0).select("source", "n", F.col("hits").alias("fp"), F.col("share").alias("rate"))),
    "score_means": lambda s, d: rounded(E.score_means(B.scores(s, d), _DET)),
    "degradation_delta": lambda s, d: rounded(E.degradation_drops(degraded(s, d), 0.2)),
    "protocol_pivot": lambda s, d: rounded(E.protocol_gaps(E.ranking(B.protocol_scores(s, d), ["detector", "protocol"]))),
    "report_lines": report_lines,
    "brier": lambda s, d: rounded(E.brier(B.scores(s, d), _DET)),
    "leaderboard": lambda s, d: rounded(E.ranking(B.protocol_scores(s, d).where("protocol = 'crop'"), _DET).select("detector", "auroc").orderBy(F.desc("auroc"), F.desc("detector"))),
    "best_detector": lambda s, d: E.ranking(B.protocol_scores(s, d).where("protocol = 'crop'"), _DET).agg(F.max(F.struct("auroc", "detector"))["detector"].alias("detector")),
    "group_counts": lambda s, d: B.bench(s, d).groupBy("track").agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("n_real"), F.count_distinct(F.when(F.col("y") == 1, F.col("generator"))).alias("generators")),
}

_RATES = """n, n_ai, n_real, tp, fp, tn, fn, round((tp + tn) / n, 6) AS accuracy, round(tp / greatest(tp + fn, 1), 6) AS tpr, round(fp / greatest(fp + tn, 1), 6) AS fpr,
  round(tp / greatest(tp + fp, 1), 6) AS precision, round(0.5::DOUBLE * (tp / greatest(tp + fn, 1) + 1 - fp / greatest(fp + tn, 1)), 6) AS balanced_accuracy"""


def _counts(source: str, threshold: float, by: str = "") -> str:
    keys, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    hit = f"score >= {threshold}::DOUBLE"
    return f"""c AS (SELECT {keys}count(*) AS n, count(*) FILTER (y = 1) AS n_ai, count(*) FILTER (y = 0) AS n_real, count(*) FILTER ({hit} AND y = 1) AS tp,
  count(*) FILTER ({hit} AND y = 0) AS fp, count(*) FILTER (NOT {hit} AND y = 0) AS tn, count(*) FILTER (NOT {hit} AND y = 1) AS fn FROM {source} {group})"""


def _kth(cls: int, k: str) -> str:
    return f"""SELECT detector, round(score, 9) AS threshold FROM (SELECT detector, score, row_number() OVER (PARTITION BY detector ORDER BY score DESC) AS rn,
  count(*) OVER (PARTITION BY detector) AS n FROM scores WHERE y = {cls}) WHERE rn = {k}"""


_FPR = lambda t: _kth(0, f"CAST(floor({t}::DOUBLE * n) AS BIGINT)")
_TPR = _kth(1, "least(greatest(CAST(ceil(0.98::DOUBLE * n) AS BIGINT), 1), n)")
_Z = 1.96
_MID = f"(p + {_Z * _Z}::DOUBLE / (2 * n)) / (1 + {_Z * _Z}::DOUBLE / n)"
_WIDTH = f"{_Z}::DOUBLE * sqrt(p * (1 - p) / n + {_Z * _Z}::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + {_Z * _Z}::DOUBLE / n)"
_SCORE = "score"
_DEGRADED_SQL = " UNION ALL ".join(f"SELECT id, y, detector, '{n}' AS degradation, {B.sql_sigmoid(f'({a}::DOUBLE * {B.sql_logit(_SCORE)} + {b}::DOUBLE)')} AS score FROM scores" for n, (a, b) in DEGRADED.items())
ORACLE = {
    "confusion": f"WITH {B.SQL_SCORES}, {_counts('scores', 0.2, 'detector')} SELECT detector, {_RATES} FROM c",
    "metrics_at_threshold": f"WITH {B.SQL_TOXICITY}, {_counts('tox', 0.5)} SELECT {_RATES} FROM c",
    "auroc": f"WITH {B.SQL_TOXICITY}, {B.sql_ranking('tox')} SELECT n_ai, n_real, round(auroc, 6) AS auroc FROM ranked",
    "average_precision": f"WITH {B.SQL_TOXICITY}, {B.sql_ranking('tox', 'lang')} SELECT lang, round(ap, 6) AS ap FROM ranked",
    "auroc_by_detector": f"WITH {B.SQL_SCORES}, {B.sql_ranking('scores', 'detector')} SELECT detector, round(auroc, 6) AS auroc FROM ranked",
    "auroc_at_scale": f"""WITH r AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_linestatus AS status, l_discount * 10 AS score FROM lineitem),
{B.sql_ranking('r', 'status')} SELECT status, n_ai, n_real, round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM ranked""",
    "auroc_distinct_scores": f"""WITH r AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, l_extendedprice / 1e5::DOUBLE AS score FROM lineitem),
{B.sql_ranking('r')} SELECT round(auroc, 6) AS auroc, round(ap, 6) AS ap FROM ranked""",
    "threshold_fpr": f"WITH {B.SQL_SCORES} {_FPR(0.05)}",
    "threshold_fpr_zero": f"WITH {B.SQL_TOXICITY} SELECT nextafter(max(score), 1::DOUBLE) > 0.5 AS above, round(nextafter(max(score), 1::DOUBLE), 9) AS threshold FROM tox WHERE y = 0",
    "threshold_tpr": f"WITH {B.SQL_SCORES} {_TPR}",
    "operating_points": f"WITH {B.SQL_SCORES} "
    + " UNION ALL ".join(f"SELECT detector, '{n}' AS point, threshold FROM ({_FPR(t)})" for n, t in E.FPR_POINTS.items())
    + f" UNION ALL SELECT detector, 'abstain_low' AS point, threshold FROM ({_TPR}) UNION ALL SELECT DISTINCT detector, 'balanced' AS point, 0.5::DOUBLE AS threshold FROM scores",
    "wilson_by_generator": f"""WITH {B.SQL_SCORES}, g AS (SELECT generator, count(*) AS n, count(*) FILTER (score >= 0.2::DOUBLE) AS hits, count(*) FILTER (score >= 0.2::DOUBLE) / count(*) AS p
  FROM scores WHERE y = 1 AND detector = 'clip-probe' GROUP BY generator)
SELECT generator, n, hits, round(p, 6) AS share, round(greatest(0, {_MID} - {_WIDTH}), 6) AS low, round(least(1, {_MID} + {_WIDTH}), 6) AS high FROM g""",
    "recall_by_generator": f"WITH {B.SQL_SCORES} SELECT generator, count(*) AS n, round(avg(CAST(score >= 0.3::DOUBLE AS DOUBLE)), 6) AS recall FROM scores WHERE y = 1 GROUP BY generator",
    "fp_by_source": f"WITH {B.SQL_SCORES} SELECT source, count(*) AS n, count(*) FILTER (score >= 0.3::DOUBLE) AS fp, round(avg(CAST(score >= 0.3::DOUBLE AS DOUBLE)), 6) AS rate FROM scores WHERE y = 0 GROUP BY source",
    "score_means": f"WITH {B.SQL_SCORES} SELECT detector, round(avg(score), 6) AS mean, round(avg(score) FILTER (y = 1), 6) AS mean_ai, round(avg(score) FILTER (y = 0), 6) AS mean_real FROM scores GROUP BY detector",
    "degradation_delta": f"""WITH {B.SQL_SCORES}, dg AS ({_DEGRADED_SQL}), {B.sql_ranking('dg', 'detector, degradation')},
m AS (SELECT detector, degradation, count(*) FILTER (score >= 0.2::DOUBLE AND y = 1) / count(*) FILTER (y = 1) AS tpr, count(*) FILTER (score >= 0.2::DOUBLE AND y = 0) / count(*) FILTER (y = 0) AS fpr,
  avg(score) AS mean, avg(score) FILTER (y = 1) AS mean_ai, avg(score) FILTER (y = 0) AS mean_real FROM dg GROUP BY 1, 2),
a AS (SELECT m.*, r.auroc FROM m JOIN ranked r USING (detector, degradation))
SELECT a.detector, a.degradation, round(a.auroc, 6) AS auroc, round(a.tpr, 6) AS tpr, round(a.fpr, 6) AS fpr, round(a.mean, 6) AS mean, round(a.mean_ai, 6) AS mean_ai, round(a.mean_real, 6) AS mean_real,
  round(c.auroc - a.auroc, 6) AS auroc_drop, round(c.tpr - a.tpr, 6) AS tpr_drop FROM a JOIN a c ON a.detector = c.detector AND c.degradation = 'clean'""",
    "protocol_pivot": f"""WITH {B.SQL_PROTOCOLS}, {B.sql_ranking('scores', 'detector, protocol')},
p AS (SELECT detector, max(auroc) FILTER (protocol = 'native') AS native, max(auroc) FILTER (protocol = 'matched') AS matched, max(auroc) FILTER (protocol = 'crop') AS crop FROM ranked GROUP BY detector)
SELECT detector, round(native, 6) AS native, round(matched, 6) AS matched, round(crop, 6) AS crop, round(native - matched, 6) AS container_gap, round(matched - crop, 6) AS context_gap FROM p""",
    "report_lines": f"""WITH {B.SQL_PROTOCOLS}, {B.sql_ranking('scores', 'detector, protocol')}, {_counts('scores', 0.2, 'detector, protocol')}
SELECT detector, protocol, n, round(auroc, 6) AS auroc, round(ap, 6) AS ap, round(0.5::DOUBLE * (tp / greatest(tp + fn, 1) + 1 - fp / greatest(fp + tn, 1)), 6) AS balanced_accuracy,
  round(tp / greatest(tp + fn, 1), 6) AS tpr, round(fp / greatest(fp + tn, 1), 6) AS fpr FROM c JOIN ranked USING (detector, protocol) WHERE n >= 20""",
    "brier": f"WITH {B.SQL_SCORES} SELECT detector, round(avg((score - y) * (score - y)), 6) AS brier FROM scores GROUP BY detector",
    "leaderboard": f"WITH {B.SQL_PROTOCOLS}, {B.sql_ranking('scores', 'detector, protocol')} SELECT detector, round(auroc, 6) AS auroc FROM ranked WHERE protocol = 'crop' ORDER BY auroc DESC, detector DESC",
    "best_detector": f"WITH {B.SQL_PROTOCOLS}, {B.sql_ranking('scores', 'detector, protocol')} SELECT detector FROM ranked WHERE protocol = 'crop' ORDER BY auroc DESC, detector DESC LIMIT 1",
    "group_counts": f"WITH {B.SQL_BENCH} SELECT track, count(*) AS n, count(*) FILTER (y = 0) AS n_real, count(DISTINCT generator) FILTER (y = 1) AS generators FROM bench GROUP BY track",
}
