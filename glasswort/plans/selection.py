"""Queries of folds, fits, ensembles and samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calibrate as C
from ..operators import evaluation as E
from ..operators import reports as R
from ..operators import sampling as P
from . import bench as B
from .evaluation import rounded


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.logo_folds(B.bench(spark, sf_dir).drop("embedding"))


def folded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, y, generator, track, fold, detector, score)."""
    return B.scores(spark, sf_dir).join(folded(spark, sf_dir).select("id", "fold"), "id")


def loo_fused_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = folded_scores(spark, sf_dir)
    pooled = C.fuse_rows(C.oof_log_odds(scored, C.fold_calibrators(scored)), B.MEMBERS)
    return rounded(E.ranking(pooled).select("n_ai", "n_real", "auroc", "ap"), 5)


def greedy_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = folded_scores(spark, sf_dir)
    history = C.greedy_select(C.oof_log_odds(scored, C.fold_calibrators(scored)), B.DETECTORS)
    return spark.createDataFrame([(i, m, round(a, 6)) for i, (m, a) in enumerate(history)], "step long, member string, auroc double")


def ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = folded_scores(spark, sf_dir)
    return rounded(C.ablation(scored, B.MEMBERS, C.fold_calibrators(scored)).select(F.col("n").cast("long").alias("n"), "calibrated", "auroc"), 5)


def cross_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = B.scores(spark, sf_dir)
    both = [C.cross_track(scored, B.MEMBERS, a, b).select("fit", "test", "n", "tp", "fp", "tn", "fn", "threshold", "auroc") for a, b in (("cf", "local"), ("local", "cf"))]
    return rounded(both[0].unionByName(both[1]), 5)


def probe_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = C.probe_fit(B.bench(spark, sf_dir))
    return spark.createDataFrame([(i, round(w, 4)) for i, w in enumerate([*probe.weights, probe.bias])], "place long, weight double")


def train_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, _ = C.train_fusion(B.scores(spark, sf_dir), B.MEMBERS)
    rows = [("threshold", k, round(v, 5)) for k, v in model.thresholds.items()]
    rows += [(c, m, round(model.calibrators[m][i], 5)) for m in model.members for i, c in enumerate("ab")]
    return spark.createDataFrame(rows, "kind string, name string, value double")


def fusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole training report as a line of JSON."""
    scored = B.scores(spark, sf_dir).join(folded(spark, sf_dir).select("id", "fold"), "id")
    _, report = R.fusion_report(scored, B.DETECTORS)
    return spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "report string")


def source_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("size"))


_FOLDS = """k AS (SELECT count(DISTINCT generator) AS k FROM bench WHERE y = 1),
names AS (SELECT generator AS fold, row_number() OVER (ORDER BY generator) AS i FROM (SELECT DISTINCT generator FROM bench WHERE y = 1)),
nr AS (SELECT count(*) AS n, (SELECT k FROM k) AS k FROM bench WHERE y = 0),
dealt AS (SELECT id, row_number() OVER (ORDER BY md5(id || '-seed'), id) - 1 AS r FROM bench WHERE y = 0),
place AS (SELECT id, CASE WHEN r < (n % k) * (n // k + 1) THEN r // (n // k + 1) ELSE n % k + (r - (n % k) * (n // k + 1)) // greatest(n // k, 1) END + 1 AS i FROM dealt, nr),
folds AS (SELECT id, generator AS fold FROM bench WHERE y = 1 UNION ALL SELECT id, fold FROM place JOIN names USING (i))"""
_FSCORES = f"{B.SQL_SCORES}, {_FOLDS}, fs AS (SELECT s.*, f.fold FROM scores s JOIN folds f USING (id))"


def sql_newton(source: str, keys: str, name: str = "fit") -> str:
    """CTEs ending in `name`: (keys, a, b) fitted by twelve Newton steps."""
    cols = [k.strip() for k in keys.split(",")]
    k = ", ".join(cols)
    nk, on = ", ".join(f"n.{c}" for c in cols), " AND ".join(f"n.{c} = t.{c}" for c in cols)
    p = f"{name}_p"
    return f"""{name}_t AS MATERIALIZED (SELECT {k}, {B.sql_logit('score')} AS x, CAST(y AS DOUBLE) AS yy FROM {source}),
{name}_n(step, {k}, a, b) AS (
  SELECT 0, {k}, 0::DOUBLE, 0::DOUBLE FROM (SELECT DISTINCT {k} FROM {name}_t)
  UNION ALL
  SELECT step + 1, {k}, a - ((a + gx) * hbb - gb * hab) / ((1 + haa) * hbb - hab * hab), b - (gb * (1 + haa) - (a + gx) * hab) / ((1 + haa) * hbb - hab * hab)
  FROM (SELECT step, {k}, a, b, sum((p - yy) * x) AS gx, sum(p - yy) AS gb, sum(p * (1 - p) * x * x) AS haa, sum(p * (1 - p) * x) AS hab, sum(p * (1 - p)) AS hbb
    FROM (SELECT n.step, {nk}, n.a, n.b, t.x, t.yy, 1 / (1 + exp(-(n.a * t.x + n.b))) AS p FROM {name}_n n JOIN {name}_t t ON {on} WHERE n.step < 12) AS {p}
    GROUP BY step, {k}, a, b)),
{name} AS (SELECT {k}, a, b FROM {name}_n WHERE step = 12)"""


_TRAIN = "tr AS (SELECT o.fold AS train_fold, s.detector, s.score, s.y FROM fs s, (SELECT DISTINCT fold FROM folds) o WHERE s.fold <> o.fold)"
_OOF = f"""{_FSCORES}, {_TRAIN}, {sql_newton('tr', 'train_fold, detector')},
z AS (SELECT s.id, s.y, s.detector, {B.sql_logit(B.sql_platt('s.score', 'f.a', 'f.b').replace('::DOUBLE * ', ' * ').replace('f.b::DOUBLE', 'f.b'))} AS z FROM fs s JOIN fit f ON s.fold = f.train_fold AND s.detector = f.detector)"""
_MEMBERS = ", ".join(f"'{m}'" for m in B.MEMBERS)
_POOLED = f"pooled AS (SELECT id, y, {B.sql_sigmoid('avg(z)')} AS score FROM z WHERE detector IN ({_MEMBERS}) GROUP BY id, y)"


def _cross(fit: str, test: str) -> str:
    z = B.sql_logit(B.sql_platt("s.score", "f.a", "f.b").replace("::DOUBLE * ", " * ").replace("f.b::DOUBLE", "f.b"))
    return f"""SELECT * FROM (WITH RECURSIVE {B.SQL_SCORES}, tr AS (SELECT * FROM scores WHERE track = '{fit}'), {sql_newton('tr', 'detector')},
fu AS (SELECT id, y, track, {B.sql_sigmoid('avg(z)')} AS score FROM (SELECT s.id, s.y, s.track, {z} AS z FROM scores s JOIN fit f ON s.detector = f.detector WHERE s.detector IN ({_MEMBERS})) GROUP BY id, y, track),
th AS (SELECT score AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score DESC) AS rn, count(*) OVER () AS n FROM fu WHERE track = '{fit}' AND y = 0) WHERE rn = CAST(floor(0.05::DOUBLE * n) AS BIGINT)),
he AS (SELECT * FROM fu WHERE track = '{test}'), {B.sql_ranking('he')}
SELECT '{fit}' AS fit, '{test}' AS test, count(*) AS n, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp,
  count(*) FILTER (score < threshold AND y = 0) AS tn, count(*) FILTER (score < threshold AND y = 1) AS fn, round(max(threshold), 5) AS threshold, round((SELECT auroc FROM ranked), 5) AS auroc FROM he, th)"""


def _ablation_sql() -> str:
    parts = []
    for i in range(1, len(B.MEMBERS) + 1):
        some = ", ".join(f"'{m}'" for m in B.MEMBERS[:i])
        for name, value in (("yes", "z"), ("no", B.sql_logit("score"))):
            source = "z" if name == "yes" else "fs"
            parts.append(
                f"SELECT * FROM (WITH fu AS (SELECT id, y, {B.sql_sigmoid(f'avg({value})')} AS score FROM {source} WHERE detector IN ({some}) GROUP BY id, y), {B.sql_ranking('fu')} "
                f"SELECT {i}::BIGINT AS n, '{name}' AS calibrated, round(auroc, 5) AS auroc FROM ranked)"
            )
    return f"WITH RECURSIVE {_OOF} " + " UNION ALL ".join(parts)


_REMAINDER = """SELECT {keys}source, size, take FROM (
  SELECT *, f + CASE WHEN row_number() OVER ({part}ORDER BY q - f DESC, source) <= b - sum(f) OVER ({whole}) THEN 1 ELSE 0 END AS take FROM (
    SELECT *, CAST(floor(q) AS BIGINT) AS f FROM (SELECT *, CAST(b AS DOUBLE) * size / sum(size) OVER ({whole}) AS q FROM sizes))) WHERE take > 0"""

QUERIES = {
    "logo_fold_sizes": lambda s, d: folded(s, d).groupBy("fold").agg(F.count_if(F.col("y") == 1).alias("n_ai"), F.count_if(F.col("y") == 0).alias("n_real")),
    "logo_fold_rows": lambda s, d: folded(s, d).select("id", "fold"),
    "logo_train_counts": lambda s, d: C.folded_training(folded(s, d), sorted(r[0] for r in folded(s, d).select("fold").distinct().collect())).groupBy("train_fold").agg(F.count("*").alias("n"), F.sum("y").alias("n_ai")),
    "platt_fit": lambda s, d: rounded(C.platt_fit(B.scores(s, d), ["detector"]), 5),
    "platt_fit_folds": lambda s, d: rounded(C.fold_calibrators(folded_scores(s, d)), 5),
    "loo_fused_auroc": loo_fused_auroc,
    "ablation": ablation,
    "cross_track": cross_track,
    "greedy_select": greedy_select,
    "probe_fit": probe_fit,
    "train_fusion": train_fusion,
    "fusion_report": fusion_report,
    "largest_remainder": lambda s, d: P.allocate(source_sizes(s, d), "source", "size", F.lit(97)),
    "stratified_subset": lambda s, d: P.stratified_subset(B.bench(s, d).select("id", "y", "source"), 120),
    "dedup_first": lambda s, d: P.dedup_by_content(B.table(s, d, "documents").select("doc_id", "text"), "text", ["doc_id"]).select("doc_id", "digest"),
    "benchmark_admission": lambda s, d: P.admit(
        B.table(s, d, "documents").select(
            F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("source_pos"),
            F.col("doc_id").alias("item_pos"),
            F.left(F.sha2("text", 256), F.lit(16)).alias("digest"),
            (F.col("n_chars") % 900).cast("int").alias("width"),
            (F.col("n_chars") % 700).cast("int").alias("height"),
            F.lit(1).alias("n_frames"),
        ).withColumn("item_pos", F.floor(F.col("item_pos") / 20)),
        10,
    ).select("source_pos", "item_pos", "digest"),
}
ORACLE = {
    "logo_fold_sizes": f"WITH {B.SQL_BENCH}, {_FOLDS} SELECT fold, count(*) FILTER (y = 1) AS n_ai, count(*) FILTER (y = 0) AS n_real FROM folds JOIN bench USING (id) GROUP BY fold",
    "logo_fold_rows": f"WITH {B.SQL_BENCH}, {_FOLDS} SELECT id, fold FROM folds",
    "logo_train_counts": f"WITH {B.SQL_BENCH}, {_FOLDS}, o AS (SELECT DISTINCT fold AS train_fold FROM folds) SELECT train_fold, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_ai FROM folds JOIN bench USING (id), o WHERE fold <> train_fold GROUP BY train_fold",
    "platt_fit": f"WITH RECURSIVE {B.SQL_SCORES}, {sql_newton('scores', 'detector')} SELECT detector, round(a, 5) AS a, round(b, 5) AS b FROM fit",
    "platt_fit_folds": f"WITH RECURSIVE {_FSCORES}, {_TRAIN}, {sql_newton('tr', 'train_fold, detector')} SELECT train_fold, detector, round(a, 5) AS a, round(b, 5) AS b FROM fit",
    "loo_fused_auroc": f"WITH RECURSIVE {_OOF}, {_POOLED}, {B.sql_ranking('pooled')} SELECT n_ai, n_real, round(auroc, 5) AS auroc, round(ap, 5) AS ap FROM ranked",
    "ablation": _ablation_sql(),
    "cross_track": _cross("cf", "local") + " UNION ALL " + _cross("local", "cf"),
    "largest_remainder": "WITH sizes AS (SELECT source, count(*) AS size, 97::BIGINT AS b FROM documents GROUP BY source) " + _REMAINDER.format(keys="", part="", whole=""),
    "stratified_subset": f"""WITH {B.SQL_BENCH}, sizes AS (SELECT y, source, count(*) AS size, 60::BIGINT AS b FROM bench GROUP BY y, source),
t AS ({_REMAINDER.format(keys='y, ', part='PARTITION BY y ', whole='PARTITION BY y')}),
r AS (SELECT id, y, source, row_number() OVER (PARTITION BY y, source ORDER BY md5(id || '-seed'), id) AS rn FROM bench)
SELECT id, r.y, r.source FROM r JOIN t ON r.y = t.y AND r.source = t.source WHERE rn <= take""",
    "train_fusion": f"""WITH RECURSIVE {B.SQL_SCORES}, tr AS (SELECT * FROM scores WHERE detector IN ({_MEMBERS})), {sql_newton('tr', 'detector')},
fu AS (SELECT id, y, {B.sql_sigmoid('avg(z)')} AS score FROM (SELECT s.id, s.y, {B.sql_logit(B.sql_platt('s.score', 'f.a', 'f.b').replace('::DOUBLE * ', ' * ').replace('f.b::DOUBLE', 'f.b'))} AS z FROM tr s JOIN fit f ON s.detector = f.detector) GROUP BY id, y),
rk AS (SELECT y, score, row_number() OVER (PARTITION BY y ORDER BY score DESC) AS rn, count(*) OVER (PARTITION BY y) AS n FROM fu)
SELECT 'threshold' AS kind, p.name, round(score, 5) AS value FROM rk, (VALUES ('fpr1', 0.01::DOUBLE), ('fpr5', 0.05::DOUBLE), ('fpr10', 0.1::DOUBLE)) p(name, target) WHERE y = 0 AND rn = CAST(floor(target * n) AS BIGINT)
UNION ALL SELECT 'threshold', 'abstain_low', round(score, 5) FROM rk WHERE y = 1 AND rn = least(greatest(CAST(ceil(0.98::DOUBLE * n) AS BIGINT), 1), n)
UNION ALL SELECT 'threshold', 'balanced', 0.5::DOUBLE UNION ALL SELECT 'a', detector, round(a, 5) FROM fit UNION ALL SELECT 'b', detector, round(b, 5) FROM fit""",
    "dedup_first": "SELECT min(doc_id) AS doc_id, left(sha256(text), 16) AS digest FROM documents GROUP BY text",
}
