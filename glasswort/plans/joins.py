"""Queries of alignment, label resolution and requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import align as A
from ..operators.scoring import DETECTORS, default_detectors, detector_table
from ..sources.tables import BASE_SOURCES, all_sources, group_sources
from . import bench as B


def gappy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores with gaps: haywoodsloan lacks every 7th id; organika-sdxl has some twice, and a NaN here and there."""
    s = B.scores(spark, sf_dir).select("id", "detector", "score", F.lit(0).alias("pos"))
    s = s.where(~((F.col("detector") == "haywoodsloan") & (F.col("id") % 7 == 0)))
    twice = s.where((F.col("detector") == "organika-sdxl") & (F.col("id") % 11 == 0)).select("id", "detector", F.lit(0.25).alias("score"), F.lit(1).alias("pos"))
    nan = F.when((F.col("detector") == "organika-sdxl") & (F.col("id") % 13 == 0) & (F.col("pos") == 0), float("nan")).otherwise(F.col("score"))
    return s.unionByName(twice).select("id", "detector", nan.alias("score"), "pos")


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.align_scores(B.bench(spark, sf_dir).select("id", "y"), gappy(spark, sf_dir))


# Label maps of classifiers, as (model, id, label), and the words wanted for each side.
LABELS = (
    ("plain", 0, "artificial"), ("plain", 1, "human"), ("upper", 0, "Human"), ("upper", 1, " AI-generated "),
    ("three", 0, "dalle"), ("three", 1, "real"), ("three", 2, "sd"), ("near", 0, "Realism"), ("near", 1, "Deepfake"),
    ("lost", 0, "cat"), ("lost", 1, "dog"), ("same", 0, "real ai"), ("same", 1, "other"),
)
WANTED = (
    ("plain", "ai", "artificial"), ("plain", "real", "human"), ("upper", "ai", "ai-generated"), ("upper", "real", "human"),
    ("three", "ai", "dalle"), ("three", "ai", "sd"), ("three", "real", "real"), ("near", "ai", "fake"), ("near", "real", "real"),
    ("lost", "ai", "artificial"), ("lost", "real", "human"), ("same", "ai", "ai"), ("same", "real", "real"),
)


def resolved(spark: SparkSession) -> DataFrame:
    return A.resolve_labels(spark.createDataFrame(list(LABELS), "model string, id long, label string"), spark.createDataFrame(list(WANTED), "model string, side string, word string"))


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a listing: a model with a slash, a real source, and gaps."""
    d = B.table(spark, sf_dir, "documents")
    return d.select(
        (F.col("doc_id") % 2).cast("int").alias("label"),
        F.when(F.col("doc_id") % 5 > 0, F.concat(F.col("lang"), F.lit("/"), F.col("source"))).alias("model"),
        F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("real_source"),
        F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("path"),
    )


_UPLOADS = (
    ("a", "1.png", 10), ("a", "2.png", 20), ("b", None, None), ("c", "big.png", 41), ("d", "empty.png", 0), ("d", "x.png", 3), *(("e", f"{i}.png", 1) for i in range(17)),
)


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(list(_UPLOADS), "request string, name string, n int")
    return A.check_uploads(files.select("request", "name", F.repeat(F.lit("x"), F.col("n")).cast("binary").alias("content")), most=16, largest=40)


def _values(rows, names: str) -> str:
    quote = lambda v: "NULL" if v is None else f"{v}::BIGINT" if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(quote(v) for v in r) + ')' for r in rows)}) t({names})"


_GAPPY = f"""{B.SQL_SCORES}, g AS (
  SELECT id, detector, CASE WHEN detector = 'organika-sdxl' AND id % 11 = 0 THEN 0.25::DOUBLE WHEN detector = 'organika-sdxl' AND id % 13 = 0 THEN NULL ELSE score END AS score
  FROM scores WHERE NOT (detector = 'haywoodsloan' AND id % 7 = 0)),
al AS (SELECT b.id, b.y, d.detector, g.score FROM bench b CROSS JOIN (SELECT DISTINCT detector FROM g) d LEFT JOIN g ON g.id = b.id AND g.detector = d.detector)"""
_RESOLVED = f"""h AS (SELECT model, id, lower(trim(label)) AS label FROM {_values(LABELS, 'model, id, label')}), w AS (SELECT model, side, lower(word) AS word FROM {_values(WANTED, 'model, side, word')}),
m AS (SELECT h.model, side, id, label = word AS same FROM h JOIN w ON h.model = w.model AND (contains(label, word) OR contains(word, label))),
r AS (SELECT model, side, list_sort(list_distinct(coalesce(list(id) FILTER (same), list(id)))) AS ids FROM m GROUP BY model, side)"""

QUERIES = {
    "left_align_scores": lambda s, d: aligned(s, d).select("id", "detector", F.round("score", 6).alias("score")),
    "complete_columns": lambda s, d: A.complete(aligned(s, d)).groupBy("detector").agg(F.count("*").alias("n")),
    "feature_join": lambda s, d: A.with_features(B.bench(s, d).select("id"), B.bench(s, d).select("id", F.col("embedding").alias("features"), F.lit("vit").alias("backbone")), "vit").select("id", F.size("features").cast("long").alias("dim")),
    "anti_cached": lambda s, d: A.to_do(B.bench(s, d).select("id", "generator"), B.scores(s, d).where("detector = 'clip-probe' AND id % 3 = 0")),
    "members_missing": lambda s, d: A.missing(s.createDataFrame([(0, "commforensics384"), (1, "nyuad"), (2, "clip-probe"), (3, "smogy")], "pos long, detector string"), B.scores(s, d)),
    "label_resolution": lambda s, d: resolved(s).select("model", "side", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")),
    "label_polarity": lambda s, d: A.polarity_errors(resolved(s)),
    "group_sources": lambda s, d: group_sources(groups(s, d)).select("track", "name", "label", "generator", "kind", F.size("paths").cast("long").alias("n"), F.element_at("paths", 1).alias("first")),
    "source_union": lambda s, d: all_sources(s, groups(s, d)),
    "subset_protocols": lambda s, d: B.protocol_scores(s, d).where("NOT (detector = 'haywoodsloan' AND protocol = 'crop')").groupBy("detector").agg(F.collect_set("protocol").alias("p")).where(F.size(F.array_except(F.array(*[F.lit(p) for p in B.PROTOCOLS]), "p")) == 0).select("detector"),
    "upload_limits": uploads,
    "default_detectors": lambda s, d: default_detectors(s).select("pos", "name"),
    "noncommercial_detectors": lambda s, d: detector_table(s).where(F.contains("license", F.lit("-nc"))).select("name", "license"),
}
ORACLE = {
    "left_align_scores": f"WITH {_GAPPY} SELECT id, detector, round(score, 6) AS score FROM al",
    "complete_columns": f"WITH {_GAPPY} SELECT detector, count(*) AS n FROM al GROUP BY detector HAVING count(*) = count(score)",
    "feature_join": "SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS dim FROM embeddings",
    "anti_cached": f"WITH {B.SQL_BENCH} SELECT id, generator FROM bench WHERE id % 3 <> 0",
    "members_missing": "SELECT * FROM (VALUES (1::BIGINT, 'nyuad'), (3::BIGINT, 'smogy')) t(pos, detector)",
    "label_resolution": f"WITH {_RESOLVED} SELECT model, side, array_to_string(ids, ',') AS ids FROM r",
    "label_polarity": f"""WITH {_RESOLVED}, s AS (SELECT model, max(ids) FILTER (side = 'ai') AS a, max(ids) FILTER (side = 'real') AS b FROM r GROUP BY model)
SELECT model, CASE WHEN a IS NULL OR b IS NULL THEN 'labels can''t be mapped' ELSE 'label sets overlap' END AS error FROM s WHERE a IS NULL OR b IS NULL OR list_has_any(a, b)""",
    "group_sources": """WITH g AS (SELECT CASE WHEN doc_id % 2 = 1 THEN 'ai' ELSE 'real' END AS label,
  CASE WHEN doc_id % 2 = 1 THEN CASE WHEN doc_id % 5 > 0 THEN lang || '-' || source ELSE 'unknown' END ELSE 'src-' || CASE WHEN doc_id % 3 > 0 THEN lang ELSE 'unknown' END END AS key, 'p' || doc_id AS path FROM documents)
SELECT 'cf' AS track, 'cf_' || label || '_' || key AS name, label, CASE WHEN label = 'ai' THEN 'cf:' ELSE 'camera:' END || key AS generator, 'files' AS kind, count(*) AS n, min(path) AS first FROM g GROUP BY label, key""",
    "subset_protocols": f"WITH {B.SQL_PROTOCOLS} SELECT detector FROM scores WHERE NOT (detector = 'haywoodsloan' AND protocol = 'crop') GROUP BY detector HAVING count(DISTINCT protocol) = 3",
    "upload_limits": f"""WITH f AS (SELECT request, name, n FROM {_values(_UPLOADS, 'request, name, n')}),
g AS (SELECT request, count(name) AS files, coalesce(max(n), 0) AS most, count(*) FILTER (name IS NOT NULL AND n = 0) AS nothing FROM f GROUP BY request)
SELECT request, files, CASE WHEN files = 0 THEN 400 WHEN files > 16 OR most > 40 THEN 413 WHEN nothing > 0 THEN 400 ELSE 200 END AS status,
  CASE WHEN files = 0 THEN 'no files' WHEN files > 16 THEN 'too many files' WHEN most > 40 THEN 'file too large' WHEN nothing > 0 THEN 'empty file' END AS problem FROM g""",
}
ORACLE["source_union"] = f"SELECT * FROM {_values(BASE_SOURCES, 'track, name, label, generator, kind, location')} UNION ALL SELECT track, name, label, generator, kind, NULL FROM ({ORACLE['group_sources']})"
_SPECS = f"(SELECT * FROM {_values([(i, d.name, d.license, int(d.general_purpose)) for i, d in enumerate(DETECTORS.values())], 'pos, name, license, general')})"
ORACLE["default_detectors"] = f"SELECT pos, name FROM {_SPECS} WHERE general = 1"
ORACLE["noncommercial_detectors"] = f"SELECT name, license FROM {_SPECS} WHERE contains(license, '-nc')"
