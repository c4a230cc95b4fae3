"""Queries of vectors, geometry and tables of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from . import bench as B

#: Weights of the probe in the queries: a wave, so that no table of numbers is needed.
PROBE = [round(((7 * i) % 13 - 6) / 5, 1) for i in range(64)]


def tile_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of ten tiles each, averaged by place before the scaling to length 1."""
    tiles = B.bench(spark, sf_dir).select(F.floor(F.col("id") / 10).alias("image"), F.posexplode("embedding").alias("place", "x"))
    means = tiles.groupBy("image", "place").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vectors = means.groupBy("image").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "m"))), lambda t: t["m"]).alias("v"))
    return vectors.select("image", F.round(F.get(S.l2_normalize(F.col("v")), F.lit(3)).cast("double"), 5).alias("x3"), F.round(S.dot(F.col("v"), F.col("v")), 6).alias("norm2"))


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 1500 + 100).cast("int").alias("w"), (F.col("n_chars") % 700 + 150).cast("int").alias("h"))


def boxes(n: int):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = S.crop_origins(F.col("w"), F.col("h"), 224, n)
        return sizes(spark, sf_dir).select("doc_id", F.array_join(F.transform(found, lambda o: F.concat_ws(",", o["x"], o["y"])), "|").alias("origins"))

    return query


def qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = spark.range(1, 101).select(F.col("id").cast("int").alias("q"))
    tables = q.select("q", S.ijg_table(S.IJG_LUMA, F.col("q")).alias("luma"), S.ijg_table(S.IJG_CHROMA, F.col("q")).alias("chroma"))
    found = S.jpeg_quality(F.col("luma"), F.col("chroma"))
    return tables.select("q", found.alias("found")).select("q", F.coalesce(F.col("found.exact") == F.col("q"), F.lit(False)).alias("same"), F.coalesce("found.estimated", F.lit(-1)).alias("estimated"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, "89504E470D0A1A0A00"), (2, "FFD8FFE0"), (3, "52494646000000005745425000"), (4, "0000001866747970"), (5, "49492A00"), (6, "4D4D002A"), (7, "00"), (8, "")]
    return spark.createDataFrame(rows, "id long, h string").select("id", S.sniff(F.unhex("h")).alias("format"))


_W, _H = "(n_chars % 1500 + 100)", "(n_chars % 700 + 150)"


def _boxes_sql(n: int) -> str:
    places = ["(w - 224) // 2 || ',' || (h - 224) // 2", "'0,0'", "(w - 224) || ',0'", "'0,' || (h - 224)", "(w - 224) || ',' || (h - 224)"]
    if n > 5:
        k = int(-(-(n**0.5) // 1))
        step = lambda d, i: f"CAST(round_even(({d} - 224) / {max(k - 1, 1)}::DOUBLE * {i}, 0) AS INTEGER)"
        places += [f"{step('w', i)} || ',' || {step('h', j)}" for j in range(k) for i in range(k)]
    return f"""WITH s AS (SELECT doc_id, {_W} AS w, {_H} AS h FROM documents), l AS (SELECT doc_id, w, h, [{', '.join(places)}] AS o FROM s)
SELECT doc_id, CASE WHEN w >= 224 AND h >= 224 THEN array_to_string(list_filter(o, lambda x, i: list_position(o, x) = i)[1:{n}], '|') ELSE '' END AS origins FROM l"""


def _ijg(base: tuple[int, ...]) -> str:
    scale = "(CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END)"
    return f"array_to_string(list_transform([{', '.join(map(str, base))}], lambda b: least(255, greatest(1, (b * {scale} + 50) // 100))), ',')"


_DOT = " + ".join(f"{w}::DOUBLE * CAST(embedding[{i + 1}] AS DOUBLE)" for i, w in enumerate(PROBE))
QUERIES = {
    "softmax_mass": lambda s, d: B.bench(s, d).select("id", F.round(S.softmax_mass(F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 10), [0, 2], [1]), 6).alias("p")),
    "probe_score": lambda s, d: B.bench(s, d).select("id", F.round(S.probe_score(F.col("embedding"), PROBE, 0.25), 6).alias("p")),
    "l2_normalize": lambda s, d: B.bench(s, d).select("id", F.round(F.get(S.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)), F.lit(5)).cast("double"), 5).alias("x5")),
    "tile_mean": tile_mean,
    "crop_boxes": boxes(5),
    "crop_boxes_grid": boxes(9),
    "matched_size": lambda s, d: sizes(s, d).select("doc_id", S.matched_size(F.col("w"), F.col("h"))["width"].alias("width"), S.matched_size(F.col("w"), F.col("h"))["height"].alias("height")),
    "ijg_tables": lambda s, d: s.range(1, 101).select(F.col("id").alias("q"), F.array_join(S.ijg_table(S.IJG_LUMA, F.col("id")).cast("array<string>"), ",").alias("luma"), F.array_join(S.ijg_table(S.IJG_CHROMA, F.col("id")).cast("array<string>"), ",").alias("chroma")),
    "jpeg_quality": qualities,
    "format_sniff": heads,
}
ORACLE = {
    "softmax_mass": "SELECT vec_id AS id, round((exp(a) + exp(c)) / (exp(a) + exp(b) + exp(c)), 6) AS p FROM (SELECT vec_id, 10 * CAST(embedding[1] AS DOUBLE) AS a, 10 * CAST(embedding[2] AS DOUBLE) AS b, 10 * CAST(embedding[3] AS DOUBLE) AS c FROM embeddings)",
    "probe_score": f"SELECT vec_id AS id, round({B.sql_sigmoid('(' + _DOT + ' + 0.25::DOUBLE)')}, 6) AS p FROM embeddings",
    "l2_normalize": "SELECT vec_id AS id, round(CAST(CAST(3 * CAST(embedding[6] AS DOUBLE) / greatest(sqrt(list_sum(list_transform(embedding, lambda x: 9 * CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 1e-12::DOUBLE) AS FLOAT) AS DOUBLE), 5) AS x5 FROM embeddings",
    "tile_mean": """WITH t AS (SELECT vec_id // 10 AS image, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS place FROM embeddings),
m AS (SELECT image, place, avg(CAST(x AS DOUBLE)) AS m FROM t GROUP BY 1, 2), n AS (SELECT image, sum(m * m) AS n2 FROM m GROUP BY image)
SELECT m.image, round(CAST(CAST(m / greatest(sqrt(n2), 1e-12::DOUBLE) AS FLOAT) AS DOUBLE), 5) AS x3, round(n2, 6) AS norm2 FROM m JOIN n ON m.image = n.image WHERE place = 4""",
    "crop_boxes": _boxes_sql(5),
    "crop_boxes_grid": _boxes_sql(9),
    "matched_size": f"""WITH s AS (SELECT doc_id, {_W} AS w, {_H} AS h FROM documents), c AS (SELECT *, least(1::DOUBLE, 512 / greatest(w, h)) AS k FROM s)
SELECT doc_id, CAST(greatest(1, round_even(w * k, 0)) AS INTEGER) AS width, CAST(greatest(1, round_even(h * k, 0)) AS INTEGER) AS height FROM c""",
    "ijg_tables": f"SELECT q, {_ijg(S.IJG_LUMA)} AS luma, {_ijg(S.IJG_CHROMA)} AS chroma FROM (SELECT unnest(generate_series(1, 100)) AS q)",
    "format_sniff": "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, '{f}')" for i, f in enumerate(('PNG', 'JPEG', 'WEBP', 'BMFF', 'TIFF', 'TIFF', '', ''), 1)) + ") t(id, format)",
}


def _ijg_list(base: tuple[int, ...], q: str) -> str:
    scale = f"(CASE WHEN {q} < 50 THEN 5000 // {q} ELSE 200 - 2 * {q} END)"
    return f"list_transform([{', '.join(map(str, base))}], lambda b: least(255, greatest(1, (b * {scale} + 50) // 100)))"


_LUMA = f"[{', '.join(map(str, S.IJG_LUMA))}]"
_ERR = lambda a, b: f"list_sum(list_transform(list_zip({a}, {b}), lambda p: abs(p[1] - p[2])))"
ORACLE["jpeg_quality"] = f"""WITH t AS (SELECT q, {_ijg_list(S.IJG_LUMA, 'q')} AS luma, {_ijg_list(S.IJG_CHROMA, 'q')} AS chroma FROM (SELECT unnest(generate_series(1, 100)) AS q)),
s AS (SELECT *, list_sort(list_transform(list_filter(list_zip(luma, {_LUMA}), lambda p: p[1] > 1 AND p[1] < 255), lambda p: (100.0::DOUBLE * p[1] - 50) / p[2])) AS scales FROM t),
g AS (SELECT *, scales[len(scales) // 2 + 1] AS m FROM s),
c AS (SELECT *, least(100, greatest(1, CAST(round_even(CASE WHEN m > 100 THEN 5000 / m ELSE (200 - m) / 2 END, 0) AS INTEGER) + d)) AS guess FROM g, (VALUES (-1), (0), (1)) v(d) WHERE m IS NOT NULL),
e AS (SELECT q, guess, {_ERR('luma', _ijg_list(S.IJG_LUMA, 'guess'))} + {_ERR('chroma', _ijg_list(S.IJG_CHROMA, 'guess'))} AS err FROM c),
b AS (SELECT q, guess, err, row_number() OVER (PARTITION BY q ORDER BY err, guess) AS rn FROM e)
SELECT CAST(t.q AS INTEGER) AS q, coalesce(CASE WHEN list_max(t.luma) = 1 THEN CASE WHEN list_max(t.chroma) = 1 THEN 100 = t.q END WHEN err = 0 THEN guess = t.q END, false) AS same,
  coalesce(CASE WHEN list_max(t.luma) = 1 THEN 100 ELSE guess END, -1) AS estimated FROM t LEFT JOIN b ON t.q = b.q AND rn = 1"""
