"""Readers and writers of manifests, scores, features, models and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("id", "track", "label", "source", "generator", "native", "matched", "crop", "format")]
    + [T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("sha256", T.StringType())]
)
GROUPS = "label int, model string, real_source string, path string"
SHARD = "image struct<bytes: binary, path: string>"


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV with y: 1 for the label `ai`, else 0."""
    return spark.read.schema(MANIFEST).csv(path, header=True).select("*", (F.col("label") == "ai").cast("int").alias("y"))


def write_manifest(rows: DataFrame, path: str) -> None:
    rows.select(*MANIFEST.names).write.mode("overwrite").csv(path, header=True)


def write_scores(scores: DataFrame, path: str) -> None:
    """(id, detector, protocol, score) appended, a folder for each protocol and detector; a non-finite score is an error."""
    bad = F.isnan("score") | (F.abs(F.col("score")) == float("inf"))
    checked = scores.select("*", F.when(bad, F.raise_error(F.concat(F.lit("score isn't finite: "), F.col("id").cast("string")))).alias("__e"))
    checked.where("__e IS NULL").drop("__e").write.mode("append").partitionBy("protocol", "detector").parquet(path)


def read_scores(spark: SparkSession, path: str, protocol: str | None = None) -> DataFrame:
    """The long table; a protocol prunes folders."""
    table = spark.read.parquet(path)
    return table if protocol is None else table.where(F.col("protocol") == protocol)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """(id, score) of an earlier run; empty if there is none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "id string, score double")
    return spark.read.parquet(path).select("id", "score")


def read_shard_images(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """(stem, content) of the first `limit` images of a Parquet shard that have bytes; only those are read."""
    stem = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    held = spark.read.parquet(path).select(F.col("image.bytes").alias("content")).where(F.length("content") > 0).limit(limit)
    numbered = held.select("content", F.monotonically_increasing_id().alias("__i"))  # one partition after the limit: 0, 1, 2, ...
    return numbered.select(F.concat(F.lit(f"{stem}_"), F.lpad(F.col("__i").cast("string"), 5, "0")).alias("stem"), "content")


def group_sources(groups: DataFrame) -> DataFrame:
    """(track, name, label, generator, kind, paths): a source for each generator, and for each real origin.

    A real row's model names its pair, not its origin, so it groups by
    real_source; slashes in model names become dashes.
    """
    ai = F.col("label") == 1
    key = F.when(ai, F.replace(F.coalesce(F.nullif(F.col("model"), F.lit("")), F.lit("unknown")), F.lit("/"), F.lit("-"))).otherwise(
        F.concat(F.lit("src-"), F.coalesce(F.nullif(F.col("real_source"), F.lit("")), F.lit("unknown")))
    )
    found = groups.select(F.when(ai, "ai").otherwise("real").alias("label"), key.alias("key"), "path").groupBy("label", "key").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return found.select(
        F.lit("cf").alias("track"),
        F.concat(F.lit("cf_"), F.col("label"), F.lit("_"), F.col("key")).alias("name"),
        "label",
        F.concat(F.when(F.col("label") == "ai", "cf:").otherwise("camera:"), F.col("key")).alias("generator"),
        F.lit("files").alias("kind"),
        "paths",
    )


# The static sources; locations are below the folder of raw files.
BASE_SOURCES = (
    ("local", "coco", "real", "camera:coco-val2017", "dir", "coco/val2017"),
    ("local", "div2k", "real", "camera:div2k-hr", "dir", "div2k"),
    ("local", "openimages", "real", "camera:open-images-v7", "parquet", "parquet/openimages.parquet"),
    ("local", "midjourney", "ai", "midjourney-v4", "dir", "midjourney"),
    ("local", "flux_dev", "ai", "flux.1-dev", "dir", "flux_dev"),
    ("local", "flux_schnell", "ai", "flux.1-schnell", "dir", "flux_schnell"),
    ("local", "sdxl", "ai", "sdxl-base-1.0", "parquet", "parquet/sdxl.parquet"),
    ("local", "nanobanana", "ai", "nano-banana", "parquet", "parquet/nanobanana.parquet"),
    ("local", "genimage_mj", "ai", "midjourney-genimage", "parquet", "parquet/genimage_mj.parquet"),
)


def all_sources(spark: SparkSession, groups: DataFrame) -> DataFrame:
    """The static sources, then those of groups, which have files of their own and so no location."""
    base = spark.createDataFrame(list(BASE_SOURCES), "track string, name string, label string, generator string, kind string, location string")
    return base.unionByName(group_sources(groups).drop("paths"), allowMissingColumns=True)


def write_report(rows: DataFrame, path: str, title: str = "Benchmark report", digits: int = 3) -> str:
    """A small result as a Markdown table: written by Spark, and returned.  Missing figures are dashes."""
    names = rows.columns
    lines = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)]
    for r in rows.collect():
        cells = ["-" if v is None or v != v else f"{v:.{digits}f}" if isinstance(v, float) else str(v) for v in r]
        lines.append("| " + " | ".join(cells) + " |")
    text = "\n".join(lines) + "\n"
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def write_json(rows: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """A line of JSON for each row, missing values included as null."""
    picked = rows.select(*(columns or rows.columns))
    picked.select(F.to_json(F.struct(*picked.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
