"""Files as rows: listings, ordered inputs, and contents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of image files.
SUFFIXES = (".jpg", ".jpeg", ".jpe", ".jfif", ".png", ".webp", ".bmp", ".tif", ".tiff", ".gif", ".ppm", ".pgm", ".avif", ".heic", ".heif")


def has_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1)).isin(*SUFFIXES)


def image_files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """binaryFile rows of a folder's image files; contents are read only where they are selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).where(has_suffix(F.col("path")))


def expand(spark: SparkSession, inputs: Sequence[str], recursive: bool = True) -> DataFrame:
    """(ordinal, path): folders become their image files in order of path, other inputs stay as they are, repeats included."""
    fs_of = lambda p: p.getFileSystem(spark._jsc.hadoopConfiguration())
    parts, plain = [], []
    for i, name in enumerate(inputs):
        p = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = fs_of(p)
        if fs.exists(p) and fs.getFileStatus(p).isDirectory():
            parts.append(image_files(spark, name, recursive).select(F.lit(i).cast("long").alias("__input"), "path"))
        else:
            plain.append((i, name))
    listed = spark.createDataFrame(plain, "__input long, path string")
    for part in parts:
        listed = listed.unionByName(part)
    # listings are short: one name a file, sorted on the driver's order of inputs
    paths = [tuple(r) for r in listed.orderBy("__input", "path").collect()]
    return spark.createDataFrame([(n, p) for n, (_, p) in enumerate(paths)], "ordinal long, path string")


def contents(spark: SparkSession, listed: DataFrame) -> DataFrame:
    """(ordinal, path, content, error): a row for each listed path, in any order; error for what can't be read.

    The same file may be listed twice; it is read once.
    """
    names = [r[0] for r in listed.select("path").distinct().collect()]
    fs = lambda name: spark._jvm.org.apache.hadoop.fs.Path(name)
    there = {}
    for name in names:
        p = fs(name)
        system = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if system.exists(p) and not system.getFileStatus(p).isDirectory():
            there[name] = system.makeQualified(p).toString()
    found = spark.createDataFrame([(n, q) for n, q in there.items()], "path string, __uri string")
    if there:
        held = spark.read.format("binaryFile").load(list(there.values())).select(F.col("path").alias("__uri"), "content")
        found = found.join(held, F.regexp_replace(found["__uri"], "^file:/+", "/") == F.regexp_replace(held["__uri"], "^file:/+", "/"), "left").select("path", "content")
    else:
        found = found.select("path", F.lit(None).cast("binary").alias("content"))
    joined = listed.join(found, "path", "left")
    error = F.when(F.col("content").isNull(), F.concat(F.lit("no such file: "), F.col("path"))).when(F.length("content") == 0, F.concat(F.lit("empty file: "), F.col("path")))
    return joined.select("ordinal", "path", "content", error.alias("error"))


def sample_items(items: DataFrame, limit: int, seed: str = "seed", shuffle: bool = True) -> DataFrame:
    """The first `limit` items in the order of a hash of their path, or of pos."""
    order = [F.md5(F.concat(F.col("path"), F.lit(f"-{seed}"))), F.col("path")] if shuffle else [F.col("pos")]
    return items.orderBy(*order).limit(limit)
