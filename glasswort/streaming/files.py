"""The same operators on streams of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.provenance import provenance
from ..sources.files import has_suffix

BINARY = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Image files as they arrive in a folder and its subfolders."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true")
    return reader.load(folder).where(has_suffix(F.col("path")))


def provenance_stream(files: DataFrame) -> DataFrame:
    """Metadata verdicts; stateless, so late files need no rule."""
    return provenance(files.select("path", "modificationTime", "content"))


def first_contents(files: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Files whose bytes didn't occur within the watermark before; the state is bounded by it."""
    digested = files.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", lateness)
    return digested.dropDuplicatesWithinWatermark(["digest"])


def verdict_counts_stream(verdicts: DataFrame, width: str = "10 minutes", lateness: str = "1 hour") -> DataFrame:
    """Counts by window of arrival and by what metadata says."""
    windowed = verdicts.withWatermark("modificationTime", lateness).groupBy(F.window("modificationTime", width), "says_ai")
    return windowed.agg(F.count("*").alias("n"))
