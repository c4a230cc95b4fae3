"""What the operators share: word rules, the shared folder, materialised tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that end a word: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: Rows of a written table of keys (a few tens of bytes each) that may be broadcast; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 500_000
#: Files of a small written table for each core.
FILES = 4
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a local folder serves if driver and
    executors are one process (master local); on a cluster that is an error,
    as other machines could not read what one of them wrote.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="glasswort-")
        atexit.register(shutil.rmtree, named.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, so any store that Spark reaches works."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: Folders of the steps that are open in scratch().
_open: list[list[str]] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared one; it goes when the session's JVM ends, or with the scratch() around it."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    fs, p = hadoop_path(spark, path)
    fs.deleteOnExit(p)
    if _open:
        _open[-1].append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes what materialize() writes inside, but for the paths appended to the list it yields."""
    kept: list[str] = []
    _open.append([])
    try:
        yield kept
    finally:
        made = _open.pop()
        for path in made:
            if path not in kept:
                drop_path(spark, path)
        if _open:
            _open[-1].extend(p for p in made if p in kept)


def drop_path(spark: SparkSession, path: str) -> None:
    fs, p = hadoop_path(spark, path)
    fs.delete(p, True)


def materialize(df: DataFrame, label: str, large: bool = False, kept: list[str] | None = None) -> DataFrame:
    """df written as Parquet to the shared folder and read again.

    Cuts the lineage with files that outlive any executor, runs df once for
    all later readers, and gives the optimizer the table's real size, so
    small tables are broadcast by Spark's own threshold.  Tables of keys,
    labels and the like come in at most FILES files a core, so that many
    shuffle partitions don't make as many tiny files; `large` ones (texts, or
    rows for every line or run) keep their partitions.  `kept` is what a
    scratch() yields: the table outlives it.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = fresh_path(spark, label)
    if kept is not None:
        kept.append(path)
    out = df if large else df.coalesce(FILES * spark.sparkContext.defaultParallelism)
    out.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._written = path
    return found


def discard(table: DataFrame) -> None:
    """Removes a table of materialize() that nothing reads any more, before the scratch() around it ends."""
    drop_path(table.sparkSession, table._written)


def few(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """table with a hint to broadcast it, if its count allows; for tables that are cheap to count."""
    return F.broadcast(table) if table.count() <= rows else table


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, nothing else; lower() is faster and the same where all is ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def wide_hash(*cols: Column) -> tuple[Column, Column]:
    """Two xxhash64 of different seeds: 128 bits."""
    return F.xxhash64(*cols), F.xxhash64(F.lit(0x5EED), *cols)


#: Rows of a batch between Spark and Python.  Spark's own 10,000 make batches of tens of MB of text, held
#: by both sides of every running task.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def schema_of(table: DataFrame, keep: list[str], made: str) -> T.StructType:
    """The kept columns' fields, then those of a DDL string."""
    return T.StructType([*(table.schema[c] for c in keep), *T.StructType.fromDDL(made).fields])


def dealt(table: DataFrame) -> DataFrame:
    """table dealt out anew if it has fewer partitions than there are cores: a small file is often one row group."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table._jdf.queryExecution().toRdd().getNumPartitions() >= cores else table.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return dealt(spark.read.parquet(f"{sf_dir}/documents.parquet"))
