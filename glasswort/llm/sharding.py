"""Sharding by size-tiered compaction under a versioned manifest.

A store is a folder of immutable Parquet shards and of manifests, one a
version, that list the shards alive.  An arrival is appended as small
shards.  Compaction groups runs of similar size (a tier spans a factor of
FANOUT) and merges a tier that has FANOUT runs or more into files of up to
the target size, moving partitions together without a shuffle.

A version is committed by giving its finished manifest a name that must not
exist yet, by an operation that the store does at once and refuses if the
name is taken: a hard link on a local or mounted file system, a rename on
HDFS.  Readers see the old version or the new one, whatever fails, and of
two writers one retries on the other's version.  Stores without such an
operation (object stores, whose rename copies) are refused unless the
caller brings one as `claim`.

expire() removes old versions and what only they name, and may run beside
writers; vacuum() removes files that no version names once they are older
than any writer's run.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, few, fresh_path, hadoop_path

TARGET = 128 << 20
FANOUT = 4
#: Arrivals of the query, and rows of a shard as it arrives.
ARRIVALS, ARRIVAL_ROWS = 4, 5000
#: How often a writer tries to commit, and the seconds that it waits at most before each further try.
TRIES, WAIT = 50, 2.0
#: Seconds after which a file that no version names can't belong to a writer at work.
ORPHAN_AGE = 7 * 24 * 3600


class Conflict(RuntimeError):
    """Another writer took the version."""


@dataclass(frozen=True)
class Shard:
    file: str
    size: int
    level: int


def _link(spark: SparkSession, aside: str, final: str) -> bool:
    """A hard link, which the system makes at once or not at all."""
    jvm = spark._jvm
    paths = [jvm.java.io.File(hadoop_path(spark, p)[1].toUri().getPath()).toPath() for p in (final, aside)]
    try:
        jvm.java.nio.file.Files.createLink(*paths)
    except Exception as e:  # noqa: BLE001 - py4j wraps the JVM's exception
        if "FileAlreadyExistsException" in str(getattr(e, "java_exception", e)):
            return False
        raise
    return True


def _rename(spark: SparkSession, aside: str, final: str) -> bool:
    """HDFS's rename, one transaction of the name node that refuses an existing target."""
    fs, p = hadoop_path(spark, aside)
    return fs.rename(p, hadoop_path(spark, final)[1])


#: By scheme: what gives a file a free name, or returns False if it is taken.
CLAIMS: dict[str, Callable[[SparkSession, str, str], bool]] = {"file": _link, "hdfs": _rename}


class ShardStore:
    """Shards and versions below root.  claim(spark, file, name) gives a file a free name; by default CLAIMS has it for root's scheme."""

    def __init__(self, spark: SparkSession, root: str, schema=None, target: int = TARGET, fanout: int = FANOUT, claim: Callable | None = None):
        if target < 1 or fanout < 2:
            raise ValueError("target must be positive and fanout at least 2")
        fs, p = hadoop_path(spark, root.rstrip("/"))
        fs.mkdirs(p)
        self.root = fs.resolvePath(p).toString()
        scheme = self.root.partition(":")[0]
        if claim is None and scheme not in CLAIMS:
            raise ValueError(f"no operation known by which {scheme} gives a file a free name at once; pass claim")
        self.spark, self.schema, self.target, self.fanout, self.claim = spark, schema, target, fanout, claim or CLAIMS[scheme]

    # manifests

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/{version:010d}.json"

    def versions(self) -> list[int]:
        fs, p = hadoop_path(self.spark, f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[:10]) for n in names if n.endswith(".json") and not n.startswith((".", "_")))

    def load(self, version: int | None = None) -> dict:
        """A version's manifest; without one, the last; of an empty store, version 0 without shards."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        if version == 0:
            return {"version": 0, "shards": [], "arrivals": []}
        fs, p = hadoop_path(self.spark, self._manifest(version))
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, old: dict, shards: list[Shard], arrivals: list[str]) -> dict:
        """The version after `old`.  Written aside and then given a name that must be free."""
        new = {"version": old["version"] + 1, "shards": [vars(s) for s in shards], "arrivals": arrivals}
        fs, aside = hadoop_path(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = fs.create(aside, False)
        try:
            stream.write(bytearray(json.dumps(new).encode()))
        finally:
            stream.close()
        won = self.claim(self.spark, aside.toString(), self._manifest(new["version"]))
        fs.delete(aside, False)  # the link's other name, or what lost
        if not won:
            raise Conflict(f"version {new['version']} exists")
        return new

    # shards

    def _listed(self, folder: str, level: int) -> list[Shard]:
        fs, p = hadoop_path(self.spark, f"{self.root}/{folder}")
        files = sorted((s.getPath().getName(), s.getLen()) for s in fs.listStatus(p)) if fs.exists(p) else []
        return [Shard(f"{folder}/{name}", size, level) for name, size in files if name.endswith(".parquet")]

    def _write(self, df: DataFrame, rows: int | None, level: int) -> list[Shard]:
        """df as shards of a folder of their own; nothing refers to them until a commit does."""
        folder = f"data/{uuid.uuid4().hex}"
        writer = df.write.option("maxRecordsPerFile", rows) if rows else df.write
        writer.parquet(f"{self.root}/{folder}")
        return self._listed(folder, level)

    def _retry(self, change: Callable[[dict], dict]) -> dict:
        for left in range(TRIES, 0, -1):
            old = self.load()
            try:
                return change(old)
            except Conflict:
                if left == 1:
                    raise
                time.sleep(random.uniform(0, min(WAIT, 0.01 * 2 ** (TRIES - left))))
        raise AssertionError

    def add(self, made: list[Shard], arrival: str) -> dict:
        """The version with the shards of an arrival; one that a version already has is not added again."""

        def change(old: dict) -> dict:
            if arrival in old["arrivals"]:
                return old
            return self.commit(old, [*(Shard(**s) for s in old["shards"]), *made], [*old["arrivals"], arrival])

        return self._retry(change)

    def append(self, df: DataFrame, arrival: str, rows: int = ARRIVAL_ROWS) -> dict:
        """The version with df's shards."""
        if self.schema is None:
            self.schema = df.schema
        now = self.load()
        return now if arrival in now["arrivals"] else self.add(self._write(df, rows, 0), arrival)

    def stage(self, df: DataFrame, batch: Column, batches: int, rows: int = ARRIVAL_ROWS) -> list[list[Shard]]:
        """Shards of each of several arrivals, written in one pass over df; batch says which, from 0.  add() makes them visible."""
        folder = f"data/{uuid.uuid4().hex}"
        name = "__batch_" + uuid.uuid4().hex[:8]
        df.withColumn(name, batch).write.partitionBy(name).option("maxRecordsPerFile", rows).parquet(f"{self.root}/{folder}")
        return [self._listed(f"{folder}/{name}={b}", 0) for b in range(batches)]

    def tier(self, size: int) -> int:
        return int(math.log(max(size, 1), self.fanout))

    def due(self, shards: list[Shard]) -> list[list[Shard]]:
        """Tiers to merge: of shards under the target, those of fanout or more."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target:
                tiers.setdefault(self.tier(s.size), []).append(s)
        return [t for _, t in sorted(tiers.items()) if len(t) >= self.fanout]

    def read(self, shards: list[Shard]) -> DataFrame:
        if not shards:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema) if self.schema is not None else self.spark.read
        return reader.parquet(*[f"{self.root}/{s.file}" for s in shards])

    def compact(self) -> dict:
        """Merges, from the smallest tier up, until no tier is due; one version a merge.

        Shards that another writer removed meanwhile make the merge void.
        """
        while True:
            old = self.load()
            due = self.due([Shard(**s) for s in old["shards"]])
            if not due:
                return old
            runs = due[0]
            files = max(1, math.ceil(sum(s.size for s in runs) / self.target))
            merged = self._write(self.read(runs).coalesce(files), None, max(s.level for s in runs) + 1)
            gone = {s.file for s in runs}

            def change(now: dict, gone=gone, merged=merged) -> dict:
                alive = [Shard(**s) for s in now["shards"]]
                if not gone <= {s.file for s in alive}:
                    return now
                return self.commit(now, [*(s for s in alive if s.file not in gone), *merged], now["arrivals"])

            if self._retry(change)["version"] > old["version"] and len(merged) >= len(runs):
                return self.load()  # compression left nothing to gain

    def expire(self, keep: int = 1) -> int:
        """Removes all versions but the last `keep`, and the shards that only those named; returns how many files went.

        Files that no version names are left alone, so writers may be at
        work.  Reads of a version that goes fail, and so does a merge of
        shards that another writer has merged meanwhile.
        """
        known = self.versions()
        old = [self.load(v) for v in known[:-keep]]
        alive = {s["file"] for v in known[-keep:] for s in self.load(v)["shards"]}
        dead = {s["file"] for m in old for s in m["shards"]} - alive
        removed = 0
        for name in sorted(dead) + [f"manifests/{m['version']:010d}.json" for m in old]:
            fs, p = hadoop_path(self.spark, f"{self.root}/{name}")
            removed += fs.delete(p, False)
        return removed

    def vacuum(self, age: float = ORPHAN_AGE) -> int:
        """Removes shards that no version names and that are `age` seconds old; returns how many files went.

        age must exceed the time from a writer's first file to its commit.
        """
        alive = {s["file"] for v in self.versions() for s in self.load(v)["shards"]}
        fs, p = hadoop_path(self.spark, f"{self.root}/data")
        before, removed = (time.time() - age) * 1000, 0
        files = fs.listFiles(p, True) if fs.exists(p) else None
        while files is not None and files.hasNext():
            status = files.next()
            name = status.getPath().toString().removeprefix(self.root).lstrip("/")
            if name.endswith(".parquet") and name not in alive and status.getModificationTime() <= before:
                removed += fs.delete(status.getPath(), False)
        return removed

    def snapshot(self, version: int | None = None) -> DataFrame:
        """The rows of a version, with __shard, its file below the root."""
        shards = [Shard(**s) for s in self.load(version)["shards"]]
        if not shards:
            return self.read([]).select("*", F.lit(None).cast("string").alias("__shard"))
        return self.read(shards).select("*", F.regexp_extract(F.col("_metadata.file_path"), r"(data/[0-9a-f]{32}/(?:__batch_[^/]+/)?[^/]+)$", 1).alias("__shard"))


def shard_documents(docs: DataFrame, root: str, id_col: str = "doc_id", arrivals: int = ARRIVALS, target: int = TARGET, fanout: int = FANOUT) -> ShardStore:
    """A store of docs: in `arrivals` batches by a hash of the id, appended one by one and compacted after each.

    docs is read once.  Rows are kept as they are, nulls, repeats, empty and
    very long texts and extra columns included; rows without an id come in
    one batch.  An empty table makes a version without shards.
    """
    store = ShardStore(docs.sparkSession, root, docs.schema, target, fanout)
    staged = store.stage(docs, F.pmod(F.xxhash64(F.col(id_col)), F.lit(arrivals)).cast("int"), arrivals)
    for batch, made in enumerate(staged):
        store.add(made, f"batch-{batch}")
        store.compact()
        store.expire()
    return store


def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text_sha256, n_chars, shard, shard_bytes, shard_level, version) of every row as the store gives it back.

    A null text has a null text_sha256 and n_chars.
    """
    store = shard_documents(documents(spark, sf_dir), fresh_path(spark, "shards"))
    now = store.load()
    names = {s["file"]: i for i, s in enumerate(now["shards"])}
    listed = [(s["file"], names[s["file"]], s["size"], s["level"]) for s in now["shards"]]
    table = spark.createDataFrame(listed, "__file string, shard long, shard_bytes long, shard_level long")
    rows = store.snapshot().select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").cast("long").alias("n_chars"), "__shard")
    found = rows.join(few(table), F.col("__shard") == F.col("__file"))
    return found.select("doc_id", "text_sha256", "n_chars", "shard", "shard_bytes", "shard_level", F.lit(now["version"]).cast("long").alias("version"))


QUERIES = {"op3_shards": op3_shards}
ORACLE: dict = {}
