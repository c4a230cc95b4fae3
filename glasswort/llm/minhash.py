"""Near-duplicate detection by HyperMinHash.

Each document's set of word shingles gets a sketch of buckets; a bucket
keeps, of the least hash that it saw, the count of leading zeros and
MANTISSA bits behind them.  Bands of ROWS registers are hashed to keys;
documents that share a key are candidates.  There are as many bands as keep
the chance to miss a pair of the threshold below MISSED.  Candidates pass if the Jaccard
index that their registers estimate, corrected for registers that agree by
chance, may reach the threshold, and are then confirmed on full sets.

Every bucket sees the whole set under a hash of its own: dealing the
elements out over the buckets instead leaves most buckets of a short text
empty, and their bands would tie unrelated short texts together.

No stage holds a band's group in one task or lists all its pairs.  Equal
word sequences are one node, told apart by 128 bits of BLAKE2b of the words.  In each group the node that shares the most with others
is the centre, and each member is tested against it; links so confirmed
make components.  What may be missing then are links between different
components of one group.  Those pairs are listed only where sizes and
unshared shingles leave a link possible: a shingle that no other open
member has can be in no intersection, which settles most edited copies of
one text without comparing them to each other, and where FINE one-bit
registers agree often enough.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, few, materialize, scratch, wide_hash
from ._shingles import shingle_sets, shingles_exact, words_exact

PERCENT = 85
ROWS, MANTISSA = 5, 10
#: Chance that a pair of just the threshold shares no band.
MISSED = 1e-6
#: Estimates so many standard deviations below the threshold end a candidate.
DEVIATIONS = 6
#: One-bit registers of the members that are left in a group of several components.
FINE = 2048
#: Members of one key that one task compares with as many others.
BLOCK = 2000
_U = np.uint64
_rng = np.random.default_rng(21)
_FINE_FACTORS = _rng.integers(0, 1 << 64, FINE, np.uint64) | _U(1)
_FINE_FLIPS = _rng.integers(0, 1 << 64, FINE, np.uint64)


def bands(percent: int) -> int:
    """The least number of bands that misses a pair of percent with a chance of MISSED at most: 24 at 85, 35 at 80."""
    return math.ceil(math.log(MISSED) / math.log(max(MISSED, 1 - (percent / 100) ** ROWS)))


@cache
def _hashes(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors and flips of n bands' registers, and factors of the bands."""
    rng = np.random.default_rng(20)
    factors, flips = rng.integers(0, 1 << 64, n * ROWS, np.uint64) | _U(1), rng.integers(0, 1 << 64, n * ROWS, np.uint64)
    return factors, flips, rng.integers(0, 1 << 64, (n, ROWS + 1), np.uint64) | _U(1)


def registers(shingles: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """uint16 a bucket: leading zeros of its least hash above the next MANTISSA bits."""
    factors, flips, _ = _hashes(bands(percent))
    least = np.full(len(factors), np.iinfo(_U).max, _U)
    for start in range(0, len(shingles), 256):
        np.minimum(least, ((shingles[start : start + 256, None] ^ flips) * factors).min(axis=0), out=least)
    least >>= _U(11)  # 53 bits: exact as a double
    zeros = 53 - np.frexp(least.astype(float))[1]
    bits = (least << zeros.astype(_U)) >> _U(52 - MANTISSA) & _U((1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << MANTISSA | bits.astype(np.uint16)).astype(np.uint16)


def fine_bits(shingles: np.ndarray) -> np.ndarray:
    """FINE one-bit registers, each of a least hash of its own, in int64 words: finer than `registers` at a quarter of its size."""
    least = np.full(FINE, np.iinfo(_U).max, _U)
    for start in range(0, len(shingles), 64):
        np.minimum(least, ((shingles[start : start + 64, None] ^ _FINE_FLIPS) * _FINE_FACTORS).min(axis=0), out=least)
    return np.packbits((least >> _U(30) & _U(1)).astype(bool)).view(np.int64)


def fine_disagreements(percent: int) -> int:
    """Bits in which two sets of at least percent may differ, but for chances of DEVIATIONS standard deviations."""
    p = (1 - percent / 100) / 2
    return int(FINE * p + DEVIATIONS * (FINE * p * (1 - p)) ** 0.5) + 1


def band_keys(sketch: np.ndarray) -> np.ndarray:
    rows = sketch.reshape(-1, ROWS).astype(_U)
    _, _, band = _hashes(len(rows))
    h = (rows * band[:, :ROWS]).sum(axis=1, dtype=_U) + band[:, ROWS]
    h = (h ^ (h >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return (h ^ (h >> _U(32)) ^ band[:, ROWS]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray, n: int, m: int) -> float:
    """Jaccard index from two sketches of sets of n and m elements, less what registers share by chance."""
    ratio = n / m
    chance = 0.169919487159739 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return max(0.0, ((a == b).mean() - chance) / (1 - chance))


def content_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that tell rows apart by id and text."""
    return wide_hash(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def sketch_table(docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """(doc_id, k1, k2, text, node, n, keys, sketch): node is a digest of the words in order; null, without keys, where there is none.

    k1 and k2 are content_key() of the row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                nodes, sizes, keys, sketches = [], [], [], []
                texts = part.column(3).to_pylist()
                for text, s in zip(texts, shingle_sets(texts), strict=True):
                    sketch = registers(s, percent) if len(s) else None
                    nodes.append(hashlib.blake2b(b" ".join(words_exact(text)), digest_size=16).digest() if len(s) else None)
                    sizes.append(len(s))
                    keys.append(band_keys(sketch) if len(s) else None)
                    sketches.append(sketch.tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                    names=["doc_id", "k1", "k2", "text", "node", "n", "keys", "sketch"],
                )

    k1, k2 = content_key(id_col, text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, k1 long, k2 long, text string, node binary, n long, keys array<long>, sketch binary"
    )


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of which the corrected estimate may reach percent."""
    j = percent / 100
    least = j - DEVIATIONS * (j * (1 - j) / (bands(percent) * ROWS)) ** 0.5
    ends = nodes.select("node", "n", "sketch")
    joined = pairs.join(ends.toDF("a", "n_a", "s_a"), "a").join(ends.toDF("b", "n_b", "s_b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
            near = [
                estimate(np.frombuffer(x.as_buffer(), np.uint16), np.frombuffer(y.as_buffer(), np.uint16), n, m) >= least
                for x, y, n, m in zip(batch.column(4), batch.column(5), n_a, n_b, strict=True)
            ]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return joined.mapInArrow(run, "a binary, b binary")


def _confirmed(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The (a, b) with 100 * intersection >= percent * union on full sets, of words and not of hashes."""
    ends = nodes.select("node", "text")
    joined = pairs.join(ends.toDF("a", "t_a"), "a").join(ends.toDF("b", "t_b"), "b").select("a", "b", "t_a", "t_b")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                ids = [part.column(c).to_pylist() for c in (0, 1)]
                sets: dict[bytes, frozenset[bytes]] = {}
                for c in (0, 1):
                    for node, text in zip(ids[c], part.column(2 + c), strict=True):
                        if node not in sets:
                            sets[node] = shingles_exact(text.as_py())
                near = []
                for a, b in zip(*ids, strict=True):
                    both = len(sets[a] & sets[b])
                    near.append(100 * both >= percent * (len(sets[a]) + len(sets[b]) - both))
                yield pa.RecordBatch.from_arrays(part.columns[:2], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    return joined.mapInArrow(run, "a binary, b binary")


def links(pairs: DataFrame, nodes: DataFrame, percent: int = PERCENT) -> DataFrame:
    return materialize(_confirmed(materialize(_possible(pairs, nodes, percent), "possible"), nodes, percent), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of the (a, b) edges.

    Each round takes the least label among neighbours, then the label's own
    label, so rounds go with the logarithm of the longest path, not with its
    length.  Every round's labels are written, so no lineage grows.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        heard = both.join(labels.toDF("b", "heard"), "b").groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        step = materialize(step, "labels")
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("further")), "label")
        moved = materialize(jump.select("node", "old", F.col("further").alias("label")), "labels")
        if moved.where("old <> label").isEmpty():
            return moved.select("node", "label")
        labels = moved.select("node", "label")


def _open_pairs(members: DataFrame, labels: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(a, b) of one group and of different components that sizes and unshared shingles leave possible.

    members is (key, node) without the groups' centres.  A pair is listed
    once, in the first band whose key it shares.
    """
    mine = members.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = lambda t: t.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min("n").alias("least")).where("x <> y").select("key", "least")
    mine = materialize(mine.join(nodes.select("node", "n"), "node"), "members")
    keys = materialize(mixed(mine), "open-keys")
    mine = materialize(mine.join(few(keys), "key"), "open-members")
    who = materialize(mine.select("node").distinct(), "open-nodes")

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                sets = shingle_sets(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(sets).view(np.int64)), part.column(0).take(pa.array(np.repeat(np.arange(len(sets)), [len(s) for s in sets])))], names=["shingle", "node"]
                )

    held = materialize(nodes.join(few(who), "node", "left_semi").select("node", "text"), "open-texts", large=True)
    alone = held.mapInArrow(shingles, "shingle long, node binary").groupBy("shingle").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1").groupBy("node").agg(F.count("*").alias("alone"))
    mine = mine.join(alone, "node", "left").select("key", "node", "label", "n", "least", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    # the best partner has all that is shared and nothing else, but is no smaller than the group's smallest
    mine = materialize(mine.where(f"100 * shared >= {percent} * (n + greatest(shared, least) - shared)"), "able-members")
    mine = materialize(mine.drop("least").join(few(materialize(mixed(mine), "able-keys").select("key")), "key", "left_semi"), "able")

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [fine_bits(s) for s in shingle_sets(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["node", "bits"])

    left = materialize(mine.select("node").distinct(), "able-nodes")
    sketched = held.join(few(left), "node", "left_semi").mapInArrow(bits, "node binary, bits array<long>")
    sketched = materialize(sketched.join(nodes.select("node", "keys"), "node"), "open-sketches")
    mine = materialize(mine.join(sketched, "node").select("key", "node", "label", "n", "shared", "keys", "bits"), "open-rows")
    # members of one key are dealt over a grid of blocks, so that no task compares more than BLOCK members with BLOCK others
    side = materialize(mine.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("side")), "grid-sides")
    mine = mine.join(few(side), "key").select("*", F.pmod(F.xxhash64("node"), F.col("side")).cast("int").alias("own"))
    cells = F.explode(F.sequence(F.lit(0), F.col("side") - 1))
    names = ("node", "label", "n", "shared", "keys", "bits")
    x = mine.select("key", F.col("own").alias("i"), cells.alias("j"), *[F.col(c).alias(f"{c}_a") for c in names])
    y = mine.select("key", F.col("own").alias("j"), cells.alias("i"), *[F.col(c).alias(f"{c}_b") for c in names])
    most = F.least("shared_a", "shared_b")
    near = (F.col("node_a") < F.col("node_b")) & (F.col("label_a") != F.col("label_b")) & (100 * most >= percent * (F.col("n_a") + F.col("n_b") - most))
    first = F.get("keys_a", (F.array_position(F.zip_with("keys_a", "keys_b", lambda a, b: a == b), True) - 1).cast("int")) == F.col("key")
    apart = F.aggregate(F.zip_with("bits_a", "bits_b", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda t, v: t + v)
    return x.join(y, ["key", "i", "j"]).where(near & first & (apart <= fine_disagreements(percent))).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, k1, k2, n_shingles, component_id, kept, label) for every row; k1 and k2 are content_key() of the row.

    label tells components apart where ids don't; it is null for the empty set.

    Words are runs of anything but blanks, A-Z lower-cased; a document's set
    holds its distinct runs of five words, of fewer words the whole
    sequence; without words (null, empty or blank text) it is empty, links
    with nothing and is kept.  component_id is the smallest id reachable by
    links, kept whether it is the row's own.  Rows of equal words are linked.
    Rows of one id and text share their fate.  A row without an id is kept
    exactly if no row of its component has one.  An empty table gives an
    empty result.
    """
    with scratch(docs.sparkSession) as kept:
        table = materialize(sketch_table(docs, id_col, text_col, percent), "sketches", large=True)
        classes = materialize(table.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep")), "classes")
        banded = table.where("node IS NOT NULL").select(F.explode("keys").alias("key"), "node")
        shared = banded.groupBy("key").agg(F.min("node").alias("x"), F.max("node").alias("y")).where("x <> y").select("key")
        members = materialize(banded.join(few(materialize(shared, "shared-keys")), "key", "left_semi").distinct(), "members")
        sizes = members.groupBy("key").agg(F.count("*").alias("size"))
        weight = materialize(members.join(materialize(sizes, "sizes"), "key").groupBy("node").agg(F.sum("size").alias("weight")), "weights")
        reps = classes.join(few(weight.select("node")), "node", "left_semi").toDF("node", "rep")
        nodes = table.join(few(materialize(reps, "candidates")), "node").where("doc_id <=> rep").select("node", "n", "keys", "sketch", "text")
        nodes = materialize(nodes, "nodes", large=True)
        if nodes.count() > weight.count():  # equal rows of one id
            nodes = materialize(nodes.dropDuplicates(["node"]), "nodes", large=True)
        centre = members.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node"))["node"].alias("centre"))
        around = materialize(members.join(materialize(centre, "centres"), "key").where("node <> centre"), "around")
        found = links(around.select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct(), nodes, percent)
        labels = components(found)
        rest = links(_open_pairs(around.select("key", "node"), labels, nodes, percent), nodes, percent)
        if not rest.isEmpty():
            labels = components(found.union(rest))
        ids = classes.join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
        linked = materialize(labels.join(classes, "node").groupBy("label").agg(F.min("rep").alias("least")), "linked")
        ids = ids.join(few(linked), "label", "left").select("node", F.coalesce("least", "rep").alias("component_id"), "label")
        ids = materialize(ids, "component-ids")
        full = table.where("node IS NOT NULL").select("doc_id", "k1", "k2", "n", "node").join(ids, "node").select("doc_id", "k1", "k2", "n", "component_id", "label")
        full = full.union(table.where("node IS NULL").select("doc_id", "k1", "k2", "n", "doc_id", "node"))
        found = full.select("doc_id", "k1", "k2", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "label")
        return materialize(found, "near-duplicates", large=True, kept=kept)


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("k1", "k2", "label")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of docs for each component of near_duplicates(), and the rows without words; of rows of equal id and text, one.

    The row is one of the component's least id, or without an id if none has
    one; of several such the one of the least content_key().
    """
    k1, k2 = content_key(id_col, text_col)
    near = materialize(near_duplicates(docs, id_col, text_col, percent).where("kept").select("k1", "k2", "label"), "near")
    first = near.where("label IS NOT NULL").groupBy("label").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2")
    kept = first.union(near.where("label IS NULL").select("k1", "k2")).toDF("__k1", "__k2").distinct()
    keyed = docs.select("*", k1.alias("__k1"), k2.alias("__k2"))
    return keyed.join(materialize(kept, "kept"), ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"]).select(*docs.columns)


QUERIES = {"op9_minhash": op9_minhash}
ORACLE: dict = {}
