"""Exact top-k by inner product over an impact-ordered index.

Vectors are integers.  A block of them is indexed by posting segments, one
for each dimension and bit plane of the shifted components: the rows whose
component has that bit.  Segments are processed score-at-a-time in
descending impact (2 to the plane): each adds its impact times the query's
component to the accumulators of its rows.  After each plane, what the
remaining planes can still add to any row is bounded from both sides;
processing stops as soon as the rows that may still reach the k best are
few, and those possible members, and no others, are rescored exactly.

Segments of a plane are bitmaps over the block's rows, so a plane is one
matrix product for a block of queries.  The index is written once, a row for
each block, and stays where it is.  Queries pass it in waves of at most WAVE
bytes, which are broadcast: a wave gives the k best of each query in every
block, and a ranking over those gives the result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import dealt, materialize, scratch

ROWS, QUERIES_A_BLOCK, K, SCALE, EVERY = 8192, 1024, 20, 64, 20
#: Rescore once no more than this share of a block's rows can still be members.
RESCORE = 1 / 32
#: Bytes of query vectors in a broadcast wave, unless one block of queries has more.
WAVE = 16 << 20
#: Scores beyond this are summed as Python integers and clipped to 64 bits.
_SAFE, _MOST = 2.0**62, (1 << 63) - 1


def _blocks(table: DataFrame, rows: int) -> DataFrame:
    """(dim, n, ids binary, vectors binary): the rows of (id, vec array<long>) packed, up to `rows` of one dimension in each."""

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, vecs = held.pop(dim)
            return pa.RecordBatch.from_pydict({"dim": [dim], "n": [len(ids)], "ids": [np.array(ids, np.int64).tobytes()], "vectors": [np.concatenate(vecs).astype(np.int64).tobytes()]})

        for batch in batches:
            for i, vec in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = vec.values.to_numpy(zero_copy_only=False)
                ids, vecs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vecs.append(v)
                if len(ids) == rows:
                    yield block(len(v))
        for dim in list(held):
            yield block(dim)

    return table.mapInArrow(pack, "dim long, n long, ids binary, vectors binary")


def _product(q: np.ndarray, rows: np.ndarray, most: int) -> np.ndarray:
    """q @ rows.T, exact: in the narrowest type that holds all partial sums."""
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (q.astype(kind) @ rows.astype(kind).T).astype(np.int64)


def segments(rows: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(least of each component, packed bitmaps of each bit plane of rows less that, from the lowest)."""
    shift = rows.min(axis=0)
    shifted = rows - shift
    planes = int(shifted.max()).bit_length() if shifted.size else 0
    return shift, [np.packbits((shifted >> p & 1).astype(np.uint8)).tobytes() for p in range(planes)]


def _too_large(*arrays: np.ndarray) -> bool:
    dim, sizes = arrays[0].shape[1], [float(np.abs(x.astype(float)).max(initial=0)) for x in arrays]
    return dim * (sizes[0] + 1) * 2 * (sizes[1] + 1) >= _SAFE or max(sizes) >= _SAFE


def block_top_k(q: np.ndarray, q_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, index: tuple[np.ndarray, list[bytes]] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, scores) of its k best rows of another id; ties to smaller ids.  index is segments(rows)."""
    k = min(k, len(rows))
    if _too_large(q, rows):
        for i in range(len(q)):
            at = np.flatnonzero(ids != q_ids[i])
            exact = [sum(int(a) * int(b) for a, b in zip(q[i], rows[j], strict=True)) for j in at]
            score = [max(-_MOST, min(_MOST, x)) for x in exact]
            best = sorted(range(len(at)), key=lambda j: (-score[j], ids[at[j]]))[:k]
            yield i, ids[at[best]], np.array([score[j] for j in best], np.int64)
        return
    shift, planes = index or segments(rows)
    own = q_ids[:, None] == ids[None, :]
    least = np.int64(-(1 << 62))
    acc = np.repeat((q * shift).sum(axis=1)[:, None], len(rows), axis=1)
    acc[own] = least
    up, down = np.maximum(q, 0).sum(axis=1), np.minimum(q, 0).sum(axis=1)
    size = int(np.abs(q).sum(axis=1).max(initial=0))
    open_ = acc > least
    for plane in range(len(planes) - 1, -1, -1):
        bits = np.unpackbits(np.frombuffer(planes[plane], np.uint8), count=rows.size).reshape(rows.shape)
        acc += _product(q, bits, size) << plane
        left = (1 << plane) - 1
        floor = np.partition(acc, len(rows) - k, axis=1)[:, len(rows) - k] + down * left  # k rows end here at least
        open_ = (acc + (up * left)[:, None] >= floor[:, None]) & ~own
        if left and open_.mean() <= RESCORE:
            break
    for i in range(len(q)):
        at = np.flatnonzero(open_[i])
        score = rows[at] @ q[i]
        best = np.lexsort((ids[at], -score))[:k]
        yield i, ids[at][best], score[best]


def build_index(blocks: DataFrame) -> DataFrame:
    """(dim, n, ids, vectors, shift, planes): the segments of each block beside its rows, for rescoring."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = np.frombuffer(r["vectors"], np.int64).reshape(-1, r["dim"])
                # differences of huge components overflow; such blocks are summed without segments
                shift, planes = (np.zeros(r["dim"], np.int64), []) if _too_large(rows, rows[:0]) else segments(rows)
                yield pa.RecordBatch.from_pylist([r | {"shift": shift.tobytes(), "planes": planes}], pa.schema([*batch.schema, ("shift", pa.binary()), ("planes", pa.list_(pa.binary()))]))

    return blocks.mapInArrow(run, "dim long, n long, ids binary, vectors binary, shift binary, planes array<binary>")


def _waves(sizes: list[tuple[int, int]]) -> Iterator[list[int]]:
    """Keys of (key, bytes) in groups of WAVE bytes at most, or of one key."""
    held, total = [], 0
    for key, size in sorted(sizes):
        if held and total + size > WAVE:
            yield held
            held, total = [], 0
        held.append(key)
        total += size
    if held:
        yield held


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _pass(index: DataFrame, wave: list, k: int) -> DataFrame:
    """(query_id, vec_id, score): each query's k best in every block; wave is (dim, ids, vectors) of blocks of queries."""
    queries: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in wave}:
        mine = [r for r in wave if r["dim"] == dim]
        ids = np.concatenate([np.frombuffer(r["q_ids"], np.int64) for r in mine])
        queries[dim] = ids, np.concatenate([np.frombuffer(r["q_vectors"], np.int64) for r in mine]).reshape(len(ids), dim)
    shipped = index.sparkSession.sparkContext.broadcast(queries)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                q_ids, q = shipped.value.get(r["dim"], (np.zeros(0, np.int64), None))
                if not len(q_ids):
                    continue
                ids, rows = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["vectors"], np.int64).reshape(-1, r["dim"])
                kept = (np.frombuffer(r["shift"], np.int64), r["planes"])
                for start in range(0, len(q), 256):
                    part = list(block_top_k(q[start : start + 256], q_ids[start : start + 256], rows, ids, k, kept))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(q_ids[[start + i for i, _, _ in part]], [len(f) for _, f, _ in part])),
                            pa.array(np.concatenate([f for _, f, _ in part])),
                            pa.array(np.concatenate([s for _, _, s in part])),
                        ],
                        names=["query_id", "vec_id", "score"],
                    )

    return index.mapInArrow(search, "query_id long, vec_id long, score long")


def top_k(table: DataFrame, is_query: Column, id_col: str = "id", vec_col: str = "vec", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows of each query row by integer inner product.

    table has an id (long) and a vector (array<long>).  Rows without an id
    or a vector, or with a null component, take no part; so do empty
    vectors.  Vectors meet those of their own length only.  Rows of one id
    never find each other; a query id of several rows is ranked over the
    results of all of them, each found id once, at its best score.  Ties go
    to the smaller id.  Scores beyond 64 bits are clipped to them; rows that
    a clipped score ties go by id.  An empty table gives an empty result.
    """
    spark = table.sparkSession
    with scratch(spark) as kept:
        usable = table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), is_query.alias("query"))
        usable = materialize(usable.where("id IS NOT NULL AND vec IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL)"), "vectors", large=True)
        index = materialize(build_index(_blocks(usable.select("id", "vec"), ROWS)), "index", large=True)
        asked = usable.where("query").select("id", "vec")
        spread = max(1, -(-asked.count() // QUERIES_A_BLOCK))
        asked = _blocks(asked.repartition(spread, "id"), QUERIES_A_BLOCK).toDF("dim", "q_n", "q_ids", "q_vectors")
        asked = materialize(asked.select("*", F.xxhash64("dim", "q_ids").alias("block")), "query-blocks")
        found = None
        for wave in _waves([tuple(r) for r in asked.select("block", F.octet_length("q_vectors")).distinct().collect()]):
            here = asked.where(F.col("block").isin(wave)).select("dim", "q_ids", "q_vectors").collect()  # WAVE bytes
            best = materialize(_best(_pass(dealt(index), here, k), k).drop("rank"), "wave", kept=kept)
            found = best if found is None else found.union(best)
    if found is None:
        found = spark.createDataFrame([], "query_id long, vec_id long, score long")
    return _best(found, k)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    table = table.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity'))")
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("long"))
    return top_k(table.select(F.col("vec_id").alias("id"), whole.alias("vec")), F.col("id") % EVERY == 0)


QUERIES = {"op8_topk": op8_topk}
ORACLE = {
    "op8_topk": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.vec, c.vec), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {K}"""
}
