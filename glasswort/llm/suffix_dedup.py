"""Removal of every byte that a repeated 400-byte string covers.

Repeats are found by column-wise construction over many short strings:
one symbol of every string is inserted each round, from the last column to
the first; the Burrows-Wheeler transform of the collection (the symbols in
the order of the suffixes behind them) and the common prefixes of
neighbours are updated from the round before.  Strings of a class share
LENGTH bytes or more exactly where neighbours' common prefixes say so.

Whole documents would take as many rounds as the longest has bytes, each
over all text, so the strings are windows.  Every window of LENGTH bytes
picks an anchor from its own content (the least hash of its grams, as in
winnowing), so equal strings pick equal anchors at equal places and only
windows of equal anchors need meet.  Runs of starts that share an anchor
are one row; a run whose anchor is found once has no repeat.  Runs of equal
anchors and equal surroundings (by 128 bits of BLAKE2b) are one kind, and
two of each kind's places, or its only one, stand for it.  These are cut
into cells of CELL starts that share a core of LENGTH - CELL + 1 bytes, and
all cells of a core go through one construction: it alone says what is
repeated, hashes say who meets whom.

A core with more than CLASS cells is first cut down to two places of each
content, and one that is still larger to two places of each string.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, documents, few, materialize, schema_of, scratch, wide_hash

LENGTH, GRAM, CELL = 400, 200, 100
#: Strings of one construction: as many classes as fit, one class at least.
STRINGS = 1 << 14
CLASS = 1 << 14
_CHUNK, _BITS = 1 << 19, 21
_U = np.uint64
_P = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> _U(32))


class _Sums:
    """Hashes of any stretch of data, by prefix sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray):
        if not _powers:
            n = _CHUNK + 2 * LENGTH
            up, down = np.full(n, _P, _U), np.full(n, pow(_P, -1, 1 << 64), _U)
            up[0] = down[0] = 1
            _powers[:] = [np.cumprod(up), np.cumprod(down)]
        self.total = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * _powers[0][: len(data)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.total[end] - self.total[start]) * _powers[1][start]


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive keys: block-wise running minima from both sides."""
    n = len(keys) - width + 1
    padded = np.full(-(-len(keys) // width) * width, np.iinfo(_U).max, _U)
    padded[: len(keys)] = keys
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _digest(data: bytes, *numbers: int, size: int = 16) -> bytes:
    return hashlib.blake2b(data + struct.pack(f"<{len(numbers)}q", *numbers), digest_size=size).digest()


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(first start, further starts, anchor less first start, anchor's hash, surroundings' digest) of each run of starts that share an anchor."""
    text, parts, around = np.frombuffer(data, np.uint8), [], []
    for begin in range(0, len(text) - LENGTH + 1, _CHUNK):
        seg = text[begin : begin + _CHUNK + LENGTH - 1]
        at = np.arange(len(seg) - GRAM + 1)
        grams = _mix(_Sums(seg).of(at, at + GRAM))
        low = _U((1 << _BITS) - 1)
        anchor = (_least(grams & ~low | at.astype(_U), LENGTH - GRAM + 1) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.concatenate((first[1:] - 1, [len(anchor) - 1]))
        a = anchor[first]
        parts.append((first + begin, last - first, a - first, grams[a].view(np.int64)))
        around += [_digest(data[begin + f : begin + e + LENGTH], lead, e - f) for f, e, lead in zip(first.tolist(), last.tolist(), (a - first).tolist(), strict=True)]
    if not parts:
        return *[np.zeros(0, np.int64)] * 4, []
    return *[np.concatenate(x) for x in zip(*parts, strict=True)], around


_RUN = ("p", "more", "lead", "gram", "around")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = wide_hash(F.col(id_col), text)
    return docs.select("*", k1.alias("__k1"), k2.alias("__k2"), text.alias("__text"))


def run_table(keyed: DataFrame) -> DataFrame:
    """(k1, k2, runs array): a row for each document of LENGTH bytes or more."""

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [runs(t.as_py().encode("utf-8", "surrogatepass")) for t in part.column(2)]
                ends = np.cumsum([0, *[len(f[0]) for f in found]]).astype(np.int32)
                flat = [pa.array(np.concatenate([f[c] for f in found])) for c in range(4)]
                flat.append(pa.array([x for f in found for x in f[4]], pa.binary()))
                rows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(flat, names=list(_RUN)))
                yield pa.RecordBatch.from_arrays([*part.columns[:2], rows], names=["k1", "k2", "runs"])

    long_enough = keyed.where(F.octet_length("__text") >= LENGTH).select("__k1", "__k2", "__text")
    fields = ",".join(f"{c}:{'binary' if c == 'around' else 'bigint'}" for c in _RUN)
    return long_enough.mapInArrow(find, f"k1 long, k2 long, runs array<struct<{fields}>>")


def construct(strings: list[bytes], begin: np.ndarray, width: int, starts: int, length: int) -> np.ndarray:
    """(strings, starts) booleans: whether `length` bytes from that column on are also another string's from the same column.

    string i covers the columns begin[i], begin[i] + 1, ... of `width`.
    """
    m, none = len(strings), 256
    table = np.full((m, width), none, np.uint16)
    for i, (s, b) in enumerate(zip(strings, begin, strict=True)):
        table[i, b : b + len(s)] = np.frombuffer(s, np.uint8)
    columns = np.ascontiguousarray(table.T)
    found = np.zeros((m, starts), bool)
    order, common = np.arange(m), np.zeros(m + 1, np.int32)  # strings by their suffixes; common prefixes with the one before
    for column in range(width - 1, -1, -1):
        transform = columns[column][order]  # the Burrows-Wheeler transform of the suffixes so far
        insert = np.argsort(transform, kind="stable")
        symbol = transform[insert]
        same = (symbol[1:] == symbol[:-1]) & (symbol[1:] != none)
        upper, lower = insert[:-1][same], insert[1:][same]
        between = np.empty(2 * len(upper), np.int64)
        between[0::2], between[1::2] = upper + 1, lower + 1
        least = np.minimum.reduceat(common, between)[::2] if len(upper) else common[:0]
        common = np.zeros(m + 1, np.int32)
        common[1:m][same] = least + 1
        order = order[insert]
        if column < starts:
            enough = common >= length
            found[order, column] = enough[:m] | enough[1:]
    return found


def _cells(data: bytes, rows: list[dict]) -> Iterator[tuple]:
    """The cells of a document's runs, as fields of _CELL but the keys."""
    for r in rows:
        anchor = r["p"] + r["lead"]
        for cell in range((r["lead"] - r["more"]) // CELL, r["lead"] // CELL + 1):  # distances from start to anchor, by CELL
            far, near = min(r["lead"], cell * CELL + CELL - 1), max(r["lead"] - r["more"], cell * CELL)
            core = data[anchor - cell * CELL : anchor - cell * CELL - CELL + 1 + LENGTH]
            begin = cell * CELL + CELL - 1 - far
            span = data[anchor - far : anchor - near + LENGTH]
            known = int.from_bytes(_digest(core, cell, size=8), "little", signed=True)
            yield known, _digest(span, begin), r["gram"], r["around"], r["twice"], anchor - far, r["lead"] - far, begin, span


#: content: digest of a cell's bytes and place; gram and kind: the run's; twice: of several equal rows; p: first start, also as shift from the run's.
_CELL = "core long, content binary, gram long, kind binary, twice boolean, p long, shift long, begin long, span binary"


def cell_table(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """_CELL and k1, k2 of the runs in rows: (k1, k2, runs)."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [f.split()[0] for f in _CELL.split(", ")]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = list(_cells(batch.column(3)[i].as_py().encode("utf-8", "surrogatepass"), batch.column(2)[i].as_py()))
                for at in range(0, len(found), 10_000):
                    part = found[at : at + 10_000]
                    key = [pa.array(np.full(len(part), batch.column(c)[i].as_py(), np.int64)) for c in (0, 1)]
                    yield pa.RecordBatch.from_arrays([*[pa.array([f[c] for f in part], k) for c, k in enumerate(kinds)], *key], names=[*names, "k1", "k2"])

    joined = rows.join(docs, (rows["k1"] == docs["__k1"]) & (rows["k2"] == docs["__k2"])).select("k1", "k2", "runs", "__text")
    return joined.mapInArrow(cut, _CELL + ", k1 long, k2 long")


def _settled(cells: DataFrame, width: int = LENGTH + CELL - 1, starts: int = CELL) -> DataFrame:
    """(gram, kind, a, b): ranges of repeated strings' starts, as shifts from a run's first, by one construction for each core.

    No core may have many cells.  Of each content two places go in, the same one twice where rows are equal.
    """
    wanted = ["core", "content", "gram", "kind", "twice", "shift", "begin", "span"]

    def solve(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # a content of a core: its bytes, and its rows

        def out() -> pa.RecordBatch:
            strings, begin, owner = [], [], []
            for i, h in enumerate(held):
                for span in h["spans"]:
                    strings.append(span)
                    begin.append(h["begin"])
                    owner.append(i)
            found = construct(strings, np.array(begin), width, starts, LENGTH) if strings else []
            made: list[list] = [[], [], [], []]
            for k, i in enumerate(owner):
                if k and owner[k - 1] == i:
                    continue
                edge = np.diff(found[k].astype(np.int8), prepend=0, append=0)
                for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
                    for gram, kind, shift in held[i]["rows"]:
                        for c, x in zip(made, (gram, kind, shift + a - held[i]["begin"], shift + b - 1 - held[i]["begin"]), strict=True):
                            c.append(x)
            held.clear()
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds, strict=True)], names=["gram", "kind", "a", "b"])

        core = content = None
        size = 0
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[0] != core and size >= STRINGS:
                    yield out()
                    size = 0
                if row[:2] != (core, content):
                    core, content = row[:2]
                    held.append({"begin": row[6], "spans": [], "rows": []})
                last = held[-1]
                if len(last["spans"]) < 2:
                    last["spans"] += [row[7]] * (2 if row[4] and not last["spans"] else 1)
                last["rows"].append((row[2], row[3], row[5]))
                size += 1
        if held:
            yield out()

    dealt = cells.select(*wanted).repartition("core").sortWithinPartitions("core", "content")
    return dealt.mapInArrow(solve, "gram long, kind binary, a long, b long")


def _two_places(cells: DataFrame, by: list[str]) -> DataFrame:
    """cells, but only the least and the greatest place of each `by`, and twice also where all its places are one."""
    place = F.struct("k1", "k2", "p")
    ends = cells.groupBy(*by).agg(F.min(place).alias("x"), F.max(place).alias("y"), F.max("twice").alias("t"))
    ends = ends.select(*by, F.explode(F.array_distinct(F.array("x", "y"))).alias("e"), ((F.col("x") == F.col("y")) & F.col("t")).alias("again"))
    keys = [*by, "k1", "k2", "p"]
    ends = ends.select(*by, "e.*", "again")
    return cells.join(ends, keys).dropDuplicates(keys).withColumn("twice", F.col("again")).drop("again")


def _strings(cells: DataFrame) -> DataFrame:
    """(string digest, at, content, twice, k1, k2, p): every start of cells, `at` its place in the cell; without the bytes."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                part = batch.slice(start, 128)
                spans = part.column(0).to_pylist()
                at = [(i, s) for i, span in enumerate(spans) for s in range(len(span) - LENGTH + 1)]
                place = pa.array([i for i, _ in at])
                made = [_digest(spans[i][s : s + LENGTH]) for i, s in at]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array([s for _, s in at], pa.int64()), *[part.column(c).take(place) for c in range(1, 6)]], names=["string", "at", *names])

    names = ["content", "twice", "k1", "k2", "p"]
    return cells.select("span", *names).mapInArrow(each, "string binary, at long, content binary, twice boolean, k1 long, k2 long, p long")


def _settled_by_strings(cells: DataFrame) -> DataFrame:
    """What _settled() finds, for cores of any number of contents: two places of each repeated string go through the construction."""
    each = materialize(_strings(cells), "strings", large=True)
    place = F.struct("k1", "k2", "p", "content", "at")
    ends = each.groupBy("string").agg(F.sum(F.lit(1) + F.col("twice").cast("int")).alias("c"), F.min(place).alias("x"), F.max(place).alias("y")).where("c > 1")
    ends = ends.select("string", F.explode(F.array_distinct(F.array("x", "y"))).alias("e"), (F.col("x") == F.col("y")).alias("again")).select("string", "e.*", "again")
    pairs = materialize(ends, "string-ends").join(cells.select("k1", "k2", "p", "content", "span"), ["k1", "k2", "p", "content"])
    none = F.lit(0).cast("long")
    one = pairs.select(
        F.xxhash64("string").alias("core"), F.col("string").alias("content"), none.alias("gram"), F.col("string").alias("kind"), F.col("again").alias("twice"),
        none.alias("shift"), none.alias("begin"), F.substring("span", F.col("at").cast("int") + 1, F.lit(LENGTH)).alias("span"),
    )
    sure = materialize(_settled(one, LENGTH, 1).select(F.col("kind").alias("string")).distinct(), "sure-strings")
    return each.join(few(sure), "string", "left_semi").select(none.alias("gram"), F.col("content").alias("kind"), F.col("at").alias("a"), F.col("at").alias("b"))


def settle(cells: DataFrame) -> DataFrame:
    """(gram, kind, a, b) of cells, whatever the sizes of their cores."""
    above = lambda t: t.groupBy("core").count().where(F.col("count") > CLASS).select("core")
    large = materialize(above(cells), "large-cores")
    if large.isEmpty():
        return _settled(cells)
    hot = cells.join(few(large), "core", "left_semi")
    none = F.lit(0).cast("long")
    # a content stands for its cells, and is a kind of its own here
    two = _two_places(hot, ["core", "content"]).withColumns({"gram": none, "kind": F.col("content"), "shift": none})
    two = materialize(two, "hot-cells", large=True)
    still = materialize(above(two), "still-large")
    solved = _settled(two.join(few(still), "core", "left_anti"))
    if not still.isEmpty():
        solved = solved.unionByName(_settled_by_strings(two.join(few(still), "core", "left_semi")))
    solved = materialize(solved.select(F.col("kind").alias("content"), "a", "b").distinct(), "hot-solved")
    named = hot.select("content", "gram", "kind", "shift").distinct().join(solved, "content")
    named = named.select("gram", "kind", (F.col("shift") + F.col("a")).alias("a"), (F.col("shift") + F.col("b")).alias("b"))
    return _settled(cells.join(few(large), "core", "left_anti")).unionByName(named)


def repeats(keyed: DataFrame) -> DataFrame:
    """(k1, k2, gone): for each row's text the ranges of starts of repeated strings, array<struct<first, last>>, in order."""
    table = materialize(run_table(keyed), "runs", large=True)
    flat = table.select("k1", "k2", F.explode("runs").alias("r")).select("k1", "k2", "r.*")
    several = flat.groupBy("gram").agg(F.count("*").alias("c")).where("c > 1").select("gram")
    shared = materialize(flat.join(few(materialize(several, "grams")), "gram", "left_semi"), "shared-runs", large=True)
    discard(table)
    place = F.struct("k1", "k2", "p", "more", "lead")
    kinds = materialize(shared.groupBy("gram", "around").agg(F.count("*").alias("c"), F.min(place).alias("x"), F.max(place).alias("y")), "kinds")
    equal_rows = (F.col("c") > 1) & (F.col("x") == F.col("y"))
    ends = kinds.select("gram", "around", equal_rows.alias("twice"), F.explode(F.array_distinct(F.array("x", "y"))).alias("e")).select("gram", "around", "twice", "e.*")
    chosen = materialize(ends.groupBy("k1", "k2").agg(F.collect_set(F.struct(*_RUN, "twice")).alias("runs")), "chosen-runs", large=True)
    texts = keyed.select("__k1", "__k2", "__text")
    if not kinds.where(equal_rows).isEmpty():
        texts = texts.dropDuplicates(["__k1", "__k2"])
    cells = materialize(cell_table(texts, chosen), "cells", large=True)
    solved = materialize(settle(cells), "solved", large=True)
    discard(cells)
    ranges = materialize(solved.groupBy("gram", F.col("kind").alias("around")).agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "ranges")
    placed = F.transform("ranges", lambda r: F.struct((F.col("p") + r["a"]).alias("first"), (F.col("p") + r["b"]).alias("last")))
    found = shared.join(few(ranges), ["gram", "around"]).select("k1", "k2", placed.alias("r"))
    return found.groupBy("k1", "k2").agg(F.sort_array(F.flatten(F.collect_set("r"))).alias("gone"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs with __n_bytes, __n_removed, __n_spans (long) and __kept (binary; its SHA-256 in hex, if digest) added.

    Texts are read as UTF-8 bytes, a null one as empty.  Each byte goes that
    a string of LENGTH bytes covers which also starts at any other place of
    any row's text; what is left is joined.  Texts of fewer bytes stay
    whole.  A repeated row makes its whole text repeated.  Cuts may fall
    inside a character, so the result is binary.  An empty table gives an
    empty result.
    """
    keyed = _keyed(docs, id_col, text_col)
    with scratch(docs.sparkSession) as kept:
        gone = materialize(repeats(keyed).toDF("__g1", "__g2", "__gone"), "gone", large=True, kept=kept)
    joined = keyed.join(gone, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2")), "left")
    columns = docs.columns
    n = len(columns)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, ranges in zip(batch.column(n), batch.column(n + 1), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                kept, at, spans = [], 0, 0
                end = -1
                for r in ranges.as_py() or ():
                    if r["first"] > end:
                        spans += 1
                        kept.append(data[at : r["first"]])
                    end = max(end, r["last"] + LENGTH)
                    at = end
                kept.append(data[at:])
                left = b"".join(kept)
                for c, x in zip(out, (len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest() if digest else left), strict=True):
                    c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string() if digest else pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *[pa.array(c, k) for c, k in zip(out, kinds, strict=True)]], names=[*columns, *_MADE])

    made = f"__n_bytes long, __n_removed long, __n_spans long, __kept {'string' if digest else 'binary'}"
    return joined.select(*columns, "__text", "__gone").mapInArrow(cut, schema_of(docs, columns, made))


_MADE = ("__n_bytes", "__n_removed", "__n_spans", "__kept")


def op6_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = remove_repeats(docs, digest=True)
    named: list[Column] = [F.col(a).alias(b) for a, b in zip(_MADE, ("n_bytes", "n_removed", "n_spans", "kept_sha256"), strict=True)]
    return found.select("doc_id", *named)


QUERIES = {"op6_suffix": op6_suffix}
ORACLE: dict = {}
