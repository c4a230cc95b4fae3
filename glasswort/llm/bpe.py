"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern and each piece is merged on its own.
A segment tree over the piece's byte positions holds, at each position, the
rank of the pair that starts there; its root names the leftmost pair of the
lowest rank.  A merge changes two pairs, so it costs two walks to the root:
n log n for a piece of n bytes, however long it is.

Files of ranks are read where the code runs, by a path that is a parameter;
the driver reads them once and ships the bytes (bounded by the vocabulary).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents, schema_of

FILE = "byte_bpe_50k.tiktoken"
#: Pieces (about 150 bytes each) that an encoder remembers in each of two generations; only speed depends on it.
#: The second number is for a job that does nothing else.
REMEMBERED, REMEMBERED_ALONE = 250_000, 600_000
#: Rows that are encoded at a time.
SLICE = 128
_NONE = 1 << 32


def read_ranks(data: bytes) -> dict[bytes, int]:
    """token bytes -> rank of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def pair_ranks(ranks: dict[bytes, int]) -> list[int]:
    """Ranks of all pairs of bytes, by first byte times 256 plus second; _NONE where there is none."""
    return [ranks.get(bytes((a, b)), _NONE) for a in range(256) for b in range(256)]


def merge(piece: bytes, ranks: dict[bytes, int], pairs: list[int] | None = None) -> list[bytes]:
    """The tokens that merging leaves: always the leftmost pair of the lowest rank, while there is one.

    pairs is pair_ranks(ranks), for speed.  The segment tree lies in a list:
    node i has the children 2i and 2i + 1, a key is a rank above its place.
    """
    n = len(piece)
    if n < 2:
        return [piece]
    pairs = pairs or pair_ranks(ranks)
    get = ranks.get
    shift = n.bit_length()
    none, mask, size = _NONE << shift, (1 << shift) - 1, 1 << (n - 2).bit_length()
    level = [pairs[a << 8 | b] << shift | i for i, (a, b) in enumerate(zip(piece, piece[1:]))]
    level += [none] * (size - n + 1)
    tree = level
    while len(level) > 1:
        level = [a if a < b else b for a, b in zip(level[::2], level[1::2])]
        tree = level + tree
    tree = [none, *tree]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # ends and left neighbours of live parts
    while (least := tree[1]) < none:
        i = least & mask
        gone = after[i]
        end = after[i] = after[gone]
        if end < n:
            before[end] = i
            rank = get(piece[i : after[end]])
            changed = [(size + i, none if rank is None else rank << shift | i), (size + gone, none)]
        else:
            changed = [(size + i, none), (size + gone, none)] if gone < n - 1 else [(size + i, none)]
        left = before[i]
        if left >= 0:
            rank = get(piece[left:end])
            changed.append((size + left, none if rank is None else rank << shift | left))
        for at, key in changed:
            while tree[at] != key:
                tree[at] = key
                if at < 2:
                    break
                other = tree[at ^ 1]
                if other < key:
                    key = other
                at >>= 1
    parts, i = [], 0
    while i < n:
        end = after[i]
        parts.append(piece[i:end])
        i = end
    return parts


class _Pieces(dict):
    """piece -> its ids as decimals joined by spaces; the older of two generations is forgotten as the newer fills up."""

    def __init__(self, ranks: dict[bytes, int], remembered: int):
        super().__init__()
        self.ranks, self.remembered, self.old, self.pairs = ranks, remembered, {}, pair_ranks(ranks)

    def __missing__(self, piece: str) -> str:
        found = self.old.get(piece)
        if found is None:
            data = piece.encode("utf-8", "surrogatepass")
            rank = self.ranks.get(data)
            found = str(rank) if rank is not None else " ".join([str(self.ranks[part]) for part in merge(data, self.ranks, self.pairs)])
        if len(self) >= self.remembered:
            self.old = dict(self)
            self.clear()
        self[piece] = found
        return found


class Encoder:
    """Texts to ids and back.  Ids travel as decimals joined by single spaces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        import regex

        self.find, self.pieces = regex.compile(pattern).findall, _Pieces(ranks, remembered)
        self.tokens = {str(rank): token for token, rank in ranks.items()}

    def encode(self, text: str) -> str:
        return " ".join(map(self.pieces.__getitem__, self.find(text)))

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.split(" "))) if ids else b""


_encoders: dict[tuple[int, str, int], Encoder] = {}


def worker_encoder(data: bytes, pattern: str, remembered: int) -> Encoder:
    """This process's encoder for a file of ranks: later tasks of a worker find the pieces that earlier ones met."""
    key = (hash(data), pattern, remembered)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(read_ranks(data), pattern, remembered)
    return _encoders[key]


def encode_table(
    docs: DataFrame, text_col: str, ranks_file: str, pattern: str, keep: list[str] | None = None, digests: bool = False, remembered: int = REMEMBERED
) -> DataFrame:
    """keep (or all columns but the text) with n_tokens, and ids array<int> and decoded binary, or with digests their sha256.

    A null text is an empty one: no ids, no bytes.  Special tokens of the
    vocabulary are ordinary text.  Rows stay where they are: no shuffle.
    Texts of any length are encoded whole; equal texts, so repeated rows,
    get equal results; an empty table gives an empty one.  A kept column
    that has the name of a result column comes as input_<name>.
    """
    with open(ranks_file, "rb") as f:
        data = docs.sparkSession.sparkContext.broadcast(f.read())
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
    keep = [c for c in (docs.columns if keep is None else keep) if c != text_col]
    for c in [c for c in keep if c in made]:
        free = f"input_{c}"
        while free in docs.columns:
            free = f"input_{free}"
        docs = docs.withColumnRenamed(c, free)
        keep[keep.index(c)] = free
    made_types = "n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(data.value, pattern, remembered)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                counts, ids, raw = [], [], []
                for text in part.column(len(keep)):
                    found = encoder.encode(text.as_py() or "")
                    data_back = encoder.decode(found)
                    counts.append(found.count(" ") + 1 if found else 0)
                    ids.append(hashlib.sha256(found.encode()).hexdigest() if digests else np.fromstring(found, np.int32, sep=" "))
                    raw.append(hashlib.sha256(data_back).hexdigest() if digests else data_back)
                if digests:
                    out = [pa.array(ids, pa.string()), pa.array(raw, pa.string())]
                else:
                    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array(raw, pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(counts, pa.int64()), *out], names=[*keep, *made])

    return docs.select(*keep, text_col).mapInArrow(run, schema_of(docs, keep, made_types))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_table(
        documents(spark, sf_dir).select("doc_id", "text"), "text", public_tokenizers.path(FILE), public_tokenizers.PATTERN, digests=True, remembered=REMEMBERED_ALONE
    )


QUERIES = {"op10_bpe": op10_bpe}
ORACLE: dict = {}
