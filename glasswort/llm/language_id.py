"""Language identification by error-correcting output codes.

Every language gets a codeword; one binary classifier a bit, a logistic
regression on hashed letter n-grams, predicts that bit.  Decoding takes the
codeword of the least weighted logistic loss, a bit's weight for a language
being how well its classifier did on that language's training documents,
and flags documents of which two codewords are about as near.

The classifiers are fitted on the driver on a bounded sample (SAMPLE
documents, dealt evenly over the languages); only their hashed counts come
there.  Prediction reads whole texts, in place, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents, schema_of

#: Labelled documents that a fit uses at most, over all languages.
SAMPLE = 2000
BUCKETS = 1 << 13
#: Documents whose best two languages are nearer than this in score are ambiguous.
AMBIGUOUS = 0.2
UNKNOWN = "und"
_CHUNK = 1 << 20
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((not 0xD800 <= c < 0xE000 and chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the letter pairs and triples of a text by hash; what isn't a letter is one space between words."""
    counts = np.zeros(BUCKETS, np.float32)
    letter = _is_letter()
    for start in range(0, len(text), _CHUNK):  # two code points of overlap: no n-gram is lost at a cut
        codes = np.frombuffer(text[max(0, start - 2) : start + _CHUNK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.where(letter[codes], codes, np.uint32(32))
        space = codes == 32
        codes = np.concatenate(([np.uint32(32)], codes[~(space & np.concatenate(([True], space[:-1])))], [np.uint32(32)])).astype(np.uint32)
        pairs = (codes[:-1] * np.uint32(0x9E3779B1) + codes[1:]) * np.uint32(0x85EBCA6B)
        counts += np.bincount(pairs >> np.uint32(19), minlength=BUCKETS)
        if len(codes) > 2:
            triples = (pairs[:-1] ^ codes[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
            counts += np.bincount(triples >> np.uint32(19), minlength=BUCKETS)
    return counts


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length 1, whatever the text's length."""
    return np.sqrt(counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1))


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """(k, bits) of -1 and 1: the exhaustive code up to 7 classes, beyond it a random one of distinct rows."""
    if k <= 7:
        bits = max(1, 2 ** (k - 1) - 1)
        return np.array([[-1 if row and (b + 1) >> (row - 1) & 1 else 1 for b in range(bits)] for row in range(k)])
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    while True:
        code = rng.choice([-1, 1], (k, bits))
        if len(np.unique(code, axis=0)) == k and (abs(code.sum(axis=0)) < k).all():
            return code


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(rows, languages): shares of the exponentials of the negative weighted losses."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) * self.trust[None]
        z = -loss.sum(axis=2)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150, l2: float = 1e-4) -> Model:
    """All bits' regressions at once, by accelerated gradient descent; classes weigh the same."""
    code = codewords(len(languages))
    t = code[y].astype(np.float32)
    weight = (1 / np.bincount(y, minlength=len(languages)).clip(1))[y][:, None].astype(np.float32)
    weight /= weight.sum()
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    w_at, b_at, rate = w, b, np.float32(2.0)  # rows have length 1, so the curvature is at most 1/2
    for step in range(steps):
        g = -t * weight / (1 + np.exp((x @ w_at + b_at) * t))
        w_next, b_next = w_at - rate * (x.T @ g + np.float32(l2) * w_at), b_at - rate * g.sum(axis=0)
        push = np.float32(step / (step + 3))
        w_at, b_at = w_next + push * (w_next - w), b_next + push * (b_next - b)
        w, b = w_next, b_next
    right = ((x @ w + b) * t > 0).astype(float)
    trust = np.array([right[y == k].mean(axis=0) if (y == k).any() else np.ones(code.shape[1]) for k in range(len(languages))])
    return Model(languages, code, w, b, trust / trust.sum(axis=1, keepdims=True).clip(1e-9) * code.shape[1])


def train(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int = SAMPLE) -> Model | None:
    """A model of the non-null languages of labelled; None where there is no text with a letter.

    Of each language sample / languages documents are taken, one at least,
    or all where it has fewer: those of the least hash of id and text, so
    reruns take the same, null and repeated ids included; of equal rows any.
    A model holds `sample` languages at most, the most frequent ones;
    documents of others can't be told.
    """
    usable = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    draw = F.pmod(F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    lang = F.col(lang_col).cast("string")
    langs = {r[0]: r[1] for r in usable.groupBy(lang).count().orderBy(F.col("count").desc(), lang).limit(sample).collect()}
    if not langs:
        return None
    quota = max(1, sample // len(langs))
    # draws below the limit hold the quota's least but for a chance of six standard deviations
    limits = labelled.sparkSession.createDataFrame([(k, min(1.0, (quota + 6 * quota**0.5 + 20) / n)) for k, n in langs.items()], "lang string, __limit double")
    drawn = usable.select(draw.alias("__draw"), lang.alias("lang"), F.col(text_col).alias("text")).join(F.broadcast(limits), "lang").where("__draw <= __limit")
    order = Window.partitionBy("lang").orderBy("__draw", F.xxhash64("text"))
    chosen = drawn.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= quota).select("__draw", "lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [ngram_counts(text.as_py()) for text in batch.column(2)]
            at = [np.flatnonzero(r) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())), pa.array([r[a] for r, a in zip(rows, at, strict=True)], pa.list_(pa.float32()))],
                names=["draw", "lang", "at", "n"],
            )

    rows = chosen.mapInArrow(count, "draw double, lang string, at array<int>, n array<float>").orderBy("draw", "lang", "at", "n").collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    place = {lang: k for k, lang in enumerate(languages)}
    x, y = [], []
    for r in rows:
        dense = np.zeros(BUCKETS, np.float32)
        dense[r["at"]] = r["n"]
        x.append(features(dense))
        y.append(place[r["lang"]])
    return fit(np.array(x, np.float32), np.array(y), languages)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", ambiguous: float = AMBIGUOUS) -> DataFrame:
    """docs with __lang string, __score double and __ambiguous boolean added.

    A text that is null, empty or without letters is `und`, of score 0, not
    ambiguous; so is every text if there is no model.  Equal texts get equal
    answers, so repeated rows agree.  Texts of any length are read whole, in
    pieces.  An empty table gives an empty result.  Other columns pass
    through; one named like a result (__lang, __score, __ambiguous) is an
    error.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns
    if clash := {"__lang", "__score", "__ambiguous"} & set(columns):
        raise ValueError(f"columns {sorted(clash)} have the results' names")
    at = columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            langs, scores, unsure = [], [], []
            for start in range(0, batch.num_rows, 64):
                texts = [t.as_py() or "" for t in batch.column(at)[start : start + 64]]
                known = [i for i, t in enumerate(texts) if model is not None and any(map(str.isalpha, t))]
                lang, score, doubt = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
                if known:
                    p = model.scores(features(np.array([ngram_counts(texts[i]) for i in known])))
                    best = p.argmax(axis=1)
                    second = np.partition(p, -2, axis=1)[:, -2] if p.shape[1] > 1 else np.zeros(len(p))
                    for i, row, b, s in zip(known, p, best, second, strict=True):
                        lang[i], score[i], doubt[i] = model.languages[b], float(row[b]), bool(row[b] - s < ambiguous)
                langs += lang
                scores += score
                unsure += doubt
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())],
                names=[*columns, "__lang", "__score", "__ambiguous"],
            )

    return docs.mapInArrow(run, schema_of(docs, columns, "__lang string, __score double, __ambiguous boolean"))


def held_out(id_col: Column) -> Column:
    """Documents that no fit may see: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), "text", "lang", "doc_id")
    found = identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__ambiguous").alias("ambiguous"))


QUERIES = {"op7_langid": op7_langid}
ORACLE: dict = {}
