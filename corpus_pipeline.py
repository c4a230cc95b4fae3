"""From raw documents to token ids: five stages, each on all that its predecessor kept.

A stage is a function of (spark, docs, sf_dir) and returns a DataFrame; all
but the last return the columns of docs, extra ones included.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glasswort.llm import bpe, language_id, line_dedup, minhash, mixing
from glasswort.llm._shared import documents, materialize

#: Least Jaccard index of near-duplicates; op9_minhash, a query of its own, has 85.
NEAR_PERCENT = 80


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; texts without a letter go, and such as no language has half the score of.

    The model learns from labelled documents that aren't held out.  Without
    any, nothing can be told, and only texts without a letter go.
    """
    seen = docs.where(~language_id.held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    model = language_id.train(seen, "text", "lang", "doc_id")
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = language_id.identify(docs, model)
    rejected = (F.col("__lang") == language_id.UNKNOWN) | (F.col("__ambiguous") & (F.col("__score") < 0.5))
    return found.where(~rejected).select(*docs.columns)


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more hold; n_chars follows the text."""
    found = line_dedup.dedup_lines(docs)
    changed = F.col("__n_dropped") > 0
    text = F.when(changed, F.col("__kept")).otherwise(F.col("text"))
    made = {"text": text, "n_chars": F.when(changed, F.length("__kept").cast("long")).otherwise(F.col("n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[made[c].alias(c) if made.get(c) is not None else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, of five-word shingles and a Jaccard index of 0.8 or more: the one of the smallest id."""
    return minhash.one_of_each(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: repeated rows for repeated epochs."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    mixed = mixing.mix(mixing.sized_documents(docs, labels))
    return mixed.where("__copies > 0").select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__copy")).drop("__copy")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(all columns but text, n_tokens, ids, decoded_sha256): the last is of the ids decoded again."""
    found = bpe.encode_table(docs, "text", public_tokenizers.path(bpe.FILE), public_tokenizers.PATTERN)
    return found.select(*[c for c in found.columns if c != "decoded"], F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", identify_languages),
    ("line dedup", drop_common_lines),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("BPE", encode),
]

#: Language ID, HyperMinHash and BPE have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), large=True)
    return STAGES[-1][1](spark, docs, sf_dir)
