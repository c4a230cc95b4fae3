"""Line dedup: explode normalised lines, hash, count distinct documents per
hash, drop lines over the threshold, reassemble by position.

Text moves once, in the last join; everything before it handles hashes and
positions.  A line's hash has 128 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import BLANKS, ascii_lower, documents, materialize, wide_hash

MIN_DOCS = 10
MIN_CHARS = 1


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = wide_hash(F.col(id_col), text)
    return docs.select("*", text.alias("__text"), k1.alias("__k1"), k2.alias("__k2"))


def line_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(__k1, __k2, pos, h1, h2): a row for each line whose key has min_chars code points or more."""
    lines = _keyed(docs.select(id_col, text_col), id_col, text_col).select(
        "__k1", "__k2", F.posexplode(F.split("__text", "\n", -1)).alias("pos", "line")
    )
    key = ascii_lower(F.btrim("line", F.lit(BLANKS)))
    lines = lines.select("__k1", "__k2", "pos", key.alias("key")).where(F.length("key") >= min_chars)
    h1, h2 = wide_hash(F.col("key"))
    return lines.select("__k1", "__k2", "pos", h1.alias("h1"), h2.alias("h2"))


def frequent_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2) of the lines found in min_docs documents or more."""
    counted = lines.groupBy("h1", "h2").agg(F.count_distinct("__k1").alias("n"))
    return counted.where(F.col("n") >= min_docs).select("h1", "h2")


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS
) -> DataFrame:
    """docs with __n_lines, __n_dropped (long) and __kept (string) added.

    Texts are split at newlines; a null or empty text is one empty line.  A
    line's key is the line without blanks at both ends and with A-Z
    lower-cased.  Keys of min_chars code points or more that min_docs
    documents hold lose all their lines in every document; the others stay,
    joined by newlines.  Rows of equal id and equal text are one document to
    the count (so are rows without an id and of equal text); every row stays
    in the result.  An empty table gives an empty result.  Columns of docs
    keep their names; those that begin with two underscores are the
    operator's own.
    """
    lines = materialize(line_table(docs, id_col, text_col, min_chars), "lines", large=True)
    frequent = materialize(frequent_lines(lines, min_docs), "frequent-lines")
    hits = lines.join(frequent, ["h1", "h2"], "left_semi")
    drops = hits.groupBy("__k1", "__k2").agg(F.sort_array(F.collect_set("pos")).alias("__pos"))
    before = lambda i: F.coalesce(F.get("__pos", i - 1), F.lit(-1))
    marks = F.array_join(F.transform("__pos", lambda p, i: F.concat(F.expr("''"), F.repeat(F.lit("0"), p - before(i) - 1), F.lit("1"))), "")
    joined = _keyed(docs, id_col, text_col).join(drops, ["__k1", "__k2"], "left")
    split = F.split("__text", "\n", -1)
    kept = F.zip_with(split, F.split(marks, ""), lambda line, mark: F.when(mark == "1", F.lit(None)).otherwise(line))
    return joined.select(
        *[F.col(c) for c in docs.columns],
        F.size(split).cast("long").alias("__n_lines"),
        F.coalesce(F.size("__pos"), F.lit(0)).cast("long").alias("__n_dropped"),
        F.when(F.col("__pos").isNull(), F.col("__text")).otherwise(F.array_join(kept, "\n")).alias("__kept"),
    )


def op2_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2("__kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op2_linededup": op2_linededup}
ORACLE = {
    "op2_linededup": f"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM docs),
keyed AS (
  SELECT doc_id, pos, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
often AS (SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
flagged AS (SELECT k.*, o.key IS NOT NULL AS gone FROM keyed k LEFT JOIN often o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id"""
}
