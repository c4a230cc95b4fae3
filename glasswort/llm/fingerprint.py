"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

A text's canonical form has compatibility-composed characters (NFKC), folded
case and single spaces.  Two xxhash64 of it (128 bits) group the documents;
inside a group of several texts the canonical bytes are compared, and a
group that holds different bytes gets its members' SHA-256 appended.  A
text is folded once for its hashes; what follows reads those, and folds
again only the texts of groups of several.

ICU, which Spark ships, does the normalising through SQL's reflect().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import documents, few, materialize, scratch, wide_hash

#: Blanks that are left after NFKC, as a class of Java's regular expressions.
_BLANK = r"\s\x{1c}-\x{1f}\x{85}\x{1680}\x{2028}\x{2029}"
#: Rows (keys only, no text) of a stretch of the document order.
STRETCH = 250_000


def canonical(text: Column) -> Column:
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    fold = lambda c: F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), c, F.lit(True))
    folded = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(compose(fold(compose(text))))
    return F.btrim(F.regexp_replace(folded, f"[{_BLANK} ]{{2,}}|[{_BLANK}&&[^ ]]", " "))


def _digest(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 16, "0"), F.lpad(F.hex(h2), 16, "0")))


#: Columns that the operator makes carry this in front; an input column of such a name is an error.
_OWN = "__fp_"
_BUCKET, _TEXT_KEY, _ROW_KEY = [["__fp_h1", "__fp_h2"], ["__fp_t1", "__fp_t2"], ["__fp_k1", "__fp_k2"]]


def _pair(names: list[str], *of: Column) -> list[Column]:
    return [h.alias(name) for h, name in zip(bucket_hash(*of) if names is _BUCKET else wide_hash(*of), names, strict=True)]


def bucket_hash(form: Column) -> tuple[Column, Column]:
    """The wide hash that groups canonical forms."""
    return wide_hash(form)


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table of a narrow row for each of docs: its id, length, and the hashes of row, text and canonical form."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("__fp_id"), F.length(text).alias("__fp_n"), *_pair(_ROW_KEY, F.col(id_col), text), *_pair(_TEXT_KEY, text), *_pair(_BUCKET, canonical(text))
    )
    return materialize(narrow, "digests")


def collided_texts(docs: DataFrame, text_col: str, narrow: DataFrame) -> DataFrame:
    """(text key, bucket, sha) of the texts in buckets that hold different canonical bytes; a written table, as a rule empty.

    Only buckets of several texts are looked at.  Their least and greatest
    bytes are equal if all are, and both combine before the shuffle, so no
    bucket's size matters.
    """
    one = F.struct(*_TEXT_KEY)
    several = narrow.groupBy(*_BUCKET).agg(F.min(one).alias("a"), F.max(one).alias("b")).where("a <> b").select(*_BUCKET)
    members = materialize(narrow.join(few(materialize(several, "several")), _BUCKET, "left_semi").select(*_TEXT_KEY, *_BUCKET).distinct(), "members")
    text = F.coalesce(F.col(text_col), F.lit(""))
    forms = docs.select(text.alias("__fp_text"), *_pair(_TEXT_KEY, text)).join(few(members), _TEXT_KEY).select(*_TEXT_KEY, *_BUCKET, canonical(F.col("__fp_text")).alias("form"))
    clash = materialize(forms.groupBy(*_BUCKET).agg(F.min("form").alias("a"), F.max("form").alias("b")).where("a <> b").select(*_BUCKET), "collided")
    told = forms.join(few(clash), _BUCKET, "left_semi").select(*_TEXT_KEY, *_BUCKET, F.sha2("form", 256).alias("__fp_sha")).distinct()
    return materialize(told, "collided-texts")


def named(narrow: DataFrame, collided: DataFrame) -> DataFrame:
    """narrow with __fingerprint."""
    plain = _digest(F.col("__fp_h1"), F.col("__fp_h2"))
    if collided.isEmpty():
        return narrow.select("*", plain.alias("__fingerprint"))
    told = narrow.join(few(collided.select(*_TEXT_KEY, "__fp_sha")), _TEXT_KEY, "left")
    return told.select(*narrow.columns, F.concat_ws("-", plain, "__fp_sha").alias("__fingerprint"))


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with __fingerprint added: 32 hex digits, and a SHA-256 behind them in a collided group.

    A null text is an empty one; texts of any length are folded whole.
    Texts have equal fingerprints exactly if their canonical bytes are
    equal, so repeated rows agree.  An empty table gives an empty result.
    Other columns pass through; names that begin with __fp_ are the
    operator's own.
    """
    if clash := [c for c in docs.columns if c.startswith(_OWN) or c == "__fingerprint"]:
        raise ValueError(f"columns {clash} have the operator's names")
    with scratch(docs.sparkSession) as kept:
        narrow = digests(docs, text_col, text_col)
        found = named(narrow, collided_texts(docs, text_col, narrow))
        found = materialize(found.select(*_TEXT_KEY, "__fingerprint").distinct(), "fingerprints", kept=kept)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select("*", *_pair(_TEXT_KEY, text)).join(found, _TEXT_KEY).select(*docs.columns, "__fingerprint")


def next_rows(rows: DataFrame, id_col: str, key: list[str], values: list[str]) -> DataFrame:
    """rows (narrow, of distinct keys) with __next: a struct of values of the row that follows in descending order of id, the first row's after the last.

    Null ids come last; rows of one id are ordered by key.  Spark's range
    partitioning cuts that order anywhere, inside one id or the nulls too,
    into stretches of about STRETCH rows; only a stretch's first row is
    handed to the stretch before it.
    """
    order = [F.col(id_col).desc_nulls_last(), *key]
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // STRETCH))
    placed = materialize(rows.repartitionByRange(parts, *order).select("*", F.spark_partition_id().alias("__at")), "order")
    within = Window.partitionBy("__at").orderBy(*order)
    value = F.struct(*values)
    led = materialize(placed.select("*", F.lead(value).over(within).alias("__lead"), (F.row_number().over(within) == 1).alias("__first")), "following")
    firsts = led.where("__first").select(F.col("__at").alias("__stretch"), value.alias("__value"))
    every = Window.orderBy("__stretch")  # a row a stretch
    whole = every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.select("__stretch", F.coalesce(F.lead("__value").over(every), F.first("__value").over(whole)).alias("__after"))
    joined = led.join(few(materialize(after, "stretches")), F.col("__at") == F.col("__stretch"))
    return joined.select(*rows.columns, F.coalesce("__lead", "__after").alias("__next"))


def compared_with_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last third replaced by the first as many code
    points of the next row's text, in descending order of id; null ids come
    last, rows of one id are ordered by a hash of id and text, and the last
    row is followed by the first.  A row alone is its own next one.  A null
    text is empty; texts of any length are taken whole.  Repeated rows
    follow each other.  An empty table gives an empty result.
    """
    with scratch(docs.sparkSession) as kept:
        narrow = digests(docs, id_col, text_col)
        collided = collided_texts(docs, text_col, narrow)
        marked = named(narrow, collided).groupBy("__fp_id", *_ROW_KEY, "__fp_n", "__fingerprint").agg(F.count("*").alias("copies"))
        marked = materialize(marked, "marked")
        repeated = not marked.where("copies > 1").isEmpty()
        follow = next_rows(marked, "__fp_id", _ROW_KEY, [*_ROW_KEY, "__fingerprint"])
        if repeated:  # all copies but the last are followed by a copy
            here = F.struct(*_ROW_KEY, "__fingerprint")
            ways = F.array(F.struct(F.lit(1).cast("long").alias("copies"), F.col("__next").alias("next")), F.struct((F.col("copies") - 1).alias("copies"), here.alias("next")))
            ways = F.filter(ways, lambda w: w["copies"] > 0)
            follow = follow.select("__fp_id", *_ROW_KEY, "__fp_n", "__fingerprint", F.explode(ways).alias("w")).select("*", F.col("w.copies").alias("copies"), F.col("w.next").alias("__next")).drop("w")
        third = F.floor(F.col("__fp_n") / 3).cast("int")
        follow = follow.select("__fp_id", *_ROW_KEY, "__fp_n", "__fingerprint", "copies", "__next", third.alias("third"))
        follow = materialize(follow.select("*", F.col("__next.__fp_k1").alias("n1"), F.col("__next.__fp_k2").alias("n2"), (F.col("__next.__fingerprint") == F.col("__fingerprint")).alias("same")).drop("__next"), "follow", kept=kept)
        clashing = materialize(collided.select(*_BUCKET).distinct(), "clashing", kept=kept)
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(*_pair(_ROW_KEY, F.col(id_col), text), text.alias("__fp_text"))
    texts = texts.dropDuplicates(_ROW_KEY) if repeated else texts
    start = follow.join(texts.toDF("n1", "n2", "__fp_text"), ["n1", "n2"]).select("__fp_id", *_ROW_KEY, "__fp_n", "__fingerprint", "copies", "third", "same", F.substring("__fp_text", F.lit(1), F.col("third")).alias("start"))
    joined = start.join(texts, _ROW_KEY)
    edited = joined.select("*", F.concat(F.substring("__fp_text", F.lit(1), F.col("__fp_n") - F.col("third")), "start").alias("edited"))
    edited = edited.select("*", canonical(F.col("edited")).alias("form"))
    edited = edited.select("*", *_pair(_BUCKET, F.col("form")))
    if not clashing.isEmpty():
        known = few(clashing.select(F.col("__fp_h1").alias("c1"), F.col("__fp_h2").alias("c2"), F.lit(True).alias("clash")))
        edited = edited.join(known, (F.col("__fp_h1") == F.col("c1")) & (F.col("__fp_h2") == F.col("c2")), "left")
    else:
        edited = edited.select("*", F.lit(None).cast("boolean").alias("clash"))
    plain = _digest(F.col("__fp_h1"), F.col("__fp_h2"))
    # bytes are compared where the digests agree, and the own ones are folded again only there
    other = F.when((F.col("__fingerprint") == plain), canonical(F.col("__fp_text")) != F.col("form")).otherwise(False)
    found = edited.select("*", F.when(F.coalesce("clash", F.lit(False)) | other, F.concat(plain, F.lit("-"), F.sha2("form", 256))).otherwise(plain).alias("edited_fingerprint"))
    if repeated:
        found = found.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    near = (F.col("__fingerprint") == F.col("edited_fingerprint")).cast("double")
    return found.select(
        F.col("__fp_id").alias(id_col), F.col("__fp_n").cast("long").alias("n_chars"), "edited", F.col("__fingerprint").alias("fingerprint"), "edited_fingerprint", near.alias("near_edited"), F.col("same").cast("double").alias("near_next")
    )


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compared_with_edited(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES = {"op4_fingerprint": op4_fingerprint}
ORACLE: dict = {}
