"""Queries of whole files: texts of the driver's tables in container bytes, walked and judged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.containers import CONTENT_TAIL
from ..operators.provenance import provenance
from . import bench as B
from .text_rules import _KEYS, _NAME, _SPECIFIC, _T, texts


def png_text(key: Column, text: Column) -> Column:
    """A PNG of one text chunk; walks don't check sums."""
    body = F.concat(F.encode(key, "ISO-8859-1"), F.unhex(F.lit("00")), F.encode(text, "ISO-8859-1"))
    size = F.unhex(F.lpad(F.hex(F.octet_length(body)), 8, "0"))
    end = F.unhex(F.lit("0000000049454E44AE426082"))
    return F.concat(F.unhex(F.lit("89504E470D0A1A0A")), size, F.encode(F.lit("tEXt"), "ISO-8859-1"), body, F.unhex(F.lit("00000000")), end)


def provenance_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation turn and inline text as the Software of a PNG: counts by verdict."""
    turns = B.table(spark, sf_dir, "conversations").select(F.lit("turn").alias("kind"), F.col("conv_id").alias("id"), F.regexp_replace("text", r"[^\x00-\x7f]", "?").alias("text"))
    rows = turns.unionByName(texts(spark).select(F.lit("inline").alias("kind"), "id", "text"))
    found = provenance(rows.select("kind", "id", png_text(F.lit("Software"), F.col("text")).alias("content")))
    return found.groupBy("kind", "format", "says_ai", "generator").agg(F.count("*").alias("n"))


def provenance_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline texts as the Title of a PNG: hints, but for records of settings, JSON, graphs and job ids."""
    found = provenance(texts(spark).select("id", png_text(F.lit("Title"), F.col("text")).alias("content")))
    return found.select("id", "says_ai", "partial_ai", "generator", "description")


def _hex(digits: str) -> Column:
    return F.unhex(F.lit(digits))


def _number(n: Column, width: int) -> Column:
    """n as big-endian bytes."""
    return F.unhex(F.lpad(F.hex(n), 2 * width, "0"))


def _box(kind: str, body: Column) -> Column:
    return F.concat(_number(F.octet_length(body) + 8, 4), _hex(kind.encode().hex()), body)


def provenance_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every nation's name as the comment of a JPEG, and as the claim generator of a manifest in WebP and ISO media bytes."""
    name = F.encode(F.col("n_name"), "UTF-8")
    comment = F.concat(_hex("FFD8FFE000074A46494600FFFFFE"), _number(F.octet_length(name) + 2, 2), name, _hex("FFDA0002"))
    claim = F.concat(_hex(b"claim_generator".hex()), _number(F.octet_length(name) + 0x60, 1), name)
    about = _box("jumd", F.concat(_hex(b"c2pa".hex() + CONTENT_TAIL.hex() + "03" + b"c2pa".hex() + "00")))
    manifest = _box("jumb", F.concat(about, claim))
    short = lambda n: F.concat(_number(n, 1), _hex("000000"))  # noqa: E731 - little-endian, of less than 256
    pad = F.when(F.octet_length(manifest) % 2 == 1, _hex("00")).otherwise(F.lit(b""))
    chunk = F.concat(_hex(b"C2PA".hex()), short(F.octet_length(manifest)), manifest, pad)
    webp = F.concat(_hex(b"RIFF".hex()), short(F.octet_length(chunk) + 4), _hex(b"WEBP".hex()), chunk)
    media = F.concat(_box("ftyp", _hex(b"heic".hex() + "00000000")), _box("meta", F.concat(_hex("00000000"), manifest)))
    made = F.array(*[F.struct(F.lit(kind).alias("container"), c.alias("content")) for kind, c in (("comment", comment), ("webp", webp), ("media", media))])
    files = B.table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.explode(made).alias("f")).select("id", "f.*")
    return provenance(files).select("id", "container", "format", "has_c2pa", F.col("raw")["jpeg:comment"].alias("comment"), F.col("c2pa.claim_generator").alias("maker"), F.col("c2pa.structurally_confirmed").alias("sure"), F.size("errors").cast("long").alias("n_errors"))


QUERIES = {"provenance_texts": provenance_texts, "provenance_rows": provenance_rows, "provenance_containers": provenance_containers}
_KIND = f"CASE WHEN {_NAME} IS NULL THEN NULL WHEN {_SPECIFIC} THEN 'weak only: PNG:Title mentions ' || {_NAME} ELSE 'weak only: PNG:Title mentions ' || {_NAME} || ' (ambiguous wording)' END"
# What the rules say of the titles that SQL can't judge (JSON, graphs, job ids, flags), worked out by hand.
_GRAPH, _PARAMS, _NOTHING = (True, "ComfyUI", "PNG 'Title' chunk holds a ComfyUI node graph"), (True, "unknown diffusion pipeline", "PNG 'Title' chunk holds generation parameters"), (False, None, "no provenance evidence")
BY_HAND = {
    22: _GRAPH, 23: _GRAPH, 24: _NOTHING, 25: _GRAPH, 26: _PARAMS, 27: _NOTHING, 28: _PARAMS, 29: (True, "Midjourney", "PNG 'Title' chunk holds a Midjourney job id"), 30: _NOTHING,
    31: (False, "Midjourney", "weak only: PNG 'Title' chunk carries Midjourney prompt flags"), 32: _NOTHING, 33: (False, "other hosted generator", "weak only: PNG:Title mentions other hosted generator"), 34: _NOTHING,
}
_quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
ORACLE = {
    "provenance_texts": f"""WITH f AS (SELECT 'turn' AS kind, text FROM conversations UNION ALL SELECT 'inline', text FROM {_T})
SELECT kind, 'PNG' AS format, {_NAME} IS NOT NULL AS says_ai, {_NAME} AS generator, count(*) AS n FROM f GROUP BY ALL""",
    "provenance_rows": f"""SELECT id, {_KEYS} >= 2 AS says_ai, false AS partial_ai, CASE WHEN {_KEYS} >= 2 THEN 'Stable Diffusion (A1111-style)' WHEN {_SPECIFIC} THEN {_NAME} END AS generator,
  CASE WHEN {_KEYS} >= 2 THEN 'PNG ''Title'' chunk holds A1111 generation settings' ELSE coalesce({_KIND}, 'no provenance evidence') END AS description FROM {_T} WHERE id < {min(BY_HAND)}
UNION ALL SELECT id::BIGINT, ai, false, generator, said FROM (VALUES {", ".join(f"({i}, {ai}, {_quoted(g)}, {_quoted(d)})" for i, (ai, g, d) in BY_HAND.items())}) t(id, ai, generator, said)""",
    "provenance_containers": """SELECT CAST(n_nationkey AS BIGINT) AS id, container, format, container <> 'comment' AS has_c2pa, CASE container WHEN 'comment' THEN n_name END AS comment,
  CASE WHEN container <> 'comment' THEN n_name END AS maker, CASE WHEN container <> 'comment' THEN true END AS sure, 0::BIGINT AS n_errors
FROM nation, (VALUES ('comment', 'JPEG'), ('webp', 'WEBP'), ('media', 'BMFF')) t(container, format)""",
}
