"""Provenance of files: container walks in Arrow batches, then rules as column expressions, all within the row."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.scores import jpeg_quality
from .containers import walk

_C2PA = "struct<container:string,manifest_bytes:bigint,claim_generator:string,actions:array<string>,labels:array<string>,terms:array<string>,structurally_confirmed:boolean,cryptographically_validated:boolean>"
_JPEG = "struct<subsampling:string,progressive:boolean,has_jfif:boolean,n_quant_tables:bigint,luma:array<bigint>,chroma:array<bigint>,has_adobe:boolean,app_segments:array<string>>"
_WALK = f"format string, fields array<struct<where:string,what:string,text:string,scan:string>>, facts array<string>, errors array<string>, raw map<string,string>, c2pa {_C2PA}, jpeg {_JPEG}"

_strings = pa.list_(pa.string())
_ARROW = [
    pa.string(),
    pa.list_(pa.struct([(n, pa.string()) for n in ("where", "what", "text", "scan")])),
    _strings,
    _strings,
    pa.map_(pa.string(), pa.string()),
    pa.struct([("container", pa.string()), ("manifest_bytes", pa.int64()), ("claim_generator", pa.string()), ("actions", _strings), ("labels", _strings), ("terms", _strings), ("structurally_confirmed", pa.bool_()), ("cryptographically_validated", pa.bool_())]),
    pa.struct([("subsampling", pa.string()), ("progressive", pa.bool_()), ("has_jfif", pa.bool_()), ("n_quant_tables", pa.int64()), ("luma", pa.list_(pa.int64())), ("chroma", pa.list_(pa.int64())), ("has_adobe", pa.bool_()), ("app_segments", _strings)]),
]
_NAMES = ["format", "fields", "facts", "errors", "raw", "c2pa", "jpeg"]


def walk_files(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their content, with what the walk of it found.  A null content finds nothing."""
    keep = [c for c in files.columns if c != content and c not in _NAMES]
    n = len(keep)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                found = [walk(x.as_py() or b"") for x in part.column(n)]
                rows = [
                    (f.format, [dict(zip(("where", "what", "text", "scan"), x, strict=True)) for x in f.fields], f.camera, f.errors, list(f.raw.items()), f.c2pa, f.jpeg)
                    for f in found
                ]
                made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_ARROW)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=[*keep, *_NAMES])

    types = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in keep)
    return files.select(*keep, content).mapInArrow(run, types + _WALK)


def field_evidence(f: Column) -> Column:
    """Evidence of one field by its scan; for PNG chunks `where` is the key."""
    key, text, scan = f["where"], f["text"], f["scan"]
    png = scan == "png"
    where, what = F.when(png, F.concat(F.lit("PNG:"), key)).otherwise(key), F.when(png, F.concat(F.lit("PNG '"), key, F.lit("' chunk"))).otherwise(f["what"])
    kind = (
        F.when(png, rules.png_key_class(key, text))
        .when(scan == "software", F.when(rules.is_settings(text), "freetext").otherwise("tool"))
        .when(scan == "ladder_params", "ladder_params")
        .when(scan == "ladder_freetext", "freetext")
        .when(scan.startswith("names_tool"), "tool")
        .when(scan.startswith("names_freetext"), "names")
        .otherwise("none")
    )
    typed = png | scan.isin("software", "dst") | scan.startswith("ladder") | scan.endswith("_dst")
    said = F.concat(rules.record_evidence(where, what, text, kind, rules.png_vendor(key)), F.when(typed, rules.source_type_evidence(where, text)).otherwise(rules.none()))
    return F.when(scan == "xmp", rules.xmp_evidence(text)).otherwise(said)


def provenance(files: DataFrame, content: str = "content") -> DataFrame:
    """files without their content, with the verdict of their metadata.

    ai, weak and camera are sorted distinct evidence; generator, says_ai,
    partial_ai, says_camera, description, has_c2pa, source_type, jpeg quality
    and raw fields follow.  Metadata only ever argues for a conclusion.
    """
    walked = walk_files(files, content)
    keep = [c for c in walked.columns if c not in _NAMES]
    held = walked.select("*", F.flatten(F.transform("fields", field_evidence)).alias("evidence"))
    of = lambda kind: rules.texts_of(F.col("evidence"), kind)
    judged = held.select(
        *keep,
        "format",
        of("ai").alias("ai"),
        of("weak").alias("weak"),
        F.array_sort(F.array_union("facts", of("camera"))).alias("camera"),
        rules.generator_of(F.col("evidence")).alias("generator"),
        F.col("c2pa").isNotNull().alias("has_c2pa"),
        "c2pa",
        rules.best_source_type(F.flatten(F.transform("fields", lambda f: F.when(~f["scan"].isin("names_tool", "names_freetext"), rules.source_type_terms(f["text"])).otherwise(F.array().cast("array<string>"))))).alias("source_type"),
        F.when(F.col("jpeg").isNotNull(), jpeg_quality(F.col("jpeg.luma"), F.col("jpeg.chroma"))).alias("jpeg_quality"),
        F.col("jpeg").alias("jpeg"),
        F.concat("errors", of("error")).alias("errors"),
        "raw",
    )
    ai = F.col("ai")
    return judged.select(
        "*",
        rules.says_ai(ai).alias("says_ai"),
        rules.partial_ai(ai).alias("partial_ai"),
        rules.says_camera(F.col("camera"), ai).alias("says_camera"),
        rules.describe(ai, F.col("weak")).alias("description"),
    )
