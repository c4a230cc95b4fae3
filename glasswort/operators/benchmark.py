"""Building a benchmark from sources of files, and scoring it by every scorer.

Images are rows, not files: a Parquet shard a protocol, in the layout that
sources.tables.read_shard_images() reads, beside a manifest.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import MANIFEST, write_manifest, write_scores
from . import images
from .sampling import admit
from .scoring import score_files

SIDE, LONGEST, QUALITY = 224, 512, 90
_MADE = "width int, height int, n_frames int, format string, matched binary, crop binary"


def encode_jpeg(rgb) -> bytes:
    """JPEG without chroma subsampling; needs Pillow."""
    held = io.BytesIO()
    images._pillow().fromarray(rgb).save(held, format="JPEG", quality=QUALITY, subsampling=0, optimize=False)
    return held.getvalue()


def _encoder(kind: str):
    return {"jpeg": encode_jpeg, "png": images.encode_png}[kind]


def decode_items(items: DataFrame, side: int = SIDE, kind: str = "jpeg") -> DataFrame:
    """items (with content) with size, frames, format and the matched and crop versions; nulls where a file doesn't decode."""
    keep = [c for c in items.columns if c not in ("width", "height", "n_frames", "format", "matched", "crop")]
    at = keep.index("content")
    names = ["width", "height", "n_frames", "format", "matched", "crop"]

    def one(data: bytes):
        try:
            d = images.decode(data)
        except images.ImageLoadError:
            return None, None, None, None, None, None
        h, w = d.pixels.shape[:2]
        if d.is_animated or min(w, h) < side:
            return w, h, d.n_frames, d.format, None, None
        scale = min(1.0, LONGEST / max(w, h))
        small = d.pixels if scale == 1.0 else images.resize(d.pixels, round(w * scale), round(h * scale))
        encode = _encoder(kind)
        return w, h, d.n_frames, d.format, encode(small), encode(images.centre_crop(d.pixels, side))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.binary())
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                part = batch.slice(start, 16)
                made = zip(*[one(x.as_py() or b"") for x in part.column(at)], strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c, k) for c, k in zip(made, kinds, strict=True)]], names=[*keep, *names])

    types = ", ".join(f"`{c}` {items.schema[c].dataType.simpleString()}" for c in keep)
    return items.select(*keep).mapInArrow(run, f"{types}, {_MADE}")


def build(items: DataFrame, out: str, per_source: int = 300, side: int = SIDE, kind: str = "jpeg") -> DataFrame:
    """Writes out/manifest and out/images/protocol=...; returns the manifest.

    items is (track, source, label, generator, source_pos, item_pos, stem,
    content).  Files are admitted by sampling.admit(): whole content once
    over all sources, in order of sources, per_source of each.
    """
    spark = items.sparkSession
    suffix = ".jpg" if kind == "jpeg" else ".png"
    digested = items.withColumn("digest", F.sha2("content", 256))
    decoded = decode_items(digested, side, kind)
    path = f"{out}/decoded"
    decoded.write.mode("overwrite").parquet(path)  # decoded once; admission goes source by source
    kept = admit(spark.read.schema(decoded.schema).parquet(path), per_source, side)
    base = F.regexp_replace("stem", r"\.[^.]*$", "")
    native = F.when(F.upper("format").isin("PNG", "TIFF", "BMP", "WEBP"), ".png").otherwise(".jpg")
    named = kept.select("*", base.alias("__base"))
    at = lambda protocol, end: F.concat(F.lit(f"{protocol}/"), "label", F.lit("/"), "source", F.lit("/"), "__base", end)
    rows = named.select(
        "*", F.concat("source", F.lit("/"), "__base").alias("id"), at("native", native).alias("p_native"), at("matched", F.lit(suffix)).alias("p_matched"), at("crop", F.lit(suffix)).alias("p_crop")
    )
    versions = F.array(*[F.struct(F.lit(p).alias("protocol"), F.struct(F.col(c).alias("bytes"), F.col(f"p_{p}").alias("path")).alias("image")) for p, c in (("native", "content"), ("matched", "matched"), ("crop", "crop"))])
    rows.select("id", F.explode(versions).alias("v")).select("id", "v.*").write.mode("overwrite").partitionBy("protocol").parquet(f"{out}/images")
    manifest = rows.select(
        "id", "track", "label", "source", "generator", F.col("p_native").alias("native"), F.col("p_matched").alias("matched"), F.col("p_crop").alias("crop"), "format", "width", "height", F.left("digest", F.lit(16)).alias("sha256")
    )
    write_manifest(manifest, f"{out}/manifest")
    return spark.read.schema(MANIFEST).csv(f"{out}/manifest", header=True)


def score(out: str, manifest: DataFrame, scorers: Sequence[str], protocols: Sequence[str], to: str) -> dict[tuple[str, str], str]:
    """Scores of every scorer on every protocol, written to `to`; (scorer, protocol) -> what went wrong, for those that failed."""
    failed = {}
    for name in scorers:
        for protocol in protocols:
            held = manifest.sparkSession.read.parquet(f"{out}/images").where(F.col("protocol") == protocol).select("id", F.col("image.bytes").alias("content"))
            try:
                found = score_files(held, [name]).where("error IS NULL").select("id", F.lit(name).alias("detector"), F.lit(protocol).alias("protocol"), F.try_element_at("scores", F.lit(name)).alias("score"))
                write_scores(found, to)
            except Exception as e:  # noqa: BLE001 - one scorer must not stop the others
                failed[name, protocol] = f"{type(e).__name__}: {e}"
    return failed
