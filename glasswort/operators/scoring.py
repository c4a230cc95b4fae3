"""Scoring files: scorers in Arrow batches, then calibration, fusion and verdicts as columns.

A scorer has a name and score_batch(images) -> scores in [0, 1]; images are
RGB arrays.  Scorers are made once a Python worker by the factory that the
registry holds, since models are large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources.tables import read_cache
from . import images
from .align import resolve_labels, to_do
from .calibrate import FusionModel
from .provenance import provenance

BATCH = 8


@dataclass(frozen=True)
class DetectorSpec:
    name: str
    repo: str
    ai_labels: tuple[str, ...]
    real_labels: tuple[str, ...]
    license: str
    general_purpose: bool = True
    kind: str = "hf"
    processor_repo: str | None = None


# Published detectors, their class labels and licences.
DETECTORS = {
    d.name: d
    for d in (
        DetectorSpec("organika-sdxl", "Organika/sdxl-detector", ("artificial",), ("human",), "cc-by-nc-3.0"),
        DetectorSpec("umm-maybe", "umm-maybe/AI-image-detector", ("artificial",), ("human",), "cc-by-4.0"),
        DetectorSpec("ateeqq-siglip", "Ateeqq/ai-vs-human-image-detector", ("ai",), ("hum", "human"), "apache-2.0"),
        DetectorSpec("haywoodsloan", "haywoodsloan/ai-image-detector-deploy", ("artificial",), ("real",), "apache-2.0"),
        DetectorSpec("smogy", "Smogy/SMOGY-Ai-images-detector", ("artificial",), ("human",), "cc-by-nc-4.0"),
        DetectorSpec("dima806-vit", "dima806/ai_vs_human_generated_image_detection", ("ai-generated",), ("human",), "apache-2.0"),
        DetectorSpec("nyuad", "NYUAD-ComNets/NYUAD_AI-generated_images_detector", ("dalle", "sd"), ("real",), "apache-2.0", processor_repo="google/vit-base-patch16-224-in21k"),
        DetectorSpec("prithiv-deepfake", "prithivMLmods/Deep-Fake-Detector-v2-Model", ("deepfake",), ("realism",), "apache-2.0", general_purpose=False),
        DetectorSpec("sadra-sdxl", "SadraCoding/SDXL-Deepfake-Detector", ("artificial",), ("human",), "mit", processor_repo="google/vit-base-patch16-224-in21k"),
        DetectorSpec("mmanikanta-swin", "mmanikanta/SWIN-AI-Image-Detector", ("fake",), ("real",), "apache-2.0"),
        DetectorSpec("mmanikanta-convnext", "mmanikanta/ConvNeXT_AI_image_detector", ("fake",), ("real",), "apache-2.0"),
        DetectorSpec("commforensics384", "OwensLab/commfor-model-384", ("ai",), ("real",), "mit", kind="commforensics"),
        DetectorSpec("commforensics224", "OwensLab/commfor-model-224", ("ai",), ("real",), "mit", kind="commforensics"),
        DetectorSpec("aiornot-siglip2", "prithivMLmods/AIorNot-SigLIP2", ("ai",), ("not ai", "not_ai", "real"), "apache-2.0"),
    )
}


def detector_table(spark: SparkSession) -> DataFrame:
    """The registry as a table of a few rows."""
    rows = [(i, d.name, d.repo, list(d.ai_labels), list(d.real_labels), d.license, d.general_purpose, d.kind) for i, d in enumerate(DETECTORS.values())]
    return spark.createDataFrame(rows, "pos long, name string, repo string, ai_labels array<string>, real_labels array<string>, license string, general_purpose boolean, kind string")


def default_detectors(spark: SparkSession, include_specialised: bool = False) -> DataFrame:
    return detector_table(spark).where(F.col("general_purpose") | F.lit(include_specialised))


class Brightness:
    """A stand-in for a model: the mean of the pixels, as a share."""

    name = "brightness"

    def score_batch(self, batch: Sequence[np.ndarray]) -> np.ndarray:
        return np.array([float(x.mean()) / 255 for x in batch])


FACTORIES: dict[str, Callable[[], object]] = {"brightness": Brightness}


def class_sides(spark: SparkSession, name: str, labels: Mapping[int, str], missing: Sequence[str] = ()) -> tuple[list[int], list[int]]:
    """The class ids of a detector's checkpoint that mean generated, and those that mean real.

    labels are the checkpoint's own, missing the parameters that it lacks.
    Refuses a checkpoint without weights for all its parameters (position
    ids aside), one whose labels don't name both sides, and one whose sides
    share a label.
    """
    if name not in DETECTORS:
        raise KeyError(f"unknown detector: {name}")
    if gaps := [m for m in missing if not m.endswith("position_ids")]:
        raise RuntimeError(f"{name}: the checkpoint has no weights for {len(gaps)} parameters, such as {gaps[0]}")
    have = spark.createDataFrame([(name, i, str(t)) for i, t in labels.items()], "model string, id int, label string")
    want = detector_table(spark).where(F.col("name") == name).select(F.col("name").alias("model"), F.explode(F.create_map(F.lit("ai"), "ai_labels", F.lit("real"), "real_labels")).alias("side", "words"))
    resolved = resolve_labels(have, want.select("model", "side", F.explode("words").alias("word")))
    sides = {r["side"]: r["ids"] for r in resolved.collect()}
    if len(sides) < 2:
        raise RuntimeError(f"{name}: labels can't be mapped: {dict(labels)}")
    if set(sides["ai"]) & set(sides["real"]):
        raise RuntimeError(f"{name}: label sets overlap: {dict(labels)}")
    return sides["ai"], sides["real"]


def needed_detectors(spark: SparkSession, members: DataFrame | None = None, every: bool = False) -> DataFrame:
    """The registry's rows that a setup needs: of members (name), of all, or those for general purposes."""
    if members is None:
        return default_detectors(spark, every)
    return detector_table(spark).join(members.select("name"), "name", "left_semi")


def register(name: str, factory: Callable[[], object]) -> None:
    """Makes a scorer known; the factory runs in Python workers, so it must be importable there."""
    FACTORIES[name] = factory


def score_files(files: DataFrame, scorers: Sequence[str], batch: int = BATCH, degradation: str = "clean") -> DataFrame:
    """files with scores map<string,double>, truncated, error, width and height; a bad file has an error, and never fails others.

    files has a content column, and an error column where reading failed.
    Rows may repeat.  A scorer is asked for `batch` images at a time.
    """
    unknown = [s for s in scorers if s not in FACTORIES]
    if unknown:
        raise KeyError(f"unknown scorers: {unknown}")
    made = {s: FACTORIES[s] for s in scorers}
    keep = [c for c in files.columns if c not in ("error", "scores", "truncated", "width", "height")]
    at = keep.index("content")
    held = files.select(*keep, (F.col("error") if "error" in files.columns else F.lit(None).cast("string")).alias("error"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {name: make() for name, make in made.items()}
        change = images.degradation(degradation)
        for records in batches:
            for start in range(0, records.num_rows, batch):
                part = records.slice(start, batch)
                n = part.num_rows
                errors = part.column(len(keep)).to_pylist()
                decoded: list[images.Decoded | None] = [None] * n
                for i, content in enumerate(part.column(at)):
                    if errors[i] is None:
                        try:
                            decoded[i] = images.decode(content.as_py() or b"")
                        except Exception as e:  # noqa: BLE001 - kept with the file
                            errors[i] = f"{type(e).__name__}: {e}"
                good = [i for i in range(n) if decoded[i] is not None]
                results: list[list[tuple[str, float]] | None] = [None] * n
                for i in good:
                    results[i] = []
                if good:
                    pixels = [change(decoded[i].pixels) for i in good]
                    for name, scorer in loaded.items():
                        for i, score in zip(good, scorer.score_batch(pixels), strict=True):
                            results[i].append((name, float(score)))
                size = [d.pixels.shape[:2] if d else (None, None) for d in decoded]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[: len(keep)],
                        pa.array(errors, pa.string()),
                        pa.array(results, pa.map_(pa.string(), pa.float64())),
                        pa.array([bool(d and d.truncated) for d in decoded], pa.bool_()),
                        pa.array([s[1] for s in size], pa.int64()),
                        pa.array([s[0] for s in size], pa.int64()),
                    ],
                    names=[*keep, "error", "scores", "truncated", "width", "height"],
                )

    types = "".join(f"`{c}` {files.schema[c].dataType.simpleString()}, " for c in keep)
    return held.mapInArrow(run, types + "error string, scores map<string,double>, truncated boolean, width long, height long")


def scores_for(files: DataFrame, scorer: str, cache: str, batch: int = BATCH, force: bool = False, degradation: str = "clean") -> DataFrame:
    """(id, score) of all files: those not in the cache are scored and added to it first."""
    spark = files.sparkSession
    left = files if force else to_do(files, read_cache(spark, cache))
    new = score_files(left, [scorer], batch, degradation).select("id", F.try_element_at("scores", F.lit(scorer)).alias("score")).where("score IS NOT NULL")
    bad = F.isnan("score") | (F.abs(F.col("score")) == float("inf"))
    new = new.select("id", F.when(bad, F.raise_error(F.lit("score isn't finite"))).otherwise(F.col("score")).cast("double").alias("score"))
    new.write.mode("overwrite" if force else "append").parquet(cache)
    return read_cache(spark, cache).join(files.select("id"), "id", "left_semi")


def predictions(files: DataFrame, scorers: Sequence[str], model: FusionModel | None = None, point: str = "fpr5", use_metadata: bool = True, abstain: bool = True, batch: int = BATCH) -> DataFrame:
    """A row for each row of files (ordinal, path, content, error): verdict, basis, p_ai, scores and metadata.

    Without a model raw log-odds are averaged and the threshold is 0.5.
    """
    scored = score_files(files, scorers, batch)
    if use_metadata:
        found = provenance(scored)
    else:
        empty = F.array().cast("array<string>")
        found = scored.select(*[c for c in scored.columns if c != "content"], empty.alias("ai"), empty.alias("weak"), F.lit(None).cast("string").alias("generator"), *[F.lit(False).alias(c) for c in ("says_ai", "partial_ai", "says_camera", "has_c2pa")])
    raw = {s: F.try_element_at("scores", F.lit(s)) for s in scorers}
    if model is None:
        p, calibrated, threshold, low = S.fuse_unweighted(list(raw.values())), raw, 0.5, None
    else:
        used = {m: c for m, c in model.calibrators.items() if m in raw and m in model.members}
        p, calibrated = S.fuse(raw, used, model.weights), {m: S.platt(raw[m], *c) for m, c in used.items()}
        threshold, low = model.thresholds.get(point, model.thresholds.get("fpr5", 0.5)), model.thresholds.get("abstain_low")
    limit, edge = F.lit(float(threshold)), F.lit(low if abstain else None).cast("double")
    told = found.select("*", p.alias("p_ai"))
    args = (F.col("p_ai"), limit, edge, F.col("error"))
    per_model = F.map_from_arrays(F.array(*[F.lit(m) for m in sorted(calibrated)]), F.array(*[F.round(calibrated[m], 4) for m in sorted(calibrated)]))
    return told.select(
        *[c for c in ("ordinal", "path") if c in told.columns],
        S.verdict(*args, F.col("says_ai"), F.col("partial_ai"), F.col("truncated")).alias("verdict"),
        F.round("p_ai", 4).alias("p_ai"),
        F.round(limit, 4).alias("threshold"),
        F.round(edge, 4).alias("low_threshold"),
        S.basis(*args, F.col("ai"), F.col("partial_ai"), F.col("weak"), F.col("truncated"), F.lit(len(calibrated))).alias("basis"),
        per_model.alias("per_model"),
        F.col("says_ai").alias("metadata_says_ai"),
        F.col("partial_ai").alias("metadata_partial_ai"),
        F.col("weak").alias("metadata_weak_hints"),
        F.col("generator").alias("metadata_generator"),
        F.col("says_camera").alias("metadata_camera_exif"),
        "has_c2pa",
        "truncated",
        "error",
    )


def verdict_table(predicted: DataFrame) -> DataFrame:
    """A line for each file, with a bar."""
    p: Column = F.col("p_ai")
    return predicted.select("ordinal", "path", "verdict", S.bar(p).alias("bar"), S.fmt(p).alias("p"), "basis")
