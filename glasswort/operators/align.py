"""Joins of manifests, scores, features, calibrators and labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clean
from .sampling import last_of_each


def align_scores(manifest: DataFrame, scores: DataFrame, by: Sequence[str] = ("detector",)) -> DataFrame:
    """A row for each manifest id and each (by) of scores; score null where there is none or it is NaN.

    Of several scores of an id the last by pos counts, if scores has pos.
    """
    by = list(by)
    scores = scores.select(*[c for c in scores.columns if c != "score"], clean(F.col("score")).alias("score"))
    if "pos" in scores.columns:
        scores = last_of_each(scores, ["id", *by], ["pos"])
    each = manifest.crossJoin(F.broadcast(scores.select(*by).distinct()))  # a few names
    return each.join(scores.select("id", *by, "score"), ["id", *by], "left")


def complete(aligned: DataFrame, by: Sequence[str] = ("detector",)) -> DataFrame:
    """Rows of those (by) that scored every id."""
    whole = aligned.groupBy(*by).agg(F.count_if(F.col("score").isNull()).alias("gaps")).where("gaps = 0").select(*by)
    return aligned.join(F.broadcast(whole), list(by), "left_semi")


def with_features(manifest: DataFrame, features: DataFrame, backbone: str) -> DataFrame:
    """manifest with the backbone's feature vectors; an error if one is missing."""
    mine = features.where(F.col("backbone") == backbone).select("id", "features")
    joined = manifest.join(mine, "id", "left")
    gap = F.raise_error(F.concat(F.lit("no features for id "), F.col("id").cast("string"))).cast(mine.schema["features"].dataType)
    return joined.select(*manifest.columns, F.coalesce(F.col("features"), gap).alias("features"))


def to_do(rows: DataFrame, cached: DataFrame) -> DataFrame:
    """Rows whose id isn't cached yet."""
    return rows.join(cached.select("id"), "id", "left_anti")


def missing(wanted: DataFrame, scored: DataFrame, key: str = "detector") -> DataFrame:
    """Members (pos, key) without a score, in the ensemble's order."""
    return wanted.join(scored.select(key).distinct(), key, "left_anti").select("pos", key)


def resolve_labels(labels: DataFrame, wanted: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, side, ids): a model's label ids (id, label) for each side's wanted words (side, word).

    Labels are trimmed and lower-cased.  Words that equal a label win; only
    where none does, words that a label contains or is part of count.
    """
    by = list(by)
    have = labels.select(*by, "id", F.lower(F.trim(F.col("label").cast("string"))).alias("__label"))
    want = wanted.select(*by, "side", F.lower("word").alias("__word"))
    met = have.join(want, by)
    same, near = F.col("__label") == F.col("__word"), F.contains(F.col("__label"), F.col("__word")) | F.contains(F.col("__word"), F.col("__label"))
    found = met.where(near).groupBy(*by, "side").agg(F.collect_set(F.when(same, F.col("id"))).alias("exact"), F.collect_set("id").alias("any"))
    return found.select(*by, "side", F.array_sort(F.when(F.size("exact") > 0, F.col("exact")).otherwise(F.col("any"))).alias("ids"))


def polarity_errors(resolved: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """(by, error) of models whose sides can't be told: a side without ids, or one id on both."""
    sides = resolved.groupBy(*by).pivot("side", ["ai", "real"]).agg(F.first("ids"))
    error = F.when(F.col("ai").isNull() | F.col("real").isNull(), "labels can't be mapped").when(F.arrays_overlap("ai", "real"), "label sets overlap")
    return sides.select(*by, error.alias("error")).where("error IS NOT NULL")


def unknown_names(wanted: Sequence[str], known: Sequence[str]) -> list[str]:
    return [w for w in wanted if w not in set(known)]


def resolve_names(wanted: Sequence[str], known: Sequence[str], default: Sequence[str], always: str | None = None) -> list[str]:
    """Names for `all`, `default` or a list, with `always` in front; an error for unknown ones."""
    names = list(known) if list(wanted) == ["all"] else list(default) if list(wanted) == ["default"] else list(wanted)
    if unknown := unknown_names(names, known):
        raise KeyError(f"unknown: {', '.join(unknown)}; known: {', '.join(sorted(known))}")
    if always is not None:
        names = [always, *(n for n in names if n != always)]
    return list(dict.fromkeys(names))


def check_uploads(files: DataFrame, request: str = "request", most: int = 16, largest: int = 32 << 20) -> DataFrame:
    """(request, files, status, problem) of requests: (request, name, content); status 200 where they may be scored.

    A request without files is a row whose name and content are null.
    """
    size = F.length("content")
    sums = files.groupBy(request).agg(F.count("name").alias("files"), F.coalesce(F.max(size), F.lit(0)).alias("__most"), F.count_if(F.col("name").isNotNull() & (F.coalesce(size, F.lit(0)) == 0)).alias("__empty"))
    problem: Column = (
        F.when(F.col("files") == 0, "no files")
        .when(F.col("files") > most, "too many files")
        .when(F.col("__most") > largest, "file too large")
        .when(F.col("__empty") > 0, "empty file")
    )
    status = F.when(F.col("files") == 0, 400).when((F.col("files") > most) | (F.col("__most") > largest), 413).when(F.col("__empty") > 0, 400).otherwise(200)
    return sums.select(request, "files", status.alias("status"), problem.alias("problem"))
