"""Calibration, folds, ensembles and probes.

Fits iterate over sums: each Newton step is one aggregate over all groups at
once, and only a few numbers a group reach the driver.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import clean, logit, platt, sigmoid
from .evaluation import ABSTAIN_TPR, FPR_POINTS, confusion, ranking, threshold_at_fpr, threshold_at_tpr
from .ordered import hash_bucket, ranks

STEPS, SETTLED = 25, 1e-11
#: Fixed values of the greedy selection.
LEAST_GAIN, MOST_MEMBERS, LEAST_ROWS = 1e-4, 6, 50


@dataclass
class FusionModel:
    """An ensemble: its members, their calibrators (a, b), weights (1 where none is named) and operating points."""

    members: list[str]
    calibrators: dict[str, tuple[float, float]]
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    dtype: str = "unknown"

    def missing(self, scored: Sequence[str]) -> list[str]:
        """Members without a score, in the ensemble's order."""
        return [m for m in self.members if m not in set(scored)]

    def to_json(self) -> str:
        calibrators = {k: {"a": a, "b": b} for k, (a, b) in self.calibrators.items()}
        return json.dumps({"backends": self.members, "calibrators": calibrators, "weights": self.weights, "thresholds": self.thresholds, "dtype": self.dtype}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> FusionModel:
        d = json.loads(text)
        return cls(d["backends"], {k: (v["a"], v["b"]) for k, v in d["calibrators"].items()}, d.get("weights", {}), d.get("thresholds", {}), d.get("dtype", "unknown"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FusionModel:
        """From a JSON file in any store that Spark reads."""
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])


@dataclass
class Probe:
    """A linear probe on feature vectors."""

    weights: list[float]
    bias: float
    dim: int
    backbone: str = ""
    crops: int = 1
    trained_on: list[str] | None = None

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Probe:
        d = json.loads(text)
        return cls(list(d["weights"]), float(d["bias"]), int(d["dim"]), d.get("backbone", ""), int(d.get("crops", 1)), d.get("trained_on"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Probe:
        return cls.from_json(spark.read.text(path, wholetext=True).first()[0])


def platt_fit(table: DataFrame, by: Sequence[str], score: str = "score", label: str = "y") -> DataFrame:
    """(by, a, b): logistic regression of the label on the score's log-odds, a penalised by a*a/2, b free; (1, 0) of one class.

    by are string columns; there is a row for each group with a usable row.
    The table is read once: steps go over its distinct scores and their
    counts, kept by the executors.
    """
    spark, by = table.sparkSession, list(by)
    usable = table.where(clean(F.col(score)).isNotNull() & F.col(label).isNotNull())
    data = usable.groupBy(*by, logit(F.col(score)).alias("__x"), F.col(label).cast("double").alias("__y")).agg(F.count("*").alias("__n")).persist()
    classes = data.groupBy(*by).agg(F.count_distinct("__y").alias("c")).collect()
    found: dict[tuple, np.ndarray] = {tuple(r[c] for c in by): np.array([1.0, 0.0] if r["c"] < 2 else [0.0, 0.0]) for r in classes}
    moving = {tuple(r[c] for c in by) for r in classes if r["c"] == 2}
    schema = ", ".join([*[f"`{c}` string" for c in by], "a double", "b double"])
    for _ in range(STEPS):
        if not moving:
            break
        at = spark.createDataFrame([(*k, float(found[k][0]), float(found[k][1])) for k in moving], schema)
        p = 1 / (1 + F.exp(-(F.col("a") * F.col("__x") + F.col("b"))))
        joined = data.join(F.broadcast(at), by) if by else data.crossJoin(F.broadcast(at))  # a row a group
        terms = joined.select(*by, "__x", (F.col("__n") * (p - F.col("__y"))).alias("r"), (F.col("__n") * p * (1 - p)).alias("w"))
        x, r, w = F.col("__x"), F.col("r"), F.col("w")
        sums = terms.groupBy(*by).agg(F.sum(r * x), F.sum(r), F.sum(w * x * x), F.sum(w * x), F.sum(w)).collect()
        for row in sums:
            key, (ga, gb, haa, hab, hbb) = tuple(row[: len(by)]), row[len(by) :]
            a, b = found[key]
            step = np.linalg.solve(np.array([[1 + haa, hab], [hab, hbb + 1e-12]]), np.array([a + ga, gb]))
            found[key] = np.array([a, b]) - step
            if np.abs(step).max() < SETTLED:
                moving.discard(key)
    data.unpersist()
    return spark.createDataFrame([(*k, float(v[0]), float(v[1])) for k, v in sorted(found.items())], schema)


# folds


def spread(id_col: Column, seed: str = "seed") -> Column:
    """A digest that orders rows at random but the same in every engine."""
    return F.md5(F.concat(id_col.cast("string"), F.lit(f"-{seed}")))


def logo_folds(bench: DataFrame, seed: str = "seed") -> DataFrame:
    """bench with its fold: a generated row's is its generator; real rows are dealt over the sorted generators in near-equal shares.

    The first n mod k shares have one row more, in the order of a hash.
    """
    names = sorted(r[0] for r in bench.where("y = 1").select("generator").distinct().collect())
    if not names:
        return bench.select("*", F.lit(None).cast("string").alias("fold"))
    real = bench.where("y = 0").select("*", spread(F.col("id"), seed).alias("__h"))
    n, k = real.count(), len(names)
    size, more = divmod(n, k)
    ranked = ranks(real, [], hash_bucket(F.col("__h")), [F.col("__h"), F.col("id")], "__rank")
    r, edge = F.col("__rank"), more * (size + 1)
    place = F.when(r < edge, F.floor(r / (size + 1))).otherwise(more + F.floor((r - edge) / max(size, 1)))
    dealt = ranked.select(*bench.columns, F.get(F.array(*[F.lit(x) for x in names]), place.cast("int")).alias("fold"))
    return bench.where("y = 1").select("*", F.col("generator").alias("fold")).unionByName(dealt)


def folded_training(scored: DataFrame, folds: Sequence[str]) -> DataFrame:
    """A fold's training rows: those of any other fold.  folds is the short list of their names."""
    names = F.array(*[F.lit(f) for f in folds])
    return scored.select("*", F.explode(F.filter(names, lambda f: f != F.col("fold"))).alias("train_fold"))


def fold_calibrators(scored: DataFrame) -> DataFrame:
    """(train_fold, detector, a, b) fitted without the fold; scored is (id, y, fold, detector, score)."""
    folds = sorted(r[0] for r in scored.select("fold").distinct().collect() if r[0] is not None)
    return platt_fit(folded_training(scored, folds), ["train_fold", "detector"])


def oof_log_odds(scored: DataFrame, calibrators: DataFrame | None) -> DataFrame:
    """scored with z, the log-odds of the score calibrated without its own fold; without calibrators, of the raw score."""
    if calibrators is None:
        return scored.select("*", logit(F.col("score")).alias("z"))
    fitted = F.broadcast(calibrators.select(F.col("train_fold").alias("fold"), "detector", "a", "b"))  # a row a fold and member
    joined = scored.join(fitted, ["fold", "detector"])
    return joined.select(*scored.columns, logit(platt(F.col("score"), F.col("a"), F.col("b"))).alias("z"))


def fuse_rows(z: DataFrame, members: Sequence[str], keep: Sequence[str] = ("id", "y", "generator", "track")) -> DataFrame:
    """(keep, score): the mean of the members' log-odds, as a probability, for rows that every member scored."""
    keep = [c for c in keep if c in z.columns]
    some = z.where(F.col("detector").isin(list(members))).groupBy(*keep).agg(F.avg("z").alias("__z"), F.count("z").alias("__n"))
    return some.where(F.col("__n") == len(members)).select(*keep, sigmoid(F.col("__z")).alias("score"))


def greedy_select(z: DataFrame, pool: Sequence[str], most: int = MOST_MEMBERS) -> list[tuple[str | None, float]]:
    """(member, auroc) in the order of choice; at the end (None, auroc) if no candidate gained enough.

    Calibrations don't depend on the ensemble, so all are fitted before and
    a round is one job: every candidate's mean of log-odds, ranked at once.
    Ties go to the later name.
    """
    z = z.where(F.col("detector").isin(list(pool)))
    wide = z.groupBy("id", "y").pivot("detector", list(pool)).agg(F.first("z")).persist()
    chosen: list[str] = []
    history: list[tuple[str | None, float]] = []
    best = 0.0
    try:
        while len(chosen) < most and len(chosen) < len(pool):
            left = [p for p in pool if p not in chosen]
            mean = lambda c: sum((F.col(f"`{m}`") for m in chosen), F.col(f"`{c}`")) / (len(chosen) + 1)
            tries = F.array(*[F.struct(F.lit(c).alias("candidate"), sigmoid(mean(c)).alias("score")) for c in left])
            rows = wide.select("y", F.explode(tries).alias("t")).select("y", "t.*").where("score IS NOT NULL")
            table = ranking(rows, ["candidate"]).where(f"auroc IS NOT NULL AND n_ai + n_real >= {LEAST_ROWS}").collect()
            if not table:
                break
            auroc, name = max((r["auroc"], r["candidate"]) for r in table)
            if auroc <= best + LEAST_GAIN:
                history.append((None, auroc))
                break
            best = auroc
            chosen.append(name)
            history.append((name, auroc))
    finally:
        wide.unpersist()
    return history


def ablation(scored: DataFrame, members: Sequence[str], calibrators: DataFrame) -> DataFrame:
    """(n, calibrated, auroc): ensembles of the first n members, out of fold, with and without calibration."""
    parts = []
    for name, z in (("yes", oof_log_odds(scored, calibrators)), ("no", oof_log_odds(scored, None))):
        sizes = F.filter(F.array(*[F.lit(i) for i in range(1, len(members) + 1)]), lambda i: i >= F.array_position(F.array(*[F.lit(m) for m in members]), F.col("detector")))
        rows = z.where(F.col("detector").isin(list(members))).select("id", "y", "z", F.explode(sizes).alias("n"))
        fused = rows.groupBy("id", "y", "n").agg(F.avg("z").alias("m"), F.count("z").alias("c")).where("c = n").select("y", "n", sigmoid(F.col("m")).alias("score"))
        parts.append(ranking(fused, ["n"]).select("n", F.lit(name).alias("calibrated"), "auroc"))
    return parts[0].unionByName(parts[1])


def cross_track(scored: DataFrame, members: Sequence[str], fit: str, test: str, target: float = 0.05) -> DataFrame:
    """Metrics on one track of an ensemble and threshold fitted on the other."""
    fitted = F.broadcast(platt_fit(scored.where(F.col("track") == fit), ["detector"]))
    rows = scored.join(fitted, "detector").select("id", "y", "generator", "track", "detector", logit(platt(F.col("score"), F.col("a"), F.col("b"))).alias("z"))
    fused = fuse_rows(rows, members)
    threshold = threshold_at_fpr(fused.where(F.col("track") == fit), target).first()[0]
    held = fused.where(F.col("track") == test)
    table = confusion(held, threshold).crossJoin(ranking(held).select("auroc", "ap"))  # a row each
    return table.select(F.lit(fit).alias("fit"), F.lit(test).alias("test"), F.lit(threshold).alias("threshold"), "*")


def train_fusion(scored: DataFrame, members: Sequence[str], dtype: str = "unknown") -> tuple[FusionModel, DataFrame]:
    """The ensemble for use, fitted on all rows, and its scores of them, from which its operating points come."""
    calibrators = platt_fit(scored.where(F.col("detector").isin(list(members))), ["detector"])
    fitted = {r["detector"]: (r["a"], r["b"]) for r in calibrators.collect()}
    z = scored.join(F.broadcast(calibrators), "detector").select(*scored.columns, logit(platt(F.col("score"), F.col("a"), F.col("b"))).alias("z"))
    fused = fuse_rows(z, members)
    points = {name: threshold_at_fpr(fused, target).first()[0] for name, target in FPR_POINTS.items()}
    points |= {"balanced": 0.5, "abstain_low": threshold_at_tpr(fused, ABSTAIN_TPR).first()[0]}
    return FusionModel(list(members), {m: fitted[m] for m in members}, {}, points, dtype), fused


def probe_fit(table: DataFrame, features: str = "embedding", label: str = "y", strength: float = 1.0, backbone: str = "", trained_on: Sequence[str] | None = None) -> Probe:
    """Logistic regression on feature vectors, classes of equal weight, penalty |w|^2 / (2 * strength)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = {int(r[0]): r[1] for r in table.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    n = sum(counts.values())
    weight = F.when(F.col(label) == 1, n / (2.0 * counts.get(1, 1))).otherwise(n / (2.0 * counts.get(0, 1)))
    data = table.where(F.col(label).isNotNull()).select(array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"), F.col(label).cast("double").alias("label"), weight.alias("w"))
    model = LogisticRegression(regParam=1 / (strength * n), elasticNetParam=0.0, standardization=False, weightCol="w", maxIter=5000, tol=1e-10).fit(data)
    weights = [float(x) for x in model.coefficients]
    return Probe(weights, float(model.intercept), len(weights), backbone, 1, list(trained_on) if trained_on else None)


def leakage(bench: DataFrame, folds: Sequence[str], features: str = "embedding") -> Mapping[str, Probe]:
    """A probe for each fold, fitted without it: the strict form of a cached out-of-fold column."""
    return {f: probe_fit(bench.where(F.col("fold") != f), features) for f in folds}
