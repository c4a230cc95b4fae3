"""Whole reports: training an ensemble, the benchmark's tables, robustness.

Each is a dictionary of small results, ready for JSON; all counting and
ranking is done by the operators.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import logit, platt, probe_score, sigmoid
from . import calibrate as C
from . import evaluation as E


def measured(table: DataFrame, thresholds: DataFrame | float, by: Sequence[str] = ()) -> DataFrame:
    """Rates at a threshold, or at each group's own, with auroc and ap."""
    by = list(by)
    if isinstance(thresholds, DataFrame):
        table = table.join(F.broadcast(thresholds), by) if by else table.crossJoin(F.broadcast(thresholds))  # a row a group
        rates = E.confusion(table, F.col("threshold"), by)
        rates = rates.join(thresholds, by) if by else rates.crossJoin(thresholds)
    else:
        rates = E.confusion(table, thresholds, by).withColumn("threshold", F.lit(float(thresholds)))
    ranked = E.ranking(table, by).select(*by, "auroc", "ap")
    return rates.join(ranked, by, "left") if by else rates.crossJoin(ranked)


def _by(rows: DataFrame, key: str) -> dict:
    return {r[key]: {k: v for k, v in r.asDict().items() if k != key} for r in rows.collect()}


def _one(rows: DataFrame) -> dict:
    r = rows.first()
    return r.asDict() if r else {}


def fused_in_folds(scored: DataFrame, calibrators: DataFrame, members: Sequence[str]) -> DataFrame:
    """(train_fold, id, y, score): every fold's training rows under the ensemble fitted on them."""
    folds = sorted(r[0] for r in calibrators.select("train_fold").distinct().collect())
    rows = C.folded_training(scored.where(F.col("detector").isin(list(members))), folds)
    z = rows.join(F.broadcast(calibrators), ["train_fold", "detector"]).select("train_fold", "id", "y", logit(platt(F.col("score"), F.col("a"), F.col("b"))).alias("z"))
    fused = z.groupBy("train_fold", "id", "y").agg(F.avg("z").alias("m"), F.count("z").alias("n"))
    return fused.where(F.col("n") == len(members)).select("train_fold", "id", "y", sigmoid(F.col("m")).alias("score"))


def fusion_report(scored: DataFrame, pool: Sequence[str], members: Sequence[str] | None = None, target: float = 0.05, most: int = C.MOST_MEMBERS) -> tuple[C.FusionModel | None, dict]:
    """The ensemble for use and the report of how it was chosen and how it does.

    scored is (id, y, generator, source, track, fold, detector, score).
    Without members they are selected greedily; without any gain there is no
    ensemble.  Held-out figures come from leaving a generator out, and from
    fitting on one track and testing on the rest; the model's own operating
    points come from its scores of all rows, so in_sample is optimistic.
    """
    calibrators = C.fold_calibrators(scored)
    z = C.oof_log_odds(scored, calibrators)
    alone = z.select("id", "y", "detector", sigmoid(F.col("z")).alias("score"))
    report: dict = {"n": scored.select("id").distinct().count(), "candidates": sorted(pool), "target_fpr": target}
    report["solo_leave_one_generator_out"] = _by(measured(alone, E.threshold_at_fpr(alone, target, ["detector"]), ["detector"]), "detector")
    history = []
    if members is None:
        history = C.greedy_select(z, sorted(pool), most)
        members = [m for m, _ in history if m is not None]
    report["members"], report["selection_history"] = list(members), [{"added": m, "auroc": a} for m, a in history]
    if not members:
        return None, report
    train = fused_in_folds(scored, calibrators, members)
    thresholds = E.threshold_at_fpr(train, target, ["train_fold"]).select(F.col("train_fold").alias("fold"), "threshold")
    pooled = C.fuse_rows(z, members, ("id", "y", "generator", "track", "fold"))
    report["logo_folds"] = _by(measured(pooled, thresholds, ["fold"]), "fold")
    at = E.threshold_at_fpr(pooled, target).first().threshold
    report["logo_pooled"] = _one(measured(pooled, at))
    report["logo_per_generator"] = _by(E.recall_by(pooled, at, "generator").select("generator", "n", F.col("share").alias("recall")), "generator")
    report["cross_track"] = {}
    tracks = sorted(r[0] for r in scored.select("track").distinct().collect())
    for track in tracks if len(tracks) > 1 else []:
        fitted = F.broadcast(C.platt_fit(scored.where(F.col("track") == track), ["detector"]))
        rows = scored.join(fitted, "detector").select("id", "y", "generator", "track", "detector", logit(platt(F.col("score"), F.col("a"), F.col("b"))).alias("z"))
        fused = C.fuse_rows(rows, members)
        at = E.threshold_at_fpr(fused.where(F.col("track") == track), target).first().threshold
        per = _by(E.recall_by(fused, at, "generator").select("generator", "n", F.col("share").alias("recall")), "generator")
        report["cross_track"][f"fit_on_{track}_test_on_rest"] = {**_one(measured(fused.where(F.col("track") != track), at)), "per_generator": per}
    model, fused = C.train_fusion(scored, members)
    report["thresholds"] = model.thresholds
    report["in_sample"] = _one(measured(fused, model.thresholds["fpr5"]))
    return model, report


def leakage_report(scored: DataFrame, bench: DataFrame, members: Sequence[str], cached: str, target: float = 0.05) -> dict:
    """Held-out figures of members and a probe, with its cached out-of-fold scores and with a probe refitted strictly in each fold.

    scored is (id, y, fold, detector, score) with the cached column as a
    detector of its own; bench is (id, y, fold, embedding).  In the strict
    form the calibrator of a fold sees the scores of that fold's probe on
    its own training rows only.  Folds whose training rows lack a class are
    left out of both.
    """
    counts = bench.where("fold IS NOT NULL").groupBy("fold").agg(F.sum(F.expr("int(y = 1)")).alias("ai"), F.sum(F.expr("int(y = 0)")).alias("real")).collect()
    ai, real = sum(r["ai"] for r in counts), sum(r["real"] for r in counts)
    folds = sorted(r["fold"] for r in counts if ai > r["ai"] and real > r["real"])
    if not folds:
        return {"cached": {}, "strict": {}}
    columns = ["id", "y", "fold", "detector", "score"]
    others = scored.where(F.col("detector").isin(list(members))).select(*columns)
    probes = C.leakage(bench, folds)
    refitted = None
    for fold, probe in probes.items():
        rows = bench.select("id", "y", "fold", F.lit(cached).alias("detector"), probe_score(F.col("embedding"), probe.weights, probe.bias).alias("score"), F.lit(fold).alias("train_fold"))
        refitted = rows if refitted is None else refitted.unionByName(rows)
    held = F.col("fold") == F.col("train_fold")
    calibrators = C.fold_calibrators(others)
    forms = {
        "cached": (others.unionByName(scored.where(F.col("detector") == cached).select(*columns)), C.fold_calibrators(scored.where(F.col("detector") == cached))),
        "strict": (others.unionByName(refitted.where(held).select(*columns)), C.platt_fit(refitted.where(~held), ["train_fold", "detector"])),
    }
    report = {}
    for form, (rows, own) in forms.items():
        z = C.oof_log_odds(rows.where(F.col("fold").isin(folds)), calibrators.unionByName(own))
        fused = C.fuse_rows(z, [*members, cached])
        report[form] = _one(measured(fused, E.threshold_at_fpr(fused, target)))
    return report


def benchmark_report(scored: DataFrame, bench: DataFrame, target: float = 0.05, least: int = 20, track: str | None = None) -> dict:
    """A line for each detector and protocol, the gaps between protocols, and recall and false positives of the best detector on crops.

    scored is (id, y, detector, protocol, score), bench (id, y, generator, source)
    and, for a report on one track or by track, the track.
    """
    if track is not None:
        bench = bench.where(F.col("track") == track)
        scored = scored.join(bench.select("id"), "id", "left_semi")
    by = ["detector", "protocol"]
    lines = measured(scored, E.threshold_at_fpr(scored, target, by), by).where(f"n >= {int(least)} AND n_ai > 0 AND n_real > 0")
    gaps = E.protocol_gaps(E.ranking(scored, by))
    tracks = F.array_sort(F.collect_set("track")) if "track" in bench.columns else F.array().cast("array<string>")
    images = bench.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("n_real"), F.count_if(F.col("y") == 1).alias("n_ai"), F.countDistinct(F.expr("if(y = 1, generator, NULL)")).alias("generators"), tracks.alias("tracks"))
    report = {"images": _one(images), "lines": [r.asDict() for r in lines.orderBy("detector", "protocol").collect()], "gaps": _by(gaps, "detector")}
    crops = [r for r in report["lines"] if r["protocol"] == "crop"]
    if not crops:
        return report | {"best": None}
    best = max(crops, key=lambda r: (r["auroc"], r["detector"]))
    rows = scored.where((F.col("detector") == best["detector"]) & (F.col("protocol") == "crop")).drop("y").join(bench.select("id", "y", "generator", "source"), "id")
    recall = E.recall_by(rows, best["threshold"], "generator")
    wrong = E.recall_by(rows, best["threshold"], "source", 0)
    return report | {"best": best["detector"], "recall": _by(recall, "generator"), "false_positives": _by(wrong, "source")}


def benchmark_markdown(report: dict, target: float = 0.05) -> str:
    """benchmark_report() as Markdown: what it stands on, then a section for each of its tables; missing figures are dashes."""

    def cell(v: object) -> str:
        return "-" if v is None or v != v else f"{v:.3f}" if isinstance(v, float) else str(v)

    def section(title: str, names: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
        return [f"## {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names), *["| " + " | ".join(map(cell, r)) + " |" for r in rows], ""]

    n = report["images"]
    lines = ["# Benchmark report", "", f"- images: {n['n']} ({n['n_real']} real, {n['n_ai']} generated)", f"- generators: {n['generators']}", f"- tracks: {', '.join(n['tracks'])}"]
    lines += [f"- thresholds: fitted on the same rows for a false positive rate of {target:.0%}", ""]
    figures = {"detector": "detector", "protocol": "protocol", "n": "n", "auroc": "AUROC", "balanced_accuracy": "bAcc", "tpr": "TPR", "fpr": "FPR"}
    lines += section("Detectors by protocol", list(figures.values()), [[r.get(f) for f in figures] for r in report["lines"]])
    for title, key, of in (("Gaps between protocols", "gaps", "detector"), ("Recall by generator", "recall", "generator"), ("False positives by source", "false_positives", "source")):
        if table := report.get(key):
            names = list(next(iter(table.values())))
            lines += section(title, [of, *names], [[k, *[table[k][c] for c in names]] for k in sorted(table)])
    return "\n".join(lines)


def robustness_report(scored: DataFrame, target: float = 0.05, clean: str = "clean") -> dict:
    """For each detector the threshold fitted on clean scores, and what every degradation does at it and at 0.5; with warnings.

    scored is (id, y, detector, degradation, score).
    """
    report: dict = {}
    for name in sorted(r[0] for r in scored.where(F.col("degradation") == clean).select("detector").distinct().collect()):
        mine = scored.where(F.col("detector") == name)
        base = mine.where(F.col("degradation") == clean)
        at = E.threshold_at_fpr(base, target).first().threshold
        allowed = int(target * base.where("y = 0").count())
        warnings = []
        if allowed <= 1:
            warnings.append(f"{allowed} real rows may be flagged: the threshold rests on one of them")
        if at > 1 - 1e-4:
            warnings.append("the threshold is in the saturated tail of the scores")
        drops = _by(E.degradation_drops(mine, at, clean).drop("detector"), "degradation")
        half = _by(E.confusion(mine, 0.5, ["degradation"]).select("degradation", "accuracy", "tpr", "fpr"), "degradation")
        report[name] = {"threshold": at, "warnings": warnings, "degradations": {d: {**v, "at_half": half[d]} for d, v in drops.items()}}
    return report
