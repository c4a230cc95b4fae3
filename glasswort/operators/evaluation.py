"""Evaluation of scores against labels.

Labels are 1 (generated) and 0 (real); a row is called generated when its
score reaches the threshold.  Rows without a score or label take no part.
Every measure takes group columns, and none moves a group's rows to one
task: rows are first summed up by distinct score, in partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import clean, wilson
from .ordered import sums_before, unit_bucket


def _usable(table: DataFrame, score: str, label: str) -> DataFrame:
    return table.where(clean(F.col(score)).isNotNull() & F.col(label).isNotNull())


def confusion(table: DataFrame, threshold: Column | float, by: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    """n, n_ai, n_real, tp, fp, tn, fn and the rates of a threshold; rates divide by one at least, so an empty class has rate 0."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    hit, ai = F.col(score) >= threshold, F.col(label) == 1
    counts = _usable(table, score, label).groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(ai).alias("n_ai"),
        F.count_if(~ai).alias("n_real"),
        F.count_if(hit & ai).alias("tp"),
        F.count_if(hit & ~ai).alias("fp"),
        F.count_if(~hit & ~ai).alias("tn"),
        F.count_if(~hit & ai).alias("fn"),
    )
    rate = lambda a, b: F.col(a) / F.greatest(F.col(a) + F.col(b), F.lit(1))
    rates = counts.select(
        "*", F.when(F.col("n") > 0, (F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), rate("tp", "fn").alias("tpr"), rate("fp", "tn").alias("fpr"), rate("tp", "fp").alias("precision")
    )
    return rates.select("*", (0.5 * (F.col("tpr") + 1 - F.col("fpr"))).alias("balanced_accuracy"))


def score_groups(table: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    """A row for each distinct score of a group: pos, neg, pos_before and neg_before of the lower scores, n_ai and n_real of the group.

    One scan of table: the group's totals come from the sums of its buckets.
    """
    counted = _usable(table, score, label).groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )
    return sums_before(counted, by, unit_bucket(F.col(score)), [F.col(score)], {"pos_before": "pos", "neg_before": "neg"}, {"n_ai": "pos", "n_real": "neg"})


def ranking(table: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    """auroc (ties count half) and ap (summed over distinct thresholds); null where a class is missing."""
    groups = score_groups(table, by, score, label)
    won = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)
    above = F.col("n_ai") - F.col("pos_before")
    gained = F.col("pos") * above / (above + F.col("n_real") - F.col("neg_before"))
    sums = groups.groupBy(*by).agg(F.first("n_ai").alias("n_ai"), F.first("n_real").alias("n_real"), F.sum(won).alias("won"), F.sum(gained).alias("gained"))
    both = (F.col("n_ai") > 0) & (F.col("n_real") > 0)
    return sums.select(
        *by, "n_ai", "n_real", F.when(both, F.col("won") / (F.col("n_ai") * F.col("n_real"))).alias("auroc"), F.when(both, F.col("gained") / F.col("n_ai")).alias("ap")
    )


def _next_up(x: Column) -> Column:
    """The next double towards 1, which 1 itself is."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextAfter"), x.cast("double"), F.lit(1.0)).cast("double")


def _at_fpr(target: float, score: str) -> Column:
    """Over the rows of score_groups(): the k-th largest real score; see threshold_at_fpr()."""
    k = F.floor(F.lit(float(target)) * F.col("n_real"))
    kth = F.max(F.when((F.col("neg") > 0) & (k > 0) & (F.col("n_real") - F.col("neg_before") >= k), F.col(score)))
    top = F.max(F.when(F.col("neg") > 0, F.col(score)))
    return F.coalesce(kth, F.when(top.isNotNull(), _next_up(F.coalesce(top, F.lit(0.5)))), F.lit(0.5))  # reflect() takes no null


def _at_tpr(target: float, score: str) -> Column:
    k = F.least(F.greatest(F.ceil(F.lit(float(target)) * F.col("n_ai")), F.lit(1)), F.col("n_ai"))
    return F.coalesce(F.max(F.when((F.col("pos") > 0) & (F.col("n_ai") - F.col("pos_before") >= k), F.col(score))), F.lit(0.5))


def threshold_at_fpr(table: DataFrame, target: float, by: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    """The k-th largest real score, k the share target of all, rounded down; of k = 0 the next number above all; 0.5 without any.

    Rows tied with the k-th are flagged with it, so a rate may exceed the target.
    """
    return score_groups(table, by, score, label).groupBy(*by).agg(_at_fpr(target, score).alias("threshold"))


def threshold_at_tpr(table: DataFrame, target: float, by: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    """The k-th largest generated score, k the share target of all, rounded up, one at least; 0.5 without any."""
    return score_groups(table, by, score, label).groupBy(*by).agg(_at_tpr(target, score).alias("threshold"))


#: Operating points by target false positive rate, and the target recall of the band's lower edge.
FPR_POINTS = {"fpr1": 0.01, "fpr5": 0.05, "fpr10": 0.10}
ABSTAIN_TPR = 0.98


def operating_points(table: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    """(by, point, threshold): fpr1, fpr5, fpr10, balanced and abstain_low, all from one pass over the scores."""
    found = {name: _at_fpr(target, score) for name, target in FPR_POINTS.items()} | {"abstain_low": _at_tpr(ABSTAIN_TPR, score)}
    wide = score_groups(table, by, score, label).groupBy(*by).agg(*[c.alias(f"__{name}") for name, c in found.items()])
    points = [F.struct(F.lit(name).alias("point"), F.col(f"__{name}").alias("threshold")) for name in found]
    points.append(F.struct(F.lit("balanced").alias("point"), F.lit(0.5).alias("threshold")))
    return wide.select(*by, F.explode(F.array(*points)).alias("__p")).select(*by, "__p.point", "__p.threshold")


def recall_by(table: DataFrame, threshold: Column | float, group: str, of: int = 1, score: str = "score", label: str = "y") -> DataFrame:
    """n, hits, share and its interval for each group's rows of class `of`: recall of generators, false positives of real sources."""
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    counts = _usable(table, score, label).where(F.col(label) == of).groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(F.col(score) >= threshold).alias("hits")
    )
    low, high = wilson(F.col("hits"), F.col("n"))
    return counts.select("*", (F.col("hits") / F.col("n")).alias("share"), low.alias("low"), high.alias("high"))


def score_means(table: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    of = lambda c: F.avg(F.when(F.col(label) == c, F.col(score)))
    return _usable(table, score, label).groupBy(*by).agg(F.avg(score).alias("mean"), of(1).alias("mean_ai"), of(0).alias("mean_real"))


def brier(table: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "y") -> DataFrame:
    return _usable(table, score, label).groupBy(*by).agg(F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))


def protocol_gaps(rank: DataFrame, protocols: Sequence[str] = ("native", "matched", "crop")) -> DataFrame:
    """A row for each detector that has all protocols: their auroc, and what container and context add."""
    wide = rank.groupBy("detector").pivot("protocol", list(protocols)).agg(F.first("auroc"))
    for p in protocols:
        wide = wide.where(F.col(p).isNotNull())
    return wide.select("*", (F.col("native") - F.col("matched")).alias("container_gap"), (F.col("matched") - F.col("crop")).alias("context_gap"))


def degradation_drops(scored: DataFrame, threshold: Column | float, clean_name: str = "clean") -> DataFrame:
    """auroc, tpr and means of each degradation, and how far auroc and tpr drop from the clean one."""
    by = ["detector", "degradation"]
    table = confusion(scored, threshold, by).join(ranking(scored, by).select(*by, "auroc"), by).join(score_means(scored, by), by)
    base = table.where(F.col("degradation") == clean_name).select("detector", F.col("auroc").alias("c_auroc"), F.col("tpr").alias("c_tpr"))
    joined = table.join(base, "detector")
    return joined.select(
        *by, "auroc", "tpr", "fpr", "mean", "mean_ai", "mean_real", (F.col("c_auroc") - F.col("auroc")).alias("auroc_drop"), (F.col("c_tpr") - F.col("tpr")).alias("tpr_drop")
    )


def report(scored: DataFrame, threshold: float = 0.5, least: int = 20) -> DataFrame:
    """A line for each detector and protocol with `least` usable rows or more and both classes."""
    by = ["detector", "protocol"]
    table = confusion(scored, threshold, by).where(f"n >= {int(least)} AND n_ai > 0 AND n_real > 0")
    return table.join(ranking(scored, by).select(*by, "auroc", "ap"), by)
