"""Scores, calibration, fusion and verdicts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

#: Where probabilities and log-odds are clipped.
PROBABILITY_FLOOR, LOG_ODDS_LIMIT = 1e-6, 60.0
LEAST_WEIGHT = 1e-6


def _sum(columns: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def clean(score: Column) -> Column:
    """NaN as NULL: Spark orders NaN above all numbers and finds it equal to itself."""
    return F.when(~F.isnan(score), score)


def logit(p: Column) -> Column:
    inside = F.least(F.greatest(p.cast("double"), F.lit(PROBABILITY_FLOOR)), F.lit(1 - PROBABILITY_FLOOR))
    return F.when(p.isNotNull(), F.log(inside / (1 - inside)))  # least and greatest would skip a null


def sigmoid(z: Column) -> Column:
    inside = F.least(F.greatest(z.cast("double"), F.lit(-LOG_ODDS_LIMIT)), F.lit(LOG_ODDS_LIMIT))
    return F.when(z.isNotNull(), 1 / (1 + F.exp(-inside)))


def platt(p: Column, a: Column | float, b: Column | float) -> Column:
    a, b = (x if isinstance(x, Column) else F.lit(float(x)) for x in (a, b))
    return sigmoid(a * logit(p) + b)


def fuse(scores: Mapping[str, Column], calibrators: Mapping[str, tuple[float, float]], weights: Mapping[str, float] | None = None) -> Column:
    """Weighted mean of the calibrated scores' log-odds, as a probability; a null score makes it null.

    Only members with a calibrator count; without any it is an error.
    """
    members = [m for m in calibrators if m in scores]
    if not members:
        raise ValueError("no member has a score")
    weights = {m: float((weights or {}).get(m, 1.0)) for m in members}
    total = _sum([F.lit(weights[m]) * logit(platt(scores[m], *calibrators[m])) for m in members])
    return sigmoid(total / max(sum(weights.values()), LEAST_WEIGHT))


def fuse_unweighted(scores: Sequence[Column]) -> Column:
    """Mean of raw log-odds, for want of calibrators: a ranking, not a rate."""
    return sigmoid(_sum([logit(s) for s in scores]) / len(scores))


def operating_point(thresholds: Column, name: Column | str) -> Column:
    """The named threshold of a map, else its fpr5, else 0.5."""
    name = F.lit(name) if isinstance(name, str) else name
    return F.coalesce(F.try_element_at(thresholds, name), F.try_element_at(thresholds, F.lit("fpr5")), F.lit(0.5))


def verdict(p: Column, threshold: Column, low: Column, error: Column, says_ai: Column, partial: Column, truncated: Column) -> Column:
    """In this order: an error; metadata; a truncated file; the threshold; the band above low (not low itself); real.  NaN is below any threshold."""
    p = clean(p)
    return (
        F.when(error.isNotNull() & (error != ""), "ERROR")
        .when(says_ai, F.when(partial, "AI-EDITED").otherwise("AI-GENERATED"))
        .when(truncated, "UNCERTAIN")
        .when(p >= threshold, "AI-GENERATED")
        .when(low.isNotNull() & (p > low), "UNCERTAIN")
        .otherwise("REAL")
    )


def basis(
    p: Column, threshold: Column, low: Column, error: Column, ai: Column, partial: Column, weak: Column, truncated: Column, models: Column
) -> Column:
    """Why; unlike in verdict(), a weak hint comes before truncation.  ai and weak are arrays of evidence."""
    has = lambda c: F.size(c) > 0
    said = verdict(p, threshold, low, error, F.lit(False), F.lit(False), F.lit(False))
    gap = F.abs(p - threshold)
    strength = F.when(gap < 0.1, "borderline").when(gap > 0.3, "clear").otherwise("moderate")
    whole = F.when(partial, "a generated region in an otherwise real image").otherwise("the whole image")
    return (
        F.when(error.isNotNull() & (error != ""), error)
        .when(has(ai), F.concat(F.lit("metadata describes "), whole, F.lit(": "), F.array_join(ai, "; ")))
        .when(has(weak), F.concat(F.lit("pixel ensemble; weak metadata hint ("), F.array_join(weak, "; "), F.lit(")")))
        .when(truncated, "file is truncated; the missing part decoded as flat grey, so the score would describe the padding")
        .when(said == "UNCERTAIN", F.format_string("pixel ensemble is between the operating points (%.2f < p <= %.2f)", low, threshold))
        .otherwise(F.concat(F.lit("pixel ensemble ("), strength, F.lit(", "), models.cast("string"), F.lit(" models)")))
    )


def softmax_mass(logits: Column, ai: Sequence[int], real: Sequence[int]) -> Column:
    """Share of the AI classes in the probability of those that are known; 0.5 if both have none."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    mass = lambda at: _sum([F.get(e, F.lit(i)) for i in at])
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    a, r = mass(ai) / total, mass(real) / total
    return F.when(a + r > 0, a / F.greatest(a + r, F.lit(1e-12))).otherwise(0.5)


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, v: a + v)


def probe_decision(features: Column, weights: Sequence[float], bias: float) -> Column:
    return dot(features, F.array(*[F.lit(float(w)) for w in weights])) + F.lit(float(bias))


def probe_score(features: Column, weights: Sequence[float], bias: float) -> Column:
    return sigmoid(probe_decision(features, weights, bias))


def l2_normalize(x: Column) -> Column:
    norm = F.greatest(F.sqrt(dot(x, x)), F.lit(1e-12))
    return F.transform(x, lambda v: (v.cast("double") / norm).cast("float"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper bound of a share's interval, within 0 and 1; null for n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = k / n
    middle, width = (p + z * z / (2 * n)) / (1 + z * z / n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(p.isNotNull(), F.greatest(F.lit(0.0), middle - width)), F.when(p.isNotNull(), F.least(F.lit(1.0), middle + width))


def bar(p: Column, width: int = 20) -> Column:
    """A bar of a probability; question marks for a missing one."""
    filled = F.bround(clean(p) * width).cast("int")
    return F.when(filled.isNull(), "?" * width).otherwise(F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), F.lit(width) - filled)))


def clip_text(text: Column, limit: int = 400) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.left(text, F.lit(limit)), F.lit("..."))).otherwise(text)


def fmt(x: Column, digits: int = 3) -> Column:
    """A figure of a report; a dash for a missing one."""
    return F.coalesce(F.format_string(f"%.{digits}f", clean(x)), F.lit("-"))


def crop_origins(w: Column, h: Column, side: int, n: int) -> Column:
    """Up to n origins (x, y) of square windows: the centre, the corners, then a grid, each once; none for a smaller image."""
    dx, dy = w - side, h - side
    at = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    zero = F.lit(0)
    origins = [at(F.floor(dx / 2), F.floor(dy / 2)), at(zero, zero), at(dx, zero), at(zero, dy), at(dx, dy)]
    if n > len(origins):
        k = int(-(-(n**0.5) // 1))
        steps = [(i, j) for j in range(k) for i in range(k)]
        origins += [at(F.bround(dx / max(k - 1, 1) * i), F.bround(dy / max(k - 1, 1) * j)) for i, j in steps]
    found = F.slice(F.array_distinct(F.array(*origins)), 1, n)
    return F.when((w >= side) & (h >= side), found).otherwise(F.slice(found, 1, 0))


def matched_size(w: Column, h: Column, longest: int = 512) -> Column:
    """(width, height) scaled to the longest side, never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(w, h))
    side = lambda x: F.greatest(F.lit(1), F.bround(x * scale).cast("int"))
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def sniff(content: Column) -> Column:
    """The container format that the first bytes name, or an empty string."""
    starts = lambda at, text: F.substring(content, at, len(text) // 2) == F.unhex(F.lit(text))
    return (
        F.when(starts(1, "89504E470D0A1A0A"), "PNG")
        .when(starts(1, "FFD8"), "JPEG")
        .when(starts(1, "52494646") & starts(9, "57454250"), "WEBP")
        .when(starts(5, "66747970"), "BMFF")
        .when(starts(1, "49492A00") | starts(1, "4D4D002A"), "TIFF")
        .otherwise("")
    )


# The example quantisation tables of the JPEG standard (Annex K), in natural order.
IJG_LUMA = (
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
)
IJG_CHROMA = (
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
)


def ijg_table(base: Sequence[int], quality: Column) -> Column:
    """The 64 entries that a quality makes of a base table."""
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)
    entries = F.array(*[F.lit(b) for b in base])
    return F.transform(entries, lambda b: F.least(F.lit(255), F.greatest(F.lit(1), F.floor((b * scale + 50) / 100))).cast("int"))


def jpeg_quality(luma: Column, chroma: Column) -> Column:
    """(estimated, exact) quality of a file's two tables; exact is null unless every entry is a default one.

    The scale comes from the upper median of the entries that aren't
    saturated; of the qualities next to it the one of the least difference
    is taken.  A luma table of ones is quality 100.
    """
    base = F.array(*[F.lit(b) for b in IJG_LUMA])
    none = F.lit(None).cast("int")
    both = F.size(chroma) == 64
    apart = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)

    def tried(q: Column) -> Column:
        err = apart(luma, ijg_table(IJG_LUMA, q)) + F.when(both, apart(chroma, ijg_table(IJG_CHROMA, q))).otherwise(F.lit(0).cast("long"))
        return F.struct(err.alias("err"), q.alias("q"))

    def nearest(scales: Column) -> Column:
        s = F.get(scales, F.floor(F.size(scales) / 2).cast("int"))
        guess = F.bround(F.when(s > 100, 5000.0 / s).otherwise((200.0 - s) / 2)).cast("int")
        held = F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.least(F.lit(100), F.greatest(F.lit(1), guess + d)))
        found = let(F.array_min(F.transform(held, tried)), lambda b: F.struct(b["q"].alias("estimated"), F.when(b["err"] == 0, b["q"]).alias("exact")))
        return F.when(F.size(scales) > 0, found).otherwise(F.struct(none.alias("estimated"), none.alias("exact")))

    pairs = F.filter(F.arrays_zip(luma.alias("t"), base.alias("b")), lambda p: (p["t"] > 1) & (p["t"] < 255))
    scales = F.array_sort(F.transform(pairs, lambda p: (100.0 * p["t"] - 50) / p["b"]))
    ones = F.struct(F.lit(100).alias("estimated"), F.when(~both | F.forall(chroma, lambda t: t == 1), 100).alias("exact"))
    return F.when(F.size(luma) != 64, F.struct(none.alias("estimated"), none.alias("exact"))).when(F.forall(luma, lambda t: t == 1), ones).otherwise(let(scales, nearest))
