"""Measures against NumPy written out by hand, with ties, empty classes and missing scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasswort.functions import scores as S
from glasswort.operators import calibrate as C
from glasswort.operators import evaluation as E
from glasswort.operators import sampling as P
from glasswort.operators.ordered import ranks, sums_before, unit_bucket


def table(spark, scores, labels):
    return spark.createDataFrame([(float(s) if s is not None else None, int(y)) for s, y in zip(scores, labels, strict=True)], "score double, y int")


def separable(n=400, seed=0):
    rng = np.random.default_rng(seed)
    z = np.concatenate([rng.normal(-1.5, 1, n), rng.normal(1.5, 1, n)])
    return 1 / (1 + np.exp(-z)), np.repeat([0, 1], n)


def auroc(s, y):
    pos, neg = s[y == 1], s[y == 0]
    return float(((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)))


def ap(s, y):
    total, before = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, n = (y[s >= t] == 1).sum(), (s >= t).sum()
        total += (tp - before) / (y == 1).sum() * tp / n
        before = tp
    return float(total)


@pytest.mark.parametrize("digits", [1, 2, 6])
def test_ranking(spark, digits):
    s, y = separable()
    s = np.round(s, digits)
    r = E.ranking(table(spark, s, y)).first()
    assert math.isclose(r.auroc, auroc(s, y), abs_tol=1e-12) and math.isclose(r.ap, ap(s, y), abs_tol=1e-12)
    squeezed = E.ranking(table(spark, s**3 / 2 + 0.1, y)).first()
    assert math.isclose(squeezed.auroc, r.auroc, abs_tol=1e-12)


def test_one_class_has_no_ranking(spark):
    r = E.ranking(table(spark, [0.2, 0.3, None, float("nan")], [1, 1, 0, 0])).first()
    assert r.auroc is None and r.ap is None and r.n_ai == 2
    assert E.ranking(table(spark, [], []), ["y"]).collect() == []


def test_confusion_by_hand(spark):
    r = E.confusion(table(spark, [0.9, 0.8, 0.4, 0.1], [1, 0, 1, 0]), 0.5).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (1, 1, 1, 1) and r.accuracy == r.tpr == r.fpr == r.precision == r.balanced_accuracy == 0.5
    empty = E.confusion(table(spark, [0.9], [1]), 0.5).first()
    assert empty.fpr == 0 and empty.n_real == 0


@pytest.mark.parametrize("target", [0.0, 0.01, 0.05, 0.1, 0.5, 1.0])
def test_thresholds(spark, target):
    s, y = separable(200, 3)
    s = np.round(s, 2)
    neg, pos = np.sort(s[y == 0]), np.sort(s[y == 1])
    t = E.threshold_at_fpr(table(spark, s, y), target).first().threshold
    k = int(np.floor(target * len(neg)))
    assert t == (neg[-k] if k else np.nextafter(neg[-1], 1.0))
    t = E.threshold_at_tpr(table(spark, s, y), target).first().threshold
    assert t == pos[len(pos) - min(max(int(np.ceil(target * len(pos))), 1), len(pos))]


def test_thresholds_without_rows(spark):
    assert E.threshold_at_fpr(table(spark, [0.3], [1]), 0.05).first().threshold == 0.5
    assert E.threshold_at_tpr(table(spark, [0.3], [0]), 0.5).first().threshold == 0.5
    assert E.threshold_at_fpr(table(spark, [1.0, 0.2], [0, 0]), 0.0).first().threshold == 1.0
    ties = table(spark, [0.5] * 4, [0, 0, 1, 1])
    assert E.threshold_at_fpr(ties, 0.5).first().threshold == 0.5 and E.confusion(ties, 0.5).first().fpr == 1.0


def test_wilson(spark):
    low, high = S.wilson(F.col("k"), F.col("n"))
    rows = spark.createDataFrame([(104, 116), (0, 0), (0, 5), (5, 5)], "k int, n int").select(low.alias("a"), high.alias("b")).collect()
    assert round(rows[0].a, 3) == 0.828 and rows[1].a is None and rows[2].a == 0 and rows[3].b == 1


def newton(s, y):
    x = np.log(np.clip(s, 1e-6, 1 - 1e-6) / (1 - np.clip(s, 1e-6, 1 - 1e-6)))
    w = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-(w[0] * x + w[1])))
        g = np.array([w[0] + ((p - y) * x).sum(), (p - y).sum()])
        d = p * (1 - p)
        w = w - np.linalg.solve(np.array([[1 + (d * x * x).sum(), (d * x).sum()], [(d * x).sum(), d.sum()]]), g)
    return w


def test_platt(spark):
    s, y = separable(100, 1)
    rows = [("m", float(a), int(b)) for a, b in zip(s, y, strict=True)] + [("one", 0.2, 1), ("one", 0.4, 1)]
    rows += [("apart", 0.01, 0), ("apart", 0.99, 1)] * 25 + [("apart", None, 1)]
    fit = {r.k: (r.a, r.b) for r in C.platt_fit(spark.createDataFrame(rows, "k string, score double, y int"), ["k"]).collect()}
    assert np.allclose(fit["m"], newton(s, y), atol=1e-8) and fit["one"] == (1.0, 0.0)
    assert np.isfinite(fit["apart"]).all() and 0 < fit["apart"][0] < 10
    p = 1 / (1 + np.exp(-(fit["m"][0] * np.log(s / (1 - s)) + fit["m"][1])))
    assert ((p - y) ** 2).mean() <= ((s - y) ** 2).mean() + 1e-9


def test_fusion_model_round_trip(spark, tmp_path):
    model = C.FusionModel(["b", "a"], {"a": (1.5, -0.2), "b": (0.5, 0.1)}, {"a": 2.0}, {"fpr5": 0.7}, "bfloat16")
    path = tmp_path / "m.json"
    path.write_text(model.to_json())
    assert C.FusionModel.load(spark, str(path)) == model and model.missing(["a"]) == ["b"]
    bare = C.FusionModel.from_json('{"backends": [], "calibrators": {}}')
    assert bare.weights == {} and bare.thresholds == {} and bare.dtype == "unknown"
    probe = C.Probe([0.5, 1.0], 0.1, 2, "x")
    assert C.Probe.from_json(probe.to_json()) == probe and C.Probe.from_json('{"weights": [1], "bias": 0, "dim": 1}').crops == 1


def test_fusion_order_and_saturation(spark):
    cal = {"a": (1.2, 0.3), "b": (0.7, -0.4)}
    t = spark.createDataFrame([(0.0, 1.0), (0.3, 0.6), (1.0, 1.0)], "a double, b double")
    one = S.fuse({"a": F.col("a"), "b": F.col("b")}, cal)
    two = S.fuse({"b": F.col("b"), "a": F.col("a")}, dict(reversed(cal.items())))
    rows = t.select(one.alias("x"), two.alias("y")).collect()
    assert all(math.isclose(r.x, r.y, rel_tol=1e-12) and 0 < r.x < 1 for r in rows)
    with pytest.raises(ValueError):
        S.fuse({}, cal)


def test_probe(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(-0.5, 1, (60, 8)), rng.normal(0.5, 1, (140, 8))])
    y = np.repeat([0, 1], [60, 140])
    t = spark.createDataFrame([(v.tolist(), int(c)) for v, c in zip(x, y, strict=True)], "embedding array<double>, y int")
    probe = C.probe_fit(t)
    w = np.array([*probe.weights, probe.bias])
    design = np.hstack([x, np.ones((200, 1))])
    weight = np.where(y == 1, 200 / 280, 200 / 120)
    grad = design.T @ (weight * (1 / (1 + np.exp(-design @ w)) - y)) + np.array([*probe.weights, 0])
    assert np.abs(grad).max() < 1e-3 and probe.dim == 8
    got = t.select(S.probe_decision(F.col("embedding"), probe.weights, probe.bias).alias("d")).collect()
    assert np.allclose([r.d for r in got], design @ w)


def test_folds(spark):
    rows = [(i, i % 3 % 2, f"g{i % 5}" if i % 3 % 2 else "camera") for i in range(200)]
    bench = spark.createDataFrame(rows, "id long, y int, generator string")
    folds = C.logo_folds(bench).collect()
    real = [r.fold for r in folds if r.y == 0]
    names = sorted({r.generator for r in folds if r.y == 1})
    sizes = [real.count(n) for n in names]
    assert len(folds) == 200 and sizes == [len(x) for x in np.array_split(np.arange(len(real)), len(names))]
    assert all(r.fold == r.generator for r in folds if r.y == 1)
    assert C.logo_folds(bench.where("y = 0")).where("fold IS NOT NULL").count() == 0


def test_greedy_takes_the_informative_detector_first(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        y = int(i % 2)
        for name, gain in (("good", 2.0), ("fair", 0.8), ("noise", 0.0)):
            rows.append((i, y, name, float(rng.normal(gain * y, 1))))
    z = spark.createDataFrame(rows, "id long, y int, detector string, z double")
    history = C.greedy_select(z, ["fair", "good", "noise"])
    assert history[0][0] == "good" and [a for _, a in history if _] == sorted(a for _, a in history if _)
    assert C.greedy_select(z.where("id < 20"), ["good"]) == []


def largest_remainder(sizes, budget):
    total = sum(sizes.values())
    budget = min(budget, total)
    quota = {k: budget * v / total for k, v in sizes.items()}
    take = {k: math.floor(q) for k, q in quota.items()}
    for k in sorted(sizes, key=lambda k: (-(quota[k] - take[k]), k))[: budget - sum(take.values())]:
        take[k] += 1
    return {k: v for k, v in take.items() if v}


@pytest.mark.parametrize("budget", [0, 1, 7, 50, 10**6])
def test_allocation(spark, budget):
    sizes = {"a": 10, "b": 3, "c": 40, "d": 1, "e": 10}
    t = spark.createDataFrame(list(sizes.items()), "k string, n long")
    got = {r.k: r["take"] for r in P.allocate(t, "k", "n", F.lit(budget)).collect()}
    assert got == largest_remainder(sizes, budget)


def test_stratified_subset(spark):
    rows = spark.createDataFrame([(i, int(i % 3 > 0), f"s{i % 4}") for i in range(300)], "id long, y int, source string")
    some = P.stratified_subset(rows, 41)
    assert some.where("y = 0").count() == 20 and some.where("y = 1").count() == 21
    assert sorted(some.collect()) == sorted(P.stratified_subset(rows.repartition(5), 41).collect())
    assert P.stratified_subset(rows, 0).count() == P.stratified_subset(rows, 999).count() == 300


def test_sums_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), round(rng.random(), 2), rng.randrange(9), i) for i in range(500)]
    t = spark.createDataFrame(rows, "k string, x double, n int, i int")
    got = {r.i: r["before"] for r in sums_before(t, ["k"], unit_bucket(F.col("x"), 16), [F.col("x"), F.col("i")], {"before": "n"}).collect()}
    for k, x, _, i in rows:
        assert got[i] == sum(m for j, v, m, w in rows if j == k and (v, w) < (x, i))
    assert sorted(r["rank"] for r in ranks(t, [], unit_bucket(F.col("x"), 16), [F.col("x"), F.col("i")]).collect()) == list(range(500))


def test_admission(spark):
    items = [(0, i, f"d{i}", 300, 300, 1) for i in range(6)] + [(0, 6, "d0", 300, 300, 1)]
    items += [(1, 0, "d0", 300, 300, 1), (1, 1, "d5", 300, 300, 1), (1, 2, "n", 100, 300, 1), (1, 3, "m", 300, 300, 2), (1, 4, "bad", None, None, 1), (1, 5, "ok", 224, 224, 1)]
    t = spark.createDataFrame(items, "source_pos int, item_pos int, digest string, width int, height int, n_frames int")
    got = sorted((r.source_pos, r.digest) for r in P.admit(t, 3).collect())
    assert got == [(0, "d0"), (0, "d1"), (0, "d2"), (1, "d5"), (1, "ok")]  # d5 lay beyond the quota of source 0


def test_admission_query_takes_all_sources(spark):
    from glasswort.plans import registry

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", F.left(F.sha2("text", 256), F.lit(16)).alias("digest"), "n_chars").collect()
    seen, want = set(), []
    for pos in range(20):
        mine = sorted((r for r in docs if r.source == f"src{pos}"), key=lambda r: r.doc_id)
        taken = 0
        for item, r in enumerate(mine[:30]):
            if taken < 10 and r.digest not in seen and min(r.n_chars % 900, r.n_chars % 700) >= 224:
                seen.add(r.digest)
                want.append((pos, item, r.digest))
                taken += 1
    got = sorted(tuple(r) for r in registry.QUERIES["benchmark_admission"](spark, sf).collect())
    assert got == want and len({pos for pos, _, _ in got}) == 20


def test_score_bars_of_every_row(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    from glasswort.plans import registry

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    got = sorted(tuple(r) for r in registry.QUERIES["score_bar"](spark, sf).collect())
    assert len(got) == spark.read.parquet(f"{sf}/embeddings.parquet").count()
    assert got == sorted(con.execute(registry.ORACLE["score_bar"]).fetchall())
