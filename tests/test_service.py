"""The HTTP contract and whole reports."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasswort import server
from glasswort.operators import reports, scoring
from glasswort.operators.calibrate import FusionModel
from glasswort.plans import bench as B
from glasswort.plans import selection
from glasswort.plans.evaluation import degraded
from tests.test_files import flat

MODEL = FusionModel(["brightness"], {"brightness": (1.0, 0.0)}, {}, {"fpr5": 0.6, "fpr1": 0.9, "balanced": 0.5, "abstain_low": 0.4}, "float32")


@pytest.fixture(scope="module")
def url(spark):
    service = server.Service(spark, MODEL, ["brightness"])
    s = server.serve(service, port=0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


def ask(url, files=None):
    if files is None:
        request = urllib.request.Request(url)
    else:
        parts = b"".join(b'--B\r\nContent-Disposition: form-data; name="files"; filename="' + n.encode() + b'"\r\nContent-Type: image/png\r\n\r\n' + d + b"\r\n" for n, d in files)
        request = urllib.request.Request(url, parts + b"--B--\r\n", {"Content-Type": "multipart/form-data; boundary=B"})
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, json.loads(r.read())
    except urllib.error.HTTPError as e:
        return e.code, json.loads(e.read())


def test_health_and_info(url, spark):
    assert ask(f"{url}/health") == (200, {"status": "ok", "version": server.VERSION, "models_loaded": True, "error": None})
    status, body = ask(f"{url}/info")
    assert status == 200 and body["ensemble"] == ["brightness"] and "fpr5" in body["available_operating_points"] and body["limits"]["max_files_per_request"] == 16
    broken = server.Service(spark, None, [], error="OSError: no checkpoints")
    assert broken.health()[0] == broken.info()[0] == broken.detect([("a", b"x")])[0] == 503 and "no checkpoints" in broken.health()[1]["error"]
    assert ask(f"{url}/else")[0] == 404


def test_detect(url):
    status, body = ask(f"{url}/detect", [("10.png", flat(10)), ("bad.png", b"not an image"), ("240.png", flat(240)), ("10.png", flat(10))])
    assert status == 200 and body["operating_point"] == "fpr5"
    assert [r["filename"] for r in body["results"]] == ["10.png", "bad.png", "240.png", "10.png"]
    assert [r["verdict"] for r in body["results"]] == ["REAL", "ERROR", "AI-GENERATED", "REAL"]
    assert "bad.png" in body["results"][1]["error"] and body["results"][1]["p_ai"] is None
    assert round(body["results"][2]["p_ai"] * 255) == 240


def test_operating_points(url):
    files = [("mid.png", flat(180))]
    loose, strict = (ask(f"{url}/detect?operating_point={p}&metadata=false", files)[1]["results"][0] for p in ("balanced", "fpr1"))
    assert (loose["threshold"], strict["threshold"]) == (0.5, 0.9) and loose["p_ai"] == strict["p_ai"] and loose["low_threshold"] == strict["low_threshold"] == 0.4
    assert (loose["verdict"], strict["verdict"]) == ("AI-GENERATED", "UNCERTAIN")
    assert ask(f"{url}/detect?operating_point=nope", files)[0] == 400


def test_limits(url, monkeypatch):
    assert ask(f"{url}/detect", [])[0] == 422
    assert ask(f"{url}/detect", [("empty.png", b"")])[0] == 400
    monkeypatch.setattr(server, "MOST_BYTES", 20)
    assert ask(f"{url}/detect", [("big.png", flat(1))])[0] == 413
    monkeypatch.setattr(server, "MOST_FILES", 1)
    assert ask(f"{url}/detect", [("a.png", b"1"), ("b.png", b"2")])[0] == 413


def test_fusion_report(spark, sf):
    scored = B.scores(spark, sf).join(selection.folded(spark, sf).select("id", "fold"), "id")
    model, report = reports.fusion_report(scored, B.DETECTORS, B.MEMBERS)
    assert model.members == list(B.MEMBERS) and set(report["solo_leave_one_generator_out"]) == set(B.DETECTORS)
    assert set(report["logo_folds"]) == {f"g{i}" for i in range(3, 10)} and sum(v["n"] for v in report["logo_folds"].values()) == report["n"]
    assert report["logo_pooled"]["fpr"] <= 0.05 + 1e-9 and report["in_sample"]["fpr"] <= 0.05 + 1e-9
    assert set(report["cross_track"]) == {"fit_on_cf_test_on_rest", "fit_on_local_test_on_rest"}
    assert json.loads(json.dumps(report))["thresholds"] == model.thresholds
    assert reports.fusion_report(scored.where("y = 1"), B.DETECTORS)[0] is None


def test_other_reports(spark, sf):
    report = reports.benchmark_report(B.protocol_scores(spark, sf), B.bench(spark, sf))
    assert len(report["lines"]) == 12 and set(report["gaps"]) == set(B.DETECTORS) and set(report["recall"]) == {f"g{i}" for i in range(3, 10)}
    assert all(v["low"] <= v["share"] <= v["high"] for v in report["recall"].values())
    n = report["images"]
    assert n["n"] == n["n_real"] + n["n_ai"] == B.bench(spark, sf).count() and n["generators"] == 7 and n["tracks"] == ["cf", "local"]
    said = reports.benchmark_markdown(report)
    assert said.count("\n## ") == 4 and all(f"| {d} | crop |" in said for d in B.DETECTORS)
    one = reports.benchmark_report(B.protocol_scores(spark, sf), B.bench(spark, sf), track="cf")
    assert one["images"]["n"] == B.bench(spark, sf).where("track = 'cf'").count() and one["images"]["tracks"] == ["cf"]
    assert max(r["n"] for r in one["lines"]) <= one["images"]["n"]
    robust = reports.robustness_report(degraded(spark, sf))
    clean = robust["clip-probe"]["degradations"]["clean"]
    assert clean["auroc_drop"] == clean["tpr_drop"] == 0 and robust["clip-probe"]["degradations"]["jpeg30"]["tpr"] <= clean["tpr"]
    few = reports.robustness_report(degraded(spark, sf).where((F.col("id") % 9 == 0) & (F.col("detector") == "clip-probe")))
    assert few["clip-probe"]["warnings"]


def test_leakage(spark):
    """A cached column that is the strict probe's own gives the same figures for the rows held out; one that tells the labels doesn't."""
    rng = np.random.default_rng(11)
    y = np.tile([0, 1], 90)
    fold = np.repeat(["a", "b", "c"], 60)
    x = rng.normal(0, 1, (180, 4)) + 0.8 * y[:, None]
    rows = [(i, int(y[i]), str(fold[i]), x[i].tolist()) for i in range(180)]
    bench = spark.createDataFrame(rows, "id long, y int, fold string, embedding array<double>")
    given = [(i, int(y[i]), str(fold[i]), "d", float(1 / (1 + np.exp(-x[i, 0])))) for i in range(180)]
    given += [(i, int(y[i]), str(fold[i]), "told", 0.99 if y[i] else 0.01) for i in range(180)]
    scored = spark.createDataFrame(given, "id long, y int, fold string, detector string, score double")
    found = reports.leakage_report(scored, bench, ["d"], "told")
    assert found["cached"]["auroc"] == 1 and 0.6 < found["strict"]["auroc"] < 1
    assert all(found[form]["n_ai"] == found[form]["n_real"] == 90 for form in ("cached", "strict"))
    assert reports.leakage_report(scored.where("y = 1"), bench.where("y = 1"), ["d"], "told") == {"cached": {}, "strict": {}}


def test_checkpoints_are_refused(spark):
    assert scoring.class_sides(spark, "nyuad", {0: "real", 1: "sd", 2: "dalle"}) == ([1, 2], [0])
    assert scoring.class_sides(spark, "umm-maybe", {0: " Artificial", 1: "human"}, ["x.position_ids"]) == ([0], [1])
    with pytest.raises(RuntimeError, match="mapped"):
        scoring.class_sides(spark, "umm-maybe", {0: "LABEL_0", 1: "LABEL_1"})
    with pytest.raises(RuntimeError, match="overlap"):
        scoring.class_sides(spark, "umm-maybe", {0: "artificial human"})
    with pytest.raises(RuntimeError, match="1 parameters"):
        scoring.class_sides(spark, "umm-maybe", {0: "artificial", 1: "human"}, ["head.weight"])
    with pytest.raises(KeyError):
        scoring.class_sides(spark, "none", {})


def test_needed_detectors(spark):
    members = spark.createDataFrame([("nyuad",), ("clip-probe",)], "name string")
    assert [r["name"] for r in scoring.needed_detectors(spark, members).collect()] == ["nyuad"]
    every, general = scoring.needed_detectors(spark, every=True).count(), scoring.needed_detectors(spark).count()
    assert every == len(scoring.DETECTORS) and general == every - 1
