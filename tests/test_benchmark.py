"""Building and scoring a benchmark."""

import numpy as np

from glasswort.operators import align, benchmark, images
from glasswort.sources import tables


def picture(seed, height=240, width=260):
    return images.encode_png(np.random.default_rng(seed).integers(0, 256, (height, width, 3), np.uint8))


def test_build_and_score(spark, tmp_path):
    rows = [("local", "a", "real", "camera:a", 0, i, f"x{i}.png", bytearray(picture(i))) for i in range(4)]
    rows += [("cf", "b", "ai", "cf:g", 1, 0, "copy.png", rows[0][-1]), ("cf", "b", "ai", "cf:g", 1, 1, "small.png", bytearray(picture(9, 100, 300)))]
    rows += [("cf", "b", "ai", "cf:g", 1, 2, "bad.png", bytearray(b"no image")), ("cf", "b", "ai", "cf:g", 1, 3, "wide.png", bytearray(picture(8, 230, 700)))]
    items = spark.createDataFrame(rows, "track string, source string, label string, generator string, source_pos int, item_pos int, stem string, content binary")
    out = str(tmp_path / "bench")
    manifest = benchmark.build(items, out, per_source=3, kind="png")
    got = {r.id: r for r in manifest.collect()}
    assert sorted(got) == ["a/x0", "a/x1", "a/x2", "b/wide"] and got["b/wide"].crop == "crop/ai/b/wide.png" and len(got["a/x0"].sha256) == 16
    held = {(r.id, r.protocol): bytes(r.image.bytes) for r in spark.read.parquet(f"{out}/images").collect()}
    assert held["a/x0", "native"] == bytes(rows[0][-1]) and images.decode(held["a/x0", "crop"]).size == (224, 224)
    assert images.decode(held["b/wide", "matched"]).size == (512, 168)
    failed = benchmark.score(out, manifest, ["brightness", "unheard"], ["native", "crop"], str(tmp_path / "scores"))
    assert set(failed) == {("unheard", "native"), ("unheard", "crop")}
    scores = tables.read_scores(spark, str(tmp_path / "scores"), "crop")
    assert align.complete(align.align_scores(manifest.select("id"), scores.select("id", "detector", "score"))).count() == 4
