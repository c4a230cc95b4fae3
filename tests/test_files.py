"""Images, scoring, sources, streams and the command line."""

import io
import json
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glasswort.operators import align, images, scoring
from glasswort.operators.calibrate import FusionModel
from glasswort.sources import files, tables
from glasswort.streaming import files as streams
from tests.test_containers import chunk, png, text


def flat(level, height=8, width=9):
    return images.encode_png(np.full((height, width, 3), level, np.uint8))


def raw_png(width, height, depth, colour, rows, *more):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(more) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def photo(seed=3, height=96, width=128):
    return np.random.default_rng(seed).integers(0, 256, (height, width, 3), np.uint8)


def test_png_round_trip_and_filters():
    a = photo()
    assert (images.decode(images.encode_png(a)).pixels == a).all()
    h, w = 5, 7
    small = photo(4, h, w).astype(int)
    lines, above = b"", np.zeros(w * 3, int)
    for y in range(h):
        row, kind = small[y].ravel(), y % 5
        left = np.concatenate([[0] * 3, row[:-3]])
        corner = np.concatenate([[0] * 3, above[:-3]])
        p = left + above - corner
        paeth = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0 * row, left, above, (left + above) // 2, paeth][kind]
        lines += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        above = row
    assert (images.decode(raw_png(w, h, 8, 2, lines)).pixels == small).all()


def test_modes():
    grey = images.decode(raw_png(2, 1, 8, 0, b"\0\x0a\xc8"))
    assert grey.pixels.tolist() == [[[10] * 3, [200] * 3]] and grey.mode == "L"
    clear = images.decode(raw_png(1, 1, 8, 6, b"\0\x01\x02\x03\0"))
    assert clear.pixels.tolist() == [[[255, 255, 255]]]
    wide = images.decode(raw_png(2, 1, 16, 0, b"\0\0\x10\0\x20"))
    assert wide.pixels.tolist() == [[[0] * 3, [255] * 3]]
    bits = images.decode(raw_png(8, 1, 1, 0, b"\0\xaa"))
    assert bits.pixels[0, :, 0].tolist() == [255, 0] * 4
    palette = images.decode(raw_png(2, 1, 8, 3, b"\0\0\1", chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6]))))
    assert palette.pixels.tolist() == [[[1, 2, 3], [4, 5, 6]]]
    seen = images.decode(raw_png(2, 1, 8, 3, b"\0\0\1", chunk(b"PLTE", bytes([1, 2, 3, 4, 5, 6])), chunk(b"tRNS", b"\0")))
    assert seen.pixels.tolist() == [[[255, 255, 255], [4, 5, 6]]]
    assert images.to_rgb(np.array([[[100, 128]]], np.uint8), "La").shape == (1, 1, 3)
    assert (images.to_rgb(np.zeros((2, 2)), "F") == 0).all()


def test_orientation_truncation_and_bad_bytes():
    a = photo(1, 4, 6)
    turned = images.oriented(a, 6)
    assert turned.shape == (6, 4, 3) and (turned[0, -1] == a[0, 0]).all()
    assert all((images.oriented(images.oriented(a, o), {6: 8, 8: 6}.get(o, o)) == a).all() for o in range(1, 9))
    cut = images.decode(images.encode_png(photo())[:-3000])
    assert cut.truncated and cut.pixels.shape == (96, 128, 3)
    for bad in (b"", b"nothing", b"\x89PNG\r\n\x1a\n"):
        with pytest.raises((images.ImageLoadError, images.Unavailable)):
            images.decode(bad)
    assert images.decode(b"P6 2 1 255\n" + bytes(range(6))).pixels.tolist() == [[[0, 1, 2], [3, 4, 5]]]


def test_tiles():
    assert images.native_tiles(photo(), 200, 4) == []
    assert [b[:2] for b in images.crop_boxes(300, 300, 300, 9)] == [(0, 0)]
    boxes = images.crop_boxes(500, 400, 224, 9)
    assert len(boxes) == len(set(boxes)) == 9 and boxes[0] == (138, 88, 362, 312)
    assert images.crop_boxes(500, 400, 224, 3) == boxes[:3]
    vector, fell_back = images.embed_tiles(photo(), lambda ts: np.array([[t.mean(), 1.0] for t in ts]), 50, 4)
    assert not fell_back and np.isclose(np.linalg.norm(vector), 1)


def test_crop_columns_match(spark):
    from glasswort.functions.scores import crop_origins

    sizes = [(224, 224), (500, 400), (225, 900), (223, 500), (1000, 333)]
    rows = spark.createDataFrame(sizes, "w int, h int")
    for n in (1, 5, 9, 12):
        got = rows.select(crop_origins(F.col("w"), F.col("h"), 224, n).alias("o")).collect()
        for (w, h), r in zip(sizes, got, strict=True):
            want = [b[:2] for b in images.crop_boxes(w, h, 224, n)] if min(w, h) >= 224 else []
            assert [tuple(o) for o in r.o] == want


def test_degradations():
    a = photo()
    for name, d in images.DEGRADATIONS.items():
        try:
            one, two = d(a), d(a)
        except images.Unavailable:
            continue
        assert (one == two).all() and one.dtype == np.uint8 and one.shape[2] == 3, name
    assert images.downscale(a, 0.5).shape == (48, 64, 3) and images.rescale(a, 0.5).shape == a.shape
    assert (images.noise(a) != images.noise(photo(9))).any() and abs(images.noise(a).astype(int) - a).mean() < 3
    assert images.blur(a, 2.0).std() < images.blur(a, 1.0).std() < a.std()
    assert (images.resize(np.full((9, 9, 3), 77, np.uint8), 4, 4) == 77).all()
    assert images.apply_chain(a, ["clean", "downscale_50", "blur_1"]).shape == (48, 64, 3)
    assert set(images.DEFAULT_SUITE) <= set(images.DEGRADATIONS) and len(images.DEGRADATIONS) == 17
    with pytest.raises(KeyError):
        images.degradation("nope")
    with pytest.raises(ValueError):
        images.downscale(a, 0)


@pytest.fixture
def folder(tmp_path):
    for name, level in (("a.png", 10), ("b.PNG", 200), ("c.png", 90), ("d.png", 250)):
        (tmp_path / name).write_bytes(flat(level))
    (tmp_path / "e.txt").write_text("no image")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "f.png").write_bytes(png(text("Software", "Midjourney")))
    return tmp_path


def test_listing(spark, folder):
    listed = [(r.ordinal, r.path.rsplit("/", 1)[-1]) for r in files.expand(spark, [str(folder / "e.txt"), str(folder), str(folder / "a.png"), "gone.png"]).orderBy("ordinal").collect()]
    assert [n for _, n in listed] == ["e.txt", "a.png", "b.PNG", "c.png", "d.png", "f.png", "a.png", "gone.png"]
    assert files.expand(spark, [str(folder)], recursive=False).count() == 4


@pytest.mark.parametrize("batch", [1, 2, 8])
def test_order_repeats_and_bad_files(spark, folder, batch):
    names = ["b.PNG", "a.png", "gone.png", "b.PNG", "e.txt", "d.png"]
    held = files.contents(spark, spark.createDataFrame([(i, str(folder / n)) for i, n in enumerate(names)], "ordinal long, path string"))
    rows = scoring.predictions(held, ["brightness"], batch=batch).orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(6))
    assert [r.verdict for r in rows] == ["AI-GENERATED", "REAL", "ERROR", "AI-GENERATED", "ERROR", "AI-GENERATED"]
    assert [r.p_ai for r in rows] == [round(200 / 255, 4), round(10 / 255, 4), None, round(200 / 255, 4), None, round(250 / 255, 4)]
    assert rows[2].error.startswith("no such file")


def test_metadata_overrides(spark, folder):
    held = files.contents(spark, files.expand(spark, [str(folder / "sub" / "f.png")]))
    model = FusionModel(["brightness"], {"brightness": (1.0, 0.0)}, {}, {"fpr5": 0.9, "fpr1": 0.99, "abstain_low": 0.0001})
    r = scoring.predictions(held, ["brightness"], model).first()
    assert r.verdict == "AI-GENERATED" and r.basis == "metadata describes the whole image: PNG:Software names Midjourney" and r.threshold == 0.9
    r = scoring.predictions(held, ["brightness"], model, "fpr1", use_metadata=False).first()
    assert r.verdict == "UNCERTAIN" and r.threshold == 0.99 and r.basis.startswith("pixel ensemble is between")
    assert scoring.predictions(held, ["brightness"], model, use_metadata=False, abstain=False).first().verdict == "REAL"


def test_incremental_scores(spark, folder, tmp_path):
    held = files.contents(spark, files.expand(spark, [str(folder)])).withColumn("id", F.col("path"))
    cache = str(tmp_path / "cache")
    first = scoring.scores_for(held.where("ordinal < 2"), "brightness", cache)
    assert first.count() == 2
    assert scoring.scores_for(held, "brightness", cache).count() == 5 and spark.read.parquet(cache).count() == 5
    with pytest.raises(KeyError):
        scoring.score_files(held, ["unheard"])


def test_tables(spark, tmp_path):
    row = ("a/1", "cf", "ai", "a", "g", "n", "m", "c", "PNG", 300, 200, "0" * 16)
    rows = spark.createDataFrame([row, ("b/1", "local", "real", *row[3:])], tables.MANIFEST)
    tables.write_manifest(rows, str(tmp_path / "m"))
    back = tables.read_manifest(spark, str(tmp_path / "m"))
    assert sorted((r.id, r.y, r.width) for r in back.collect()) == [("a/1", 1, 300), ("b/1", 0, 300)]
    scores = spark.createDataFrame([("a/1", "d", "crop", 0.5), ("a/1", "d", "native", 0.25)], "id string, detector string, protocol string, score double")
    tables.write_scores(scores, str(tmp_path / "s"))
    assert tables.read_scores(spark, str(tmp_path / "s"), "crop").first().score == 0.5
    with pytest.raises(Exception, match="finite"):
        tables.write_scores(scores.withColumn("score", F.lit(float("nan"))), str(tmp_path / "s2"))
    assert tables.read_cache(spark, str(tmp_path / "none")).count() == 0
    shard = str(tmp_path / "x.parquet")
    spark.createDataFrame([((bytearray(b"1"), "p"),), ((None, "q"),), ((bytearray(b"2"), "r"),), (None,)], tables.SHARD).coalesce(1).write.parquet(shard)
    got = tables.read_shard_images(spark, shard, 5).collect()
    assert [(r.stem, bytes(r.content)) for r in got] == [("x_00000", b"1"), ("x_00001", b"2")]
    said = tables.write_report(scores.orderBy("protocol"), str(tmp_path / "r"))
    assert "| a/1 | d | crop | 0.500 |" in said
    tables.write_json(scores, str(tmp_path / "j"))
    assert json.loads(spark.read.text(str(tmp_path / "j")).first()[0])["id"] == "a/1"


def test_features_must_be_complete(spark):
    m = spark.createDataFrame([("a",), ("b",)], "id string")
    f = spark.createDataFrame([("a", [1.0], "vit"), ("b", [1.0], "other")], "id string, features array<double>, backbone string")
    with pytest.raises(Exception, match="no features for id b"):
        align.with_features(m, f, "vit").collect()
    assert align.with_features(m.where("id = 'a'"), f, "vit").count() == 1


def test_names():
    assert align.resolve_names(["all"], ["a", "b"], ["a"]) == ["a", "b"]
    assert align.resolve_names(["default"], ["a", "b", "clean"], ["b"], "clean") == ["clean", "b"]
    with pytest.raises(KeyError, match="unknown: x"):
        align.resolve_names(["x"], ["a"], [])


def test_streams(spark, folder, tmp_path):
    (folder / "twin.png").write_bytes((folder / "a.png").read_bytes())
    verdicts = streams.provenance_stream(streams.file_stream(spark, str(folder)))
    q = verdicts.select("path", "says_ai").writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination(120)
    rows = spark.table("verdicts").collect()
    assert len(rows) == 6 and [r.path.endswith("f.png") for r in rows if r.says_ai] == [True]
    once = streams.first_contents(streams.file_stream(spark, str(folder)))
    q = once.select("digest").writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination(120)
    assert spark.table("once").count() == 5


def test_command_line(folder):
    run = lambda *a: subprocess.run([sys.executable, "-m", "glasswort", *a], capture_output=True, text=True, timeout=200)
    out = run("--metadata-only", "--json", str(folder / "sub"))
    found = json.loads(out.stdout[out.stdout.index("[") :])
    assert out.returncode == 0 and found[0]["says_ai"] and found[0]["generator"] == "Midjourney"
    (folder / "none").mkdir()
    assert run(str(folder / "none")).returncode == 2
    assert run("--model", str(folder / "gone.json"), str(folder)).returncode == 1


def test_bytes_objects_are_enough():
    assert images.decode(io.BytesIO(flat(3)).read()).size == (9, 8)
