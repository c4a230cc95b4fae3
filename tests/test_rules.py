"""Text rules against Python's own regular expressions and JSON, Unicode included."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from glasswort.functions import rules as R
from glasswort.functions import scores as S


def names(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    return [r.n for r in rows.select("i", R.generator_name(F.col("t"))["name"].alias("n")).orderBy("i").collect()]


def first_name(text):
    return next((n for p, n, _ in R.GENERATORS if re.search(p, text, re.I)), None)


def test_names_like_python(spark):
    rng = random.Random(5)
    bits = ["Midjourney", "mj v6", "sdxl", "ComfyUI", "dall·e", "DALL-E", "openai", "flux", "flux.1-dev", "generative  fill", "firefly", "Imagen 3", "gemini", "krea", "krea.ai", "canva", "magic", "é", "_", "x.ai", " ", "\n", "-", "nano-banana", "FLUX", "grok", "kandinsky", "playground v2", "Ş"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 6))) for _ in range(500)] + ["éflux", "flux dev", "ſdxl"]
    got = names(spark, texts)
    assert [(t, g) for t, g in zip(texts, got, strict=True) if g != first_name(t)] == []


@pytest.mark.parametrize("caption", ["an influx of visitors", "kreature feature", "groking the code", "a grand canvas of magic", "the firefighter's line", "Geminid shower", "sdxlarge"])
def test_ordinary_words_name_nothing(caption):
    assert first_name(caption) is None


@pytest.mark.parametrize("base", ["http://cv.iptc.org/newscodes/digitalsourcetype/", "https://c2pa.org/digitalsourcetype/", ""])
def test_source_types(spark, base):
    terms = [(t, k) for k, ts in R.SOURCE_TYPES.items() for t in ts]
    assert len(terms) == 20
    rows = spark.createDataFrame([(t, k, f'<a Iptc4xmpExt:DigitalSourceType="{base}{t}"/>') for t, k in terms], "t string, k string, x string")
    found = rows.select("t", "k", R.best_source_type(R.source_type_terms(F.col("x"))).alias("d"), R.source_type_evidence(F.lit("XMP"), F.col("x")).alias("e")).collect()
    for r in found:
        assert (r.d.term, r.d.kind, r.d.retired, r.d.partial) == (r.t, r.k, r.t in R.RETIRED_TYPES, r.t in R.PARTIAL_TYPES)
        assert {e.kind for e in r.e} == ({r.k} if r.k != "neutral" else set())


def json_keys(text):
    try:
        parsed = json.loads(text)
    except ValueError:
        return []
    if not isinstance(parsed, dict):
        return []
    keys = set(parsed) | {k for v in parsed.values() if isinstance(v, dict) for k in v}
    known = sorted(k for k in keys if k.lower() in {*R.SAMPLING_KEYS, *R.OTHER_JSON_KEYS})
    return known if any(k.lower() in R.SAMPLING_KEYS for k in known) else []


def is_graph(text):
    if "class_type" not in text and '"nodes"' not in text:
        return False
    try:
        parsed = json.loads(text)
    except ValueError:
        return '"class_type"' in text
    if not isinstance(parsed, dict):
        return False
    nodes = parsed.get("nodes")
    return any(isinstance(v, dict) and "class_type" in v for v in parsed.values()) or (
        isinstance(nodes, list) and any(isinstance(n, dict) and {"type", "widgets_values"} <= set(n) for n in nodes)
    )


def test_json_like_python(spark):
    rng = random.Random(6)

    def value(depth):
        kind = rng.randrange(6 if depth else 3)
        if kind < 3:
            return [1, "x", None][kind]
        keys = ["steps", "Seed", "model", "prompt", "class_type", "nodes", "type", "widgets_values", "uc", "other", "scale"]
        if kind == 3:
            return [value(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice(keys): value(depth - 1) for _ in range(rng.randrange(5))}

    texts = [json.dumps(value(3)) for _ in range(400)]
    texts += [t[: len(t) // 2] for t in texts[:100]] + ["", "{", "no json", '"class_type"', '{"nodes": {"type": 1}}']
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = rows.select("i", R.json_keys(F.col("t")).alias("k"), R.is_node_graph(F.col("t")).alias("g")).orderBy("i").collect()
    assert [(t, r.k) for t, r in zip(texts, got, strict=True) if list(r.k) != json_keys(t)] == []
    assert [(t, r.g) for t, r in zip(texts, got, strict=True) if r.g != is_graph(t)] == []


def xmp_values(text, local):
    found = [m[1] for m in re.finditer(rf'(?:^|[\s"])(?:[\w.-]+:)?{local}\s*=\s*"([^"]*)"', text)]
    found += [re.sub(r"<[^>]+>", " ", m[1]) for m in re.finditer(rf"<[\w.-]*:?{local}(?:\s[^>]*)?>(.*?)</[\w.-]*:?{local}>", text, re.S)]
    return [v for v in (x.strip().replace("&lt;", "<").replace("&amp;", "&") for x in found) if v]


def test_xmp_values(spark):
    texts = [
        '<r dc:title="A &amp; B" x:title = "two"/><dc:title><rdf:li> in\nside </rdf:li></dc:title>', '<rdf:Description dc:description="no"/>', 'title="bare"', "<title/>", '<a mytitle="x" q:title=""/>', "", "<t:title>open",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = rows.select("i", R.xmp_values(F.col("t"), "title").alias("v")).orderBy("i").collect()
    assert [list(r.v) for r in got] == [xmp_values(t, "title") for t in texts]


def test_verdict_order(spark):
    base = {"p": 0.9, "error": None, "ai": False, "partial": False, "cut": False}
    cases = [({}, "AI-GENERATED"), ({"p": 0.6}, "UNCERTAIN"), ({"p": 0.5}, "REAL"), ({"p": 0.7}, "AI-GENERATED"), ({"p": 0.1}, "REAL"), ({"cut": True}, "UNCERTAIN"), ({"cut": True, "ai": True}, "AI-GENERATED"),
             ({"ai": True, "partial": True, "p": 0.0}, "AI-EDITED"), ({"error": "x", "ai": True}, "ERROR"), ({"error": ""}, "AI-GENERATED"), ({"p": float("nan")}, "REAL"), ({"p": None}, "REAL")]
    rows = [(i, *({**base, **c}).values()) for i, (c, _) in enumerate(cases)]
    t = spark.createDataFrame(rows, "i long, p double, error string, ai boolean, partial boolean, cut boolean")
    v = S.verdict(F.col("p"), F.lit(0.7), F.lit(0.5), F.col("error"), F.col("ai"), F.col("partial"), F.col("cut"))
    assert [r.v for r in t.select("i", v.alias("v")).orderBy("i").collect()] == [w for _, w in cases]
    free = S.verdict(F.col("p"), F.lit(0.7), F.lit(None).cast("double"), F.col("error"), F.col("ai"), F.col("partial"), F.col("cut"))
    assert t.where("i = 1").select(free.alias("v")).first().v == "REAL"


def test_describe(spark):
    row = spark.createDataFrame([(["b", "a"], ["w"]), ([], ["w", "x"]), ([], [])], "ai array<string>, weak array<string>")
    got = [r.d for r in row.select(R.describe(F.col("ai"), F.col("weak")).alias("d")).collect()]
    assert got == ["b; a", "weak only: w; x", "no provenance evidence"]


def test_provenance_of_all_titles(spark, sf):
    from glasswort.plans import provenance, registry

    rows = registry.QUERIES["provenance_rows"](spark, sf).collect()
    assert sorted(r.id for r in rows) == list(range(1, 35)) and not any(r.partial_ai for r in rows)
    assert {r.id: (r.says_ai, r.generator, r.description) for r in rows if r.id >= 22} == provenance.BY_HAND
