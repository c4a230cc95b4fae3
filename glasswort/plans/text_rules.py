"""Queries of the text rules, on inline texts and on the driver's free text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions.scores import clip_text
from . import bench as B

# Texts that exercise the rules, as (id, text).
TEXTS = (
    (1, "Midjourney v6 portrait"),
    (2, "rendered with SDXL base"),
    (3, "exported from comfy ui"),
    (4, "DALL-E 3 output"),
    (5, "a memo about openai policy"),
    (6, "flux.1-dev sample"),
    (7, "the flux of time"),
    (8, "Adobe Photoshop (Generative Fill)"),
    (9, "Adobe Firefly Image 2"),
    (10, "a firefly at night"),
    (11, "Imagen 3 by Google"),
    (12, "gemini twins under the stars"),
    (13, "an ideogram from 1200 BC"),
    (14, "grok imagine test"),
    (15, "canva with the magic wand"),
    (16, "chatgpt wrote this"),
    (17, "Kandinsky at the museum"),
    (18, "a plain caption"),
    (19, ""),
    (20, "Steps: 20, Sampler: Euler a, CFG scale: 7, Seed: 5"),
    (21, "Seed: the seed of a tree"),
    (22, '{"3": {"class_type": "KSampler", "inputs": {}}}'),
    (23, '{"nodes": [{"type": "X", "widgets_values": []}]}'),
    (24, '{"nodes": [{"type": "X"}]}'),
    (25, '{"3": {"class_type": "KSam'),
    (26, '{"steps": 20, "Sampler": "k", "seed": 1, "other": 2}'),
    (27, '{"model": "m", "prompt": "p", "scale": 1}'),
    (28, '{"meta": {"cfg_scale": 7, "uc": "x"}, "model": "m"}'),
    (29, "Job ID: 01234567-89ab-cdef-0123-456789abcdef"),
    (30, "Job ID: 4711 for the archive"),
    (31, "a castle --ar 16:9 --v 5"),
    (32, "class_type is a word here"),
    (33, "StabilityAI core model; NightCafe"),
    (34, '[{"class_type": 1}]'),
)
# XMP packets, as (id, packet).
PACKETS = (
    (1, '<x:xmpmeta><rdf:Description xmp:CreatorTool="Midjourney 6" tiff:Make="Canon"/></x:xmpmeta>'),
    (2, "<Iptc4xmpExt:DigitalSourceType>http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia</Iptc4xmpExt:DigitalSourceType>"),
    (3, '<rdf:Description Iptc4xmpExt:DigitalSourceType="compositeSynthetic"/>'),
    (4, "<d:DigitalSourceType>digitalCapture</d:DigitalSourceType> <dc:description>print</dc:description>"),
    (5, "see https://c2pa.org/digitalsourcetype/minorHumanEdits and http://cv.iptc.org/newscodes/digitalsourcetype/nonsense"),
    (6, '<r xmlns:AIGC="http://x"/><TC260:AIGC>1</TC260:AIGC>'),
    (7, "<g:AIGeneratedContent>false</g:AIGeneratedContent>"),
    (8, '<a genai:model="x" gen_ai:flag="0"/>'),
    (9, "<dc:title><rdf:li>Cats &amp; dogs</rdf:li></dc:title>"),
    (10, "nothing at all"),
)
# PNG text chunks, as (id, key, value).
CHUNKS = (
    (1, "parameters", "Steps: 3, Seed: 4, made by flux-dev"), (2, "Prompt", '{"3": {"class_type": "A"}}'), (3, "Software", "krea"), (4, "Comment", "krea"), (5, "invokeai_metadata", "x"),
    (6, "dream", '"a cat" -s50 -W512 -H512'), (7, "dream", "a nice dream"), (8, "Title", "by midjourney"), (9, "XML:com.adobe.xmp", "<x/>"), (10, "Elsewhere", "midjourney"),
    (11, "aiframework", "diffusers"), (12, "workflow", '{"steps": 1, "seed": 2, "sampler": "x"}'),
)


def texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEXTS), "id long, text string")


def packets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PACKETS), "id long, text string")


def chunks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CHUNKS), "id long, key string, value string")


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def flat(evidence: Column) -> Column:
    return joined(F.transform(evidence, lambda e: F.concat_ws(":", e["kind"], e["text"], F.coalesce(e["generator"], F.lit("-")))))


def free_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(kind, id, text) of all free text of the driver's tables."""
    parts = [("benchmark", "item_id", "text"), ("conversations", "conv_id", "text"), ("documents", "doc_id", "text")]
    tables = [B.table(spark, sf_dir, t).select(F.lit(t).alias("kind"), F.col(i).alias("id"), F.col(c).alias("text")) for t, i, c in parts]
    return tables[0].unionByName(tables[1]).unionByName(tables[2])


def _roles(spark: SparkSession) -> DataFrame:
    return texts(spark).select("id", "text", F.explode(F.array(*[F.lit(r) for r in (R.TOOL, R.PARAMS, R.FREETEXT)])).alias("role"))


def evidence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = packets(spark).select("id", R.xmp_evidence(F.col("text")).alias("e"))
    ai, weak, camera = (R.texts_of(F.col("e"), k) for k in ("ai", "weak", "camera"))
    return e.select("id", R.says_ai(ai).alias("says_ai"), R.partial_ai(ai).alias("partial_ai"), R.says_camera(camera, ai).alias("says_camera"), R.describe(ai, weak).alias("description"))


def generator_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, ["unknown diffusion pipeline", "Midjourney", "Krea"]), (2, ["Krea", "Midjourney"]), (3, ["other diffusion model", "local diffusion UI"]), (4, [])]
    table = spark.createDataFrame(rows, "id long, names array<string>")
    e = F.transform("names", lambda n: F.struct(F.lit("ai").alias("kind"), F.lit("x").alias("text"), n.alias("generator")))
    return table.select("id", R.generator_of(e.cast(R.EVIDENCE)).alias("generator"))


def source_type_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = R.best_source_type(R.source_type_terms(F.col("text")))
    return packets(spark).select("id", best["term"].alias("term"), best["kind"].alias("kind"), best["retired"].cast("string").alias("retired"), best["partial"].cast("string").alias("partial"))


QUERIES = {
    "name_scan": lambda s, d: texts(s).select("id", R.generator_name(F.col("text"))["name"].alias("name"), R.generator_name(F.col("text"))["specific"].cast("string").alias("specific")),
    "name_scan_tables": lambda s, d: free_text(s, d).select("kind", R.generator_name(F.col("text"))["name"].isNotNull().alias("named")).groupBy("kind", "named").agg(F.count("*").alias("n")),
    "name_evidence": lambda s, d: _roles(s).select("id", "role", flat(R.name_evidence(F.lit("X"), F.col("text"), F.col("role"))).alias("evidence")),
    "freetext_ladder": lambda s, d: texts(s).select("id", R.ladder_rung(F.col("text")).alias("rung")),
    "a1111_keys": lambda s, d: texts(s).select("id", R.setting_keys(F.col("text")).alias("n"), R.is_settings(F.col("text")).alias("settings")),
    "json_keys": lambda s, d: texts(s).select("id", joined(R.json_keys(F.col("text"))).alias("keys")),
    "json_props": lambda s, d: B.table(s, d, "events").select(joined(F.json_object_keys("props")).alias("keys")).groupBy("keys").agg(F.count("*").alias("n")),
    "node_graphs": lambda s, d: texts(s).select("id", R.is_node_graph(F.col("text")).alias("graph")),
    "xmp_values": lambda s, d: packets(s).select("id", *[joined(R.xmp_values(F.col("text"), n)).alias(n.lower()) for n in ("CreatorTool", "title", "DigitalSourceType", "Make")]),
    "html_titles": lambda s, d: B.table(s, d, "pages").select("page_id", joined(R.xmp_values(F.col("html"), "title")).alias("titles"), joined(R.xmp_values(F.col("html"), "class")).alias("classes")),
    "dst_terms": lambda s, d: packets(s).select("id", joined(R.source_type_terms(F.col("text"))).alias("terms")),
    "source_type_info": source_type_info,
    "aigc_tags": lambda s, d: packets(s).select("id", joined(R.aigc_tags(F.col("text"))).alias("tags")),
    "png_key_class": lambda s, d: chunks(s).select("id", R.png_key_class(F.col("key"), F.col("value")).alias("class")),
    "png_evidence": lambda s, d: chunks(s).select("id", flat(R.png_evidence(F.col("key"), F.col("value"))).alias("evidence")),
    "evidence_flags": evidence_flags,
    "generator_precedence": generator_precedence,
    "clip_text": lambda s, d: B.table(s, d, "benchmark").select("item_id", clip_text(F.col("text"), 40).alias("text")),
}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows, names: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(f'{v}::BIGINT' if isinstance(v, int) else _q(v) for v in r) + ')' for r in rows)}) t({names})"


_T, _P, _C = _values(TEXTS, "id, text"), _values(PACKETS, "id, text"), _values(CHUNKS, "id, key, value")
_NAME = "CASE " + " ".join(f"WHEN regexp_matches(text, {_q('(?i)' + p)}) THEN {_q(n)}" for p, n, _ in R.GENERATORS) + " END"
_SPECIFIC = "CASE " + " ".join(f"WHEN regexp_matches(text, {_q('(?i)' + p)}) THEN {str(s).lower()}" for p, _, s in R.GENERATORS) + " END"
_KEYS = " + ".join(f"CAST(contains(text, {_q(k)}) AS INTEGER)" for k in R.SETTING_KEYS)
_JSON = f"""j AS (SELECT id, text, CASE WHEN json_valid(text) AND json_type(text) = 'OBJECT' THEN text END AS o FROM {_T}),
k AS (SELECT id, text, o, list_concat(json_keys(o), flatten(list_transform(json_keys(o), lambda x: CASE WHEN json_type(o, '$."' || x || '"') = 'OBJECT' THEN json_keys(o, '$."' || x || '"') ELSE [] END))) AS keys FROM j),
f AS (SELECT id, text, o, list_sort(list_distinct(list_filter(keys, lambda x: list_contains([{', '.join(_q(x) for x in (*R.SAMPLING_KEYS, *R.OTHER_JSON_KEYS))}], lower(x))))) AS known FROM k),
g AS (SELECT id, text, o, CASE WHEN len(list_filter(known, lambda x: list_contains([{', '.join(_q(x) for x in R.SAMPLING_KEYS)}], lower(x)))) > 0 THEN known ELSE [] END AS keys FROM f)"""
_GRAPH = """CASE WHEN NOT (contains(text, 'class_type') OR contains(text, '"nodes"')) THEN false WHEN NOT json_valid(text) THEN contains(text, '"class_type"')
  WHEN o IS NULL THEN false ELSE len(list_filter(json_keys(o), lambda x: json_type(o, '$."' || x || '"') = 'OBJECT' AND list_contains(json_keys(o, '$."' || x || '"'), 'class_type'))) > 0
  OR (json_type(o, '$.nodes') = 'ARRAY' AND json_exists(o, '$.nodes[0].type') AND json_exists(o, '$.nodes[0].widgets_values')) END"""


def _xmp(local: str, text: str = "text") -> str:
    attribute = f"regexp_extract_all({text}, {_q(chr(40) + '?:^|[' + chr(92) + 's' + chr(34) + '])(?:[' + chr(92) + 'w.-]+:)?' + local + chr(92) + 's*=' + chr(92) + 's*' + chr(34) + '([^' + chr(34) + ']*)' + chr(34))}, 1)"
    element = f"regexp_extract_all({text}, {_q('(?s)<[' + chr(92) + 'w.-]*:?' + local + '(?:' + chr(92) + 's[^>]*)?>(.*?)</[' + chr(92) + 'w.-]*:?' + local + '>')}, 1)"
    plain = "regexp_replace(v, '^\\s+|\\s+$', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
        plain = f"replace({plain}, '{a}', '{b}')"
    bare = f"list_transform({element}, lambda w: regexp_replace(w, '<[^>]+>', ' ', 'g'))"
    return f"list_filter(list_transform(list_concat({attribute}, {bare}), lambda v: {plain}), lambda u: u <> '')"


_TERMS = f"""list_concat(regexp_extract_all(text, {_q(R.SOURCE_TYPE_URI)}, 1),
  list_filter(list_transform({_xmp('DigitalSourceType')}, lambda y: trim(list_extract(string_split(y, '/'), -1))), lambda y: y <> ''))"""
_ALL_TYPES = [(t, k) for k, ts in R.SOURCE_TYPES.items() for t in ts]
ORACLE = {
    "name_scan": f"SELECT id, {_NAME} AS name, CAST({_SPECIFIC} AS VARCHAR) AS specific FROM {_T}",
    "name_scan_tables": f"""WITH f AS (SELECT 'benchmark' AS kind, text FROM benchmark UNION ALL SELECT 'conversations', text FROM conversations UNION ALL SELECT 'documents', text FROM documents)
SELECT kind, {_NAME} IS NOT NULL AS named, count(*) AS n FROM f GROUP BY 1, 2""",
    "name_evidence": f"""WITH n AS (SELECT id, role, {_NAME} AS name, {_SPECIFIC} AS specific FROM {_T}, (VALUES ('tool'), ('params'), ('freetext')) r(role))
SELECT id, role, CASE WHEN name IS NULL THEN '' WHEN role = 'tool' OR (role = 'params' AND specific) THEN 'ai:X names ' || name || CASE WHEN name = {_q(R.PARTIAL_GENERATORS[0])} THEN {_q(R.PARTIAL_MARK)} ELSE '' END || ':' || name
  WHEN specific THEN 'weak:X mentions ' || name || ':' || name ELSE 'weak:X mentions ' || name || ' (ambiguous wording):-' END AS evidence FROM n""",
    "freetext_ladder": f"""WITH {_JSON} SELECT id, CASE WHEN {_KEYS} >= 2 THEN 'settings' WHEN {_GRAPH} THEN 'node graph' WHEN len(keys) >= 3 THEN 'json'
  WHEN regexp_matches(text, {_q(R.JOB_ID)}) THEN 'job id' WHEN regexp_matches(text, {_q(R.PROMPT_FLAGS)}) THEN 'prompt flags' WHEN {_NAME} IS NOT NULL THEN 'name: ' || {_NAME} ELSE 'nothing' END AS rung FROM g""",
    "a1111_keys": f"SELECT id, {_KEYS} AS n, {_KEYS} >= 2 AS settings FROM {_T}",
    "json_keys": f"WITH {_JSON} SELECT id, coalesce(array_to_string(keys, '|'), '') AS keys FROM g",
    "json_props": "SELECT array_to_string(json_keys(props), '|') AS keys, count(*) AS n FROM events GROUP BY 1",
    "node_graphs": f"WITH {_JSON} SELECT id, {_GRAPH} AS graph FROM g",
    "xmp_values": "SELECT id, " + ", ".join(f"array_to_string({_xmp(n)}, '|') AS {n.lower()}" for n in ("CreatorTool", "title", "DigitalSourceType", "Make")) + f" FROM {_P}",
    "html_titles": f"SELECT page_id, array_to_string({_xmp('title', 'html')}, '|') AS titles, array_to_string({_xmp('class', 'html')}, '|') AS classes FROM pages",
    "dst_terms": f"SELECT id, array_to_string({_TERMS}, '|') AS terms FROM {_P}",
    "source_type_info": f"""WITH v AS (SELECT * FROM (VALUES {', '.join(f"({_q(t)}, {_q(k)}, {str(t in R.RETIRED_TYPES).lower()}, {str(t in R.PARTIAL_TYPES).lower()})" for t, k in _ALL_TYPES)}) t(term, kind, retired, partial)),
e AS (SELECT id, unnest({_TERMS}) AS w, generate_subscripts({_TERMS}, 1) AS i FROM {_P}),
m AS (SELECT e.id, v.*, row_number() OVER (PARTITION BY e.id ORDER BY v.kind <> 'ai', i) AS rn FROM e JOIN v ON lower(e.w) = lower(v.term))
SELECT p.id, m.term, m.kind, CAST(m.retired AS VARCHAR) AS retired, CAST(m.partial AS VARCHAR) AS partial FROM {_P.replace(') t(', ') p(')} LEFT JOIN m ON p.id = m.id AND rn = 1""",
    "png_key_class": f"""SELECT id, CASE WHEN lower(key) = 'xml:com.adobe.xmp' THEN 'xmp' WHEN lower(key) IN ({', '.join(_q(k) for k in R.VENDOR_KEYS)}) THEN 'vendor'
  WHEN lower(key) = 'dream' AND len(regexp_extract_all(value, {_q(R.DREAM_FLAG)})) >= 2 THEN 'vendor' WHEN lower(key) IN ({', '.join(_q(k) for k in R.PARAM_KEYS)}) THEN 'params'
  WHEN lower(key) IN ('software', 'source') THEN 'tool' WHEN lower(key) IN ({', '.join(_q(k) for k in R.FREETEXT_KEYS)}) THEN 'freetext' ELSE 'other' END AS class FROM {_C}""",
    "generator_precedence": "SELECT * FROM (VALUES (1::BIGINT, 'Midjourney'), (2::BIGINT, 'Krea'), (3::BIGINT, 'other diffusion model'), (4::BIGINT, NULL)) t(id, generator)",
    "aigc_tags": f"""WITH a AS (SELECT id, list_zip(regexp_extract_all(text, '<\\s*([\\w.-]+):([\\w.-]+)[^>]*>([^<]{{0,64}})', 1), regexp_extract_all(text, '<\\s*([\\w.-]+):([\\w.-]+)[^>]*>([^<]{{0,64}})', 2),
  regexp_extract_all(text, '<\\s*([\\w.-]+):([\\w.-]+)[^>]*>([^<]{{0,64}})', 3)) AS tags, list_zip(regexp_extract_all(text, '[\\s"]([\\w.-]+):([\\w.-]+)\\s*=\\s*"([^"]*)"', 1),
  regexp_extract_all(text, '[\\s"]([\\w.-]+):([\\w.-]+)\\s*=\\s*"([^"]*)"', 2), regexp_extract_all(text, '[\\s"]([\\w.-]+):([\\w.-]+)\\s*=\\s*"([^"]*)"', 3)) AS attrs FROM {_P})
SELECT id, array_to_string(list_sort(list_distinct(list_transform(list_filter(list_concat(tags, list_filter(attrs, lambda t: lower(t[1]) <> 'xmlns')),
  lambda t: (regexp_matches(t[1], {_q(R.AIGC_NAME)}) OR regexp_matches(t[2], {_q(R.AIGC_NAME)})) AND NOT list_contains([{', '.join(_q(x) for x in R.DENIALS)}], lower(trim(t[3])))), lambda t: t[1] || ':' || t[2]))), '|') AS tags FROM a""",
    "clip_text": "SELECT item_id, CASE WHEN length(text) > 40 THEN left(text, 40) || '...' ELSE text END AS text FROM benchmark",
}

# What the rules must find, worked out by hand.
_FLAGS = (
    (1, True, False, "XMP:CreatorTool names Midjourney"),
    (2, True, False, "XMP declares digitalSourceType=trainedAlgorithmicMedia"),
    (3, True, True, "XMP declares digitalSourceType=compositeSynthetic (generated element, not whole image)"),
    (4, False, False, "no provenance evidence"),
    (5, False, False, "no provenance evidence"),
    (6, True, False, "XMP carries generative-AI namespace tags: TC260:AIGC"),
    (7, False, False, "no provenance evidence"),
    (8, True, False, "XMP carries generative-AI namespace tags: genai:model"),
    (9, False, False, "no provenance evidence"),
    (10, False, False, "no provenance evidence"),
)
_CHUNK_EVIDENCE = (
    (1, "ai:PNG 'parameters' chunk holds A1111 generation settings:Stable Diffusion (A1111-style)|ai:PNG:parameters names FLUX / Black Forest Labs:FLUX / Black Forest Labs"),
    (2, "ai:PNG 'Prompt' chunk holds a ComfyUI node graph:ComfyUI"),
    (3, "ai:PNG:Software names Krea:Krea"),
    (4, "weak:PNG:Comment mentions Krea (ambiguous wording):-"),
    (5, "ai:PNG 'invokeai_metadata' chunk is a InvokeAI record:InvokeAI"),
    (6, "ai:PNG 'dream' chunk is a InvokeAI record:InvokeAI"),
    (7, ""),
    (8, "weak:PNG:Title mentions Midjourney:Midjourney"),
    (9, ""),
    (10, ""),
    (11, "ai:PNG 'aiframework' chunk is a unknown diffusion pipeline record:unknown diffusion pipeline|weak:PNG:aiframework mentions other diffusion model (ambiguous wording):-"),
    (12, "ai:PNG 'workflow' chunk holds generation parameters (sampler, seed, steps):unknown diffusion pipeline"),
)
ORACLE["evidence_flags"] = "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {str(a).lower()}, {str(b).lower()}, false, {_q(d)})" for i, a, b, d in _FLAGS) + ") t(id, says_ai, partial_ai, says_camera, description)"
ORACLE["png_evidence"] = f"SELECT * FROM {_values(_CHUNK_EVIDENCE, 'id, evidence')}"
