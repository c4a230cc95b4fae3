"""What texts of a file say about how it was made, as column expressions.

Evidence is an array of (kind, text, generator): kind is ai, weak, camera or
error; generator the name that a claim carries, or null.  Arrays keep the
order in which claims were found, which decides the generator's name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .let import let

EVIDENCE = "array<struct<kind:string,text:string,generator:string>>"
TOOL, PARAMS, FREETEXT = "tool", "params", "freetext"

# Patterns of generator names in order of precedence (searched
# in any letter case), the name, and whether the wording is specific enough
# not to occur in ordinary prose.
GENERATORS = (
    (r"midjourney|\bmj[\s_-]?v?[456]\b", "Midjourney", True),
    (r"stable[\s_-]?diffusion|automatic\s?1111|\bsd[\s_-]?webui\b|\bsdxl\b|stable[\s_-]?cascade|\bfooocus\b|\bdreamstudio\b", "Stable Diffusion", True),
    (r"comfy[\s_-]?ui", "ComfyUI", True),
    (r"dall[\s_.·∙-]?e\b", "DALL-E / OpenAI", True),
    (r"\bopenai\b|\bgpt[\s-]?image\b", "DALL-E / OpenAI", False),
    (r"black[\s_-]?forest[\s_-]?labs|\bflux[\s._-]?(?:1[\s._-]?)?(?:dev|schnell|pro|kontext|krea)\b", "FLUX / Black Forest Labs", True),
    (r"\bflux\b", "FLUX / Black Forest Labs", False),
    (r"generative\s+(?:fill|expand|remove|erase|recolou?r)|\bneural\s+filters\b", "Adobe Firefly (generative edit)", True),
    (r"adobe\s+firefly|\bfirefly[\s_-]?image\b", "Adobe Firefly", True),
    (r"\bfirefly\b", "Adobe Firefly", False),
    (r"\bimagen[\s._-]?\d|nano[\s_-]?banana", "Google Imagen / Gemini", True),
    (r"\bimagen\b|\bgemini\b|google\s+ai\b|\bvertex\s+ai\b", "Google Imagen / Gemini", False),
    (r"\bnovel\s?ai\b", "NovelAI", True),
    (r"leonardo[\s._-]?ai\b", "Leonardo.Ai", True),
    (r"\bideogram\b", "Ideogram", False),
    (r"\bkrea[\s._-]?ai\b", "Krea", True),
    (r"\bkrea\b", "Krea", False),
    (r"invoke[\s_-]?ai\b", "InvokeAI", True),
    (r"\brecraft[\s._-]?(?:ai|v\d)\b", "Recraft", True),
    (r"\bgrok[\s_-]?(?:imagine|\d)\b|\bx\.ai\b", "xAI Grok", True),
    (r"\bgrok\b|\bxai\b", "xAI Grok", False),
    (r"\bcanva\b[^.\n]{0,40}\b(?:magic|ai)\b", "Canva AI", True),
    (r"\bseedream\b|\bseededit\b|\bjimeng\b|byte\s?dance\s+(?:seed|ai)", "ByteDance Seedream", True),
    (r"\bqwen[\s._-]?image\b|tongyi\s*wanxiang|\bwanx\b", "Qwen / Tongyi Wanxiang", True),
    (r"\bhunyuan[\s._-]?(?:dit|image|\d)|\bhailuo\b", "Tencent Hunyuan", True),
    (r"\bkling[\s._-]?(?:ai|\d)", "Kling", True),
    (r"\bcogview\b|\bernie[\s._-]?vilg\b", "Zhipu CogView / ERNIE", True),
    (r"runway\s?ml\b|\brunway\s+gen[\s._-]?\d", "Runway", True),
    (r"luma\s?labs\b|luma[\s._-]?(?:ai|dream)", "Luma", True),
    (r"bing\s+image\s+creator|microsoft\s+designer|image\s+creator\s+from\s+designer", "Microsoft Designer / Bing", True),
    (r"\bmeta[\s._-]?ai\b|\bemu[\s._-]?(?:image|edit)\b|imagine\.meta", "Meta AI", True),
    (r"\bcivitai\b|\btensor\.?art\b|\bseaart\b|\bshakker\b", "Civitai / TensorArt", True),
    (r"\bswarm\s?ui\b|stable\s?swarm|\bdrawthings\b|diffusion\s?bee|\bsd\.next\b|\bautomatic1111\b", "local diffusion UI", True),
    (r"\bfreepik\b|getimg\.ai|\bnightcafe\b|\bartbreeder\b|\bcraiyon\b|\bstarryai\b|\bwombo\b|\bpika\s?labs\b|\bmage\.space\b", "other hosted generator", True),
    (r"\bstability[\s._-]?ai\b|\bstable[\s._-]?image[\s._-]?(?:core|ultra)\b", "Stability AI", True),
    (r"\bchatgpt\b|\bsora[\s._-]?\d\b", "DALL-E / OpenAI", True),
    (r"\bdeci[\s_-]?diffusion\b|\bplayground\s?v?\d", "other diffusion model", True),
    (r"\bdiffusers\b|\bkandinsky\b", "other diffusion model", False),
)
# For each pattern in the same order, lower-case words of which any match has one.
ANCHORS = (
    ("midjourney", "mj"),
    ("diffusion", "automatic", "webui", "sdxl", "cascade", "fooocus", "dreamstudio"),
    ("comfy",),
    ("dall",),
    ("openai", "gpt"),
    ("forest", "flux"),
    ("flux",),
    ("generative", "neural"),
    ("firefly",),
    ("firefly",),
    ("imagen", "banana"),
    ("imagen", "gemini", "google", "vertex"),
    ("novel",),
    ("leonardo",),
    ("ideogram",),
    ("krea",),
    ("krea",),
    ("invoke",),
    ("recraft",),
    ("grok", "x.ai"),
    ("grok", "xai"),
    ("canva",),
    ("seedream", "seededit", "jimeng", "dance"),
    ("qwen", "wanxiang", "wanx"),
    ("hunyuan", "hailuo"),
    ("kling",),
    ("cogview", "ernie"),
    ("runway",),
    ("luma",),
    ("creator", "designer"),
    ("meta", "emu"),
    ("civitai", "tensor", "seaart", "shakker"),
    ("swarm", "drawthings", "diffusion", "sd.next", "automatic1111"),
    ("freepik", "getimg", "nightcafe", "artbreeder", "craiyon", "starryai", "wombo", "pika", "mage.space"),
    ("stability", "stable"),
    ("chatgpt", "sora"),
    ("deci", "playground"),
    ("diffusers", "kandinsky"),
)
# Names that only say that something was generated; a specific one replaces them.
PLACEHOLDERS = ("other diffusion model", "other hosted generator", "local diffusion UI", "unknown diffusion pipeline", "unknown (AIGC-labelled)")
# Names, and the mark, of a generated region in a photograph.
PARTIAL_GENERATORS = ("Adobe Firefly (generative edit)",)
PARTIAL_MARK = " (generated element, not whole image)"
# Terms of the digital source type vocabulary.
SOURCE_TYPES = {
    "ai": ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicallyEnhanced", "algorithmicMedia", "dataDrivenMedia", "compositeSynthetic"),
    "camera": ("digitalCapture", "computationalCapture", "negativeFilm", "positiveFilm", "print"),
    "neutral": ("humanEdits", "digitalCreation", "screenCapture", "virtualRecording", "composite", "compositeCapture", "minorHumanEdits", "softwareImage", "digitalArt"),
}
RETIRED_TYPES = ("algorithmicMedia", "minorHumanEdits", "softwareImage", "digitalArt")
PARTIAL_TYPES = ("compositeWithTrainedAlgorithmicMedia", "algorithmicallyEnhanced", "compositeSynthetic")
SOURCE_TYPE_URI = r"https?://(?:cv\.iptc\.org/newscodes/digitalsourcetype/|c2pa\.org/digitalsourcetype/)([A-Za-z]+)"
# Property names of generative namespaces, and values that deny the claim.
AIGC_NAME = r"(?i)(?:^|[:_.-])(?:aigc|genai|gen_ai|generativeai|aigeneratedcontent)"
DENIALS = ("false", "0", "no", "none", "off", "n", "unknown", "")
# Keys of generation settings in text and in JSON.
SETTING_KEYS = ("Steps:", "Sampler:", "CFG scale:", "Seed:", "Model hash:", "Denoising strength:", "Schedule type:", "Negative prompt:", "Clip skip:")
SAMPLING_KEYS = ("steps", "sampler", "seed", "cfg_scale", "uc", "negative_prompt", "noise_schedule", "generation_mode", "sm_dyn", "scheduler")
OTHER_JSON_KEYS = ("scale", "strength", "model", "prompt", "app_version")
JOB_ID = r"(?i)Job ID:\s*[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
PROMPT_FLAGS = r"(?i)--(?:v|ar|q|style|chaos|niji|stylize|sref|cref)\s+\S"
DREAM_FLAG = r"(?:^|\s)-[sSWHCAfInGUv]\s*[\d.]"
# Keys of PNG text chunks, in lower case.
VENDOR_KEYS = {
    "invokeai_metadata": "InvokeAI",
    "invokeai_graph": "InvokeAI",
    "sd-metadata": "InvokeAI",
    "fooocus_scheme": "Stable Diffusion",
    "aiframework": "unknown diffusion pipeline",
}
PARAM_KEYS = ("parameters", "prompt", "workflow", "generation_data", "sui_image_params")
TOOL_KEYS = ("software", "source")
FREETEXT_KEYS = ("title", "author", "description", "copyright", "disclaimer", "warning", "comment", "dream")
# XMP properties that name tools, describe the subject, or record capture.
XMP_TOOL = ("CreatorTool", "Software", "softwareAgent")
XMP_FREETEXT = ("Credit", "creator", "description", "title", "rights")
XMP_CAMERA = {
    "Make": "Make",
    "Model": "Model",
    "Lens": "LensModel",
    "ExposureTime": "ExposureTime",
    "FNumber": "FNumber",
    "ISOSpeedRatings": "ISOSpeedRatings",
    "FocalLength": "FocalLength",
    "DateTimeOriginal": "DateTimeOriginal",
    "GPSLatitude": "GPS",
}


def none() -> Column:
    return F.array().cast(EVIDENCE)


def claim(kind: str | Column, text: Column, generator: Column | None = None) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    return F.array(F.struct(kind.alias("kind"), text.alias("text"), (F.lit(None).cast("string") if generator is None else generator).alias("generator"))).cast(EVIDENCE)


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def generator_name(text: Column) -> Column:
    """(name, specific) of the first pattern that a text matches, or null.

    Searches for plain words come first: they cost a small part of a
    regular expression's, and most texts have none of them.
    """

    def chain(low: Column) -> Column:
        found = None
        for (pattern, name, specific), words in zip(GENERATORS, ANCHORS, strict=True):
            value = F.struct(F.lit(name).alias("name"), F.lit(specific).alias("specific"))
            hit = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]) & text.rlike(f"(?iU){pattern}")
            found = F.when(hit, value) if found is None else found.when(hit, value)
        return found

    # the one letter besides capitals that matches an ASCII one in any case
    return let(F.replace(F.lower(text), F.lit("\u017f"), F.lit("s")), chain)


def name_evidence(where: Column, text: Column, role: Column) -> Column:
    """Decisive in a field that names the tool, and for a specific name among parameters; a weak hint anywhere else.

    A specific name in a weak place still names the generator.
    """

    def weigh(hit: Column) -> Column:
        name, specific = hit["name"], hit["specific"]
        decisive = (role == TOOL) | ((role == PARAMS) & specific)
        mark = F.when(name.isin(*PARTIAL_GENERATORS), PARTIAL_MARK).otherwise("")
        return (
            F.when(name.isNull(), none())
            .when(decisive, claim("ai", _text(where, " names ", name, mark), name))
            .when(specific, claim("weak", _text(where, " mentions ", name), name))
            .otherwise(claim("weak", _text(where, " mentions ", name, " (ambiguous wording)")))
        )

    return let(generator_name(text), weigh)


def setting_keys(text: Column) -> Column:
    """How many of the settings block's keys a text has."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(k)).cast("int") for k in SETTING_KEYS])


def is_settings(text: Column) -> Column:
    """Two keys: a caption may have one of its own."""
    return setting_keys(text) >= 2


def _as_map(text: Column) -> Column:
    return F.from_json(text, "map<string,string>")


def is_node_graph(text: Column) -> Column:
    """A JSON object with a value that has class_type, or nodes that have type and widgets_values; of JSON cut short, the quoted key."""
    flat = _as_map(text)
    objects = F.exists(F.map_values(flat), lambda v: F.coalesce(F.array_contains(F.json_object_keys(v), "class_type"), F.lit(False)))
    nodes = F.from_json(F.try_element_at(flat, F.lit("nodes")), "array<map<string,string>>")
    shaped = F.exists(nodes, lambda n: F.coalesce(F.map_contains_key(n, "type") & F.map_contains_key(n, "widgets_values"), F.lit(False)))
    whole = F.try_parse_json(text).isNotNull()
    found = F.coalesce(objects, F.lit(False)) | F.coalesce(shaped, F.lit(False))
    guard = F.contains(text, F.lit("class_type")) | F.contains(text, F.lit('"nodes"'))
    return F.when(~guard, False).when(whole, found).otherwise(F.contains(text, F.lit('"class_type"')))


def json_keys(text: Column) -> Column:
    """Sorted generation keys of a JSON object, flattened by one level; none unless one belongs to sampling."""
    inner = F.flatten(F.transform(F.map_values(_as_map(text)), lambda v: F.coalesce(F.json_object_keys(v), F.array().cast("array<string>"))))
    keys = F.array_distinct(F.concat(F.json_object_keys(text), F.coalesce(inner, F.array().cast("array<string>"))))
    known = F.array_sort(F.filter(keys, lambda k: F.lower(k).isin(*SAMPLING_KEYS, *OTHER_JSON_KEYS)))
    sampled = F.exists(known, lambda k: F.lower(k).isin(*SAMPLING_KEYS))
    return F.when(F.try_parse_json(text).isNotNull() & F.coalesce(sampled, F.lit(False)), known).otherwise(F.array().cast("array<string>"))


def record_evidence(where: Column, what: Column, text: Column, kind: Column, vendor: Column | None = None) -> Column:
    """Evidence of a field by its kind, without its source types; every rule stands here once.

    vendor: the key alone is a claim.  params: generation settings, then
    names.  freetext and ladder_params: fields into which tools put whole
    records, so structured shapes count in full, and only without one do
    names.  tool and names: names alone.  Anything else says nothing.
    """

    def judge(c: Column) -> Column:
        settings = claim("ai", _text(what, " holds A1111 generation settings"), F.lit("Stable Diffusion (A1111-style)"))
        graph = claim("ai", _text(what, " holds a ComfyUI node graph"), F.lit("ComfyUI"))
        listed = F.when(c["kind"] == "params", _text(" (", F.array_join(F.slice(c["keys"], 1, 5), ", "), ")")).otherwise("")
        keys = claim("ai", _text(what, " holds generation parameters", listed), F.lit("unknown diffusion pipeline"))
        job = claim("ai", _text(what, " holds a Midjourney job id"), F.lit("Midjourney"))
        hint = c["kind"] == "freetext"
        flags = claim(F.when(hint, "weak").otherwise("ai"), _text(what, F.when(hint, " carries").otherwise(" holds"), " Midjourney prompt flags"), F.lit("Midjourney"))
        whole = c["kind"].isin("freetext", "ladder_params")
        record = none() if vendor is None else claim("ai", _text(what, " is a ", vendor, " record"), vendor)
        shapes = (
            F.when(c["kind"] == "vendor", record)
            .when(~whole & (c["kind"] != "params"), none())
            .when(whole & c["settings"], settings)
            .when(c["graph"], graph)
            .when(c["settings"], settings)
            .when(F.size(c["keys"]) >= 3, keys)
            .when(whole & text.rlike(JOB_ID), job)
            .when(whole & text.rlike(PROMPT_FLAGS), flags)
            .otherwise(none())
        )
        role = F.when(c["kind"] == "tool", TOOL).when(c["kind"].isin("vendor", "params", "ladder_params"), PARAMS).otherwise(FREETEXT)

        def names(found: Column) -> Column:
            wanted = c["kind"].isin("vendor", "tool", "names") | ((c["kind"] == "params") & ~c["graph"]) | (whole & (F.size(found) == 0))
            return F.concat(found, F.when(wanted, name_evidence(where, text, role)).otherwise(none()))

        return let(shapes, names)

    record = kind.isin("params", "freetext", "ladder_params")
    no_keys = F.array().cast("array<string>")
    facts = F.struct(
        kind.alias("kind"),
        (record & is_settings(text)).alias("settings"),
        F.when(record, is_node_graph(text)).otherwise(False).alias("graph"),
        F.when(record & F.contains(text, F.lit("{")), json_keys(text)).otherwise(no_keys).alias("keys"),
    )
    return let(facts, judge)


def ladder(where: Column, what: Column, text: Column, role: Column) -> Column:
    """A field into which tools put whole records: structured shapes count in full anywhere, names by the field's role."""
    return record_evidence(where, what, text, F.when(role == PARAMS, "ladder_params").otherwise("freetext"))


def ladder_rung(text: Column) -> Column:
    """Which rung of ladder() a text stands on."""
    name = generator_name(text)["name"]
    return (
        F.when(is_settings(text), "settings")
        .when(is_node_graph(text), "node graph")
        .when(F.size(json_keys(text)) >= 3, "json")
        .when(text.rlike(JOB_ID), "job id")
        .when(text.rlike(PROMPT_FLAGS), "prompt flags")
        .when(name.isNotNull(), _text("name: ", name))
        .otherwise("nothing")
    )


def xmp_values(text: Column, local: str) -> Column:
    """Values of a property by its local name under any prefix: attributes, then elements without their tags; empty ones left out."""
    attribute = F.regexp_extract_all(text, F.lit(rf'(?U)(?:^|[\s"])(?:[\w.-]+:)?{local}\s*=\s*"([^"]*)"'), F.lit(1))
    element = F.regexp_extract_all(text, F.lit(rf"(?sU)<[\w.-]*:?{local}(?:\s[^>]*)?>(.*?)</[\w.-]*:?{local}>"), F.lit(1))
    bare = F.transform(element, lambda v: F.regexp_replace(v, "<[^>]+>", " "))

    def plain(v: Column) -> Column:
        v = F.regexp_replace(v, r"^\s+|\s+$", "")
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&")):
            v = F.replace(v, F.lit(entity), F.lit(char))
        return v

    found = F.filter(F.transform(F.concat(attribute, bare), plain), lambda v: v != "")
    return F.when(F.contains(text, F.lit(local)), found).otherwise(F.array().cast("array<string>"))


def source_type_terms(text: Column) -> Column:
    """Terms as written: of vocabulary addresses anywhere, then the last part of a DigitalSourceType property."""
    bare = F.transform(xmp_values(text, "DigitalSourceType"), lambda v: F.regexp_replace(F.element_at(F.split(v, "/"), -1), r"^\s+|\s+$", ""))
    return F.concat(F.regexp_extract_all(text, F.lit(SOURCE_TYPE_URI), F.lit(1)), F.filter(bare, lambda v: v != ""))


def source_type(term: Column) -> Column:
    """(term, kind, retired, partial) of a term in any letter case; null for one that isn't in the vocabulary."""
    found = None
    for kind, terms in SOURCE_TYPES.items():
        for t in terms:
            value = F.struct(F.lit(t).alias("term"), F.lit(kind).alias("kind"), F.lit(t in RETIRED_TYPES).alias("retired"), F.lit(t in PARTIAL_TYPES).alias("partial"))
            hit = F.lower(term) == t.lower()
            found = F.when(hit, value) if found is None else found.when(hit, value)
    return found


def source_type_evidence(where: Column, text: Column) -> Column:
    def one(term: Column) -> Column:
        return let(source_type(term), lambda known: told(term, known))

    def told(term: Column, known: Column) -> Column:
        mark = F.when(known["partial"], PARTIAL_MARK).otherwise("")
        short = F.when(F.length(term) > 60, F.concat(F.left(term, F.lit(60)), F.lit("..."))).otherwise(term)
        return (
            F.when(known.isNull(), claim("error", _text(where, ": unknown digitalSourceType '", short, "'")))
            .when(known["kind"] == "ai", claim("ai", _text(where, " declares digitalSourceType=", known["term"], mark)))
            .when(known["kind"] == "camera", claim("camera", _text("digitalSourceType:", known["term"])))
            .otherwise(none())
        )

    return F.flatten(F.transform(source_type_terms(text), one))


def best_source_type(terms: Column) -> Column:
    """The first term that says generated, else the first known one."""
    known = F.filter(F.transform(terms, source_type), lambda t: t.isNotNull())
    return F.coalesce(F.get(F.filter(known, lambda t: t["kind"] == "ai"), F.lit(0)), F.get(known, F.lit(0)))


def aigc_tags(text: Column) -> Column:
    """Sorted names of tags and attributes in a generative namespace whose value is no denial; declarations of namespaces don't count."""
    tag, attribute = r"<\s*([\w.-]+):([\w.-]+)[^>]*>([^<]{0,64})", r'[\s"]([\w.-]+):([\w.-]+)\s*=\s*"([^"]*)"'
    parts = lambda p: F.arrays_zip(*[F.regexp_extract_all(text, F.lit(f"(?U){p}"), F.lit(i)).alias(n) for i, n in ((1, "prefix"), (2, "local"), (3, "value"))])
    claims = lambda t: (t["prefix"].rlike(AIGC_NAME) | t["local"].rlike(AIGC_NAME)) & ~F.lower(F.regexp_replace(t["value"], r"^\s+|\s+$", "")).isin(*DENIALS)
    tags = F.filter(parts(tag), claims)
    attributes = F.filter(parts(attribute), lambda t: (F.lower(t["prefix"]) != "xmlns") & claims(t))
    return F.array_sort(F.array_distinct(F.transform(F.concat(tags, attributes), lambda t: F.concat(t["prefix"], F.lit(":"), t["local"]))))


def png_key_class(key: Column, value: Column) -> Column:
    """Of a text chunk's key, in any letter case: xmp, vendor, params, tool, freetext or other; `dream` is a vendor's if the value has two flags."""
    name = F.lower(key)
    return (
        F.when(name == "xml:com.adobe.xmp", "xmp")
        .when(name.isin(*VENDOR_KEYS), "vendor")
        .when((name == "dream") & (F.regexp_count(value, F.lit(DREAM_FLAG)) >= 2), "vendor")
        .when(name.isin(*PARAM_KEYS), "params")
        .when(name.isin(*TOOL_KEYS), "tool")
        .when(name.isin(*FREETEXT_KEYS), "freetext")
        .otherwise("other")
    )


def png_vendor(key: Column) -> Column:
    found = F.lit("InvokeAI")
    for k, v in VENDOR_KEYS.items():
        found = F.when(F.lower(key) == k, F.lit(v)).otherwise(found)
    return found


def png_evidence(key: Column, value: Column) -> Column:
    """Evidence of a PNG text chunk, without its source types."""
    return record_evidence(_text("PNG:", key), _text("PNG '", key, "' chunk"), value, png_key_class(key, value), png_vendor(key))


def _field(local: str, role: str):
    return lambda v: F.struct(F.lit(f"XMP:{local}").alias("where"), v.alias("value"), F.lit(role).alias("role"))


def xmp_evidence(text: Column) -> Column:
    """Evidence of a file's XMP packets, joined by newlines."""
    parts = [source_type_evidence(F.lit("XMP"), text)]
    fields = []
    for names, role in ((XMP_TOOL, TOOL), (XMP_FREETEXT, FREETEXT)):
        for local in names:
            fields.append(F.transform(xmp_values(text, local), _field(local, role)))
    parts.append(F.flatten(F.transform(F.concat(*fields), lambda f: name_evidence(f["where"], f["value"], f["role"]))))
    for local, fact in XMP_CAMERA.items():
        parts.append(F.when(F.size(xmp_values(text, local)) > 0, claim("camera", F.lit(fact))).otherwise(none()))
    flagged = lambda tags: claim("ai", _text("XMP carries generative-AI namespace tags: ", F.array_join(F.slice(tags, 1, 4), ", ")), F.lit("unknown (AIGC-labelled)"))
    parts.append(let(aigc_tags(text), lambda tags: F.when(F.size(tags) > 0, flagged(tags)).otherwise(none())))
    return F.concat(*parts)


def generator_of(evidence: Column) -> Column:
    """The first specific name, else the first placeholder."""
    names = F.filter(F.transform(evidence, lambda e: e["generator"]), lambda g: g.isNotNull())
    return F.coalesce(F.get(F.filter(names, lambda g: ~g.isin(*PLACEHOLDERS)), F.lit(0)), F.get(names, F.lit(0)))


def texts_of(evidence: Column, kind: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter(evidence, lambda e: e["kind"] == kind), lambda e: e["text"])))


def says_ai(ai: Column) -> Column:
    return F.size(ai) > 0


def partial_ai(ai: Column) -> Column:
    return says_ai(ai) & F.forall(ai, lambda e: F.contains(e, F.lit(PARTIAL_MARK)))


def says_camera(camera: Column, ai: Column) -> Column:
    return (F.size(camera) >= 2) & ~says_ai(ai)


def describe(ai: Column, weak: Column) -> Column:
    return F.when(says_ai(ai), F.array_join(ai, "; ")).when(F.size(weak) > 0, F.concat(F.lit("weak only: "), F.array_join(weak, "; "))).otherwise("no provenance evidence")
