"""Container walks and the rules on what they find, over bytes built here."""

import struct
import zlib

import pytest

from glasswort.functions import rules
from glasswort.operators import containers as C
from glasswort.operators import framing
from glasswort.operators.provenance import provenance


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(*chunks):
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 2, 0, 0, 0))
    return b"\x89PNG\r\n\x1a\n" + head + b"".join(chunks) + chunk(b"IDAT", zlib.compress(b"\0\1\2\3")) + chunk(b"IEND", b"")


def text(key, value):
    return chunk(b"tEXt", key.encode() + b"\0" + value.encode("latin-1"))


def itext(key, value, packed=False):
    body = value.encode()
    return chunk(b"iTXt", key.encode() + b"\0" + bytes([packed, 0]) + b"\0\0" + (zlib.compress(body) if packed else body))


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(*segments):
    return b"\xff\xd8" + b"".join(segments) + segment(0xDA, b"\0" * 4) + b"pixels"


def ifd(entries, order="<", base=8, extra=b""):
    """A directory of (tag, type, count, bytes); long values go behind it."""
    out, tail = struct.pack(order + "H", len(entries)), b""
    at = base + 2 + 12 * len(entries) + 4
    for tag, kind, count, value in entries:
        if len(value) <= 4:
            out += struct.pack(order + "HHI", tag, kind, count) + value.ljust(4, b"\0")
        else:
            out += struct.pack(order + "HHII", tag, kind, count, at + len(tail))
            tail += value
    return out + b"\0\0\0\0" + tail + extra


def exif(entries, sub=(), order="<"):
    magic = b"II*\0\x08\0\0\0" if order == "<" else b"MM\0*\0\0\0\x08"
    if not sub:
        return magic + ifd(entries, order)
    probe = ifd([*entries, (C.EXIF_IFD, 4, 1, b"\0" * 4)], order)
    at = 8 + len(probe)
    return magic + ifd([*entries, (C.EXIF_IFD, 4, 1, struct.pack(order + "I", at))], order) + ifd(list(sub), order, at)


def webp(*chunks):
    body = b"WEBP" + b"".join(k + struct.pack("<I", len(b)) + b + b"\0" * (len(b) % 2) for k, b in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def box(kind, body):
    return struct.pack(">I", len(body) + 8) + kind + body


def superbox(kind, label, body=b""):
    return box(b"jumb", box(b"jumd", kind + C.CONTENT_TAIL + b"\x03" + label.encode() + b"\0") + body)


def manifest(body=b""):
    return superbox(b"c2pa", "c2pa", superbox(b"c2ma", "urn:x", body))


def cbor(key, value):
    data = value.encode()
    return key.encode() + (bytes([0x60 + len(data)]) if len(data) < 24 else bytes([0x78, len(data)])) + data


CASES = {
    "empty": b"",
    "plain": png(),
    "a1111": png(text("parameters", "a cat\nSteps: 20, Sampler: Euler, Seed: 1")),
    "forked": png(text("Parameters", "Steps: 20, Sampler: Euler")),
    "comfy": png(text("prompt", '{"3": {"class_type": "KSampler", "flux-dev": 1}}')),
    "novel": png(text("Software", "NovelAI"), text("Comment", '{"steps": 28, "sampler": "k", "seed": 1, "uc": "x"}')),
    "invoke": png(itext("invokeai_metadata", "{}", True)),
    "software": png(text("Software", "Midjourney")),
    "caption": png(text("Title", "a midjourney of the flux")),
    "ambiguous": png(text("Description", "the flux of things")),
    "seed_only": png(text("Comment", "Seed: planted in spring")),
    "xmp_png": png(itext("XML:com.adobe.xmp", '<x:xmpmeta><r Iptc:DigitalSourceType="http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia"/></x:xmpmeta>')),
    "partial": png(itext("XML:com.adobe.xmp", '<x:xmpmeta><r xmp:CreatorTool="Photoshop (Generative Fill)"/></x:xmpmeta>')),
    "jpeg_comment": jpeg(segment(0xFE, b"Steps: 1, Seed: 2")),
    "jpeg_camera": jpeg(segment(0xE1, b"Exif\0\0" + exif([(0x010F, 2, 6, b"Canon\0"), (0x0110, 2, 4, b"EOS\0")], [(0x8827, 3, 1, struct.pack("<H", 100))]))),
    "jpeg_comment_field": jpeg(segment(0xE1, b"Exif\0\0" + exif([], [(0x9286, 7, 42, b"UNICODE\0" + "Steps: 3, Seed: 4".encode("utf-16-be"))], ">"))),
    "jpeg_iptc": jpeg(segment(0xED, b"Photoshop 3.0\x008BIM\x04\x04\0\0" + struct.pack(">I", 15) + b"\x1c\x02\x41\0\x0aMidjourney" + b"\0")),
    "jpeg_trailing_xmp": jpeg() + b"<x:xmpmeta><d:DigitalSourceType>digitalCapture</d:DigitalSourceType></x:xmpmeta>",
    "webp_c2pa": webp((b"C2PA", manifest(b"c2pa.actionskc2pa.created" + cbor("claim_generator", "OpenAI DALL-E") + b"http://cv.iptc.org/newscodes/digitalsourcetype/trainedAlgorithmicMedia"))),
    "signed_camera": png(chunk(b"caBX", manifest(cbor("claim_generator", "Leica")))),
    "not_a_manifest": png(chunk(b"caBX", b"nothing here")),
    "heic": box(b"ftyp", b"heic\0\0\0\0") + box(b"meta", b"\0\0\0\0" + manifest(b"http://c2pa.org/digitalsourcetype/digitalCapture")),
    "cut": png(text("parameters", "Steps: 1, Seed: 2"))[:-20],
    "noise": bytes(range(256)) * 3,
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, bytearray(v)) for k, v in CASES.items()]
    table = provenance(spark.createDataFrame(rows, "name string, content binary"))
    return {r["name"]: r for r in table.collect()}


def test_silence(found):
    for name in ("empty", "plain", "noise", "seed_only"):
        assert not found[name]["says_ai"] and found[name]["weak"] == [] and found[name]["generator"] is None


@pytest.mark.parametrize(
    ("name", "generator"),
    [
        ("a1111", "Stable Diffusion (A1111-style)"), ("forked", "Stable Diffusion (A1111-style)"), ("comfy", "ComfyUI"), ("novel", "NovelAI"), ("invoke", "InvokeAI"), ("software", "Midjourney"),
        ("jpeg_comment", "Stable Diffusion (A1111-style)"), ("jpeg_comment_field", "Stable Diffusion (A1111-style)"), ("jpeg_iptc", "Midjourney"), ("webp_c2pa", "DALL-E / OpenAI"),
    ],
)
def test_generated(found, name, generator):
    assert found[name]["says_ai"] and found[name]["generator"] == generator and not found[name]["partial_ai"]


def test_captions_are_hints(found):
    assert not found["caption"]["says_ai"] and found["caption"]["weak"] == ["PNG:Title mentions Midjourney"] and found["caption"]["generator"] == "Midjourney"
    assert found["ambiguous"]["weak"] == ["PNG:Description mentions FLUX / Black Forest Labs (ambiguous wording)"] and found["ambiguous"]["generator"] is None


def test_source_types(found):
    assert found["xmp_png"]["ai"] == ["XMP declares digitalSourceType=trainedAlgorithmicMedia"]
    assert found["xmp_png"]["source_type"]["term"] == "trainedAlgorithmicMedia"
    assert found["partial"]["partial_ai"] and found["partial"]["ai"] == ["XMP:CreatorTool names Adobe Firefly (generative edit)" + rules.PARTIAL_MARK]
    assert found["jpeg_trailing_xmp"]["camera"] == ["digitalSourceType:digitalCapture"]


def test_camera(found):
    r = found["jpeg_camera"]
    assert r["camera"] == ["ISOSpeedRatings", "Make", "Model"] and r["says_camera"] and r["raw"]["exif:Make"] == "Canon"


def test_manifests(found):
    r = found["webp_c2pa"]["c2pa"]
    assert r["structurally_confirmed"] and not r["cryptographically_validated"] and r["actions"] == ["c2pa.created"]
    assert {"c2pa.actions", "c2pa", "urn:x"} <= set(r["labels"]) and r["claim_generator"] == "OpenAI DALL-E"
    assert found["signed_camera"]["has_c2pa"] and not found["signed_camera"]["says_ai"]
    assert not found["not_a_manifest"]["has_c2pa"] and "holds no recognisable JUMBF manifest" in found["not_a_manifest"]["errors"][0]
    assert found["heic"]["has_c2pa"] and found["heic"]["camera"] == ["digitalSourceType:digitalCapture"]


def test_short_files_still_speak(found):
    assert found["cut"]["says_ai"] and found["cut"]["errors"]


def test_bounds():
    errors = []
    empty = b"\x89PNG\r\n\x1a\n" + (struct.pack(">I", 0) + b"aaaa" + b"\0" * 4) * (framing.MOST_PARTS + 5)
    assert sum(1 for _ in C.listed(framing.parts(empty, framing.PNG, 8), errors)) == framing.MOST_PARTS and "stopped walking" in errors[0]
    bomb = png(chunk(b"zTXt", b"k\0\0" + zlib.compress(b"\0" * (C.MOST_INFLATED + 1))))
    assert any("inflate cap" in e for e in C.walk(bomb).errors)
    assert any("79-byte" in e for e in C.walk(png(text("k" * 80, "v"))).errors)
    assert list(framing.parts(struct.pack(">I4sQ", 1, b"meta", 4), framing.BOX)) == []
    assert C.walk(jpeg(segment(0xE1, b"Exif\0\0xx"))).errors


def tags(data, layout, begin=0):
    return [p.tag for p in framing.parts(data, layout, begin)]


def test_layouts():
    assert tags(png(text("a", "b")), framing.PNG, 8) == [b"IHDR", b"tEXt", b"IDAT", b"IEND"]
    assert tags(png() + b"more", framing.PNG, 8)[-1] == b"IEND"
    filled = b"\xff\xd8\xff\xd0\xff\xff\xff" + segment(0xFE, b"x") + segment(0xDA, b"") + b"rest"
    assert tags(filled, framing.JPEG, 2) == [0xFE, 0xDA]
    with pytest.raises(framing.Broken):
        tags(b"\xff\xd8abcdef", framing.JPEG, 2)
    with pytest.raises(framing.Broken):
        tags(png()[:8] + struct.pack(">I", 4) + b"1234" + b"\0" * 8, framing.PNG, 8)
    odd = webp((b"XMP ", b"abc"), (b"EXIF", b"d"))
    assert [odd[p.begin : p.end] for p in framing.parts(odd, framing.RIFF, 12)] == [b"abc", b"d"]
    wide = struct.pack(">I4sQ", 1, b"mdat", 20) + b"abcd" + struct.pack(">I4s", 0, b"free") + b"tail"
    assert [(p.tag, wide[p.begin : p.end]) for p in framing.parts(wide, framing.BOX)] == [(b"mdat", b"abcd"), (b"free", b"tail")]
    inside = box(b"moov", box(b"trak", box(b"meta", b"\0" * 4 + box(b"moov", box(b"uuid", b"deep")))))
    assert [p.tag for p in framing.nested(inside, framing.BOX, C._HOLDERS, 3)] == [b"moov", b"trak", b"meta", b"moov"]


def test_manifest_parts():
    whole = manifest(superbox(b"c2as", "c2pa.assertions"))
    want = [(b"c2pa", "c2pa"), (b"c2ma", "urn:x"), (b"c2as", "c2pa.assertions")]
    assert framing.jumbf(whole, C.CONTENT_TAIL) == want
    assert framing.jumbf(superbox(b"c2pa", "c2pa")[8:], C.CONTENT_TAIL) == want[:1]  # without the outer header
    assert framing.jumbf(box(b"jumb", box(b"jumd", b"c2pa" + bytes(12) + b"\x03a\0")), C.CONTENT_TAIL) == []
    assert C.named_labels(b"kc2pa.actionskc2pa.createdx c2pa.own.thing. c2pa.org c2pa.ab") == {"c2pa.actions", "c2pa.created", "c2pa.own.thing"}


def test_cbor():
    assert framing.cbor_text(b"\x63abc", 0, 512) == "abc" and framing.cbor_text(b"\x78\x03abc", 0, 512) == "abc" and framing.cbor_text(b"\x79\0\x03abc", 0, 512) == "abc"
    for bad in (b"", b"\x60", b"\x43abc", b"\x64abc", b"\x7fabc", b"\x78", b"\x79\x02\x01" + b"a" * 513):
        assert framing.cbor_text(bad, 0, 512) is None
    assert C.claim_maker(b"claim_generator_infoxname" + b"\x65Maker") == "Maker" and C.claim_maker(cbor("claim_generator", " Tool ")) == "Tool"
    assert C.claim_maker(b"claim_generator" + b"\x18") is None


def test_text_chunks():
    long = png(chunk(b"tEXt", b"nosep"), chunk(b"zTXt", b"k\0\x01abc"), chunk(b"zTXt", b"z\0\0" + zlib.compress(b"deep")), chunk(b"iTXt", b"i\0\0"), chunk(b"iTXt", b"j\0\0\0en\0t\0" + "é".encode()), chunk(b"zTXt", b"bad\0\0xx"))
    found = C.Found()
    assert C.png_texts(long, found) == {"z": ("deep", "zTXt"), "j": ("é", "iTXt")} and len(found.errors) == 3


def test_first_text_of_a_key_wins():
    assert C.png_texts(png(text("a", "1"), text("a", "2")), C.Found())["a"] == ("1", "tEXt")


def test_user_comments():
    assert C.user_comment(b"ASCII\0\0\0abc") == "abc"
    assert C.user_comment(b"UNICODE\0" + "ab".encode("utf-16-le")) == "ab"
    assert C.user_comment(b"UNICODE\0" + "ab".encode("utf-16")) == "ab"
    assert C.user_comment(bytes(8) + b"abc") == "abc" and C.user_comment(b"abc") == "abc"


def test_jpeg_tables(spark):
    from glasswort.functions.scores import IJG_CHROMA, IJG_LUMA

    def table(base, number, quality):
        scale = 5000 // quality if quality < 50 else 200 - 2 * quality
        natural = [min(255, max(1, (b * scale + 50) // 100)) for b in base]
        return bytes([number]) + bytes(natural[i] for i in C._ZIGZAG)

    frame = segment(0xC2, struct.pack(">BHHB", 8, 8, 8, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    data = [(q, bytearray(jpeg(segment(0xE0, b"JFIF\0"), segment(0xDB, table(IJG_LUMA, 0, q) + table(IJG_CHROMA, 1, q)), frame))) for q in (30, 75, 90, 100)]
    rows = provenance(spark.createDataFrame(data, "q int, content binary")).collect()
    for r in rows:
        assert r["jpeg_quality"]["exact"] == r["q"] and r["jpeg"]["subsampling"] == "4:2:0" and r["jpeg"]["progressive"] and r["jpeg"]["has_jfif"]
