"""Operators on texts against brute force, over rows with every awkward value."""

import hashlib
import random
import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glasswort.llm import bpe, fingerprint, line_dedup, secrets, suffix_dedup

WS = " \t\n\x0b\x0c\r"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, line string, k1 long, h1 long, n string"


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", None, None, "x", 1, 2, "n") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


# line dedup


def lines_brute(texts, min_docs, min_chars):
    key = lambda line: line.strip(WS).translate(UP)
    docs: dict[str, set] = {}
    for i, t in enumerate(texts):
        for line in (t or "").split("\n"):
            docs.setdefault(key(line), set()).add(i)
    gone = {k for k, d in docs.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for t in texts:
        parts = (t or "").split("\n")
        kept = [p for p in parts if key(p) not in gone]
        out.append((len(parts), len(parts) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("min_docs", [2, 3])
def test_line_dedup(spark, min_docs):
    rng = random.Random(min_docs)
    pool = ["", " ", "a", "A ", "\tB\r", "É", "é", "long line " * 50, "x\x0by"]
    texts = [None, "", "\n", "\n\n", *("\n".join(rng.choice([*pool, str(rng.random())]) for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    found = line_dedup.dedup_lines(table(spark, texts), min_docs=min_docs)
    got = {r.doc_id: (r["__n_lines"], r["__n_dropped"], r["__kept"]) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == lines_brute(texts, min_docs, 1)
    assert found.columns[:9] == ["doc_id", "text", "lang", "source", "n_chars", "line", "k1", "h1", "n"]


def test_line_dedup_repeated_rows_and_none(spark):
    docs = table(spark, ["a\nb", "a\nb", "a"], [7, 7, None])
    got = sorted((r.doc_id or -1, r["__kept"]) for r in line_dedup.dedup_lines(docs, min_docs=2).collect())
    assert got == [(-1, ""), (7, "b"), (7, "b")]
    assert line_dedup.dedup_lines(docs.limit(0)).collect() == []


# fingerprints


def canon(t):
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t or "").casefold()).split())


def test_fingerprints(spark):
    texts = [None, "", "  ", "Straße", "STRASSE", "ﬁne  text", "fine\ntext", "Å", "Å", "x y", "X Y", "é" * 3000, "a", "a"]
    got = {r.doc_id: r["__fingerprint"] for r in fingerprint.fingerprints(table(spark, texts)).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (canon(a) == canon(b)), (a, b)
    assert fingerprint.fingerprints(table(spark, texts).limit(0)).collect() == []


def edited_brute(rows):
    """(id, length, edited, canonical form's, of the edited, near, near) in descending order of id."""
    order = sorted(rows, key=lambda r: -r[0])
    out = {}
    for at, (i, t) in enumerate(order):
        t, after = t or "", order[(at + 1) % len(order)][1] or ""
        third = len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        out[i] = (len(t), edited, float(canon(t) == canon(edited)), float(canon(t) == canon(after)))
    return out


@pytest.mark.parametrize(("n", "stretch"), [(0, 5), (1, 5), (2, 5), (300, 7), (300, 250_000)])
def test_edited_texts(spark, monkeypatch, n, stretch):
    monkeypatch.setattr(fingerprint, "STRETCH", stretch)
    rng = random.Random(n)
    ids = rng.sample(range(-5000, 5000), n)
    texts = [rng.choice([None, "", "a", "Ab c", "é😀 x" * rng.randrange(9), "same text " * 3, "SAME  text " * 3]) for _ in ids]
    got = {r.doc_id: (r.n_chars, r.edited, r.near_edited, r.near_next) for r in fingerprint.compared_with_edited(table(spark, texts, ids)).collect()}
    assert got == edited_brute(list(zip(ids, texts, strict=True)))


def test_edited_texts_with_ties_nulls_and_repeats(spark):
    rows = [("abc", 5), ("xyz", 5), ("mno", None), ("def", 1), ("pqr", None), ("pqr", None), ("pqr", None), (None, 1)]
    docs = table(spark, [t for t, _ in rows], [i for _, i in rows])
    got = [(r.doc_id, r.edited) for r in fingerprint.compared_with_edited(docs).collect()]
    assert len(got) == 8 and sorted(str(i) for i, _ in got) == sorted(str(i) for _, i in rows)
    # ids 5, 5, 1, 1, null four times, then the first again; ties in some fixed order, copies next to each other
    heads = {i: {(t or "")[:1] for t, j in rows if j == i} for i in (5, 1, None)}
    for i, edited in got:
        if edited:
            assert edited[2:] in heads[i] | heads[{5: 1, 1: None, None: 5}[i]]
    assert sum(e == "pqp" for _, e in got) >= 2


def test_collided_buckets(spark, monkeypatch):
    texts = [None, "A  b", "a b", "other words", "something else", "a b"]
    docs = table(spark, texts)
    plain = {r.doc_id: r["__fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    monkeypatch.setattr(fingerprint, "bucket_hash", lambda form: (F.length(form).cast("long") * 0, F.octet_length(form).cast("long") * 0))
    got = {r.doc_id: r["__fingerprint"] for r in fingerprint.fingerprints(docs).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (got[i] == got[j]) == (plain[i] == plain[j]) == (canon(a) == canon(b))
    assert all(len(x) == 32 + 1 + 64 for x in got.values())
    edited = {r.doc_id: (r.n_chars, r.edited, r.near_edited, r.near_next) for r in fingerprint.compared_with_edited(docs).collect()}
    assert edited == edited_brute(list(enumerate(texts)))
    with pytest.raises(ValueError, match="names"):
        fingerprint.fingerprints(docs.withColumn("__fp_h1", F.lit(1)))


def test_fingerprint_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    found = fingerprint.op4_fingerprint(spark, sf)
    assert found.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = found.collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got} == {i: (n, sha(e), x, y) for i, (n, e, x, y) in edited_brute(rows).items()}
    forms = {}
    for r in got:
        forms.setdefault(r.fingerprint, set()).add(canon(dict(rows)[r.doc_id]))
    assert all(len(f) == 1 for f in forms.values()) and len(forms) == len({canon(t) for _, t in rows})


# secrets


def spans_brute(text):
    out = []
    for k, rule in enumerate(secrets.RULES):
        pattern = rule.pattern.replace("(?i:password|passwd|secret|token|api_?key)", "[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]")
        for m in re.finditer(pattern, text or ""):
            if len(m.group(rule.group)) >= rule.least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def secret_texts():
    rng = random.Random(3)
    bits = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "'", '"', " ", "=", ":", "abcdefgh", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "deadbeef", "é😀", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36, "xoxb-1234567890ab", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return [None, "", "secret=api_key = \"ABCDEFGHIJ", "password: x", "AKIA" + "A" * 11, "AKIA" + "A" * 12, "0" * 31, "0" * 32, "é" * 500 + "token=12345678", *texts]


def test_secrets(spark):
    texts = secret_texts()
    got = {r.doc_id: [tuple(s) for s in r["__spans"]] for r in secrets.scan(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == spans_brute(t), t
    assert secrets.scan(table(spark, texts).limit(0)).collect() == []


def test_every_match_meets_its_query():
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        for t in secret_texts():
            if t and any(k == secrets.RULES.index(rule) for _, k, _ in spans_brute(t)):
                low = t.translate(UP)
                assert all(any(all(g in low for g in terms) for terms in clause) for clause in query)
    assert secrets.trigram_query(r"[0-9a-f]{32,}") == [] and secrets.trigram_query("a.b") == []
    assert secrets.trigram_query("AKIA[A-Z0-9]{12,}") == [[frozenset({"aki", "kia"})]]
    assert secrets.trigram_query("(abcd|xyz)?lmn") == [[frozenset({"lmn"})]]


# repeated strings


def repeats_brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        mask = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mask[i : i + length] = True
        spans = int((np.diff(mask.astype(int), prepend=0) == 1).sum())
        out.append((len(d), int(mask.sum()), spans, bytes(np.frombuffer(d, np.uint8)[~mask])))
    return out


@pytest.mark.parametrize("largest", [suffix_dedup.CLASS, 3, 1])
def test_suffix_dedup(spark, monkeypatch, largest):
    monkeypatch.setattr(suffix_dedup, "CLASS", largest)
    rng = random.Random(9)
    words = ["alpha", "beta", "gamma", "délta", "epsilon", "zeta", "eta"]
    long = lambda n: "".join(rng.choice(words) + rng.choice(" .,") for _ in range(n))
    base = [long(400) for _ in range(6)]
    texts = [None, "", "y" * 399, "z" * 400, "a" * 1000, "ab" * 500, base[0], base[0], *base[1:]]
    for n in (395, 399, 400, 401, 450, 800):
        s = base[rng.randrange(1, 6)]
        at = rng.randrange(0, 500)
        texts += [long(20) + s[at : at + n] + long(30), s[at : at + n]]
    near = list(base[2])
    for at in range(0, len(near), 350):
        near[at] = "#"
    texts.append("".join(near))
    found = suffix_dedup.remove_repeats(table(spark, texts))
    got = {r.doc_id: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) for r in found.collect()}
    assert [got[i] for i in range(len(texts))] == repeats_brute(texts, suffix_dedup.LENGTH)
    assert suffix_dedup.remove_repeats(table(spark, texts).limit(0)).collect() == []


@pytest.mark.parametrize("largest", [suffix_dedup.CLASS, 3, 1])
def test_repeated_rows_are_repeats(spark, monkeypatch, largest):
    monkeypatch.setattr(suffix_dedup, "CLASS", largest)
    docs = table(spark, ["q" * 200 + "r" * 300] * 2, [1, 1])
    assert [r["__n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()] == [500, 500]


def test_nothing_goes_that_the_construction_does_not_find(spark, monkeypatch):
    texts = ["".join(random.Random(7).choice("abc") for _ in range(900))] * 3
    assert [r["__n_removed"] for r in suffix_dedup.remove_repeats(table(spark, texts)).collect()] == [900] * 3
    monkeypatch.setattr(suffix_dedup, "_settled", lambda cells, *a: cells.select("gram", "kind", F.col("p").alias("a"), F.col("p").alias("b")).limit(0))
    assert [r["__n_removed"] for r in suffix_dedup.remove_repeats(table(spark, texts)).collect()] == [0] * 3


def test_patterns_of_letters_are_no_repeats(spark):
    one = "a"
    while len(one) < 1024:
        one += one.translate(str.maketrans("ab", "ba"))
    texts = [one, one.translate(str.maketrans("ab", "ba"))]
    got = {r.doc_id: (r["__n_bytes"], r["__n_removed"], r["__n_spans"], bytes(r["__kept"])) for r in suffix_dedup.remove_repeats(table(spark, texts)).collect()}
    assert [got[i] for i in range(2)] == repeats_brute(texts, suffix_dedup.LENGTH)


def test_suffix_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = suffix_dedup.op6_suffix(spark, sf)
    assert found.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = dict(zip(docs, [(n, r, s, hashlib.sha256(k).hexdigest()) for n, r, s, k in repeats_brute(list(docs.values()), suffix_dedup.LENGTH)], strict=True))
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()} == want


def test_column_wise_construction():
    rng = random.Random(4)
    strings, begin = [], []
    for _ in range(200):
        b = rng.randrange(0, 5)
        strings.append(bytes(rng.choice(b"ab") for _ in range(rng.randrange(8, 20 - b))))
        begin.append(b)
    found = suffix_dedup.construct(strings, np.array(begin), 20, 8, 6)
    for i, (s, b) in enumerate(zip(strings, begin, strict=True)):
        for c in range(8):
            own = s[c - b : c - b + 6] if c >= b else b""
            others = {t[c - d : c - d + 6] for j, (t, d) in enumerate(zip(strings, begin, strict=True)) if j != i and c >= d}
            assert found[i, c] == (len(own) == 6 and own in others)


def test_winnowed_runs_cover_all_starts():
    rng = random.Random(8)
    data = bytes(rng.choice(b"abcd ") for _ in range(3000))
    p, more, lead, _, _ = suffix_dedup.runs(data)
    assert [s for a, m in zip(p, more, strict=True) for s in range(a, a + m + 1)] == list(range(len(data) - suffix_dedup.LENGTH + 1))
    assert ((lead >= more) & (lead <= suffix_dedup.LENGTH - suffix_dedup.GRAM)).all()


# byte-level BPE


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers as P
    import tiktoken

    with open(P.path(bpe.FILE), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    return bpe.Encoder(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=200))
def test_bpe_like_the_library(tokenizers, text):
    mine, theirs = tokenizers
    ids = mine.encode(text)
    assert [int(x) for x in ids.split()] == theirs.encode_ordinary(text)
    assert mine.decode(ids) == text.encode()


def test_bpe_long_pieces_and_table(spark, tokenizers):
    import public_tokenizers as P

    mine, theirs = tokenizers
    texts = [None, "", " ", "<|endoftext|>", "a" * 20000, "ab" * 9000, "é😀" * 2000, "It's  \n\n a test", "It's  \n\n a test"]
    rows = bpe.encode_table(table(spark, texts), "text", P.path(bpe.FILE), P.PATTERN).collect()
    for r in rows:
        t = texts[r.doc_id] or ""
        assert list(r.ids) == theirs.encode_ordinary(t) and bytes(r.decoded) == t.encode() and r.n_tokens == len(r.ids)
    assert bpe.encode_table(table(spark, texts).limit(0), "text", P.path(bpe.FILE), P.PATTERN).collect() == []
    clash = spark.createDataFrame([("a b", 7, "x")], "text string, n_tokens int, ids string")
    row = bpe.encode_table(clash, "text", P.path(bpe.FILE), P.PATTERN).first()
    assert (row.input_n_tokens, row.input_ids, row.n_tokens, bytes(row.decoded)) == (7, "x", 2, b"a b")


def test_bpe_forgets_and_stays_right(tokenizers):
    mine, theirs = tokenizers
    small = bpe.Encoder({t: int(i) for i, t in mine.tokens.items()}, mine_pattern(), 3)
    text = "one two three four five six seven one two three"
    assert [int(x) for x in small.encode(text).split()] == theirs.encode_ordinary(text)


def mine_pattern():
    import public_tokenizers as P

    return P.PATTERN


NONE = 1 << 32


class SegmentTree:
    """The least of n keys under point updates."""

    __slots__ = ("size", "tree")

    def __init__(self, keys: list[int]):
        size = 1
        while size < len(keys):
            size *= 2
        tree = [NONE * 4096] * size + keys + [NONE * 4096] * (size - len(keys))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        self.size, self.tree = size, tree

    def least(self) -> int:
        return self.tree[1]

    def put(self, at: int, key: int) -> None:
        tree, i = self.tree, at + self.size
        tree[i] = key
        while i > 1:
            other = tree[i ^ 1]
            if other < key:
                key = other
            i >>= 1
            if tree[i] == key:
                break
            tree[i] = key


def test_segment_tree():
    rng = random.Random(2)
    keys = [rng.randrange(1000) for _ in range(37)]
    tree = SegmentTree(list(keys))
    for _ in range(500):
        i, k = rng.randrange(37), rng.randrange(1000)
        keys[i] = k
        tree.put(i, k)
        assert tree.least() == min(keys)


def merged_by_tree(piece, ranks):
    """bpe.merge() in words: the tree's root is the lowest rank, at the leftmost place that has it."""
    parts = {i: piece[i : i + 1] for i in range(len(piece))}
    after = lambda i: min((j for j in parts if j > i), default=None)
    key = lambda i: NONE * 4096 if after(i) is None or parts[i] + parts[after(i)] not in ranks else ranks[parts[i] + parts[after(i)]] * 4096 + i
    tree = SegmentTree([key(i) for i in range(len(piece))])
    while tree.least() < NONE * 4096 and (i := tree.least() % 4096) in parts:
        j = after(i)
        parts[i] += parts.pop(j)
        tree.put(j, NONE * 4096)
        for k in [i, *([max(p for p in parts if p < i)] if any(p < i for p in parts) else [])]:
            tree.put(k, key(k))
    return [parts[i] for i in sorted(parts)]


def test_merging_by_a_segment_tree(tokenizers):
    mine, _ = tokenizers
    ranks = {token: int(rank) for rank, token in mine.tokens.items()}
    rng = random.Random(5)
    for n in (2, 3, 7, 40, 90):
        piece = bytes(rng.choice(b"the cat sat on aaab") for _ in range(n))
        assert bpe.merge(piece, ranks) == merged_by_tree(piece, ranks)


def test_bpe_query(spark, sf, tokenizers):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = bpe.op10_bpe(spark, sf).collect()
    assert len(rows) == n and all(r.decoded_sha256 == sha((texts[r.doc_id] or "").encode()) for r in rows)
    _, theirs = tokenizers
    for r in rows:
        ids = theirs.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
