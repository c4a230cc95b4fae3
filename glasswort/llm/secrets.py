"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is
derived: any match must contain, for every clause, all trigrams of one of
its alternatives.  The index has a posting for each document and each
trigram that some query names; intersecting a document's postings leaves
the rules that may match it, and only those are verified on the whole text.
A rule without a mandatory trigram scans every text.

Postings are keyed by a 128-bit hash of id and text.  A document's postings
come from one task, so they combine before the shuffle, to one small row
for each document.
"""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ascii_lower, documents, few, materialize, wide_hash


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of pattern whose group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False


# The rules, in the order in which they break ties.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", base=True),
    Rule("hex", r"[0-9a-f]{32,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Strings that a derivation carries along, and characters of a class that it spells out.
_STRINGS, _CLASS = 64, 8

Query = list[list[frozenset[str]]]


def _clause(strings: set[str]) -> list[frozenset[str]] | None:
    """OR over strings of AND over their trigrams; None if a string has no trigram."""
    if any(len(s) < 3 for s in strings):
        return None
    alternatives = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings}
    return sorted((a for a in alternatives if not any(b < a for b in alternatives)), key=sorted)


def _walk(items, query: Query) -> set[str] | None:
    """All strings that items can match, lower-cased, or None; clauses found on the way go to query."""
    held: set[str] = {""}
    exact = True

    def flush() -> None:
        nonlocal held, exact
        if (clause := _clause(held)) is not None:
            query.append(clause)
        held, exact = {""}, False

    for op, arg in items:
        found: set[str] | None = None
        inner: Query = []
        if op is sre.LITERAL:
            found = {chr(arg).lower()}
        elif op is sre.IN and all(kind in (sre.LITERAL, sre.RANGE) for kind, _ in arg):
            chars = {chr(c).lower() for kind, a in arg for c in ([a] if kind is sre.LITERAL else range(a[0], min(a[1], a[0] + 99) + 1))}
            found = chars if len(chars) <= _CLASS else None
        elif op is sre.SUBPATTERN:
            found = _walk(arg[3], inner)
        elif op is sre.BRANCH:
            branches = [_walk(branch, []) for branch in arg[1]]
            found = set().union(*branches) if all(b is not None for b in branches) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, body = arg
            once = _walk(body, inner)
            if once is not None and high == 1:
                found = once | ({""} if low == 0 else set())
            elif once is not None and low == high and len(once) ** low <= _STRINGS:
                found = reduce(lambda a, b: {x + y for x in a for y in b}, [once] * low, {""})
            elif low == 0:
                inner = []
        if found is not None and len(found) * len(held) <= _STRINGS:
            held = {a + b for a in held for b in found}
            continue
        flush()
        if found is not None:
            held = found
        else:
            query += inner
    if exact:
        return held
    flush()
    return None


def trigram_query(pattern: str) -> Query:
    """An AND of ORs of ANDs of lower-case trigrams that every match of pattern satisfies; empty: no mandatory trigram."""
    query: Query = []
    whole = _walk(sre_parser.parse(pattern), query)
    if whole is not None and (clause := _clause(whole)) is not None:
        query.append(clause)
    return query


def _masks(terms: frozenset[str], vocabulary: list[str]) -> dict[int, int]:
    """63-bit words of the set of terms, by word."""
    words: dict[int, int] = {}
    for t in terms:
        at = vocabulary.index(t)
        words[at // 63] = words.get(at // 63, 0) | 1 << at % 63
    return words


def _key(id_col: str, text: Column) -> tuple[Column, Column]:
    return wide_hash(F.col(id_col), text)


def postings(docs: DataFrame, id_col: str, text_col: str, vocabulary: list[str]) -> DataFrame:
    """The inverted index: (term int, k1, k2), a row for each document and each term of vocabulary in it."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    k1, k2 = _key(id_col, text)
    low = docs.select(k1.alias("k1"), k2.alias("k2"), ascii_lower(text).alias("low"))
    terms = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(t)), F.lit(i)) for i, t in enumerate(vocabulary)]))
    return low.select(F.explode(terms).alias("term"), "k1", "k2")


def candidates(index: DataFrame, queries: list[Query], vocabulary: list[str]) -> DataFrame:
    """(k1, k2, rules long): bit r is set where the intersected postings satisfy query r; rows without a bit are left out."""
    words = range(-(-len(vocabulary) // 63))
    bit = F.expr("shiftleft(1L, term % 63)")
    joint = index.groupBy("k1", "k2").agg(*[F.bit_or(F.when(F.floor(F.col("term") / 63) == w, bit).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in words])
    has = lambda terms: reduce(lambda a, b: a & b, [F.col(f"w{w}").bitwiseAND(F.lit(m)) == m for w, m in _masks(terms, vocabulary).items()])
    rules = F.lit(0).cast("long")
    for r, query in enumerate(queries):
        if query:
            meets = reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, [has(terms) for terms in clause]) for clause in query])
            rules = rules + F.when(meets, F.lit(1 << r).cast("long")).otherwise(F.lit(0).cast("long"))
    return joint.select("k1", "k2", rules.alias("rules")).where("rules <> 0")


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _spans(text: Column, rule: Rule, kind: int) -> Column:
    """(start, kind, end) of a rule's matches in code points: the pieces between matches and the matches, laid end to end."""
    pieces, matches = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    tested = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    laid = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), tested.alias("tested"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"])
        end = start + F.coalesce(F.length(x["match"]), F.lit(0))
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).cast(_SPANS)
        good = x["match"].isNotNull() & (F.length(x["tested"]) >= rule.least)
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["found"], span)).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("found"))
    return F.aggregate(laid, start, step, lambda acc: acc["found"])


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with __spans added: array of (start, kind, end), kind a place in rules, sorted by start, then kind.

    A null or empty text has no span.  Texts are read whole; positions are
    code points, ends exclusive.  Rows of equal id and text share their
    postings and get equal spans.  An empty table gives an empty result.
    """
    queries = [trigram_query(rule.pattern) for rule in rules]
    vocabulary = sorted({t for query in queries for clause in query for terms in clause for t in terms})
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed, may = docs.select("*"), F.lit(0).cast("long")
    if vocabulary:
        found = materialize(candidates(postings(docs.select(id_col, text_col), id_col, text_col, vocabulary), queries, vocabulary), "candidates")
        found = few(found)
        k1, k2 = _key(id_col, text)
        keyed = docs.select("*", k1.alias("__k1"), k2.alias("__k2")).join(found.toDF("__c1", "__c2", "__rules"), (F.col("__k1") == F.col("__c1")) & (F.col("__k2") == F.col("__c2")), "left")
        may = F.coalesce("__rules", F.lit(0).cast("long"))
    none, parts = F.array().cast(_SPANS), []
    for r, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        named = may.bitwiseAND(F.lit(1 << r).cast("long")) != 0 if query else F.lit(True)
        parts.append(F.when(named & text.rlike(rule.pattern), _spans(text, rule, r)).otherwise(none))
    return keyed.select(*docs.columns, F.array_sort(F.concat(*parts)).alias("__spans"))


def _named(spans: Column, rules: tuple[Rule, ...]) -> Column:
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("__spans", lambda s: s["kind"] == [r.kind for r in RULES].index(kind))).cast("long")
    base = F.filter("__spans", lambda s: s["kind"].isin([i for i, r in enumerate(RULES) if r.base]))
    return found.select(
        "doc_id",
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(_named(base, RULES), 256).alias("base_sha256"),
        _named(F.col("__spans"), RULES).alias("spans"),
    )


def _oracle() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    parts = []
    for r, rule in enumerate(RULES):
        p = quote(rule.pattern)
        parts.append(
            f"""SELECT doc_id, {r} AS kind, {quote(rule.kind)} AS name, {rule.base} AS base, i, pieces, found,
  tested[i] AS t FROM (SELECT doc_id, string_split_regex(text, {p}) AS pieces, regexp_extract_all(text, {p}, 0) AS found,
  regexp_extract_all(text, {p}, {rule.group}) AS tested, unnest(generate_series(1, len(regexp_extract_all(text, {p}, 0)))) AS i
  FROM d WHERE regexp_matches(text, {p})) WHERE length(tested[i]) >= {rule.least}"""
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS ({" UNION ALL ".join(parts)}),
s AS (
  SELECT doc_id, kind, name, base,
    CAST(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS a,
    length(found[i]) AS n FROM m),
g AS (
  SELECT doc_id, count(*) FILTER (name = 'assign') AS n_assign, count(*) FILTER (name = 'access') AS n_access, count(*) FILTER (name = 'hex') AS n_hex,
    string_agg(name || ':' || a || ':' || (a + n), ',' ORDER BY a, kind) FILTER (base) AS base,
    string_agg(name || ':' || a || ':' || (a + n), ',' ORDER BY a, kind) AS spans
  FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.doc_id = g.doc_id"""


QUERIES = {"op5_secrets": op5_secrets}
ORACLE = {"op5_secrets": _oracle()}
