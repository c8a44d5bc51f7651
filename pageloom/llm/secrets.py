"""Secret scans by a trigram inverted index; DataFrame functions only.

From each rule's regular expression a Boolean trigram query is derived: a disjunction over the
alternatives of its literal text, each a conjunction of that literal's trigrams. The index holds a
posting (trigram, document) for every trigram that some query names; one pass over a text finds them
all. Postings are intersected by document: one row a document with the set of its trigrams as bit
masks, made by a partial aggregation, so no trigram's postings are gathered in one place, however
frequent. Rules whose
query holds for a document are its candidates, and only those expressions run on it; a rule without
mandatory trigrams (hex runs) scans every text.

Candidates are joined back by (doc_id, hash of the text). If the candidate table is small, which
is measured, it is broadcast; otherwise it is joined by a shuffle.

Defined results: null texts count as empty and have no spans; repeated rows each get the same
spans; a null doc_id keeps its row; very long texts are scanned whole; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cut
from pageloom.llm.spans import match_spans

#: A candidate table of at most so many rows (40 bytes each) is broadcast.
BROADCAST_ROWS = 200_000


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The least length of ``group`` for a match to count.
    group: int = 0
    least: int = 0
    #: Base rules are fixed by contract; the others are the method's own.
    base: bool = False
    query: tuple[frozenset[str], ...] = field(default=())


def _expand(pattern: str) -> list[str]:
    """The literal texts that a pattern's leading literals, alternations and optional characters allow.

    Understands literals, escapes, (a|b), x? and classes of one letter's two cases; anything else
    ends the literal. Lower case throughout.
    """
    out, i, depth_group = [""], 0, re.compile(r"\((?:\?:)?((?:[^()\[\]\\]|\[[^\]]*\]|\\.)*)\)")
    while i < len(pattern):
        c = pattern[i]
        if (m := depth_group.match(pattern, i)) and not pattern[m.end() : m.end() + 1] in ("*", "+", "{"):
            options = [w for part in m[1].split("|") for w in _expand(part)]
            if m[1] and any(_stops(part) for part in m[1].split("|")):
                break
            i = m.end()
        elif m := re.compile(r"\[([a-z])([A-Z])\]").match(pattern, i):
            if m[1] != m[2].lower():
                break
            options, i = [m[1]], m.end()
        elif c == "\\" and i + 1 < len(pattern) and not pattern[i + 1].isalnum():
            options, i = [pattern[i + 1].lower()], i + 2
        elif c in "[](){}*+?.|^$\\":
            break
        else:
            options, i = [c.lower()], i + 1
        after = pattern[i : i + 1]
        if after in ("*", "+", "{"):
            break
        if after == "?":
            options, i = [*options, ""], i + 1
        out = [a + b for a in out for b in options]
    return out


def _stops(part: str) -> bool:
    """Whether ``part`` holds more than its expansion says."""
    return not all(re.fullmatch(part, w, re.I) for w in _expand(part))


def trigram_query(pattern: str) -> tuple[frozenset[str], ...]:
    """A disjunction of conjunctions of lower-case trigrams that every match's text satisfies; empty if there is none."""
    literals = _expand(pattern)
    if any(len(w) < 3 for w in literals):
        return ()
    clauses = {frozenset(w[k : k + 3] for k in range(len(w) - 2)) for w in literals}
    return tuple(sorted((c for c in clauses if not any(d < c for d in clauses)), key=sorted))


def rule(kind: str, pattern: str, group: int = 0, least: int = 0, base: bool = False) -> Rule:
    return Rule(kind, pattern, group, least, base, trigram_query(pattern))


WORDS = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + either_case("api") + "_?" + either_case("key")
ASSIGN = rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The base rules in the order of the contract, then the method's own.
RULES = (
    rule("assign", ASSIGN, 2, 12, True),
    rule("access", "AKIA[A-Z0-9]{14,}", base=True),
    rule("hex", "[0-9a-f]{16,}", base=True),
    rule("github", "(ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{36,}"),
    rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    rule("slack", "(xoxb-|xoxp-|xoxa-|xoxr-|xoxs-)[0-9A-Za-z-]{10,}"),
    rule("stripe", "(sk_live_|rk_live_)[0-9A-Za-z]{16,}"),
    rule("google", "AIza[0-9A-Za-z_-]{35}"),
)
TRIGRAMS = sorted({t for r in RULES for clause in r.query for t in clause})
#: Bits of a mask that are used; as many masks as the trigrams need.
BITS = 62


def _any_of(grams: list[str]) -> str:
    """A pattern that finds, at every place of a text, the trigram that starts there."""
    quoted = lambda c: c if c.isalnum() else f"\\x{ord(c):02x}"
    heads: dict[str, dict[str, str]] = {}
    for a, b, c in grams:
        rest = heads.setdefault(a, {})
        rest[b] = rest.get(b, "") + quoted(c)
    paths = "|".join(quoted(a) + "(?:" + "|".join(f"{quoted(b)}[{c}]" for b, c in rest.items()) + ")" for a, rest in heads.items())
    return f"(?=({paths}))"


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, mark): null texts empty; mark tells rows of one doc_id with differing texts apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))


def index(docs: DataFrame) -> DataFrame:
    """Postings (trigram, doc_id, mark) of every trigram that a query names."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(_any_of(TRIGRAMS)), F.lit(1))
    return docs.select(F.explode(F.array_distinct(found)).alias("trigram"), "doc_id", "mark")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, mark, rules): the bits of the rules whose trigram query the document's postings satisfy."""
    place = {t: divmod(k, BITS) for k, t in enumerate(TRIGRAMS)}
    count = 1 + (len(TRIGRAMS) - 1) // BITS
    bits = []
    for m in range(count):
        mine = F.create_map(*[F.lit(x) for t, (k, b) in place.items() if k == m for x in (t, 1 << b)])
        bits.append(F.bit_or(F.coalesce(mine[F.col("trigram")], F.lit(0)).cast("long")).alias(f"mask{m}"))
    masks = postings.groupBy("doc_id", "mark").agg(*bits)
    wanted = F.lit(0).cast("long")
    for k, r in enumerate(rules):
        for clause in r.query:
            held = F.lit(True)
            for m in {place[t][0] for t in clause}:
                need = F.lit(sum(1 << place[t][1] for t in clause if place[t][0] == m)).cast("long")
                held = held & (F.col(f"mask{m}").bitwiseAND(need) == need)
            wanted = wanted.bitwiseOR(F.when(held, F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return masks.select("doc_id", "mark", wanted.alias("rules")).where("rules <> 0")


def _spans_of(r: Rule) -> Column:
    """(start, end) of a rule's matches that pass its length check."""
    text = F.col("text")
    spans = match_spans(text, r.pattern)
    if r.least:
        values = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(r.group))
        spans = F.filter(F.zip_with(spans, values, lambda s, v: F.when(F.length(v) >= r.least, s)), lambda s: s.isNotNull())
    return spans


def find(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, spans: array<struct<start, nth, end>>), nth being the rule's number."""
    rows = keyed(docs)
    able = cut(candidates(index(rows), rules))
    small = able.count() <= BROADCAST_ROWS
    able = able.withColumnRenamed("doc_id", "id").withColumnRenamed("mark", "hash")
    joined = rows.join(F.broadcast(able) if small else able, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("hash")), "left")
    none = F.array().cast("array<struct<start: bigint, nth: int, end: bigint>>")
    parts = []
    for k, r in enumerate(rules):
        spans = F.transform(_spans_of(r), _numbered(k))
        if r.query:
            wanted = F.col("rules").bitwiseAND(F.lit(1 << k)) != 0
        else:
            wanted = F.col("text").rlike(r.pattern)
        parts.append(F.when(wanted, spans).otherwise(none))
    return joined.select("doc_id", F.sort_array(F.concat(*parts)).alias("spans"))


def _numbered(k: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("nth"), s["end"].alias("end"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans): spans as kind:start:end by start, then kind as listed."""
    names = F.array(*[F.lit(r.kind) for r in RULES])
    n_base = sum(r.base for r in RULES)

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["nth"]], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(k: int) -> Column:
        return F.expr(f"cast(size(filter(spans, s -> s.nth = {k})) as bigint)").alias(f"n_{RULES[k].kind}")

    base = F.filter("spans", lambda s: s["nth"] < n_base)
    return find(docs).select("doc_id", *[count(k) for k in range(n_base)], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_spans(k: int, r: Rule) -> str:
    pattern = r.pattern.replace("'", "''")
    value = f", {r.group}" if r.group else ""
    return f"""
    SELECT rid, {k} AS nth, '{r.kind}' AS kind, s AS start, s + length(m) AS stop FROM (
      SELECT rid, m, v, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s FROM (
        SELECT rid, gaps, found, unnest(found) AS m, unnest(vals) AS v, generate_subscripts(found, 1) AS i FROM (
          SELECT rid, regexp_split_to_array(text, '{pattern}') AS gaps, regexp_extract_all(text, '{pattern}') AS found, regexp_extract_all(text, '{pattern}'{value}) AS vals
          FROM d WHERE regexp_matches(text, '{pattern}'))))
    WHERE length(v) >= {r.least}"""


def sql() -> str:
    """DuckDB SQL that runs every rule on every text, without an index."""
    spans = " UNION ALL ".join(_sql_spans(k, r) for k, r in enumerate(RULES))
    n_base = sum(r.base for r in RULES)
    said = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, nth)"
    counts = ", ".join(f"count(*) FILTER (nth = {k}) AS n_{RULES[k].kind}" for k in range(n_base))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    spans AS ({spans}),
    g AS (SELECT rid, {counts}, {said} FILTER (nth < {n_base}) AS base, {said} AS every FROM spans GROUP BY rid)
    SELECT doc_id, {", ".join(f"coalesce(n_{RULES[k].kind}, 0) AS n_{RULES[k].kind}" for k in range(n_base))},
      sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
    FROM d LEFT JOIN g USING (rid)"""
