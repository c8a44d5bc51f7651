"""License scans by an exact set-similarity join; DataFrame functions only.

A text block is a run of words of a document: blocks of 2 * step words begin at every step-th word, so
every run of step + 1 words lies whole in a block, whatever lines it is wrapped over. A template is
compared with blocks of a step that it fits in with room for some words more. A block matches a
template if it holds at least ``THRESHOLD`` of the template's distinct words and, word for word, the
phrases that tell the licence from its kin ("mit license", "version 3").

Words are ordered by their number of occurrences over all documents, rarest first (ties by the word).
If a block and a template share o = ceil(t * |T|) words, then the block holds one of the template's
first |T| - o + 1 words (its prefix) within its own first |B| - o + 1; so only blocks around a prefix
word are made, and candidates come from joining blocks with the templates' prefixes on a word. Length
filter: a block with fewer than o template words can't match. Positional filter: at a shared word in
places i and j, at most 1 + min(|T| - i, |B| - j) words are still to be shared. Candidates that pass
are verified by intersecting the two sets and looking for the phrases.

The templates are fixed texts, so their postings are a small table of constant size, which is
broadcast. Texts are read twice, for the counts and for everything else; only the blocks of a few
documents and the rows of matches go on.

Fixed phrases are looked up besides: places where their words stand consecutively in the text.

Defined results: null texts count as empty (no words, null first and last word, score 0);
repeated rows each get the same result; a null doc_id keeps its row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cut

THRESHOLD = 0.8
#: Words between the starts of blocks; a template of up to step - 3 words is compared with blocks of 2 * step words.
STEPS = (16, 32)
#: Phrases and labels of the contract.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Notices by which public licenses are commonly declared, their labels, and phrases that must stand in them.
TEMPLATES = (
    ("released under the mit license", "mit", ("mit license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit", ("permission is hereby granted",)),
    ("licensed under the apache license version 2 0", "apache-2", ("apache license", "version 2")),
    ("licensed under cc by nc 4 0", "cc-by-nc", ("cc by nc",)),
    ("this work is licensed under the gnu general public license version 3", "gpl-3", ("gnu general public license", "version 3")),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", ("gnu general public license",)),
    ("licensed under the gnu lesser general public license version 3", "lgpl-3", ("lesser general public license", "version 3")),
    ("licensed under the gnu affero general public license version 3", "agpl-3", ("affero general public license", "version 3")),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", ("mozilla public license",)),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", ("source and binary forms",)),
    ("licensed under the creative commons attribution 4 0 international license", "cc-by", ("attribution 4 0",)),
    ("licensed under the creative commons attribution sharealike 4 0 international license", "cc-by-sa", ("attribution sharealike 4 0",)),
    ("this is free and unencumbered software released into the public domain", "unlicense", ("public domain",)),
)

#: What separates words, after A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _templates() -> list[tuple[int, str, frozenset[str], int, int, tuple[str, ...]]]:
    """(number, label, words, words to share, step of its blocks, phrases)."""
    out = []
    for k, (text, label, core) in enumerate(TEMPLATES):
        words = frozenset(text.split())
        step = next(s for s in STEPS if len(text.split()) <= s - 3)
        out.append((k, label, words, math.ceil(round(THRESHOLD * len(words), 9)), step, core))
    return out


VOCABULARY = sorted(frozenset().union(*(w for _, _, w, *_ in _templates())))


def worded(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, words), A-Z lowered.

    ``lower`` is many times faster than ``translate``; that it lowers other letters too moves no word's
    ends, and only U+0130 and U+212A become ASCII letters by it, so texts with those are translated.
    """
    text = F.coalesce("text", F.lit(""))
    odd = F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a"))
    low = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.split(low, GAP).alias("parts"))
    # only the first and the last part can be empty: what is before a gap that begins the text, and after one that ends it
    begin = F.when(F.get("parts", 0) == "", 2).otherwise(1)
    size = F.size("parts") - begin + 1 - F.when((F.size("parts") > 1) & (F.element_at("parts", -1) == ""), 1).otherwise(0)
    return rows.select("doc_id", "mark", F.slice("parts", begin, F.greatest(size, F.lit(0))).alias("words"))


def word_counts(rows: DataFrame) -> list[tuple[str, int]]:
    """Occurrences over all rows of each word of the templates."""
    words = rows.select(F.explode(F.filter("words", lambda w: w.isin(VOCABULARY))).alias("word"))
    found = {r["word"]: r["n"] for r in words.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most the vocabulary
    return [(w, found.get(w, 0)) for w in VOCABULARY]


def ranks(counts: list[tuple[str, int]]) -> dict[str, int]:
    return {w: k for k, (_, w) in enumerate(sorted((n, w) for w, n in counts))}


def postings(rank: dict[str, int]) -> list[tuple[int, int, int, list[int], int, int, int, list[str]]]:
    """(template, step, rank of a prefix word, ranks of all words, size, place of the word from 1, words to share, phrases)."""
    out = []
    for k, _, words, need, step, core in _templates():
        ordered = sorted(rank[w] for w in words)
        out += [(k, step, r, ordered, len(ordered), i + 1, need, [f" {c} " for c in core]) for i, r in enumerate(ordered[: len(ordered) - need + 1])]
    return out


def _blocks_of(step: int, prefix: list[str], number: Column) -> Column:
    """The blocks of one step around each word of ``prefix``: array<struct<step, at, held: ranks of template words, text>>."""
    words = F.col("words")

    def starts(at: Column) -> Column:
        nth = (at / step).cast("int")
        return F.array(nth * step, F.greatest(nth - 1, F.lit(0)) * step)

    def block(at: Column) -> Column:
        part = F.slice(words, at + 1, 2 * step)
        held = F.array_sort(F.array_compact(F.transform(F.array_distinct(part), lambda w: number[w])))
        return F.struct(F.lit(step).alias("step"), at.alias("at"), held.alias("held"), F.concat(F.lit(" "), F.array_join(part, " "), F.lit(" ")).alias("text"))

    places = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(prefix))
    near = F.array_distinct(F.flatten(F.transform(places, starts)))
    none = F.array().cast("array<struct<step: int, at: int, held: array<int>, text: string>>")
    return F.when(F.arrays_overlap(words, F.array(*map(F.lit, prefix))), F.transform(near, block)).otherwise(none)


def _blocks(rank: dict[str, int]) -> Column:
    """The blocks of ``words`` around the prefix words of the templates."""
    names = {r: w for w, r in rank.items()}
    number = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    return F.concat(*[_blocks_of(step, sorted({names[p[2]] for p in postings(rank) if p[1] == step}), number) for step in STEPS])


def matches(blocks: DataFrame, rank: dict[str, int]) -> DataFrame:
    """``blocks`` (doc_id, mark, blocks) -> (doc_id, mark, at, template, share) of every block that holds enough of a template."""
    table = blocks.sparkSession.createDataFrame(postings(rank), "template int, step int, word int, others array<int>, size int, i int, need int, core array<string>")
    rows = blocks.select("doc_id", "mark", F.inline("blocks")).where(F.size("held") >= min(need for _, _, _, need, *_ in _templates()))
    places = rows.select("*", F.posexplode("held").alias("j", "word"))
    size, j = F.size("held"), F.col("j") + 1
    # the postings are a constant table; both sides' prefixes, the lengths and the places bound the candidates
    able = places.join(F.broadcast(table), ["step", "word"]).where((size >= F.col("need")) & (j <= size - F.col("need") + 1) & (F.least(F.col("size") - F.col("i"), size - j) + 1 >= F.col("need")))
    shared = F.size(F.array_intersect("held", "others"))
    told = F.forall("core", lambda c: F.contains(F.col("text"), c))
    found = able.select("doc_id", "mark", "at", "template", (shared / F.col("size")).alias("share"), ((shared >= F.col("need")) & told).alias("enough"))
    return found.where("enough").select("doc_id", "mark", "at", "template", "share").distinct()


def _places(phrase: str, label: str) -> Column:
    """Word indexes (from 0) at which the phrase's words stand consecutively, with its label."""
    want, words = phrase.split(), F.col("words")
    last = F.size(words) - len(want)
    same = lambda i: (F.get(words, i) == want[0]) & (F.array_join(F.slice(words, i + 1, len(want)), " ") == phrase)
    found = F.transform(F.filter(F.sequence(F.lit(0), last), same), lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))
    able = last >= 0
    for w in want:
        able = able & F.array_contains(words, w)
    return F.when(able, found).otherwise(F.array().cast("array<struct<at: int, label: string>>"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, places: array<struct<at, label>>, found: array<struct<at, template, share>>)."""
    rows = worded(docs)
    rank = ranks(word_counts(rows))
    seen = cut(rows.select("doc_id", "mark", F.size("words").cast("long").alias("n_words"), F.concat(*[_places(p, label) for p, label in PHRASES]).alias("places"), _blocks(rank).alias("blocks")))
    hits = matches(seen.where(F.size("blocks") > 0), rank).groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("at", "template", "share"))).alias("found"))
    hits = hits.withColumnRenamed("doc_id", "id").withColumnRenamed("mark", "hash")
    joined = seen.drop("blocks").join(hits, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("hash")), "left")
    return joined.select("doc_id", "n_words", "places", F.coalesce("found", F.array().cast("array<struct<at: int, template: int, share: double>>")).alias("found"))


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)."""
    labels = F.array(*[F.lit(label) for _, label, _ in TEMPLATES])
    base = F.transform("places", lambda p: p["label"])
    own = F.transform("found", lambda m: F.get(labels, m["template"]))
    text = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    at = F.transform("places", lambda p: p["at"].cast("long"))
    best = F.array_max(F.transform("found", lambda m: m["share"]))
    return scan(docs).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        text(base).alias("base_labels"), text(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )


def sql() -> str:
    """DuckDB SQL: every block against every template, and every word position against every phrase."""
    templates = ", ".join(f"({k}, '{label}', {sorted(words)}, {need}, {step}, {[f' {c} ' for c in core]})" for k, label, words, need, step, core in _templates())
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in PHRASES)
    steps = ", ".join(f"({s})" for s in STEPS)
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
    w AS (SELECT rid, doc_id, regexp_extract_all(low, '{word}') AS words FROM d),
    phrases(phrase, label, n) AS (VALUES {phrases}),
    templates(nr, label, words, need, step, core) AS (VALUES {templates}),
    steps(step) AS (VALUES {steps}),
    places AS (
      SELECT rid, i - 1 AS pos, label FROM (SELECT rid, words, unnest(range(1, len(words) + 1)) AS i FROM w), phrases
      WHERE words[i] = split_part(phrase, ' ', 1) AND array_to_string(words[i:i + n - 1], ' ') = phrase),
    starts AS (SELECT rid, words, step, unnest(range(0, len(words), step)) AS ofs FROM w, steps),
    parts AS (SELECT rid, step, words[ofs + 1:ofs + 2 * step] AS part FROM starts),
    blocks AS (SELECT rid, step, list_distinct(part) AS held, ' ' || array_to_string(part, ' ') || ' ' AS line FROM parts),
    found AS (
      SELECT rid, label, len(list_intersect(held, words)) / len(words) AS share FROM blocks JOIN templates USING (step)
      WHERE len(list_intersect(held, words)) >= need AND len(list_filter(core, lambda c: contains(line, c))) = len(core)),
    b AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rid),
    s AS (SELECT rid, max(share) AS share FROM found GROUP BY rid),
    l AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM found UNION ALL SELECT rid, label FROM places) GROUP BY rid)
    SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
      coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS DOUBLE) AS score
    FROM w LEFT JOIN b USING (rid) LEFT JOIN s USING (rid) LEFT JOIN l USING (rid)"""
