"""String rules of layout items and manifests, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip sees it, for Java regular expressions.
SPACE = r"[\s\x0B\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same characters, for trimming.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
#: Terminal punctuation and list markers, in their order of precedence.
TERMINAL = (".", "?", "!", "。", "？", "！", ";", "；")
CJK = "一二三四五六七八九十"
MARKERS = (
    ("arabic", rf"^{SPACE}*(\p{{Nd}}+)[.)]{SPACE}+"),
    ("alpha", rf"^{SPACE}*([a-zA-Z])[.)]{SPACE}+"),
    ("roman", rf"^{SPACE}*([ivxlcdmIVXLCDM]+)[.)]{SPACE}+"),
    ("bullet", rf"^{SPACE}*[•\-*>]{SPACE}+"),
    ("paren_arabic", rf"^{SPACE}*[(（](\p{{Nd}}+)[)）]{SPACE}*"),
    ("paren_cjk", rf"^{SPACE}*[(（]([{CJK}]+)[)）]{SPACE}*"),
    ("cjk_comma", rf"^{SPACE}*([{CJK}]+)[、.．]{SPACE}*"),
    ("ordinal_cjk", rf"^{SPACE}*第[{CJK}]+[，,、.．]{SPACE}*"),
)


def rstrip(c: Column) -> Column:
    """One pass from the end; a regular expression would try every run of blanks in the text."""
    return F.rtrim(c, F.lit(BLANKS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(BLANKS))


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def collapsed(c: Column) -> Column:
    """Text of an element: runs of white space are one blank, none at the ends; empty for null."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def utc_now() -> Column:
    """The time of the query in UTC, in ISO form."""
    return F.date_format(F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def ends_terminal(c: Column) -> Column:
    """Whether the last character, white space apart, ends a sentence (no colon, quote or bracket does)."""
    return F.coalesce(F.right(rstrip(c), F.lit(1)).isin(*TERMINAL), F.lit(False))


def join_parts(parts: Column) -> Column:
    return F.array_join(parts, " ")


def join_continuation(left: Column, right: Column) -> Column:
    """The two texts as one: a trailing hyphen is dropped, otherwise one blank stands between."""
    a, b = rstrip(left), lstrip(right)
    return F.when(a == "", b).when(b == "", a).when(a.endswith("-"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat_ws(" ", a, b))


def marker_type(c: Column) -> Column:
    text, out = strip(F.coalesce(c, F.lit(""))), F.lit(None).cast("string")
    for name, pattern in reversed(MARKERS):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def marker_text(c: Column) -> Column:
    text, out = strip(F.coalesce(c, F.lit(""))), F.lit(None).cast("string")
    for _, pattern in reversed(MARKERS):
        out = F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 0))).otherwise(out)
    return out


def list_marker(c: Column) -> Column:
    """struct(type, marker), or null."""
    return F.when(marker_type(c).isNotNull(), F.struct(marker_type(c).alias("type"), marker_text(c).alias("marker")))


#: Canonical types, the raw types they take, and the text that stands for an empty item.
CANONICAL = (
    ("text", ("paragraph", "text"), "[EMPTY]"),
    ("title", ("title",), "[EMPTY]"),
    ("equation", ("equation", "equation_interline", "interline_equation", "display_formula"), "[EQUATION]"),
    ("table", ("table",), "[TABLE]"),
    ("figure", ("figure", "image", "chart"), "[FIGURE]"),
    ("algorithm", ("algorithm",), "[ALGORITHM]"),
    ("list", ("list",), "[EMPTY]"),
    ("code", ("code",), "[CODE]"),
    ("reference", ("reference", "references", "bibliography"), "[REFERENCE]"),
    ("other", (), "[EMPTY]"),
)
TYPE_VOCABULARY = tuple(name for name, _, _ in CANONICAL)


def canonical_type(c: Column) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("other")
    for name, raw, _ in reversed(CANONICAL):
        if raw:
            out = F.when(low.isin(*raw), F.lit(name)).otherwise(out)
    return out


def embedding_text(kind: Column, text: Column) -> Column:
    canonical = canonical_type(kind)
    stand_in = F.create_map(*[F.lit(x) for name, _, word in CANONICAL for x in (name, word)])[canonical]
    body = strip(F.coalesce(text, F.lit("")))
    return F.when(canonical == "reference", stand_in).when(body != "", body).otherwise(stand_in)


# ---- manifests


def normalized_id(raw: Column) -> Column:
    """The id of a paper: last path segment without version, or null if it isn't of the new form."""
    last = F.substring_index(F.regexp_replace(strip(raw.cast("string")), "/+$", ""), "/", -1)
    bare = F.regexp_replace(last, r"v\p{Nd}+$", "")
    return F.when(bare.rlike(r"^\p{Nd}{4}\.\p{Nd}{4,5}(v\p{Nd}+)?$"), bare)


def id_year(c: Column) -> Column:
    two = F.substring(c, 1, 2).try_cast("int")
    return F.when(c.rlike(r"^\d{4}\.\d{4,5}(v\d+)?$"), F.when(two < 90, two + 2000).otherwise(two + 1900))


def _year_in(c: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"\b(?:19|20)\d{2}\b", 0), F.lit("")).cast("int")


def record_year(paper_id: Column, years: list[Column], dates: list[Column], versions: Column) -> Column:
    """Year of the id, else the first whole number of ``years``, else the first year in ``dates``, else in versions' dates."""
    whole = [F.when(y.cast("string").rlike(r"^\d+$"), y.cast("string").try_cast("int")) for y in years]
    found = F.filter(F.transform(F.coalesce(versions, F.array().cast("array<struct<created:string>>")), lambda v: _year_in(v["created"])), lambda y: y.isNotNull())
    return F.coalesce(id_year(paper_id), *whole, *[_year_in(d) for d in dates], F.get(found, 0))


def version_year(versions: Column, update_date: Column) -> Column:
    first = F.get(versions, 0)["created"]
    return F.coalesce(_year_in(first), F.when(update_date.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.substring(update_date, 1, 4).cast("int")))


def safe_id(c: Column) -> Column:
    return F.replace(c, F.lit("/"), F.lit("_"))


def tail_text(c: Column, n: int = 12_000) -> Column:
    return F.right(c, F.lit(n))


def short_error(c: Column, n: int = 500) -> Column:
    return F.substring(c, 1, n)
