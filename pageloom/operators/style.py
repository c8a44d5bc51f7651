"""Style spans: font flags, character gaps, span merging, baselines, clip rectangles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from pageloom.functions.text import strip
from pageloom.operators import spans

#: Parts of font names by style, and characters of formulas.
BOLD = ("bold", "bd", "blk", "black", "heavy", "demi", "medi")
ITALIC = ("ital", "italic", "oblique", "slant", "slanted")
CODE = ("mono", "courier", "consolas", "typewriter", "cmtt", "lmmono")
MATH = (
    "cmmi", "cmsy", "cmex", "msam", "msbm", "stixmath", "latinmodernmath", "xitsmath", "texgyrepagella-math", "texgyretermes-math",
    "texgyrebonum-math", "texgyreschola-math", "mathematicalpi", "mtmi", "mtsy",
)
MATH_CHARS = "∑∫√∞≈≠≤≥±×÷∂∇αβγδεζηθικλμνξοπρστυφχψωΓΔΘΛΞΠΣΦΨΩ_^{}=<>|"
OPENERS, CLOSERS = "([{/%“‘", ".,;:!?)]}%”’"
WORD_OPENERS = "([{“‘"
KEY = ("font_name", "font_size", "is_bold", "is_italic", "is_inline_math", "is_inline_code")


def font_name(raw: Column) -> Column:
    return F.lower(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^[A-Z]{6}\+", ""))


def size_bucket(size: Column, bucket: float = 0.5) -> Column:
    return F.rint(size / bucket) * bucket if bucket > 0 else size


def _has(name: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(name, F.lit(w))
    return out


def is_bold(flags: Column, name: Column) -> Column:
    return (flags.bitwiseAND(F.lit(16)) != 0) | _has(name, BOLD)


def is_italic(flags: Column, name: Column) -> Column:
    return (flags.bitwiseAND(F.lit(2)) != 0) | _has(name, ITALIC)


def is_code(name: Column) -> Column:
    return _has(name, CODE)


def is_math(name: Column, text: Column) -> Column:
    return _has(name, MATH) | (F.contains(name, F.lit("symbol")) & (F.translate(text, MATH_CHARS, "") != text))


def _in(c: Column, chars: str) -> Column:
    return c.isin(*chars)


def _word(c: Column) -> Column:
    return c.rlike(r"^[\p{L}\p{N}]$")


def join_spans(left: Column, right: Column) -> Column:
    """Two fragments as one, with a blank where words or brackets meet; the first rule that holds decides."""
    a, b = F.right(left, F.lit(1)), F.left(right, F.lit(1))
    before = F.substring(left, F.length(left) - 1, F.lit(1))
    glued, spaced = F.concat(left, right), F.concat(left, F.lit(" "), right)
    return (
        F.when(left == "", right).when(right == "", left)
        .when(a.isin(" ", "\n") | b.isin(" ", "\n") | (a == "-") | _in(b, CLOSERS) | _in(a, OPENERS), glued)
        .when(_word(a) & (_word(b) | _in(b, WORD_OPENERS)), spaced)
        .when((a == ".") & (F.length(left) >= 2) & before.rlike(r"^\p{Nd}$") & b.rlike(r"^\p{Nd}$"), glued)
        .when(_in(a, CLOSERS) & _word(b), spaced)
        .otherwise(glued)
    )


def span_text(chars: Column, size: Column, text: Column) -> Column:
    """Text of characters array<struct<c, x0, x1>> with a blank at each wide gap; ``text`` where there are none.

    A character without x1 ends where the one before it does.
    """
    gap = F.greatest(F.lit(1.0), F.coalesce(size, F.lit(0.0)) * 0.22)
    return _spaced_text(chars, gap, text)


@F.arrow_udf(StringType())
def _spaced_text(chars: pa.Array, gap: pa.Array, text: pa.Array) -> pa.Array:
    return spans.spaced_text(chars, gap, text, [" ", *CLOSERS], [" ", *OPENERS])


def numbered_spans(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Spans with the number of the run of equal style that they belong to."""
    by = Window.partitionBy(*keys).orderBy(order)
    style = F.struct(*KEY)
    rows = rows.withColumn("_new", (~F.coalesce(F.lag(style).over(by).eqNullSafe(style), F.lit(False))).cast("int"))
    return rows.withColumn("span", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def span_sizes(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, span, font_size, char_count) of the spans that ``merge_spans`` makes, without gathering their text."""
    return numbered_spans(rows, keys, order).groupBy(*keys, "span", "font_size").agg(F.sum(F.length("text")).alias("char_count"))


def _in_order(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Numbered spans, the rows of a key one after the other in one partition: the numbering's windows have put them so."""
    return numbered_spans(rows, keys, order).sortWithinPartitions(*keys, order).select(*keys, "span", "text", *KEY)


def _fields(rows: DataFrame, names: list[str]) -> list[StructField]:
    return [StructField(f.name, f.dataType) for f in (rows.schema[c] for c in names)]


def merge_spans(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adjacent spans of equal style as one: (keys, span, text, style fields, char_count)."""
    placed = _in_order(rows, keys, order)
    made = StructType([*_fields(placed, [*keys, "span", "text", *KEY]), StructField("char_count", LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in spans.whole(batches, [*keys, "span"]):
            yield pa.RecordBatch.from_pydict(spans.merged(t, keys, list(KEY), spans.Signs(CLOSERS, OPENERS, WORD_OPENERS)))

    return placed.mapInArrow(run, made)


def nested_spans(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, style_spans, style_baseline_size) of the spans that ``merge_spans`` makes and ``baseline_size`` weighs, in one pass over the spans of a key."""
    placed = _in_order(rows, keys, order)
    span = StructType([*_fields(placed, ["text", *KEY]), StructField("char_count", LongType())])
    made = StructType([*_fields(placed, keys), StructField("style_spans", ArrayType(span)), StructField("style_baseline_size", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in spans.whole(batches, keys):
            merged = spans.merged(t, keys, list(KEY), spans.Signs(CLOSERS, OPENERS, WORD_OPENERS))
            yield pa.RecordBatch.from_pydict(spans.nested(merged, keys, list(SPAN_FIELDS)))

    return placed.mapInArrow(run, made)


def baseline_size(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The font size of most characters (at least one a span), the first seen on ties."""
    length = [F.length("text")] if "text" in rows.columns else []  # span_sizes has none: its counts are lengths
    weight = F.greatest(F.lit(1), F.coalesce(F.nullif(F.col("char_count"), F.lit(0)), *length, F.lit(0)))
    sizes = rows.where("font_size is not null").groupBy(*keys, "font_size").agg(F.sum(weight).alias("n"), F.min(order).alias("first"))
    return sizes.groupBy(*keys).agg(F.max_by("font_size", F.struct("n", -F.col("first"))).alias("baseline_size"))


def clip_rect(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, margin: float = 2.0) -> Column:
    """A box in 0..1000 as page points, widened by the margin and cut at the page."""
    return F.struct(
        F.greatest(F.lit(0.0), x0 / 1000.0 * width - margin).alias("x0"), F.greatest(F.lit(0.0), y0 / 1000.0 * height - margin).alias("y0"),
        F.least(width, x1 / 1000.0 * width + margin).alias("x1"), F.least(height, y1 / 1000.0 * height + margin).alias("y1"),
    )


@dataclass(frozen=True)
class StyleConfig:
    """Points added around a box, and the step of font sizes."""

    margin: float = 2.0
    size_step: float = 0.5


SPAN_FIELDS = ("text", *KEY, "char_count")


def classified(raw: DataFrame, cfg: StyleConfig = StyleConfig()) -> DataFrame:
    """Raw spans (doc_id, global_order, chunk, pos, text, font_name, size, flags, chars) with their text rebuilt and their style; blank ones go."""
    size = F.coalesce(F.col("size"), F.lit(0.0))
    said = span_text(F.col("chars"), size, F.col("text")) if "chars" in raw.columns else F.coalesce("text", F.lit(""))
    rows = raw.select("doc_id", "global_order", (F.col("chunk").cast("long") * (1 << 32) + F.col("pos")).alias("at"), said.alias("text"), font_name(F.col("font_name")).alias("font_name"), size.alias("size"), F.coalesce("flags", F.lit(0)).alias("flags"))
    name, flags, text = F.col("font_name"), F.col("flags"), F.col("text")
    return rows.where(strip(text) != "").select(
        "doc_id", "global_order", "at", "text", "font_name", size_bucket(F.col("size"), cfg.size_step).alias("font_size"), is_bold(flags, name).alias("is_bold"),
        is_italic(flags, name).alias("is_italic"), is_math(name, text).alias("is_inline_math"), is_code(name).alias("is_inline_code"),
    )


def styled_items(items: DataFrame, raw: DataFrame, cfg: StyleConfig = StyleConfig()) -> DataFrame:
    """``items`` (doc_id, global_order, ...) with style_spans in reading order, style_baseline_size, style_span_count and style_extract_status.

    An item without spans has an empty list, no baseline and the status "empty". Only the spans of one
    item are gathered.
    """
    keys = ["doc_id", "global_order"]
    found = nested_spans(classified(raw, cfg), keys, "at")
    joined = items.join(found, keys, "left")
    none = F.array().cast(found.schema["style_spans"].dataType)
    rows = joined.withColumn("style_spans", F.coalesce("style_spans", none)).withColumn("style_span_count", F.size("style_spans"))
    return rows.withColumn("style_extract_status", F.when(F.col("style_span_count") > 0, "ok").otherwise("empty"))
