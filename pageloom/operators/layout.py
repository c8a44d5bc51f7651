"""Page layout: geometry, column split, reading order, text runs, page summaries.

Blocks are rows (doc_id, page_idx, original_index, type, text, x0, y0, x1, y1). All windows are over
(doc_id, page_idx); partitioned by doc_id once, a plan holds one exchange, and a very frequent page
number can't make a hot key since doc_id is part of every key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Block types by role.
AUXILIARY = ("page_header", "page_footer", "page_number", "page_aside_text", "page_footnote")
TEXTUAL = ("title", "paragraph", "list", "index", "code", "algorithm")
WIDE = ("title", "table", "chart", "image", "equation_interline", "algorithm", "code")


@dataclass(frozen=True)
class LayoutConfig:
    """Thresholds for coordinates normalised to 0..1000. The defaults.

    A block is wide from ``wide_share`` of the page on, or if it is of a wide type and reaches from
    ``crosses_from`` to ``crosses_to``; a page has two columns if ``column_blocks`` blocks lie on each
    side of a gap of ``column_gap`` between centres; a wide block begins a region ``rise`` above its top.
    """

    wide_share: float = 0.62
    crosses_from: float = 380.0
    crosses_to: float = 620.0
    column_gap: float = 130.0
    column_blocks: int = 2
    rise: float = 8.0
    drop_blank_text: bool = True
    keep_auxiliary: bool = False


def _page():
    return Window.partitionBy("doc_id", "page_idx")


def parse_bbox(bbox: Column) -> Column:
    """array<double> -> struct; anything but four numbers is the whole page."""
    whole = F.struct(*[F.lit(v).alias(n) for n, v in (("x0", 0.0), ("y0", 0.0), ("x1", 1000.0), ("y1", 1000.0))])
    four = F.struct(*[F.get(bbox, k).alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])
    return F.when(F.size(bbox) == 4, four).otherwise(whole)


def geometry(blocks: DataFrame, cfg: LayoutConfig = LayoutConfig()) -> DataFrame:
    kind = F.coalesce("type", F.lit(""))
    width = F.greatest(F.lit(0.0), F.col("x1") - F.col("x0"))
    across = (F.col("x0") <= cfg.crosses_from) & (F.col("x1") >= cfg.crosses_to)
    return blocks.withColumns({
        "cx": (F.col("x0") + F.col("x1")) / 2.0,
        "cy": (F.col("y0") + F.col("y1")) / 2.0,
        "width": width,
        "is_textual": kind.isin(*TEXTUAL),
        "is_auxiliary": kind.isin(*AUXILIARY),
        "is_full_width": (width >= 1000.0 * cfg.wide_share) | (kind.isin(*WIDE) & across),
    })


def sortable(blocks: DataFrame, cfg: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Blocks with geometry, without auxiliary ones and empty textual ones, as configured."""
    rows = geometry(blocks, cfg)
    if not cfg.keep_auxiliary:
        rows = rows.where("not is_auxiliary")
    return rows.where("not (is_textual and coalesce(text, '') = '')") if cfg.drop_blank_text else rows


def split_at(rows: DataFrame, centre: str, candidate: Column, page: Window, order: list, gap: float, least: int) -> Column:
    """The middle of a page's widest gap between candidates' centres, the first on ties; null if it is too small."""
    by = page.orderBy(candidate.cast("int").desc(), centre, *order)
    nth, n = F.row_number().over(by), F.sum(candidate.cast("int")).over(page)
    nxt = F.lead(centre).over(by)
    able = candidate & (nth >= least) & (n - nth >= least) & (nxt - F.col(centre) >= gap)
    return F.when(able, F.struct((nxt - F.col(centre)).alias("gap"), (-nth).alias("first"), ((F.col(centre) + nxt) / 2.0).alias("mid")))


def with_columns(blocks: DataFrame, cfg: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Sortable blocks with the page's split (null if it has one column) and each block's column_id (null if full width)."""
    rows = sortable(blocks, cfg)
    gap = split_at(rows, "cx", ~F.col("is_full_width"), _page(), ["original_index"], cfg.column_gap, cfg.column_blocks)
    rows = rows.withColumn("_gap", gap).withColumn("split", F.max("_gap").over(_page())["mid"]).drop("_gap")
    column = F.when(F.col("is_full_width"), F.lit(None)).when(F.col("split").isNull() | (F.col("cx") < F.col("split")), 0).otherwise(1)
    return rows.withColumn("column_id", column.cast("int"))


def reading_order(blocks: DataFrame, cfg: LayoutConfig = LayoutConfig()) -> DataFrame:
    """Blocks with visual_order: regions between full-width blocks, each left column first.

    A block's region is the number of full-width blocks that begin at or above its middle.
    """
    rows = with_columns(blocks, cfg)
    full = F.col("is_full_width")
    key = F.when(full, F.col("y0") - cfg.rise).otherwise(F.col("cy"))
    seen = _page().orderBy(key, (~full).cast("int")).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.row_number().over(_page().orderBy((~full).cast("int"), "y0", "x0", "original_index")) - 1
    rows = rows.withColumn("region", F.when(full, rank).otherwise(F.sum(full.cast("int")).over(seen)))
    order = _page().orderBy("region", full.cast("int"), F.coalesce("column_id", F.lit(0)), "y0", "x0", "original_index")
    return rows.withColumn("visual_order", (F.row_number().over(order) - 1).cast("int"))


def text_runs(ordered: DataFrame) -> DataFrame:
    """Ordered blocks with text_run_id and text_run_index: unbroken text of one column."""
    by = _page().orderBy("visual_order")
    text = F.col("is_textual") & (F.coalesce("text", F.lit("")) != "")
    goes_on = F.coalesce(F.lag(text).over(by), F.lit(False)) & F.lag("column_id").over(by).eqNullSafe(F.col("column_id"))
    rows = ordered.withColumn("_text", text).withColumn("_new", (text & ~goes_on).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    index = F.sum(F.col("_text").cast("int")).over(Window.partitionBy("doc_id", "page_idx", "_run").orderBy("visual_order").rowsBetween(Window.unboundedPreceding, 0)) - 1
    rows = rows.withColumn("text_run_id", F.when(F.col("_text"), F.format_string("p%04d_r%04d", F.col("page_idx").cast("int"), F.col("_run").cast("int"))))
    return rows.withColumn("text_run_index", F.when(F.col("_text"), index).cast("int")).drop("_text", "_new", "_run")


def page_summary(blocks: DataFrame, cfg: LayoutConfig = LayoutConfig()) -> DataFrame:
    rows = geometry(blocks, cfg).groupBy("doc_id", "page_idx").agg(
        F.count("*").alias("input_blocks"),
        F.count_if(F.col("is_auxiliary") & F.lit(not cfg.keep_auxiliary)).alias("dropped_auxiliary_blocks"),
        F.count_if(F.col("is_textual") & (F.coalesce("text", F.lit("")) == "") & F.lit(cfg.drop_blank_text)).alias("dropped_empty_textual_blocks"),
    )
    out = text_runs(reading_order(blocks, cfg)).groupBy("doc_id", "page_idx").agg(
        F.count("*").alias("output_blocks"), F.countDistinct("column_id").alias("column_count"), F.count_if("is_full_width").alias("full_width_blocks"), F.countDistinct("text_run_id").alias("text_runs")
    )
    zero = ["output_blocks", "column_count", "full_width_blocks", "text_runs"]
    return rows.join(out, ["doc_id", "page_idx"], "left").fillna(0, zero)
