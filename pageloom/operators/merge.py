"""Paragraph merging over columns, pages and floats, and list annotation.

The folds are window forms: a segment of merge links is broken where the head's column forbids a
link (v3), consumed continuations are the odd links of a chain, and active list parents are the
last parent found since the last reset (v4).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import ends_terminal, join_continuation, marker_text, marker_type, rstrip

#: Types that merge, and types that count as floats.
MERGEABLE = ("paragraph", "list")
FLOATS = ("algorithm", "chart", "code", "equation", "equation_interline", "figure", "image", "interline_equation", "table")


def _doc():
    return Window.partitionBy("doc_id")
#: What an item keeps of its head besides, where the blocks have it.
KEPT = ("raw_type", "list_type", "reference_items", "block")
UP_TO = (Window.unboundedPreceding, 0)
BEFORE = (Window.unboundedPreceding, -1)


def merge_groups(ordered: DataFrame, y_tolerance: float = 80.0, bottom: float = 780.0, top: float = 260.0) -> DataFrame:
    """Blocks in reading order with grp: the number of the item they are merged into."""
    by = _doc().orderBy("page_idx", "visual_order")
    prev = {c: F.lag(c).over(by) for c in ("type", "text", "page_idx", "y0", "y1")}
    alike = (prev["type"] == F.col("type")) & F.col("type").isin(*MERGEABLE) & (prev["text"] != "") & (F.col("text") != "") & ~ends_terminal(prev["text"])
    across = alike & (F.col("page_idx") == prev["page_idx"] + 1) & (prev["y1"] >= bottom) & (F.col("y0") <= top)
    beside = alike & (F.col("page_idx") == prev["page_idx"]) & (F.col("column_id") == 1) & (F.col("y0") <= prev["y0"] + y_tolerance)
    rows = ordered.withColumn("_x", F.coalesce(across, F.lit(False))).withColumn("_c", F.coalesce(beside, F.lit(False)))
    rows = rows.withColumn("_seg", F.sum((~F.col("_x") & ~F.col("_c")).cast("int")).over(by.rowsBetween(*UP_TO)))
    head = F.first("column_id").over(Window.partitionBy("doc_id", "_seg").orderBy("page_idx", "visual_order").rowsBetween(*UP_TO))
    rows = rows.withColumn("_break", (~F.col("_x") & ~(F.col("_c") & head.eqNullSafe(F.lit(0)))).cast("int"))
    return rows.withColumn("grp", F.sum("_break").over(by.rowsBetween(*UP_TO)) - 1).drop("_x", "_c", "_seg", "_break")


def items_v3(ordered: DataFrame, **thresholds: float) -> DataFrame:
    """One row an item: the head's attributes, joined text, and the lineage of its parts.

    Only parts of one item are gathered, a few blocks; a document is never collected.
    """
    kept = [c for c in KEPT if c in ordered.columns]
    part = F.struct("page_idx", "visual_order", "original_index", "text", F.struct("x0", "y0", "x1", "y1").alias("box"), "type", "column_id", "is_full_width", "is_textual", *kept)
    rows = merge_groups(ordered, **thresholds).groupBy("doc_id", "grp").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    head = F.get("parts", F.lit(0))
    text = F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), head["text"], lambda s, p: join_continuation(s, p["text"]))
    return rows.select(
        "doc_id", F.col("grp").cast("int").alias("global_order"),
        *[head[c].alias(c) for c in ("type", "page_idx", "visual_order", "original_index", "column_id", "is_full_width", "is_textual")],
        text.alias("text"), F.size("parts").alias("merge_count"), F.col("parts.page_idx").alias("source_page_idxs"),
        F.col("parts.visual_order").alias("source_visual_orders"), F.col("parts.original_index").alias("source_original_indexes"), F.col("parts.box").alias("bbox"),
        *[(F.coalesce(head[c], F.array().cast("array<string>")) if c == "reference_items" else head[c]).alias(c) for c in kept],
    )


def float_merged(items: DataFrame, max_floats: int = 3, top: float = 760.0) -> DataFrame:
    """Items with paragraphs continued across one to ``max_floats`` floats merged; the consumed ones are gone."""
    rows = items.withColumn("_float", F.lower(F.coalesce("type", F.lit(""))).isin(*FLOATS)).withColumn("_marked", marker_type(F.col("text")).isNotNull())
    by_doc = _doc().orderBy("global_order")
    rows = rows.withColumn("_types", F.array(*[F.lead("type", k).over(by_doc) for k in range(1, max_floats + 1)]))
    apart = Window.partitionBy("doc_id", "_float").orderBy("global_order")
    following = F.struct("global_order", "type", "text", "_marked", "page_idx", "bbox", "merge_count", "source_page_idxs", "source_visual_orders", "source_original_indexes")
    rows = rows.withColumn("_next", F.when(~F.col("_float"), F.lead(following).over(apart)))
    n, skipped = F.col("_next"), F.col("_next.global_order") - F.col("global_order") - 1
    here = F.element_at("source_page_idxs", -1)
    near = (n["page_idx"] == here) | ((n["page_idx"] == here + 1) & (F.get(n["bbox"], F.lit(0))["y0"] <= top))
    link = (F.col("type") == "paragraph") & ~F.col("_marked") & rstrip(F.col("text")).endswith("-") & skipped.between(1, max_floats) & (n["type"] == "paragraph") & ~n["_marked"] & (n["text"] != "") & near
    rows = rows.withColumn("_link", F.coalesce(link, F.lit(False)))
    rows = rows.withColumn("_chain", F.coalesce(F.sum((~F.col("_link")).cast("int")).over(apart.rowsBetween(*BEFORE)), F.lit(0)))
    place = F.sum(F.col("_link").cast("int")).over(Window.partitionBy("doc_id", "_float", "_chain").orderBy("global_order").rowsBetween(*UP_TO))
    rows = rows.withColumn("_used", F.col("_link") & (place % 2 == 1))
    rows = rows.withColumn("_gone", F.coalesce(F.lag("_used").over(apart), F.lit(False))).where("not _gone")
    both = lambda c: F.when(F.col("_used"), F.concat(c, f"_next.{c}")).otherwise(F.col(c))
    used = F.col("_used")
    return rows.select(
        "doc_id", "global_order", "type", "page_idx", "visual_order", "original_index", "column_id", "is_full_width", "is_textual",
        F.when(used, join_continuation(F.col("text"), n["text"])).otherwise(F.col("text")).alias("text"),
        F.when(used, F.col("merge_count") + n["merge_count"]).otherwise(F.col("merge_count")).alias("merge_count"),
        *[both(c).alias(c) for c in ("source_page_idxs", "source_visual_orders", "source_original_indexes", "bbox")],
        F.when(used, 1).alias("float_continuation_merge_count"),
        F.when(used, F.sequence(F.col("global_order") + 1, n["global_order"] - 1)).alias("skipped_float_global_orders"),
        F.when(used, F.slice("_types", F.lit(1), skipped)).alias("skipped_float_types"), *[c for c in KEPT if c in items.columns],
    )


def list_annotated(items: DataFrame, indent: float = 20.0) -> DataFrame:
    """Items with list_marker, list_level, list_item_id and list_parent_global_order, renumbered.

    Parents keep the numbers they had before renumbering.
    """
    by = _doc().orderBy("global_order")
    rows = items.withColumn("_marker", marker_type(F.col("text")))
    marked = F.col("_marker").isNotNull()
    rows = rows.withColumn("_x0", F.get("bbox", F.lit(0))["x0"])
    colon = F.when(rstrip(F.col("text")).rlike("[:：]$") & F.col("_x0").isNotNull(), F.struct("global_order", "_x0"))
    rows = rows.withColumn("_colon", F.last(colon, ignorenulls=True).over(by.rowsBetween(*BEFORE)))
    rows = rows.withColumn("_own", F.when(marked & (F.col("_x0") > F.col("_colon._x0") + indent), F.col("_colon.global_order")))
    reset = ~marked & ~F.coalesce(F.col("type"), F.lit("")).isin(*MERGEABLE)
    rows = rows.withColumn("_part", F.coalesce(F.sum(reset.cast("int")).over(by.rowsBetween(*BEFORE)), F.lit(0)))
    active = F.last("_own", ignorenulls=True).over(Window.partitionBy("doc_id", "_part").orderBy("global_order").rowsBetween(*UP_TO))
    nth = F.sum(marked.cast("int")).over(by.rowsBetween(*UP_TO)) - 1
    rows = rows.withColumn("list_parent_global_order", F.when(marked, active))
    rows = rows.withColumn("list_level", F.when(marked, F.when(F.col("list_parent_global_order").isNull(), 0).otherwise(1)))
    rows = rows.withColumn("list_item_id", F.when(marked, F.format_string("li_%05d", nth.cast("int"))))
    rows = rows.withColumn("list_marker", F.when(marked, F.struct(F.col("_marker").alias("type"), marker_text(F.col("text")).alias("marker"))))
    return rows.withColumn("source_global_order", F.col("global_order")).withColumn("global_order", (F.row_number().over(by) - 1).cast("int")).drop("_marker", "_x0", "_colon", "_own", "_part")


def items_v4(v3: DataFrame) -> DataFrame:
    return list_annotated(float_merged(v3))
