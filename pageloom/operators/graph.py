"""Graph features of items: type one-hots, local geometry, derived statistics, edges, node records.

Items are rows with bbox: array<struct(x0,y0,x1,y1)> (one box for each merged part). All windows and
joins are keyed by doc_id, so a document's nodes need one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.functions.text import TYPE_VOCABULARY, canonical_type, embedding_text
from pageloom.operators.layout import split_at

PAGE_SIZE, FRAME_WIDTH, FRAME_GAP = 1000.0, 620.0, 130.0
#: Types whose text density is zero.
NO_DENSITY = ("equation", "table", "figure", "algorithm", "code")


def _doc():
    return Window.partitionBy("doc_id")


def bbox_chunks(flat: Column) -> Column:
    """A flat array of numbers -> boxes of four; a partial tail is dropped."""
    box = lambda i: F.struct(*[F.get(flat, i * 4 + k).cast("double").alias(n) for k, n in enumerate(("x0", "y0", "x1", "y1"))])
    n = F.floor(F.size(flat) / 4).cast("int")
    return F.when(F.size(flat) >= 4, F.transform(F.sequence(F.lit(0), n - 1), box)).otherwise(F.array().cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"))


def type_onehot(kind: Column) -> Column:
    name = canonical_type(kind)
    return F.array(*[(name == v).cast("float") for v in TYPE_VOCABULARY])


def _pages() -> Column:
    """The page of each box; the item's page for all where the lengths differ."""
    same = F.size("source_page_idxs") == F.size("bbox")
    return F.when(F.coalesce(same, F.lit(False)), F.col("source_page_idxs")).otherwise(F.transform("bbox", lambda b: F.col("page_idx")))


def page_frames(items: DataFrame) -> DataFrame:
    """(doc_id, page, left_min, left_max, right_min, right_max) of pages with two columns."""
    boxes = items.select("doc_id", "global_order", F.posexplode(F.arrays_zip(_pages().alias("page"), F.col("bbox").alias("box"))).alias("k", "z"))
    boxes = boxes.select("doc_id", "global_order", "k", F.col("z.page").alias("page"), "z.box.*").where(F.col("page").isNotNull() & (F.col("x1") - F.col("x0") < FRAME_WIDTH))
    page = Window.partitionBy("doc_id", "page")
    boxes = boxes.withColumn("c", (F.col("x0") + F.col("x1")) / 2.0)
    boxes = boxes.withColumn("gap", split_at(boxes, "c", F.lit(True), page, ["global_order", "k"], FRAME_GAP, 2))
    boxes = boxes.withColumn("mid", F.max("gap").over(page)["mid"]).where("mid is not null")
    left = F.col("c") < F.col("mid")
    return boxes.groupBy("doc_id", "page").agg(
        F.min(F.when(left, F.col("x0"))).alias("left_min"), F.max(F.when(left, F.col("x1"))).alias("left_max"),
        F.min(F.when(~left, F.col("x0"))).alias("right_min"), F.max(F.when(~left, F.col("x1"))).alias("right_max"),
    )


def _local_x(x: Column, box: Column, frame: str) -> Column:
    """x within the nearer of the page's two frames, the left on ties; x / 1000 where there are none."""
    at = lambda c: F.col(f"{frame}.{c}")
    centre = (box["x0"] + box["x1"]) / 2.0
    nearer_left = F.abs(centre - (at("left_min") + at("left_max")) / 2.0) <= F.abs(centre - (at("right_min") + at("right_max")) / 2.0)
    low, high = F.when(nearer_left, at("left_min")).otherwise(at("right_min")), F.when(nearer_left, at("left_max")).otherwise(at("right_max"))
    plain = F.coalesce(F.col("is_full_width"), F.lit(False)) | F.col(frame).isNull()
    return F.when(plain, x / PAGE_SIZE).otherwise((x - low) / F.greatest(F.lit(1.0), high - low))


def geometry(items: DataFrame) -> DataFrame:
    """Items with x_start, y_start, x_end, y_end; zeros where there is no box."""
    frames = page_frames(items).select("doc_id", "page", F.struct("left_min", "left_max", "right_min", "right_max").alias("f"))
    pages = F.coalesce("source_page_idxs", F.array().cast("array<int>"))
    first_page = F.coalesce(F.get(pages, F.lit(0)), "page_idx", F.lit(0))
    rows = items.withColumn("_p0", first_page).withColumn("_p1", F.coalesce(F.try_element_at(pages, F.lit(-1)), "_p0"))
    for k in ("0", "1"):
        side = frames.withColumnRenamed("page", f"_q{k}").withColumnRenamed("f", f"_f{k}").withColumnRenamed("doc_id", f"_d{k}")
        rows = rows.join(side, (F.col("doc_id") == F.col(f"_d{k}")) & (F.col(f"_p{k}") == F.col(f"_q{k}")), "left")
    first, last = F.get("bbox", F.lit(0)), F.try_element_at("bbox", F.lit(-1))
    rows = rows.withColumns({
        "x_start": F.coalesce(_local_x(first["x0"], first, "_f0"), F.lit(0.0)), "y_start": F.coalesce(first["y0"] / PAGE_SIZE, F.lit(0.0)),
        "x_end": F.coalesce(_local_x(last["x1"], last, "_f1"), F.lit(0.0)), "y_end": F.coalesce(last["y1"] / PAGE_SIZE, F.lit(0.0)),
    })
    return rows.drop("_p0", "_p1", "_q0", "_q1", "_f0", "_f1", "_d0", "_d1")


def derived_stats(items: DataFrame) -> DataFrame:
    """Items with macro_position, aspect_ratio and text_density."""
    add = lambda value: F.aggregate("bbox", F.lit(0.0), lambda s, b: s + value(b))
    wide, high = lambda b: F.greatest(F.lit(0.0), b["x1"] - b["x0"]), lambda b: F.greatest(F.lit(0.0), b["y1"] - b["y0"])
    nth, n = F.row_number().over(_doc().orderBy("global_order")) - 1, F.count("*").over(_doc())
    bare = canonical_type(F.col("type")).isin(*NO_DENSITY)
    return items.withColumns({
        "macro_position": nth / F.greatest(F.lit(1), n - 1),
        "aspect_ratio": add(high) / F.greatest(add(wide), F.lit(1.0)),
        "text_density": F.when(bare, 0.0).otherwise(F.length(F.coalesce("text", F.lit(""))) / F.greatest(add(lambda b: wide(b) * high(b)), F.lit(1.0))),
    })


def node_features(items: DataFrame, text_vectors: DataFrame | None = None) -> DataFrame:
    """(doc_id, node, x): text vector (if given: doc_id, global_order, vector), one-hot, geometry, statistics as floats."""
    rows = derived_stats(geometry(items))
    parts = [type_onehot(F.col("type")), F.array(*[F.col(c).cast("float") for c in ("x_start", "y_start", "x_end", "y_end", "macro_position", "aspect_ratio", "text_density")])]
    if text_vectors is not None:
        rows = rows.join(text_vectors, ["doc_id", "global_order"], "left")
        parts.insert(0, F.col("vector").cast("array<float>"))
    return rows.select("doc_id", F.col("global_order").alias("node"), F.concat(*parts).alias("x"))


def sequential_edges(items: DataFrame, bidirectional: bool = True) -> DataFrame:
    """(doc_id, edge_pos, source, target): each node to the next, and back directly after."""
    by = _doc().orderBy("global_order")
    rows = items.select("doc_id", (F.row_number().over(by) - 1).alias("i"), F.lead("global_order").over(by).alias("more")).where("more is not null")
    ways = [F.struct(F.col("i").alias("source"), (F.col("i") + 1).alias("target"))]
    ways += [F.struct((F.col("i") + 1).alias("source"), F.col("i").alias("target"))] if bidirectional else []
    rows = rows.select("doc_id", "i", F.posexplode(F.array(*ways)).alias("k", "e"))
    return rows.select("doc_id", (F.col("i") * len(ways) + F.col("k")).alias("edge_pos"), "e.source", "e.target")


def node_records(items: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    kept = ["doc_id", "global_order", "type", "page_idx", "visual_order", "merge_count", "source_page_idxs", "source_visual_orders", "bbox"]
    return items.select(*kept, canonical_type(F.col("type")).alias("canonical_type"), F.substring(text, 1, 200).alias("text_preview"), embedding_text(F.col("type"), F.col("text")).alias("embedding_text"))


def token_windows(n_tokens: Column, max_length: int = 512, stride: int = 384) -> Column:
    """Starts of the windows that cover ``n_tokens``, two places of each being kept for special tokens."""
    body = max_length - 2
    step = min(stride, body)
    if step <= 0:
        raise ValueError("stride must be positive")
    last = F.greatest(F.lit(0), F.ceil((n_tokens - body) / step)).cast("int")
    return F.when(n_tokens > 0, F.transform(F.sequence(F.lit(0), last), lambda k: k * step)).otherwise(F.array().cast("array<int>"))


def mean_pool(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The element-wise mean of the vectors of each key, in double precision."""
    flat = rows.select(*keys, F.posexplode(vector).alias("_i", "_v")).groupBy(*keys, "_i").agg(F.avg(F.col("_v").cast("double")).alias("_m"))
    return flat.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias(vector))
