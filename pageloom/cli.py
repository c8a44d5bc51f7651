"""python -m pageloom.cli STEP INPUT OUTPUT: layout files to ordered blocks, items, lists, styled items or graphs.

Steps: order, items, lists, styles (each a JSON table), graph (nodes and edges as Parquet). INPUT is a
path of layout files; a document is a file. styles takes the raw spans of a PDF reader (--spans: JSON rows of
path, global_order, chunk, pos, text, font_name, size, flags, chars) and puts them to their items.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.operators import graph, layout, merge, style
from pageloom.session import session
from pageloom.sources.layout_json import blocks_of, read_layout, write_json

STEPS = ("order", "items", "lists", "styles", "graph")
SPANS = "path string, global_order int, chunk int, pos int, text string, font_name string, size double, flags int, chars array<struct<c:string,x0:double,x1:double>>"


def blocks(layout_rows: DataFrame) -> DataFrame:
    """Blocks of layout files; doc_id is a hash of the path, and a malformed box is the whole page."""
    rows = blocks_of(layout_rows).withColumn("_b", layout.parse_bbox(F.col("bbox")))
    return rows.select(
        F.xxhash64("path").alias("doc_id"), "path", "page_idx", "original_index", "type", F.col("type").alias("raw_type"), "logical_type", "list_type", "reference_items", "block", "text", "_b.*"
    ).repartition("doc_id")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("step", choices=STEPS)
    parser.add_argument("input")
    parser.add_argument("output")
    parser.add_argument("--keep-auxiliary", action="store_true")
    parser.add_argument("--spans", help="JSON rows of raw spans, for styles")
    args = parser.parse_args(argv)
    spark = session()
    ordered = layout.text_runs(layout.reading_order(blocks(read_layout(spark, args.input)), layout.LayoutConfig(keep_auxiliary=args.keep_auxiliary)))
    if args.step == "order":
        write_json(ordered, args.output)
        return
    # references count as text in the layout, but merge by their logical type
    items = merge.items_v3(ordered.withColumn("type", F.col("logical_type")))
    if args.step == "items":
        write_json(items, args.output)
        return
    if args.step == "styles":
        raw = spark.read.schema(SPANS).json(args.spans)
        raw = raw.withColumn("doc_id", F.xxhash64(F.regexp_replace("path", "^(file:)?/+", "file:/")))  # as the layout reader names local files
        write_json(style.styled_items(items, raw), args.output)
        return
    lists = merge.items_v4(items)
    if args.step == "lists":
        write_json(lists, args.output)
    else:
        graph.node_features(lists).write.mode("overwrite").parquet(f"{args.output}/nodes")
        graph.node_records(lists).write.mode("overwrite").parquet(f"{args.output}/records")
        graph.sequential_edges(lists).write.mode("overwrite").parquet(f"{args.output}/edges")


if __name__ == "__main__":
    main()
