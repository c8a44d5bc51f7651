"""Layout, item and metadata files as rows, and their sinks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pageloom.functions.nested import block_fields
from pageloom.operators.manifest import id_set, id_union

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def read_layout(spark: SparkSession, path: str) -> DataFrame:
    """Files of pages of blocks -> (path, page_idx, original_index, block: JSON). A file that isn't a list of lists of objects raises."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pages = json.loads(text)
                if not isinstance(pages, list) or not all(isinstance(p, list) and all(isinstance(b, dict) for b in p) for p in pages):
                    raise ValueError(f"{file} is not a list of pages of blocks")
                rows = [(file, i, k, json.dumps(b, ensure_ascii=False)) for i, p in enumerate(pages) for k, b in enumerate(p)]
                cols = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["path", "page_idx", "original_index", "block"])

    return files.mapInArrow(run, "path string, page_idx int, original_index int, block string")


def blocks_of(layout: DataFrame) -> DataFrame:
    """Layout rows with type, logical_type, list_type, bbox (array), text and reference_items taken from the block's JSON."""
    return block_fields(layout, "block")


def read_items(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Payload files with an ``items`` list -> one row an item (path, position, item: JSON); elements that are no objects are dropped."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.from_json("value", "struct<items: array<string>>").alias("p"))
    checked = files.select("path", F.when(F.col("p.items").isNull(), F.raise_error(F.lit("no items list")).cast("array<string>")).otherwise(F.col("p.items")).alias("items"))
    return checked.select("path", F.posexplode("items").alias("position", "item")).where(F.col("item").startswith("{"))


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines -> (file, line: from 1 in each file's order, record: variant); malformed lines are skipped but counted.

    A line's place in its split is known where it is read, so lines stay there: what is added is the
    number of lines in the file's splits before, from a table of a row a split, which is broadcast (at
    128 MB a split, a millionth of the data).
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("k"), "value")
    splits = lines.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("at")) - F.col("n")
    starts = splits.select("file", "at", (before - F.col("first") + 1).alias("shift"))
    numbered = lines.join(F.broadcast(starts), ["file", "at"])
    return numbered.select("file", (F.col("k") + F.col("shift")).alias("line"), F.try_parse_json("value").alias("record")).where("record is not null")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by Spark's own file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_ids(spark: SparkSession, *paths: str, key: str = "arxiv_id", normalise: bool = True) -> DataFrame:
    """The ids of JSON-lines files, once each; a file that isn't there holds none."""
    none = spark.createDataFrame([], f"{key} string")
    found = [read_jsonl(spark, p).select(F.try_variant_get("record", f"$.{key}", "string").alias(key)) for p in paths if exists(spark, p)]
    return id_union(none, *[id_set(f, key, normalise) for f in found])


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines, keys sorted; commits are atomic a task, so no lock is needed."""
    df.select(sorted(df.columns)).write.mode("append").json(path)


def nested_items(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Items as one payload a document, in order; for documents that fit a row, as the sink format asks."""
    return items.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in items.columns if c not in (*keys, order)]))).alias("items"))


def safe_member(name: str) -> bool:
    """Whether an archive member stays inside its folder: by path components, not by a prefix of the string."""
    path = PurePosixPath(name.replace("\\", "/"))
    return not path.is_absolute() and ".." not in path.parts and bool(path.parts)
