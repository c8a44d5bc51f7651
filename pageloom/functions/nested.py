"""Readable text of nested block content, by an Arrow-batched visitor: depth is unbounded, so no fixed expression is exact."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys of content that are visited, in this order.
KEYS = (
    "title_content", "paragraph_content", "math_content", "code_content", "algorithm_content", "item_content", "list_items",
    "table_caption", "chart_caption", "image_caption", "page_footnote_content",
)


def text_parts(value: object) -> list[str]:
    """Non-empty strings of the content in visiting order, stripped; an explicit stack, so depth can't overflow."""
    out, stack = [], [value]
    while stack:
        at = stack.pop()
        if isinstance(at, str):
            if text := at.strip():
                out.append(text)
        elif isinstance(at, list):
            stack += reversed(at)
        elif isinstance(at, dict):
            own = [at["content"]] if isinstance(at.get("content"), str) else []
            stack += reversed(own + [at[k] for k in KEYS if k in at])
    return out


def references(block: dict) -> list[str]:
    content = block.get("content")
    items = content.get("list_items") if isinstance(content, dict) and content.get("list_type") == "reference_list" else None
    texts = [" ".join(text_parts(i.get("item_content"))) for i in items if isinstance(i, dict)] if isinstance(items, list) else []
    return [t for t in texts if t]


def extract_text(block: str | Column) -> Column:
    """Readable text of a block's JSON; null for null."""

    def run(block: pd.Series) -> pd.Series:
        return block.map(lambda b: " ".join(text_parts(json.loads(b).get("content"))), na_action="ignore")

    return F.pandas_udf(run, "string")(block)


def reference_items(block: str | Column) -> Column:
    """One string for each non-empty item of a reference list; empty for other blocks."""

    def run(block: pd.Series) -> pd.Series:
        return block.map(lambda b: references(json.loads(b)), na_action="ignore")

    return F.pandas_udf(run, "array<string>")(block)


def block_fields(df: DataFrame, column: str) -> DataFrame:
    """``df`` with type, logical_type, list_type, bbox, text, reference_items of the JSON blocks in ``column``."""
    names = ("type", "logical_type", "list_type", "bbox", "text", "reference_items")
    kinds = (pa.string(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.string(), pa.list_(pa.string()))

    def of(raw: str) -> tuple:
        b = json.loads(raw)
        content = b.get("content")
        listed = content.get("list_type") if isinstance(content, dict) else None
        box = [float(v) for v in b["bbox"]] if isinstance(b.get("bbox"), list) and len(b["bbox"]) == 4 else None
        kind = b.get("type")
        return kind, "reference" if kind == "list" and listed == "reference_list" else kind, listed, box, " ".join(text_parts(content)), references(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(zip(*(of(b.as_py()) for b in batch.column(column)), strict=True)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, k in zip(found, kinds, strict=True))], names=[*batch.schema.names, *names])

    kept = df.drop(*names)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, type string, logical_type string, list_type string, bbox array<double>, text string, reference_items array<string>")
