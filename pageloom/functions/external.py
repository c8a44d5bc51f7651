"""Boundaries to external programs and models: each takes a plain function and runs it over Arrow batches.

The functions are given by the caller (a TeX engine, a PDF reader, a text model), so nothing here
depends on them; failures of one row become that row's result, and a lost task runs its rows again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS = "array<struct<c:string,x0:double,x1:double>>"


def compiled(files: DataFrame, compile_one: Callable[[str, str], tuple[str, str]], log_chars: int = 12_000) -> DataFrame:
    """``files`` (arxiv_id, main_tex) -> (arxiv_id, compiled, log): ok, failed, timeout or error, and the log's tail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for paper, main in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    state, log = compile_one(paper, main)
                except TimeoutError as e:
                    state, log = "timeout", str(e)
                except Exception as e:  # noqa: BLE001  what an external program raises is that row's outcome
                    state, log = "error", f"{type(e).__name__}: {e}"
                found.append((paper, state, log[-log_chars:]))
            cols = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=["arxiv_id", "compiled", "log"])

    return files.select("arxiv_id", "main_tex").mapInArrow(run, "arxiv_id string, compiled string, log string")


def first_that_compiles(engines: list[Callable[[str, str], tuple[str, str]]]) -> Callable[[str, str], tuple[str, str]]:
    """A compile function that tries engines in order; the last failure is the result if none succeeds."""

    def run(paper: str, main: str) -> tuple[str, str]:
        state, logs = "failed", []
        for engine in engines:
            state, log = engine(paper, main)
            logs.append(log)
            if state == "ok":
                break
        return state, "\n".join(logs)

    return run


def extracted_spans(items: DataFrame, read_spans: Callable[[str, int, tuple[float, float, float, float]], list[dict]]) -> DataFrame:
    """Raw spans of items (doc_id, global_order, pdf, page_idx, source_page_idxs, bbox): a row a span, in reading order.

    ``read_spans(pdf, page, box)`` gives dicts of text, font_name, size, flags and chars (dicts of c, x0
    and x1), from which the text is rebuilt later. An item whose pages aren't as many as its boxes has
    all of them on its page_idx; a box whose page is unknown, out of range or can't be read is skipped,
    and spans without text or characters are dropped.
    """
    pages = F.col("source_page_idxs")
    if "page_idx" in items.columns:
        pages = F.when(F.size("source_page_idxs") == F.size("bbox"), pages).otherwise(F.array_repeat("page_idx", F.size("bbox")))
    boxes = items.select("doc_id", "global_order", "pdf", F.posexplode(F.arrays_zip(pages.alias("page"), F.col("bbox").alias("box"))).alias("chunk", "z"))
    boxes = boxes.select("doc_id", "global_order", "pdf", "chunk", "z.page", "z.box.*").where("page >= 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                try:
                    spans = read_spans(r["pdf"], r["page"], (r["x0"], r["y0"], r["x1"], r["y1"]))
                except Exception:  # noqa: BLE001  an unreadable box has no spans
                    spans = []
                kept = [(k, s) for k, s in enumerate(spans) if (s.get("text") or "").strip() or s.get("chars")]
                out += [(r["doc_id"], r["global_order"], r["chunk"], k, s.get("text"), s.get("font_name"), s.get("size"), s.get("flags"), s.get("chars")) for k, s in kept]
            cols = list(zip(*out, strict=True)) or [[]] * 9
            chars = pa.list_(pa.struct([("c", pa.string()), ("x0", pa.float64()), ("x1", pa.float64())]))
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), chars)
            names = ["doc_id", "global_order", "chunk", "pos", "text", "font_name", "size", "flags", "chars"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return boxes.mapInArrow(run, f"doc_id long, global_order int, chunk int, pos int, text string, font_name string, size double, flags int, chars {CHARS}")


def text_vectors(items: DataFrame, tokenize: Callable[[str], list[int]], embed: Callable[[list[list[int]]], np.ndarray], width: int = 768, max_length: int = 512, stride: int = 384, batch: int = 16) -> DataFrame:
    """(doc_id, global_order, vector): the mean over windows of what ``embed`` gives a batch of windows; zeros without tokens."""
    body = max_length - 2
    step = min(stride, body)
    if step <= 0:
        raise ValueError("stride must be positive")

    def vector(text: str) -> list[float]:
        ids = tokenize(text)
        if not ids:
            return [0.0] * width
        n = max(0, -(-(len(ids) - body) // step)) + 1
        windows = [ids[k * step : k * step + body] for k in range(n)]
        return np.concatenate([np.asarray(embed(windows[at : at + batch]), np.float64) for at in range(0, n, batch)]).mean(axis=0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            vectors = pa.array([vector(t or "") for t in rows.column(2).to_pylist()], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), vectors], names=["doc_id", "global_order", "vector"])

    return items.select("doc_id", "global_order", "embedding_text").mapInArrow(run, "doc_id long, global_order int, vector array<float>")
