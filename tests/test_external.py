import json

import numpy as np
from pyspark.sql import functions as F

from pageloom import cli
from pageloom.functions import external
from pageloom.operators import style


def test_compile_boundary(spark):
    def engine(paper, main):
        if paper == "slow":
            raise TimeoutError("late")
        if paper == "broken":
            raise OSError("no engine")
        return ("ok" if main == "main.tex" else "failed"), "x" * 20_000

    rows = spark.createDataFrame([("a", "main.tex"), ("b", "other.tex"), ("slow", "m"), ("broken", "m")], "arxiv_id string, main_tex string")
    got = {r.arxiv_id: (r.compiled, len(r.log)) for r in external.compiled(rows, engine).collect()}
    assert got["a"] == ("ok", 12_000) and got["b"][0] == "failed" and got["slow"][0] == "timeout" and got["broken"][0] == "error"
    both = external.first_that_compiles([lambda p, m: ("failed", "1"), lambda p, m: ("ok", "2"), lambda p, m: ("ok", "3")])
    assert both("p", "m") == ("ok", "1\n2")


def test_span_boundary(spark):
    def read(pdf, page, box):
        if page > 3:
            raise IndexError
        return [{"text": f"{pdf}{page}", "font_name": "F", "size": 9.0, "flags": 16}, {"text": "  "}]

    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    items = spark.createDataFrame([(1, 0, "p", [2, 9, 3], [(0.0, 0.0, 1.0, 1.0)] * 3)], f"doc_id long, global_order int, pdf string, source_page_idxs array<int>, bbox array<{box}>")
    assert [(r.chunk, r.text) for r in external.extracted_spans(items, read).orderBy("chunk").collect()] == [(0, "p2"), (2, "p3")]


def test_spans_to_styled_items(spark):
    """Characters travel with the spans, pages fall back to the item's, and items get their spans back in order."""

    def read(pdf, page, box):
        word = lambda text, gap: [{"c": c, "x0": 6.0 * k + (gap if k >= 2 else 0), "x1": 6.0 * k + 5.5 + (gap if k >= 2 else 0)} for k, c in enumerate(text)]
        return [
            {"text": "", "font_name": "ABCDEF+Times-Bold", "size": 9.1, "flags": 0, "chars": word(f"p{page}ab", 4.0)},
            {"text": "plain", "font_name": "Times", "size": 10.0, "flags": 0}, {"text": "text", "font_name": "Times", "size": 10.0, "flags": 0},
            {"text": None, "font_name": "Times", "size": 10.0, "flags": 0, "chars": [{"c": " ", "x0": 0.0, "x1": 1.0}]},
        ]

    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    rows = [(1, 0, "p", 4, [2, 3], [(0.0, 0.0, 1.0, 1.0)] * 2), (1, 1, "p", 7, [2], [(0.0, 0.0, 1.0, 1.0)] * 2), (1, 2, "p", None, [], [(0.0, 0.0, 1.0, 1.0)])]
    items = spark.createDataFrame(rows, f"doc_id long, global_order int, pdf string, page_idx int, source_page_idxs array<int>, bbox array<{box}>")
    raw = external.extracted_spans(items, read)
    assert {(r.global_order, r.page) for r in raw.join(items.withColumn("page", F.lit(0)).select("global_order", "page"), "global_order").collect()} == {(0, 0), (1, 0)}
    got = {r.global_order: r for r in style.styled_items(items, raw).collect()}
    said = lambda r: [(s.text, s.font_name, s.font_size, s.is_bold, s.char_count) for s in r.style_spans]
    bold = lambda page: (f"p{page} ab", "times-bold", 9.0, True, 5)
    plain = ("plain text", "times", 10.0, False, 9)
    assert said(got[0]) == [bold(2), plain, bold(3), plain] and said(got[1]) == [bold(7), plain, bold(7), plain]
    assert (got[0].style_baseline_size, got[0].style_span_count, got[0].style_extract_status) == (10.0, 4, "ok")
    assert (got[2].style_spans, got[2].style_baseline_size, got[2].style_span_count, got[2].style_extract_status) == ([], None, 0, "empty")


def test_text_vectors(spark):
    rows = spark.createDataFrame([(1, 0, "a " * 900), (1, 1, "")], "doc_id long, global_order int, embedding_text string")
    got = external.text_vectors(rows, lambda t: list(range(len(t.split()))), lambda ws: np.array([[w[0], len(w)] for w in ws]), width=2).orderBy("global_order").collect()
    starts = [0, 384, 768]
    n = [w for w in starts if w == 0 or w < 900 - 510 + 384]
    assert got[0].vector == [float(np.mean(n)), float(np.mean([min(510, 900 - s) for s in n]))] and got[1].vector == [0.0, 0.0]


def test_command_line(spark, tmp_path):
    page = [
        {"type": "paragraph", "bbox": [80, 60, 480, 180], "content": {"paragraph_content": [{"type": "text", "content": "one goes"}]}},
        {"type": "paragraph", "bbox": [520, 60, 920, 180], "content": {"paragraph_content": [{"type": "text", "content": "two ends."}]}},
        {"type": "paragraph", "bbox": [80, 200, 480, 280], "content": {"paragraph_content": [{"type": "text", "content": "left ends."}]}},
        {"type": "paragraph", "bbox": [520, 200, 920, 280], "content": {"paragraph_content": [{"type": "text", "content": "right ends."}]}},
        {"type": "page_number", "content": {"paragraph_content": [{"content": "7"}]}},
        {"type": "list", "bbox": [80, 500, 920, 600], "content": {"list_type": "reference_list", "list_items": [{"item_content": [{"content": "ref"}]}]}},
    ]
    (tmp_path / "a.json").write_text(json.dumps([page]))
    path = "file://" + str(tmp_path / "a.json")
    (tmp_path / "spans.json").write_text("\n".join(json.dumps({"path": path, "global_order": 1, "chunk": 0, "pos": k, "text": t, "font_name": "F-Bold", "size": 9.0, "flags": 0}) for k, t in enumerate(["left", "ends."])))
    for step in cli.STEPS:
        cli.main([step, str(tmp_path / "a.json"), str(tmp_path / step), *(["--spans", str(tmp_path / "spans.json")] if step == "styles" else [])])
    order = spark.read.json(str(tmp_path / "order")).orderBy("visual_order")
    assert [r.text for r in order.collect()] == ["one goes", "left ends.", "two ends.", "right ends.", "ref"]
    items = spark.read.json(str(tmp_path / "items")).orderBy("global_order").collect()
    assert [r.type for r in items] == ["paragraph"] * 4 + ["reference"]
    assert (items[4].raw_type, items[4].list_type, items[4].reference_items) == ("list", "reference_list", ["ref"]) and items[0].reference_items == []
    assert json.loads(items[4].block) == page[5]
    styles = spark.read.json(str(tmp_path / "styles")).orderBy("global_order").collect()
    assert [r.style_extract_status for r in styles] == ["empty", "ok", "empty", "empty", "empty"] and styles[1].style_spans[0].text == "left ends."
    assert spark.read.parquet(str(tmp_path / "graph/edges")).where(F.col("source") == 0).count() == 1
