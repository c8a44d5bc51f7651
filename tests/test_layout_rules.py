"""Literal cases of the layout, merge, style and graph rules, and a loop model of the folds."""

import random

from pyspark.sql import functions as F

from pageloom.functions import nested
from pageloom.functions import text as T
from pageloom.operators import graph, layout, merge, style
from pageloom.plans import fixtures

COLS = fixtures.COLUMNS


def items(spark, rows):
    return merge.items_v3(layout.reading_order(spark.createDataFrame([(*r[:5], *map(float, r[5:])) for r in rows], COLS)))


def test_literal_documents(spark):
    got = {}
    for r in items(spark, fixtures.LITERAL).orderBy("doc_id", "global_order").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.merge_count))
    assert ("delta continues epsilon goes", 2) in got[-1] and ("zeta here", 1) in got[-1]
    assert got[-2][0] == ("one goes two goes three ends.", 3)
    v4 = merge.items_v4(items(spark, fixtures.LITERAL)).where("doc_id = -3").orderBy("global_order").collect()
    assert [r.text for r in v4] == ["one alpha two be-", "", "", "ta three gamma four.", ""]
    assert v4[0].skipped_float_types == ["table"] and v4[0].skipped_float_global_orders == [1]
    lists = merge.items_v4(items(spark, fixtures.LITERAL)).where("doc_id = -4 and list_marker is not null").orderBy("global_order").collect()
    assert [(r.list_marker.type, r.list_level, r.list_parent_global_order) for r in lists] == [
        ("paren_arabic", 1, 0), ("paren_cjk", 1, 0), ("cjk_comma", 1, 0), ("ordinal_cjk", 1, 0), ("roman", 1, 0), ("bullet", 1, 0), ("bullet", 1, 0),
    ]
    assert lists[0].list_marker.marker == "(1)" and lists[-1].list_item_id == "li_00006"


def loop_order(blocks):
    """Emission of one page's blocks, literally: (index, full, column, x0, y0, cy)."""
    fulls, rest, out = sorted((b for b in blocks if b[1]), key=lambda b: (b[4], b[3], b[0])), [b for b in blocks if not b[1]], []
    by = lambda b: (b[2] or 0, b[4], b[3], b[0])
    for f in fulls:
        out += sorted((b for b in rest if b[5] < f[4] - 8), key=by) + [f]
        rest = [b for b in rest if b not in out]
    return [b[0] for b in out + sorted(rest, key=by)]


def test_reading_order_against_a_loop(spark):
    rng, rows = random.Random(3), []
    for page in range(60):
        for i in range(rng.randint(1, 12)):
            x, y = rng.choice([80, 90, 500, 520]), rng.randint(0, 40) * 20
            rows.append((1, page, i, rng.choice(["paragraph", "title", "list"]), "t", x, y, x + rng.choice([100, 380, 700]), y + rng.choice([4, 20, 60])))
    frame = spark.createDataFrame([(*r[:5], *map(float, r[5:])) for r in rows], COLS)
    got, want = {}, {}
    for r in layout.reading_order(frame).orderBy("page_idx", "visual_order").collect():
        got.setdefault(r.page_idx, []).append(r.original_index)
        want.setdefault(r.page_idx, []).append((r.original_index, r.is_full_width, r.column_id, r.x0, r.y0, r.cy))
    assert all(loop_order(want[p]) == got[p] for p in got)


def test_text_rules(spark):
    rows = ["End. ", "no:", "x”", "  ", None, "1) a", "A. b", "xii. c", "- d", "(3) e", "（十）f", "二、g", "第三．h", "1.x"]
    got = spark.createDataFrame([(r,) for r in rows], "t string").select(T.ends_terminal(F.col("t")), T.marker_type(F.col("t"))).collect()
    assert [r[0] for r in got[:5]] == [True, False, False, False, False]
    assert [r[1] for r in got[5:]] == ["arabic", "alpha", "roman", "bullet", "paren_arabic", "paren_cjk", "cjk_comma", "ordinal_cjk", None]
    ids = ["2501.00001v2", "http://x/abs/9912.1234v1/", "hep-th/9901001", " 2501.00001 ", None, "", "2501.123"]
    got = [r[0] for r in spark.createDataFrame([(i,) for i in ids], "i string").select(T.normalized_id(F.col("i"))).collect()]
    assert got == ["2501.00001", "9912.1234", None, "2501.00001", None, None, None]


def test_style_rules(spark):
    pairs = [("a", "b"), ("a ", "b"), ("a-", "b"), ("a", ","), ("(", "b"), ("a", "("), ("1.", "5"), (".", "b"), ("", "b"), ("=", "b"), ("é", "ß")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(style.join_spans(F.col("a"), F.col("b"))).collect()]
    assert got == ["a b", "a b", "a-b", "a,", "(b", "a (", "1.5", ". b", "b", "=b", "é ß"]
    row = spark.range(1).select(style.size_bucket(F.lit(9.25)).alias("a"), style.size_bucket(F.lit(9.75)).alias("b"), style.font_name(F.lit("ABCDEF+CMMI10")).alias("c"), style.is_math(F.lit("symbolmt"), F.lit("α")).alias("d"), style.is_math(F.lit("symbolmt"), F.lit("a")).alias("e")).first()
    assert tuple(row) == (9.0, 10.0, "cmmi10", True, False)
    spans = spark.createDataFrame([(1, 0, "x", 9.0, 4), (1, 1, "y", 10.0, 4), (1, 2, "z", None, 99)], "doc long, pos int, text string, font_size double, char_count int")
    assert style.baseline_size(spans, ["doc"], "pos").first().baseline_size == 9.0


def test_graph_rules(spark):
    row = spark.range(1).select(graph.bbox_chunks(F.array(*[F.lit(float(i)) for i in range(9)])).alias("c"), graph.bbox_chunks(F.array(F.lit(1.0))).alias("d"), graph.token_windows(F.lit(0)).alias("z"), graph.token_windows(F.lit(510)).alias("o"), graph.token_windows(F.lit(900)).alias("t")).first()
    assert [tuple(c) for c in row.c] == [(0, 1, 2, 3), (4, 5, 6, 7)] and row.d == [] and row.z == [] and row.o == [0]
    assert row.t == [0, 384, 768]
    rows = [(1, i, "paragraph", None, False, [], [], None) for i in range(3)]
    bare = spark.createDataFrame(rows, "doc_id long, global_order int, type string, page_idx int, is_full_width boolean, source_page_idxs array<int>, bbox array<struct<x0:double,y0:double,x1:double,y1:double>>, text string")
    x = [r.x for r in graph.node_features(bare).orderBy("node").collect()]
    assert [len(v) for v in x] == [17] * 3 and [v[14] for v in x] == [0.0, 0.5, 1.0] and x[0][10:14] == [0.0] * 4
    edges = [(r.source, r.target) for r in graph.sequential_edges(bare).orderBy("edge_pos").collect()]
    assert edges == [(0, 1), (1, 0), (1, 2), (2, 1)]


def test_nested_text():
    block = {"title_content": [{"type": "t", "content": " A "}], "content": "B", "other": "no", "list_items": [{"item_content": [{"content": "C"}, None, 3]}]}
    assert nested.text_parts(block) == ["B", "A", "C"]
    deep = "x"
    for _ in range(5000):
        deep = [deep]
    assert nested.text_parts(deep) == ["x"]
    assert nested.references({"content": {"list_type": "reference_list", "list_items": [{"item_content": "r"}, {"item_content": " "}, 3]}}) == ["r"]
