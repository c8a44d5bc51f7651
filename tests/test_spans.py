"""Spans in Arrow batches against the folds that they stand for, and the shape of their plans."""

import random

import pytest
from pyspark.sql import functions as F

from pageloom.operators import style
from pageloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def spans(spark):
    rng, signs = random.Random(5), [".", "5", "a", "-", "", " ", "(", ")", "x.", "3", "é", "/", "7.", "“", "ab", "."]
    rows = [(k % 3, k, rng.choice(signs) if k % 97 else None, "f", 9.0 + (k // rng.choice([20, 30])) % 2, False, False, False, False) for k in range(600)]
    return spark.createDataFrame(rows, "d long, pos long, text string, font_name string, font_size double, is_bold boolean, is_italic boolean, is_inline_math boolean, is_inline_code boolean")


def folded(spark):
    rows = style.numbered_spans(spans(spark), ["d"], "pos").groupBy("d", "span").agg(F.sort_array(F.collect_list(F.struct("pos", "text"))).alias("p"), F.max("font_size").alias("font_size"), F.sum(F.length("text")).alias("char_count"))
    text = F.aggregate(F.slice("p", 2, F.size("p")), F.get("p", F.lit(0))["text"], lambda s, p: style.join_spans(s, p["text"]))
    return rows.select("d", "span", text.alias("text"), "font_size", "char_count")


def test_merged_spans_equal_the_fold(spark, small_batches):
    got = style.merge_spans(spans(spark), ["d"], "pos").select("d", "span", "text", "font_size", "char_count")
    want = folded(spark)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_nested_spans_hold_the_merged_and_their_baseline(spark, small_batches):
    got = {r.d: r for r in style.nested_spans(spans(spark), ["d"], "pos").collect()}
    base = {r.d: r.baseline_size for r in style.baseline_size(style.merge_spans(spans(spark), ["d"], "pos"), ["d"], "span").collect()}
    assert {d: r.style_baseline_size for d, r in got.items()} == base
    want = folded(spark).orderBy("span").collect()
    assert {d: [(s.text, s.char_count) for s in r.style_spans] for d, r in got.items()} == {d: [(r.text, r.char_count) for r in want if r.d == d] for d in got}


def test_gaps_of_characters(spark, small_batches):
    rows = [
        (1, [("a", 0.0, 5.0), ("b", 9.0, 14.0), (",", 30.0, 31.0), ("c", 31.0, None), ("d", 60.0, 61.0), ("", 0.0, 1.0), ("e", 61.5, None)], "t"),
        (2, [], "whole"), (3, None, None), (4, [(None, 0.0, 1.0)], "t"), (5, [("a", None, None), ("b", 9.0, 10.0), ("(", 20.0, 21.0), ("c", 40.0, 41.0), ("d", float("nan"), 1.0)], "t"),
    ]
    made = spark.createDataFrame(rows, "k int, chars array<struct<c:string,x0:double,x1:double>>, text string")
    got = {r.k: r.t for r in made.select("k", style.span_text(F.col("chars"), F.lit(10.0), F.col("text")).alias("t")).collect()}
    assert got == {1: "a b,c de", 2: "whole", 3: "", 4: "", 5: "ab (c d"}


def test_words_are_not_shuffled(spark):
    """The documents are, whole, before they are taken apart; in baseline_size and span_merge nothing else is."""
    for name in ("baseline_size", "span_merge"):
        shown = plan(catalog.QUERIES[name](spark, SF))
        assert shown.count("Exchange") == 1 and shown.index("Generate") < shown.index("Exchange"), name


def test_no_fold_in_the_jvm(spark):
    """Folds of an expression a row took most of the time; styled_items joins once and merges spans once."""
    for name in ("char_gap_text", "span_merge", "styled_items"):
        shown = plan(catalog.QUERIES[name](spark, SF))
        assert "aggregate(" not in shown and "ObjectHashAggregate" not in shown, name
    assert shown.count("Join") == 1
