"""Places of regular expression matches as columns, without Python: JVM expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start: bigint, end: bigint>"


def match_spans(text: Column, pattern: str) -> Column:
    """(start, end) of every leftmost non-overlapping match, in code points, as array<struct<start, end>>.

    The gaps between matches and the matches themselves alternate, so places are running sums of both
    lengths. Adding to an array copies it, so n sums are run in about sqrt(n) arrays of sqrt(n), each
    going on from the one before. The pattern must not match the empty string.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    steps = F.zip_with(F.split(text, pattern, -1), found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("size")))
    return let(F.filter(steps, lambda x: x["size"].isNotNull()), _running)  # the last gap has no match


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once; inside a lambda a column would be computed for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def _running(steps: Column) -> Column:
    width = F.greatest(F.ceil(F.sqrt(F.size(steps))).cast("int"), F.lit(1))
    first = F.sequence(F.lit(0), F.greatest(F.size(steps) - 1, F.lit(0)).cast("int"), width)

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        span = F.struct(start.alias("start"), (start + step["size"]).alias("end"))
        return F.struct((start + step["size"]).alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    def run(done: Column, at: Column) -> Column:
        before = F.coalesce(F.get(done, F.size(done) - 1)["at"], F.lit(0).cast("long"))
        state = F.struct(before.alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
        return F.concat(done, F.array(F.aggregate(F.slice(steps, at + 1, width), state, add)))

    none = F.array().cast(f"array<struct<at: bigint, out: array<{SPAN}>>>")
    return F.flatten(F.transform(F.aggregate(first, none, run), lambda x: x["out"]))
