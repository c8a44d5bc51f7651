"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round shuffles only links (two longs a row) and aggregates minima before the shuffle; no
node's neighbours are ever gathered in one place, and nothing but three numbers a round comes to
the driver. A table of so many links that a hub could overfill a task has the links of its hubs dealt
over several tasks (``hot_join``); in smaller ones adaptive execution splits what it finds skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cut, hot_join


#: Links that one task takes well, whatever node they share.
FEW = 4_000_000


def _signature(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*").alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x"), F.sum(F.expr("xxhash64(a, b) % 1000003")).alias("s")
    ).first()
    return tuple(row)


def _to_minimum(pairs: DataFrame, total: int) -> DataFrame:
    """(u, v, m) for each of about ``total`` pairs, m being the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).select("u", F.least("u", "low").alias("m"), "n")
    return hot_join(pairs, least, ["u"], total, spread=("v",)) if total > FEW else pairs.join(least.drop("n"), "u")


def connected_components(links: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``links`` (u, v: long) -> (node, root): root is the least node reachable.

    Self links and nulls are dropped, repeated and reversed links count once; nodes without any
    link are absent from the result, and an empty table gives an empty result. Rounds grow with the
    logarithm of the longest path; ``max_rounds`` only guards against a fault, which raises.
    """
    star = cut(
        links.where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
        .distinct()
    )
    before = _signature(star)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(star.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _to_minimum(both, 2 * before[0]).where("v > u").select(F.col("m").alias("u"), F.col("v").alias("w")).distinct()
        small = _to_minimum(large.select(F.col("w").alias("u"), F.col("u").alias("v")), before[0])
        star = cut(
            small.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a < b").distinct()
        )
        after = _signature(star)
        if after == before:
            return star.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
                star.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
            )
        before = after
    if before[0]:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return star.select(F.col("b").alias("node"), F.col("a").alias("root"))


def labelled(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``nodes`` (node: distinct longs, low, any others) with label: the least low reachable over ``links`` (u, v)."""
    roots = cut(connected_components(links))
    rooted = cut(nodes.join(roots, "node", "left"))
    linked = rooted.where("root is not null")
    least = cut(linked.groupBy("root").agg(F.min("low").alias("label"), F.count("*").alias("_n")))
    found = hot_join(linked, least, ["root"], roots.count(), spread=("node",), count="_n").select(*nodes.columns, "label")
    return found.unionByName(rooted.where("root is null").select(*nodes.columns, F.col("low").alias("label")))
