"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one kept per group.

Equal vectors are merged first, with their number and least vec_id. Centres are fitted in two levels on
bounded samples: groups on at most ``SAMPLE`` distinct vectors, then the cells of each group in a task of
its own on the group's share of ``PER_CELL`` vectors a cell. Cells grow with the table (its square root,
or one for each ``OWNED`` vectors if that is more) as far as ``CENTRES`` bytes hold their centres. Every
vector is indexed: it belongs to the nearest cell and visits the next nearest, ``PROBES`` in all, among
those of its ``PROBES`` nearest groups. A pair is compared where one's home is visited by the other;
the tests measure recall against brute force. A cell larger than a block is cut into blocks of
targets and of sources, and every block pair is a task of its own, so a hot cell is spread out and no
cell is held whole.

Links are counted in the blocks and never written out; from each block only a spanning forest of
its links goes on to the components. Cosines are in double precision, and no pair below the
threshold links.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows
without vec_id, link with nothing; vectors of differing length don't link; rows that repeat a vec_id
with unlike vectors are vectors of their own that share a name, each with its own links, and a group is
named by the least vec_id in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cut, hot_join
from pageloom.llm.components import labelled

THRESHOLD, PROBES = 0.9, 4
#: Sampled vectors for groups and for each cell; vectors of a cell where the square root has fewer cells; bytes of centres and their number at most.
SAMPLE, PER_CELL, OWNED, CENTRES, CELLS = 8192, 8, 2048, 1 << 26, 1 << 16
#: Rows of a block of targets or of sources, and sources compared at once.
BLOCK, CHUNK = 4096, 512


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_cells(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Unit centres of spherical k-means; a cell left empty keeps its centre."""
    points = unit(sample)
    centres = points[np.random.default_rng(seed).choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(rounds):
        home = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, points)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def cells_of(total: int, dim: int) -> int:
    """The number of cells for ``total`` distinct vectors of a length."""
    return max(1, min(CELLS, CENTRES // (4 * dim), max(round(math.sqrt(total)), total // OWNED)))


class Index:
    """Centres of one length: groups, and each group's cells, numbered on from those of the group before."""

    def __init__(self, groups: np.ndarray, cells: dict[int, np.ndarray]):
        self.groups = groups.astype(np.float32)
        self.cells = [cells.get(g, groups[g : g + 1]).astype(np.float32) for g in range(len(groups))]
        self.first = np.r_[0, np.cumsum([len(c) for c in self.cells])].astype(np.int32)

    def nearest(self, points: np.ndarray, probes: int) -> np.ndarray:
        """The nearest cells [n, probes] of unit vectors, nearest first, among those of the nearest groups; -1 fills up."""
        points = points.astype(np.float32)
        near = np.argsort(-(points @ self.groups.T), axis=1, kind="stable")[:, :probes]
        sims, ids = np.full((len(points), probes), -np.inf, np.float32), np.full((len(points), probes), -1, np.int32)
        for g in np.unique(near).tolist():
            rows = np.flatnonzero((near == g).any(axis=1))
            both = np.concatenate([sims[rows], points[rows] @ self.cells[g].T], axis=1)
            name = np.concatenate([ids[rows], np.broadcast_to(np.arange(self.first[g], self.first[g + 1]), (len(rows), len(self.cells[g])))], axis=1)
            best = np.argsort(-both, axis=1, kind="stable")[:, :probes]
            sims[rows], ids[rows] = np.take_along_axis(both, best, 1), np.take_along_axis(name, best, 1)
        return ids


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        yield dim, batch.filter(pa.array(dims == dim))


def fit_index(vectors: DataFrame) -> dict[int, Index]:
    """``vectors`` (id, dim, vector) -> an index for each length; the sample of the lowest hashes, the same on every run."""
    spark, mixed = vectors.sparkSession, F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    sizes = {r["dim"]: (r["n"], r["vector"]) for r in vectors.groupBy("dim").agg(F.count("*").alias("n"), F.min("vector").alias("vector")).collect()}
    by_dim: dict[int, list] = {}
    for r in vectors.select("dim", "vector", mixed.alias("h")).orderBy("h").limit(SAMPLE).collect():
        by_dim.setdefault(r["dim"], []).append(r["vector"])
    wanted = {d: cells_of(n, d) for d, (n, _) in sizes.items()}
    groups = {}
    for d, k in wanted.items():
        some = np.array(by_dim.get(d) or [sizes[d][1]], np.float64)  # a length too rare for the sample has one group
        groups[d] = fit_cells(some, max(1, min(round(math.sqrt(k)), len(some) // 4)))
    shared = spark.sparkContext.broadcast(groups)

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, some in _by_dim(batch):
                home = (unit(_matrix(some.column("vector"))) @ shared.value[d].T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(home.astype(np.int32))], names=[*some.schema.names, "home"])

    kind = vectors.schema["vector"].dataType.simpleString()

    def fitted(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = _matrix(table.column("vector"))
        centres = fit_cells(x, max(1, round(len(x) / PER_CELL)))
        n = len(centres)
        return pa.table({"dim": table.column("dim").combine_chunks()[:1].take(pa.array([0] * n)), "home": table.column("home").combine_chunks()[:1].take(pa.array([0] * n)), "centre": pa.array(list(centres), pa.list_(pa.float64()))})

    share = F.lit(0.0)
    for d, k in wanted.items():
        share = F.when(F.col("dim") == d, F.lit(min(1.0, PER_CELL * k / sizes[d][0]))).otherwise(share)
    some = vectors.select("id", "dim", "vector").where(mixed < share * (1 << 30))
    found = some.mapInArrow(grouped, f"id long, dim int, vector {kind}, home int").groupBy("dim", "home").applyInArrow(fitted, "dim int, home int, centre array<double>")
    cells: dict[int, dict[int, list]] = {d: {} for d in wanted}
    for r in found.collect():  # at most about CELLS centres, CENTRES bytes
        cells[r["dim"]].setdefault(r["home"], []).append(r["centre"])
    return {d: Index(groups[d], {g: np.array(c) for g, c in cells[d].items()}) for d in wanted}


def _indexed(vectors: DataFrame, models: dict[int, Index], probes: int) -> DataFrame:
    """``vectors`` (id, n, dim, vector) with home and visits (cells, home left out)."""
    shared = vectors.sparkSession.sparkContext.broadcast(models)  # at most CENTRES bytes a length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, some in _by_dim(batch):
                near = shared.value[dim].nearest(unit(_matrix(some.column("vector"))), probes)
                visits = pa.array([[c for c in row if c >= 0] for row in near[:, 1:].tolist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(near[:, 0]), visits], names=[*some.schema.names, "home", "visits"])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("id", "n", "dim", "vector").mapInArrow(run, f"id long, n long, dim int, vector {kind}, home int, visits array<int>")


def forest(hits: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest (source row, target column) of a bipartite graph given as a matrix."""
    out, rows_left, cols_left = [], hits.any(axis=1), hits.any(axis=0)
    while cols_left.any():
        frontier = np.array([int(np.argmax(cols_left))])
        cols_left[frontier] = False
        while len(frontier):
            rows = np.flatnonzero(rows_left)
            part = hits[np.ix_(rows, frontier)]
            new = part.any(axis=1)
            rows, part = rows[new], part[new]
            out += zip(rows.tolist(), frontier[part.argmax(axis=1)].tolist(), strict=True)
            rows_left[rows] = False
            cols = np.flatnonzero(cols_left)
            part = hits[np.ix_(rows, cols)]
            new = part.any(axis=0)
            frontier, part = cols[new], part[:, new]
            out += zip(rows[part.argmax(axis=0)].tolist() if len(rows) else [], frontier.tolist(), strict=True)
            cols_left[frontier] = False
    return out


def _compare(threshold: float):
    """For a block: rows (id, links, other): links to add to id's number, or a forest edge id - other."""

    def run(table: pa.Table) -> pa.Table:
        target = table.column("target").to_numpy()
        ids, n, homes = (table.column(c).to_numpy() for c in ("id", "n", "home"))
        x = _matrix(table.column("vector"))
        size = np.linalg.norm(x, axis=1)
        t, s = np.flatnonzero(target), np.flatnonzero(~target)
        if not len(t) or not len(s):
            return empty
        hits = np.empty((len(s), len(t)), bool)
        for at in range(0, len(s), CHUNK):
            some = s[at : at + CHUNK]
            hits[at : at + CHUNK] = x[some] @ x[t].T / size[some][:, None] / size[t][None, :] >= threshold
        hits &= ids[s][:, None] != ids[t][None, :]
        add = np.zeros(len(ids), np.int64)
        for at in range(0, len(s), CHUNK):
            add[s[at : at + CHUNK]] = hits[at : at + CHUNK] @ n[t]
        # a visitor's link is also found in the visitor's home if the target visits that; else it counts for both here
        visits = table.column("visits").to_pylist()
        for k in np.flatnonzero((homes[s] != homes[t[0]]) & hits.any(axis=1)).tolist():
            for j in np.flatnonzero(hits[k]).tolist():
                if homes[s[k]] not in visits[t[j]]:
                    add[t[j]] += n[s[k]]
        some = np.flatnonzero(add)
        edges = np.array(forest(hits), np.int64).reshape(-1, 2)
        u, v = ids[s[edges[:, 0]]], ids[t[edges[:, 1]]]
        return pa.table({"id": np.r_[ids[some], u], "links": np.r_[add[some], np.zeros(len(u), np.int64)], "other": pa.array([None] * len(some) + v.tolist(), pa.int64())})

    empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "other": pa.array([], pa.int64())})
    return run


def compared(vectors: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``vectors`` (id, n, dim, vector), distinct -> (id, links, other) from all blocks of all cells."""
    placed = cut(_indexed(vectors, fit_index(vectors), probes))
    own = placed.groupBy("dim", F.col("home").alias("cell")).agg(F.count("*").alias("owned"))
    guests = placed.select("dim", F.explode("visits").alias("cell")).groupBy("dim", "cell").agg(F.count("*").alias("guests"))
    parts = own.join(guests, ["dim", "cell"], "left").select(
        "dim", "cell",
        F.ceil(F.col("owned") / block).cast("int").alias("bs"),
        F.ceil((F.col("owned") + F.coalesce("guests", F.lit(0))) / block).cast("int").alias("ss"),
    )
    parts = F.broadcast(cut(parts))  # a row for each cell, of which there are at most CELLS a length
    lot = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    targets = placed.withColumn("cell", F.col("home")).join(parts, ["dim", "cell"])
    targets = targets.withColumn("b", lot("bs")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("ss") - 1))).withColumn("target", F.lit(True))
    sources = placed.withColumn("cell", F.explode(F.concat(F.array("home"), F.col("visits")))).join(parts, ["dim", "cell"])
    sources = sources.withColumn("s", lot("ss")).withColumn("b", F.explode(F.sequence(F.lit(0), F.col("bs") - 1))).withColumn("target", F.lit(False))
    columns = ["dim", "cell", "b", "s", "id", "n", "home", "visits", "target", "vector"]
    rows = targets.select(columns).unionByName(sources.select(columns))
    return rows.groupBy("dim", "cell", "b", "s").applyInArrow(_compare(threshold), "id long, links long, other long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """``rows`` (vec_id, embedding) -> (vec_id, n_links, component_id, kept), one row a vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    able = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    all_rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").withColumn("able", F.coalesce(able, F.lit(False)))
    # vectors are told apart by 128 bits of hash, so that they needn't travel to meet their results
    good = all_rows.where("able").select("vec_id", "embedding", F.xxhash64("embedding").alias("one"), F.xxhash64(F.lit(1), "embedding").alias("two"))
    vectors = cut(good.groupBy("one", "two", F.col("embedding").alias("vector")).agg(F.min("vec_id").alias("low"), F.count("*").alias("n")).withColumn("dim", F.size("vector")))
    vectors = vectors.withColumn("id", F.monotonically_increasing_id())  # the same on every read of what was written
    alone = all_rows.where("not able").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = cut(compared(vectors, threshold, probes, block))
    nodes = vectors.select(F.col("id").alias("node"), "low", "one", "two", "n")
    named = labelled(nodes, found.where("other is not null").select(F.col("id").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links")).withColumnRenamed("id", "node")
    named = cut(named.join(links, "node", "left").select("one", "two", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("label").alias("component_id")))
    linked = hot_join(good.select("vec_id", "one", "two"), named, ["one", "two"], good.count(), spread=("vec_id",)).select("vec_id", "n_links", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def sql() -> str:
    """DuckDB SQL that compares all pairs."""
    return f"""
    WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    good AS (
      SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
    reach AS (SELECT DISTINCT vec_id AS node, vec_id AS other FROM v UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.other),
    n AS (SELECT u AS vec_id, count(*) AS n_links FROM links GROUP BY u), c AS (SELECT node AS vec_id, min(other) AS component_id FROM reach GROUP BY node)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, coalesce(vec_id = component_id, false) AS kept FROM v LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)"""
