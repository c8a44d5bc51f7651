import numpy as np
import pyspark.sql.functions as F
import pytest
from oracle import frames

from pageloom.llm import embeddings, registry

SF = "/root/testdata/sf0.1"


def brute(ids, x, threshold=0.9):
    """id -> (n_links, component), by comparing all pairs of valid vectors."""
    valid = [i for i, v in enumerate(x) if v is not None and len(v) and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    links, root = dict.fromkeys(range(len(x)), 0), list(range(len(x)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(valid):
        for j in valid[:a]:
            u, v = np.array(x[i], float), np.array(x[j], float)
            if len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i in range(len(x)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return sorted((ids[i], links[i], low[find(i)], ids[i] == low[find(i)]) for i in range(len(x)))


def odd_vectors(rng):
    x = []
    for _ in range(12):
        c = rng.normal(size=24)
        x += [c.tolist(), *((c + rng.normal(0, 0.25 * rng.random(), 24)).tolist() for _ in range(rng.integers(0, 12)))]
    return x + [x[0], x[0], (2 * np.array(x[0])).tolist(), None, [], [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [1.0, 0.0], [1.0, 0.1]]


def test_small_table_with_odd_vectors(spark):
    rng = np.random.default_rng(3)
    x = odd_vectors(rng)
    ids = rng.permutation(len(x)).tolist()
    frame = spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<double>").withColumn("n", F.lit("q")).withColumn("home", F.lit(0))
    want = brute(ids, x)
    for block in (4096, 7):  # small blocks cut every cell
        got = sorted(map(tuple, embeddings.near_duplicates(frame, probes=64, block=block).collect()))
        assert got == want
    none = embeddings.near_duplicates(frame.limit(0)).collect()
    assert none == []
    odd = frame.where("size(embedding) = 0 or embedding is null").withColumn("vec_id", F.lit(None).cast("long"))
    assert [(r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(odd).collect()] == [(0, None, False)] * 2


def test_rows_that_repeat_a_vec_id_with_unlike_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.1]), (3, [0.1, 1.0]), (4, [1.0, 0.2]), (4, [1.0, 0.2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, embeddings.near_duplicates(frame).collect()))
    assert got == brute([r[0] for r in rows], [r[1] for r in rows]) and sorted(r[1] for r in got if r[0] == 1) == [1, 3]
    rng = np.random.default_rng(8)
    x = odd_vectors(rng)
    ids = rng.integers(0, 12, len(x)).tolist()
    got = sorted(map(tuple, embeddings.near_duplicates(spark.createDataFrame(list(zip(ids, x)), "vec_id long, embedding array<double>"), probes=64).collect()))
    assert got == brute(ids, x)


def test_query_equals_sql(spark):
    got, want = frames(spark, "op10_embedding_dedup", registry.queries(), registry.oracle_sql(), "/root/testdata/sf0.1")
    assert got == want and len(got) == 2000


def counted(ids, x):
    """id -> number of other vectors at 0.9 or more."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for at in range(0, len(x), 1000):
        want.update(zip(ids[at : at + 1000].tolist(), ((x[at : at + 1000] @ x.T >= 0.9).sum(1) - 1).tolist()))
    return want


def recall(frame, ids, x):
    want = counted(ids, x)
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(frame).collect()}
    assert got.keys() == want.keys() and all(got[i] <= want[i] for i in got)
    share = sum(got.values()) / sum(want.values())
    print(f"{len(x)} vectors, {sum(want.values())} links, recall {share:.4f}")
    return share


def test_recall_on_large_groups_of_near_copies(spark):
    rng = np.random.default_rng(12)
    x = [rng.normal(size=(3000, 64))]
    for size in (1200, 300, *[20] * 40, *[3] * 200):
        x.append(rng.normal(size=64) + rng.normal(size=(size, 64)) * rng.uniform(0.02, 0.6))
    x = rng.permutation(np.concatenate(x))
    frame = spark.createDataFrame(zip(range(len(x)), x.tolist()), "vec_id long, embedding array<double>")
    assert recall(frame, np.arange(len(x)), x) >= 0.95


def test_recall_on_twenty_thousand_vectors(spark):
    """Neighbours at all angles up to the threshold and beyond, around centres without any structure."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(5000, 64))
    near = rng.normal(size=(5000, 3, 64)) * rng.uniform(0, 0.8, (5000, 3, 1))
    x = np.concatenate([centres, (centres[:, None] + near).reshape(-1, 64)])
    frame = spark.createDataFrame(zip(range(len(x)), x.tolist()), "vec_id long, embedding array<double>")
    assert len(x) == 20_000 and recall(frame, np.arange(len(x)), x) >= 0.9


def test_cells_grow_with_the_table():
    assert [embeddings.cells_of(n, 64) for n in (1, 10_000, 10**6, 10**8, 10**12)] == [1, 100, 1000, 48828, 65536]
    assert embeddings.cells_of(10**12, 4096) == 4096


@pytest.mark.parametrize("seed", range(5))
def test_forest_spans_what_the_matrix_links(seed):
    hits = np.random.default_rng(seed).random((15, 12)) < 0.12
    edges = embeddings.forest(hits)
    assert all(hits[i, j] for i, j in edges)

    def parts(pairs):
        name = {}
        for i in range(15):
            name[("s", i)] = ("s", i)
        for j in range(12):
            name[("t", j)] = ("t", j)
        for i, j in pairs:
            a, b = name[("s", i)], name[("t", j)]
            name = {k: a if v == b else v for k, v in name.items()}
        groups = {}
        for k, v in name.items():
            groups.setdefault(v, set()).add(k)
        return sorted(map(sorted, groups.values()))

    assert parts(edges) == parts(zip(*np.nonzero(hits)))
