import numpy as np
import pyspark.sql.functions as F
import pytest
import xxhash

from pageloom.llm import components, simhash
from pageloom.llm.components import connected_components


def brute(rows, words=4, distance=4):
    """doc_id -> (fingerprint, smallest reachable doc_id), by comparing all pairs."""
    prints = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = [x for x in low.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
        sh = [" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))] if w else []
        hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, f"{p:016x}", low[find(i)]) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def test_query_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = list(rng.choice(vocab, 40))
        rows.append((1000 - i, " ".join(base)))
        for _ in range(rng.integers(0, 4)):
            near = list(base)
            near[rng.integers(0, 40)] = "zz"
            rows.append((2000 + len(rows), " ".join(near)))
    rows += [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (5, "ONE\x0btwo"), (6, "É one two three"), (7, "é one two three"), (8, "a b c d e " * 3000)]
    rows += [rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("key", F.lit(1))
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()))
    assert got == brute(rows)


def test_very_long_texts_and_clashing_names(spark):
    """Columns named as those of the result are ignored; a text of 300,000 words is read whole."""
    long = " ".join(f"w{k % 977}x{k % 13}" for k in range(300_000))
    rows = [(5, long), (3, long + " end"), (4, "short text"), (4, "short text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("fingerprint", "component_id", "node", "label", "low", "n")})
    assert sorted(map(tuple, simhash.near_duplicates(docs).collect())) == brute(rows)


def test_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d e"), (7, "a b c d e"), (None, "q r s t u v w")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("bucket", [48, 2048])
def test_refined_buckets_lose_no_link(spark, bucket):
    """A ball of close fingerprints overfills every bucket; all must still meet."""
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 63))
    values = {centre ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in range(300)}
    values |= {int(x) for x in rng.integers(0, 1 << 63, 50)}
    prints = sorted(values)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    links = simhash.close_links(frame, len(prints), 4, bucket)
    roots = {r.node: r.root for r in connected_components(links).collect()}
    group = list(range(len(prints)))

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 4:
                group[find(i)] = find(j)
    assert all(bin((r.u ^ r.v) % (1 << 64)).count("1") <= 4 for r in links.collect())
    name = lambda i: roots.get(simhash._signed(prints[i]), simhash._signed(prints[i]))
    for i in range(len(prints)):
        for j in range(i):
            assert (find(i) == find(j)) == (name(i) == name(j))


def test_close_pairs_share_a_block():
    rng = np.random.default_rng(2)
    for n in (10, 10_000, 10**6, 10**9, 10**11):
        masks = simhash.block_masks(n, 4)
        for _ in range(200):
            diff = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
            assert any(not diff & m for m in masks)


@pytest.mark.parametrize("few", [components.FEW, 0])
def test_components_of_a_path_and_a_hub(spark, monkeypatch, few):
    monkeypatch.setattr(components, "FEW", few)  # 0: hubs are dealt out
    path = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1001 + i) for i in range(900)]
    frame = spark.createDataFrame([*path, *hub, (5, 5), (None, 3), (3, 2)], "u long, v long")
    got = {r.node: r.root for r in connected_components(frame).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(1000, 1901), 1000)}
    assert connected_components(frame.limit(0)).collect() == []
