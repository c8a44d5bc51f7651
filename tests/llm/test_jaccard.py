import random

import corpus_pipeline
import numpy as np
from pageloom.llm import jaccard


def kept_by_brute_force(rows):
    """Of (doc_id, text), the least doc_id of each group, by comparing all pairs of shingle sets."""
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted(low.values())


def test_stage_removes_texts_of_similarity_080(spark, monkeypatch):
    """Texts with two to eight edited words; few of them are within four bits of each other."""
    rng = random.Random(3)
    vocab, rows = [f"w{i}" for i in range(3000)], []
    for i in range(40):
        base = rng.choices(vocab, k=300)
        rows.append((i, " ".join(base)))
        for edits in rng.choices(range(2, 9), k=3):
            near = list(base)
            for at in rng.sample(range(300), edits):
                near[at] = "edited"
            rows.append((100 + len(rows), " ".join(near)))
    rows += [(900, "one two"), (901, "ONE\ttwo"), (902, " \n"), (903, None), (904, "one two three")]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept_by_brute_force(rows)
    for volume in (jaccard.VOLUME, 500):  # in one part, and in pairs of parts
        monkeypatch.setattr(jaccard, "VOLUME", volume)
        assert sorted(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()) == want


def test_links_span_what_all_pairs_give():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 40, rng.integers(0, 40)).astype(np.uint64)) for _ in range(120)]
    sets += [s[:-1] for s in sets[:40]]
    near = lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
    label = list(range(len(sets)))
    for a, b in jaccard.links(sets):
        assert near(a, b)
        label = [label[a] if x == label[b] else x for x in label]
    assert all(label[i] == label[j] for i in range(len(sets)) for j in range(i) if near(i, j))


def test_rows_are_told_apart_by_doc_id_and_text(spark):
    """Rows of one doc_id in two groups, and near copies without doc_id."""
    rng = random.Random(5)
    a, b, c = (" ".join(rng.choices([f"w{i}" for i in range(900)], k=200)) for _ in range(3))
    rows = [(7, a), (7, b), (7, b), (9, b + " more"), (None, c), (None, c + " more"), (None, c), (None, a + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text.removesuffix(" more")) for r in corpus_pipeline.without_near_duplicates(spark, docs, "").collect()]
    assert sorted(got, key=repr) == sorted([(7, a), (7, b), (None, c)], key=repr)
