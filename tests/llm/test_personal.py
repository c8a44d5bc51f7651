import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pyspark.sql.functions as F

from pageloom.llm import personal

SF = "/root/testdata/sf0.01"


def brute_base(text):
    """The contract's patterns, matched literally."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and personal.luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_equal_the_literal_patterns():
    rng = random.Random(3)
    for _ in range(4000):
        text = "".join(rng.choice(["1", "2", "25", "255", "300", ".", ".", "-", " ", "+", "(", ")", "a", "b@", "@", "x.y", "é", "%", "4111111111111111", "\n", "_"]) for _ in range(rng.randint(0, 24)))
        assert personal.base_spans(text) == brute_base(text), text
    assert personal.luhn("4111111111111111") and not personal.luhn("4111111111111112")


def test_gradient_by_differences():
    tagger, rng = personal.Tagger(), random.Random(1)
    made = [personal._labelled_line(rng) for _ in range(3)]
    x = np.stack([np.pad(personal._classes(t), (0, personal.WINDOW - len(t))) for t, _ in made])
    y = np.stack([personal.tags_of(personal.WINDOW, s) for _, s in made])
    loss, grad = tagger.gradient(x, y)
    for k, v in tagger.p.items():
        at = np.unravel_index(np.argmax(abs(grad[k])), v.shape)
        v[at] += 1e-5
        assert abs((tagger.gradient(x, y)[0] - loss) / 1e-5 - grad[k][at]) < 1e-2 * max(1, abs(grad[k][at]))
        v[at] -= 1e-5


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(5)
    tagger = personal.Tagger()
    tagger.p["T"], tagger.p["S"] = rng.normal(size=(9, 9)), rng.normal(size=9)
    x = rng.integers(0, personal.CLASSES, (6, 4))
    e, p = tagger.emissions(x), tagger.p
    tags, margins = tagger.decode(x)
    for k in range(len(x)):
        score = lambda path: p["S"][path[0]] + sum(e[k, t, y] for t, y in enumerate(path)) + sum(p["T"][a, b] for a, b in zip(path, path[1:], strict=False))  # noqa: B023, E731
        best = max(itertools.product(range(9), repeat=4), key=score)
        assert tuple(tags[k]) == best
        assert np.isclose(margins[k].sum(), score(best) - score((0, 0, 0, 0)))


def test_kept_weights_are_what_training_gives():
    """The first steps trained anew have the losses that were kept with the weights."""
    with np.load(personal.FILE) as kept:
        assert np.allclose(personal.train(most=12)[1], kept["losses"][:12], rtol=1e-4)
    assert personal.trained().p.keys() == personal.Tagger().p.keys()


def test_network_on_held_out_lines():
    tagger, rng = personal.trained(), random.Random(99)
    lines = [personal._labelled_line(rng) for _ in range(2000)]
    n, right, wrong, beyond, reached = Counter(), Counter(), 0, Counter(), Counter()
    for (text, spans), got in zip(lines, personal.model_spans(tagger, [t for t, _ in lines]), strict=True):
        base = set(personal.base_spans(text))
        for s in spans:
            n[s[0]] += 1
            right[s[0]] += s in got
            if s not in base:  # what the patterns leave out
                beyond[s[0]] += 1
                reached[s[0]] += s in got
        wrong += len(set(got) - set(spans))
    print({k: (round(right[k] / n[k], 3), f"{reached[k]} of {beyond[k]} beyond the patterns") for k in n}, wrong / sum(n.values()))
    assert all(right[k] >= 0.9 * n[k] and reached[k] >= 0.9 * beyond[k] and beyond[k] > 50 for k in personal.KINDS)
    assert wrong <= 0.03 * sum(n.values())


def test_reconciliation_against_all_choices():
    rng = random.Random(6)
    for _ in range(200):
        found = [(rng.choice([1.0, 2.0, 2.5, 4.0]), (rng.choice(personal.KINDS), a := rng.randint(0, 12), a + rng.randint(1, 6))) for _ in range(rng.randint(0, 7))]
        best = {s: max(x for x, other in found if other == s) for _, s in found}
        free = lambda some: all(a[2] <= b[1] or b[2] <= a[1] for a, b in itertools.combinations(some, 2))
        most = max(sum(best[s] for s in some) for n in range(len(best) + 1) for some in itertools.combinations(best, n) if free(some))
        got = personal.reconciled(found)
        assert free(got) and got == sorted(got, key=lambda s: s[2]) and np.isclose(sum(best[s] for s in got), most)


def test_windows_are_reconciled_over_the_whole_text():
    found = [(1.0, ("ip", 0, 7)), (3.0, ("phone", 5, 12)), (2.5, ("ip", 12, 20)), (2.5, ("ip", 12, 20)), (1.0, ("card", 19, 30))]
    assert personal.reconciled(found) == [("phone", 5, 12), ("ip", 12, 20)]
    assert personal.reconciled([(1.0, ("ip", 0, 4)), (1.0, ("card", 2, 6))]) == [("ip", 0, 4)]
    tagger = personal.trained()
    for value, kind in (("mail.box@mailhost.example.com", "email"), ("mail.box [at] mailhost.example.com", "email"), ("(555) 123-4567", "phone"), ("612 345 678", "phone"), ("3782-822463-10005", "card"), ("fe80::1ff:fe23:4567:890a", "ip")):
        for pad in range(0, 130, 13):  # at every place of a window
            text = "word " * 300 + "x" * pad + f" write to {value} now " + "word " * 300
            at = text.index(value)
            assert (kind, at, at + len(value)) in personal.model_spans(tagger, [text])[0], (value, pad)
    assert not any(personal.model_spans(tagger, ["on 2024-03-01 at 12:30:45, 1,234,567 of 25.000.000 sold, 12.03.2024, pp. 123-456"]))


def test_windows_left_out_hold_nothing():
    """Running every window of every text gives the same spans."""
    tagger = personal.trained()
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()]
    texts += ["call (555) 123-4567", "a (at) b.org", "", "é" * 500, "x@y.zz" * 30]
    assert personal.model_spans(tagger, texts) == personal.model_spans(tagger, texts, all_windows=True)
    for k in personal.KINDS:
        assert not personal.plausible(k, "no sign at all") and not personal.plausible(k, "::") and not personal.plausible(k, "ab at cd.org")


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    added = 0
    for r in personal.digest(docs).collect():
        base = brute_base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in base) for k in personal.KINDS)
        said = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(said) <= set(every)
        kinds = [(personal.KINDS.index(s.split(":")[0]), int(s.split(":")[1])) for s in every]
        assert kinds == sorted(kinds)
        added += len(every) - len(said)
    assert added <= 0.05 * len(texts)


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (3, "x@y.zz"), (3, "x@y.zz"), (4, "😀 a@b.cc 1.2.3.4 " + "pad " * 50_000 + "+1 (555) 123-4567"), (5, "9" * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("spans", F.lit("q"))
    got = {r.doc_id: r for r in personal.digest(docs).collect()}
    assert got[1].spans == got[2].spans == "" and got[3].spans == "email:0:6"
    assert got[4].spans.startswith("email:2:8,ip:9:16,phone:200017:200034")
    clean = {r.doc_id: r.text for r in personal.redact(docs).collect()}
    assert clean[1] is None and clean[2] == "" and clean[3] == "<EMAIL>" and clean[4].endswith("pad <PHONE>") and clean[4].startswith("😀 <EMAIL> <IP>")
    assert personal.digest(docs.limit(0)).collect() == []
