import math
import random
import zlib
from collections import Counter

import numpy as np
import pyspark.sql.functions as F

from pageloom.llm import language

SF = "/root/testdata/sf0.01"


def plain(rows):
    """(symbols of a text, probability of a symbol after a history) by the textbook recursion, over dictionaries."""
    rows = sorted((lang, text) for text, lang in rows)
    letters = Counter(c for _, t in rows for c in t.lower() if c.isalpha())
    alphabet = {c: k + 1 for k, c in enumerate(sorted(letters))}

    def symbols(text):
        line = [alphabet.get(c, language.OTHER) if c.isalpha() else 0 for c in text.lower()]
        return [s for k, s in enumerate(line) if s or not k or line[k - 1]]

    counts, seen = {}, Counter()
    for lang, text in rows:
        seen[lang] += 1
        if seen[lang] % 3:  # every third row of a language calibrates
            line = [0] * 3 + symbols(text)
            counts.setdefault(lang, Counter()).update(tuple(line[k : k + 4]) for k in range(len(line) - 3))
    orders = {}
    for lang, top in counts.items():
        orders[lang] = {4: top}
        for n in (3, 2, 1):
            orders[lang][n] = Counter(g[1:] for g in orders[lang][n + 1])  # distinct predecessors

    def probability(lang, gram):
        n = len(gram)
        if not n:
            return 1 / (len(alphabet) + 2)
        found = orders[lang][n]
        after = [c for g, c in found.items() if g[:-1] == gram[:-1]]
        if not after:
            return probability(lang, gram[1:])
        once, twice = (sum(c == k for c in found.values()) for k in (1, 2))
        discount = once / (once + 2 * twice) if once and twice else 0.5
        return max(found[gram] - discount, 0) / sum(after) + discount * len(after) / sum(after) * probability(lang, gram[1:])

    return symbols, probability, sorted(counts)


ROWS = [("abab abba", "x"), ("abca abab", "x"), ("bcbc cbcb bcc", "y"), ("cbbc bcab", "y"), ("ab ab", "x"), ("cb cb", "y"), ("Ünï 中文 ab", "z"), ("中 ünüab", "z")]


def test_every_probability_equals_the_plain_recursion():
    model = language.train(ROWS)
    _, probability, langs = plain(ROWS)
    every = [0, *range(1, len(model.alphabet) + 1), language.OTHER]
    rng = random.Random(0)
    for _ in range(60):
        head = [rng.choice(every) for _ in range(3)]
        keys = np.array([sum(s << 16 * (3 - k) for k, s in enumerate((*head, last))) for last in every], np.uint64)
        got = np.exp(model.log_probs(keys).astype(float))
        want = [[probability(lang, (*head, last)) for lang in langs] for last in every]
        assert model.langs == langs and np.allclose(got, want, rtol=1e-4)
        assert np.allclose(got.sum(axis=0), 1, atol=1e-4)


def test_predictions_equal_the_plain_recursion(spark):
    """The query's way of a small table: the lowest cross-entropy by the plain recursion, ties to the first name."""
    rng = random.Random(1)
    rows = []
    for k in range(90):
        lang = ("x", "y", "z")[k % 3]
        bits = {"x": ["ab", "ba", "abc"], "y": ["cb", "bc", "bcc"], "z": ["zü", "üz", "a"]}[lang]
        rows.append((k, " ".join(rng.choice(bits) for _ in range(rng.randint(1, 12))), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = language.training_rows(docs.where(~language.held_out()))
    assert sorted(sample) == sorted({(t, x) for k, t, x in rows if zlib.crc32(str(k).encode()) % 3 != 1})
    symbols, probability, langs = plain(sample)
    for r in language.identify(docs, language.train(sample)).collect():
        line = [0] * 3 + symbols(r.text)
        losses = [-sum(math.log(probability(lang, tuple(line[k : k + 4]))) for k in range(len(line) - 3)) for lang in langs]
        best = min(losses)
        assert losses[langs.index(r.lang_pred)] - best < 1e-3 and np.isclose(r.cross_entropy, best / (len(line) - 3), rtol=1e-4)


def test_sample_holds_rare_languages_long_texts_and_copies_once(spark):
    rows = [(k, f"the and of number {'abcdefghij'[k % 10]}{'klmnopqrst'[k // 10 % 10]}{'uvwxyz'[k // 100 % 6]}{'abcdefghijklmnopq'[k // 600]}", "en") for k in range(10_000)]
    rows += [(20_000 + k, f"og det er ikke{'abcde'[k]}", "no") for k in range(5)]
    rows += [(30_000 + k, "der die das und " * 2000 + "x" * k, "de") for k in range(3)]
    rows += [(40_000 + k, "les copies de texte", "fr") for k in range(4000)] + [(50_000, "les autres textes", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language.training_rows(docs)
    n = Counter(lang for _, lang in got)
    assert n["en"] == language.PER_LANGUAGE and n["no"] == 5 and n["de"] == 3 and n["fr"] == 2
    assert all(0 < len(t) <= language.MAX_CHARS for t, _ in got) and sorted(got) == sorted(language.training_rows(docs.repartition(7)))
    model = language.train(got)
    assert model.predict("det og ikke er det")[0] == "no" and model.predict("und das die der")[0] == "de"


def test_held_out_accuracy_and_rejection(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(language.training_rows(docs.where(~language.held_out())))
    got = language.identify(docs, model).where(language.held_out())
    n, right, long_rejected = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.sum(F.col("rejected").cast("int"))).first()
    assert right >= 0.97 * n
    assert long_rejected <= 0.01 * n
    odd = spark.createDataFrame([(1, "xqz wvkj " * 60), (2, "привет как дела " * 20)], "doc_id long, text string")
    assert {r.rejected for r in language.identify(odd, model).collect()} == {True}


def test_defined_results(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34 !!", None), (4, "the and of the", "en"), (5, "der die das und", "de"), (5, "der die das und", "de"), (6, "the of and to " * 90_000, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    model = language.train(language.training_rows(docs))
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in language.identify(docs, model).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == "und" and got[4][0] == "en" and got[5][0] == "de" and got[6][0] == "en"
    assert language.identify(docs.limit(0), model).collect() == []
    none = language.train([])
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}


def test_pieces_of_a_long_text_score_as_one(monkeypatch):
    model = language.train([("der die das " * 9, "de"), ("the and of " * 9, "en"), ("den dem des " * 9, "de"), ("of to in " * 9, "en")])
    text = "the die of,, den -- x1 " * 50
    whole = model.score(text)
    monkeypatch.setattr(language, "PIECE", 7)
    part = model.score(text)
    assert np.allclose(whole[0], part[0]) and whole[1:] == part[1:]
