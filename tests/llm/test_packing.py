import itertools
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyspark.sql.functions as F
import pytest
from tokenizers import Tokenizer

from pageloom.llm import packing

SF = "/root/testdata/sf0.001"


def optimum(items, size):
    """Fewest bins, by trying every assignment."""
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in sorted({x for x in bins if x >= items[i]}):
            rest = list(bins)
            rest.remove(b)
            go(i + 1, [*rest, b - items[i]])
        go(i + 1, [*bins, size - items[i]])

    go(0, [])
    return best[0]


def expand(patterns):
    return [[w for w, n in p for _ in range(n)] for p, times in patterns for _ in range(times)]


def plain_best_fit(items, size):
    bins = []
    for w in sorted(items, reverse=True):
        able = [i for i, r in enumerate(bins) if r >= w]
        if able:
            i = min(able, key=lambda i: bins[i])
            bins[i] -= w
        else:
            bins.append(size - w)
    return len(bins)


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_an_optimum_and_classes_equal_plain_best_fit(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(6, 24))
    items = [int(x) for x in rng.integers(1, size + 1, rng.integers(1, 9))]
    fixed, left = packing.dominated(dict(Counter(items)), size)
    rest = [w for w, n in left.items() for _ in range(n)]
    assert sum(t for _, t in fixed) + optimum(rest, size) == optimum(items, size)
    bins = expand(packing.pack(dict(Counter(items)), size))
    assert all(sum(b) <= size for b in bins) and Counter(itertools.chain(*bins)) == Counter(items)
    many = [int(x) for x in rng.integers(1, size + 1, 200)]
    assert len(expand(packing.best_fit(dict(Counter(many)), size))) == plain_best_fit(many, size)


def test_word_cache_equals_the_tokenizer():
    words = packing.WordTokens(packing.TOKENIZER, most=50)
    t = Tokenizer.from_file(packing.TOKENIZER)
    texts = ["", " ", "It's THE end. Yes,no.. ok.,", "a\n\nb\tc", "<|startoftext|> x<|endoftext|>y", "été É. á.", "ΣΑΣ. ΟΔΟΣ,", "x y　z. \x85 q", "ªb. cº, µ. 12.5, ²., ½.", "w" * 300 + ". z", "İstanbul. ſ. K.", "don't, won't. '', '.", "a\x1cb. c\x1d", "…. ‘s.", "foo. foo, foo", "Ǆ ǅ ŉ ß ÿ Ⱥ ɐ ªº µm ×÷ Ÿ İ I ı", "don't İstanbul Ÿes ÀÉ"]
    for text in texts * 2:
        got = np.frombuffer(next(words.ids([text])), "<u4").tolist()
        assert got == t.encode(text, add_special_tokens=False).ids, text


def test_every_plain_character_beside_others_equals_the_tokenizer():
    words, t = packing.WordTokens(packing.TOKENIZER, most=500), Tokenizer.from_file(packing.TOKENIZER)
    texts = [x for c in map(chr, range(0x260)) for x in (f"a{c}b 1{c}2 .{c}. {c}{c}", f"A{c}. {c}, 'S{c}'s.\n{c}, x{c}{c}.", f"{c}. <|{c}")]
    for text, ids in zip(texts, words.ids(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, ascii(text)


def test_plain_words_need_the_model_alone_and_common_ones_stay_known():
    words, whole, models = packing.WordTokens(packing.TOKENIZER, most=400), [], []
    ids, model = words._ids, words.tokenizer.model

    class Counting:
        def tokenize(self, piece):
            models.append(piece)
            return model.tokenize(piece)

    words._ids, words.model = lambda text: whole.append(text) or ids(text), Counting()
    rng = np.random.default_rng(3)
    rare = ["".join(chr(97 + k) for k in rng.integers(0, 26, 9)) for _ in range(2000)]
    texts = [f"Common words&&& don't, (go) 12.5% élan.\n{' '.join(rare[at : at + 100])}." for at in range(0, 2000, 100)]
    for text in texts:
        list(words.ids([text]))
    assert whole == []
    assert Counter(models)["common"] == 1 and Counter(models)["élan".translate(words.written)] == 1
    assert len(words) + len(words.old) <= 2 * 400


def check(rows, texts, size):
    t = Tokenizer.from_file(packing.TOKENIZER)
    want = Counter()
    for d, text in texts:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for k, at in enumerate(range(0, len(ids), size)):
            part = ids[at : at + size]
            want[(d, k, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= size
    return len(bins)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.packed(docs).collect()
    n = check(rows, [(r.doc_id, r.text) for r in docs.collect()], 2048)
    assert n <= -(-sum(r.length for r in rows) // 2048) + 1


def test_defined_results(spark):
    texts = [(1, None), (1, None), (2, ""), (None, "a b"), (3, "the " * 5000), *((10 + i, "same words here") for i in range(50))]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("salt", F.lit("x")).withColumn("length", F.lit(1.5))
    check(packing.packed(docs, size=16).collect(), texts, 16)
    assert packing.packed(docs.limit(0)).collect() == []
