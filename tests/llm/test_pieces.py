import random
import zlib

import numpy as np
import pyspark.sql.functions as F
import sentencepiece

from pageloom.llm import pieces

SF = "/root/testdata/sf0.01"


def reference():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def test_encoding_equals_the_library():
    sp, encoder, rng = reference(), pieces.Encoder(pieces.MODEL), random.Random(0)
    texts = ["", " ", "   a  b\nc\t é é ", "Hello world, this is it.", "▁x ▁▁", "中文字符 テスト 한국어", "😀 emoji\U0001f9ff", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "1234567 8.9", "x" * 5000, "İß ǅ", "\x01\x7f", "thethethethe ininin"]
    bits = ["the", "in", "er", " ", " ", "é", "ß", "ation", "12", "\n", "Q", "ing", "中", "a", "b", "▁", "."]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for text, raw in zip(texts, encoder.encode(texts, batch=900), strict=True):
        ids = np.frombuffer(raw, "<i4").tolist()
        assert ids == sp.encode(text), text
        assert encoder.decode(ids) == sp.decode(ids), text


def test_edges_are_all_occurrences_of_all_pieces():
    vocab = pieces.Encoder(pieces.MODEL).vocab
    text = "▁the▁information\0▁internationally▁ther\0é▁ß"
    points = np.array([ord(c) for c in text])
    want = sorted((i, p) for p in vocab.id for i in range(len(text)) if text.startswith(p, i))
    for patterns in (vocab.narrow, vocab.wide):
        starts, which = pieces._edges(patterns.code[points], patterns)
        assert sorted((int(s), vocab.piece[i]) for s, i in zip(starts, patterns.ids[which].tolist())) == want


def test_pairs_apart_as_the_merge_rule_says():
    """Pieces taken from running text meet as in use; random ones meet as they never do."""
    vocab, rng = pieces.Encoder(pieces.MODEL).vocab, random.Random(3)
    short = [i for i in vocab.own if vocab.size[i] <= 3]
    pairs = [(rng.choice(vocab.own), rng.choice(short)) for _ in range(3000)] + [(rng.choice(short), rng.choice(vocab.own)) for _ in range(3000)]
    for p in rng.sample(sorted(vocab.id), 3000):
        pairs += [(vocab.id[p[:k]], vocab.id[p[k:]]) for k in range(1, len(p)) if p[:k] in vocab.id and p[k:] in vocab.id]
        pairs += [(vocab.id[p[:k]], i) for k in range(1, len(p)) if p[:k] in vocab.id and (i := vocab.id.get(p[k:] + "s"))]
    pairs = [(a, b) for a, b in pairs if a in set(vocab.own) and b in set(vocab.own)] if len(vocab.own) < len(vocab.id) else pairs
    want = [vocab.merged(vocab.piece[a] + vocab.piece[b])[0] == [vocab.piece[a], vocab.piece[b]] for a, b in pairs]
    left, right = np.array(pairs).T
    for _ in range(2):  # the second time from what is kept
        assert vocab.apart(left, right).tolist() == want
    assert 0.05 < np.mean(want) < 0.95


def test_query_against_the_library(spark):
    docs, sp = spark.read.parquet(f"{SF}/documents.parquet"), reference()
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = pieces.digest(docs).collect()
    assert len(got) == len(texts) and all(r.round_trip for r in got)
    for r in got:
        ids = np.array(sp.encode(texts[r.doc_id]), "<i4")
        assert (r.n_ids, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    back = pieces.decode(pieces.encode(docs)).collect()
    assert all(r.text == texts[r.doc_id] for r in back)


def test_defined_results(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "word " * 40_000), (4, "z" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit(1))
    got = sorted((str(r.doc_id), r.n_ids > 0, r.round_trip) for r in pieces.digest(docs).collect())
    assert got == [("1", False, True), ("2", False, True), ("2", False, True), ("4", True, True), ("None", True, True)]
    assert pieces.digest(docs.limit(0)).collect() == []
