from collections import Counter
from pathlib import Path
from types import SimpleNamespace

import corpus_pipeline
import pytest
from pageloom.llm import language, packing, personal
from pageloom.llm.common import ensure_checkpoint_dir
from test_jaccard import kept_by_brute_force
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(language.training_rows(docs.where(~language.held_out())))
    rows = [r for r in docs.collect() if not model.predict(r.text)[3]]
    assert len(rows) >= 0.98 * docs.count()
    kept = set(kept_by_brute_force([(r.doc_id, r.text) for r in rows]))
    tagger = personal.trained()
    want = Counter()
    t = Tokenizer.from_file(packing.TOKENIZER)
    for r in rows:
        if r.doc_id in kept:
            text, at, out = r.text, 0, ""
            for kind, a, b in sorted(next(personal.all_spans(tagger, [text]))[1], key=lambda s: (s[1], -s[2])):
                if a >= at:
                    out += text[at:a] + f"<{kind.upper()}>"
                at = max(at, b)
            n = len(t.encode(out + text[at:], add_special_tokens=False).ids) + 1
            want.update((r.doc_id, k, min(2048, n - 2048 * k)) for k in range(-(-n // 2048)))
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    got = Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == want
    assert not list(folder.glob("pipeline-*"))


def test_stages_keep_clashing_columns(spark):
    rows = [(k, text, "en", "s", 1, k / 2, f"p{k}", k, "r", k, k, k) for k, text in enumerate(["the and of a word", "and the of", "some words of the text", "the text of and"])]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, lang_pred string, cross_entropy int, rejected string, _in int, mark int, low int"
    docs = spark.createDataFrame(rows, names)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.schema.simpleString() == docs.schema.simpleString()
        got = {r.doc_id: r for r in out.collect()}
        assert all((r.score, r.lang_pred, r.rejected, r._in, r.mark, r.low) == (k / 2, f"p{k}", "r", k, k, k) for k, r in got.items()), name
        if name != "language":
            assert len(got) == 4
    bare = docs.select("doc_id", "text")
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, bare, SF).schema.simpleString() == bare.schema.simpleString()


def test_checkpoint_folder_must_be_named_on_a_cluster():
    class Unset:
        def isDefined(self):
            return False

    session = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=Unset)), getConf=lambda: SimpleNamespace(get=lambda key: None)))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(session)


def test_stages_keep_columns_and_take_odd_rows(spark):
    rows = [(1, None, "en", "s", 0), (1, None, "en", "s", 0), (2, "", None, None, None), (None, "the and of", "en", "s", 9), (3, "the and of a b c", "en", "s", 9), (3, "the and of a b c", "en", "s", 9), (4, "write x@y.zz now", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for given in (docs, docs.limit(0)):
        frame = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, SF)
            assert frame.schema.simpleString() == docs.schema.simpleString()
        frame.collect()
    found = {r.doc_id: r for r in corpus_pipeline.without_personal_data(spark, docs, SF).collect()}
    assert found[4].text == "write <EMAIL> now" and found[4].n_chars == 17
    ids = Counter(r.doc_id for r in corpus_pipeline.without_near_duplicates(spark, docs, SF).collect())
    assert ids == {1: 1, 3: 1, 4: 1, None: 1}
