import hashlib
import random
import re
import time

import pyspark.sql.functions as F
from oracle import frames

from pageloom.llm import registry, secrets
from pageloom.llm.spans import match_spans

SF = "/root/testdata/sf0.01"


def brute(text):
    """Every rule on the whole text, without an index; base rules as the contract spells them."""
    base = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 12:
            base.append((m.start(), 0, m.end()))
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    more = [(m.start(), k, m.end()) for k, r in enumerate(secrets.RULES) if not r.base for m in re.finditer(r.pattern, text)]
    return sorted(base), sorted(base + more)


def said(spans):
    return ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in spans)


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd[0-9]+") == (frozenset({"abc", "bcd"}),)
    assert q("(abc|xyz1)=?") == (frozenset({"abc"}), frozenset({"xyz", "yz1"}))
    assert q("ab_?cd") == (frozenset({"ab_", "b_c", "_cd"}), frozenset({"abc", "bcd"}))
    assert q("[0-9a-f]+") == () and q("ab.*cde") == () and q("(abc)?def") == (frozenset({"def"}),)
    assert q("ab[cC]d+") == (frozenset({"abc"}),)


def test_query_equals_sql_and_brute_force(spark):
    got, want = frames(spark, "op7_secret_scan", registry.queries(), registry.oracle_sql(), SF)
    assert got == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in secrets.digest(docs).collect():
        base, every = brute(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
        assert r.base_sha256 == hashlib.sha256(said(base).encode()).hexdigest() and r.spans == said(every)


def test_odd_texts(spark):
    rng = random.Random(2)
    bits = ["token", "TOKEN", "api_key", "ApiKey", "=", ":", " ", '"', "abcdef012345", "AKIA", "AKIAQQ", "Z9" * 8, "secret", "é", "😀", "\n", "ghp_", "x" * 40, "0" * 17, "ſecret=aaaaaaaaaaaaaaaa", "eyJ", "."]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += [None, "", "", "pad " * 60_000 + 'token = "0123456789abcdef0123" ' + "0123456789abcdef " * 300]
    rows = [(None if i == 3 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x")).withColumn("spans", F.lit(1)).withColumn("id", F.lit(2))
    for limit in (secrets.BROADCAST_ROWS, 0):
        secrets.BROADCAST_ROWS, kept = limit, secrets.BROADCAST_ROWS
        got = sorted((str(r.doc_id), r.base_sha256, r.spans) for r in secrets.digest(docs).collect())
        secrets.BROADCAST_ROWS = kept
        want = sorted((str(d), hashlib.sha256(said(brute(t or "")[0]).encode()).hexdigest(), said(brute(t or "")[1])) for d, t in rows)
        assert got == want
    assert secrets.digest(docs.limit(0)).collect() == []


def test_many_matches_take_about_linear_time(spark):
    text = "pad é0123456789abcdef0 " * 40_000
    row = secrets.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_hex == 40_000 and row.spans == said(brute(text)[1])
    took = []
    for n in (10_000, 10_000, 80_000):  # the first time compiles
        docs = spark.createDataFrame([(1, text[: 23 * 10_000] * (n // 10_000))], "doc_id long, text string")
        began = time.perf_counter()
        assert docs.select(F.size(match_spans(F.col("text"), "[0-9a-f]{16,}"))).first()[0] == n
        took.append(time.perf_counter() - began)
    assert took[2] < 24 * took[1], took  # eight times the matches; copying the array for each would take 64 times as long


def test_all_trigrams_in_one_pass(spark):
    text = "".join(secrets.TRIGRAMS) + " To-KEN ïpas PRI.ke "
    got = secrets.index(secrets.keyed(spark.createDataFrame([(1, text), (1, text), (2, None)], "doc_id long, text string"))).collect()
    assert sorted((r.doc_id, r.trigram) for r in got) == sorted(2 * [(1, t) for t in secrets.TRIGRAMS if t in text.lower()])


def test_no_python_on_the_main_path(spark):
    plan = secrets.digest(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
