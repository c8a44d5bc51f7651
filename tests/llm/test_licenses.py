import math
import random
import re

import pyspark.sql.functions as F
from oracle import frames

from pageloom.llm import licenses, registry

SF = "/root/testdata/sf0.01"


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words = find(low)
    places = [(i, label) for p, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    found = []
    for text_, label, core in licenses.TEMPLATES:
        t = set(text_.split())
        step = next(s for s in licenses.STEPS if len(text_.split()) <= s - 3)
        for at in range(0, len(words), step):
            block = words[at : at + 2 * step]
            n = len(t & set(block))
            if n >= math.ceil(round(licenses.THRESHOLD * len(t), 9)) and all(f" {c} " in f" {' '.join(block)} " for c in core):
                found.append((label, n / len(t)))
    base, every = {p[1] for p in places}, {p[1] for p in places} | {f[0] for f in found}
    at = [p[0] for p in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(every)), 1.0 if places else max((f[1] for f in found), default=0.0))


def values(r):
    return (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score)


def test_query_equals_sql_and_brute_force(spark):
    got, want = frames(spark, "op4_license_scan", registry.queries(), registry.oracle_sql(), SF)
    assert got == want
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in licenses.digest(docs).collect():
        assert values(r) == brute(texts[r.doc_id]), r.doc_id


def test_odd_texts(spark):
    rng, texts = random.Random(4), []
    for _ in range(300):
        words = rng.choice(licenses.TEMPLATES)[0].split()
        kept = [w for w in words if rng.random() < 0.85]
        rng.shuffle(kept)
        texts.append(rng.choice([" ", "  ", "\n", ", ", "\t"]).join(kept + rng.choices(["the", "of", "xyz", "É", "license", "under"], k=rng.randint(0, 6))))
    texts += [None, "", " \n ", "\n\nUnder the MIT\nLicense cc-by-nc under the mit license", "cc by nc " * 3000, "  cc by nc", "x" * 300_000, "k cc by nc"]
    rows = [(None if i == 5 else i // 2, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit(1)).withColumn("mark", F.lit("x")).withColumn("places", F.lit(0))
    got = sorted(map(repr, ((r.doc_id, *values(r)) for r in licenses.digest(docs).collect())))
    assert got == sorted(map(repr, ((d, *brute(t)) for d, t in rows)))
    assert licenses.digest(docs.limit(0)).collect() == []


def test_notices_as_they_stand_in_files(spark):
    notices = {
        "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the Software)",
        "gpl": "This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by",
        "bsd": "Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that",
        "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
        "apache-2": "Licensed under the Apache License,\nVersion 2.0",
        "gpl-3": "This work is licensed under the GNU General Public License, version 3.",
        "lgpl-3": "Licensed under the GNU Lesser General Public License version 3",
        "cc-by": "Licensed under the Creative Commons Attribution 4.0 International License",
        "cc-by-sa": "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
        # notices of other licences that share most of their words
        "": "Released under the BSD License. Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.",
        " ": "Licensed under the GNU General Public License version 2.0",
    }
    prose = "lorem ipsum dolor sit amet consetetur " * 30
    rows = [(k, label, prose[: 37 * (k % 7)] + text + " " + prose) for k, (label, text) in enumerate(notices.items())]
    got = {r.doc_id: r.labels for r in licenses.digest(spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, text string")).collect()}
    assert got == {k: label.strip() for k, label, _ in rows}


def test_no_python_on_the_main_path(spark):
    plan = licenses.digest(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
