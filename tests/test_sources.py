import gzip
import io
import json
import tarfile
import zipfile
from datetime import datetime, timedelta

import pytest

from pageloom.operators import manifest
from pageloom.sources import archives, workspace
from pageloom.sources import layout_json as L
from pageloom.streaming import resume


def test_layout_files(spark, tmp_path):
    page = [{"type": "list", "bbox": [1, 2, 3, 4], "content": {"list_type": "reference_list", "list_items": [{"item_content": [{"content": "r"}]}]}}, {"type": "title", "content": {"title_content": "T"}}]
    (tmp_path / "a.json").write_text(json.dumps([page, []]))
    rows = L.blocks_of(L.read_layout(spark, str(tmp_path / "a.json"))).orderBy("original_index").collect()
    assert [(r.type, r.logical_type, r.bbox, r.text, r.reference_items) for r in rows] == [("list", "reference", [1.0, 2.0, 3.0, 4.0], "r", ["r"]), ("title", "title", None, "T", [])]
    (tmp_path / "b.json").write_text('{"not": "pages"}')
    with pytest.raises(Exception, match="not a list of pages"):
        L.read_layout(spark, str(tmp_path / "b.json")).collect()
    (tmp_path / "c.json").write_text('{"items": [{"a": 1}, 3, {"a": 2}]}')
    assert [json.loads(r.item)["a"] for r in L.read_items(spark, str(tmp_path / "c.json")).orderBy("position").collect()] == [1, 2]


def test_json_lines_keep_their_numbers(spark, tmp_path):
    lines = [json.dumps({"id": i}) if i % 3 else "broken {" for i in range(500)]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    rows = L.read_jsonl(spark, str(tmp_path / "m.jsonl")).selectExpr("line", "variant_get(record, '$.id', 'int') AS id").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r.line, r.id) for r in rows) == [(i + 1, i) for i in range(500) if i % 3]


def archive(files, kind):
    out = io.BytesIO()
    if kind == "tar":
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            for name, text in files.items():
                info = tarfile.TarInfo(name)
                info.size = len(text)
                t.addfile(info, io.BytesIO(text.encode()))
    else:
        with zipfile.ZipFile(out, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
    return out.getvalue()


def test_archives(spark):
    good = {"main.tex": "\\documentclass", "sub/a.tex": "x"}
    rows = [("tar", archive(good, "tar")), ("zip", archive(good, "zip")), ("gz", gzip.compress(b"\\begin{document}")), ("plain", b"\\documentclass{a}"), ("html", b"<html>"), ("evil", archive({"../out/a": "x"}, "tar")), ("evil2", archive({"/abs": "x"}, "zip"))]
    got = {}
    for r in archives.unpacked(spark.createDataFrame([(k, bytearray(v)) for k, v in rows], "id string, content binary")).collect():
        got.setdefault(r.id, []).append((r.path, r.error))
    assert got["tar"] == got["zip"] == [("main.tex", None), ("sub/a.tex", None)] and got["gz"] == got["plain"] == [("main.tex", None)]
    assert "neither" in got["html"][0][1] and "unsafe" in got["evil"][0][1] and "unsafe" in got["evil2"][0][1]
    with pytest.raises(ValueError, match="too large"):
        archives.members(archive({"a.tex": "x" * 5000}, "zip"), 1000)


def test_feed_entries(spark):
    feed = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x.org/abs/2501.00001v2</id><title>A
      title</title><published>2025-01-02T00:00:00Z</published><updated>2025-02-03T00:00:00Z</updated><category term="cs.CL"/><category term="cs.LG"/></entry>
      <entry><id>http://x.org/abs/2401.00002v1</id><title>old</title><published>2024-01-02T00:00:00Z</published></entry><entry><id>bad</id></entry></feed>"""
    rows = archives.atom_entries(spark.createDataFrame([(0, feed)], "position int, xml string"), 2025).collect()
    assert [(r.arxiv_id, r.title, r.categories, r.update_date) for r in rows] == [("2501.00001", "A title", "cs.CL cs.LG", "2025-02-03")]


def test_feed_is_paged(spark):
    entry = "<entry><id>http://x.org/abs/{}</id><title>t</title><published>{}-01-02T00:00:00Z</published></entry>"
    stock = [entry.format(f"2501.{k:05}v1", 2025 if k % 4 else 2024) for k in range(1, 12)]
    asked, pauses = [], []

    def fetch(query):
        asked.append((int(query["start"]), int(query["max_results"])))
        at, n = asked[-1]
        return f'<feed xmlns="http://www.w3.org/2005/Atom">{"".join(stock[at : at + n])}</feed>'

    pages = list(archives.feed_pages(fetch, 2025, 6, batch=4, sleep=2.0, pause=pauses.append))
    assert asked == [(0, 4), (4, 3), (7, 1), (8, 1)][: len(asked)] and pauses == [2.0] * (len(asked) - 1)
    ids = archives.atom_entries(spark.createDataFrame(pages, "position int, xml string"), 2025).select("arxiv_id").distinct().count()
    assert ids == 6
    asked.clear()
    assert len(list(archives.feed_pages(fetch, 2025, 100, batch=50, pause=pauses.append))) == 1 and asked == [(0, 50), (11, 50)]


def test_fetching_again():
    said, pauses = [], []

    def fetch(paper):
        said.append(paper)
        if paper == "gone":
            raise archives.FetchFailed("HTTP 404", permanent=True)
        if paper == "late" and said.count("late") < 3:
            raise OSError("reset")
        if paper == "down":
            raise archives.FetchFailed("HTTP 500")
        return b"" if paper == "empty" else b"body"

    run = archives.retrying(fetch, retries=3, sleep=1.5, pause=pauses.append)
    assert run("ok") == (b"body", False, None) and run("late") == (b"body", False, None)
    assert run("gone") == (None, True, "HTTP 404") and said.count("gone") == 1
    assert run("empty") == (None, False, "empty body") and run("down") == (None, False, "HTTP 500")
    assert said.count("empty") == said.count("down") == 3 and pauses == [1.5] * 6


def test_fetched_rows(spark):
    rows = spark.createDataFrame([("a",), ("gone",)], "arxiv_id string")

    def fetch(paper):
        if paper == "gone":
            raise archives.FetchFailed("HTTP 404", permanent=True)
        return paper.encode()

    got = {r.arxiv_id: (r.content, r.permanent, r.error) for r in archives.fetched(rows, archives.retrying(fetch, 2, 0.0)).collect()}
    assert got == {"a": (bytearray(b"a"), False, None), "gone": (None, True, "HTTP 404")}


def test_ids_of_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"arxiv_id": "http://x/abs/2501.00001v2"}\n{"arxiv_id": ""}\nbroken {\n{"arxiv_id": null}\n{"other": 1}\n{"arxiv_id": "hep-th/1"}\n')
    (tmp_path / "b.jsonl").write_text('{"arxiv_id": "2501.00001"}\n{"arxiv_id": "2501.00002"}\n')
    paths = [str(tmp_path / n) for n in ("a.jsonl", "b.jsonl", "none.jsonl")]
    assert sorted(r.arxiv_id for r in L.read_ids(spark, *paths).collect()) == ["2501.00001", "2501.00002"]
    assert sorted(r.arxiv_id for r in L.read_ids(spark, *paths, normalise=False).collect()) == ["2501.00001", "2501.00002", "hep-th/1", "http://x/abs/2501.00001v2"]
    assert L.read_ids(spark, paths[2]).collect() == []


def test_ready_sources_and_appended_lines(spark, tmp_path):
    for name in ("pool/a/main.tex", "pool/b/x/y/part.tex", "pool/b/z.tex", "pool/c/notes.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    assert archives.ready_sources(spark, str(tmp_path / "pool")) == 2
    log = str(tmp_path / "log")
    for rows in ([("z", 1)], [("a", 2), ("b", 3)]):
        L.append_jsonl(spark.createDataFrame(rows, "status string, line int"), log)
    assert sorted(r.line for r in spark.read.json(log).collect()) == [1, 2, 3]
    assert all(list(json.loads(x)) == ["line", "status"] for f in (tmp_path / "log").glob("part-*") for x in f.read_text().splitlines())


def test_workspace(spark, tmp_path):
    space = workspace.Workspace(str(tmp_path / "data"))
    space.ensure(spark)
    space.ensure(spark)
    assert (tmp_path / "data/09_eval_reports/arxiv_2025_tex_compile").is_dir() and space.path("manifests", "a.jsonl").endswith("data/00_manifests/a.jsonl")
    for name, text in (("src/x/a.tex", "new"), ("dst/old.tex", "old")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    workspace.replace_tree(spark, str(tmp_path / "src"), str(tmp_path / "dst"))
    assert (tmp_path / "dst/x/a.tex").read_text() == "new" and not (tmp_path / "dst/old.tex").exists() and (tmp_path / "src/x/a.tex").exists()


def test_quota_and_months(spark):
    rows = spark.createDataFrame([(i, i % 3 == 0) for i in range(30)], "k long, ok boolean")
    from pyspark.sql import functions as F

    got = manifest.accept_quota(rows, F.col("ok"), "k", 5, 2).orderBy("k").collect()
    assert [(r.k, r.accepted_index) for r in got] == [(0, 3), (3, 4), (6, 5)]
    assert manifest.success_quota(rows, F.col("ok"), "k", 2).count() == 4
    assert manifest.accept_quota(rows.limit(0), F.col("ok"), "k", 5).collect() == []
    assert manifest.accept_quota(rows, F.col("ok"), "k", 2, 2).collect() == manifest.success_quota(rows, F.col("ok"), "k", 2, 2).collect() == []
    assert manifest.success_quota(rows, F.col("ok"), "k", 99).count() == 30


def test_quotas_in_any_order(spark):
    """Orders that are text, far apart, or missing: rows without one come last."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(f"k{i:05}", i % 2 == 0, 10 ** (i % 19) + i if i else None) for i in range(700)], "name string, ok boolean, at long")
    by_name = {r.name: r.n for r in manifest.running(rows, F.lit(1), "name", "n", parts=8).collect()}
    assert by_name == {f"k{i:05}": i + 1 for i in range(700)}
    order = sorted((10 ** (i % 19) + i, i) for i in range(1, 700)) + [(None, 0)]
    got = {r.name: r.n for r in manifest.running(rows, F.lit(1), "at", "n").collect()}
    assert got == {f"k{i:05}": n + 1 for n, (_, i) in enumerate(order)}
    want, n = {}, 0
    for _, i in order:
        if n < 340:
            n += i % 2 == 0
            want[f"k{i:05}"] = n
    assert {r.name: r.successes for r in manifest.success_quota(rows, F.col("ok"), "at", 340).collect()} == want
    everything = {r.name for r in manifest.success_quota(rows, F.col("ok"), "at", 350).collect()}
    assert len(everything) == 700  # the last success is the row without an order
    assert [r.name for r in manifest.accept_quota(rows, F.col("ok"), "at", 350).orderBy("accepted_index").collect()] == [f"k{i:05}" for _, i in order if i % 2 == 0]


def test_months():
    assert manifest.scan_months(" 01,,12 ") == [1, 12]
    for bad in ("", "13", "0,1"):
        with pytest.raises(ValueError):
            manifest.scan_months(bad)


def test_resumed_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    source, log = tmp_path / "in", str(tmp_path / "log")
    run = lambda: resume.resume(
        spark.readStream.schema("line long, arxiv_id string").json(str(source)), lambda d: d.select("arxiv_id", F.lit("accepted").alias("status")), log, str(tmp_path / "cp")
    ).awaitTermination()
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "line long, arxiv_id string").write.json(str(source))
    run()
    spark.createDataFrame([(4, "b"), (5, "c")], "line long, arxiv_id string").write.mode("append").json(str(source))
    run()
    done = spark.read.json(log)
    assert sorted(r.arxiv_id for r in done.collect()) == ["a", "b", "c"]
    row = resume.progress(done).first()
    assert (row.rows, row.accepted, row.status_counts) == (3, 3, {"accepted": 3})


def test_progress_document(spark):
    log = spark.createDataFrame([("a", "accepted"), ("b", "download_error"), ("c", "compile_failed"), ("d", "already_present"), ("e", None)], "arxiv_id string, status string")
    candidates = spark.createDataFrame([(c,) for c in "abcdefg"], "arxiv_id string")
    row = resume.progress_document(candidates, log, 10, "2026-01-01T00:00:00+00:00").first()
    assert (row.attempted_submitted, row.download_completed, row.compile_completed, row.accepted_total, row.pending, row.remaining, row.success_share) == (5, 4, 2, 2, 2, 8, 0.4)
    assert row.status_counts == {"accepted": 1, "download_error": 1, "compile_failed": 1, "already_present": 1, "unknown": 1}
    assert row.mode == "combined" and row.target_successes == 10 and row.accepted_an_hour > 0 and datetime.fromisoformat(row.updated_at).utcoffset() == timedelta(0)
    empty = resume.progress_document(candidates, log.limit(0), 10, "2026-01-01T00:00:00+00:00").first()
    assert empty.attempted_submitted == 0 and empty.pending == 7 and empty.success_share is None
