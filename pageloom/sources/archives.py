"""Source archives and feeds: unpacking to rows, and an Atom feed's entries. Fetching is pluggable."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pageloom.functions.text import collapsed
from pageloom.sources.layout_json import safe_member

MEGABYTE = 1 << 20
ATOM = "{http://www.w3.org/2005/Atom}"


def members(raw: bytes, most: int) -> list[tuple[str, int, str]]:
    """(path, size, text) of the files in a tar, a zip, a gzip or a plain TeX body; ValueError if unsafe, too large or neither."""
    try:
        with tarfile.open(fileobj=io.BytesIO(raw)) as archive:
            found = [m for m in archive.getmembers() if m.isfile()]
            _check([(m.name, m.size) for m in found], most)
            return [(m.name, m.size, archive.extractfile(m).read().decode("utf-8", "replace")) for m in found]
    except tarfile.ReadError:
        pass
    if zipfile.is_zipfile(io.BytesIO(raw)):
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            found = [i for i in archive.infolist() if not i.is_dir()]
            _check([(i.filename, i.file_size) for i in found], most)
            return [(i.filename, i.file_size, archive.read(i).decode("utf-8", "replace")) for i in found]
    try:
        with gzip.open(io.BytesIO(raw)) as file:
            body = file.read(most + 1)
    except (OSError, EOFError):
        body = raw
    if len(body) > most:
        raise ValueError("source too large after unpacking")
    text = body.decode("utf-8", "replace")
    if "\\documentclass" not in text and "\\begin{document}" not in text:
        raise ValueError("neither an archive nor a TeX document")
    return [("main.tex", len(text.encode()), text)]


def _check(entries: list[tuple[str, int]], most: int) -> None:
    if sum(size for _, size in entries) > most:
        raise ValueError("source too large after unpacking")
    if unsafe := [name for name, _ in entries if not safe_member(name)]:
        raise ValueError(f"unsafe archive member: {unsafe[0]}")


def unpacked(archives: DataFrame, max_mb: int = 120) -> DataFrame:
    """``archives`` (id, content: binary) -> (id, path, size, text, error); an archive that fails gives one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, raw in zip(batch.column("id").to_pylist(), batch.column("content"), strict=True):
                try:
                    rows = [(key, *m, None) for m in members(raw.as_py() or b"", max_mb * MEGABYTE)]
                except Exception as e:  # noqa: BLE001  what a damaged archive raises is its result
                    rows = [(key, None, None, None, f"{type(e).__name__}: {e}"[:500])]
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "path", "size", "text", "error"])

    return archives.select(F.col("id").cast("string").alias("id"), "content").mapInArrow(run, "id string, path string, size long, text string, error string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("id"), "content")


def ready_sources(spark: SparkSession, path: str) -> int:
    """Folders under ``path`` that hold a .tex file at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tex").load(path)
    root = path.rstrip("/") + "/"
    return files.select(F.substring_index(F.substring_index("path", root, -1), "/", 1).alias("folder")).distinct().count()


class FetchFailed(Exception):
    """A fetch that failed; a permanent failure isn't tried again."""

    def __init__(self, message: str, permanent: bool = False):
        super().__init__(message)
        self.permanent = permanent


def retrying(fetch: Callable[[str], bytes], retries: int = 3, sleep: float = 3.0, pause: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[bytes | None, bool, str | None]]:
    """A fetcher for ``fetched`` from one that returns a body or raises: tries again after a pause, and takes an empty body as a failure."""

    def run(paper: str) -> tuple[bytes | None, bool, str | None]:
        said, permanent = "not tried", False
        for attempt in range(retries):
            if attempt:
                pause(sleep)
            try:
                if body := fetch(paper):
                    return body, False, None
                said = "empty body"
            except FetchFailed as e:
                said, permanent = str(e), e.permanent
                if permanent:
                    break
            except Exception as e:  # noqa: BLE001  whatever a fetcher raises is that try's outcome
                said = f"{type(e).__name__}: {e}"
        return None, permanent, said[:500]

    return run


def feed_pages(fetch: Callable[[dict[str, str]], str], year: int, limit: int, batch: int = 100, sleep: float = 3.0, pause: Callable[[float], None] = time.sleep) -> Iterator[tuple[int, str]]:
    """(position, xml) of a feed's pages for ``atom_entries``: until ``limit`` ids of the year are there, or a page has no entries.

    ``fetch`` takes a page's query; where the next page starts depends on this one, so they come one after another.
    """
    start, seen, position = 0, set(), 0
    while len(seen) < limit:
        if position:
            pause(sleep)
        # fixed values: the query of the feed
        page = fetch({
            "search_query": f"submittedDate:[{year}01010000 TO {year}12312359]", "start": str(start), "max_results": str(min(batch, limit - len(seen))),
            "sortBy": "submittedDate", "sortOrder": "ascending",
        })
        entries = ElementTree.fromstring(page).findall(f"{ATOM}entry")
        if not entries:
            return
        yield position, page
        for entry in entries:
            last = (entry.findtext(f"{ATOM}id") or "").strip().rstrip("/").rsplit("/", 1)[-1]
            published = (entry.findtext(f"{ATOM}published") or "").strip()
            if re.fullmatch(r"\d{4}\.\d{4,5}", re.sub(r"v\d+$", "", last)) and (not published or published.startswith(f"{year}-")):
                seen.add(re.sub(r"v\d+$", "", last))
        start, position = start + len(entries), position + 1


def fetched(candidates: DataFrame, fetch: Callable[[str], tuple[bytes | None, bool, str | None]]) -> DataFrame:
    """``candidates`` (arxiv_id) with content, permanent and error by a given fetcher, which returns (bytes, permanent, error)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [fetch(i) for i in batch.column("arxiv_id").to_pylist()]
            cols = list(zip(*got, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column("arxiv_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.bool_(), pa.string()), strict=True))], names=["arxiv_id", "content", "permanent", "error"])

    return candidates.select("arxiv_id").mapInArrow(run, "arxiv_id string, content binary, permanent boolean, error string")


FEED = "entry array<struct<id:string,title:string,published:string,updated:string,category:array<struct<_term:string>>>>"


def atom_entries(feeds: DataFrame, year: int) -> DataFrame:
    """``feeds`` (position, xml) -> entries of the year in feed order: arxiv_id, title, categories, update_date, created."""
    rows = feeds.select("position", F.posexplode(F.from_xml("xml", FEED)["entry"]).alias("k", "e"))
    last = F.substring_index(F.regexp_replace(collapsed(F.col("e.id")), "/+$", ""), "/", -1)
    terms = F.filter(F.col("e.category._term"), lambda t: t.isNotNull() & (t != ""))
    out = rows.select(
        "position", "k", F.regexp_replace(last, r"v\d+$", "").alias("arxiv_id"), collapsed(F.col("e.title")).alias("title"),
        F.array_join(terms, " ").alias("categories"), F.substring(collapsed(F.col("e.updated")), 1, 10).alias("update_date"), collapsed(F.col("e.published")).alias("created"),
    )
    return out.where(F.col("arxiv_id").rlike(r"^\d{4}\.\d{4,5}(v\d+)?$") & ((F.col("created") == "") | F.col("created").startswith(f"{year}-")))
