"""SimHash near-duplicate groups: fingerprints, pigeonhole blocks, verified Hamming links.

Fingerprints at most ``distance`` bits apart, cut into ``blocks`` parts, agree on at least
``blocks - distance`` whole parts, so a join on every choice of that many parts meets every close
pair at least once. ``blocks`` follows from the number of distinct fingerprints, so that a key has
about as many values as there are fingerprints; every choice is exact, only the cost differs.

Equal fingerprints are merged before anything is joined (a hot group of copies is one row). A key
shared by more than ``BUCKET`` fingerprints is not gathered but refined: its free bits are cut
into ``distance + 1`` parts, of which a close pair shares one, until buckets are small. A bucket
with f free bits holds at most 2**f fingerprints, so this ends. From each bucket only a spanning
forest of its verified links is emitted, never all pairs.

Defined results: null text counts as empty; a text without words has fingerprint zero and links
like any other; a null doc_id keeps its row and takes the group's least doc_id (null if none);
repeated rows stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cut, hot_join
from pageloom.llm.components import labelled

#: A bucket of more fingerprints is refined instead of compared in one task.
BUCKET = 2048


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every ``words``-word shingle, repeats included."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(parts), xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.array([digest(joined[a:b], seed) for a, b in spans], np.uint64)


def majority(hashes: np.ndarray, step: int = 1 << 16) -> int:
    """The 64-bit number whose bits are set in over half of ``hashes``; zero if there are none."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), step):
        raw = hashes[at : at + step].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * counts > len(hashes)) & (len(hashes) > 0), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, fp: the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([majority(shingle_hashes(t.as_py(), words)) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(bits: list[int], n: int) -> list[int]:
    """``bits`` cut into n masks of nearly equal size."""
    return [sum(1 << b for b in chunk.tolist()) for chunk in np.array_split(np.array(bits), n)]


def block_masks(n: int, distance: int) -> list[int]:
    """Masks of block choices for ``n`` distinct fingerprints; any close pair agrees under one."""
    for blocks in range(distance + 2, 2 * distance + 4):
        if 64 * (blocks - distance) / blocks >= log2(max(n, 2)):
            break
    parts = _parts(list(range(64)), blocks)
    return [sum(c) for c in combinations(parts, blocks - distance)]


def _refined(mask: int, distance: int) -> list[int]:
    free = [b for b in range(64) if not mask >> b & 1]
    return [mask | p for p in _parts(free, distance + 1)]


def bucket_links(prints: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between distinct fingerprints (uint64) of one bucket."""
    found, todo = [], prints
    while len(todo):
        queue, todo = [todo[0]], todo[1:]
        while queue and len(todo):
            at = queue.pop()
            near = np.bitwise_count(todo ^ at) <= distance
            if near.any():
                hits = todo[near]
                found += [(int(at), int(h)) for h in hits]
                queue += list(hits)
                todo = todo[~near]
    return found


def _links_of(distance: int):
    """A mapInArrow function over rows (key, fp) sorted by key: the links of each key's bucket."""

    def emit(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        sizes, pairs = np.diff(edges), []
        two = edges[:-1][sizes == 2]
        close = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= distance]
        for a, n in zip(edges[:-1][sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            pairs += bucket_links(prints[a : a + n], distance)
        more = np.array(pairs, np.uint64).reshape(-1, 2)
        u, v = np.r_[prints[close], more[:, 0]], np.r_[prints[close + 1], more[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.r_[keys, batch.column(0).to_numpy()]
            prints = np.r_[prints, batch.column(1).to_numpy().view(np.uint64)]
            if len(keys) and keys[0] != keys[-1]:
                done = int(np.searchsorted(keys, keys[-1]))
                yield emit(keys[:done], prints[:done])
                keys, prints = keys[done:], prints[done:]
        if len(keys):
            yield emit(keys, prints)

    return run


def close_links(prints: DataFrame, n: int, distance: int = 4, bucket: int = BUCKET) -> DataFrame:
    """``prints`` (fp: distinct longs, n rows) -> (u, v): links that span each group of close ones."""
    masks = block_masks(n, distance)
    rows, total = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask")), n * len(masks)
    links = None
    while True:
        rows = rows.select("fp", "mask", F.xxhash64("mask", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
        shared = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").withColumn("size", F.col("n"))
        live = cut(hot_join(rows, shared, ["key"], total, spread=("fp",)))
        small = live.where(F.col("size") <= bucket).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
        found = small.mapInArrow(_links_of(distance), "u long, v long")
        links = found if links is None else links.unionByName(found)
        large = live.where(F.col("size") > bucket)
        held = [r["mask"] for r in large.select("mask").distinct().collect()]  # some of the masks made above
        if not held:
            return links
        finer = [(m, _signed(x)) for m in held for x in _refined(m % (1 << 64), distance)]
        choices = prints.sparkSession.createDataFrame(finer, "mask long, finer long")  # its size follows from the 64 bits alone
        rows = large.select("fp", "mask").join(F.broadcast(choices), "mask").select("fp", F.col("finer").alias("mask"))


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, fingerprint, component_id), one row per document.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest doc_id reachable
    over links of at most ``distance`` differing bits.
    """
    of_docs = cut(fingerprints(docs, words))
    distinct = cut(of_docs.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")))
    links = close_links(distinct.select("fp"), distinct.count(), distance)
    labels = cut(labelled(distinct.withColumnRenamed("fp", "node"), links)).select(F.col("node").alias("fp"), "n", F.col("label").alias("component_id"))
    named = hot_join(of_docs, labels, ["fp"], of_docs.count(), spread=("doc_id",))
    return named.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
