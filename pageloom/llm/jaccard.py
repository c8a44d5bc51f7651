"""Near copies by exact shingle similarity: SimHash blocks and MinHash bands give candidates, verified by Jaccard.

Two texts are linked if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
Candidates come first from the SimHash operator: fingerprints over five words, cut into pigeonhole
blocks, joined on blocks and within ``DISTANCE`` bits. At 0.8 about ten of 64 bits differ, and blocks
that meet all such pairs would be too short, so the operator alone misses most pairs near 0.8. MinHash
completes it: ``BANDS`` bands of ``ROWS`` minima, of which a pair of similarity s shares one in
1 - (1 - s**ROWS)**BANDS of cases: 0.9999 at 0.8, more above. Each band key's texts are tied to the
least of them, and groups that hang together by such ties and by SimHash's links are candidates as a
whole: all their pairs are compared, and only links of sufficient similarity are kept.

Equal texts are merged first (a hot group of copies is one row). A text is shipped only if it has a
candidate, once for each pair of parts that its group is cut into; a group of at most ``VOLUME``
shingles is one part, so a task's memory doesn't grow with the group. From each pair of parts only a
spanning forest of its links is emitted.

Defined results: null text counts as empty; texts without words are alike; repeated rows stay; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import cut, hot_join
from pageloom.llm.components import connected_components
from pageloom.llm.simhash import close_links, majority, shingle_hashes

WORDS, SIMILARITY, DISTANCE = 5, 0.8, 4
ROWS, BANDS = 6, 30
#: Shingles of a part of a candidate group; a task holds two parts.
VOLUME = 2_000_000

_random = np.random.default_rng(7)
_FACTORS = _random.integers(0, 1 << 63, ROWS * BANDS, np.uint64) << np.uint64(1) | np.uint64(1)
_MASKS = _random.integers(0, 1 << 63, ROWS * BANDS, np.uint64)
_MIX = _random.integers(0, 1 << 63, ROWS, np.uint64) << np.uint64(1) | np.uint64(1)
_BAND = _random.integers(0, 1 << 63, BANDS, np.uint64)


def mark() -> Column:
    """The hash by which a text is told from others."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def band_keys(hashes: np.ndarray, step: int = 1 << 11) -> np.ndarray:
    """A key for each band; sets of similarity s agree in a band with probability s**ROWS."""
    least = np.full(ROWS * BANDS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), step):
        least = np.minimum(least, ((hashes[at : at + step, None] ^ _MASKS) * _FACTORS).min(axis=0))
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64) ^ _BAND


def links(sets: list[np.ndarray], similarity: float = SIMILARITY) -> list[tuple[int, int]]:
    """A spanning forest of the links between ``sets`` (sorted, distinct hashes), by their indexes."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    number = np.unique(np.concatenate(sets), return_inverse=True)[1]
    order = np.argsort(number, kind="stable")
    held, first = owner[order], np.r_[0, np.cumsum(np.bincount(number))]
    starts = np.r_[0, np.cumsum(sizes)]
    todo, found = np.ones(len(sets), bool), []
    for seed in range(len(sets)):
        queue = [seed] if todo[seed] else []
        todo[seed] = False
        while queue:
            at = queue.pop()
            mine = number[starts[at] : starts[at + 1]]
            where = [held[first[k] : first[k + 1]] for k in mine.tolist()]
            both = np.bincount(np.concatenate(where), minlength=len(sets)) if where else np.zeros(len(sets), np.int64)
            near = np.flatnonzero(todo & (both >= similarity * (sizes + sizes[at] - both) - 1e-9))
            found += [(at, k) for k in near.tolist()]
            todo[near] = False
            queue += near.tolist()
    return found


def _distinct_texts(docs: DataFrame) -> DataFrame:
    """(mark, size, fp: the SimHash fingerprint, bands, low: the least doc_id) of every distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys, prints = [], [], []
            for text in batch.column(2):
                every = shingle_hashes(text.as_py(), WORDS)
                prints.append(majority(every))
                found = np.unique(every)
                sizes.append(len(found))
                keys.append(band_keys(found).view(np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64))
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), fp, bands], ["doc_id", "mark", "size", "fp", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), "text")
    found = rows.mapInArrow(run, "doc_id long, mark long, size long, fp long, bands array<long>")
    return found.groupBy("mark", "size", "fp", "bands").agg(F.min("doc_id").alias("low"))


def _simhash_ties(texts: DataFrame) -> DataFrame:
    """(u, v): marks of texts whose fingerprints are at most DISTANCE bits apart, tied to the least mark of their fingerprint."""
    prints = cut(texts.groupBy("fp").agg(F.min("mark").alias("least"), F.count("*").alias("n")))
    equal = hot_join(texts.select("fp", "mark"), prints.where("n > 1"), ["fp"], texts.count(), spread=("mark",)).where("mark <> least")
    least = prints.select("fp", "least")
    close = close_links(least.select("fp"), prints.count(), DISTANCE)
    close = close.join(least.toDF("u", "a"), "u").join(least.toDF("v", "b"), "v")
    return equal.select(F.col("mark").alias("u"), F.col("least").alias("v")).unionByName(close.select(F.col("a").alias("u"), F.col("b").alias("v")))


def _band_ties(texts: DataFrame) -> DataFrame:
    """(u, v): marks of texts that share a band key, tied to the least of them."""
    keys = texts.select("mark", F.explode("bands").alias("key"))
    shared = cut(keys.groupBy("key").agg(F.min("mark").alias("least"), F.count("*").alias("n")).where("n > 1"))
    ties = hot_join(keys, shared, ["key"], BANDS * texts.count(), spread=("mark",)).where("mark <> least")
    return ties.select(F.col("mark").alias("u"), F.col("least").alias("v"))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (root, a, b, mark, text) sorted by all but the text -> links (u, v) of each (root, a, b)."""
    key, marks, sets = None, [], []

    def emit() -> pa.RecordBatch:
        pairs = links(sets) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([marks[k] for k in c], pa.int64()) for c in (list(zip(*pairs, strict=True)) or [[], []])], ["u", "v"])

    for batch in batches:
        for root, a, b, own, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (root, a, b) != key:
                if marks:
                    yield emit()
                key, marks, sets = (root, a, b), [], []
            if not marks or marks[-1] != own:
                marks.append(own)
                sets.append(shingles(text))
    if marks:
        yield emit()


def groups(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) -> (mark, low, root): a row for each distinct text.

    ``mark`` is the hash of the text, ``low`` its least doc_id, and ``root`` the least mark reachable
    over links of similarity ``SIMILARITY`` or more.
    """
    texts = cut(_distinct_texts(docs))
    ties = _band_ties(texts).unionByName(_simhash_ties(texts))
    near = connected_components(ties).withColumnRenamed("node", "mark")
    near = cut(texts.select("mark", "low", "size").join(near, "mark"))
    parts = cut(near.groupBy("root").agg(F.ceil(F.greatest(F.sum("size"), F.lit(1)) / VOLUME).cast("int").alias("parts"), F.count("*").alias("n")))
    near = hot_join(near, parts, ["root"], near.count(), spread=("mark",)).select("root", "parts", "low", F.col("mark").alias("hash"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), mark().alias("mark"), "text")
    rows = rows.join(near, (F.col("mark") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("low")))
    part = F.pmod(F.xxhash64("mark"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("a"), F.greatest(part, j).alias("b")))
    dealt = rows.select("root", F.explode(pairs).alias("p"), "mark", "text").select("root", "p.a", "p.b", "mark", "text")
    dealt = dealt.repartition("root", "a", "b").sortWithinPartitions("root", "a", "b", "mark")
    nodes = connected_components(dealt.mapInArrow(_verified, "u long, v long")).withColumnRenamed("node", "mark")
    return texts.select("mark", "low").join(nodes, "mark", "left").select("mark", "low", F.coalesce("root", "mark").alias("root"))
