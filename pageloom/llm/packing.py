"""Packing token sequences: Martello-Toth dominance reduction, then best fit decreasing.

Lengths are whole numbers up to the capacity, so an instance is a histogram of at most ``size``
classes however many documents there are. The driver packs that histogram: sets of up to three
pieces that provably dominate all others with their longest piece are fixed (with their
multiplicity), and the rest is packed by best fit in falling length. What comes out is a list of
patterns and how often each is used; its size depends on the capacity alone. Pieces then take
their places by their rank among the pieces of the same length. Ranks come from salted groups with
running totals, so one length that a third of all pieces share is never gathered in a task.

Defined results: null and empty texts hold the end token alone; a text of more than ``size``
tokens is cut into full pieces and a rest; repeated rows are packed each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import cut

SIZE = 2048
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Rows tokenized at once.
SLICE = 1024
#: About so many pieces share a group in which ranks are counted.
GROUP = 512

#: Letters and numbers up to U+024F, but for U+0130, which ends in a combining dot when lower-cased.
_LETTERS = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L" and len(c.lower()) == 1)
_NUMBERS = "".join(c for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N")
#: A text of these alone is lower-cased and split as it is: none combines, and its blanks are a space, tab and line
#: ends. It must not hold OPEN, which starts special tokens.
_PLAIN = re.compile("[\x00-\x0a\x0d-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]*")
#: The model's pieces of a plain word.
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}]+")
OPEN = "<|"
#: A sign right before a full stop or comma, which then may end a longer piece.
_SIGNS = re.compile(f"[^{_LETTERS}{_NUMBERS}\\s][.,]")


class WordTokens(dict):
    """Ids of texts as little-endian 32-bit words, by a word-level BPE that drops white space.

    No token crosses a blank, so ids of words are kept and joined; texts are taken in blocks of about
    CHARS characters, whose words are looked up once each. An unknown plain word is cut into the
    pieces of the tokenizer's pattern, and each piece goes to the model directly, its bytes written as
    the model's characters. Unknown other words of a block are tokenized together in lines, with a mark
    between words whose one id shows where each ends. At most about ``most`` short words are kept: when
    half as many are, they become the old ones, of which those that come up again are kept on. Words
    over LONG characters are tokenized anew.
    """

    MARK, LONG, LINE, STEP, CHARS = "~", 64, 512, 1 << 14, 1 << 20

    def __init__(self, path: str, most: int = 300_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.old = Tokenizer.from_file(path), most, {}
        self.model, self.mark = self.tokenizer.model, self._ids(self.MARK)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from U+0100
        hidden = [b for b in range(256) if b not in shown]
        name = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.written = {c: "".join(name[b] for b in chr(c).encode()) for c in range(0x250)}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            low = word.lower()
            if low.isalpha() and _PLAIN.fullmatch(low):
                ids = self._piece(low if low.isascii() else low.translate(self.written))
            elif not _PLAIN.fullmatch(low) or OPEN in low:
                ids = self._ids(word).tobytes()
            else:
                pieces = _PIECE.findall(low)
                ids = b"".join([self[p] for p in pieces]) if len(pieces) > 1 else self._piece(low.translate(self.written))
        if len(word) <= self.LONG:
            self[word] = ids
        return ids

    def _learn(self, words: list[str]) -> None:
        """Words that aren't plain, many at once."""
        some = [w for w in words if w not in self and w not in self.old and len(w) <= self.LONG and self.MARK not in w and not _PLAIN.fullmatch(w.lower())]
        for at in range(0, len(some), self.LINE):
            line = some[at : at + self.LINE]
            ids = self._ids(f" {self.MARK} ".join(line))
            cuts = [-1, *np.flatnonzero(ids == self.mark[0]).tolist(), len(ids)]
            raw = ids.tobytes()
            self.update((w, raw[4 * (i + 1) : 4 * j]) for w, i, j in zip(line, cuts, cuts[1:], strict=False))

    def _block(self, texts: list[str], plain: bool) -> Iterator[bytes]:
        """Ids of texts whose words are looked up once each."""
        lines = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        words = lines.flatten().dictionary_encode()
        each = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        if not plain:
            self._learn(each)
        ids = []
        for at in range(0, len(each), self.STEP):
            ids += [self[w] for w in each[at : at + self.STEP]]
            if len(self) > self.most // 2:
                self.old = dict(self)
                self.clear()
        sizes = np.fromiter(map(len, ids), "i4", len(ids)) // 4
        rows = words.indices.to_numpy()
        each = sizes[rows]
        ends = np.cumsum(each, dtype="i4")
        first = (np.cumsum(sizes, dtype="i4") - sizes)[rows] - (ends - each)  # a word's place less that of its use
        at = np.repeat(first, each)
        at += np.arange(len(at), dtype="i4")
        raw = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        cuts = np.concatenate([[0], ends])[lines.offsets.to_numpy()].tolist()
        yield from (raw[4 * i : 4 * j] for i, j in itertools.pairwise(cuts))

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        block, chars, plain = [], 0, True
        for t in texts:
            if _PLAIN.fullmatch(t) and OPEN not in t:
                t = t.lower()
                if not _SIGNS.search(t):
                    t = t.replace(". ", " . ").replace(", ", " , ").replace(".\n", " . ")
            else:
                plain = False
            block.append(t)
            chars += len(t)
            if chars > self.CHARS:
                yield from self._block(block, plain)
                block, chars, plain = [], 0, True
        yield from self._block(block, plain)


_WORKER: dict[str, WordTokens] = {}


def _worker(path: str) -> WordTokens:
    if path not in _WORKER:
        _WORKER[path] = WordTokens(path)
    return _WORKER[path]


def pieces(docs: DataFrame, path: str = TOKENIZER, size: int = SIZE) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, piece, start, length, ids_crc32), one row a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _worker(path)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, max(1, len(whole)), SLICE)):
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), words.ids(texts), strict=True):
                ids += b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at : at + 4 * size]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        words.clear()  # the worker goes on to other stages
        words.old = {}

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


Pattern = list[tuple[int, int]]


def dominated(counts: dict[int, int], size: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Fixed patterns with multiplicities, and the counts that remain.

    For the longest piece j, in falling length: alone if nothing fits beside it; with the longest
    fitting piece if that fills the sequence, or if no two pieces fit beside j, or if it is at least
    as long as any two that do; with the best two if no three fit, they fill the sequence, and the
    longer is the longest that fits. Each removes nothing that a better packing would need.
    """
    left, fixed = {w: n for w, n in counts.items() if n}, []

    def lengths(without: int) -> list[int]:
        return sorted(w for w, n in left.items() if n - (w == without) > 0)

    def smallest(without: int, k: int) -> list[int]:
        out: list[int] = []
        for w in lengths(without):
            out += [w] * min(k - len(out), left[w] - (w == without))
            if len(out) >= k:
                break
        return out

    for j in sorted(left, reverse=True):
        while left.get(j, 0):
            room, small = size - j, smallest(j, 3)
            fitting = [w for w in lengths(j) if w <= room]
            if not fitting:
                choice = [j]
            else:
                most = fitting[-1]
                two_fit = len(small) > 1 and small[0] + small[1] <= room
                three_fit = len(small) > 2 and sum(small) <= room
                choice = [j, most] if most == room or not two_fit else []
                if not choice and not three_fit:
                    pairs = []
                    for a in fitting:
                        only = left[a] - (a == j) == 1
                        b = _largest(fitting, min(room - a, a - only))
                        pairs += [(a + b, a, b)] if b else []
                    best = max(pairs, default=(0, 0, 0))
                    if most >= best[0]:
                        choice = [j, most]
                    elif best[0] == room and best[1] == most:
                        choice = [j, best[1], best[2]]
            if not choice:
                break
            need = {w: choice.count(w) for w in choice}
            times = min(left[w] // n for w, n in need.items())
            for w, n in need.items():
                left[w] -= times * n
                if not left[w]:
                    del left[w]
            fixed.append((sorted(need.items(), reverse=True), times))
    return fixed, left


def _largest(values: list[int], most: int) -> int:
    at = bisect_left(values, most + 1)
    return values[at - 1] if at else 0


def best_fit(counts: dict[int, int], size: int) -> list[tuple[Pattern, int]]:
    """Best fit in falling length, over classes: a group of equal bins is filled at once."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[Pattern, int]]] = {}

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((pattern, times))

    for w in sorted(counts, reverse=True):
        n = counts[w]
        while n:
            at = bisect_left(rooms, w)
            if at == len(rooms):
                room, pattern, times = size, [], -(-n // (size // w))
            else:
                room = rooms[at]
                pattern, times = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            each = room // w
            full = min(times, n // each)
            if full:
                put(room - full // full * each * w, [*pattern, (w, each)], full)
                n -= full * each
            rest = times - full
            if rest and n:  # fewer than fill one bin
                put(room - n * w, [*pattern, (w, n)], 1)
                n, rest = 0, rest - 1
            if rest:
                put(room, pattern, rest)
    return [g for room in rooms for g in groups[room]]


def pack(counts: dict[int, int], size: int = SIZE) -> list[tuple[Pattern, int]]:
    """A histogram of lengths -> patterns [(length, copies), ...] with multiplicities."""
    fixed, left = dominated(counts, size)
    return fixed + best_fit(left, size)


def _places(patterns: list[tuple[Pattern, int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies a sequence, first sequence, offset) of every pattern's entries."""
    out, used, sequence = [], {}, 0
    for pattern, times in patterns:
        offset = 0
        for w, copies in pattern:
            out.append((w, used.get(w, 0), copies, sequence, offset))
            used[w] = used.get(w, 0) + copies * times
            offset += w * copies
        sequence += times
    return out


def packed(docs: DataFrame, path: str = TOKENIZER, size: int = SIZE) -> DataFrame:
    """``docs`` (doc_id, text) -> pieces with sequence_id and offset, gapless in each sequence."""
    spark = docs.sparkSession
    rows = cut(pieces(docs, path, size))
    salts = max(16, min(1 << 16, rows.count() // GROUP))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    sizes = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    starts = sizes.select("length", "salt", before.alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.row_number().over(order) - 1)
    entries = spark.createDataFrame(_places(pack(counts, size)) or [(0, 0, 1, 0, 0)], "length long, first long, copies long, sequence long, base long")
    entries = entries.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "copies", "sequence", "base"))).alias("places"))
    place = F.element_at(F.filter("places", lambda p: p["first"] <= F.col("rank")), -1)
    # the entries follow from the capacity, at most a few thousand whatever the input
    at = ranked.join(F.broadcast(entries), "length").withColumn("place", place).withColumn("nth", F.col("rank") - F.col("place.first"))
    return at.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("place.sequence") + F.expr("nth div place.copies")).alias("sequence_id"),
        (F.col("place.base") + F.col("length") * (F.col("nth") % F.col("place.copies"))).alias("offset"),
    )
