"""SentencePiece encoding and decoding by suffix-array matching and relaxation.

Text is escaped as the model does (blank to U+2581, one in front) and cut where a word begins and
between letters and other characters; no piece has that mark after another character or holds both
letters and others, so the parts encode independently. The distinct words of each batch are
concatenated and indexed by a suffix array to the depth of the longest piece; every piece of the
vocabulary is looked up by binary search, its range of suffixes gives its occurrences, and all
occurrences are edges, sorted by where in their word they end. Relaxing them in that order, all words
at once, gives each position the last piece of its prefix's encoding. Nothing is carried over from
batch to batch but the fate of pairs of pieces (at most ``PAIRS`` of them).

The model is a byte-pair encoding, so a path of least cost would be wrong: the relaxation admits an
edge only if the two neighbouring pieces, encoded together by the merge rule, stay apart. Whether they
do follows from the trees of their merges: undone from the last merge back, the nodes that meet at the
boundary must never form a piece of a better score than what the merge rule did next. As merges
inside a prefix don't depend on what follows, exactly one edge is admitted at a position, and the
result is the encoding of the model itself. Characters without a piece become byte pieces.

Defined results: null texts count as empty; empty texts have no ids and decode to empty; U+2581 in
a text decodes to a blank, as in the model; repeated rows get equal results; words of any length
are indexed in bounded chunks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
_LETTER = re.compile(r"[^\W\d_]")
#: Characters of a batch of texts, and of words indexed at once; a longer text or word is taken alone.
BATCH, CHUNK = 1 << 22, 1 << 19
#: Places for pairs of pieces whose fate is kept; a pair takes the place of another of the same hash.
PAIRS = 1 << 20
NONE, START, BYTES = -3, -1, -2


class Vocabulary:
    """Pieces of a model file, the trees of their merges, and tables by which they are looked up."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.piece = {i: model.id_to_piece(i) for i in normal}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: model.get_score(i) for i, p in self.piece.items()}
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.longest = max(map(len, self.id))
        self.letters = set("".join(self.id))
        if any(c not in self.id for c in self.letters) or any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("pieces of letters that are no pieces, or with a mark inside, can't be matched word by word")
        self.word = self._cuts({(a, b) for p in self.id for a, b in zip(p, p[1:], strict=False) if a != MARK})
        self.raw = [b""] * n
        for i, p in self.piece.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in self.byte.items():
            self.raw[i] = bytes([b])
        self.size = np.ones(n, np.int64)
        self.size[normal] = [len(self.piece[i]) for i in normal]
        self._grow(n)
        self.seen, self.fate = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        common = Counter(c for p in self.id for c in set(p))
        common = sorted(common, key=lambda c: (not c.isascii(), -common[c], c))[:255]
        self.narrow, self.rare = Patterns(self, sorted(common), 8), self.letters.difference(common)
        self.wide = Patterns(self, sorted(self.letters), 16) if len(self.letters) > 255 else self.narrow

    def _cuts(self, pairs: set[tuple[str, str]]) -> re.Pattern:
        """A pattern of runs of letters and runs of others, each with the marks before it; no piece may hold both."""
        signs = "".join(sorted(c for c in self.letters if _LETTER.match(c) and not c.isalpha()))  # such as raised digits
        letter = lambda c: bool(_LETTER.match(c)) and c not in signs
        if any(letter(a) != letter(b) for a, b in pairs):
            raise ValueError("pieces that hold both letters and other characters can't be matched word by word")
        return re.compile(rf"{MARK}*[^\W\d_{signs}]+|{MARK}*(?:[^\w{MARK}]|[\d_{signs}])+|{MARK}+")

    def merged(self, text: str) -> tuple[list[str], list[tuple[str, str]]]:
        """The merge rule, literally: join the neighbours of the best score, the leftmost on ties, until none joins.

        Returns the parts and the merges in their order.
        """
        parts, merges = list(text), []
        while True:
            best = max(((self.score[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id), default=None)
            if best is None:
                return parts, merges
            k = -best[1]
            merges.append((parts[k], parts[k + 1]))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    def _grow(self, n: int) -> None:
        """Trees: the two parts of each piece's last merge and its score; and which two pieces make which."""
        self.born, self.left, self.right = np.full(n, np.inf), np.full(n, -1), np.full(n, -1)
        self.own: list[int] = []
        joins = []
        for p, i in self.id.items():
            parts, merges = self.merged(p)
            if parts != [p]:
                continue  # never the result of an encoding
            self.own.append(i)
            scores = [self.score[a + b] for a, b in merges]
            if scores != sorted(scores, reverse=True):
                raise ValueError("merges that don't fall in score can't be undone one by one")
            if merges:
                self.born[i], self.left[i], self.right[i] = scores[-1], self.id[merges[-1][0]], self.id[merges[-1][1]]
            joins += [(self.id[p[:k]] << 32 | self.id[p[k:]], self.score[p]) for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id]
        joins.sort()
        self.join_key, self.join_score = np.array([k for k, _ in joins], np.int64), np.array([s for _, s in joins])

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the merge rule keeps each pair of pieces apart."""
        key = left << 32 | right
        place = (key ^ key >> 29) * 0x9E3779B1 >> 7 & PAIRS - 1
        ok = self.fate[place]
        new = np.flatnonzero(self.seen[place] != key)
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            ok[new] = fate = self._apart(some >> 32, some & 0xFFFFFFFF)[back]
            self.seen[place[new]] = key[new]
            self.fate[place[new]] = fate
            clash = self.seen[place[new]] != key[new]  # two new pairs in one place: the last stays, with its own fate
            if clash.any():
                self.fate[place[new[~clash]]] = fate[~clash]
        return ok

    def _apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out, todo = np.ones(len(left), bool), np.arange(len(left))
        ends_left, ends_right = np.full(len(left), -np.inf), np.full(len(left), -np.inf)
        while len(todo):
            key = left << 32 | right
            at = np.minimum(np.searchsorted(self.join_key, key), len(self.join_key) - 1)
            score = np.where(self.join_key[at] == key, self.join_score[at], -np.inf)
            # among equal scores the leftmost merges: inside the left piece, then across, then inside the right
            joined = (score > ends_left) & (score >= ends_right) & (self.join_key[at] == key)
            out[todo[joined]] = False
            a, b = self.born[left], self.born[right]
            on = ~joined & np.isfinite(np.minimum(a, b))
            back = b <= a  # the right piece's merge is the later one
            ends_right, ends_left = np.where(back, b, ends_right)[on], np.where(back, ends_left, a)[on]
            left, right, todo = np.where(back, left, self.right[left])[on], np.where(back, self.left[right], right)[on], todo[on]
        return out


class Patterns:
    """The pieces of some letters, as numbers of ``bits`` a character, and the keys between which their suffixes lie."""

    def __init__(self, vocab: Vocabulary, letters: list[str], bits: int):
        self.bits, self.per = bits, 64 // bits
        self.code = np.zeros(0x110000, np.uint16)
        self.code[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        known = set(letters)
        named = sorted((p, vocab.id[p]) for p in map(vocab.piece.__getitem__, vocab.own) if known.issuperset(p))
        self.ids = np.array([i for _, i in named], np.int64)
        self.sizes = np.array([len(p) for p, _ in named], np.int64)
        self.longest = int(self.sizes.max())
        codes = [self.code[[ord(c) for c in p]].tolist() for p, _ in named]
        self.bounds = [tuple(np.array(b, np.uint64) for b in zip(*(self._bounds(p[at : at + self.per]) for p in codes), strict=True)) for at in range(0, self.longest, self.per)]

    def _bounds(self, codes: list[int]) -> tuple[int, int]:
        """The least and the greatest key that start with ``codes``."""
        low = 0
        for c in codes:
            low = low << self.bits | c
        free = self.bits * (self.per - len(codes))
        return low << free, (low << free) | ((1 << free) - 1)


class SuffixIndex:
    """Suffixes of ``codes`` (0: separator), sorted by their first ``depth`` characters.

    Those that end within the first key need no more than that key to be sorted.
    """

    def __init__(self, codes: np.ndarray, depth: int, bits: int):
        self.per = 64 // bits
        steps = -(-depth // self.per)
        key, width = np.r_[codes, np.zeros(steps * self.per, codes.dtype)].astype(np.uint64), 1
        tail = key[self.per - 1 : self.per - 1 + len(codes)]
        while width < self.per:  # a key of twice as many characters from two neighbouring ones
            key = key << np.uint64(bits * width) | np.r_[key[width:], np.zeros(width, np.uint64)]
            width *= 2
        self.keys = [key[k * self.per : k * self.per + len(codes)] for k in range(steps)]
        self.order = np.argsort(self.keys[0])
        long = np.flatnonzero(tail[self.order])
        some = self.order[long]
        self.order[long] = some[np.lexsort([k[some] for k in self.keys[::-1]])]
        self.keys = [k[self.order] for k in self.keys]

    def ranges(self, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the range of sorted suffixes that start with it, by binary search."""
        lows = np.searchsorted(self.keys[0], patterns.bounds[0][0], "left")
        highs = np.searchsorted(self.keys[0], patterns.bounds[0][1], "right")
        for k in range(1, len(self.keys)):
            for i in np.flatnonzero((lows < highs) & (patterns.sizes > k * self.per)).tolist():
                part, lo = self.keys[k][lows[i] : highs[i]], lows[i]
                lows[i], highs[i] = lo + np.searchsorted(part, patterns.bounds[k][0][i], "left"), lo + np.searchsorted(part, patterns.bounds[k][1][i], "right")
        return lows, highs


def _edges(codes: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """(start, pattern) of every occurrence of every piece."""
    index = SuffixIndex(codes, patterns.longest, patterns.bits)
    lows, highs = index.ranges(patterns)
    counts = np.maximum(highs - lows, 0)
    which = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(which)) + np.repeat(lows - np.r_[0, np.cumsum(counts)[:-1]], counts)
    return index.order[at], which


def encode_words(vocab: Vocabulary, words: list[str], patterns: Patterns) -> list[bytes]:
    """Ids of each word (non-empty, escaped, of the patterns' letters or of none): index, match, sort edges, relax."""
    text = "\0".join(words) + "\0"
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    first = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    codes = patterns.code[points]
    starts, which = _edges(codes, patterns)
    names, lengths = patterns.ids[which], patterns.sizes[which]
    bare = codes == 0  # characters without a piece
    bare[first + sizes] = False
    if bare.any():
        bare = np.flatnonzero(bare)
        starts, names, lengths = np.r_[starts, bare], np.r_[names, np.full(len(bare), BYTES)], np.r_[lengths, np.ones(len(bare), np.int64)]
    ends = starts + lengths
    place = ends - np.repeat(first, sizes + 1)[starts]  # in the word
    by = np.argsort(place.astype(np.uint16) if sizes.max(initial=0) < 1 << 16 else place, kind="stable")
    starts, names, ends = starts[by], names[by], ends[by]
    cuts = np.r_[0, np.cumsum(np.bincount(place))]
    last = np.full(len(points) + 1, NONE, np.int64)
    last[first] = START
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if a == b:
            continue
        left, name, end = last[starts[a:b]], names[a:b], ends[a:b]
        ok = left != NONE
        both = np.flatnonzero((left >= 0) & (name >= 0))
        ok[both] = vocab.apart(left[both], name[both])
        last[end[ok]] = name[ok]
    return _walked(vocab, points, first, sizes, last)


def _walked(vocab: Vocabulary, points: np.ndarray, first: np.ndarray, sizes: np.ndarray, last: np.ndarray) -> list[bytes]:
    """Ids of all words from the last pieces of their prefixes, walked back from their ends at once."""
    at, live, owners, found = first + sizes, np.arange(len(first)), [], []
    while len(live):
        name = last[at]
        odd = np.flatnonzero(name == BYTES)
        if len(odd):
            raw = [chr(c).encode("utf-8", "surrogatepass")[::-1] for c in points[at[odd] - 1].tolist()]
            many = np.ones(len(live), np.int64)
            many[odd] = [len(r) for r in raw]
            ids = np.repeat(name, many)
            ids[ids == BYTES] = [vocab.byte[b] for r in raw for b in r]
            owners.append(np.repeat(live, many))
            found.append(ids)
        else:
            owners.append(live)
            found.append(name)
        at = at - np.where(name == BYTES, 1, vocab.size[name])
        on = at > first[live]
        at, live = at[on], live[on]
    if not found:
        return []
    # each word's ids were found from its last to its first, so the order of finding is turned round
    owner, ids = np.concatenate(owners)[::-1], np.concatenate(found)[::-1]
    raw = ids[np.argsort(owner, kind="stable")].astype("<i4").tobytes()
    ends = (4 * np.cumsum(np.bincount(owner, minlength=len(first)))).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Encoder:
    """Ids of texts, batch by batch; the words of a batch are merged, and each batch is matched anew."""

    def __init__(self, path: str):
        self.vocab = Vocabulary(path)

    def _ids(self, words: set[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        plain, rest = [], []
        for w in words:
            (plain if w.isascii() or self.vocab.rare.isdisjoint(w) else rest).append(w)
        for group, patterns in ((plain, self.vocab.narrow), (rest, self.vocab.wide)):
            some, size = [], 0
            for w in [*group, None]:
                if some and (w is None or size + len(w) > CHUNK):
                    out.update(zip(some, encode_words(self.vocab, some, patterns), strict=True))
                    some, size = [], 0
                if w is not None:
                    some.append(w)
                    size += len(w) + 1
        return out

    def encode(self, texts: list[str], batch: int = BATCH) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit numbers."""
        some, size = [], 0
        for t in [*texts, None]:
            if t is None or (some and size + len(t) > batch):
                lines = [self.vocab.word.findall(MARK + x.replace(" ", MARK)) if x else [] for x in some]
                ids = self._ids(set().union(*lines))
                yield from [b"".join([ids[w] for w in line]) for line in lines]
                some, size = [], 0
            if t is not None:
                some.append(t)
                size += len(t)

    def decode(self, ids: list[int]) -> str:
        raw = self.vocab.raw
        text = b"".join([raw[i] if 0 <= i < len(raw) else b"" for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_WORKER: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def encode(docs: DataFrame, path: str = MODEL, rows: int = 4096) -> DataFrame:
    """``docs`` (doc_id, text) -> (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for whole in batches:
            for at in range(0, max(1, len(whole)), rows):
                batch = whole.slice(at, rows)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                raw = list(encoder.encode(texts))
                flat = pa.array(np.frombuffer(b"".join(raw), "<i4"))
                ends = np.r_[0, np.cumsum([len(r) // 4 for r in raw], dtype=np.int64)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """``rows`` with ids -> the same with text; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            texts = [None if i.as_py() is None else encoder.decode(i.as_py()) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "text"])

    kept = rows.drop("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, text string")


def digest(docs: DataFrame, path: str = MODEL, rows: int = 4096) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, decoded_sha256, round_trip): ids little-endian for the checksum; decoded from the ids.

    Encodes and decodes in one worker, so that ids don't travel.
    """
    names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256", "round_trip"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in (whole.slice(at, rows) for whole in batches for at in range(0, max(1, len(whole)), rows)):
            texts, out = [t or "" for t in batch.column(1).to_pylist()], []
            for doc_id, text, raw in zip(batch.column(0).to_pylist(), texts, encoder.encode(texts), strict=True):
                back = encoder.decode(np.frombuffer(raw, "<i4").tolist())
                out.append((doc_id, len(raw) // 4, zlib.crc32(raw), hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest(), back == text))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string, round_trip boolean")
