"""Language ID: interpolated Kneser-Ney character models in sorted hash arrays.

One model per language over symbols (letters, lower-cased; every run of other characters is one
blank). All n-grams that any language has seen stand in one sorted array of hashes per order, with
the finished interpolated log probability of each language beside it, so scoring a text is one
binary search a character, and a shorter one where the n-gram is new. The language with the lowest
cross-entropy per symbol wins. Part of the training rows is held back to calibrate rejection:
a text is rejected when its cross-entropy lies far outside what its length allows.

Training takes a bounded, documented sample of each language: at most ``PER_LANGUAGE`` of its distinct
labelled texts, those of the lowest hashes, and of each at most ``MAX_CHARS`` characters, from a place
that its hash names. So a rare language, one of long texts only and one with a large group of copies
are all learned. Prediction reads every whole text.

Defined results: null texts and texts without any letter give ``und``, score 0 and are rejected;
of languages with equal cross-entropy the first by name wins; repeated rows get equal results; an
empty table gives an empty result; where no row has a label, every text is ``und``; letters beyond the
``MOST`` most frequent of the sample, and letters not in it, are one symbol; other columns are kept,
and those of the names that are added are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDER = 4
#: Bounds of the training sample: texts of a language, and characters of a text.
PER_LANGUAGE, MAX_CHARS = 400, 8192
#: Symbols 1 to MOST are letters seen in training; OTHER is any other letter; 0 is the blank.
MOST, OTHER, BITS = 65_533, 65_534, 16
#: Whole texts are scored in pieces of so many characters, which bounds memory.
PIECE = 1 << 19
#: Rejection: standard deviations above the mean cross-entropy, beyond the worst held-back row.
SLACK = 3.0


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Model:
    langs: list[str]
    alphabet: np.ndarray
    #: For each order from 1: sorted hashes, and log probabilities (one row an n-gram).
    grams: list[tuple[np.ndarray, np.ndarray]]
    #: For each order from 1: sorted hashes of the contexts, and log back-off weights.
    contexts: list[tuple[np.ndarray, np.ndarray]]
    unseen: float
    #: For each language: mean cross-entropy, and its variance between rows and between symbols.
    calm: np.ndarray | None = None

    def table(self) -> np.ndarray:
        """Code point to symbol."""
        if not hasattr(self, "_table"):
            self._table = np.where(_letters(), OTHER, 0).astype(np.uint16)
            self._table[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return self._table

    def symbols(self, text: str) -> np.ndarray:
        s = self.table()[_codes(text)]
        return s[np.r_[True, (s[1:] != 0) | (s[:-1] != 0)]] if len(s) else s

    def log_probs(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Log probability of the last symbol of each ``order``-gram, by language."""
        if not order:
            return np.full((len(keys), len(self.langs)), self.unseen, np.float32)
        hashes, logs = self.grams[order - 1]
        at, found = _find(hashes, hashed(keys & np.uint64((1 << BITS * order) - 1), order))
        out = logs[at]
        if not found.all():
            new = keys[~found]
            contexts, weights = self.contexts[order - 1]
            at, known = _find(contexts, hashed(new >> np.uint64(BITS) & np.uint64((1 << BITS * (order - 1)) - 1), order - 1))
            out[~found] = self.log_probs(new, order - 1) + np.where(known[:, None], weights[at], np.float32(0))
        return out

    def score(self, text: str) -> tuple[np.ndarray, int, int]:
        """Summed negative log probability by language, symbols scored, letters among them."""
        total, n, letters, past = np.zeros(len(self.langs)), 0, 0, np.zeros(ORDER - 1, np.uint16)
        for at in range(0, len(text), PIECE):
            s = self.symbols(text[at : at + PIECE])
            s = s[1:] if len(s) and not s[0] and not past[-1] else s
            line = np.r_[past, s]
            total -= self.log_probs(packed(line)).sum(axis=0, dtype=np.float64)
            n, letters, past = n + len(s), letters + int(np.count_nonzero(s)), line[len(line) - ORDER + 1 :]
        return total, n, letters

    def limits(self, n: int) -> np.ndarray:
        """The highest cross-entropy accepted for ``n`` symbols, by language."""
        mean, between, within, z = self.calm.T
        return mean + z * np.sqrt(between + within / n)

    def predict(self, text: str | None) -> tuple[str, float, float | None, bool]:
        """Language, score (0 to 1), cross-entropy in nats a symbol, rejected."""
        total, n, letters = self.score(text or "") if self.langs else (None, 0, 0)
        if not letters:
            return "und", 0.0, None, True
        best = int(np.argmin(total))
        # the posterior of at most 100 symbols' worth of evidence, as neighbouring symbols repeat each other
        share = float(1 / np.exp(-(total - total[best]) * min(1.0, 100 / n)).sum())
        loss = float(total[best] / n)
        return self.langs[best], share, loss, bool(loss > self.limits(n)[best])


def packed(line: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Every ``order``-gram of ``line`` as one number, the last symbol lowest."""
    n = max(0, len(line) - order + 1)
    keys = np.zeros(n, np.uint64)
    for k in range(order):
        keys = keys << np.uint64(BITS) | line[k : k + n].astype(np.uint64)
    return keys


def hashed(keys: np.ndarray, order: int) -> np.ndarray:
    """A mixing of keys of one order that has no collisions: odd factors and shifts invert."""
    with np.errstate(over="ignore"):
        keys = (keys + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
        return keys ^ keys >> np.uint64(29)


def _find(sorted_hashes: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_hashes, wanted), len(sorted_hashes) - 1)
    return at, sorted_hashes[at] == wanted


def _kneser_ney(texts: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order from 1: distinct n-grams and their counts; lower orders count distinct predecessors."""
    top = [np.r_[np.zeros(ORDER - 1, np.uint16), s] for s in texts]
    keys, counts = np.unique(np.concatenate([packed(s) for s in top] or [np.empty(0, np.uint64)]), return_counts=True)
    found = [(keys, counts)]
    for order in range(ORDER - 1, 0, -1):
        keys, counts = np.unique(found[0][0] & np.uint64((1 << BITS * order) - 1), return_counts=True)
        found.insert(0, (keys, counts))
    return found


def train(rows: list[tuple[str, str]]) -> Model:
    """``rows`` (text, language) -> model; every third row of a language calibrates and isn't counted."""
    rows = sorted((lang, text) for text, lang in rows)
    langs = sorted({lang for lang, _ in rows})
    letters = np.bincount(np.concatenate([_codes(t) for _, t in rows] or [np.empty(0, np.int64)]), minlength=1)
    known = np.flatnonzero(letters)
    known = known[[chr(c).isalpha() for c in known.tolist()]] if len(known) else known
    alphabet = np.sort(known[np.argsort(-letters[known], kind="stable")][:MOST])
    model = Model(langs, alphabet, [], [], -math.log(len(alphabet) + 2))
    if not langs:
        return model
    fit = {lang: [] for lang in langs}
    held: dict[str, list[str]] = {lang: [] for lang in langs}
    for lang, text in rows:
        if (len(fit[lang]) + len(held[lang])) % 3 == 2:
            held[lang].append(text)
        else:
            fit[lang].append(model.symbols(text))
    counts = [_kneser_ney(fit[lang]) for lang in langs]
    for order in range(1, ORDER + 1):
        grams = np.unique(np.concatenate([c[order - 1][0] for c in counts]))
        heads = grams >> np.uint64(BITS)
        contexts, inverse = np.unique(heads, return_inverse=True)
        lower = np.exp(model.log_probs(grams, order - 1).astype(np.float64))
        probs, weights = np.empty((len(grams), len(langs))), np.empty((len(contexts), len(langs)))
        for k, found in enumerate(counts):
            keys, n = found[order - 1]
            count = np.zeros(len(grams))
            count[np.searchsorted(grams, keys)] = n
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.5
            mass, kinds = np.bincount(inverse, count, len(contexts)), np.bincount(inverse, count > 0, len(contexts))
            weight = np.where(mass > 0, discount * kinds / np.maximum(mass, 1), 1.0)
            probs[:, k] = np.maximum(count - discount, 0) / np.maximum(mass, 1)[inverse] + weight[inverse] * lower[:, k]
            weights[:, k] = weight
        for store, keys, values, n in ((model.grams, grams, probs, order), (model.contexts, contexts, weights, order - 1)):
            h = hashed(keys, n)
            by = np.argsort(h)
            store.append((h[by], np.log(np.maximum(values[by], 1e-30)).astype(np.float32)))
    model.calm = np.array([_calm(model, k, held[lang] or [t for l, t in rows if l == lang]) for k, lang in enumerate(langs)])
    return model


def _calm(model: Model, k: int, texts: list[str]) -> tuple[float, float, float, float]:
    got = [(total[k] / n, n) for total, n, letters in map(model.score, texts) if letters]
    if not got:
        return 0.0, 1e6, 1e6, 1.0
    loss, n = np.array(got).T
    mean = float(np.average(loss, weights=n))
    between = float(np.average((loss - mean) ** 2, weights=n)) + 1e-4
    within = float(np.mean(np.maximum((loss - mean) ** 2 - between, 0) * n)) + 1.0
    return mean, between, within, float(np.max((loss - mean) / np.sqrt(between + within / n))) + SLACK


def training_rows(docs: DataFrame, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> list[tuple[str, str]]:
    """A bounded sample of labelled texts (text, language), the same on every run."""
    mixed, size = F.pmod(F.xxhash64("text"), F.lit(1 << 30)), F.length("text")
    part = F.substr("text", 1 + F.pmod(F.xxhash64(F.lit(1), "text"), F.greatest(size - max_chars + 1, F.lit(1))).cast("int"), F.lit(max_chars))
    able = docs.where("text is not null and lang is not null").where(size > 0).select(F.col("lang").cast("string").alias("lang"), mixed.alias("mixed"), part.alias("part"))
    sizes = {r["lang"]: r["n"] for r in able.groupBy("lang").agg(F.approx_count_distinct("mixed").alias("n")).collect()}  # a row a language
    if not sizes:
        return []
    # twice as many as wanted pass, as the numbers are estimates; the window sees those alone
    limits = [(lang, min(1 << 30, int(2 * per_language / max(n, 1) * (1 << 30)))) for lang, n in sizes.items()]
    limit = F.create_map(*[F.lit(x) for pair in limits for x in pair])[F.col("lang")]
    some = able.where(F.col("mixed") < limit).groupBy("lang", "mixed").agg(F.min("part").alias("part"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("mixed"))
    got = some.withColumn("nth", nth).where(F.col("nth") <= per_language).collect()  # at most per_language rows a language
    return [(r["part"], r["lang"]) for r in got]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score, cross_entropy and rejected; columns of those names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most some tables of bounded alphabets and samples

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            got = [model.predict(t.as_py()) for t in batch.column("text")]
            new = list(zip(*got, strict=True)) if got else [[]] * 4
            added = [pa.array(new[0], pa.string()), pa.array(new[1], pa.float64()), pa.array(new[2], pa.float64()), pa.array(new[3], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *ADDED])

    kept = docs.drop(*ADDED)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{fields}, lang_pred string, score double, cross_entropy double, rejected boolean")


ADDED = ("lang_pred", "score", "cross_entropy", "rejected")


def held_out() -> F.Column:
    """Rows that no model learns from: crc32 of doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
