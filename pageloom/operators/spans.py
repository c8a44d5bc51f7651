"""Spans of text in Arrow batches: characters to text with blanks at wide gaps, runs of equal style to one span, spans to items.

A batch is worked on as columns; nothing is done row by row but a full stop between digits.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def spaced_text(chars: pa.Array, gap: pa.Array, text: pa.Array, closers: list[str], openers: list[str]) -> pa.Array:
    """Text of characters list<struct<c, x0, x1>> with a blank where one begins more than ``gap`` after the last known end, but not before ``closers`` or after ``openers``."""
    flat, counts = chars.flatten(), pc.fill_null(pc.list_value_length(chars), 0).to_numpy(zero_copy_only=False)
    c, row = pc.struct_field(flat, 0), np.repeat(np.arange(len(chars)), counts)
    known = pc.fill_null(pc.not_equal(c, ""), False)
    if pc.all(known).as_py() is False:
        flat, row = flat.filter(known), row[known.to_numpy(zero_copy_only=False)]
        c = pc.struct_field(flat, 0)
    n = len(c)
    x0, x1 = (pc.struct_field(flat, k) for k in (1, 2))
    has0, has1 = (x.is_valid().to_numpy(zero_copy_only=False) for x in (x0, x1))
    begins, ends = (pc.fill_null(x, 0.0).to_numpy(zero_copy_only=False) for x in (x0, x1))
    least = pc.fill_null(gap, np.nan).to_numpy(zero_copy_only=False)[row]
    wide = np.zeros(n, bool)
    if n:
        at = np.maximum.accumulate(np.where(has1, np.arange(n), -1))[:-1]  # the last known end before each character but the first
        with np.errstate(invalid="ignore"):
            away = begins[1:] - ends[at]
            # NaN is above all numbers, as in Spark
            far = (away > least[1:]) | (np.isnan(away) & ~np.isnan(least[1:]))
        wide[1:] = far & has0[1:] & (at >= 0) & (row[np.maximum(at, 0)] == row[1:]) & (row[1:] == row[:-1])
        shut, opened = (pc.is_in(c, value_set=pa.array(s, pa.string())).to_numpy(zero_copy_only=False) for s in (closers, openers))
        wide[1:] &= ~shut[1:] & ~opened[:-1]
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(wide), " ", ""), c, "")
    return pc.if_else(pa.array(counts > 0), _joined(pieces, np.bincount(row, minlength=len(chars))), pc.fill_null(text, ""))


def _joined(pieces: pa.Array, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), pieces), "")


def _first(t: pa.Table, names: list[str]) -> np.ndarray:
    """Whether each row but the first differs from the one before in a column; nulls are equal."""
    new = np.zeros(max(0, t.num_rows - 1), bool)
    for name in names:
        c = t[name].combine_chunks() if isinstance(t[name], pa.ChunkedArray) else t[name]
        a, b = c.slice(0, len(c) - 1), c.slice(1)
        new |= pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
        if c.null_count:
            new |= pc.not_equal(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
    return new


def whole(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Rows of batches in order, in tables that hold all rows of a group of equal ``names``."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        if held:
            last = held[-1].slice(held[-1].num_rows - 1)
            new = _first(pa.Table.from_batches([last, b]), names)
        else:
            new = np.concatenate([[False], _first(pa.Table.from_batches([b]), names)])
        at = np.flatnonzero(new)
        if len(at):
            yield pa.Table.from_batches([*held, b.slice(0, at[-1])]).combine_chunks()
            held = [b.slice(at[-1])]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


class Signs:
    """What the rules ask of a character: bits of each of an array's distinct ones."""

    BLANK, HYPHEN, CLOSER, OPENER, WORD_OPENER, WORD, DIGIT, STOP = (1 << k for k in range(8))

    def __init__(self, closers: str, openers: str, word_openers: str):
        self.sets = ((self.BLANK, " \n"), (self.HYPHEN, "-"), (self.CLOSER, closers), (self.OPENER, openers), (self.WORD_OPENER, word_openers), (self.STOP, "."))

    def one(self, c: str) -> int:
        kind = unicodedata.category(c) if c else ""
        return sum(bit for bit, s in self.sets if c and c in s) | (self.WORD if kind[:1] in ("L", "N") and kind else 0) | (self.DIGIT if kind == "Nd" else 0)

    def of(self, chars: pa.Array) -> np.ndarray:
        d = chars.dictionary_encode()
        return np.array([self.one(c) for c in d.dictionary.to_pylist()], np.int64)[d.indices.to_numpy(zero_copy_only=False)]


def merged(t: pa.Table, keys: list[str], style: list[str], signs: Signs) -> dict[str, pa.Array]:
    """A row for each run of equal (keys, span): its text, joined by the rules of ``style.join_spans``, the style of its first row, and its characters."""
    t = {name: t[name].combine_chunks() for name in t.column_names}
    t = {name: c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for name, c in t.items()}
    text, n = t["text"], len(t["text"])
    starts = np.flatnonzero(np.concatenate([[True], _first(pa.table(t), [*keys, "span"])]))
    group = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
    said = pc.fill_null(pc.not_equal(text, ""), False)
    parts, of = text.filter(said), group[said.to_numpy(zero_copy_only=False)]
    blank = np.zeros(len(parts), bool)
    if len(parts) > 1:
        ends = signs.of(pc.utf8_slice_codeunits(parts, -1))[:-1]
        begins = signs.of(pc.utf8_slice_codeunits(parts, 0, 1))[1:]
        same = of[1:] == of[:-1]
        glued = (ends & (Signs.BLANK | Signs.HYPHEN | Signs.OPENER) != 0) | (begins & (Signs.BLANK | Signs.CLOSER) != 0)
        word = begins & Signs.WORD != 0
        blank[1:] = same & ~glued & (((ends & Signs.WORD != 0) & (word | (begins & Signs.WORD_OPENER != 0))) | ((ends & Signs.CLOSER != 0) & word))
        for k in np.flatnonzero(same & (ends & Signs.STOP != 0) & (begins & Signs.DIGIT != 0)):
            left = parts[k].as_py()
            before = left[-2] if len(left) > 1 else parts[k - 1].as_py()[-1] if k and of[k - 1] == of[k] else ""
            if signs.one(before) & Signs.DIGIT:
                blank[k + 1] = False
    pieces = pc.binary_join_element_wise(pc.if_else(pa.array(blank), " ", ""), parts, "")
    out = _joined(pieces, np.bincount(of, minlength=len(starts)))
    count = pa.array(np.add.reduceat(pc.fill_null(pc.utf8_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64), starts))
    if text.null_count:
        null = np.add.reduceat(text.is_null().to_numpy(zero_copy_only=False).astype(np.int64), starts)
        out = pc.if_else(pa.array(null > 0), pa.scalar(None, pa.string()), out)
        count = pc.if_else(pa.array(null == np.diff([*starts, n])), pa.scalar(None, pa.int64()), count)
    at = pa.array(starts)
    return {c: t[c].take(at) for c in [*keys, "span"]} | {"text": out} | {c: t[c].take(at) for c in style} | {"char_count": count}


def nested(spans: dict[str, pa.Array], keys: list[str], fields: list[str]) -> dict[str, pa.Array]:
    """A row for each run of equal keys: its spans, and the font size of most characters (at least one a span), the first seen on ties."""
    n = len(spans["span"])
    starts = np.flatnonzero(np.concatenate([[True], _first(pa.table(spans), keys)]))
    item = np.repeat(np.arange(len(starts)), np.diff([*starts, n]))
    made = pa.ListArray.from_arrays(pa.array([*starts, n], pa.int32()), pa.StructArray.from_arrays([spans[c] for c in fields], names=fields))
    sized = np.flatnonzero(spans["font_size"].is_valid().to_numpy(zero_copy_only=False))
    base = np.full(len(starts), np.nan)
    has = np.zeros(len(starts), bool)
    if len(sized):
        values, code = np.unique(spans["font_size"].take(pa.array(sized)).to_numpy(zero_copy_only=False), return_inverse=True)
        weight = np.maximum(1, pc.fill_null(spans["char_count"], 0).to_numpy(zero_copy_only=False)[sized])
        pair, first, which = np.unique(item[sized] * len(values) + code, return_index=True, return_inverse=True)
        total = np.bincount(which, weights=weight)
        of = pair // len(values)
        order = np.lexsort((first, -total, of))
        best = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
        base[of[best]], has[of[best]] = values[pair[best] % len(values)], True
    at = pa.array(starts)
    size = pc.if_else(pa.array(has), pa.array(base), pa.scalar(None, pa.float64()))
    return {c: spans[c].take(at) for c in keys} | {"style_spans": made, "style_baseline_size": size}
