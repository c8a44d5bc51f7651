"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions.

The patterns (email, ip, card, phone) are read over the whole text and always kept. The network
tags characters in overlapping windows; each window is decoded by Viterbi, and the spans of all
windows are reconciled over the whole text by choosing the non-overlapping set of highest total
score (of equal ones, that of the spans that end first). A span that touches an inner edge of its
window counts only as what the next window makes of it; spans of up to WINDOW - STRIDE - 2 characters
lie inside some window. Spans of the network are added where no pattern span of any kind lies and
where they look like their kind (``plausible``); they reach what the patterns leave out, such as phone
numbers without a plus, 13 to 15 digit cards, IPv6 addresses and emails of the form "a (at) b.org".

What is plausible holds a digit, an "@" or a bracketed "at", whatever its kind; a window without any of
these can't give a span that is kept, and isn't run. A test compares this with running all windows.

The network is trained in numpy, by the gradient of the CRF likelihood, on generated lines whose spans
are known. Training takes minutes, so its weights are kept beside this module (``tagger.npz``), as
``python -m pageloom.llm.personal`` writes them; a test trains the first steps anew and compares them.

Defined results: null texts count as empty; empty texts have no spans; repeated rows get equal
results; texts of any length are read whole, window by window; an empty table gives an empty
result; columns of the names that are added are replaced.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns; each match is kept if its check passes, and passed over if not.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
DIGITS = re.compile(r"[0-9]+")

Span = tuple[str, int, int]

WINDOW, STRIDE, HIDDEN = 128, 64, 20
#: Windows decoded at once, and characters of texts whose windows are decoded together.
BATCH, TEXTS = 1024, 1 << 21
#: Lines, epochs and seed of the training whose weights are kept in FILE.
LINES, EPOCHS, SEED = 9000, 6, 11
FILE = Path(__file__).with_name("tagger.npz")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SIGNS = " \n@.-+()_%:/,='\"#[]*&$|!?;<>~\\{}"
CLASSES = 6 + len(SIGNS)


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the local part, "@" and a dotted domain; in time linear in the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, by kind and start."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(len(x) for x in DIGITS.findall(m[0])) <= 15]
    return out


# ---- the network


def _classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _class_table()[np.minimum(codes, 128)]


@cache
def _class_table() -> np.ndarray:
    table = np.zeros(129, np.int64)
    for c in range(128):
        ch = chr(c)
        table[c] = 1 if ch.isdigit() else 2 if ch.islower() else 3 if ch.isupper() else 6 + SIGNS.index(ch) if ch in SIGNS else 4
    table[128] = 5
    return table


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Weights: for each direction an embedding into the gates, a recurrence and a bias; emissions; transitions."""

    def __init__(self, seed: int = 7, weights: dict[str, np.ndarray] | None = None):
        if weights:
            self.p = weights
            return
        rng, h = np.random.default_rng(seed), HIDDEN
        self.p = {f"{k}{d}": v for d in "fb" for k, v in (("E", rng.normal(0, 0.3, (CLASSES, 4 * h))), ("R", rng.normal(0, 0.3, (h, 4 * h))))}
        self.p |= {"O": rng.normal(0, 0.3, (2 * h, TAGS)), "c": np.zeros(TAGS), "T": np.zeros((TAGS, TAGS)), "S": np.zeros(TAGS)}
        for d in "fb":
            self.p[f"E{d}"][:, h : 2 * h] += 1.0  # remember at first

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states [n, steps, h] of one direction over classes x [n, steps]."""
        n, steps = x.shape
        E, R = self.p[f"E{d}"], self.p[f"R{d}"]
        h, c, out = np.zeros((n, HIDDEN), E.dtype), np.zeros((n, HIDDEN), E.dtype), np.empty((n, steps, HIDDEN), E.dtype)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = E[x[:, t]] + h @ R
            gates = _sigmoid(z[:, : 3 * HIDDEN])
            i, f, o, g = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])
            before, past = c, h
            c = f * c + i * g
            tc = np.tanh(c)
            h = o * tc
            out[:, t] = h
            if keep is not None:
                keep.append((t, i, f, o, g, before, tc, past))
        return out

    def emissions(self, x: np.ndarray, keep: dict | None = None) -> np.ndarray:
        states = np.concatenate([self._run(x, d, None if keep is None else keep.setdefault(d, [])) for d in "fb"], axis=2)
        if keep is not None:
            keep["states"] = states
        return states @ self.p["O"] + self.p["c"]

    def _back(self, x: np.ndarray, d: str, keep: list, grad: np.ndarray, out: dict) -> None:
        E, R = out[f"E{d}"], out[f"R{d}"]
        dh, dc = np.zeros_like(grad[:, 0]), np.zeros_like(grad[:, 0])
        for t, i, f, o, g, before, tc, past in reversed(keep):
            dh = dh + grad[:, t]
            dc = dc + dh * o * (1 - tc * tc)
            dz = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)], axis=1)
            np.add.at(E, x[:, t], dz)
            R += past.T @ dz
            dh, dc = dz @ self.p[f"R{d}"].T, dc * f

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Negative log likelihood of tags y [n, steps] under the CRF, and its gradient, by forward and backward sums."""
        keep: dict = {}
        e, T, S = self.emissions(x, keep), self.p["T"], self.p["S"]
        n, steps = x.shape
        fwd, bwd = np.empty_like(e), np.zeros_like(e)
        fwd[:, 0] = e[:, 0] + S
        for t in range(1, steps):
            fwd[:, t] = _logsum(fwd[:, t - 1][:, :, None] + T, 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            bwd[:, t] = _logsum(T + (e[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
        log_z = _logsum(fwd[:, -1], 1)
        rows = np.arange(n)
        gold = S[y[:, 0]] + e[rows[:, None], np.arange(steps), y].sum(1) + T[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(fwd + bwd - log_z[:, None, None])
        out = {k: np.zeros_like(v) for k, v in self.p.items()}
        out["S"] = de[:, 0].sum(0)
        np.add.at(out["S"], y[:, 0], -1)
        for t in range(1, steps):
            out["T"] += np.exp(fwd[:, t - 1][:, :, None] + T + (e[:, t] + bwd[:, t])[:, None, :] - log_z[:, None, None]).sum(0)
        np.add.at(out["T"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        np.add.at(de, (rows[:, None], np.arange(steps), y), -1)
        out["O"], out["c"] = np.einsum("nth,ntk->hk", keep["states"], de), de.sum((0, 1))
        ds = de @ self.p["O"].T
        for d, part in (("f", ds[..., :HIDDEN]), ("b", ds[..., HIDDEN:])):
            self._back(x, d, keep[d], part, out)
        return float((log_z - gold).sum() / n), {k: v / n for k, v in out.items()}

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags [n, steps], and what each position adds to the path's score over the all-outside path's."""
        e, T = self.emissions(x), self.p["T"]
        n, steps, _ = e.shape
        score, back = e[:, 0] + self.p["S"], np.zeros((n, steps, TAGS), np.int8)
        for t in range(1, steps):
            every = score[:, :, None] + T
            back[:, t] = every.argmax(1)
            score = every.max(1) + e[:, t]
        tags = np.empty((n, steps), np.int64)
        tags[:, -1] = score.argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = back[np.arange(n), t, tags[:, t]]
        margins = np.take_along_axis(e, tags[:, :, None], 2)[:, :, 0] - e[:, :, 0]
        margins[:, 0] += self.p["S"][tags[:, 0]] - self.p["S"][0]
        margins[:, 1:] += T[tags[:, :-1], tags[:, 1:]] - T[0, 0]
        return tags, margins


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def _labelled_line(rng: random.Random) -> tuple[str, list[Span]]:
    """A line of WINDOW characters or fewer, with at most three spans."""
    pick = rng.choice
    word = lambda: "".join(pick("etaoinshrdlucmfwyp") for _ in range(rng.randint(1, 9))) + pick([""] * 8 + [",", ".", "é", "ß"])
    num = lambda n: "".join(pick("0123456789") for _ in range(n))
    name = lambda: "".join(pick("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 8)))
    hexa = lambda n: "".join(pick("0123456789abcdef") for _ in range(n))

    def email() -> str:
        who = name() + pick(["", ".", "_", "-"]) + pick(["", num(1), num(2), name()])
        where = name() + pick(["", num(1), f"-{name()}", f".{name()}"]) + "." + pick(["com", "org", "example.com", "net", "de", "io"])
        sign = pick(["@"] * 6 + ["(at)", "[at]", " (at) ", " [at] ", " {at} ", " @ "])
        return (who.replace("a", "á").replace("o", "ö") if rng.random() < 0.1 else who) + sign + where

    def ip() -> str:
        if rng.random() < 0.7:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        parts = [hexa(rng.randint(1, 4)) for _ in range(8)]
        k, n = rng.randint(1, 3), rng.randint(2, 5)
        return ":".join(parts) if rng.random() < 0.5 else pick(["2001", "fe80", "fd" + hexa(2)]) + ":" + ":".join(parts[:k]) + "::" + ":".join(parts[k : k + 6 - n])

    def card() -> str:
        size = pick([16, 16, 16, 15, 13])
        body = {15: "3", 13: "4"}.get(size) or pick("3456")
        body += num(size - 2)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        sep = pick(["", "", " ", "-", "."])
        cuts = [0, 4, 10, 15] if size == 15 else [*range(0, size, 4), size]
        return sep.join(full[i:j] for i, j in zip(cuts, cuts[1:], strict=False))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return pick([
            f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{num(2)} {a} {b}{num(2)}", f"{a}.{b}.{c}", f"+{num(2)}-{a}-{b}-{c}", f"{a} {b} {c}",
            f"{pick('6789')}{num(2)} {b} {num(3)}", f"0{num(2)} {num(4)} {num(4)}", f"0{num(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{num(3)}-{num(3)}{num(3)}", f"00{num(2)} {a} {b} {num(3)}",
            f"(0{num(2)}) {num(4)} {num(4)}", f"+{num(1)} {num(4)} {c}", f"0{num(3)} {num(3)} {num(2)}",
        ])

    def other() -> str:
        year, month, day = pick(["19", "20"]) + num(2), f"{rng.randint(1, 12):02}", f"{rng.randint(1, 31):02}"
        return pick([
            num(rng.randint(1, 6)), f"{num(1)}.{num(1)}", f"{num(1)}.{num(2)}.{num(1)}", f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{day}/{month}/{year}", f"{month}-{day}-{year}", f"{year} {month} {day}",
            f"{year}-{year}", hexa(pick([8, 16, 18, 32, 40])), f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", ":".join(hexa(2) for _ in range(6)), f'token = "{hexa(20)}"', f"password={name()}{num(3)}",
            "AKIA" + "".join(pick("ABCDEFGHJKMNPQRSTUVWXYZ234567") for _ in range(16)), f"https://{name()}.example.com/{name()}/{num(3)}", f"{num(2)}:{num(2)}:{num(2)}", f"{num(1)},{num(3)}",
            f"{num(2)}.{num(3)}.{num(3)}", f"{num(3)},{num(3)},{num(3)}", f"#{num(4)}", f"#{num(rng.randint(8, 12))}", f"v{num(1)}.{num(1)}", f"{name()}{num(2)}", f"@{name()}", num(20), num(rng.randint(7, 14)), f"{num(2)} % {num(3)}",
            f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{name()}@{name()}", f"{num(2)}.{num(4)}, {num(2)}.{num(4)}", f"({name()}) {num(3)}", f"pp. {num(3)}-{num(3)}", f"{num(3)} {word()} {num(3)}", f"(at) {name()}",
        ])

    text, spans = "", []
    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    for _ in range(rng.randint(1, 3)):
        text += " ".join(word() for _ in range(rng.randint(0, 4))) + pick([" ", " ", " ", "\n", ": ", " (", ", "])
        if rng.random() < 0.6:
            kind = pick(KINDS)
            value = makers[kind]()
            spans.append((kind, len(text), len(text) + len(value)))
        else:
            value = other()
        text += value + pick([" ", " ", ". ", ", ", "\n", ") "])
    text += " ".join(word() for _ in range(8))
    return text[:WINDOW], [s for s in spans if s[2] <= WINDOW]


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    y = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        y[a:b] = k + 1
        y[a] = k
    return y


def train(lines: int = LINES, epochs: int = EPOCHS, seed: int = SEED, most: int | None = None) -> tuple[Tagger, list[float]]:
    """A tagger after Adam steps over generated lines, and the loss of each step; the same for the same numbers.

    ``most`` stops after so many steps.
    """
    rng, tagger = random.Random(seed), Tagger()
    made = [_labelled_line(rng) for _ in range(lines)]
    x = np.stack([np.pad(_classes(t), (0, WINDOW - len(t))) for t, _ in made])
    y = np.stack([tags_of(WINDOW, s) for _, s in made])
    order, m, v, losses = np.random.default_rng(seed), {}, {}, []
    steps = epochs * (lines // 48)
    for _ in range(epochs):
        for rows in np.array_split(order.permutation(lines), lines // 48):
            loss, grad = tagger.gradient(x[rows], y[rows])
            losses.append(loss)
            step = len(losses)
            rate = 0.02 * (1 - step / (steps + 1))
            for k, g in grad.items():
                m[k], v[k] = 0.9 * m.get(k, 0) + 0.1 * g, 0.99 * v.get(k, 0) + 0.01 * g * g
                tagger.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
            if step == most:
                return tagger, losses
    return tagger, losses


@cache
def trained() -> Tagger:
    """The tagger whose weights are kept in FILE, in single precision."""
    with np.load(FILE) as kept:
        return Tagger(weights={k: kept[k] for k in kept.files if k != "losses"})


_AT = r"(?:\s?[(\[{]at[)\]}]\s?|\s?@\s?)"
#: A sign without which nothing is plausible.
SIGN = re.compile(r"[0-9@]|[(\[{]at[)\]}]")
EMAIL = re.compile(rf"[^\W_][\w.%+-]*{_AT}[^\W_][\w-]*(?:\.[\w-]+)*\.[^\W\d_]{{2,}}")
DATE = re.compile(r"(?:1[5-9]|20)[0-9]{2}([-/. ])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/. ])[0-9]{1,2}\2(?:1[5-9]|20)[0-9]{2}|(?:1[5-9]|20)[0-9]{2}-(?:1[5-9]|20)[0-9]{2}")
THOUSANDS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{3})+|97[89]-.*")


def _is_ip(value: str) -> bool:
    if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", value):
        return all(int(p) <= 255 for p in value.split("."))
    parts = value.split(":")
    return bool(DIGIT.search(value)) and all(re.fullmatch("[0-9A-Fa-f]{0,4}", p) for p in parts) and (len(parts) == 8 and all(parts) or value.count("::") == 1 and 4 <= len(parts) <= 8 and ":::" not in value)


def plausible(kind: str, value: str) -> bool:
    """Whether a span of the network has the form of its kind; every such span holds a SIGN."""
    digits = "".join(DIGITS.findall(value))
    if kind == "email":
        return bool(EMAIL.fullmatch(value))
    if kind == "ip":
        return _is_ip(value)
    if kind == "card":
        bare = digits != value or len(digits) >= 16 or (len(digits), value[0]) in ((13, "4"), (14, "3"), (15, "3"))  # numbers that short are many
        return bare and bool(re.fullmatch(r"[0-9][0-9 .-]+[0-9]", value)) and 13 <= len(digits) <= 19 and luhn(digits)
    form = re.fullmatch(r"[+(]?[0-9][0-9 ().-]+[0-9]", value) and 8 <= len(digits) <= 15 and set(value) & set(" ().-")
    return bool(form) and not DATE.fullmatch(value) and not THOUSANDS.fullmatch(value)


def starts_of(text: str, all_of_them: bool = False) -> list[int]:
    """Where the windows of a text begin: each STRIDE, the last at the text's end; those that hold no SIGN are left out."""
    last = max(0, len(text) - WINDOW)
    if all_of_them:
        return sorted({min(s, last) for s in range(0, last + STRIDE, STRIDE)}) if text else []
    cells = {k // STRIDE for m in SIGN.finditer(text) for k in m.span()}
    return sorted({min(max(0, (c - k) * STRIDE), last) for c in cells for k in (0, 1)})


def decoded(tagger: Tagger, texts: list[str], starts: list[list[int]]) -> list[list[tuple[float, Span]]]:
    """For each text the plausible spans (score, span) of its windows; those cut by an inner edge are left out.

    Windows of all texts are decoded together.
    """
    out: list[list[tuple[float, Span]]] = [[] for _ in texts]
    where = [(k, s) for k, some in enumerate(starts) for s in some]
    codes = {k: _classes(texts[k]) for k, some in enumerate(starts) if some}
    for at in range(0, len(where), BATCH):
        some = where[at : at + BATCH]
        x = np.zeros((len(some), WINDOW), np.int64)
        for row, (k, s) in zip(x, some, strict=True):
            part = codes[k][s : s + WINDOW]
            row[: len(part)] = part
        tags, margins = tagger.decode(x)
        for r in np.flatnonzero(tags.any(1)).tolist():
            (k, s), line = some[r], tags[r].tolist()
            text, t, size = texts[k], 0, min(WINDOW, len(texts[k]) - s)
            while t < size:
                end = t + 1
                if line[t]:
                    kind = (line[t] - 1) // 2
                    while end < size and line[end] == 2 * kind + 2:
                        end += 1
                    inner = (t == 0 and s > 0) or (end == WINDOW and s + end < len(text))
                    if not inner and plausible(KINDS[kind], text[s + t : s + end]):
                        leave = end + (end < WINDOW and not line[end])  # the step out of a span counts with it
                        out[k].append((max(float(margins[r, t:leave].sum()), 1e-6), (KINDS[kind], s + t, s + end)))
                t = end
    return out


def reconciled(found: list[tuple[float, Span]]) -> list[Span]:
    """The non-overlapping spans of the highest total score, over the whole text; of equal totals, that of spans that end first."""
    best: dict[Span, float] = {}
    for score, span in found:
        best[span] = max(score, best.get(span, 0.0))
    spans = sorted((s for s in best if best[s] > 0), key=lambda s: (s[2], s[1], s[0]))
    ends = [s[2] for s in spans]
    total, take = [0.0], []
    for i, s in enumerate(spans):
        before = bisect_right(ends, s[1], 0, i)
        take.append(before if total[before] + best[s] > total[i] else -1)
        total.append(max(total[i], total[before] + best[s]))
    out, i = [], len(spans)
    while i:
        if take[i - 1] >= 0:
            out.append(spans[i - 1])
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


def model_spans(tagger: Tagger, texts: list[str], all_windows: bool = False) -> list[list[Span]]:
    """Spans of the network over whole texts."""
    return [reconciled(found) for found in decoded(tagger, texts, [starts_of(t, all_windows) for t in texts])]


def all_spans(tagger: Tagger, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text the spans of the fixed patterns, and all spans; both by kind as listed, then start."""
    some, size = [], 0
    for t in [*texts, None]:
        if some and (t is None or size + len(t) > TEXTS):
            for text, found in zip(some, model_spans(tagger, some), strict=True):
                base = base_spans(text)
                held = sorted((a, b) for _, a, b in base)
                added = [s for s in found if not any(a < s[2] and s[1] < b for a, b in held)]
                yield base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))
            some, size = [], 0
        if t is not None:
            some.append(t)
            size += len(t)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with base and spans: arrays of (kind, start, end) in code points, end exclusive."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        asdict = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            base, every = [], []
            for b, e in all_spans(shared.value, [t or "" for t in batch.column("text").to_pylist()]):
                base.append(asdict(b))
                every.append(asdict(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(base, kind), pa.array(every, kind)], names=[*batch.schema.names, "base", "spans"])

    kept = docs.drop("base", "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    spans = "array<struct<kind: string, start: bigint, end: bigint>>"
    return kept.mapInArrow(run, f"{fields}, base {spans}, spans {spans}")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; same columns."""
    shared = docs.sparkSession.sparkContext.broadcast(trained())

    def clean(text: str | None, spans: list[Span]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
            if a >= at:
                out += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        return "".join([*out, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.get_field_index("text")
            texts = batch.column(i).to_pylist()
            spans = [every for _, every in all_spans(shared.value, [t or "" for t in texts])]
            done = pa.array([clean(t, s) for t, s in zip(texts, spans, strict=True)], batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays([done if j == i else c for j, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def joined(spans: F.Column) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    return find(docs.select("doc_id", "text")).select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


if __name__ == "__main__":
    made, found = train()
    np.savez_compressed(FILE, losses=np.array(found[:40]), **{k: v.astype(np.float32) for k, v in made.p.items()})
    print(f"{len(found)} steps, loss {np.mean(found[:40]):.2f} -> {np.mean(found[-40:]):.2f}")
