"""Personal data: base patterns, and a character-level BiLSTM-CRF that adds to them.

The base patterns find e-mail addresses, IP addresses, card numbers and phone numbers in
the whole text. A bidirectional LSTM over characters with CRF transitions is trained in
numpy on labelled spans of a bounded, documented sample, and then adds spans that the
patterns don't have. Its labels are the base spans of the sample, as they stand and written
in other ways that the patterns don't read (VARIANTS): spelled or spaced at signs and dots,
other separators, numbers without their plus. So it learns other spellings, not other
meanings; texts of the sample without any base span teach it what to leave alone.

A text is cut into cores of CORE characters at fixed places. A core is scored within a
window that reaches CONTEXT characters beyond it on both sides, so a character's scores
never depend on what else is read; one Viterbi pass over the text reconciles the overlapping
windows. Every core of every text is scored. A character is surely outside if the scores of
no span over it can make up for leaving the outside (``Tagger.unsure``): the best path of
the text leaves all of these outside, so the stretches between them are decoded one by one,
with the same tags as the whole text at once.

Added spans touch no base span, are ``LEAST`` to MOST characters long, and obey the rule
of their kind: an at sign and a dot, or the words for them, with a name on either side;
four numbers up to 255; 13 to 19 digits with a right check digit; 9 to 15 digits.

Defined cases: null text counts as empty and has no spans; positions count code points;
a text may be of any length; repeated rows are treated alike; without any base span in
the sample the model adds nothing; an empty table gives an empty result; extra columns
are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm import textkit as K
from gavelflow.llm.scratch import Scratch

KINDS = ("email", "ip", "card", "phone")

#: Most texts that the model learns from: so many with a base span, a third as many without.
TRAIN_TEXTS = 300
#: Most windows that it learns from in a text, as it stands and rewritten.
TEXT_WINDOWS = 8
HIDDEN = 12
CORE, CONTEXT = 192, 24
WINDOW = CORE + 2 * CONTEXT
#: The cores of the windows that it learns from are shorter.
STEP = 48
LEARNT = STEP + 2 * CONTEXT
#: Fewest and most characters of an added span.
LEAST, MOST = 7, 48
#: How spans are rewritten for training, by kind: (what is replaced, by what).
VARIANTS = {
    0: [(("@", " at "), (".", " dot ")), (("@", " (at) "), (".", " (dot) ")), (("@", "[at]"), (".", "[dot]")), (("@", " @ "), (".", " . "))],
    1: [((".", " . "),), ((".", "[.]"),), ((".", "-"),), ((".", " dot "),)],
    2: [((" ", "."), ("-", ".")), ((" ", "\u00a0"), ("-", "\u00a0")), ((" ", "/"), ("-", "/")), ((" ", "  "), ("-", " - "))],
    3: [(("+", "00"),), (("+", ""),), ((" ", "\u00a0"), ("-", "\u00a0")), ((" ", "/"), ("-", "/"))],
}
#: Ways that training never shows, to measure with.
HELD_OUT_VARIANTS = {
    0: [(("@", " AT "), (".", " DOT ")), (("@", " {at} "), (".", " {dot} "))],
    1: [((".", " / "),), ((".", "(.)"),)],
    2: [((" ", "_"), ("-", "_")), ((" ", " . "), ("-", " . "))],
    3: [((" ", "_"), ("-", "_")), (("+", "(0)"),)],
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number's digits are tried from their first on: what follows fails alike from any later one.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_DOT = r"(?i)(?<![a-z])dot(?![a-z])"
_AT_FORM = re.compile(r"(?i)@|(?<![a-z])at(?![a-z])")
_DOT_FORM = re.compile(r"\.|" + _DOT[4:], re.IGNORECASE)
_TRIGGER = re.compile(_DOT + "|[0-9@]")
#: What a text with a base span holds: [0-9A-Za-z]@[0-9A-Za-z]|[0-9]\.[0-9]+\.[0-9]|\+[0-9]|[0-9]{4}[ -]?[0-9]{4},
#: so written that most characters are passed over at the first step.
LIKELY = r"[0-9@+](?:(?<=[0-9A-Za-z]@)[0-9A-Za-z]|(?<=\+)[0-9]|(?<=[0-9])(?:\.[0-9]+\.[0-9]|[0-9]{3}[ -]?[0-9]{4}))"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind and start."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        end = at + 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, lo, m.end()))
            end = done = m.end()
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def obeys(kind: int, text: str) -> bool:
    """Whether an added span satisfies what makes its kind, however it is written."""
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == 0:
        at = _AT_FORM.search(text, 1)
        dot = _DOT_FORM.search(text, at.end() + 1) if at else None
        return bool(dot) and text[0].isalnum() and text[-1].isalnum() and len(text[dot.end() :].strip(" ()[]{}")) >= 2 and len(text.split()) <= 9
    if kind == 1:
        return len(numbers) == 4 and all(len(n) <= 3 and int(n) <= 255 for n in numbers)
    if kind == 2:
        return 13 <= len(digits) <= 19 and luhn(digits)
    return 9 <= len(digits) <= 15


def shapes(text: str) -> np.ndarray:
    """Characters as classes: each ASCII character its own, digits one, other letters by case."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    out = np.where(code < 128, code, 128)
    out[(code >= 0x30) & (code < 0x3A)] = 0x30
    out[(code >= 0xC0) & (code < 0x250)] = 129
    return out


CLASSES = 130
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind


def _allowed() -> np.ndarray:
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


ALLOWED = _allowed()


def tags_of(length: int, spans: list[tuple[int, int, int]], lo: int) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        a, b = max(a - lo, 0), min(b - lo, length)
        if a < b and not out[a:b].any():
            out[a:b] = 2 + 2 * kind
            out[a] = 1 + 2 * kind
    return out


def telling_cores(text: str) -> list[tuple[int, int]]:
    """Runs of cores to learn from, as character ranges: near digits, at signs and the word "dot"."""
    n = -(-len(text) // STEP)
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() // STEP - 1), min(n, (m.end() - 1) // STEP + 2)
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a * STEP, min(b * STEP, len(text))) for a, b in out]


def rewritten(text: str, spans: list[tuple[int, int, int]], ways: dict, pick) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its spans written another way, and where they stand then. pick(n) chooses of n."""
    parts, out, at, done = [], [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: s[1]):
        if a < done:
            continue
        new = text[a:b]
        for old, by in ways[kind][pick(len(ways[kind]))]:
            new = new.replace(old, by)
        parts += [text[done:a], new]
        at += a - done
        out.append((kind, at, at + len(new)))
        at += len(new)
        done = b
    return "".join([*parts, text[done:]]), out


def padded(code: np.ndarray, lo: int) -> np.ndarray:
    """The window from ``lo`` on, blanks outside of the text."""
    out = np.full(LEARNT, 0x20, np.int64)
    a, b = max(lo, 0), min(lo + LEARNT, len(code))
    if a < b:
        out[a - lo : b - lo] = code[a:b]
    return out


class Tagger:
    """Two LSTMs over characters, a linear layer and CRF transitions.

    x / (1 + |x|) stands for tanh, and half of it and a half for the sigmoid: without exponentials
    every character of a text can be read."""

    def __init__(self, seed: int = 7, hidden: int = HIDDEN):
        r, h = np.random.default_rng(seed), hidden
        make = lambda *shape: (r.standard_normal(shape) * 0.2).astype(np.float32)
        self.h = h
        self.p = {"out_f": make(h, TAGS), "out_b": make(h, TAGS), "bias": np.zeros(TAGS, np.float32), "move": np.zeros((TAGS, TAGS), np.float32)}
        for d in "fb":
            self.p[f"x_{d}"], self.p[f"h_{d}"] = make(CLASSES, 4 * h), make(h, 4 * h)
            self.p[f"x_{d}"][:, h : 2 * h] += 1  # remember by default

    def _states(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states of a batch (rows, time)."""
        h, n, steps = self.h, *x.shape
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out = np.empty((n, steps, h), np.float32)
        table, again = self.p[f"x_{d}"], self.p[f"h_{d}"]
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            gates = table[x[:, t]] + state @ again
            gates /= 1 + np.abs(gates)
            sig, new = (gates[:, : 3 * h] + 1) / 2, gates[:, 3 * h :]
            old, before = cell, state
            cell = sig[:, h : 2 * h] * old + sig[:, :h] * new
            lit = cell / (1 + np.abs(cell))
            state = sig[:, 2 * h :] * lit
            out[:, t] = state
            if keep is not None:
                keep.append((t, before, old, sig, new, lit))
        return out

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return self._states(x, "f") @ self.p["out_f"] + self._states(x, "b") @ self.p["out_b"] + self.p["bias"]

    def of_cores(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """emissions() of the cores of the windows of ``flat`` that begin at ``starts``. Each LSTM runs
        as far as the core's last character. The gates lie one after another, for numpy's sake."""
        h, n = self.h, len(starts)
        apart = lambda w: np.ascontiguousarray(w.reshape(len(w), 4, h).transpose(1, 0, 2))
        gates, taken, lit = np.empty((4, n, h), np.float32), np.empty((4, n, h), np.float32), np.empty((n, h), np.float32)
        codes = np.ascontiguousarray(flat[starts + np.arange(WINDOW)[:, None]], np.intp)
        out = np.empty((CORE, n, TAGS), np.float32)
        out[:] = self.p["bias"]
        told = np.empty((n, TAGS), np.float32)
        for d, times in (("f", range(CONTEXT + CORE)), ("b", range(WINDOW - 1, CONTEXT - 1, -1))):
            # Gates stay twice as large, and so does the state: halves of weights make up for it, exactly.
            table, again, last = apart(self.p[f"x_{d}"]), apart(self.p[f"h_{d}"]) / 2, self.p[f"out_{d}"] / 2
            state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for t in times:
                np.matmul(state, again, out=gates)
                gates += np.take(table, codes[t], axis=1, out=taken, mode="clip")
                np.abs(gates, out=taken)
                taken += 1
                gates /= taken
                gates[:3] += 1
                take, keep, show, new = gates
                new *= take
                cell *= keep
                cell += new
                cell *= np.float32(0.5)
                np.abs(cell, out=lit)
                lit += 1
                np.divide(cell, lit, out=lit)
                np.multiply(lit, show, out=state)
                if CONTEXT <= t < CONTEXT + CORE:
                    out[t - CONTEXT] += np.matmul(state, last, out=told)
        return out.transpose(1, 0, 2)

    def moves(self) -> np.ndarray:
        return np.where(ALLOWED, self.p["move"], np.float32(-1e4))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Negative log-likelihood of the tags, and its gradients."""
        n, steps = x.shape
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self._states(x, d, kept[d]) for d in "fb"}
        e = (states["f"] @ self.p["out_f"] + states["b"] @ self.p["out_b"] + self.p["bias"]).astype(np.float64)
        move = self.moves().astype(np.float64)
        ahead, back = np.empty_like(e), np.zeros_like(e)
        add = lambda a, axis: np.log(np.exp(a - a.max(axis=axis, keepdims=True)).sum(axis=axis)) + a.max(axis=axis)
        ahead[:, 0] = e[:, 0]
        for t in range(1, steps):
            ahead[:, t] = add(ahead[:, t - 1][:, :, None] + move[None], 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            back[:, t] = add(move[None] + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
        whole = add(ahead[:, -1], 1)
        share = np.exp(ahead + back - whole[:, None, None])
        row, time = np.arange(n)[:, None], np.arange(steps)[None]
        loss = float((whole - e[row, time, y].sum(1) - move[y[:, :-1], y[:, 1:]].sum(1)).sum())
        share[row, time, y] -= 1
        g = {k: np.zeros_like(v, dtype=np.float64) for k, v in self.p.items()}
        for t in range(1, steps):
            both = ahead[:, t - 1][:, :, None] + move[None] + (e[:, t] + back[:, t])[:, None, :] - whole[:, None, None]
            g["move"] += np.exp(both).sum(0)
        np.add.at(g["move"], (y[:, :-1].ravel(), y[:, 1:].ravel()), -1)
        g["move"][~ALLOWED] = 0
        flat = share.reshape(-1, TAGS)
        g["bias"] = flat.sum(0)
        h = self.h
        for d in "fb":
            g[f"out_{d}"] = states[d].reshape(-1, h).T @ flat
            wanted = share @ self.p[f"out_{d}"].T
            ds, dc = np.zeros((n, h)), np.zeros((n, h))
            for t, before, old, sig, new, lit in reversed(kept[d]):
                ds = ds + wanted[:, t]
                i, f, o = sig[:, :h], sig[:, h : 2 * h], sig[:, 2 * h :]
                dc = dc + ds * o * (1 - np.abs(lit)) ** 2
                slope = lambda s: (1 - np.abs(2 * s - 1)) ** 2 / 2
                dg = np.concatenate([dc * new * slope(i), dc * old * slope(f), ds * lit * slope(o), dc * i * (1 - np.abs(new)) ** 2], 1)
                np.add.at(g[f"x_{d}"], x[:, t], dg)
                g[f"h_{d}"] += before.T @ dg
                ds, dc = dg @ self.p[f"h_{d}"].T, dc * f
        return loss / n, {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 10, batch: int = 48, rate: float = 0.02, seed: int = 3) -> float:
        r, loss, step = np.random.default_rng(seed), 0.0, 0
        first = {k: np.zeros_like(v, dtype=np.float64) for k, v in self.p.items()}
        second = {k: np.zeros_like(v, dtype=np.float64) for k, v in self.p.items()}
        for _ in range(epochs):
            order, loss = r.permutation(len(x)), 0.0
            for lo in range(0, len(x), batch):
                some = order[lo : lo + batch]
                part, g = self.gradients(x[some], y[some])
                loss += part * len(some) / len(x)
                step += 1
                for k, v in g.items():
                    v = np.clip(v, -5, 5)
                    first[k] = 0.9 * first[k] + 0.1 * v
                    second[k] = 0.99 * second[k] + 0.01 * v * v
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return loss

    def unsure(self, e: np.ndarray) -> np.ndarray:
        """Of the characters (time, TAGS), those that a best path may leave outside or not; it surely
        leaves all others outside.

        A span gains, against characters outside, no more than ``begin`` at its first character,
        ``more`` at each other one, and ``close``. Putting it outside costs its neighbours ``near`` at
        most. So it is in no best path unless these add up to 0 or more. The best span over a
        character is the best way to it, plus the best way on: running sums and their maxima.
        Such a span holds a hot character: one where ``more`` is a gain, or ``begin`` alone is enough.
        So sums run over the characters up to REACH from a hot one only. What lies between two such
        stretches counts as no loss, and a span that begins there as one that begins with just less
        than enough; if the characters next to it are surely outside, so is all of it. This, and
        sums that reach over the texts' ends, only find more characters unsure."""
        move = self.moves().astype(np.float64)
        plain, own = move[0, 0], move[1:, 0]
        close = max(0.0, own.max() - plain)
        near = max(0.0, (plain - own).max()) + max(max(0.0, move[1:, k].max() - move[0, k]) for k in range(1, TAGS, 2))
        enough = -(close + near + 1e-3)
        gain = np.empty(TAGS - 1)
        gain[::2] = [max(0.0, move[:, k].max() - plain) for k in range(1, TAGS, 2)]
        gain[1::2] = [move[[k, k + 1], k + 1].max() - plain for k in range(1, TAGS, 2)]
        least = np.where(np.arange(TAGS - 1) % 2, 0, enough) - gain - 1e-3
        out, hot = np.zeros(len(e), bool), []
        for lo in range(0, len(e), 1 << 14):  # in a core's cache
            part = e[lo : lo + (1 << 14)]
            some = part[:, 1:] - part[:, :1] >= least.astype(np.float32)
            hot.append(np.flatnonzero(some.view(np.uint64)[:, 0]) + lo)
        hot = np.concatenate(hot) if hot else np.empty(0, np.int64)
        if not len(hot):
            return out
        cuts = np.flatnonzero(np.diff(hot) > 2 * REACH) + 1
        start = np.maximum(hot[np.concatenate([[0], cuts])] - REACH, 0)
        end = np.minimum(hot[np.concatenate([cuts - 1, [-1]])] + REACH + 1, len(e))
        # One place before each stretch stands for all that lies between it and the one before.
        where = K.gathered(end - start + 1, start - 1)
        first = np.concatenate([[0], np.cumsum(end - start + 1)])
        by = e[np.maximum(where, 0)].T.astype(np.float64)
        by -= by[0].copy()
        unsure = np.zeros(len(where), bool)
        for k in range(1, TAGS, 2):
            begin, more = by[k] + gain[k - 1], by[k + 1] + gain[k]
            begin[first[:-1]], more[first[:-1]] = enough, 0
            more = np.cumsum(more)
            to = np.maximum.accumulate(begin - more)
            on = np.maximum.accumulate(more[::-1])[::-1]
            unsure |= to + on >= enough
        unsure[first[:-1]] = False
        out[where[unsure]] = True
        before, after = np.concatenate([[0], end]), np.concatenate([start, [len(e)]])
        open_before, open_after = np.concatenate([[False], unsure[first[1:] - 1]]), np.concatenate([unsure[first[:-1] + 1], [False]])
        for a, b in zip(before[open_before | open_after].tolist(), after[open_before | open_after].tolist(), strict=True):
            out[a:b] = True
        return out

    def decode(self, e: np.ndarray, opens: bool = True, closes: bool = True) -> np.ndarray:
        """The best tags of one stretch (time, TAGS) between two characters outside, or the text's ends."""
        move, score = self.moves().astype(np.float64), e[0].astype(np.float64)
        if opens:
            score[2::2] = -1e4
        else:
            score += move[0]
        back = np.empty(e.shape, np.int64)
        for t in range(1, len(e)):
            both = score[:, None] + move
            back[t] = both.argmax(0)
            score = both.max(0) + e[t]
        tag = int((score if closes else score + move[:, 0]).argmax())
        out = np.empty(len(e), np.int64)
        for t in range(len(e) - 1, -1, -1):
            out[t] = tag
            tag = int(back[t, tag]) if t else tag
        return out


#: Windows that are scored together: their gates lie in a core's cache.
TOGETHER = 1024
#: Characters around a hot one over which ``unsure`` sums.
REACH = 48


def laid(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(texts one after another, whole cores between blanks of CONTEXT, where each begins)."""
    sizes = [2 * CONTEXT + -(-len(c) // CORE) * CORE for c in codes]
    at = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    flat = np.full(at[-1], 0x20, np.uint8)
    for c, a in zip(codes, at.tolist(), strict=False):
        flat[a + CONTEXT : a + CONTEXT + len(c)] = c
    return flat, at[:-1]


def scored(model: Tagger, texts: list[tuple[np.ndarray, list[tuple[int, int]]]]) -> list[list[np.ndarray]]:
    """Emissions of runs of cores of each text (character classes, runs)."""
    flat, at = laid([code for code, _ in texts])
    part = lambda a, b: model.of_cores(flat, np.arange(a, b, CORE)).reshape(-1, TAGS)[: b - a]
    return [[part(x + a, x + b) for a, b in runs] for (_, runs), x in zip(texts, at.tolist(), strict=True)]


def stretches(model: Tagger, texts: list[str], everywhere: bool = False) -> Iterator[tuple[int, int, np.ndarray]]:
    """(text, start, tags) of each stretch between characters that are surely outside, if an added
    span fits in; of the whole texts with ``everywhere``. All characters are scored."""
    codes = [shapes(t) for t in texts]
    flat, at = laid(codes)
    sizes = np.array([len(c) for c in codes], np.int64)
    cores = -(-sizes // CORE)
    windows = np.repeat(at, cores) + CORE * K.gathered(cores, np.zeros(len(codes), np.int64))
    scores = [np.empty((0, TAGS), np.float32)]
    for lo in range(0, len(windows), TOGETHER):
        some = windows[lo : lo + TOGETHER]
        own = some[:, None] + np.arange(CORE) < np.repeat(at + sizes, cores)[lo : lo + TOGETHER, None]
        scores.append(model.of_cores(flat, some)[own])
    e = np.concatenate(scores)
    opens = np.concatenate([[0], np.cumsum(sizes)])
    inside = np.ones(len(e), bool) if everywhere else model.unsure(e)
    for a, b, text in zip(*(x.tolist() for x in K.runs(inside, opens)), strict=True):
        if b - a >= LEAST:
            yield text, a - int(opens[text]), model.decode(e[a:b], a == opens[text], b == opens[text + 1])


def added_spans(text: str, base: list[tuple[int, int, int]], tagged: list[tuple[int, np.ndarray]]) -> list[tuple[int, int, int]]:
    """tagged: (start, tags) of stretches of the text."""
    taken = sorted((a, b) for _, a, b in base)
    out = []
    for lo, tags in tagged:
        for a in np.flatnonzero(tags % 2 == 1).tolist():
            b = a + 1
            while b < len(tags) and tags[b] == tags[a] + 1:
                b += 1
            kind, x, y = int(tags[a] - 1) // 2, lo + a, lo + b
            while y > x and text[y - 1] in " .,;:":
                y -= 1
            while x < y and text[x] in " .,;:":
                x += 1
            if LEAST <= y - x <= MOST and obeys(kind, text[x:y]) and not any(p < y and x < q for p, q in taken):
                out.append((kind, x, y))
    return out


def found(model: Tagger, texts: list[str], everywhere: bool = False) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text. everywhere: decode what is surely outside too."""
    base = [base_spans(t) for t in texts]
    tagged: list[list] = [[] for _ in texts]
    for k, start, tags in stretches(model, texts, everywhere):
        tagged[k].append((start, tags))
    return [(b, added_spans(t, b, g)) for t, b, g in zip(texts, base, tagged, strict=True)]


def examples(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """(character classes, tags) of windows of a text, as it stands and rewritten."""
    base, out = base_spans(text), []
    seed = np.random.default_rng(zlib.crc32(text.encode()))
    forms = [(text, base)]
    forms += [rewritten(text, base, VARIANTS, lambda n: int(seed.integers(n))) for _ in range(3)] if base else []
    for said, spans in forms:
        code, starts = shapes(said), [lo for a, b in telling_cores(said) for lo in range(a, b, STEP)]
        # Cores with a span first: a text of many numbers would crowd them out.
        starts.sort(key=lambda lo: not any(x < lo + STEP and lo < y for _, x, y in spans))
        for lo in starts[: max(1, TEXT_WINDOWS // len(forms))]:
            at = lo - CONTEXT
            out.append((padded(code, at), tags_of(LEARNT, spans, at)))
    return out


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", texts: int = TRAIN_TEXTS) -> Tagger | None:
    """Trained on at most ``texts`` texts with what looks like a base span, and a third as many
    with other digits, picked by a hash of the id. Only the picked texts are fetched; of
    several rows of an id any may be taken."""
    text = F.col(text_col).cast("string")
    key = F.xxhash64(F.col(id_col))
    narrow = docs.select(key.alias("h"), text.rlike(LIKELY).alias("likely"), text.alias("t"))
    # One pass finds both; a hash may have rows of either kind.
    kinds = [F.col("likely").alias("likely"), (~F.col("likely") & F.col("t").rlike("[0-9]")).alias("other")]
    seen = Scratch(docs.sparkSession, "pii").save(narrow.select("h", *kinds).filter("likely OR other").distinct(), "learnable")
    first = seen.filter("likely").select("h").orderBy("h").limit(texts)
    other = seen.filter("other").select("h").orderBy("h").limit(-(-texts // 3))
    # At most 4 / 3 of ``texts`` hashes are broadcast.
    rows = docs.select(key.alias("h"), text.alias("text")).join(F.broadcast(first.unionByName(other).distinct()), "h")

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [(h, e) for h, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for e in examples(t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in made], pa.int64()), *[pa.array([e[k].astype(np.uint8).tobytes() for _, e in made], pa.binary()) for k in (0, 1)]], names=["h", "x", "y"])

    # 192 bytes each, at most TEXT_WINDOWS of a text; rows that share an id share their place in the order.
    held = rows.mapInArrow(of, "h long, x binary, y binary").distinct().orderBy("h", "x", "y").limit(2 * texts * TEXT_WINDOWS).collect()
    if not any(any(r.y) for r in held):
        return None
    x, y = (np.stack([np.frombuffer(bytes(r[k]), np.uint8) for r in held]).astype(np.int64) for k in (1, 2))
    model = Tagger()
    model.train(x, y)
    return model


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", model: Tagger | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (all of the base patterns), spans
    (with the model's) of every row."""
    model = model or learn(docs, id_col=id_col, text_col=text_col)
    held = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("x_text"))

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = held.value
        empty = hashlib.sha256(b"").hexdigest()
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((4, n), np.int64)
            digest, spans = [empty] * n, [""] * n
            raw, offsets = K.text_bytes(batch.column(1))
            for lo, hi in K.slices(offsets):
                texts = [raw[offsets[r] : offsets[r + 1]].tobytes().decode() for r in range(lo, hi)]
                for r, (base, more) in zip(range(lo, hi), found(tagger, texts) if tagger else [(base_spans(t), []) for t in texts], strict=True):
                    for kind, _, _ in base:
                        counts[kind, r] += 1
                    if base:
                        digest[r] = hashlib.sha256(joined(base).encode()).hexdigest()
                    spans[r] = joined(base + more)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(of, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
