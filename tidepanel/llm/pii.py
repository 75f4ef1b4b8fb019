"""Personal data: rules for four plain forms, and a character tagger for the forms rules miss.

The tagger is a bidirectional LSTM over characters with a linear-chain CRF on top, written in numpy and
trained here by gradient steps on labelled spans. Every text is cut into windows that cover all of it and overlap
by STRIDE characters; each window is decoded alone (Viterbi), and one dynamic programme over the whole text chooses, among
all spans of all windows, the set without overlaps that has the largest total weight. A span that fills the overlap and
reaches the end of its window is decoded again in windows of twice the width, until one holds all of it.

A found span stays if it passes the test of its kind (``valid``: card numbers Luhn, address parts
up to 255, and so on). Spans of the rules always stay; the tagger adds spans that overlap none of them.

Null and empty texts have no spans. Every row is judged alone, so repeated rows and null ids change
nothing. Only ``doc_id`` and ``text`` are read; other columns may have any name. Without labelled
spans there is no tagger and the rules stand alone.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE = 96, 48
WIDE = 768  # width of the windows that are decoded; the last of a text is a smaller multiple of WINDOW
HIDDEN = 20
BATCH = 256  # windows decoded together
CHUNK = 64  # steps whose emissions are added to the rest at once
TEXT_BYTES = 1 << 24  # texts held as Python objects at a time, so that the windows of each width fill batches; one text more than that alone
SAMPLE_ROWS = 1_500  # texts the labelled windows come from, at most
SAMPLE_WINDOWS = 4  # labelled windows of one text, at most
STEPS = 180  # gradient steps
LEAST = 0.7  # mean probability of the tags of a span

Span = tuple[int, int, int]  # start, end, kind

# ---- rules ------------------------------------------------------------------
# the possessive forms match what the plain ones match, without going back over long runs
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        if i % 2:
            v = 2 * v - 9 * (v > 4)
        total += v
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        last = found.end() if found else at + 1
        if found:
            yield start, last
        at = text.find("@", last)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def rule_spans(text: str) -> list[Span]:
    """Spans of the plain forms, leftmost and without overlaps for each kind; by start, then kind."""
    found = [(s, e, 0) for s, e in _emails(text)]
    if not _DIGIT.search(text):  # the other forms begin with a digit or have one after the plus
        return found
    found += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for pattern, kind, low, high in ((_CARD, 2, 12, 19), (_PHONE, 3, 9, 15)):
        for m in pattern.finditer(text):
            if m.end() - m.start() >= low:
                digits = _NOT_DIGIT.sub("", m.group())
                if low <= len(digits) <= high and (kind == 3 or luhn(digits)):
                    found.append((*m.span(), kind))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


_AT = re.compile(r"\s*(?:@|\(at\)|\[at\])\s*")
_DOT = re.compile(r"\s*(?:\(dot\)|\[dot\]|\[\.\]|\(\.\))\s*|\s+\.\s*|\.\s+")
_PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def valid(kind: int, text: str) -> bool:
    """Whether a found span can be of its kind once its spelling is made plain."""
    if text != text.strip():
        return False
    if kind == 0:
        return bool(_PLAIN_EMAIL.fullmatch(_DOT.sub(".", _AT.sub("@", text))))
    if kind == 1:
        parts = _NOT_DIGIT.sub(" ", text).split()
        return len(parts) == 4 and all(map(_small, parts)) and text[0].isdigit() and text[-1].isdigit()
    digits = _NOT_DIGIT.sub("", text)
    if not digits.isascii() or any(c.isalpha() for c in text) or not text[-1].isdigit():
        return False
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits) and text[0].isdigit()
    return 9 <= len(digits) <= 15 and len(digits) < len(text) and text[0] in "+(0123456789"


# ---- the tagger -------------------------------------------------------------
PAD, CODES = 130, 131
TAGS = 1 + 2 * len(KINDS)  # outside; first character and further characters of each kind


def codes_of(text: str, width: int = WINDOW) -> np.ndarray:
    """ASCII as it is, Latin letters and all else as one code each, filled up to ``width``."""
    out = np.full(width, PAD, np.int64)
    if text.isascii():
        out[:len(text)] = np.frombuffer(text.encode(), np.uint8)
    else:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out[:len(code)] = np.where(code < 128, code, np.where(code < 0x250, 128, 129))
    return out


def tags_of(spans: Iterable[Span], width: int = WINDOW) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for start, end, kind in spans:
        out[max(start, 0):min(end, width)] = 2 + 2 * kind
        if 0 <= start < width:
            out[start] = 1 + 2 * kind
    return out


def _allowed() -> np.ndarray:
    """A further character follows a first or further one of its kind."""
    ok = np.ones((TAGS, TAGS), bool)
    for kind in range(len(KINDS)):
        ok[:, 2 + 2 * kind] = False
        ok[[1 + 2 * kind, 2 + 2 * kind], 2 + 2 * kind] = True
    return ok


ALLOWED = _allowed()


@dataclass
class Tagger:
    """Weights by name; the input weights act on one character each, so a lookup replaces a product."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def new(seed: int = 7, hidden: int = HIDDEN, dtype=np.float32) -> Tagger:
        rng = np.random.default_rng(seed)
        w = {}
        for side in "fb":
            w["W" + side] = rng.normal(0, 0.3, (CODES, 4 * hidden))
            w["U" + side] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            w["c" + side] = np.zeros(4 * hidden)
            w["c" + side][hidden:2 * hidden] = 1  # remember at first
        w["O"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS))
        w["o"] = np.zeros(TAGS)
        w["A"] = np.zeros((TAGS, TAGS))
        return Tagger({k: v.astype(dtype) for k, v in w.items()})

    # forward: codes (T, B) -> emissions (T, B, TAGS)
    def emissions(self, codes: np.ndarray, keep: dict) -> np.ndarray:
        w = self.weights
        ahead = _lstm(w["Wf"][codes] + w["cf"], w["Uf"], keep, "f")
        back = _lstm((w["Wb"][codes] + w["cb"])[::-1], w["Ub"], keep, "b")[::-1]
        keep["both"] = both = np.concatenate([ahead, back], axis=2)
        return both @ w["O"] + w["o"]

    def scores(self, codes: np.ndarray) -> np.ndarray:
        """The emissions, as (T, TAGS, B), without what training keeps: both directions advance together.

        A logistic gate is (1 + tanh(x / 2)) / 2; the halves of the argument are in the tables, states are held doubled.
        A gate's units of one window lie side by side, so that a lookup copies them at once; the gates lie in the order output,
        input, forget, new, and the cell after them, so that one product takes input by new and forget by cell.
        """
        w, (steps, batch) = self.weights, codes.shape
        n, dtype = w["Uf"].shape[0], w["Uf"].dtype
        half, one = dtype.type(0.5), dtype.type(1)

        def gates(x):  # (rows, input, forget, output and new side by side) -> (gates, rows, n)
            return x.reshape(-1, 4, n).transpose(1, 0, 2)[[2, 0, 1, 3]] * np.array([half, half, half, one])[:, None, None]

        table = np.concatenate([gates(w["W" + side] + w["c" + side]) for side in "fb"], axis=1)
        u = np.stack([gates(w["U" + side]) for side in "fb"], axis=1) * half
        weigh = w["O"].reshape(2, n, TAGS) * half
        x, y = _aligned((5, 2, batch, n), dtype), _aligned((4, 2, batch, n), dtype)
        h, part = _aligned((2, batch, n), dtype), _aligned((CHUNK, 2, batch, TAGS), dtype)
        every, logistic, kept, held = x[:4], x[:3], x[1:3], x[3:]
        leave, entered, stayed, _, cell = x
        looked_up = every.reshape(4, 2 * batch, n)
        cell[:], h[:] = 0, 0
        e = np.empty((steps, TAGS, batch), dtype)
        e[:] = w["o"][:, None]
        for first in range(0, steps, CHUNK):
            size, end = min(CHUNK, steps - first), steps - first
            rows = np.empty((size, 2, batch), np.intp)
            rows[:, 0], rows[:, 1] = codes[first:first + size], codes[end - size:end][::-1]
            rows[:, 1] += CODES
            for k, row in enumerate(rows.reshape(size, 2 * batch)):
                table.take(row, axis=1, out=looked_up, mode="clip")
                np.matmul(h, u, out=y)
                np.add(every, y, out=every)
                np.tanh(every, out=every)
                np.add(logistic, one, out=logistic)  # doubled
                np.multiply(kept, held, out=kept)
                np.add(entered, stayed, out=cell)
                np.multiply(cell, half, out=cell)
                np.tanh(cell, out=h)
                np.multiply(h, leave, out=h)
                np.matmul(h, weigh, out=part[k])
            e[first:first + size] += part[:size, 0].transpose(0, 2, 1)
            e[end - size:end] += part[:size, 1][::-1].transpose(0, 2, 1)
        return e

    def transitions(self) -> np.ndarray:
        return np.where(ALLOWED, np.exp(self.weights["A"]), 0)

    def loss(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood per window, and its gradient."""
        keep: dict = {}
        e = self.emissions(codes, keep)
        steps, batch = codes.shape
        w, grad = self.weights, {}
        marginal, pairs, total = _posterior(e, self.transitions(), with_pairs=True)
        row, col = np.arange(steps)[:, None], np.arange(batch)
        path = e[row, col, tags].sum() + w["A"][tags[:-1], tags[1:]].sum()
        de = marginal
        de[row, col, tags] -= 1
        de /= batch
        np.subtract.at(pairs, (tags[:-1].ravel(), tags[1:].ravel()), 1)
        grad["A"] = np.where(ALLOWED, pairs / batch, 0)
        both = keep["both"]
        grad["O"] = np.tensordot(both, de, ([0, 1], [0, 1]))
        grad["o"] = de.sum(axis=(0, 1))
        down = de @ w["O"].T
        hidden = both.shape[2] // 2
        onehot = np.zeros((steps * batch, CODES), both.dtype)
        onehot[np.arange(steps * batch), codes.ravel()] = 1
        for side, own in (("f", down[:, :, :hidden]), ("b", down[::-1, :, hidden:])):
            gates, grad["U" + side] = _lstm_back(own, w["U" + side], keep, side)
            gates = gates if side == "f" else gates[::-1]
            grad["W" + side] = onehot.T @ gates.reshape(steps * batch, -1)
            grad["c" + side] = gates.sum(axis=(0, 1))
        return float((total - path) / batch), grad

    def decode(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags (T, B) for emissions (T, B, TAGS), and the probability of each."""
        best = viterbi(e, np.where(ALLOWED, self.weights["A"], -1e9))
        marginal, _, _ = _posterior(e, self.transitions())
        return best, np.take_along_axis(marginal, best[:, :, None], axis=2)[:, :, 0]


def _aligned(shape: tuple[int, ...], dtype: np.dtype) -> np.ndarray:
    """Empty array that starts at a multiple of 64 bytes, where vector instructions are fastest."""
    size = int(np.prod(shape)) * dtype.itemsize
    room = np.empty(size + 64, np.uint8)
    skip = -room.ctypes.data % 64
    return room[skip:skip + size].view(dtype).reshape(shape)


def _lstm(gates: np.ndarray, u: np.ndarray, keep: dict | None, side: str) -> np.ndarray:
    steps, batch, four = gates.shape
    n = four // 4
    h, c = np.zeros((batch, n), gates.dtype), np.zeros((batch, n), gates.dtype)
    out = np.empty((steps, batch, n), gates.dtype)
    cells, acts = [], []
    for t in range(steps):
        a = gates[t] + h @ u
        a[:, :3 * n] *= 0.5
        np.tanh(a, out=a)
        a[:, :3 * n] += 1
        a[:, :3 * n] *= 0.5  # input, forget and output gate; the last quarter is the candidate
        c = a[:, n:2 * n] * c + a[:, :n] * a[:, 3 * n:]
        curved = np.tanh(c)
        h = a[:, 2 * n:3 * n] * curved
        out[t] = h
        if keep is not None:
            cells.append((c, curved))
            acts.append(a)
    if keep is not None:
        keep[side] = (out, cells, acts)
    return out


def _lstm_back(down: np.ndarray, u: np.ndarray, keep: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    out, cells, acts = keep[side]
    steps, batch, n = down.shape
    gates = np.empty((steps, batch, 4 * n), down.dtype)
    du = np.zeros_like(u)
    dh, dc = np.zeros((batch, n), down.dtype), np.zeros((batch, n), down.dtype)
    for t in reversed(range(steps)):
        a, (_, curved) = acts[t], cells[t]
        i, f, o, g = a[:, :n], a[:, n:2 * n], a[:, 2 * n:3 * n], a[:, 3 * n:]
        dh = dh + down[t]
        dc = dc + dh * o * (1 - curved * curved)
        d = gates[t]
        d[:, :n] = dc * g * i * (1 - i)
        d[:, n:2 * n] = dc * (cells[t - 1][0] if t else 0) * f * (1 - f)
        d[:, 2 * n:3 * n] = dh * curved * o * (1 - o)
        d[:, 3 * n:] = dc * i * (1 - g * g)
        if t:
            du += out[t - 1].T @ d
        dh, dc = d @ u.T, dc * f
    return gates, du


def _posterior(e: np.ndarray, trans: np.ndarray, with_pairs: bool = False):
    """Tag probabilities, summed pair probabilities and the summed log of the partition function."""
    steps, batch, k = e.shape
    top = e.max(axis=2, keepdims=True)
    x = np.exp(e - top)
    ahead, scale = np.empty_like(x), np.empty((steps, batch, 1), x.dtype)
    for t in range(steps):
        a = x[t] if t == 0 else (ahead[t - 1] @ trans) * x[t]
        scale[t] = a.sum(axis=1, keepdims=True)
        ahead[t] = a / scale[t]
    back = np.ones((batch, k), x.dtype)
    marginal = np.empty_like(x)
    pairs = np.zeros((k, k), x.dtype)
    for t in reversed(range(steps)):
        marginal[t] = ahead[t] * back
        if t:
            right = x[t] * back / scale[t]
            if with_pairs:
                pairs += ahead[t - 1].T @ right
            back = right @ trans.T
    return marginal, pairs * trans, float(np.log(scale.astype(np.float64)).sum() + top.astype(np.float64).sum())


def may_hold(e: np.ndarray, a: np.ndarray) -> np.ndarray:
    """For each window of ``e`` (T, TAGS, B) whether its best path may hold a span; False is certain.

    A span gains over the outside what its tags and the changes between them gain. The largest such gain
    of a span that ends at a step follows from that of the step before; changes count as the largest of their sort.
    """
    rel = np.where(ALLOWED, a - a[0, 0], -np.inf)
    enter, stay, leave = max(rel[:, 1::2].max(), 0), rel[:, 2::2].max(), max(rel[1:, 0].max(), 0)
    enter, stay = e.dtype.type(enter), e.dtype.type(stay)
    gain = np.maximum(e[0, 1::2] + enter, e[0, 2::2]) - e[0, :1]  # a window may start inside a span
    most = gain
    for first in range(1, len(e), CHUNK):
        part = e[first:first + CHUNK]
        begun, going = part[:, 1::2] - part[:, :1], part[:, 2::2] - part[:, :1]
        begun += enter
        going += stay
        for own, more in zip(begun, going):
            np.add(more, gain, out=more)
            gain = np.maximum(own, more, out=own)
        most = np.maximum(most, begun.max(axis=0))
    return most.max(axis=0) + leave > -0.01  # far above the rounding of these sums


def viterbi(e: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Path of largest score for each column of ``e``."""
    steps, batch, k = e.shape
    back = np.empty((steps, batch, k), np.int8)
    score = e[0]
    for t in range(1, steps):
        both = score[:, :, None] + trans
        back[t] = both.argmax(axis=1)
        score = both.max(axis=1) + e[t]
    path = np.empty((steps, batch), np.int64)
    path[-1] = score.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[t - 1] = back[t][np.arange(batch), path[t]]
    return path


def train(codes: np.ndarray, tags: np.ndarray, *, steps: int = STEPS, batch: int = 40, rate: float = 0.02,
          seed: int = 7) -> Tagger:
    """Adam on batches of windows (rows of ``codes`` and ``tags``), drawn in a fixed order."""
    model, rng = Tagger.new(seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    order = np.empty(0, np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(codes))])
        pick, order = order[:batch], order[batch:]
        _, grad = model.loss(codes[pick].T, tags[pick].T)
        size = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        clip, now = min(1.0, 5.0 / max(size, 1e-9)), rate * (0.05 + 0.95 * (1 - step / steps))
        for k, g in grad.items():
            g = g * g.dtype.type(clip)
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            model.weights[k] -= (now * (first[k] / (1 - 0.9 ** step)) / (
                np.sqrt(second[k] / (1 - 0.99 ** step)) + 1e-8)).astype(g.dtype)
    return model


# ---- labelled windows -------------------------------------------------------
def _number(rnd: random.Random, n: int) -> str:
    return "".join(str(rnd.randrange(10)) for _ in range(n))


def _card(rnd: random.Random) -> str:
    head = str(rnd.choice((3, 4, 5, 6))) + _number(rnd, 14)
    return next(head + str(d) for d in range(10) if luhn(head + str(d)))


def written_loosely(kind: int, plain: str, rnd: random.Random) -> str:
    """The same data in a spelling that the rules may miss."""
    if kind == 0:
        local, _, host = plain.partition("@")
        at = rnd.choice((" @ ", "(at)", "[at]", " (at) ", " [at] ", "@"))
        dot = rnd.choice(("[.]", "(dot)", "[dot]", " [dot] ")) if at == "@" or rnd.random() < 0.4 else "."
        return local + at + host.replace(".", dot)
    if kind == 1:
        return plain.replace(".", rnd.choice(("[.]", "(.)", " . ", "[dot]", ". ")))
    digits = _NOT_DIGIT.sub("", plain)
    if kind == 2:
        return rnd.choice((".", "/", "_", " - ", "  ")).join(digits[i:i + 4] for i in range(0, len(digits), 4))
    a, b, c = digits[-10:-7] or "030", digits[-7:-4], digits[-4:]
    return rnd.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"{a} {b} {c}",
                       f"+1/{a}/{b}-{c}", f"1 ({a}) {b}-{c}"))


def _plain(kind: int, rnd: random.Random, words: list[str]) -> str:
    if kind == 0:
        name = re.sub("[^A-Za-z]", "", rnd.choice(words)) or "name"
        return f"{name.lower()}.{rnd.randrange(100)}@{rnd.choice(('mail', 'post', 'web'))}{rnd.randrange(10)}.example.{rnd.choice(('com', 'org', 'net'))}"
    if kind == 1:
        return ".".join(str(rnd.randrange(256)) for _ in range(4))
    return _card(rnd) if kind == 2 else f"+{rnd.randrange(1, 99)} ({_number(rnd, 3)}) {_number(rnd, 3)}-{_number(rnd, 4)}"


def _decoy(rnd: random.Random) -> str:
    """Digits that are no personal data."""
    return rnd.choice((
        f"20{_number(rnd, 2)}-0{rnd.randrange(1, 9)}-{rnd.randrange(10, 28)}", f"{rnd.randrange(24)}:{rnd.randrange(10, 60)}:{rnd.randrange(10, 60)}",
        f"{rnd.randrange(1, 99)}.{rnd.randrange(10)}.{rnd.randrange(10)}", f"{rnd.randrange(1, 999)},{_number(rnd, 3)}.{_number(rnd, 2)}",
        _number(rnd, rnd.randrange(1, 9)), f"{rnd.randrange(1, 99)}%", "%032x" % rnd.getrandbits(128), f"v{rnd.randrange(9)}.{rnd.randrange(20)}",
        f"{rnd.randrange(1, 31)}/{rnd.randrange(1, 12)}/{rnd.randrange(1950, 2030)}", f"@{_number(rnd, 2)}", f"{rnd.randrange(100, 999)}-{rnd.randrange(100, 999)}",
        f"#{_number(rnd, 6)}", f"{_number(rnd, 2)} {_number(rnd, 3)}", f"978-{_number(rnd, 1)}-{_number(rnd, 2)}-{_number(rnd, 6)}-{_number(rnd, 1)}"))


def enriched(windows: list[tuple[str, list[Span]]], seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Each labelled window as it is, and twice with its spans (or a word) replaced by loose spellings or decoys."""
    rnd, out = random.Random(seed), []
    for text, spans in windows:
        out.append((text, spans))
        words = text.split()
        for _ in range(2):
            places = [s for s in spans if s[0] >= 0 and s[1] <= len(text)]
            if not places and words:
                m = rnd.choice(list(re.finditer(r"\S+", text)))
                places = [(*m.span(), -1)]
            made, moved, at = [], [], 0
            for start, end, kind in places:
                if start < at:
                    continue
                kind = rnd.randrange(4) if kind < 0 or rnd.random() < 0.3 else kind
                made.append(text[at:start])
                begin = sum(map(len, made))
                if rnd.random() < 0.3:
                    made.append(_decoy(rnd))
                else:
                    plain = _plain(kind, rnd, words or ["name"])
                    made.append(written_loosely(kind, plain, rnd) if rnd.random() < 0.8 else plain)
                    moved.append((begin, begin + len(made[-1]), kind))
                at = end
            made.append(text[at:])
            whole = "".join(made)
            cut = rnd.randrange(max(len(whole) - WINDOW, 0) + 1)
            piece = whole[cut:cut + WINDOW]
            out.append((piece, [(s - cut, e - cut, k) for s, e, k in moved if s < cut + len(piece) and e > cut]))
    return out


def labelled_windows(text: str, spans: list[Span], most: int = SAMPLE_WINDOWS) -> list[tuple[str, list[Span]]]:
    """Up to ``most`` windows around spans and, after them, around other digits."""
    middle = [(s + e) // 2 for s, e, _ in spans] + [m.start() for m in re.finditer(r"[0-9]+", text)]
    out, taken = [], []
    for at in middle:
        start = max(0, min(at - WINDOW // 2 + at % 31 - 15, len(text) - WINDOW))
        if all(abs(start - x) >= STRIDE for x in taken):
            taken.append(start)
            out.append((text[start:start + WINDOW], [
                (s - start, e - start, k) for s, e, k in spans if s < start + WINDOW and e > start]))
            if len(out) >= most:
                break
    return out


_LABELLED = "window string, spans array<struct<start:int,end:int,kind:int>>"


def sampled(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS) -> list[tuple[str, list[Span]]]:
    """Labelled windows of at most ``sample_rows`` different texts with digits, drawn by a hash of the text.

    The rules label them. The bounds are ``sample_rows`` and SAMPLE_WINDOWS; only windows reach the driver.
    """
    own, texts = F.xxhash64("text"), docs.select(F.col("text").cast("string").alias("text"))
    # most texts fail the plain class, which is faster than the choice
    digits = F.col("text").rlike("[0-9@]") & F.col("text").rlike(r"@|\+[0-9]|[0-9]{3}")
    least = [r[0] for r in texts.where(digits).select(own.alias("h")).distinct().orderBy("h").limit(sample_rows).collect()]
    if not least:
        return []

    def run(batches):
        for batch in batches:
            found = [w for text in batch.column(0).to_pylist() for w in labelled_windows(text, rule_spans(text))]
            yield pa.RecordBatch.from_pylist(
                [{"window": w, "spans": [{"start": s, "end": e, "kind": k} for s, e, k in spans]} for w, spans in found],
                pa.schema([("window", pa.string()), ("spans", pa.list_(pa.struct(
                    [("start", pa.int32()), ("end", pa.int32()), ("kind", pa.int32())])))]))

    windows = texts.where((own <= max(least)) & digits).mapInArrow(run, _LABELLED).distinct()
    return sorted((r[0], [tuple(s) for s in r[1]]) for r in windows.collect())


def fit(docs: DataFrame, *, sample_rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Tagger | None:
    """Tagger trained on a bounded sample of ``docs`` (see ``sampled``) and loose spellings of it; None without any."""
    windows = enriched(sampled(docs, sample_rows=sample_rows))
    return fitted(windows, steps=steps) if windows else None


def fitted(windows: list[tuple[str, list[Span]]], *, steps: int = STEPS) -> Tagger:
    """Tagger trained on windows with their spans."""
    return train(np.stack([codes_of(t) for t, _ in windows]), np.stack([tags_of(s) for _, s in windows]), steps=steps)


# ---- whole texts ------------------------------------------------------------
def windows_of(length: int) -> list[tuple[int, int]]:
    """(start, width) of windows that cover a text and overlap by STRIDE at least."""
    starts = range(0, max(length - STRIDE, 1), WIDE - STRIDE) if length else ()
    return [(s, min(WIDE, -(-(length - s) // WINDOW) * WINDOW)) for s in starts]


def wider(start: int, end: int, width: int, length: int) -> set[tuple[int, int]]:
    """The windows of twice the width, each half over the next, that hold a place from ``start`` to ``end``."""
    if 2 * width >= length:
        return {(0, length)}
    return {(max(k, 0) * width, 2 * width) for k in range(start // width - 1, (end - 1) // width + 1)}


def _may_grow(kind: int, text: str) -> bool:
    """Whether a piece may belong to a longer valid span: numbers end at some count of digits or parts."""
    numbers = _NOT_DIGIT.sub(" ", text).split()
    if kind < 2:
        return kind == 0 or len(numbers) <= 4
    return sum(map(len, numbers)) <= (19 if kind == 2 else 15) and not any(c.isalpha() for c in text)


def spans_in(tags: np.ndarray, sure: np.ndarray) -> Iterator[tuple[Span, float]]:
    """Spans of a tag sequence with the mean probability of their tags."""
    at = 0
    while at < len(tags):
        if tags[at] == 0:
            at += 1
            continue
        kind, end = (tags[at] - 1) // 2, at + 1
        while end < len(tags) and tags[end] == 2 + 2 * kind:
            end += 1
        yield (at, end, int(kind)), float(sure[at:end].mean())
        at = end


def reconciled(spans: list[tuple[Span, float]]) -> list[Span]:
    """The spans without overlaps whose weights (probability times length) add up to the most."""
    best: dict[Span, float] = {}
    for span, sure in spans:
        best[span] = max(best.get(span, 0.0), sure)
    rows = sorted(best, key=lambda s: (s[1], s[0], s[2]))
    ends = [s[1] for s in rows]
    total, take = [0.0], []
    for i, (start, end, kind) in enumerate(rows):
        before = int(np.searchsorted(ends[:i], start, "right"))
        gain = total[before] + best[(start, end, kind)] * (end - start)
        take.append((gain > total[-1], before))
        total.append(max(gain, total[-1]))
    out, i = [], len(rows)
    while i:
        chosen, before = take[i - 1]
        if chosen:
            out.append(rows[i - 1])
        i = before if chosen else i - 1
    return out[::-1]


def added(model: Tagger, texts: list[str], rules: list[list[Span]], batch: int = BATCH) -> list[list[Span]]:
    """Spans that the tagger finds besides those of the rules, for each text."""
    codes = [codes_of(text, len(text)).astype(np.uint8) for text in texts]
    found: list[list[tuple[Span, float]]] = [[] for _ in texts]
    todo = {(i, s, w) for i, text in enumerate(texts) for s, w in windows_of(len(text))}
    while todo:
        again = set()
        for i, start, width, a, b, kind, p in _decoded(model, codes, todo, batch):
            text = texts[i]
            end = min(start + width, len(text))
            a, b = start + a, min(start + b, end)
            if a == start > 0 or b == end < len(text):  # cut; a span shorter than the overlap is whole in another window
                if b - a >= (STRIDE if width <= WIDE else width // 2) and _may_grow(kind, text[a:b]):
                    again.update((i, *w) for w in wider(a, b, max(width, WIDE), len(text)))
            elif p >= LEAST and valid(kind, text[a:b]):
                found[i].append(((a, b, kind), p))
        todo = again
    return [reconciled(_free(spans, own)) for spans, own in zip(found, rules)]


def _decoded(model: Tagger, codes: list[np.ndarray], windows: set[tuple[int, int, int]], batch: int) -> Iterator[tuple]:
    """(text, start, width, a, b, kind, probability) of the spans in windows (text, start, width); a and b count from start."""
    rows, at, held = sorted(windows, key=lambda x: (x[2], x[0], x[1])), 0, []
    while at < len(rows):
        width = rows[at][2]
        most = max(1, batch * WIDE // width)
        part = [x for x in rows[at:at + most] if x[2] == width]
        at += len(part)
        block = np.full((len(part), width), PAD, np.uint8)
        for j, (i, start, _) in enumerate(part):
            piece = codes[i][start:start + width]
            block[j, :len(piece)] = piece
        e = model.scores(np.ascontiguousarray(block.T))
        some = np.flatnonzero(may_hold(e, model.weights["A"])).tolist()
        held += [(part[j], e[:, :, j].copy()) for j in some]
        # the few that may hold a span are decoded together
        if held and (len(held) >= most or at == len(rows) or rows[at][2] != width):
            tags, sure = model.decode(np.stack([x for _, x in held], axis=1))
            for j in np.flatnonzero((tags > 0).any(axis=0)).tolist():
                for (a, b, kind), p in spans_in(tags[:, j], sure[:, j]):
                    yield *held[j][0], a, b, kind, p
            held = []


def _free(spans: list[tuple[Span, float]], rules: list[Span]) -> list[tuple[Span, float]]:
    """Those of ``spans`` that overlap none of ``rules`` (by start)."""
    starts = [r[0] for r in rules]
    reach = list(accumulate((r[1] for r in rules), max, initial=0))  # where those before end
    return [x for x in spans if reach[bisect_left(starts, x[0][1])] <= x[0][0]]


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices with about TEXT_BYTES of text."""
    part = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64) // TEXT_BYTES
    ends = [*(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for start, end in zip([0, *ends], ends):
        yield batch.slice(start, end - start)


SPANS = "array<struct<start:int,end:int,kind:string,rule:boolean>>"


def find(docs: DataFrame, model: Tagger | None) -> DataFrame:
    """doc_id and spans (start, end, kind, rule), by start, then kind; places count code points, ends are exclusive."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = T.StructType([rows.schema["doc_id"], T.StructField("spans", T._parse_datatype_string(SPANS))])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(out)
        for batch in (piece for b in batches for piece in _pieces(b)):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            rules = [rule_spans(t) if t else [] for t in texts]
            more = added(model, texts, rules) if model else [[] for _ in texts]
            spans = [[{"start": s, "end": e, "kind": KINDS[k], "rule": rule} for s, e, k, rule in sorted(
                [(*x, True) for x in own] + [(*x, False) for x in new], key=lambda x: (x[0], x[2], x[1]))]
                for own, new in zip(rules, more)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, schema[1].type)], schema=schema)

    return rows.mapInArrow(run, out)


def summary(found: DataFrame) -> DataFrame:
    """Numbers of the rules' spans by kind, the digest of their list, and the list of all spans."""
    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat(
            s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")

    rules = F.filter("spans", lambda s: s["rule"])

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["rule"] & (s["kind"] == kind))).cast("bigint")

    counts = [number(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed(rules), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
