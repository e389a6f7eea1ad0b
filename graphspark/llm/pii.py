"""Personal data: fixed base patterns plus a character-level bidirectional LSTM with CRF transitions.

The base patterns give emails, IP addresses, card and phone numbers. The sequence model, trained in numpy on
labelled spans, adds spans in notations that the patterns don't know (spaced or bracketed emails, phone numbers
without a plus, cards with other separators, ...). Its training windows are prose with spans and look-alikes put in,
the prose being a bounded sample of the table's own. Every text is covered by overlapping windows and each is decoded,
whatever it holds; a span is taken from the window that holds it whole, one that touches an inner edge is decoded
anew in a wider window around it, and overlapping spans are reconciled over the whole text by weighted interval
scheduling. Taken are spans whose score, the mean margin of their tags over "O", reaches MARGIN; what a character model
cannot count is checked exactly: cards pass Luhn, the four parts of an address are at most 255, a phone number has 9 to
15 digits, an email an at and a dot, as signs or words.

A window needs no backtracking if a bound over fewer tags proves that no path beats the one without spans.

Defined cases: null and empty texts have no spans; texts of any length are covered whole; repeated rows and null
ids each give a row; an empty table gives no rows, and trains on invented prose; extra columns are ignored; equal
scores go to the earlier span.
"""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphspark.llm.common import plain, small_batches, texts_of

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, str]

_LOCAL_CHAR = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit before cannot help: a run of digits matches from its start or not at all.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by kind as in KINDS, then start: (start, end, kind) in code points."""
    found: list[Span] = []
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHAR:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append((start, m.end(), "email"))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                found.append((*m.span(), "card"))
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


# --- the sequence model -------------------------------------------------------------------------------------------

#: Windows: characters and step; a span of up to WIDTH - STEP characters lies whole in some window.
WIDTH, STEP = 384, 336
#: Windows that are decoded at a time, and the widest window around a span that touches an edge.
AT_ONCE, WIDEST = 1024, 3072
#: The least score of a span.
MARGIN = 0.0
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]


def char_codes(text: str) -> np.ndarray:
    """ASCII from space to ~ as 1-95, other white space 96, other letters 97, the rest 98; 0 pads."""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    out = np.where((a >= 32) & (a < 127), a - 31, np.where((a >= 9) & (a <= 13), 96, np.where(a >= 192, 97, 98)))
    return out.astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


class Tagger:
    """Embedding, one LSTM in each direction, a linear layer to tags and CRF transitions; all arrays are numpy's."""

    def __init__(self, dim: int = 12, hidden: int = 12, seed: int = 7) -> None:
        r, n = np.random.default_rng(seed), len(TAGS)
        self.h = hidden
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"E": init(99, dim) * 2, "V": init(2 * hidden, n), "c": np.zeros(n, np.float32), "T": np.zeros((n, n), np.float32), "S": np.zeros(n, np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": init(dim + hidden, 4 * hidden), f"g{d}": np.repeat(np.float32([0, 1, 0, 0]), hidden)}
        self.barred = np.zeros((n, n), np.float32)
        for i, a in enumerate(TAGS):
            for j, b in enumerate(TAGS):
                if b[0] == "I" and a[2:] != b[2:]:
                    self.barred[i, j] = -1e4
        self.barred_start = np.float32([-1e4 if t[0] == "I" else 0 for t in TAGS])

    def _lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        (n, steps, _), h = x.shape, self.h
        w, g = self.p[f"W{d}"], self.p[f"g{d}"]
        hid, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, memo = np.zeros((n, steps, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            xh = np.concatenate([x[:, t], hid], 1)
            a = xh @ w + g
            i, f, o, u = _sigmoid(a[:, :h]), _sigmoid(a[:, h : 2 * h]), _sigmoid(a[:, 2 * h : 3 * h]), np.tanh(a[:, 3 * h :])
            old, cell = cell, f * cell + i * u
            th = np.tanh(cell)
            hid = o * th
            out[:, t] = hid
            memo.append((t, xh, i, f, o, u, old, th))
        return out, memo

    def _lstm_back(self, memo: list, dout: np.ndarray, d: str, grad: dict) -> np.ndarray:
        n, steps, h = dout.shape
        w = self.p[f"W{d}"]
        dx = np.zeros((n, steps, w.shape[0] - h), np.float32)
        dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        for t, xh, i, f, o, u, old, th in reversed(memo):
            dh = dh + dout[:, t]
            dc = dc + dh * o * (1 - th * th)
            da = np.concatenate([dc * u * i * (1 - i), dc * old * f * (1 - f), dh * th * o * (1 - o), dc * i * (1 - u * u)], 1)
            grad[f"W{d}"] += xh.T @ da
            grad[f"g{d}"] += da.sum(0)
            back = da @ w.T
            dx[:, t], dh, dc = back[:, :-h], back[:, -h:], dc * f
        return dx

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        x = self.p["E"][codes]
        (hf, mf), (hb, mb) = self._lstm(x, "f"), self._lstm(x, "b")
        both = np.concatenate([hf, hb], 2)
        return both @ self.p["V"] + self.p["c"], (both, mf, mb)

    def loss_and_grad(self, codes: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tag sequences, and its gradient."""
        em, (both, mf, mb) = self.emissions(codes)
        n, steps, k = em.shape
        trans, start = self.p["T"] + self.barred, self.p["S"] + self.barred_start
        alpha, beta = np.zeros_like(em), np.zeros_like(em)
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha[:, 0] = start + em[:, 0]
        for t in range(1, steps):
            alpha[:, t] = lse(alpha[:, t - 1, :, None] + trans, 1) + em[:, t]
        for t in range(steps - 2, -1, -1):
            beta[:, t] = lse(trans + (em[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = lse(alpha[:, -1], 1)
        rows = np.arange(n)
        gold = start[tags[:, 0]] + em[rows[:, None], np.arange(steps), tags].sum(1) + trans[tags[:, :-1], tags[:, 1:]].sum(1)
        marg = np.exp(alpha + beta - z[:, None, None])
        dem = marg.copy()
        dem[rows[:, None], np.arange(steps), tags] -= 1
        grad = {key: np.zeros_like(v) for key, v in self.p.items()}
        for t in range(steps - 1):
            grad["T"] += np.exp(alpha[:, t, :, None] + trans + (em[:, t + 1] + beta[:, t + 1] - z[:, None])[:, None, :]).sum(0)
        np.subtract.at(grad["T"], (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
        grad["S"] = dem[:, 0].sum(0)
        grad["V"], grad["c"] = both.reshape(n * steps, -1).T @ dem.reshape(n * steps, k), dem.sum((0, 1))
        dboth = dem @ self.p["V"].T
        dx = self._lstm_back(mf, dboth[:, :, : self.h], "f", grad) + self._lstm_back(mb, dboth[:, :, self.h :], "b", grad)
        np.add.at(grad["E"], codes, dx)
        return float((z - gold).mean()), {key: v / n for key, v in grad.items()}

    def fit(self, codes: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 64, rate: float = 0.025) -> None:
        """Adam with a falling rate; the result is the mean of the weights over the last quarter of the steps."""
        r, m, v, step = np.random.default_rng(1), {}, {}, 0
        total, mean = epochs * -(-len(codes) // batch), {}
        for epoch in range(epochs):
            order = r.permutation(len(codes))
            for lo in range(0, len(order), batch):
                _, grad = self.loss_and_grad(codes[order[lo : lo + batch]], tags[order[lo : lo + batch]])
                step += 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
                for key, g in grad.items():
                    g = g * min(1, 5 / (norm + 1e-9))
                    m[key] = 0.9 * m.get(key, 0) + 0.1 * g
                    v[key] = 0.99 * v.get(key, 0) + 0.01 * g * g
                    lr = rate * max(0.05, 1 - step / total)
                    self.p[key] -= (lr * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                    if 4 * step > 3 * total:
                        mean[key] = mean.get(key, 0) + self.p[key].astype(np.float64)
        if mean:
            self.p = {key: (x / (total - 3 * total // 4)).astype(np.float32) for key, x in mean.items()}

    def tables(self) -> tuple[dict, np.ndarray, np.ndarray]:
        """What decoding needs of each direction, (weights of a character's embedding, twice the state and a one; output
        weights of twice the state), with the sigmoid's factor put in; the transitions; and their gain at a start."""
        h, by = self.h, {}
        scale = np.repeat(np.float32([0.5, 0.5, 0.5, 1]), h)[:, None]
        for k, d in enumerate("fb"):
            w = np.concatenate([self.p[f"W{d}"][:-h], 0.5 * self.p[f"W{d}"][-h:], self.p[f"g{d}"][None]]).T
            by[d] = np.ascontiguousarray(scale * w), np.ascontiguousarray(0.5 * self.p["V"][k * h : (k + 1) * h].T)
        return by, self.p["T"] + self.barred, self.p["S"] + self.barred_start

    def fast_emissions(self, codes: np.ndarray) -> np.ndarray:
        """The emissions (steps, tags, windows) of codes (windows, steps)."""
        by, _, _ = self.tables()
        n, steps = codes.shape
        h, across = self.h, np.ascontiguousarray(codes.T)
        em = np.empty((steps, len(TAGS), n), np.float32)
        em[:] = self.p["c"][:, None]
        gates, cell, new = (np.empty((k * h, n), np.float32) for k in (4, 1, 1))
        # the embedding (fewer rows to gather than the gates have), the state and a one for the bias: one product
        embedding = np.ascontiguousarray(self.p["E"].T)
        dim = len(embedding)
        given, part = np.ones((dim + h + 1, n), np.float32), np.empty((len(TAGS), n), np.float32)
        letter, state = given[:dim], given[dim:-1]
        for d in "fb":
            weights, out = by[d]
            cell[:] = 0
            state[:] = 0
            for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
                np.take(embedding, across[t], axis=1, out=letter, mode="clip")
                np.matmul(weights, given, out=gates)
                np.tanh(gates, out=gates)
                gates[: 3 * h] += 1  # twice the sigmoids; cell and state are held twofold, too
                cell *= gates[h : 2 * h]
                cell *= 0.5
                np.multiply(gates[:h], gates[3 * h :], out=new)
                cell += new
                np.multiply(cell, 0.5, out=new)
                np.tanh(new, out=new)
                np.multiply(gates[2 * h : 3 * h], new, out=state)
                np.matmul(out, state, out=part)
                em[t] += part
        return em

    def decode(self, codes: np.ndarray, lengths: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
        """Best tag sequence of each window as spans with a score: the mean margin of the tags over "O"."""
        _, trans, start = self.tables()
        em = self.fast_emissions(codes)
        open_ = np.flatnonzero(_may_hold(em, lengths, trans, start))
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(len(codes))]
        if len(open_):
            for i, spans in zip(open_, _viterbi(np.ascontiguousarray(em[:, :, open_]), lengths[open_], trans, start[:, None])):
                out[i] = spans
        return out


def _may_hold(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether some path may beat the one without spans, by a bound: paths over three tags, "O", the best of "B" and the
    best of "I" at each place, with the best transition between each two, score as much as any path or more. All
    scores are relative to those of the path of "O" alone."""
    kinds = {"b": slice(1, None, 2), "i": slice(2, None, 2)}
    far = np.arange(len(em))[:, None] >= lengths
    gain = {k: em[:, at].max(1) - em[:, 0] for k, at in kinds.items()}
    for g in gain.values():
        g[far] = -1e9
    way = {x + y: np.float32(trans[kinds.get(x, slice(0, 1)), kinds.get(y, slice(0, 1))].max() - trans[0, 0]) for x in "obi" for y in "obi"}
    b, i, o = gain["b"][0] + (start[1::2].max() - start[0]), np.full(len(lengths), -1e9, np.float32), np.zeros(len(lengths), np.float32)
    top = np.maximum(b, i)
    for t in range(1, len(em)):
        into_o = np.maximum(o, np.maximum(b + way["bo"], i + way["io"]))
        into_i = np.maximum(b + way["bi"], i + way["ii"])
        b = np.maximum(np.maximum(b + way["bb"], i + way["ib"]), o + way["ob"]) + gain["b"][t]
        i = into_i + gain["i"][t]
        o = into_o
        np.maximum(top, b, out=top)
        np.maximum(top, i, out=top)
    return (o > 0) | (top > 0)


def _viterbi(em: np.ndarray, lengths: np.ndarray, trans: np.ndarray, start: np.ndarray) -> list[list[tuple[int, int, str, float]]]:
    """The spans on the best path of each window; em is (steps, tags, windows), start (tags, windows)."""
    steps, k, n = em.shape
    score = np.empty_like(em)
    score[0] = start + em[0]
    ways, best = np.empty((k, k, n), em.dtype), np.empty((k, n), em.dtype)
    for t in range(1, steps):
        np.add(score[t - 1][:, None], trans[:, :, None], out=ways)
        np.maximum.reduce(ways, axis=0, out=best)
        np.add(best, em[t], out=score[t])
    path, tag = np.zeros((steps, n), np.int64), np.zeros(n, np.int64)
    for t in range(steps - 1, -1, -1):
        last, inside = lengths == t + 1, lengths > t + 1
        if last.any():
            tag[last] = score[t][:, last].argmax(0)
        if inside.any():
            tag[inside] = (score[t] + trans[:, tag])[:, inside].argmax(0)
        path[t] = np.where(last | inside, tag, 0)
    out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(n)]
    for i in np.flatnonzero(path.any(0)):
        row, e = path[:, i], 0
        for t in np.flatnonzero(row).tolist():
            if t < e:
                continue
            e = t + 1
            while e < lengths[i] and row[e] and TAGS[row[e]][0] == "I":
                e += 1
            at = np.arange(t, e)
            out[i].append((t, e, TAGS[row[t]][2:], float(np.mean(em[at, row[t:e], i] - em[at, 0, i]))))
    return out


# --- labelled spans -----------------------------------------------------------------------------------------------

# Syllables of the invented filler prose.
_SYLLABLES = "the and ing tion er re on an es ci ado mente la que os le ment aux é è un ver ich sch en der und ge ß ü th ha to st of in is was".split()


def _word(r: random.Random) -> str:
    w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))
    return (w.capitalize() if r.random() < 0.15 else w) + r.choice(["", "", "", "", ",", "."])


def _luhn_card(r: random.Random) -> str:
    d = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(r.choice([13, 14, 14, 14])))
    return next(d + c for c in "0123456789" if luhn(d + c))


def _group(s: str, size: int, sep: str) -> str:
    return sep.join(s[i : i + size] for i in range(0, len(s), size))


def _entity(r: random.Random) -> tuple[str, str]:
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    name = lambda: "".join(r.choice("abcdefghiklmnoprst") for _ in range(r.randint(3, 8)))
    kind = r.choice(("email", *KINDS))  # the kind with most notations comes more often
    if kind == "email":
        local, host, top = name() + r.choice(["", "." + num(2), "." + name(), "_" + name()]), name() + r.choice(["", num(1)]), r.choice(["com", "org", "net", "example.com", "de", "fr"])
        at, dot = r.choice([("@", "."), ("@", "."), (" @ ", "."), (" @ ", " . "), (" [at] ", "."), (" (at) ", " (dot) "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", ".")])
        return kind, local + at + (host + "." + top).replace(".", dot)
    if kind == "ip":
        return kind, r.choice([".", ".", "[.]", " . "]).join(str(r.randint(1, 255)) for _ in range(4))
    if kind == "card":
        c = _luhn_card(r)
        return kind, r.choice([c, c, _group(c, 4, " "), _group(c, 4, "-"), _group(c, 4, "."), _group(c, 4, "/"), _group(c, 4, "  ")])
    a, b, c = num(3), num(3), num(4)
    return kind, r.choice([f"+1 ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{num(2)} {num(3)} {num(7)}", f"00{num(2)} {num(3)} {num(6)}", f"0{num(3)} {num(7)}", f"1-{a}-{b}-{c}", f"+{num(2)}/{num(3)}/{num(6)}"])


def _decoy(r: random.Random) -> str:
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    if r.random() < 0.2:  # a word over and over
        return r.choice([" ", ". ", ", "]).join([r.choice([_word(r), r.choice(_SYLLABLES)])] * r.randint(3, 40))
    return r.choice([f"{r.randint(1, 30)}.", f"{r.randint(1, 9)}.{r.randint(0, 9)}.", f"{r.randint(1, 9)}.{r.randint(0, 9)}.{r.randint(0, 9)}", f"{r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}", f"{r.randint(1, 28)}/{r.randint(1, 12)}/{r.randint(1990, 2030)}", f"{r.randint(10, 23)}:{num(2)}:{num(2)}", "AKIA" + num(3) + "XQ" + num(2) + "ZKD", f"password={hexa(18)}", f'"{hexa(40)}"', num(r.randint(1, 8)), f"{num(2)},{num(3)},{num(3)}", f"{num(3)}.{num(2)}", f"@{_word(r)}", f"x{num(5)}", f"({num(2)})", f"{num(20)}", f"{num(3)} {num(2)} {num(1)}", f"[{num(1)}]", f"#{num(4)}"])


def shapes(text: str) -> list[Span]:
    """The spans that look like one of the kinds by the base patterns, whatever their numbers' sums and sizes."""
    found = [x for x in base_spans(text) if x[2] in ("email", "phone")]
    found += [(*m.span(), "ip") for m in _IP.finditer(text)]
    found += [(*m.span(), "card") for m in _CARD.finditer(text) if 13 <= len(_DIGIT.findall(m[0])) <= 19]
    return found


def _prose(r: random.Random, carriers: list[str]) -> str:
    """Some prose: a stretch of a carrier text, else invented."""
    if carriers and r.random() < 0.85:
        t = r.choice(carriers)
        at = r.randint(0, max(0, len(t) - 40))
        return t[at : at + r.randint(8, 60)]
    return "".join((_decoy(r) if r.random() < 0.15 else _word(r)) + r.choice([" ", " ", " ", "\n"]) for _ in range(r.randint(1, 6)))


def labelled_text(r: random.Random, carriers: list[str], least: int, dense: float = 0.6) -> tuple[str, list[Span]]:
    """A text of `least` characters or more, and its spans: prose with spans and look-alikes put in."""
    text, marks = "", []
    while len(text) < least:
        lo = len(text)
        text += _prose(r, carriers)
        marks += [(lo + a, lo + b, k) for a, b, k in shapes(text[lo:])]
        if r.random() < dense:
            text += r.choice([" ", " ", " ", " (", ": ", ", "])
            if r.random() < 0.65:
                kind, s = _entity(r)
                marks.append((len(text), len(text) + len(s), kind))
                text += s
            else:
                text += _decoy(r)
            text += r.choice([" ", " ", ", ", ". ", ") ", "\n"])
        else:
            text += " "
    return text, marks


def labelled_windows(n: int, seed: int = 11, carriers: list[str] | None = None, width: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """n windows of prose with spans of known kind and place, and look-alikes that are none."""
    r, codes, tags = random.Random(seed), np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)
    for i in range(n):
        text, marks = labelled_text(r, carriers or [], width + 16, r.choice([0.25, 0.7, 0.9]))
        shift = r.randint(0, 16)
        codes[i] = char_codes(text[shift : shift + width])
        for a, b, kind in marks:
            a, b = a - shift, b - shift
            if 0 <= a and b <= width:
                tags[i, a], tags[i, a + 1 : b] = TAGS.index(f"B-{kind}"), TAGS.index(f"I-{kind}")
            elif a < width and b > 0:  # cut off at the edge: unlabelled, so blank it
                codes[i, max(0, a) : b] = 1
        if r.random() < 0.25:  # the end of a text
            end = r.randint(12, width)
            while end < width and tags[i, end] and TAGS[tags[i, end]][0] == "I":
                end += 1
            codes[i, end:], tags[i, end:] = 0, 0
    return codes, tags


@functools.lru_cache(maxsize=4)
def trained_tagger(windows: int = 7000, epochs: int = 10, seed: int = 11, carriers: tuple[str, ...] = ()) -> Tagger:
    """The tagger, fitted on `windows` labelled windows (the bound of its training sample)."""
    tagger = Tagger()
    tagger.fit(*labelled_windows(windows, seed, list(carriers)), epochs)
    return tagger


def carriers_of(rows: DataFrame, most: int = 2000, chars: int = 200) -> tuple[str, ...]:
    """Prose of the table for the training windows: of the `most` rows with the smallest hash of id and text, `chars`
    characters from a place that the hash gives."""
    h = F.xxhash64("doc_id", F.xxhash64("text"))
    thin = max(1, rows.count() // (4 * most))  # about four times as many as wanted come to the driver's choice
    place = F.pmod(h, F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    some = rows.where("length(text) > 0").where(F.pmod(h, F.lit(thin)) == 0).select(h.alias("h"), F.substring("text", place, F.lit(chars)).alias("t"))
    return tuple(r["t"] for r in some.orderBy("h", "t").limit(most).collect())


def _valid(kind: str, s: str) -> bool:
    """The exact check of what a character model cannot count: Luhn and lengths of numbers, sizes of an address's parts;
    and an email holds an at and a dot, as signs or words."""
    digits = _DIGIT.findall(s)
    if kind == "ip":
        parts = re.findall("[0-9]+", s)
        return len(parts) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in parts)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn("".join(digits))
    if kind == "email":
        words = re.findall("[a-z]+", s.lower())
        return ("@" in s or "at" in words[1:-1]) and ("." in s or "dot" in words[1:-1])
    return 9 <= len(digits) <= 15


def _decoded(parts: list[tuple[int, int, int]], texts: list[str], coded: list[np.ndarray], tagger: Tagger) -> Iterator[tuple[int, int, int, str, float, bool]]:
    """(text, start, end, kind, score, whole) of the spans in windows (text, start, end) of one width or less."""
    width = max(e - s for _, s, e in parts)
    lengths = np.array([e - s for _, s, e in parts])
    codes = np.zeros((len(parts), width), np.int64)
    for i, (k, s, e) in enumerate(parts):
        codes[i, : e - s] = coded[k][s:e]
    for (k, s, e), spans in zip(parts, tagger.decode(codes, lengths)):
        for a, b, kind, score in spans:
            yield k, s + a, s + b, kind, score, (a > 0 or s == 0) and (s + b < e or e == len(texts[k]))


def model_spans(texts: list[str], tagger: Tagger, margin: float = MARGIN) -> list[list[tuple[int, int, str, float]]]:
    """The spans that the tagger finds in each whole text, reconciled over all of its windows."""
    found: list[dict[tuple[int, int, str], float]] = [{} for _ in texts]
    cut: list[tuple[int, int, int]] = []
    coded = [char_codes(t) for t in texts]
    windows = [(k, s, min(len(t), s + WIDTH)) for k, t in enumerate(texts) for s in range(0, max(1, len(t) - WIDTH + STEP), STEP) if t]

    def take(parts: list[tuple[int, int, int]]) -> None:
        for k, a, b, kind, score, whole in _decoded(parts, texts, coded, tagger):
            if not whole:
                cut.append((k, a, b))
            elif score >= margin and _valid(kind, texts[k][a:b]):
                found[k][a, b, kind] = max(score, found[k].get((a, b, kind), score))

    windows.sort(key=lambda w: w[2] - w[1])  # those of a batch have about one length
    for lo in range(0, len(windows), AT_ONCE):
        take(windows[lo : lo + AT_ONCE])
    width = 2 * WIDTH
    while cut and width <= WIDEST:  # a wider window around each span that an edge may have cut off
        again, cut = sorted({(k, max(0, (a + b - width) // 2), min(len(texts[k]), (a + b + width) // 2)) for k, a, b in cut}), []
        for lo in range(0, len(again), AT_ONCE // 4):
            take(again[lo : lo + AT_ONCE // 4])
        width *= 2
    return [heaviest(sorted((a, b, kind, v) for (a, b, kind), v in f.items())) for f in found]


def heaviest(spans: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """The set of disjoint spans with the largest sum of score times length."""
    from bisect import bisect_right

    spans = sorted(spans, key=lambda x: (x[1], x[0], x[2]))
    ends, best = [x[1] for x in spans], [0.0]
    take = []
    for i, (a, b, _, v) in enumerate(spans):
        j = bisect_right(ends, a, 0, i)
        with_it = best[j] + v * (b - a)
        take.append(j if with_it > best[i] else -1)
        best.append(max(best[i], with_it))
    out, i = [], len(spans)
    while i:
        if take[i - 1] >= 0:
            out.append(spans[i - 1])
            i = take[i - 1]
        else:
            i -= 1
    return out[::-1]


def all_spans(texts: list[str], tagger: Tagger, margin: float = MARGIN) -> list[tuple[list[Span], list[Span]]]:
    """Of each text the base spans, and those the tagger adds: none of them overlaps a base span. Both by kind, then
    start."""
    out = []
    for text, spans in zip(texts, model_spans(texts, tagger, margin)):
        base = base_spans(text)
        taken = sorted((a, b) for a, b, _ in base)
        added = [(a, b, k) for a, b, k, _ in spans if not any(x < b and a < y for x, y in taken)]
        out.append((base, sorted(added, key=lambda x: (KINDS.index(x[2]), x[0]))))
    return out


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows: int = 7000, carriers: int = 2000, margin: float = MARGIN) -> DataFrame:
    """doc_id, spans array<struct<start, end, kind, added>> of each row; offsets in code points, end exclusive.

    The tagger is trained on `windows` windows over prose of `carriers` rows, and goes to the executors as a broadcast
    (some 30 KB of weights, whatever the data)."""
    spark = df.sparkSession
    small_batches(spark)
    rows = plain(df, ("doc_id", id_col), ("text", text_col))
    weights = spark.sparkContext.broadcast(trained_tagger(windows, carriers=carriers_of(rows, carriers) if carriers else ()))
    kind = rows.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("added", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for base, added in all_spans(texts_of(b), weights.value, margin):
                out.append([{"start": s, "end": e, "kind": k, "added": new} for new, part in ((False, base), (True, added)) for s, e, k in part])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    return rows.mapInArrow(run, f"doc_id {kind}, spans array<struct<start:int,end:int,kind:string,added:boolean>>")


def digest(spans: list[dict]) -> str:
    """kind:start:end by kind as in KINDS, then start, comma-joined."""
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in sorted(spans, key=lambda s: (KINDS.index(s["kind"]), s["start"])))


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    for a, b, kind in sorted(spans, reverse=True):
        text = f"{text[:a]}<{kind}>{text[b:]}"
    return text


def holdout(doc_id: object) -> int:
    return zlib.crc32(str(doc_id).encode()) % 4
